"""Operators against brute force, exact round trips, other implementations and held-out labels."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import bpe, chat, common, lines, minhash, mixture, outliers, quality, simhash, suffix, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(bpe.default_vocabulary()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("abcdefgh étàß '!\n\t\x1c\x85\xa0０½漢😀ſ'st<|endoftext|>AB12"), max_size=60))
def test_bpe_like_the_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode_batch([text]) == [want]
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, SF).collect()}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("cell", [1024, 3])
def test_simhash_links_all(spark, cell, monkeypatch):
    """Random fingerprints and tight clusters: components equal brute force, with and without split cells."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(6)]
    fps = sorted({*map(int, base), *near, 0, 1, 3, 7, 2**64 - 1})
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.node: r.component for r in common.components(spark, simhash.link(spark, df)).collect()}
    want = _components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_fingerprint_like_a_plain_loop(spark, docs):
    import xxhash

    got = {r.doc_id: r.fingerprint for r in simhash.op2_simhash(spark, SF).collect()}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        assert got[i] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


@pytest.mark.parametrize("r", [1, 3, 6])
def test_pivot_cells_and_tables_lose_no_link(spark, r):
    """Of pairs 4 bits apart every one shares a cell, and no coordinate differs by more; most random pairs share none."""
    rng = np.random.default_rng(r)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    y = np.array([int(v) ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for v in x], np.uint64)
    refs = np.array([p for g in simhash.pivots(4, r) for p in g], np.uint64)
    assert np.abs(simhash.pivot_table(x, refs) - simhash.pivot_table(y, refs)).max() <= 4
    rows = [(simhash._signed(int(v)), i) for i, v in enumerate(x)] + [(simhash._signed(int(v)), 1000 + i) for i, v in enumerate(y)]
    cells: dict = {}
    for row in simhash.cells_of(spark.createDataFrame(rows, "fp long, id long"), 4, r).collect():
        cells.setdefault(row.id, set()).add((row.m, row.cell))
    assert all(cells[i] & cells[1000 + i] for i in range(300))
    assert np.mean([bool(cells[i] & cells[j]) for i in range(300) for j in range(i)]) < 0.01


def test_components_on_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in common.components(spark, links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and got[5000] == 5000


def test_mixture_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixture.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in mixture.op3_mixture(spark, SF).collect()) == want


def test_flow_prefers_unrepeated_and_serves_overlaps():
    # words of both sources go where they lack; none is repeated while others lie idle
    got = mixture.route([(("a",), 10), (("a", "b"), 10)], {"a": 12, "b": 8})
    assert sum(f.get("a", 0) for f in got) == 12 and got[1]["b"] == 8 and sum(map(sum, (f.values() for f in got))) == 20
    got = mixture.route([(("a",), 10)], {"a": 15})
    assert got == [{"a": 15}]


def test_outliers_base_statistics(spark, docs):
    got = {r.doc_id: r for r in outliers.op5_outliers(spark, SF).collect()}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        under = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        worded = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(under))
        assert r.base_failed == (len(w) < 20 or 100 * len(under) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_outliers_estimate_resists_planted_outliers(spark):
    """A tenth of planted outliers is beyond the cutoff, and hardly moves the centre."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 2, 0.5, 1, 3] + [0, 5, 1, 2, 3]
    x[:40] += 60
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{c} double" for c in outliers.X))
    fit = outliers.estimate(spark, df)
    d = np.array([r[0] for r in df.join(fit, "g").select(outliers._distance()).collect()])
    xs = np.array([[r[c] for c in outliers.X] for r in df.collect()])
    far = (xs[:, 0] > 30)
    assert (d[far] > outliers.CUTOFF).all() and (d[~far] < outliers.CUTOFF).mean() > 0.99
    m = fit.first()
    core = xs[~far]
    assert np.allclose([m[f"m{i}"] for i in range(5)], core.mean(0), atol=0.35 * core.std(0).max())


def _mcd(x: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Squared distances of rows to the estimate that plain concentration steps give."""
    n, p = x.shape
    ranks = [max(0, int(np.ceil(q * n)) - 1) for q in (0.16, 0.5, 0.84)]
    low, mid, high = np.sort(x, axis=0)[ranks]
    found = []
    for m, cov in ((mid, np.diag(((high - low) / 2) ** 2 + floors**2)), (x.mean(0), np.diag(x.var(0) + floors**2))):
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            bins = np.floor(np.log(d + 1e-9) * 24)
            cut = np.sort(bins)[int(np.ceil(n * outliers.CORE)) - 1]
            core = x[bins <= cut]
            m, cov = core.mean(0), np.cov(core.T, bias=True) * outliers.CONSISTENT + np.diag(floors**2)
        found.append((np.linalg.slogdet(cov)[1], m, cov))
    _, m, cov = min(found, key=lambda f: f[0])
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)


def test_outliers_verdicts_like_a_plain_loop(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text").collect()
    place = {r.doc_id: (r.lang, r.source) for r in table}
    worded = {r.doc_id: len([x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]) for r in table}
    rows = outliers.judge(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    groups: dict = {}
    for r in rows:
        if not r.base_failed:
            v = (np.log1p(r.n_words), (r.word_chars + 250) / (r.n_words + 50), np.sqrt(r.n_symbols / (r.word_chars + 50)), np.sqrt(r.n_dup_lines / (worded[r.doc_id] + 4)), np.sqrt(r.n_repeat_words / (r.n_words + 50)))
            groups.setdefault(place[r.doc_id], []).append((r, v))
    for members in groups.values():
        d = _mcd(np.array([v for _, v in members]), np.array(outliers.FLOORS))
        for (r, _), want in zip(members, d):
            assert np.isclose(r.distance, want, rtol=1e-6, atol=1e-6) and r.kept == (want <= outliers.CUTOFF)
    assert not any(r.kept and r.base_failed for r in rows)


def test_minhash_estimates_jaccard(spark, docs):
    got = {r.doc_id: r for r in minhash.op6_minhash(spark, SF).collect()}
    err = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (set(minhash.shingle_hashes(x).tolist()) for x in (t, e, nxt))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        err += [got[i].near_edited - len(a & b) / len(a | b), got[i].near_next - len(a & c) / len(a | c)]
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.04


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("␛<>|/s[]INSTY elb"), max_size=40))
def test_chat_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))


def test_chat_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.sql(chat.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in chat.op7_chat(spark, SF).collect()) == want


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"prompt": "a", "response": "b"}', '{"instruction": "a", "input": "", "output": "b"}', '{"instruction": "a", "output": "b"}',
        '{"prompt": "a", "completion": "b"}', '{"question": "a", "answer": "b"}', '{"system": "s", "prompt": "a", "response": "b"}',
    ]
    df = spark.createDataFrame(list(enumerate(records)) + [(9, '{"other": 1}'), (10, "no json"), (11, None)], "k long, j string")
    got: dict = {}
    for r in chat.format_records(df, "j", ["k"]).orderBy("k", "at").collect():
        got.setdefault(r.k, []).append(r.segment and chat.read_turn(r.segment))
    assert all(got[i] == [("user", "a"), ("assistant", "b")] for i in range(7)) and got[7] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert got[9] == got[10] == got[11] == [None]
    turns = chat.format_records(df, "j", ["k"]).withColumnRenamed("k", "conv_id").withColumn("turn", F.lit(0))
    assert sorted((r.conv_id, r.n_turns) for r in chat.conversation_digests(spark, turns).collect()) == [(i, 2 + (i == 7)) for i in range(8)]


def test_lines_remove_later_runs(spark):
    long = "this line has more than ten words in it to count as one run"
    docs = [(1, f"{long}\nshort\nother start here"), (2, f"unlike\n{long}\nshort\nelse"), (3, "short\nnothing"), (4, f"{long}\n\n{long}")]
    got = {r.doc_id: r for r in lines.dedup(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "unlike\nelse" and got[3].text == docs[2][1] and got[4].text.strip() == ""


def test_suffix_sort_orders_by_content():
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(97, 99, 230, dtype=np.uint8)) for _ in range(9)]
    t = suffix.Texts(pieces)
    at = np.concatenate([b + np.arange(25) for b in t.begin])
    got = t.merge_sort(at, np.zeros(len(at), int))
    key = lambda p: t.data[p : p + 200].tobytes()
    assert [key(p) for p in got] == sorted(key(p) for p in at)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, lab[r.doc_id]) for r in quality.op4_quality(spark, sf).collect() if r.held_out and r.doc_id in lab]
    assert np.mean([a == b for a, b in got]) > 0.93


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, lab[r.doc_id]) for r in toxicity.op10_toxicity(spark, sf).collect() if r.held_out and lab.get(r.doc_id) is not None]
    hit, told, there = sum(a & b for a, b in got), sum(a for a, _ in got), sum(b for _, b in got)
    assert hit / told >= 0.95 and hit / there >= 0.85  # several of those missed have no insult left in their text


def test_string_kernel_is_gap_tolerant():
    k = toxicity.Landmarks(["<idiot>"]).kernel(["<idiot>", "<idxiot>", "<iddiot>", "<station>"])[:, 0]
    assert k[0] > 0.99 and k[1] > 0.4 and k[2] > 0.6 and k[3] < 0.3
    assert "idiot" in toxicity.tokens("you i d i o t there")
