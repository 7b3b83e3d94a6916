"""Spelling variants against plain loops over words."""

import random
import re
import zlib
from collections import Counter

from tapewright.llm import spelling

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _vocabulary(docs):
    seen = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def _near(words):
    """All pairs at distance one, by what is left when one code point is deleted or masked."""
    out, masked = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            masked.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            if (x := w[:i] + w[i + 1 :]) in out:
                out[w].add(x)
                out[x].add(w)
    for group in masked.values():
        for a in group:
            out[a].update(b for b in group if b != a)
    return out


def _forms(words):
    near = _near(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_query_equals_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = _forms(_vocabulary(docs))
    assert _rows(spelling.op11_spelling(spark, sf)) == want and any(w[1] for w in want)


def test_edge_rows(spark, tmp_path):
    long = "äbcdefgh" * 2_000
    docs = [(1, None), (2, ""), (3, f"{long} {long}x {long}"), (4, f"{long}x Zebraſtripes {long}x"), (None, "letters lettters letters"), (5, "letterſ lettters LETTERS"), (5, "letterſ lettters LETTERS")]
    rows = [(i, t, "x", 9, "y") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    want = _forms(_vocabulary(docs))
    assert _rows(spelling.op11_spelling(spark, str(tmp_path))) == want and any(len(w[0]) > 10_000 and w[4] for w in want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op11_spelling(spark, f"{tmp_path}/empty").collect() == []


def test_large_subtrees_are_parted_further(spark):
    """Subtrees of at most 3 words: every pair is found in some finer one, once."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))) for _ in range(400)}
    words |= {w[: (i := rng.randrange(len(w)))] + rng.choice("abé") + w[i:] for w in list(words)}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    for most in (3, 20_000):
        got = [(r.word, r.other) for r in spelling.near_words(spark, df, most=most).collect()]
        want = sorted((a, b) for a, bs in _near(words).items() for b in bs)
        assert sorted(got) == want and len(want) > 1_000


def test_chains_of_forms_are_followed(spark):
    words = {"aaaaaaa": 1000, "aaaaaaab": 100, "aaaaaaabb": 10, "aaaaaaabbc": 1, "zzzzzzz": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = _rows(spelling.forms(spark, df, spelling.near_words(spark, df)))
    assert got == _forms(words) and {r[0]: r[2] for r in got}["aaaaaaabbc"] == "aaaaaaa"
