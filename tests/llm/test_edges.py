"""Every operator and stage: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import os

import pytest

import corpus_pipeline
from tapewright.llm import bpe, chat, lines, minhash, mixture, near, outliers, quality, simhash, suffix, toxicity
from tapewright.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, ids string, taken long, a long, component_id long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))


def rows():
    base = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
        (2, None, "en", "s1"),
        (3, "", None, None),
        (4, "  \n\t ", "en", ""),
        (None, "a row without any id but with words enough to hash", "en", "s2"),
        (5, LONG, "en", "s2"),
        (6, "x" * 50_000, "de", "s2"),
        (7, "éàü 漢字 ␛ <|endoftext|> </s>", "fr", "s1"),
        (8, "the quick brown fox jumps over the lazy dog again and again", "en", "s3"),
    ]
    return [(i, t, g, s, len(t or ""), 1, 0.5, "x", 2, 3, 4) for i, t, g, s in base]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    for folder, data in ((full, rows()), (empty, [])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        lab = [(1, 1, 0), (2, 0, 1), (None, None, None), (5, 1, 0), (7, 0, 1), (8, 1, None)] if data else []
        spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        conv = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", "</s>␛")] if data else []
        spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return full, empty


@pytest.mark.parametrize("name", [n for n in queries() if n not in ("op7_chat", "op11_spelling", "op12_lloyd")])
def test_edge_rows(spark, tables, name):
    got = queries()[name](spark, tables[0]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows())
    assert queries()[name](spark, tables[1]).collect() == []


def test_edge_conversations(spark, tables):
    got = {r.conv_id: r for r in chat.op7_chat(spark, tables[0]).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[2].loss_chars == 5 and got[None].n_turns == 1 and got[-7].n_turns == 2
    assert [r.conv_id for r in chat.op7_chat(spark, tables[1]).collect()] == [-7]


def test_stages_keep_columns(spark, tables):
    for folder in tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, folder)
            assert out.columns == docs.columns, name
            out.collect()
        assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "n_tokens"}


def test_empty_texts(spark, tables):
    fp = {r.doc_id: r for r in simhash.op2_simhash(spark, tables[0]).collect()}
    assert fp[2].fingerprint == fp[3].fingerprint == "0" * 16 and fp[3].component_id == 2 and fp[8].component_id == 1
    m = {r.doc_id: r for r in minhash.op6_minhash(spark, tables[0]).collect()}
    assert set(m[2].fingerprint) == {"0"} and m[2].near_next == 1.0
    s = {r.doc_id: r for r in suffix.op9_suffix(spark, tables[0]).collect()}
    assert s[6].n_removed == 50_000 and s[2].n_bytes == 0 and s[1].n_removed == 0
    x = {r.doc_id: r for r in mixture.op3_mixture(spark, tables[0]).collect()}
    assert x[2].size == x[3].size == x[4].size == 0 and all(r.taken <= 2 * r.size for r in x.values())
    o = {r.doc_id: r for r in outliers.op5_outliers(spark, tables[0]).collect()}
    assert o[2].base_failed and not o[2].kept and o[5].n_words == 24_000
    assert {r.doc_id: r.score for r in toxicity.op10_toxicity(spark, tables[0]).collect()}[3] == 0.0
    assert all(0 <= r.score <= 1 for r in quality.op4_quality(spark, tables[0]).collect())
    line = {r.doc_id: r for r in lines.op8_lines(spark, tables[0]).collect()}
    assert line[8].n_removed == 1 and line[1].n_removed == 0
    assert os.path.exists(bpe.default_vocabulary())


def test_near_copies_reduce_to_one(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    kept = [r.doc_id for r in near.keep_one(spark, docs).collect()]
    assert kept.count(1) == 1 and 8 not in kept and kept.count(2) == 1 and 3 not in kept and None in kept
