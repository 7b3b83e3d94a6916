"""Suffix dedup against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapewright.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(texts):
    """Bytes, bytes removed, maximal removed runs and what is left, of each text."""
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for raw in texts:
        edge = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        under = np.cumsum(edge[:-1]) > 0
        n = int((np.diff(np.r_[False, under].astype(int)) == 1).sum())
        yield len(raw), int(under.sum()), n, np.frombuffer(raw, np.uint8)[~under].tobytes()


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove(spark, df).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute([t.encode() for t in texts]))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_query_like_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op9_suffix(spark, SF).collect()}
    for (i, _), (n, gone, k, left) in zip(docs, brute([t for _, t in docs])):
        assert got[i] == (n, gone, k, hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("chunk", [2048, 7])
def test_hot_passage_with_many_surroundings(spark, chunk, monkeypatch):
    """A passage shared by many texts, each of which shares a different stretch of its surroundings with a few others."""
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    hot, sides = word(190), [word(60) for _ in range(6)]
    texts = [word(rng.randrange(80)) + rng.choice(sides)[-rng.randrange(1, 60) :] + hot + rng.choice(sides)[: rng.randrange(60)] + word(rng.randrange(80)) for _ in range(60)]
    texts += [texts[0]] * 40 + ["", "x" * 500, "short", texts[1] + texts[1]]
    check(spark, texts)
