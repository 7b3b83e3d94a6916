"""The near-copy stage against all pairs' five-word similarity."""

import random
from collections import Counter

import corpus_pipeline
from tapewright.llm import near


def _kept(docs):
    sets = {i: set(near.shingle_set(t or "").tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def test_stage_equals_all_pairs(spark):
    rng = random.Random(4)
    docs, n = [(0, None), (1, " \n"), (2, "one two"), (3, "One  TWO")], 10
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 150, 900)))]
        docs.append((n, " ".join(base)))
        for share in (0.01, 0.02, 0.03, 0.06):
            copy = list(base)
            for k in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[k] = f"x{rng.randrange(9999)}"
            docs.append((n := n + 1, " ".join(copy)))
        n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(got) == sorted(_kept(docs))


def test_texts_of_one_id_are_told_apart(spark):
    one, two = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (None, one)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text[0]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == [(0, "a"), (1, "a"), (1, "b")]


def test_pairs_among_many_that_are_almost_alike(spark):
    """One text's variants: 300 true pairs at 0.836, all others at 0.635; every pair is found, and nothing else."""
    base, docs = [f"w{i}" for i in range(700)], []
    rng = random.Random(8)
    for k in range(300):
        twin = list(base)
        for at in rng.sample(range(0, 700, 8), 18):
            twin[at] = f"p{k}x{at}"
        for half in range(2):
            copy = list(twin)
            for at in rng.sample([x for x in range(4, 700, 8)], 7):
                copy[at] = f"q{k}x{half}x{at}"
            docs.append((2 * k + half, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r.doc_id for r in near.keep_one(spark, df).collect())
    assert got == sorted(_kept(docs)) and len(got) == 300


def test_queries_against_all_rows(spark):
    """Every link at 0.8 or more of each 50th document of sf0.1 to any other lies within one group."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marked = df.withColumn("source", df.doc_id.cast("string"))
    sets = {r.doc_id: set(near.shingle_set(r.text or "").tolist()) for r in df.select("doc_id", "text").collect()}
    where = {}
    for i, s in sets.items():
        for h in s:
            where.setdefault(h, []).append(i)
    kept = {r.doc_id for r in near.keep_one(spark, marked).collect()}
    for i in (i for i in sets if i % 50 == 0 and sets[i]):
        shared = Counter(j for h in sets[i] for j in where[h])
        alike = {j for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
        assert len(alike & kept) <= 1, i
