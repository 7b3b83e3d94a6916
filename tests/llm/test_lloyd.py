"""Dual-tree Lloyd rounds against plain ones."""

import hashlib

import numpy as np
import pytest

from tapewright.llm import lloyd


def _plain(ids, x, k=40, rounds=5):
    order = sorted(range(len(ids)), key=lambda j: hashlib.sha256(f"2:{ids[j]}".encode()).hexdigest())[:k]
    c = [list(map(int, x[j])) for j in order]
    nearest = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c)) for v in x.tolist()]
    for _ in range(rounds):
        own = nearest()
        for i in range(len(c)):
            mine = [v for v, (_, o) in zip(x.tolist(), own) if o == i]
            c[i] = [sum(t) // len(mine) for t in zip(*mine)] if mine else c[i]
    own = nearest()
    part = {i: sum(d for d, o in own if o == i) for i in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((i, o, d, part[o], sum(part.values()), sha[o]) for i, (d, o) in zip(ids, own))


def test_query_equals_plain_rounds(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    assert sorted(map(tuple, lloyd.op12_lloyd(spark, sf).collect())) == _plain([i for i, _ in rows], x)


def test_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(int(i), rng.normal(size=64).round(2).tolist()) for i in range(90)]
    good += [(200 + i, good[7][1]) for i in range(60)] + [good[3], (500, [0.0] * 64)]
    bad = [(300, None), (301, []), (302, [0.1] * 63), (303, [None] + [0.1] * 63), (304, [float("nan")] + [0.1] * 63), (305, [float("-inf")] + [0.1] * 63)]
    rows = [(i, v, 1, 2, "t") for i, v in good + bad]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, id long, tree string").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.floor(256 * np.array([v for _, v in good])).astype(np.int64)
    assert sorted(map(tuple, lloyd.op12_lloyd(spark, str(tmp_path)).collect())) == _plain([i for i, _ in good], x)
    for name, some in (("few", good[:5]), ("empty", [])):
        spark.createDataFrame(some, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = sorted(map(tuple, lloyd.op12_lloyd(spark, f"{tmp_path}/{name}").collect()))
        assert got == (_plain([i for i, _ in some], x[:5]) if some else [])


def test_tree_covers_and_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, (300, 8)) for c in rng.normal(0, 300, (12, 8))]).astype(np.int64)
    t = lloyd.cover_tree(x, 10)
    assert sorted(t["order"]) == list(range(len(x)))
    for k, (c, up) in enumerate(zip(t["centre"], t["parent"])):
        below = t["order"][t["first"][k] : t["last"][k]]
        assert np.sqrt(lloyd.squared(x[below], x[c : c + 1]).max()) <= t["radius"][k]
        assert up < 0 or (t["first"][up] <= t["first"][k] and t["last"][k] <= t["last"][up])


@pytest.mark.parametrize("width,spread", [(2, 300), (8, 300), (64, 0)])
def test_pruned_pairs_change_nothing(width, spread):
    """In clustered data most pairs are never compared; in data without any structure all may be. Ties go to the smaller number."""
    rng = np.random.default_rng(width)
    at = rng.normal(0, spread, (40, width)) if spread else np.zeros((40, width))
    x = np.concatenate([rng.normal(c, 10, (60, width)) for c in at]).astype(np.int64)
    c = x[rng.integers(0, len(x), 38)]
    c = np.concatenate([c, c[:2]])  # equal centroids
    with_tree = {k: v for k, v in np.load(lloyd.io.BytesIO(lloyd.block(x))).items()}
    best, compared = lloyd.assign(with_tree, c, lloyd.cover_tree(c, lloyd.CENTROID_LEAF))
    assert (best == lloyd.squared(with_tree["points"], c).argmin(axis=1)).all()
    assert compared < 0.3 * len(x) * len(c) or not spread


def test_large_components():
    a = np.array([[1 << 24, -(1 << 24)], [0, 1]])
    assert lloyd.squared(a, a).tolist() == [[0, (1 << 48) + ((1 << 24) + 1) ** 2], [(1 << 48) + ((1 << 24) + 1) ** 2, 0]]
    with pytest.raises(OverflowError):
        lloyd.squared(a << 10, a)
