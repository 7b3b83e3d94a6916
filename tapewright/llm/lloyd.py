"""Lloyd's rounds by dual trees: a cover tree over each block of vectors, a tree over the centroids of each round.

Blocks are runs of at most BLOCK rows of a task's input, so no vector is
shuffled. A block's cover tree is built once, by farthest-first insertion: the
centres inserted at a distance above 2^i are the net of level i, a centre's parent is the
nearest centre of the level above, and every point hangs on its nearest centre of the
finest net. Trees are written to the shared folder with their vectors, subtree
sums and radii, and each round streams them.

A round walks both trees together. A pair of nodes is dropped if its least
distance exceeds the largest that another pair leaves to all vectors of the
vector node; a vector node with one centroid left takes it whole, by its stored
sum. Pairs of leaves are compared exactly, on integers. A task returns one sum per
centroid, so a round sends (tasks x centroids) rows, and the driver holds
the centroids alone.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import done_with, read_table, stage

#: Rows of a block, and rows of a leaf that is not parted further.
BLOCK, LEAF = 4096, 24
#: Centroids of a leaf of the centroid tree.
CENTROID_LEAF = 1
#: Components up to this size have squared distances that doubles hold exactly (at most 2^53 over 64 components).
EXACT = 1 << 22


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all of b (int64; OverflowError where they do not fit)."""
    width = max(1, a.shape[1])
    most = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if 4 * most * most * width <= 1 << 53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.rint((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    if 4 * most * most * width >= 1 << 63:
        raise OverflowError("a squared distance exceeds 64 bits")
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` centres, each the point farthest from those before it; their insertion distances; each point's nearest centre."""
    centres, reach = [0], [np.inf]
    near = np.sqrt(squared(points, points[:1])[:, 0])
    owner = np.zeros(len(points), np.int64)
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= 0:
            break
        reach.append(float(near[far]))
        d = np.sqrt(squared(points, points[far : far + 1])[:, 0])
        owner[d < near] = len(centres)
        near = np.minimum(near, d)
        centres.append(far)
    return np.array(centres), np.array(reach), owner


def cover_tree(points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Nodes in an order in which children follow their parents.

    centre (row of points), radius (largest distance to a point below), parent, is_leaf; first and last: the node's
    points are order[first:last].
    """
    centres, reach, owner = farthest_first(points, max(1, -(-len(points) // leaf)))
    level = np.full(len(centres), 1 << 30)
    level[1:] = np.ceil(np.log2(reach[1:])).astype(int) - 1  # on all nets of 2^i and finer, 2^i < reach
    parent = np.zeros(len(centres), np.int64)
    for j in range(1, len(centres)):  # the net of the level above holds earlier centres only, of which centre 0 is one
        above = np.flatnonzero(level[:j] > level[j])
        parent[j] = above[squared(points[centres[j : j + 1]], points[centres[above]])[0].argmin()]
    below: dict[int, list[int]] = {}
    for j in range(1, len(centres)):
        below.setdefault(int(parent[j]), []).append(j)
    members = {int(j): np.flatnonzero(owner == j) for j in range(len(centres))}
    nodes, order, at = [], [], 0
    # a frame is (centre, its children not split off yet, parent node); a node parts into its finest children and itself one level down
    stack = [(0, sorted(below.get(0, []), key=lambda c: -level[c]), -1)]
    while stack:
        j, kids, up = stack.pop()
        me = len(nodes)
        nodes.append([int(centres[j]), up, not kids, j])
        if kids:
            top = level[kids[0]]
            now, later = [c for c in kids if level[c] == top], [c for c in kids if level[c] != top]
            stack += [(c, sorted(below.get(c, []), key=lambda x: -level[x]), me) for c in now] + [(j, later, me)]
    span = [[0, 0] for _ in nodes]
    kids_of: dict[int, list[int]] = {}
    for k, (_, up, _, _) in enumerate(nodes):
        kids_of.setdefault(up, []).append(k)
    walk = [(0, False)]
    while walk:
        k, over = walk.pop()
        if over:
            span[k][1] = at
            continue
        span[k][0] = at
        walk.append((k, True))
        if nodes[k][2]:
            rows = members[nodes[k][3]]
            order.append(rows)
            at += len(rows)
        else:
            walk += [(c, False) for c in reversed(kids_of[k])]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    span = np.array(span)
    centre = np.array([n[0] for n in nodes])
    radius = np.array([np.sqrt(squared(points[order[a:b]], points[c : c + 1]).max()) if b > a else 0.0 for c, (a, b) in zip(centre, span)])
    return {"centre": centre, "radius": radius, "parent": np.array([n[1] for n in nodes]), "is_leaf": np.array([n[2] for n in nodes]), "first": span[:, 0], "last": span[:, 1], "order": order}


def block(points: np.ndarray) -> bytes:
    """A block's vectors in tree order with its tree and the sum of each node's vectors."""
    t = cover_tree(points, LEAF)
    ordered = points[t["order"]]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, axis=0)])
    t |= {"points": ordered, "at": points[t["centre"]], "sums": total[t["last"]] - total[t["first"]]}
    out = io.BytesIO()
    np.savez(out, **{k: v for k, v in t.items() if k != "centre"})
    return out.getvalue()


def children(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the start and number of its children in a list of nodes ordered by parent."""
    listed = np.argsort(parent, kind="stable")
    counts = np.bincount(parent[parent >= 0], minlength=len(parent))
    return listed, int((parent < 0).sum()) + np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def _spread(pairs: np.ndarray, leaf: np.ndarray, kids: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``pairs`` (nodes) replaced by its children, leaves by themselves: (index into pairs, node)."""
    listed, start, count = kids
    n = np.where(leaf[pairs], 1, count[pairs])
    index = np.repeat(np.arange(len(pairs)), n)
    offset = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
    node = pairs[index]
    kid = listed[np.minimum(start[node] + offset, len(listed) - 1)]
    return index, np.where(leaf[node], node, kid)


def assign(t: dict[str, np.ndarray], centroids: np.ndarray, c: dict[str, np.ndarray], take=None) -> tuple[np.ndarray, int]:
    """Nearest centroid of each vector of a block's tree (ties: the smaller number), and the count of exact comparisons.

    ``take(node, centroid)`` is told of vector nodes that one centroid takes whole.
    """
    best = np.full(len(t["points"]), -1, np.int64)
    if not len(best):
        return best, 0
    q_kids, r_kids = children(t["parent"]), children(c["parent"])
    c_at = centroids[c["centre"]]
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.full(len(t["parent"]), np.inf)
    compared = 0
    while len(q):
        d = np.sqrt(_paired(t["at"][q], c_at[r]))
        np.minimum.at(bound, q, d + t["radius"][q])
        slack = 1e-9 * (1 + bound[q])
        left = d - t["radius"][q] - c["radius"][r] <= bound[q] + slack
        q, r = q[left], r[left]
        # one centroid left: the whole vector node is its own
        size = c["last"][r] - c["first"][r]
        many = np.bincount(q, weights=size, minlength=len(bound))[q]
        for node, leaf in zip(q[many == 1], r[many == 1]):
            one = int(c["order"][c["first"][leaf]])
            best[t["first"][node] : t["last"][node]] = one
            if take:
                take(int(node), one)
        q, r = q[many > 1], r[many > 1]
        done = t["is_leaf"][q] & c["is_leaf"][r]
        # a vector leaf is compared once all its centroid nodes are leaves
        wait = np.bincount(q[~done], minlength=len(bound)) > 0
        for node in np.unique(q[done & ~wait[q]]):
            some = np.sort(np.concatenate([c["order"][c["first"][x] : c["last"][x]] for x in r[q == node]]))
            a, b = t["first"][node], t["last"][node]
            best[a:b] = some[squared(t["points"][a:b], centroids[some]).argmin(axis=1)]
            compared += (b - a) * len(some)
        go = ~done | wait[q]
        q, r = q[go], r[go]
        i, kid = _spread(q, t["is_leaf"], q_kids)
        bound[kid] = np.minimum(bound[kid], bound[q[i]])
        j, below = _spread(r[i], c["is_leaf"], r_kids)
        q, r = kid[j], below
    return best, compared


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    d = a - b
    return np.einsum("ij,ij->i", d.astype(np.float64), d.astype(np.float64))


def _blocks(vectors: DataFrame) -> DataFrame:
    """``vectors(id, v array<long>)`` as rows (ids in tree order, tree)."""

    def run(batches):
        ids, rows = [], []

        def made():
            points = np.array(rows, np.int64)
            t = block(points)
            with np.load(io.BytesIO(t)) as z:
                return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in z["order"]]], pa.list_(pa.int64())), pa.array([t], pa.binary())], ["ids", "tree"])

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            for i, v in zip(b.column("id").to_pylist(), flat.reshape(b.num_rows, -1)):
                ids.append(i)
                rows.append(v)
                if len(rows) == BLOCK:
                    yield made()
                    ids, rows = [], []
        if rows:
            yield made()

    return vectors.select("id", "v").mapInArrow(run, "ids array<long>, tree binary")


def _walked(blocks: DataFrame, centroids: np.ndarray, run, schema: str) -> DataFrame:
    """``run(trees, centroids, centroid tree)`` over a task's blocks; the centroids go with the task."""
    flat, shape = centroids.tobytes(), centroids.shape

    def go(batches):
        at = np.frombuffer(flat, np.int64).reshape(shape)
        if not len(at):
            return
        yield from run((x for b in batches for x in zip(b.column("ids").to_pylist(), b.column("tree").to_pylist())), at, cover_tree(at, CENTROID_LEAF))

    return blocks.mapInArrow(go, schema)


def _load(tree: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(tree)) as z:
        return {k: z[k] for k in z.files}


def _sums(trees, centroids, c):
    """One row per centroid of a task: its vectors' number and sum."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, tree in trees:
        t = _load(tree)
        whole = np.zeros(len(t["points"]), bool)

        def take(node, one, t=t, whole=whole):
            n[one] += t["last"][node] - t["first"][node]
            total[one] += t["sums"][node]
            whole[t["first"][node] : t["last"][node]] = True

        best, _ = assign(t, centroids, c, take)
        np.add.at(n, best[~whole], 1)
        np.add.at(total, best[~whole], t["points"][~whole])
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])


def _rows(trees, centroids, c):
    """Each vector's id, centroid and squared distance."""
    for ids, tree in trees:
        t = _load(tree)
        best, _ = assign(t, centroids, c)
        far = np.zeros(len(best), np.int64)
        for k in np.unique(best):
            far[best == k] = squared(t["points"][best == k], centroids[k : k + 1])[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])


def cluster(spark: SparkSession, vectors: DataFrame, start: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of ``vectors(id, v array<long>)``, all of one width, and the final centroids.

    Every round assigns to the nearest centroid (ties: smaller number) and moves each non-empty one to the floor of its
    vectors' mean. Repeated rows count each; no vector, no row. Null ids are kept as ids. ``start``: int64, one row a centroid.
    """
    centroids = np.array(start, np.int64)
    blocks = stage(spark, _blocks(vectors), "lloyd-blocks")
    for _ in range(rounds if len(centroids) else 0):
        sums = _walked(blocks, centroids, _sums, "cluster long, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
        moved = sums.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
        for m in moved:
            centroids[m.cluster, m.at] = int(m.x) // m.n
    out = stage(spark, _walked(blocks, centroids, _rows, "id long, cluster int, distance long"), "lloyd-assigned")
    done_with(spark, blocks)
    return out, centroids


def whole_numbers(embeddings: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of vectors with exactly ``width`` components, none null, NaN or infinite."""
    fine = F.size(vector).eqNullSafe(F.lit(width)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector)).where(fine).select("id", scaled.alias("v"))


def seeded(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and id, in that order; null ids last, ties by components."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    found = vectors.orderBy(h.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64) if found else np.zeros((0, 0), np.int64)


def op12_lloyd(spark: SparkSession, sf_dir: str, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> DataFrame:
    """Every kept vector's cluster after the last round, its squared distance, and inertias.

    Vectors of another width or with a null, NaN or infinite component are not kept; a null vector is not either.
    Fewer vectors than centroids give fewer centroids; an empty table gives no rows. A component of a size that takes a
    squared distance past 64 bits raises. Extra columns are ignored.
    """
    vectors = whole_numbers(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", width, scale)
    found, centroids = cluster(spark, vectors, seeded(vectors, k), rounds)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # at most k rows each
    per = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(W.partitionBy()))
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
