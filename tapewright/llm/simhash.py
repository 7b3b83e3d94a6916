"""SimHash near-duplicates: linking 64-bit fingerprints through pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to a fixed set of
reference fingerprints (pivots). By the triangle inequality two fingerprints
within ``most`` bits differ by at most ``most`` in every coordinate, so a pair
whose largest coordinate difference is above it is discarded unseen; survivors
are verified on the fingerprints themselves.

The table also says which pairs to look at, so that tables are never compared
all against all. The pivots come in ``most + r`` groups, each with ones in a
block of bits of its own, and the zero fingerprint is a pivot to all groups.
How much nearer a fingerprint is to a pivot than to zero depends on the pivot's
block alone; two fingerprints within ``most`` bits are alike in at least r
blocks, hence in all coordinates of at least r groups. A cell is a choice of r
groups and a value of all their coordinates: every pair that must link meets in
a cell, and no link is lost. r grows with the number of distinct fingerprints,
so that cells stay small at any size. The rows of cells of more than ``CELL``
rows go to a finer table with two more groups; what is still hot in the finest
is cut into chunks, and each pair of chunks is a task's work of its own. A cell
yields a spanning forest of its links, not the links, so the output is linear
in the rows even where thousands are mutually near.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, parts, read_table, stage, text_of

#: Rows of one cell compared in one piece; more are compared in chunks of so many.
CELL = 1024
#: Groups that a cell is a choice of, at most.
FINEST = 6


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles, repeats included; no words: zero."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII separators split
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    digest, ends = xxhash.xxh64_intdigest, (starts + sizes)[shingle - 1 :]
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends.tolist())], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none, zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (key, fp long): the fingerprint as a signed 64-bit number. One narrow pass."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fp.view(np.int64))], [key, "fp"])

    return df.select(key, text_of(text).alias("__text")).mapInArrow(run, T.StructType([df.schema[key], T.StructField("fp", T.LongType())]))


def pivots(most: int, r: int) -> list[list[int]]:
    """Groups of reference fingerprints: seeded bits in one block of the most + r that the 64 bits are cut into."""
    n = most + r
    cuts = [64 * i // n for i in range(n + 1)]
    return [[(xxhash.xxh64_intdigest(b"pivot %d" % i, 7) & ((1 << (y - x)) - 1)) << x for i in range(max(1, min(8, y - x - 2)))] for x, y in zip(cuts, cuts[1:])]


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, one row each."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def cells_of(rows: DataFrame, most: int, r: int) -> DataFrame:
    """Rows (fp, id, m, cell): of each choice of r groups of pivots the coordinates there, as a hash."""
    groups = pivots(most, r)
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))
    of_group = [F.xxhash64(*[distance(p) - F.bit_count("fp") for p in g]).alias(f"g{i}") for i, g in enumerate(groups)]
    table = rows.select("fp", "id", *of_group)
    return table.select("fp", "id", F.posexplode(F.array(*[F.xxhash64(*[f"g{i}" for i in chosen]) for chosen in combinations(range(len(groups)), r)])).alias("m", "cell"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choose_r(n: int, most: int) -> int:
    """The least r whose cells hold about one of n spread fingerprints."""
    return next((r for r in range(1, FINEST) if n <= 2 ** (64 * r // (most + r) - 1)), FINEST)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star from each node of a linked part to the part's first node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    x = np.flatnonzero(root != np.arange(n))
    return x, root[x]


def cell_links(fp: np.ndarray, side: np.ndarray, most: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one cell. side: 0 compares with 1 only, or all are 2."""
    tables = pivot_table(fp, refs)
    found_a, found_b = [], []
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        alive = np.ones((len(rows), len(right)), bool)
        for k in range(len(refs)):  # the maximum coordinate difference, one coordinate at a time
            alive &= np.abs(tables[rows, k][:, None] - tables[right, k][None, :]) <= most
            if k % 6 == 5 and np.count_nonzero(alive) < 4 * len(rows):
                break
        i, j = np.nonzero(alive)
        a, b = rows[i], right[j]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= most) & (a != b)
        found_a.append(a[near])
        found_b.append(b[near])
    return _forest(len(fp), np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.array([], int),) * 2


def _link_batches(batches, most: int, refs: np.ndarray):
    """Rows (m, cell, pair, side, fp, id) sorted by cell: links (a, b) of ids."""
    held: list[np.ndarray] = []

    def run(cols, final):
        which, fp, side, ids = cols
        cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]).any(axis=1)])
        ends = np.r_[cut[1:], len(fp)]
        whole = len(ends) if final else len(ends) - 1
        size = ends[:whole] - cut[:whole]
        links = []
        two = cut[:whole][size == 2]
        if len(two):  # most cells: one pair, all at once
            ok = (np.abs(pivot_table(fp[two], refs) - pivot_table(fp[two + 1], refs)).max(axis=1) <= most) & (side[two] + side[two + 1] != 0) & ((side[two] != 1) | (side[two + 1] != 1))
            ok &= np.bitwise_count(fp[two] ^ fp[two + 1]) <= most
            links.append((ids[two[ok]], ids[two[ok] + 1]))
        for s, n in zip(cut[:whole][size > 2], size[size > 2]):
            x, y = cell_links(fp[s : s + n], side[s : s + n], most, refs)
            links.append((ids[s + x], ids[s + y]))
        rest = cut[-1] if not final and len(cut) else len(fp)
        out = [np.concatenate(z) for z in zip(*links)] if links else [np.array([], np.int64)] * 2
        return out, [which[rest:], fp[rest:], side[rest:], ids[rest:]]

    for b in batches:
        if not b.num_rows:
            continue
        col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        got = [np.stack([col("m"), col("cell"), col("pair")], axis=1), col("fp").view(np.uint64), col("side"), col("id")]
        held = [np.concatenate(x) for x in zip(held, got)] if held else got
        (a, c), held = run(held, False)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])
    if held and len(held[1]):
        (a, c), _ = run(held, True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])


def link(spark: SparkSession, distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) of ids that span every component of ``distinct(fp, id)`` under at most ``most`` differing bits."""
    rows = stage(spark, distinct.select("fp", "id"), "simhash-fp")
    r, out = choose_r(rows.count(), most), None
    while True:
        cells, last = cells_of(rows, most, r), r + 2 > FINEST
        # a cell of one row is dropped before anything is sent to Python
        full = stage(spark, cells.groupBy("m", "cell").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-cells{r}")
        met = cells.join(full if last else full.where(F.col("n") <= CELL), ["m", "cell"]).withColumn("k", F.ceil(F.col("n") / CELL))
        # chunk c of a cell meets each chunk d; a cell of one chunk is one pair of chunks
        dealt = met.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k"))).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        pair = F.least("c", "d") * F.col("k") + F.greatest("c", "d")
        side = F.when(F.col("c") == F.col("d"), 2).when(F.col("c") < F.col("d"), 0).otherwise(1)
        work = dealt.select("m", "cell", pair.alias("pair"), side.alias("side"), "fp", "id").repartition(parts(spark, 4), "m", "cell", "pair").sortWithinPartitions("m", "cell", "pair")
        refs = np.array([0, *(p for g in pivots(most, r) for p in g)], np.uint64)
        found = work.mapInArrow(lambda batches, refs=refs: _link_batches(batches, most, refs), "a long, b long")
        out = found if out is None else out.unionByName(found)
        hot = full.where(F.col("n") > CELL)
        if last or hot.isEmpty():
            return out
        rows = stage(spark, cells.join(hot.select("m", "cell"), ["m", "cell"]).select("fp", "id").distinct(), f"simhash-hot{r}")
        r += 2


def classes(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """Rows (key, fp, component_id): component_id is the smallest key reachable over links of at most ``most`` bits.

    Copies meet in one row of the distinct fingerprints before anything is
    compared. Null keys link by their fingerprint but give it no id of their own.
    """
    fps = stage(spark, fingerprints(df, key, text, shingle), "simhash-doc")
    distinct = fps.groupBy("fp").agg(F.min(key).cast("long").alias("id")).where("id is not null")
    distinct = stage(spark, distinct, "simhash-distinct")
    found = components(spark, link(spark, distinct, most), "simhash-cc")
    of = distinct.join(found, distinct.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(of, "fp", "left").select(key, "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: fingerprint in hex and the smallest doc_id of its component.

    Null and empty texts have fingerprint zero and link with one another.
    Repeated rows are returned each; an empty table gives no rows. Texts of any
    length are read whole, 65,536 shingles at a time; extra columns are ignored.
    """
    c = classes(spark, read_table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
