"""Near copies at a stated word similarity: SimHash links and MinHash bands propose, the shingle sets decide.

Two texts are near copies if the sets of their runs of five words (lower case)
have a Jaccard similarity of at least ``LEAST``. Texts with equal sets are one
row from the start.

Every distinct set's SimHash fingerprint goes through the pivot distance tables
of ``simhash``; what is linked there is proposed. 64 bits see most pairs that
are almost equal but few at 0.8, so bands propose as well: of each distinct set the least value under BANDS * ROWS
hash functions is kept; sets that agree in all values of a band meet there.
A pair of similarity s meets in some band with probability
1 - (1 - s^ROWS)^BANDS, which is 0.998 at 0.8.

A band's group of n proposes about 2n pairs at first, not n^2: each member with the
group's first, and with its neighbour in the order of the next band, where
alike sets stand together. Every pair is verified on the whole sets before it
links; unverified pairs link nothing.

That joins what is alike throughout, however large the group. Where a group is
still in several parts, or a proposal has failed, a link may be left between the
parts: all members of those are compared again, by an exact join on their
rarest members, and what can be alike is verified, all of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import components, stage, text_of
from .minhash import shingle_hashes

#: Least five-word Jaccard similarity of near copies.
LEAST = 0.8
BANDS, ROWS = 16, 5
#: Sizes of sets within such a factor of one another are joined as one.
SIZES = 1.05
#: Neighbours of a group with more rows are sought in pieces of about so many.
PIECE = 1024


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of the hash functions."""
    h = np.array([[xxhash.xxh64_intdigest(b"near %d" % i, s) for i in range(BANDS * ROWS)] for s in (1, 2)], np.uint64)
    return h[0] | np.uint64(1), h[1]


_FACTORS, _MASKS = _functions()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word runs, A-Z as a-z; of all words where there are fewer."""
    return np.unique(shingle_hashes(_lower(text)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One 64-bit key per band; none for a set without hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[None, at : at + 512] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1))
    least = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(least)]


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two stored sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _mapped(docs: DataFrame, columns: list[str], of, made: dict) -> DataFrame:
    """One narrow pass: ``columns`` and the columns ``made`` (name: Arrow type, SQL type) that ``of`` makes of each text."""

    def run(batches):
        for b in batches:
            cols = list(zip(*(of(x) for x in b.column("__near_text").to_pylist()))) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(c, t) for c, (t, _) in zip(cols, made.values()))], [*columns, *made])

    return docs.select(*columns, "__near_text").mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{k} {t}" for k, (_, t) in made.items())]))


_KEYS = {"node": (pa.int64(), "long"), "keys": (pa.list_(pa.int64()), "array<long>"), "fp": (pa.int64(), "long")}
_WORDS = {"words": (pa.binary(), "binary")}


def _keys(text: str) -> tuple[int, list[int], int]:
    """Node of the shingle set, its band keys, and the SimHash fingerprint of all shingles."""
    h = shingle_hashes(_lower(text))
    x = np.unique(h)
    return _node(x), band_keys(x), simhash._signed(simhash.majority(h))


def _words(text: str) -> tuple[bytes]:
    return (shingle_set(text).astype("<u8").tobytes(),)


def _node(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), 3) - (1 << 63)


def proposals(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bands' groups (m, cell, node) of more than one member of ``nodes(node, keys)``, and the distinct pairs (a, b) that they propose."""
    turn = F.expr(f"transform(keys, (k, i) -> struct(i AS m, k AS cell, keys[(i + 1) % {BANDS}] AS next))")
    cells = stage(spark, nodes.select("node", F.explode(turn).alias("x")).select("node", "x.*"), "near-cells")
    full = stage(spark, cells.groupBy("m", "cell").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "near-full")
    shared = stage(spark, cells.join(full, ["m", "cell"]), "near-shared")
    met = shared.withColumn("piece", F.pmod(F.xxhash64("next"), F.ceil(F.col("n") / PIECE)))
    beside = F.lag("node").over(W.partitionBy("m", "cell", "piece").orderBy("next", "node"))
    pairs = met.withColumn("beside", beside).select("node", F.explode(F.array("first", "beside")).alias("other")).where("other <> node")
    return shared.select("m", "cell", "node"), pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def simhash_proposals(spark: SparkSession, nodes: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, fp)`` that span what fingerprints within ``most`` bits link."""
    fps = stage(spark, nodes.groupBy("fp").agg(F.min("node").alias("id")), "near-fp")
    same = nodes.join(fps, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    both = same.unionByName(simhash.link(spark, fps, most))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(spark: SparkSession, pairs: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets in ``words(node, words)`` are alike."""

    def run(batches):
        for b in batches:
            ok = [likeness(x, y) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok, pa.bool_())) for k in ("a", "b")], ["a", "b"])

    of = lambda node, name: words.select(F.col("node").alias(node), F.col("words").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def unresolved(spark: SparkSession, cells: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes, with their part, of which a link to another part may be missing: members of band groups in several parts,
    and all of the parts between which a proposal has failed. ``found(node, component)``: parts so far; others are their own."""
    part = lambda node, name: found.select(F.col("node").alias(node), F.col("component").alias(name))
    placed = cells.join(found, "node", "left").select("m", "cell", "node", F.coalesce("component", "node").alias("part"))
    open_cells = placed.groupBy("m", "cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("m", "cell")
    members = placed.join(open_cells, ["m", "cell"]).select("node", "part")
    ends = pairs.join(part("a", "pa"), "a", "left").join(part("b", "pb"), "b", "left").select(F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb")).where("pa <> pb")
    parts_apart = ends.select(F.explode(F.array("pa", "pb")).alias("part")).distinct()
    all_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    return members.unionByName(all_nodes.join(parts_apart, "part", "left_semi").select("node", "part")).distinct()


def across(spark: SparkSession, nodes: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (a, b) of ``nodes(node, part)`` of different parts that can be alike, by the first member that both have, rarest first.

    What comes before it is not shared, so its place in either set bounds what they can share, and with it the sizes that may meet:
    joined are only rows of sizes that each other's place allows. The first shared member of a pair at ``least`` always passes.
    """

    def run(batches):
        for b in batches:
            for node, part, w in zip(b.column("node").to_pylist(), b.column("part").to_pylist(), b.column("words").to_pylist()):
                h = np.frombuffer(w, "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(np.full(len(h), part)), pa.array(h), pa.array(np.full(len(h), len(h)))], ["node", "part", "h", "n"])

    sets = stage(spark, nodes.join(words, "node").select("node", "part", "words").mapInArrow(run, "node long, part long, h long, n long"), "near-members")
    # a member that one set alone has leads to no pair, but has its place in the prefix
    often = stage(spark, sets.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-often")
    ranked = sets.join(often, "h", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # at place ``at`` of the order a set of n has n - at members left: if that is the first that two sets share, they share no more
    at = F.row_number().over(W.partitionBy("node").orderBy("df", "h")) - 1
    most = F.least(F.floor((F.col("n") - F.col("at")) * (1 + least) / least - F.col("n") + 1e-9), F.floor(F.col("n") / least + 1e-9))
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZES)).cast("int")
    keys = ranked.withColumn("at", at).where("df > 1").withColumns({"from": F.ceil(F.lit(least) * F.col("n") - 1e-9), "most": most}).where("from <= most")
    keys = keys.select("node", "part", "h", "n", "at", size(F.col("n")).alias("own"), F.explode(F.sequence(size(F.col("from")), size(F.col("most")))).alias("other"))
    keys = stage(spark, keys, "near-prefix")
    # sizes meet if each may be the other's; where all that meet are of one part there is nothing to join
    parts_of = keys.groupBy("h", "own", "other").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    mirror = parts_of.select("h", F.col("own").alias("other"), F.col("other").alias("own"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    mixed = parts_of.join(mirror, ["h", "own", "other"]).where(F.least("lo", "lo2") < F.greatest("hi", "hi2")).select("h", "own", "other")
    x = keys.join(mixed, ["h", "own", "other"])
    y = x.select("h", F.col("own").alias("other"), F.col("other").alias("own"), F.col("node").alias("node2"), F.col("part").alias("part2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    needed = F.ceil((F.col("n") + F.col("n2")) * least / (1 + least) - 1e-9)
    can = (F.col("node") < F.col("node2")) & (F.col("part") != F.col("part2")) & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= needed)
    met = x.join(y, ["h", "own", "other"]).where(can)
    return stage(spark, met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), "near-across")


def joined(spark: SparkSession, found: DataFrame, more: DataFrame) -> DataFrame:
    """``found(node, component)`` with the parts that ``more(a, b)`` links as one; a node without a part is its own."""
    if more.isEmpty():
        return found
    part = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"p{name}"))
    ends = more.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).distinct()
    whole = stage(spark, components(spark, ends, "near-all").select(F.col("node").alias("part"), F.col("component").alias("whole")), "near-whole")
    merged = found.join(whole, found.component == whole.part, "left").select("node", F.coalesce("whole", "component").alias("component"))
    return merged.unionByName(whole.join(found, whole.part == found.node, "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component")))


def keep_one(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents without near copies: of each linked group the row with the smallest doc_id stays.

    Texts without a word are copies of one another. Rows that agree in doc_id
    and text are reduced to one; of a doc_id with several texts each is a row
    of its own. Rows of null doc_id stay. All columns are kept as they are
    (names that begin with ``__near_`` are the stage's own); an empty table gives
    no rows; a very long text is one set of one row.
    """
    keyed = docs.where("doc_id is not null").withColumn("__near_text", text_of())
    keyed = keyed.withColumn("__near_doc", F.col("doc_id").cast("long")).withColumn("__near_tid", F.xxhash64("__near_text"))
    known = _mapped(keyed, ["__near_doc", "__near_tid"], _keys, _KEYS)
    # equal sets are one row; its text is that of the smallest doc_id
    lead = known.groupBy("node").agg(F.min(F.struct("__near_doc", "__near_tid")).alias("o"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    lead = stage(spark, lead.select("node", "o.*", "keys", "fp"), "near-lead")
    cells, banded = proposals(spark, lead)
    pairs = stage(spark, banded.unionByName(simhash_proposals(spark, lead.select("node", "fp"))).distinct(), "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(lead.select("node", "__near_doc", "__near_tid"), "node")
    texts = keyed.select("__near_doc", "__near_tid", "__near_text").join(asked, ["__near_doc", "__near_tid"]).dropDuplicates(["node"])
    words = stage(spark, _mapped(texts, ["node"], _words, _WORDS), "near-words")
    linked = stage(spark, links(spark, pairs, words, least), "near-links")
    found = stage(spark, components(spark, linked, "near-cc"), "near-parts")
    left = stage(spark, unresolved(spark, cells, pairs, found), "near-left")
    found = joined(spark, found, stage(spark, links(spark, across(spark, left, words, least), words, least), "near-more"))
    group = F.coalesce("component", lead.node)
    stay = lead.join(found, lead.node == found.node, "left").groupBy(group.alias("g")).agg(F.min(F.struct("__near_doc", "__near_tid")).alias("o")).select("o.*")
    kept = keyed.join(stay, ["__near_doc", "__near_tid"], "left_semi").dropDuplicates(["__near_doc", "__near_tid"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null")).select(*docs.columns)
