"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (the pattern).
Each pattern offers its words once per pass, later passes at a higher, convex
cost; each source asks for its quota. A min-cost flow routes the offers to the
quotas, so a document is repeated only where no unrepeated words can serve, and
a document of several sources serves the one that lacks words. The flow of a
pattern is then taken from its documents in a seeded order: whole passes over
all of them, and the rest from the documents that come first.

What reaches the driver is one row per pattern, never per document; it is
checked against ``MOST_PATTERNS``.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GAP_RE, read_table, stage, text_of

MOST_PATTERNS = 200_000
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Slices of a pattern's documents that are ordered apart; a hot source is spread over so many tasks.
SLICES = 4096


def n_words(text: Column) -> Column:
    """Number of words of a text, null as none; runs of separators are squeezed to count them."""
    squeezed = F.trim(F.regexp_replace(text, GAP_RE, " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: Fraction = Fraction(3, 2), most: int = 2, weights=WEIGHTS) -> dict[str | None, Fraction]:
    """Each source's words: ``share`` of all, by weight, capped at ``most`` times its size, the excess reshared."""
    names = sorted((s for s, _ in sizes if s is not None), key=str.encode) + [None] * any(s is None for s, _ in sizes)
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(size.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > most * size[s] * total]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(most * size[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= set(full)
    return out


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials; integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        """Sends all that fits. After each distance labelling, every path of least cost is filled before the next one."""
        n = len(self.out)
        height = [0] * n
        while True:
            far = [float("inf")] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] and (c := d + self.cost[e] + height[x] - height[self.to[e]]) < far[self.to[e]]:
                        far[self.to[e]] = c
                        heapq.heappush(heap, (c, self.to[e]))
            if far[t] == float("inf"):
                return
            height = [h + (d if d < far[t] else far[t]) for h, d in zip(height, far)]
            self._fill(s, t, height)

    def _fill(self, s: int, t: int, height: list) -> None:
        """Blocking flows over arcs of reduced cost zero, level by level."""
        tight = lambda x, e: self.room[e] and self.cost[e] + height[x] - height[self.to[e]] == 0
        while True:
            level, layer = {s: 0}, [s]
            while layer and t not in level:
                layer = [y for x in layer for e in self.out[x] if tight(x, e) and (y := self.to[e]) not in level and not level.update({y: level[x] + 1})]
            if t not in level:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    path, x = [], s
                    continue
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if tight(x, e) and level.get(self.to[e], -1) == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.out[x]):
                    path.append(self.out[x][at[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict, passes: int = 2) -> list[dict]:
    """Words each pattern sends to each of its sources. patterns: (sources, words)."""
    names = list(quotas)
    n = len(patterns)
    net, place = Flow(n + len(names) + 2), {s: n + i for i, s in enumerate(names)}
    s, t = n + len(names), n + len(names) + 1
    arcs = []
    for i, (sources, words) in enumerate(patterns):
        for p in range(passes):
            net.arc(s, i, words, p * p)  # convex: the p-th repetition costs more than the one before
        arcs.append({x: net.arc(i, place[x], passes * words, 0) for x in sources})
    for x, quota in quotas.items():
        net.arc(place[x], t, quota, 0)
    net.run(s, t)
    return [{x: net.room[e ^ 1] for x, e in a.items()} for a in arcs]


def mix(spark: SparkSession, docs: DataFrame, members: DataFrame | None = None, share: Fraction = Fraction(3, 2), most: int = 2, seed: str = SEED, carry: tuple = ()) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken) for every row of ``docs``, and its columns ``carry``.

    ``members(doc_id, source)`` lists further sources of documents; a document's
    own ``source`` counts anyway, and size, target and source_size are of its own.
    taken: words the mix takes of it, at most ``most`` times its size. The order
    is that of md5(seed:doc_id), so reruns and other partitionings agree; rows
    that repeat a doc_id are ordered by size and share the seeded place.
    """
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), *carry)
    own = own.withColumn("pattern", F.array("source"))
    if members is not None:
        more = members.select("doc_id", F.col("source").cast("string").alias("s")).groupBy("doc_id").agg(F.collect_set(F.struct("s")).alias("more"))
        own = own.join(more, "doc_id", "left").withColumn("pattern", F.array_sort(F.array_union("pattern", F.coalesce(F.col("more.s"), F.array())))).drop("more")
    # a null source is a source; group keys must compare, so the pattern becomes text with lengths
    own = own.withColumn("pkey", F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"}))
    own = own.withColumn("turn", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    own = own.withColumn("slice", (F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * SLICES / 2**32).cast("int"))
    own = stage(spark, own.drop("pattern"), "mix-docs")
    sums = stage(spark, own.groupBy("pkey", "source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    # the sizes of sources and patterns: one row each
    groups = sums.groupBy("pkey", "source").agg(F.sum("words").alias("words"))
    got = groups.limit(MOST_PATTERNS + 1).collect()
    if len(got) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources; group rare sources first")
    of_source: dict = {}
    of_pattern: dict = {}
    for r in got:
        of_source[r.source] = of_source.get(r.source, 0) + r.words
        of_pattern[r.pkey] = of_pattern.get(r.pkey, 0) + r.words
    keys = sorted(of_pattern)
    lists = {k: tuple(json.loads(k)["pattern"]) for k in keys}
    for k in keys:
        for s in lists[k]:
            of_source.setdefault(s, 0)
    reach = {s: 0 for s in of_source}
    for k in keys:
        for s in lists[k]:
            reach[s] += of_pattern[k]
    goal = targets([(s, n if members is None else reach[s]) for s, n in of_source.items()], share, most)
    flows = route([(lists[k], of_pattern[k]) for k in keys], {s: int(g + Fraction(1, 2)) for s, g in goal.items()}, most)
    plan = [(k, of_pattern[k], sum(f.values())) for k, f in zip(keys, flows)]
    plan_df = spark.createDataFrame(plan, T.StructType([T.StructField("pkey", T.StringType()), T.StructField("all_words", T.LongType()), T.StructField("flow", T.LongType())]))
    source_df = spark.createDataFrame([(s, n, float(goal[s])) for s, n in of_source.items()], "source string, source_size long, target double")
    # where each slice begins: a running sum over at most SLICES rows of a pattern
    begin = sums.groupBy("pkey", "slice").agg(F.sum("words").alias("words"))
    begin = begin.select("pkey", "slice", (F.sum("words").over(W.partitionBy("pkey").orderBy("slice")) - F.col("words")).alias("before"))
    begin = begin.join(plan_df, "pkey").select("pkey", "slice", "before", "all_words", "flow")
    w = W.partitionBy("pkey", "slice").orderBy("turn", "doc_id", "size", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("upto", F.sum("size").over(w)).join(begin, ["pkey", "slice"])
    rest = F.expr("flow % greatest(all_words, 1)") - F.col("before") - F.col("upto") + F.col("size")
    taken = F.expr("(flow div greatest(all_words, 1)) * size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    placed = placed.select("doc_id", "source", "size", taken.cast("long").alias("taken"), *carry)
    return placed.join(source_df, placed.source.eqNullSafe(source_df.source)).select("doc_id", placed.source, "size", "source_size", "target", "taken", *carry)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its part in the mix.

    Null and empty texts have size 0 and nothing is taken of them; a null
    source is the last source. Repeated rows are mixed each; an empty table
    gives no rows. Extra columns: ignored. Of very long texts only words are counted.
    """
    return mix(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def resample(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document once per pass taken, the last pass cut to the words taken.

    Each row gets what is taken of itself, null doc_ids and other texts of one
    doc_id too; only rows that agree in doc_id, source and text share equally.
    Documents of which nothing is taken go. Where ``n_chars`` is a column, it
    follows the text of a cut pass.
    """
    docs, names = docs.withColumn("__tid", F.xxhash64(text_of())), docs.columns
    taken = mix(spark, docs, carry=("__tid",), **options).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__tid").alias("__t")).agg(F.sum("taken").alias("__taken"), F.count("*").alias("__rows"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__tid") == F.col("__t"))
    both = docs.join(taken, same).withColumn("__size", n_words(text_of()))
    both = both.withColumn("__mine", F.least(F.col("__size") * 2, F.expr("__taken div __rows"))).where("__mine > 0")
    both = both.withColumn("__pass", F.explode(F.expr("sequence(0L, (__mine - 1) div __size)")))
    words = F.least(F.col("__size"), F.col("__mine") - F.col("__pass") * F.col("__size"))
    head = F.array_join(F.slice(F.filter(F.split(text_of(), GAP_RE), lambda x: x != ""), 1, words.cast("int")), " ")
    both = both.withColumn("text", F.when(words == F.col("__size"), F.col("text")).otherwise(head))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*names)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
-- sources fill in the order of size per weight: those below the level are capped
r AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY source_size * 1.0 / w DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS free_w, (SELECT 1.5 * sum(source_size) FROM s) AS total FROM s),
level AS (SELECT min(CASE WHEN (total - capped) * w <= 2 * source_size * free_w THEN source_size * 1.0 / w END) AS lv FROM r),
c AS (SELECT *, source_size * 1.0 / w < (SELECT lv FROM level) AS is_capped FROM r),
f AS (SELECT *, (total - (SELECT coalesce(sum(2 * source_size) FILTER (is_capped), 0) FROM c)) AS left_words, (SELECT sum(w) FILTER (NOT is_capped) FROM c) AS ws FROM c),
t AS (SELECT source, source_size, CASE WHEN is_capped THEN 2.0 * source_size ELSE left_words::DOUBLE * w / ws END::DOUBLE AS target FROM f),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS flow,
  sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((flow // greatest(source_size, 1)) * size + greatest(0, least(size, flow % greatest(source_size, 1) - before)))::BIGINT AS taken FROM o
"""
