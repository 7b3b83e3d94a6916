"""Exact dedup by content sort, in DataFrame and SQL functions only.

Rows are keyed by (first LEAD bytes of the normalised text, XXH64 of all of it,
doc_id), keys of bounded size. Keys of a sample, sorted, every OVERSAMPLE-th of
them, are the splitters; a row's range is found by binary search in them. One
shuffle brings a range's rows together, Spark's external sort orders them by key
and whole text, and each row is compared in full with its neighbour: equal
neighbours are a run.

The doc_id is part of the key so that copies of one text, however many, spread
over as many ranges as they fill. A run can go on in another range only if its
prefix and hash are those of a splitter; such runs (about one or two a range)
are merged by their whole text afterwards.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP_RE, parts, read_table, stage, text_of

#: Bytes of a text in its key.
LEAD = 32
#: Sampled keys per splitter, and ranges per shuffle partition.
OVERSAMPLE, RANGES = 8, 4
#: The merged runs are sent to every task as long as there are at most so many splitters, and joined by shuffle otherwise.
MOST_SENT = 20_000
_KEY = "struct<p:string,h:bigint,i:bigint>"
_LAST = (1 << 63) - 1


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), GAP_RE, " ")


def _key(norm: str, key: str) -> Column:
    lead = F.hex(F.substring(F.col(norm).cast("binary"), 1, LEAD))
    return F.struct(lead.alias("p"), F.xxhash64(norm).alias("h"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("i"))


def splitters(docs: DataFrame, ranges: int, key: str = "doc_id", text: str = "text") -> list:
    """About ``ranges`` sorted distinct keys that part the rows evenly. Of the sample, which Spark sorts, the driver gets these alone."""
    share = ranges * OVERSAMPLE / max(1, docs.count())
    sample = docs if share >= 1 else docs.sample(share, seed=13)
    keys = sample.select(F.col(key), normalised(text).alias("__norm")).select(_key("__norm", key).alias("k")).orderBy("k")
    every = keys.withColumn("at", F.monotonically_increasing_id()).where(f"at % {OVERSAMPLE} = {OVERSAMPLE - 1}")
    return sorted({tuple(r.k) for r in every.select("k").collect()})


def _range(found: list, k: str) -> tuple[Column, Column]:
    """The table of splitters, and the number of those that are not above the key ``k``, by binary search."""
    table = F.from_json(F.lit(json.dumps([dict(zip("phi", x)) for x in found])), f"array<{_KEY}>")
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    # the first lo splitters are not above the key, those from hi on are
    half = lambda a, at: F.when(F.get(table, at) <= F.col(k), F.struct((at + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), at.alias("hi")))
    narrow = lambda a, _: F.when(a["lo"] < a["hi"], half(a, middle(a))).otherwise(a)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(found)).alias("hi"))
    return table, F.aggregate(F.sequence(F.lit(0), F.lit(len(found).bit_length())), start, narrow, lambda a: a["lo"])


def groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts (null as empty) the row with the smallest key
    stays; null keys come last, and are kept only where a group has no other.
    Of rows that agree in key and text one is kept. No rows, no result; other
    columns are not read. A very long text is one value of one row.
    """
    found = splitters(docs, ranges or RANGES * parts(spark), key, text)
    table, at = _range(found, "__k")
    rows = docs.select(F.col(key).cast("long").alias("__id"), normalised(text).alias("__norm")).withColumn("__k", _key("__norm", "__id")).withColumn("__r", at)
    same = lambda i: F.coalesce((F.get(table, i)["p"] == F.col("__k")["p"]) & (F.get(table, i)["h"] == F.col("__k")["h"]), F.lit(False))
    rows = rows.withColumn("__edge", same(F.col("__r") - 1) | same(F.col("__r"))).select("__id", "__norm", "__k.p", "__k.h", "__k.i", "__r", "__edge")
    order = W.partitionBy("__r").orderBy("p", "h", "__norm", "i", F.col("__id").asc_nulls_last())
    first = ~F.col("__norm").eqNullSafe(F.lag("__norm").over(order))
    runs = rows.withColumn("__first", first).withColumn("__run", F.sum(F.col("__first").cast("long")).over(order))
    run = W.partitionBy("__r", "__run")
    runs = runs.select(
        "__id", "__r", "__run", "__first",
        F.unhex(F.sha2("__norm", 256)).alias("__sha"),
        F.when(F.col("__edge") & F.col("__first"), F.col("__norm")).alias("__open"),
    ).withColumns({"__n": F.count("*").over(run), "__keep": F.min("__id").over(run)})
    runs = stage(spark, runs, "content-runs")
    # runs at the edge of a range, merged by their text: about two a range, hence a small table
    whole = W.partitionBy("__open")
    merged = runs.where("__open IS NOT NULL").withColumns({"__all": F.sum("__n").over(whole), "__least": F.min("__keep").over(whole), "__lead": F.min(F.struct("__r", "__run")).over(whole)})
    merged = merged.select("__r", "__run", "__all", "__least", (F.col("__lead") == F.struct("__r", "__run")).alias("__leads"))
    if len(found) <= MOST_SENT:
        merged = F.broadcast(merged)
    out = runs.join(merged, ["__r", "__run"], "left")
    keep = F.when(F.col("__all").isNull(), F.col("__keep")).otherwise(F.col("__least"))
    return out.select(
        F.col("__id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("__all", "__n").alias("group_size"),
        (F.col("__first") & F.coalesce("__leads", F.lit(True))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, the number of its copies and a digest of its normalised text.

    Null and empty texts are copies of one another; repeated rows are one kept
    row and copies of it; an empty table gives no rows; extra columns are ignored.
    """
    return groups(spark, read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
