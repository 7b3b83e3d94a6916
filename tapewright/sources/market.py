"""Price sources and sinks: packed tables, exchange files, dimensions; Parquet is the native layout."""

from __future__ import annotations

import gzip
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import paise
from ..functions.text import file_key
from ..operators.bars import traded_close

c = F.col
# The packed table's first bytes, and the columns and codes of exchange files.
MAGIC = b"RKN1"
SERIES = ("EQ", "BE", "BZ", "SM", "ST")
CSV = {"type": 4, "symbol": 7, "series": 8, "expiry": 9, "strike": 11, "opt_type": 12, "name": 13, "o": 14, "h": 15, "l": 16, "c": 17, "last": 18, "prev": 19, "under": 20, "v": 24, "lot": 28}


def encode_table(columns: list[Iterable[int]]) -> bytes:
    """Integer columns as zigzag varints of differences, gzipped. Ragged or non-integer columns raise ValueError."""
    cols = [list(x) for x in columns]
    if len({len(x) for x in cols}) > 1:
        raise ValueError("columns differ in length")
    rows = len(cols[0]) if cols else 0
    out = bytearray(MAGIC + bytes([len(cols)]))

    def put(n: int) -> None:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)

    put(rows)
    for col in cols:
        for a, b in zip([0, *col], col):
            if b != int(b):
                raise ValueError(f"not an integer: {b}")
            put(2 * (b - a) if b >= a else 2 * (a - b) - 1)
    return gzip.compress(bytes(out), 9, mtime=0)


def decode_table(packed: bytes) -> list[np.ndarray]:
    """The columns of a packed table; anything else raises ValueError. Varints are read all at once."""
    raw = gzip.decompress(packed)
    if raw[:4] != MAGIC:
        raise ValueError("not a packed table")
    data = np.frombuffer(raw, np.uint8, offset=5)
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((data & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), starts) if len(ends) else np.array([], np.uint64)
    rows, n = int(values[0]), raw[4]
    z = values[1 : 1 + rows * n].astype(np.int64).reshape(n, rows)
    return list(np.cumsum(np.where(z % 2 == 0, z // 2, -(z + 1) // 2), axis=1))


def packed_bars(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, d, o, h, l, c, v) of every packed cash table under a path; prices in the file are hundredths."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.rkn$", 1).alias("key"), "content")

    def run(batches):
        for b in batches:
            for key, content in zip(b.column("key").to_pylist(), b.column("content").to_pylist()):
                d, o, h, low, close, v = decode_table(content)
                yield pa.RecordBatch.from_pydict({"key": [key] * len(d), "d": pa.array(d, pa.int32()), "o": o / 100, "h": h / 100, "l": low / 100, "c": close / 100, "v": v})

    return files.mapInArrow(run, "key string, d int, o double, h double, l double, c double, v long")


def fields(lines: DataFrame) -> DataFrame:
    """The named fields of lines of thirty or more, beside the other columns."""
    f = lines.withColumn("f", F.split("line", ",")).where("size(f) >= 30")
    return f.select(*[x for x in lines.columns if x != "line"], *[F.trim(c("f")[i]).alias(k) for k, i in CSV.items()])


def cash_bars(lines: DataFrame) -> DataFrame:
    """Per symbol and day the best-ranked series' bar, the first of its lines. lines: day, line, and line_no if a series may repeat."""
    rank = F.array_position(F.array(*map(F.lit, SERIES)), c("series"))
    t = fields(lines).withColumn("rank", rank).where("rank > 0").withColumn("v", F.coalesce(F.expr("try_cast(v AS bigint)"), F.lit(0)))
    one = t.groupBy("symbol", "day").agg(F.min_by(F.struct("name", "series", "o", "h", "l", "c", "prev", "v"), F.struct("rank", *[x for x in ("line_no",) if x in t.columns])).alias("r")).select("symbol", "day", "r.*").where("v > 0")
    return one.select("symbol", "day", "name", "series", *[(paise(c(x)) / 100).alias(x) for x in ("o", "h", "l", "c", "prev")], "v")


def derivative_bars(lines: DataFrame, index_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Option and future bars; a close out of the day's range becomes the last trade drawn into it. ``keep``: further columns of the lines."""
    t = fields(lines).where(c("type").isin("IDO", "STO", "IDF", "STF"))
    t = t.where(c("type").startswith("I")) if index_only else t
    t = t.withColumns({x: paise(c(x)) / 100 for x in ("o", "h", "l", "c", "last", "strike", "under")} | {"v": F.coalesce(F.expr("try_cast(v AS bigint)"), F.lit(0)), "lot": F.expr("try_cast(lot AS int)")})
    return t.where("v > 0").select("symbol", "day", F.when(c("type").endswith("O"), "option").otherwise("future").alias("kind"), F.when(c("type").startswith("I"), "index").otherwise("stock").alias("of"), F.to_date("expiry").alias("expiry"), "strike", "opt_type", "o", "h", "l", traded_close().alias("c"), "v", "lot", "under", *keep)


def symbol_info(bars: DataFrame) -> DataFrame:
    """Last name and series, first and last day, and whether ever listed for small companies."""
    return bars.groupBy("symbol").agg(F.max_by("name", "day").alias("name"), F.max_by("series", "day").alias("series"), F.min("day").alias("a"), F.max("day").alias("z"), F.bool_or(c("series").isin("SM", "ST")).alias("sme"))


def contracts(bars: DataFrame, order: str | Column = "day") -> DataFrame:
    """Per symbol and expiry: last non-zero lot, and whether options and futures traded."""
    order = c(order) if isinstance(order, str) else order
    return bars.groupBy("symbol", "expiry").agg(F.max_by("lot", F.when(c("lot") > 0, order)).alias("lot"), F.bool_or(c("kind") == "option").alias("has_options"), F.bool_or(c("kind") == "future").alias("has_futures"))


def spot(lines_bars: DataFrame) -> DataFrame:
    """The underlying's value per symbol and day; all rows of a day agree on it, the least is taken where they do not."""
    return lines_bars.where("under IS NOT NULL").groupBy("symbol", "day").agg(F.min("under").alias("price"))


def candidate_expiries(calls: DataFrame, expiries: DataFrame, most: int = 4) -> DataFrame:
    """Expiries a call can mean, ranked: near the hinted date, the hinted month's last, or the next four.

    calls: call_id, symbol, today, hint_day, hint_month (nulls for none). expiries: symbol, expiry.

    What can be meant is worked out once for each symbol, day and hint that is asked, not call by call: a symbol's
    expiries multiply with days, not with calls.
    """
    asked = ["symbol", "today", "hint_day", "hint_month"]
    e = expiries.withColumn("monthly", c("expiry") == F.max("expiry").over(W.partitionBy("symbol", F.trunc("expiry", "month"))))
    t = calls.select(*asked).distinct().join(e, "symbol").where("expiry >= today")
    year = F.year("today") + F.when(c("hint_month") < F.month("today") - 6, 1).otherwise(0)
    month = F.make_date(year, c("hint_month"), F.lit(1))
    gap = F.abs(F.datediff("expiry", F.date_add(month, c("hint_day").cast("int") - 1)))
    in_month = F.trunc("expiry", "month") == month
    ok = F.when(c("hint_month").isNull(), True).when(c("hint_day").isNotNull(), in_month & (gap <= 3)).otherwise(in_month & c("monthly"))
    rank = F.row_number().over(W.partitionBy(*asked).orderBy(F.when(c("hint_day").isNotNull(), gap).otherwise(0), "expiry"))
    t = t.where(ok).withColumn("rank", rank).where((c("rank") <= most) | c("hint_month").isNotNull()).drop("monthly")
    # symbols and days are never null here, hints mostly are
    t = t.withColumnsRenamed({x: f"__{x}" for x in asked})
    same = (c("symbol") == c("__symbol")) & (c("today") == c("__today")) & c("hint_day").eqNullSafe(c("__hint_day")) & c("hint_month").eqNullSafe(c("__hint_month"))
    return calls.join(t, same).drop(*[f"__{x}" for x in asked])


def write_bars(bars: DataFrame, path: str, by: str = "symbol") -> None:
    """Bars as Parquet, a folder per file-safe key, sorted by key and day: scans of a symbol read its folder only."""
    keyed = bars.withColumn("key", file_key(c(by)))
    keyed.repartition("key").sortWithinPartitions("key", "d").write.mode("overwrite").partitionBy("key").parquet(path)


def write_calls_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header; quotes inside cells are doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
