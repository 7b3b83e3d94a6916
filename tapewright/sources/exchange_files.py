"""Exchange files as they are downloaded: a folder of daily zips for cash, one for derivatives, one of plain files of a second exchange.

A file is one row of Spark's ``binaryFile`` source; an archive's member is read as a
stream and leaves as batches of lines, so no archive is held as text. Everything
after that is DataFrame work: the best series of a day, contracts of both
exchanges in one union, first spot values, splits, and the packed market.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import paise
from ..functions.plan import written
from ..operators.bars import split_factors
from . import packed_source
from .market import cash_bars, contracts, derivative_bars, fields, symbol_info

c = F.col
#: Lines that one batch holds.
LINES = 8_192
_DAY = r"(\d{8})[^/]*$"


def _day(path: str = "path") -> Column:
    """The date that a file's name begins with or holds; null where it has none."""
    return F.try_to_timestamp(F.regexp_extract(path, _DAY, 1), F.lit("yyyyMMdd")).cast("date")


def _members(content: bytes) -> Iterator[io.BufferedIOBase]:
    """The first member of an archive as a stream, none of an empty one; any other content as it is."""
    if content[:2] != b"PK":
        yield io.BytesIO(content)
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist()[:1]:
            with z.open(name) as member:
                yield member


def file_lines(files: DataFrame) -> DataFrame:
    """(day, line_no, line) of each archive's first member, or of a plain file, of ``files(path, content)``, without its header.

    A file without a date in its name, an empty one and an archive without members have no lines; a broken archive raises.
    """

    def run(batches):
        for b in batches:
            for day, content in zip(b.column("day").to_pylist(), b.column("content").to_pylist()):
                for member in _members(content):
                    held: list = []
                    for n, line in enumerate(io.TextIOWrapper(member, "utf-8", newline="\n")):
                        if n:
                            held.append((n, line.rstrip("\r\n")))
                        if len(held) == LINES:
                            yield _batch(day, held)
                            held = []
                    yield _batch(day, held)

    return files.select(_day().alias("day"), "content").where("day IS NOT NULL").mapInArrow(run, "day date, line_no long, line string")


def _batch(day: dt.date, held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(day, pa.date32()), len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], ["day", "line_no", "line"])


def folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The files of a kind (zip, csv) in a folder as (path, content); of a missing folder none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")


def trading_days(files: DataFrame, until: dt.date | None = None) -> DataFrame:
    """(d, dt): the dates in the names of ``files(path)`` up to ``until``, counted. Contents are not read."""
    days = files.select(_day().alias("dt")).where("dt IS NOT NULL").distinct()
    days = days.where(c("dt") <= F.lit(until)) if until else days
    return days.select((F.row_number().over(W.orderBy("dt")) - 1).alias("d"), "dt")


def cash(lines: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars (symbol, d, name, series, o, h, l, c, prev, v) of the best series of each symbol and day."""
    days = F.broadcast(calendar.withColumnRenamed("dt", "day"))  # a row a trading day
    return cash_bars(lines).join(days, "day").select("symbol", "d", "name", "series", "o", "h", "l", "c", "prev", "v")


def symbols(bars: DataFrame) -> DataFrame:
    """(symbol, name, series, first_d, last_d, sme, splits) of cash bars."""
    info = symbol_info(bars.withColumnRenamed("d", "day")).select("symbol", "name", "series", c("a").alias("first_d"), c("z").alias("last_d"), "sme")
    factors = split_factors(bars.withColumnRenamed("symbol", "instrument_id"), "prev").groupBy(c("instrument_id").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct(c("d").cast("int").alias("d"), "factor"))).alias("splits"))
    return info.join(factors, "symbol", "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<struct<d: int, factor: double>>")))


def derivatives(first: DataFrame, second: DataFrame, stock_options_from: dt.date | None = None) -> DataFrame:
    """Option and future bars of two exchanges' lines: all of the first, contracts on indices of the second (set_union_sources)."""
    both = derivative_bars(first.withColumn("exchange", F.lit(0)), keep=("exchange", "line_no")).unionByName(derivative_bars(second.withColumn("exchange", F.lit(1)), index_only=True, keep=("exchange", "line_no")))
    early = (c("kind") == "option") & (c("of") == "stock") & (c("day") < F.lit(stock_options_from)) if stock_options_from else F.lit(False)
    return both.where(~early)


def spots(first: DataFrame, second: DataFrame) -> DataFrame:
    """(symbol, day, price): the underlying's value in the first line of a day that has one, of the first exchange if it has it; untraded contracts count too."""
    one = lambda lines, exchange: fields(lines).where(c("type").isin("IDO", "STO", "IDF", "STF") & (c("type").startswith("I") | (F.lit(exchange) == 0)) & (c("under") != "")).select("symbol", "day", F.struct(F.lit(exchange).alias("e"), "line_no").alias("at"), (paise(c("under")) / 100).alias("price"))
    return one(first, 0).unionByName(one(second, 1)).groupBy("symbol", "day").agg(F.min_by("price", "at").alias("price"))


def build(spark: SparkSession, raw: str, out: str, until: dt.date | None = None, stock_options_from: dt.date | None = None) -> None:
    """A packed market at ``out`` from ``raw``/cm and ``raw``/fo (zips) and ``raw``/bfo (plain files), with days of cash files up to ``until``."""
    archives = folder(spark, f"{raw}/cm", "zip")
    calendar = written(trading_days(archives, until), "days")
    bars = written(cash(file_lines(archives), calendar), "cash")
    first, second = (written(file_lines(folder(spark, f"{raw}/{name}", kind)), name) for name, kind in (("fo", "zip"), ("bfo", "csv")))
    day = F.broadcast(calendar.withColumnRenamed("dt", "day"))  # a row a trading day
    deals = written(derivatives(first, second, stock_options_from).join(day, "day"), "derivatives")
    prices = ["o", "h", "l", "c"]
    null = lambda kind: F.lit(None).cast(kind)
    d, v = c("d").cast("int").alias("d"), c("v").cast("long").alias("v")
    rows = bars.select(F.lit("cash").alias("kind"), "symbol", null("date").alias("expiry"), null("double").alias("strike"), null("string").alias("opt_type"), d, *prices, v)
    option = c("kind") == "option"
    rows = rows.unionByName(deals.select("kind", "symbol", "expiry", F.when(option, c("strike")).alias("strike"), F.when(option, c("opt_type")).alias("opt_type"), d, *prices, v))
    spot = spots(first, second).join(day, "day").join(deals.select("symbol").distinct(), "symbol", "left_semi")
    rows = rows.unionByName(spot.select(F.lit("spot").alias("kind"), "symbol", null("date").alias("expiry"), null("double").alias("strike"), null("string").alias("opt_type"), d, *[null("double").alias(x) for x in "ohl"], c("price").alias("c"), null("long").alias("v")))
    last = F.struct("exchange", "day", "line_no")
    kinds = contracts(deals, last).join(deals.groupBy("symbol").agg(F.min("of").alias("kind")), "symbol")
    packed_source.write_market(rows, out, calendar, symbols(bars), kinds)
