"""The packed market as a Spark data source: ``spark.read.format("packed_market")``.

One reader for cash, option, future and spot tables. Its own index names every
file, so nothing is listed; what is asked of kind, symbol and expiry chooses
the files, whose groups are the input partitions. The choice is made by options of
the load, not by filters that Spark pushes down: Spark 4.1 keeps the pushed filters of a
Python source with the loaded relation, so a frame that is filtered in two ways,
or read again, would get the rows of its first use. The writer writes
files apart and publishes them in one commit; a task that is run again
leaves nothing behind, and the index is written last.

Paths are anything that Arrow's file systems open (local, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .market import decode_table, encode_table

c = F.col
SCHEMA = "kind string, symbol string, expiry date, strike double, opt_type string, d int, o double, h double, l double, c double, v long"
KINDS = ("cash", "option", "future", "spot")
#: Files that one input partition reads.
GROUP = 64
_ARROW = pa.schema([("kind", pa.string()), ("symbol", pa.string()), ("expiry", pa.date32()), ("strike", pa.float64()), ("opt_type", pa.string()), ("d", pa.int32()), *[(x, pa.float64()) for x in "ohlc"], ("v", pa.int64())])
_PRICES = ("o", "h", "l", "c")


def file_key(symbol: str) -> str:
    """The file-safe form of a ticker."""
    return re.sub("[^A-Z0-9-]", "_", symbol.upper())


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _json(store: fs.FileSystem, path: str) -> dict:
    try:
        with store.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}


@dataclass
class Files(InputPartition):
    """Tables (kind, symbol, expiry or None, path below the market's folder) that one task reads."""

    tables: list = field(default_factory=list)


class PackedReader(DataSourceReader):
    """Reads the tables of the kinds and symbols asked for (none: all), and of options those whose expiry lies in [since, until]."""

    def __init__(self, path: str, group: int, kinds: list, symbols: list, since: str, until: str):
        self.path, self.group, self.kinds, self.symbols, self.since, self.until = path, group, set(kinds), set(symbols), since, until

    def _wants(self, kind: str, symbol: str, expiry: dt.date | None) -> bool:
        if self.kinds and kind not in self.kinds or self.symbols and symbol not in self.symbols:
            return False
        return kind != "option" or (not self.since or expiry.isoformat() >= self.since) and (not self.until or expiry.isoformat() <= self.until)

    def tables(self) -> list:
        """All tables that the index names and that are asked for, in order."""
        store, root = _opened(self.path)
        out = [("cash", s, None, f"cm/{file_key(s)}.rkn") for s in _json(store, f"{root}/symbols.json")]
        for s, entry in _json(store, f"{root}/fo/index.json").items():
            folder = f"fo/{file_key(s)}"
            for date, _, options, _ in entry["x"]:
                if options:
                    out.append(("option", s, dt.date.fromisoformat(date), f"{folder}/{date.replace('-', '')}.rkn"))
            if any(x[3] for x in entry["x"]):
                out.append(("future", s, None, f"{folder}/fut.rkn"))
            out.append(("spot", s, None, f"{folder}/u.rkn"))
        return sorted((t for t in out if self._wants(*t[:3])), key=lambda t: t[3])

    def partitions(self) -> list[Files]:
        tables = self.tables()
        return [Files(tables[i : i + self.group]) for i in range(0, len(tables), self.group)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)
        for kind, symbol, expiry, at in partition.tables:
            try:
                with store.open_input_stream(f"{root}/{at}") as f:
                    content = f.read()
            except FileNotFoundError:  # named by the index, but not there: no bars
                continue
            yield _batch(kind, symbol, expiry, decode_table(content))


def _batch(kind: str, symbol: str, expiry: dt.date | None, cols: list) -> pa.RecordBatch:
    """A table's columns as rows of SCHEMA: hundredths as prices, codes as types, numbers as dates."""
    n = len(cols[0])
    out = {f.name: pa.nulls(n, f.type) for f in _ARROW} | {"kind": pa.repeat(kind, n), "symbol": pa.repeat(symbol, n)}
    if kind == "option":
        strike, code, *cols = cols
        out |= {"expiry": pa.repeat(pa.scalar(expiry, pa.date32()), n), "strike": pa.array(strike / 100), "opt_type": pc.if_else(pa.array(code == 1), "PE", "CE")}
    if kind == "future":
        date, *cols = cols
        out["expiry"] = pa.array([dt.date(x // 10_000, x // 100 % 100, x % 100) for x in date.tolist()], pa.date32())
    day, *values = cols
    out["d"] = pa.array(day).cast(pa.int32())
    if kind == "spot":
        out["c"] = pa.array(values[0] / 100)
    else:
        out |= {x: pa.array(v / 100) for x, v in zip(_PRICES, values)} | {"v": pa.array(values[4])}
    return pa.RecordBatch.from_pydict(out, schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: tables (kind, symbol, expiry, path) and the folder they wait in."""

    folder: str
    tables: list


class PackedWriter(DataSourceArrowWriter):
    """Writes each table to a folder of the attempt; the commit moves tables into place and writes the index last.

    Rows of a table have to come together and in order, as ``write_market`` sends them.
    """

    def __init__(self, path: str, dimensions: str):
        self.path, self.job = path, uuid.uuid4().hex
        self.dims = {"days": None, "symbols": {}, "lots": {}, "index": []} | json.loads(dimensions)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        folder = f"_attempts/{self.job}/{uuid.uuid4().hex}"
        done, key, parts = [], None, []

        def put():
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            kind, symbol, file = key
            at = f"cm/{file_key(symbol)}.rkn" if kind == "cash" else f"fo/{file_key(symbol)}/{file}.rkn"
            full = f"{root}/{folder}/{at}"
            store.create_dir(full.rpartition("/")[0], recursive=True)
            with store.open_output_stream(full) as f:
                f.write(encode_table(_columns(kind, t)))
            done.append((kind, symbol, sorted({x.isoformat() for x in t["expiry"].to_pylist() if x}), at))

        for b in iterator:
            names = b.schema.names
            keys = list(zip(b.column(names.index("kind")).to_pylist(), b.column(names.index("symbol")).to_pylist(), b.column(names.index("file")).to_pylist()))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != key:
                        put()
                        key, parts = keys[start], []
                    parts.append(b.slice(start, i - start))
                    start = i
        put()
        return Written(folder, done)

    def commit(self, messages: list) -> None:
        store, root = _opened(self.path)
        told = [m for m in messages if m is not None]
        symbols, index = _json(store, f"{root}/symbols.json"), _json(store, f"{root}/fo/index.json")
        owners: dict[str, str] = {}
        for m in told:
            for kind, symbol, expiries, at in m.tables:
                if owners.setdefault(file_key(symbol), symbol) != symbol:
                    raise ValueError(f"two symbols of one file key: {symbol} and {owners[file_key(symbol)]}")
                store.create_dir(f"{root}/{at}".rpartition("/")[0], recursive=True)
                store.move(f"{root}/{m.folder}/{at}", f"{root}/{at}")
                if kind == "cash":
                    symbols[symbol] = self.dims["symbols"].get(symbol, symbols.get(symbol, {}))
                    continue
                entry = index.setdefault(symbol, {"k": "I" if symbol in self.dims["index"] else "S", "x": []})
                for date in expiries:
                    row = next((x for x in entry["x"] if x[0] == date), None)
                    if row is None:
                        entry["x"].append(row := [date, self.dims["lots"].get(f"{symbol}|{date}", 0), 0, 0])
                    row[2 if kind == "option" else 3] = 1
                entry["x"].sort()
        meta = [("meta.json", {"days": self.dims["days"]})] if self.dims["days"] is not None else []
        for name, content in [*meta, ("symbols.json", symbols), ("fo/index.json", index)]:
            store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(json.dumps(dict(sorted(content.items()))).encode())
        self._forget()

    def abort(self, messages: list) -> None:
        self._forget()

    def _forget(self) -> None:
        store, root = _opened(self.path)
        try:
            store.delete_dir(f"{root}/_attempts/{self.job}")
        except FileNotFoundError:
            pass


def _columns(kind: str, t: pa.Table) -> list:
    """Rows of one table as integer columns: hundredths, codes, dates as numbers."""
    hundredths = lambda x: pc.cast(pc.round(pc.multiply(t[x], 100.0)), pa.int64()).to_pylist()
    if kind == "spot":
        return [t["d"].to_pylist(), hundredths("c")]
    lead = []
    if kind == "option":
        lead = [hundredths("strike"), [int(x == "PE") for x in t["opt_type"].to_pylist()]]
    if kind == "future":
        lead = [[x.year * 10_000 + x.month * 100 + x.day for x in t["expiry"].to_pylist()]]
    return [*lead, t["d"].to_pylist(), *[hundredths(x) for x in _PRICES], t["v"].to_pylist()]


class PackedMarket(DataSource):
    """Options: path, files per input partition (``group``), and what is asked for: kinds, symbols (JSON lists), since, until (dates of expiry)."""

    @classmethod
    def name(cls) -> str:
        return "packed_market"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackedReader:
        o = self.options
        return PackedReader(o["path"].rstrip("/"), int(o.get("group", GROUP)), json.loads(o.get("kinds", "[]")), json.loads(o.get("symbols", "[]")), o.get("since", ""), o.get("until", ""))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"].rstrip("/"), self.options.get("dimensions", "{}"))


def market_bars(spark: SparkSession, path: str, kinds: tuple = (), symbols: tuple = (), since: dt.date | None = None, until: dt.date | None = None, group: int = GROUP) -> DataFrame:
    """Bars of a packed market, as SCHEMA, of the kinds and symbols asked for (none: all) and, where ``since`` or
    ``until`` is given, of expiries in that span only. Files of other kinds, symbols and expiries are not opened."""
    spark.dataSource.register(PackedMarket)
    asked = {"path": path, "group": str(group), "kinds": json.dumps(list(kinds)), "symbols": json.dumps(list(symbols)), "since": since.isoformat() if since else "", "until": until.isoformat() if until else ""}
    bars = spark.read.format("packed_market").options(**asked).load()
    span = [c("expiry") >= F.lit(since)] * (since is not None) + [c("expiry") <= F.lit(until)] * (until is not None)
    for s in span:  # a file of futures holds several expiries
        bars = bars.where(s)
    return bars


def write_market(bars: DataFrame, path: str, calendar: DataFrame | None = None, symbols: DataFrame | None = None, expiries: DataFrame | None = None) -> None:
    """Bars (SCHEMA) as a packed market. A table is one symbol's (cash, futures, spot) or one expiry's (options) and is held whole by one task.

    calendar (d, dt), symbols (symbol, name, series, first_d, last_d, sme, splits) and expiries (symbol, kind, expiry, lot) are the
    market's dimensions, of which its layout keeps one file each. Writing again replaces tables and keeps one index.
    """
    spark = bars.sparkSession
    spark.dataSource.register(PackedMarket)
    dims: dict = {}
    if calendar is not None:
        dims["days"] = [str(r.dt) for r in calendar.orderBy("d").select("dt").collect()]
    if symbols is not None:
        info = lambda r: {"n": r.name, "r": r.series, "a": r.first_d, "z": r.last_d} | ({"m": 1} if r.sme else {}) | ({"x": [[x.d, x.factor] for x in r.splits]} if r.splits else {})
        dims["symbols"] = {r.symbol: info(r) for r in symbols.select("symbol", "name", "series", "first_d", "last_d", "sme", "splits").collect()}
    if expiries is not None:
        rows = expiries.select("symbol", "kind", "expiry", "lot").collect()
        dims |= {"lots": {f"{r.symbol}|{r.expiry}": r.lot or 0 for r in rows}, "index": sorted({r.symbol for r in rows if r.kind == "index"})}
    file = F.when(c("kind") == "option", F.date_format("expiry", "yyyyMMdd")).when(c("kind") == "future", "fut").when(c("kind") == "spot", "u").otherwise("")
    order = ["kind", "symbol", "file", "strike", c("opt_type") == "PE", "expiry", "d"]
    dealt = bars.withColumn("file", file).repartition("kind", "symbol", "file").sortWithinPartitions(*order)
    dealt.write.format("packed_market").option("path", path).option("dimensions", json.dumps(dims)).mode("append").save()


def market_dimensions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calendar (d, dt), symbols (symbol, name, series, first_d, last_d, sme, splits) and expiries (symbol, kind, expiry, lot,
    has_options, has_futures) of a packed market. A missing file raises, an empty one gives no rows."""
    whole = lambda name: spark.read.text(f"{path}/{name}", wholetext=True)
    days = whole("meta.json").select(F.posexplode(F.from_json("value", "days array<string>")["days"]).alias("d", "dt")).select("d", F.to_date("dt").alias("dt"))
    info = "map<string, struct<n: string, r: string, a: int, z: int, m: int, x: array<array<double>>>>"
    symbols = whole("symbols.json").select(F.explode(F.from_json("value", info)).alias("symbol", "i"))
    splits = F.transform(F.coalesce("i.x", F.array().cast("array<array<double>>")), lambda x: F.struct(x[0].cast("int").alias("d"), x[1].alias("factor")))
    symbols = symbols.select("symbol", c("i.n").alias("name"), c("i.r").alias("series"), c("i.a").alias("first_d"), c("i.z").alias("last_d"), (F.coalesce("i.m", F.lit(0)) == 1).alias("sme"), splits.alias("splits"))
    index = whole("fo/index.json").select(F.explode(F.from_json("value", "map<string, struct<k: string, x: array<array<string>>>>")).alias("symbol", "i"))
    index = index.select("symbol", F.when(c("i.k") == "I", "index").otherwise("stock").alias("kind"), F.explode("i.x").alias("x"))
    flag = lambda i: c("x")[i].cast("int") != 0
    return days, symbols, index.select("symbol", "kind", F.to_date(c("x")[0]).alias("expiry"), c("x")[1].cast("int").alias("lot"), flag(2).alias("has_options"), flag(3).alias("has_futures"))
