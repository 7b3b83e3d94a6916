"""Small reference files: the register of advisers, whose header has to be found, and the annexure of a case, whose rows differ in shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import written

c = F.col
#: Parts into which recommendations are dealt, however few bytes they are on the way: keys take several times as much when they are grouped.
DEALT = 200
#: Cells of a line that are read.
WIDEST = 40
# ---- fixed values: how the register's columns are called, and what its numbers begin with
COLUMNS = {"name": r"(?i)^name$", "reg_no": r"(?i)registration\s*no", "valid_from": r"(?i)^from$", "valid_to": r"(?i)^to$"}
NUMBER = r"^IN[HA]"


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, line) of CSV files that are small enough to be a value each."""
    whole = spark.read.text(path, wholetext=True).select(c("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))


def register(lines: DataFrame) -> DataFrame:
    """(file, reg_no, name, valid_from, valid_to) of register files ``lines(file, row, line)``.

    The first row of a file with a cell that names the number is its header, and says by pattern in which column what stands;
    titles above it are skipped. Rows without such a number are none; of a number that repeats in a file the last row counts.
    A file in which no row is a header raises, as a register that cannot be read must not pass for an empty one.
    """
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(WIDEST))), {"mode": "PERMISSIVE"})
    rows = lines.select("file", "row", F.transform(F.array(*[cells[f"c{i}"] for i in range(WIDEST)]), lambda x: F.trim(F.coalesce(x, F.lit("")))).alias("cells"))
    is_head = F.exists("cells", lambda x: x.rlike(COLUMNS["reg_no"]))
    place = lambda pattern: F.array_position(F.transform("head", lambda x: x.rlike(pattern)), True)
    heads = rows.groupBy("file").agg(F.min(F.when(is_head, c("row"))).alias("at"), F.min_by("cells", F.when(is_head, c("row"))).alias("head"))
    at = F.when(c("at").isNull(), F.raise_error(F.concat(F.lit("no header row in "), c("file"))).cast("int")).otherwise(c("at"))
    heads = heads.select("file", at.alias("at"), *[place(p).cast("int").alias(f"i_{k}") for k, p in COLUMNS.items()])
    found = rows.join(F.broadcast(heads), "file").where("row > at")  # a row a file
    value = lambda k: F.when(c(f"i_{k}") > 0, F.get("cells", c(f"i_{k}") - 1)).otherwise("")
    found = found.select("file", "row", *[(F.upper(value(k)) if k == "reg_no" else value(k)).alias(k) for k in COLUMNS]).where(c("reg_no").rlike(NUMBER))
    return found.groupBy("file", "reg_no").agg(F.max_by(F.struct("name", "valid_from", "valid_to"), "row").alias("r")).select("file", "reg_no", "r.*")


def annexure(documents: DataFrame, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(document, page, reco_date, scrip, reco_time, eff_date) of the rows of JSON texts ``documents(document, value)``.

    Documents are variants: each row may call its fields by any of the ``names``, of which the first that it has counts, and may
    have others. A text that is no JSON, or has no list of rows, gives none; a row without a scrip is none.
    """
    keys = {"page": ("page",), "reco_date": ("recoDate", "reco_date"), "scrip": ("scrip", "Scrip Name"), "reco_time": ("recoTime", "reco_time"), "eff_date": ("effDateT", "eff_date")} | (names or {})
    rows = documents.select("document", F.explode(F.try_variant_get(F.try_parse_json("value"), "$.rows", "array<variant>")).alias("v"))
    kind = lambda k: "int" if k == "page" else "string"
    one = lambda k: F.coalesce(*[F.try_variant_get("v", f"$['{x}']", kind(k)) for x in keys[k]]).alias(k)
    return rows.select("document", *[one(k) for k in keys]).where("scrip IS NOT NULL")


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """How much of a case the prices cover: for each value of ``by``, and over all (``by`` null, whole true).

    rows: scrip, reco_date, reco_time, symbol (null where the prices have none), measured. Distinct values are keys of
    plain groupings, one after the other: distinct counts beside each other would hold every row once for each of them.
    """
    reco, inside = ["scrip", "reco_date", "reco_time"], c("symbol").isNotNull()
    rows = written(rows.select(by, *reco, "symbol", "measured"), "coverage")
    dealt = rows.repartition(DEALT, *reco)
    yes = lambda x: F.coalesce(F.bool_or(x), F.lit(False))

    def counts(of: list) -> DataFrame:
        one = dealt.groupBy(*of, *reco).agg(F.count("*").alias("rows"), yes(inside).alias("inside"), yes(c("measured")).alias("m"), yes(~c("measured")).alias("u"))
        scrip = one.groupBy(*of, "scrip").agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.bool_or("inside").alias("inside"), F.count_if("m").alias("m"), F.count_if("u").alias("u"))
        return scrip.groupBy(*of).agg(
            F.sum("rows").alias("rows"), F.sum("n").alias("recommendations"), F.count("scrip").alias("scrips"), F.count_if(c("inside") & c("scrip").isNotNull()).alias("scrips_in_data"),
            F.sum("m").alias("measured"), F.sum("u").alias("not_measured"),
        )

    null = F.lit(None).cast(rows.schema[by].dataType).alias(by)
    all_ = counts([]).where("rows IS NOT NULL")  # of no rows there is nothing to say
    out = counts([by]).withColumn("whole", F.lit(False)).unionByName(all_.select(null, F.lit(True).alias("whole"), *all_.columns))
    traded = rows.where(c("measured") & inside).groupBy(by, "symbol").agg(F.lit(1).alias("one"))
    of, whole = traded.groupBy(by).agg(F.count("*").alias("n")), traded.select("symbol").distinct().agg(F.count("*").alias("n"))
    stocks = of.select(c(by).alias("__by"), F.lit(False).alias("__whole"), c("n").alias("stocks_measured")).unionByName(whole.select(null.alias("__by"), F.lit(True).alias("__whole"), c("n").alias("stocks_measured")))
    out = out.join(stocks, c(by).eqNullSafe(c("__by")) & (c("whole") == c("__whole")), "left")
    return out.select(by, "whole", "rows", "recommendations", "scrips", "scrips_in_data", "measured", "not_measured", F.coalesce("stocks_measured", F.lit(0)).alias("stocks_measured"))
