"""Shared helpers of the corpus operators: staging tables, word rules, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract of this subpackage; all ASCII.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that a worker's memory does not grow with the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader (any file system)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the driver and every executor share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set, but only
    if all executors are threads of this machine; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tapewright-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is a scratch folder
        pass


def stage(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet in the shared folder and rereads it.

    Survives lost executors (the table is not kept by any of them), is computed
    once however often it is read, and lets later scans prune columns.
    """
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def done_with(spark: SparkSession, *staged: DataFrame) -> None:
    """Deletes staged tables whose last reader has run."""
    for df in staged:
        _remove(spark, df.stage_path)


def parts(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id in decimal, modulo 5; fold 0 is held out of all learning."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def components(spark: SparkSession, links: DataFrame, tag: str = "cc", most_rounds: int = 200) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, component), component = smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which end
    after a number of rounds logarithmic in the longest path. Every round is one
    written table; nothing but a row count and a checksum reaches the driver.
    Self links give isolated nodes; null ends are ignored; no links, no rows.
    Raises if ``most_rounds`` have not been enough, rather than return parts.
    """
    ends = stage(spark, links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null"), tag + "l")
    nodes = stage(spark, ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), tag + "n")
    e = stage(spark, ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    done_with(spark, ends)
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # large star: each larger neighbour of a hangs on a's smallest
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # small star: each smaller neighbour and a itself hang on a's smallest
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, stage(spark, small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), tag)
        done_with(spark, before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now[0] == now[2] and now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(roots, nodes.node == roots.a, "left").select("node", F.coalesce("m", "node").alias("component"))
