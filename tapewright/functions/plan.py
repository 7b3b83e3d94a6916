"""Keeping plans small: barriers for the optimizer, and tables between the parts of a long job."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows, with every column an attribute of a generator: nothing above is folded into the expressions below.

    Without it the optimizer would substitute a chain of columns into each
    filter and reference above it, and plans would grow with the power of its length.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where none is set and all executors are threads of this machine."""
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
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is a scratch folder
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and reread: what several readers need is computed once,
    later scans prune its columns, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
