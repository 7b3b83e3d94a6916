"""A training-data pipeline over ``documents``: five stages, each one corpus operator.

Toxic documents go, repeated runs of lines go, of near copies one stays, sources
are mixed to target weights, and what is left is encoded and decoded. Every
stage is written as Parquet and reread as the next one's input.

Of every stage: an empty table gives no rows; whole texts are read, however
long, each as one value of one row; further columns go along unread, but
names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import bpe, lines, mixture, near, toxicity
from tapewright.llm.common import read_table, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, unchanged. Labels of the training folds are learnt from.

    Null and empty texts score 0 and stay; rows that repeat are judged each; without labels, or of an empty table, all stay.
    """
    return toxicity.without_toxic(spark, docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the runs of lines that an earlier place has; documents of nothing else go.

    Null, empty and wordless texts stay as they are; of equal places (rows that agree in doc_id and text) all get one result.
    """
    return lines.without_repeats(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word similarity of 0.8 or more the one with the smallest doc_id.

    SimHash links propose, and MinHash bands where 64 bits see too little; word sets decide.
    """
    return near.keep_one(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time cut to the words it takes.

    Texts without a word, null ones too, offer nothing and go; rows that agree in all but place share equally.
    """
    return mixture.resample(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, one row per document of the mix."""
    return bpe.digests(spark, docs, bpe.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixture", mix_sources),
    ("bpe", encode),
]

#: The learnt stage and the encoder are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(spark, docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
