"""One-permutation MinHash with optimal densification, stored as packed low-order bits.

Each shingle is hashed once; the hash's high bits choose a bin, which keeps its
smallest hash. An empty bin borrows from the bin that a universal hash of (bin,
attempt) names, attempts counted up until that bin has a shingle of its own
(Shrivastava 2017), so equal sets borrow alike. Of each bin BITS low bits are
stored. Two unrelated bins agree by chance with probability 2^-BITS, which the
likeness corrects for.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, read_table, text_of

BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
SHINGLE = 5
SEED = 42
#: Bytes of text that a task of the shuffle gets, about.
TASK_BYTES = 64 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=16)
def _attempts(chunk: int, width: int = 256) -> np.ndarray:
    """Bins that each bin asks in attempts chunk * width and on."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)
    tries = np.arange(chunk * width, (chunk + 1) * width, dtype=np.uint64)[None, :]
    return (_mix(bins + tries + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``shingle`` words, space-joined; fewer words: of all of them; none: no hash."""
    words = text.encode().split()
    n, joined = len(words), b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), (starts + sizes)[shingle - 1 :].tolist())], np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The stored bits of each bin; no hash at all: zeros."""
    low = np.zeros(BINS, np.uint8)
    if not len(hashes):
        return low
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    order = np.sort(hashes)
    bins = (order >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    least[bins[first]] = order[first]
    empty, chunk = np.flatnonzero(~full), 0
    own = full.copy()
    while len(empty):
        ask = _attempts(chunk)[empty]
        hit = own[ask]
        got = hit.any(axis=1)
        least[empty[got]] = least[ask[got, hit[got].argmax(axis=1)]]
        empty, chunk = empty[~got], chunk + 1
    # mixed with the bin, so that a value borrowed by many bins agrees by chance in each of them apart
    return (_mix(least + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(low: np.ndarray) -> str:
    """Hex of the packed bits, two bins a byte."""
    return ((low[0::2] << 4) | low[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the shingle sets, corrected for chance agreement, in 0..1."""
    same, chance = float(np.mean(a == b)), 2.0**-BITS
    return 1.0 if same == 1.0 else min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (key, fingerprint): the general operator, one narrow pass."""

    def run(batches):
        for b in batches:
            out = [pack(sketch(shingle_hashes(x, shingle))) for x in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], [key, "fingerprint"])

    return df.select(key, text_of(text).alias("__text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fingerprint string")


_LAST = np.iinfo(np.int64).max


def with_next(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt to bins of neighbouring keys and sorted there; each bin also holds the row that follows it.

    Columns key, text, bin, after (true for the row that follows). Texts are
    shuffled once. Bins are cut at quantiles of the keys, so they hold about
    equally many; only their bounds, a few numbers a partition, reach the driver.
    """
    keyed = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(parts(spark), size // TASK_BYTES + 1)  # so that no task's share grows with the corpus
    n = 3 * tasks
    cuts = keyed.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)
    bounds = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def bin_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, s.astype("Int64").fillna(_LAST).to_numpy(np.int64), "right"))

    firsts = sorted((r.b, _LAST if r.f is None else r.f) for r in keyed.groupBy(bin_of(key).alias("b")).agg(F.min(key).alias("f")).collect())
    before = spark.sparkContext.broadcast({f: firsts[i - 1][0] for i, (_, f) in enumerate(firsts)})

    @F.pandas_udf("array<long>")
    def slots(s: pd.Series) -> pd.Series:
        k = s.astype("Int64").fillna(_LAST).to_numpy(np.int64)
        own = np.searchsorted(bounds.value, k, "right")
        return pd.Series([[2 * b] if (p := before.value.get(x)) is None else [2 * b, 2 * p + 1] for x, b in zip(k.tolist(), own.tolist())])

    dealt = keyed.withColumn("slot", F.explode(slots(key))).withColumn("bin", F.expr("slot div 2")).withColumn("after", F.expr("slot % 2 = 1")).drop("slot")
    return dealt.repartition(tasks, "bin").sortWithinPartitions("bin", "after", F.col(key).asc_nulls_last(), "text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    Null and empty texts: the all-zero fingerprint, likeness 1 to themselves.
    Rows of one doc_id follow each other by text; null ids come last. A table of
    one row is followed by itself; an empty one gives no rows. Texts of any length
    are hashed whole; extra columns are ignored.
    """
    rows = with_next(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "text", "bin", "after")

    def run(batches):
        held = None
        for b in batches:
            out = []
            for doc, text, bin_, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bin", "after"))):
                low = None
                if held is not None and held[2] == bin_:
                    low = sketch(shingle_hashes(text))
                    out.append(_pair(*held[:2], held[3], text, low))
                held = None if after else (doc, text, bin_, sketch(shingle_hashes(text)) if low is None else low)
            if out:
                yield pa.RecordBatch.from_pydict({k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate(_OUT)})

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pair(doc, text: str, low: np.ndarray, following: str, low_next: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = sketch(shingle_hashes(edited))
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(low), pack(changed), likeness(low, changed), likeness(low, low_next)
