"""Line dedup by winnowing over line hashes.

Lines with a word are hashed. A window is a least run of consecutive lines that
holds WORDS words, counted from its first line on or back from its last. The
line with the least hash in a window (the leftmost of equal ones) is selected;
neighbouring windows mostly select the same line, so a text leaves fewer
positions than lines. Two equal runs of at least WORDS words hold an equal
window, which selects the same line in both: no such run goes unseen, while a
short line alone is never a match.

Positions are brought together by the hash of the selected line, and those that
are alone with theirs, nearly all, are dropped after a count that combines on
the map side. What is left is extended both ways, to every window that the
position was selected by, and each is compared with the first place that has
it. Every line of a repeated run is in a window inside the run that starts or
ends with the run or with the line itself, so the windows together are the
whole of every repeated run, also where its parts first stood in several
places. All but first places are deleted.

Order is that of (doc_id, line), null ids last; rows that agree in doc_id and
text are one document and get one result. A hot line is one row per task in
both counts, and the joins have one row a key on one side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import done_with, read_table, stage, text_of

#: Least words of a run that counts as repeated.
WORDS = 10


def spans_of(size: list[int], words: int) -> list[tuple[int, int]]:
    """First and last line of each window, given the number of words of each line."""
    n, held, end = len(size), 0, 0
    out = set()
    for start in range(n):  # counted from a first line on
        while end < n and held < words:
            held += size[end]
            end += 1
        if held < words:
            break
        out.add((start, end - 1))
        held -= size[start]
    held, start = 0, n - 1
    for end in range(n - 1, -1, -1):  # counted back from a last line
        while start >= 0 and held < words:
            held += size[start]
            start -= 1
        if held < words:
            break
        out.add((start + 1, end))
        held -= size[end]
    return sorted(out)


def selected(text: str, words: int = WORDS) -> list[tuple]:
    """(line hash, firsts, lasts, hashes) of each selected line: the windows that select it, by line numbers, and the hash of each."""
    lines = [(i, x.rstrip()) for i, x in enumerate(text.encode().split(b"\n")) if x.strip()]
    h = np.array([xxhash.xxh64_intdigest(x) for _, x in lines], np.uint64)
    raw, ids = h.tobytes(), h.tolist()
    found: dict[int, tuple] = {}
    for a, b in spans_of([min(words, len(x.split(None, words))) for _, x in lines], words):
        at = min(range(a, b + 1), key=ids.__getitem__)
        row = found.setdefault(at, (ids[at], [], [], []))
        for column, x in zip(row[1:], (lines[a][0], lines[b][0], xxhash.xxh64_intdigest(raw[8 * a : 8 * b + 8], b - a))):
            column.append(x)
    return list(found.values())


def positions(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, tid, fp, first, last, whole), one per selected line; one narrow pass."""
    signed = lambda xs: np.array(xs, np.uint64).view(np.int64)

    def run(batches):
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                got = selected(text, words)
                take += [i] * len(got)
                rows += got
            cut = pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32())
            flat = lambda k: [x for r in rows for x in r[k]]
            lists = [pa.ListArray.from_arrays(cut, pa.array(flat(k), pa.int32())) for k in (1, 2)] + [pa.ListArray.from_arrays(cut, pa.array(signed(flat(3))))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(take, pa.int64())) for k in ("doc_id", "tid")), pa.array(signed([r[0] for r in rows])), *lists], ["doc_id", "tid", "fp", "first", "last", "whole"])

    return docs.select("doc_id", F.xxhash64("__text").alias("tid"), "__text").mapInArrow(run, "doc_id long, tid long, fp long, first array<int>, last array<int>, whole array<long>")


def repeated_runs(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, tid, a, b): lines a to b, counted from 0, repeat what came earlier."""
    chosen = stage(spark, positions(docs, words), "lines")
    met = chosen.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    met = stage(spark, met, "lines-met")  # a join whose sides are only dealt out can be split at a hot line
    windows = chosen.join(met, "fp").select("doc_id", "tid", "fp", F.explode(F.arrays_zip("first", "last", "whole")).alias("w"))
    windows = stage(spark, windows.select("doc_id", "tid", "fp", "w.*"), "lines-windows")
    done_with(spark, chosen, met)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid", "first")
    known = windows.groupBy("fp", "whole").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = stage(spark, known, "lines-known")
    hits = windows.join(known, ["fp", "whole"]).where(~(F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("tid") == F.col("o.tid")) & (F.col("first") == F.col("o.first"))))
    return hits.select("doc_id", "tid", F.col("first").alias("a"), F.col("last").alias("b"))


def _removed(text: str, spans: list[dict]) -> list[bool]:
    """Whether each line goes; one without a word goes if the lines with words on both its sides go."""
    worded = np.array([bool(x.encode().strip()) for x in text.split("\n")])
    edge = np.zeros(len(worded) + 1, np.int64)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] + 1 for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(worded)
    after = np.searchsorted(at, np.arange(len(worded)))  # the next line with a word, or this
    inside = ~worded & (after > 0) & (after < len(at))
    gone[inside] = gone[at[after[inside] - 1]] & gone[at[after[inside]]]
    return (gone & (worded | inside)).tolist()


def dedup(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs of ``words`` words or more, and __lines, __removed, __spans.

    Null texts stay null; texts without a word are as they were; other columns
    are passed through, except that names beginning with __ are the operator's.
    """
    names = docs.columns
    keyed = docs.withColumn("__text", text_of()).withColumn("__doc", F.col("doc_id").cast("long"))
    runs = repeated_runs(spark, keyed.select(F.col("__doc").alias("doc_id"), "__text"), words)
    spans = runs.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("a", "b")).alias("__s"))  # bounded by the lines of one document
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("tid").alias("__t"), "__s")
    both = keyed.withColumn("__tid", F.xxhash64("__text")).join(spans, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__tid") == F.col("__t")), "left").select(*names, "__s")

    def run(batches):
        for b in batches:
            new, n, gone, k = [], [], [], []
            for text, s in zip(b.column("text").to_pylist(), b.column("__s").to_pylist()):
                drop = _removed(text, s) if s else []
                count = sum(1 for x in (text or "").split("\n") if x.encode().strip()) if text else 0
                n.append(count)
                if any(drop):
                    rows = text.split("\n")
                    gone.append(sum(d and bool(x.encode().strip()) for d, x in zip(drop, rows)))
                    k.append(sum(d and not e for d, e in zip(drop, [False, *drop])))
                    text = "\n".join(x for d, x in zip(drop, rows) if not d)
                else:
                    gone.append(0)
                    k.append(0)
                new.append(text)
            cols = [pa.array(new, b.schema.field("text").type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64())], [*names, "__lines", "__removed", "__spans"])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__lines", "__removed", "__spans"))])
    return both.mapInArrow(run, schema)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, how many of them were deleted in how many runs, and the digest of what is left.

    Null texts count as empty; an empty table gives no rows; extra columns are
    ignored. A very long text is one row, and its lines are read once. Rows that
    agree in doc_id and text get one result; ties of place do not occur.
    """
    out = dedup(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.sha2(text_of(), 256).alias("kept_sha256"))


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` less repeated runs; a document of which no word is left, but had some, goes. ``n_chars`` follows the text."""
    out = dedup(spark, docs).where(~((F.col("__removed") > 0) & (F.col("__removed") == F.col("__lines"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length(text_of())).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
