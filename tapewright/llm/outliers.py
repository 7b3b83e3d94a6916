"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Base statistics of each text are array expressions; nothing is exploded. A
transformed vector of five statistics is judged within its language and source
by a minimum-covariance-determinant estimate: concentration steps (take the
share CORE of rows nearest by Mahalanobis distance, re-estimate mean and
covariance from them) from two deterministic starts, of which the one with the
smaller determinant is kept. Rows beyond CUTOFF are rejected.

A group has to have more rows than statistics to say much of its own spread: in
smaller ones the floors are nearly all of the variance, and rows are judged by
them around the group's mean; a lone row is at its own mean and is kept.

Every step is two small aggregations that combine on the map side: moments per
group, and a histogram of distances from which the cut of the nearest share is
read. A group of any size, hot or not, is a row of moments to each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP_RE, read_table, stage, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of a group that the estimate rests on, and the factor that makes its covariance consistent for a
#: normal law: CORE / P(chi2 with 7 degrees < 6.6257), where 6.6257 is the CORE quantile with 5 degrees.
CORE, CONSISTENT = 0.75, 1.4126
#: Concentration steps; the determinant falls with each, by less than a thousandth after the fourth.
STEPS = 4
#: A squared distance above it is an outlier: normal data exceed it once in ten million rows (chi2, 5 degrees).
CUTOFF = 41.0
#: Least standard deviation of each transformed statistic, added as variance. Statistics that are zero in most
#: rows have no spread of their own; below this much, a difference says nothing about quality.
FLOORS = (0.5, 0.20, 0.04, 0.12, 0.12)
P = len(FLOORS)


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word); a narrow projection."""
    t = df.withColumn("__t", text_of(text))
    t = t.withColumn("__w", F.expr(rf"filter(split(__t, '{GAP_RE}'), w -> w <> '')".replace("\\", "\\\\")))
    t = t.withColumn("__l", F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^\x20\x09-\x0D]')".replace("\\", "\\\\")))
    windows = f"transform(sequence(0, size(__h) - {WINDOW}), i -> xxhash64(slice(__h, i + 1, {WINDOW})))"
    t = t.withColumn("__h", F.expr("transform(__w, w -> xxhash64(w))"))
    t = t.withColumn("__v", F.expr(f"CASE WHEN size(__h) < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE {windows} END"))
    # of the windows in order of hash, those equal to a neighbour; then the words under them, each once
    covered = f"""CASE WHEN size(array_distinct(__v)) = size(__v) THEN 0L ELSE
      aggregate(
        transform(array(sort_array(arrays_zip(__v, sequence(0, size(__v) - 1)))), s ->
          sort_array(transform(filter(s, (x, k) -> get(s, k - 1).`__v` <=> x.`__v` OR get(s, k + 1).`__v` <=> x.`__v`), x -> x.`1`)))[0],
        named_struct('last', -{WINDOW}, 'sum', 0L),
        (a, p) -> named_struct('last', p, 'sum', a.sum + least({WINDOW}, p - a.last)),
        a -> a.sum) END"""
    return t.select(
        *df.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", GAP_RE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The five transformed statistics. Ratios are shrunk for short texts, whose ratios vary more."""
    c = F.col
    return [
        F.log1p("n_words"),
        (c("word_chars") + 50 * 5) / (c("n_words") + 50),
        F.sqrt(c("n_symbols") / (c("word_chars") + 50)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 4)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 50)),
    ]


X = [f"x{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def _with_inverse(spark: SparkSession, moments: DataFrame, tag: str) -> DataFrame:
    """From (g, s, m_i, c_ij) to (g, s, m_i, w_ij, logdet): w is the inverse of the covariance's Cholesky factor."""
    t = moments
    for i, j in LOWER:  # the factor, one entry at a time
        left = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        t = t.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    for i, j in LOWER:  # its inverse by forward substitution
        t = t.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    t = t.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))
    return stage(spark, t.select("g", "s", *[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i, j in LOWER], "logdet"), tag)


def _distance() -> Column:
    """Squared Mahalanobis distance of x to m."""
    return sum((sum((F.col(f"w{i}{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(P)), F.lit(0.0))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and floored covariance per (g, s)."""
    shift = rows  # values are of order one: products need no centring in double precision
    sums = shift.groupBy("g", "s").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.avg(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in LOWER])
    cov = [((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in LOWER]
    return sums.select("g", "s", *[f"m{i}" for i in range(P)], *cov)


def estimate(spark: SparkSession, vec: DataFrame) -> DataFrame:
    """Per group g of ``vec(g, x0..x4)``: mean, inverse factor and log-determinant of the MCD estimate."""
    n = vec.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.16, 0.5, 0.84], 1000).alias(f"q{i}") for i, x in enumerate(X)], *[F.avg(x).alias(f"a{i}") for i, x in enumerate(X)], *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(X)])
    n = stage(spark, n, "mcd-n")
    diagonal = lambda var: [(F.lit(FLOORS[i] ** 2) + var(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in LOWER]
    robust = n.select("g", F.lit(0).alias("s"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)], *diagonal(lambda i: ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 2) ** 2))
    plain = n.select("g", F.lit(1).alias("s"), *[F.col(f"a{i}").alias(f"m{i}") for i in range(P)], *diagonal(lambda i: F.col(f"v{i}")))
    now = _with_inverse(spark, robust.unionByName(plain), "mcd-start")
    for step in range(STEPS):
        rows = vec.join(now, "g").select("g", "s", *X, F.floor(F.log(_distance() + 1e-9) * 24).alias("bin"))
        counts = rows.groupBy("g", "s", "bin").agg(F.count("*").alias("k"))  # at most some thousand bins a group, whatever its rows
        upto = counts.withColumn("upto", F.sum("k").over(W.partitionBy("g", "s").orderBy("bin")))
        cut = upto.join(n.select("g", "n"), "g").where(F.col("upto") >= F.ceil(F.col("n") * CORE)).groupBy("g", "s").agg(F.min("bin").alias("cut"))
        cut = stage(spark, cut, f"mcd-cut{step}")
        core = rows.join(cut, ["g", "s"]).where("bin <= cut")
        now = _with_inverse(spark, _moments(core, CONSISTENT), f"mcd-{step}")
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "s")).alias("best")).select("g", "best.s")
    return stage(spark, now.join(best, ["g", "s"]).drop("s"), "mcd")


def judge(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, base statistics, base_failed, distance, kept) for every row of ``docs``.

    Groups are (lang, source), nulls being values of their own. Rows that fail
    the base rules are neither kept nor part of the estimate; a group without
    other rows has no estimate, and none is needed.
    """
    group = F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    stats = base_statistics(docs.select(key, group.alias("g"), F.col("text"))).drop("text")
    stats = stats.withColumn("base_failed", base_failed()).withColumns(dict(zip(X, vector())))
    stats = stage(spark, stats, "mcd-stats")
    fitted = estimate(spark, stats.where("NOT base_failed").select("g", *X))
    out = stats.join(fitted, "g", "left").withColumn("distance", _distance())
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))


def op5_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged each; an empty table gives no rows; extra columns are ignored.
    Very long texts are arrays of their words in one row; nothing is exploded.
    """
    out = judge(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"))
