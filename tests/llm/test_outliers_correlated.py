"""The covariance of the MCD estimate decides where statistics have a spread of their own: outliers off a correlation."""

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import outliers


def test_outliers_off_the_correlation(spark):
    rng = np.random.default_rng(4)
    n, bad = 1500, 150
    x0 = rng.normal(5, 1.5, n)
    x1 = 0.7 * (x0 - 5) + rng.normal(5, 0.15, n)
    good = np.column_stack([x0, x1, np.zeros((n, 3))])
    # inside the range of either statistic, and all on one side, so that a plain covariance leans towards them
    at = rng.normal(7, 0.2, bad)
    off = np.column_stack([at, rng.normal(2.7, 0.1, bad), np.zeros((bad, 3))])
    rows = [("g", k < bad, *map(float, v)) for k, v in enumerate(np.concatenate([off, good]))]
    vec = spark.createDataFrame(rows, "g string, bad boolean, " + ", ".join(f"{x} double" for x in outliers.X))
    fitted = outliers.estimate(spark, vec.select("g", *outliers.X))
    got = vec.join(fitted, "g").withColumn("out", outliers._distance() > outliers.CUTOFF).groupBy("bad").agg(F.count_if("out").alias("k")).collect()
    assert {r.bad: r.k for r in got} == {True: bad, False: 0}
    # distances by the floors alone reject good rows and keep bad ones' like
    plain = ((good - np.median(good, axis=0)) / np.array(outliers.FLOORS)) ** 2
    assert (plain.sum(axis=1) > outliers.CUTOFF).sum() > 100
    # and a plain covariance keeps all
    both = np.concatenate([off, good])[:, :2]
    d = both - both.mean(axis=0)
    assert (np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(d.T)), d)[:bad] > outliers.CUTOFF).sum() == 0
