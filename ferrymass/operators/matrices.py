"""Hermitian matrices as tables (problem, r, c, re, im): index arithmetic, joins and sums in place of dense algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_trace(matrix: DataFrame, m: int, keep: str) -> DataFrame:
    """Trace over the factor that isn't kept of a matrix on a product space whose second factor has m states; rows are i * m + a."""
    i, a = F.floor(F.col("r") / m), F.col("r") % m
    j, b = F.floor(F.col("c") / m), F.col("c") % m
    own, other = ((i, j), (a, b)) if keep == "first" else ((a, b), (i, j))
    return matrix.filter(other[0] == other[1]).groupBy("problem", own[0].cast("long").alias("r"), own[1].cast("long").alias("c")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def hermitian_part(matrix: DataFrame) -> DataFrame:
    """(M + M*) / 2: entries and their mirror images are summed by place."""
    mirror = matrix.select("problem", F.col("c").alias("r"), F.col("r").alias("c"), "re", (-F.col("im")).alias("im"))
    return matrix.unionByName(mirror).groupBy("problem", "r", "c").agg((F.sum("re") / 2).alias("re"), (F.sum("im") / 2).alias("im"))


def inner(x: DataFrame, y: DataFrame) -> DataFrame:
    """problem, value: the real part of the Hilbert-Schmidt product."""
    y = y.withColumnsRenamed({"re": "re2", "im": "im2"})
    return x.join(y, ["problem", "r", "c"]).groupBy("problem").agg(F.sum(F.col("re") * F.col("re2") + F.col("im") * F.col("im2")).alias("value"))


def lift_sum(u: DataFrame, v: DataFrame, n: int, m: int) -> DataFrame:
    """U x I + I x V, the adjoint of taking both partial traces. Each entry is copied along the other factor's diagonal."""
    eye_m = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k")
    eye_n = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    left = u.select("*", eye_m).select("problem", (F.col("r") * m + F.col("k")).alias("r"), (F.col("c") * m + F.col("k")).alias("c"), "re", "im")
    right = v.select("*", eye_n).select("problem", (F.col("k") * m + F.col("r")).alias("r"), (F.col("k") * m + F.col("c")).alias("c"), "re", "im")
    return left.unionByName(right).groupBy("problem", "r", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def entry_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """problem, error: the sum of absolute differences of all entries."""
    y = y.withColumnsRenamed({"re": "re2", "im": "im2"})
    zero = F.lit(0.0)
    dre = F.coalesce("re", zero) - F.coalesce("re2", zero)
    dim = F.coalesce("im", zero) - F.coalesce("im2", zero)
    return x.join(y, ["problem", "r", "c"], "full").groupBy("problem").agg(F.sum(F.sqrt(dre * dre + dim * dim)).alias("error"))
