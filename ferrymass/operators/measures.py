"""Measures as tables (problem, axis, idx, mass): normalising and checking in one aggregation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(measure: DataFrame, keys: list[str]) -> DataFrame:
    """Masses divided by their sum for each key. Sums are partial before they shuffle, and no task meets a measure as a whole."""
    total = measure.groupBy(*keys).agg(F.sum("mass").alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = measure.join(total.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    return both.select(*[(F.col("mass") / F.col("_total")).alias(c) if c == "mass" else F.col(c) for c in measure.columns])


def finite(x: Column) -> Column:
    """Whether a value is a number other than NaN and the infinities; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def problem_status(cost: DataFrame, measures: list[DataFrame], eps: float, tolerance: float | None = None, rtol: float = 1e-10) -> DataFrame:
    """problem, valid for every problem that the cost or a measure names.

    Valid: all costs and masses finite, no mass negative, every axis there with
    positive mass, all of equal mass, and epsilon and tolerance finite and positive.
    """
    fit = all(x is None or (math.isfinite(x) and x > 0) for x in (eps, tolerance)) and eps is not None
    costs = cost.groupBy("problem").agg(F.bool_and(finite(F.col("c").cast("double"))).alias("cost_ok"))
    each = [m.groupBy("problem").agg(F.bool_and(finite(F.col("mass")) & (F.col("mass") >= 0)).alias("ok"), F.sum("mass").alias("total")) for m in measures]
    axes = reduce(DataFrame.unionByName, each).groupBy("problem").agg(F.count("*").alias("axes"), F.bool_and("ok").alias("ok"), F.min("total").alias("least"), F.max("total").alias("most"))
    equal = F.col("most") - F.col("least") <= rtol * (1 + F.abs("most"))
    good = F.lit(fit) & F.col("cost_ok") & (F.col("axes") == len(measures)) & F.col("ok") & (F.col("least") > 0) & equal
    return costs.join(axes, "problem", "full").select("problem", F.coalesce(good, F.lit(False)).alias("valid"))


def check(measure: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """problem, axes, valid: masses finite, none negative, each axis of positive mass, and all axes of equal mass."""
    axes = measure.groupBy("problem", "axis").agg(F.bool_and(finite(F.col("mass")) & (F.col("mass") >= 0)).alias("ok"), F.sum("mass").alias("total"))
    least, most = F.min("total"), F.max("total")
    return axes.groupBy("problem").agg(F.count("*").alias("axes"), (F.bool_and("ok") & (least > 0) & (most - least <= tolerance + tolerance * F.abs(most)) & (F.count("*") >= 2)).alias("valid"))


def support(measure: DataFrame) -> DataFrame:
    """Cells of positive mass; the others have no part in a plan and never pair."""
    return measure.filter(F.col("mass") > 0)
