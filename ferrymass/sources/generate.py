"""Generated inputs as DataFrames: costs on grids, Gaussian measures, and points that depend on their row number alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.operators.measures import normalise


def pair_cost(kind: str, a: Column, b: Column, diagonal_penalty: float = 1e6) -> Column:
    d = F.abs(a - b).cast("double")
    if kind == "euclidean":
        return d * d
    if kind == "weak-coulomb":
        return 1.0 / (d + 1.0)
    if kind == "strong-coulomb":
        return F.when(d == 0, F.lit(diagonal_penalty)).otherwise(1.0 / F.greatest(d, F.lit(1.0)))
    raise ValueError(f"unknown cost kind: {kind}")


def cost_tensor(spark: SparkSession, n: int, marginals: int = 2, kind: str = "euclidean", diagonal_penalty: float = 1e6) -> DataFrame:
    """i0, i1, ..., c: the sum of pair costs over all pairs of axes. The n ** marginals cells come of one range, numbered in base n."""
    if n < 1 or marginals < 2:
        raise ValueError("a cost needs a positive size and two marginals or more")
    cells = spark.range(n**marginals)
    axes = [(F.floor(F.col("id") / n ** (marginals - 1 - k)) % n).cast("int").alias(f"i{k}") for k in range(marginals)]
    out = cells.select(*axes)
    total = F.lit(0.0)
    for p in range(marginals):
        for q in range(p + 1, marginals):
            total = total + pair_cost(kind, F.col(f"i{p}"), F.col(f"i{q}"), diagonal_penalty)
    return out.withColumn("c", total)


def cost_between(axes: list[DataFrame], kind: str = "euclidean", diagonal_penalty: float = 1e6) -> DataFrame:
    """problem, i0, i1, ..., c: the sum of pair costs between positions xk of the cells (problem, ik, xk) of every axis.

    All combinations of a problem's cells are what is asked for; they are made
    problem by problem from the first axis on, so its rows are what tasks share.
    """
    out, total = axes[0], F.lit(0.0)
    for k, axis in enumerate(axes[1:], 1):
        out = out.join(axis, "problem")
        for p in range(k):
            total = total + pair_cost(kind, F.col(f"x{p}"), F.col(f"x{k}"), diagonal_penalty)
    return out.select("problem", *[f"i{k}" for k in range(len(axes))], total.alias("c"))


def gaussian_mixtures(fits: DataFrame, n: int, lower: float, upper: float) -> DataFrame:
    """problem, idx, mass: for each problem the mixture of its normal densities (problem, loc, scale) on an even grid of n cells, scaled to sum to 1."""
    cells = fits.select("problem", "loc", "scale", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    z = (F.lit(lower) + F.lit(upper - lower) * F.col("idx") / F.lit(max(n - 1, 1)) - F.col("loc")) / F.col("scale")
    density = cells.groupBy("problem", "idx").agg(F.avg(F.exp(-z * z / 2) / (F.col("scale") * F.sqrt(2 * F.pi()))).alias("mass"))
    return normalise(density, ["problem"])


def gaussian_marginal(spark: SparkSession, n: int, locs: list[float], scales: list[float], lower: float = -5.0, upper: float = 5.0) -> DataFrame:
    """idx, mass: a mixture of normal densities on an even grid, scaled to sum to 1."""
    if len(locs) != len(scales) or not locs or min(scales) <= 0:
        raise ValueError("locs and positive scales must have one length")
    x = F.lit(lower) + F.lit(upper - lower) * F.col("id") / F.lit(max(n - 1, 1))
    density = F.lit(0.0)
    for loc, scale in zip(locs, scales, strict=True):
        z = (x - loc) / scale
        density = density + F.exp(-z * z / 2) / (scale * F.sqrt(2 * F.pi()))
    rows = spark.range(n).select(F.col("id").cast("int").alias("idx"), (density / len(locs)).alias("d"))
    total = rows.agg(F.sum("d").alias("t"))
    return rows.join(F.broadcast(total)).select("idx", (F.col("d") / F.col("t")).alias("mass"))  # one row


def row_points(spark: SparkSession, n: int, features: int, seed: int, tag: int = 0) -> DataFrame:
    """idx, x: normal points, each drawn from a seed of its own row, so the partitioning never shows."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.random.default_rng(np.random.SeedSequence([seed, tag, i])).normal(size=features).tolist() for i in b["id"].tolist()]
            yield pd.DataFrame({"idx": b["id"], "x": x})

    return spark.range(n).mapInPandas(make, "idx long, x array<double>")


def squared_distance(x: Column, y: Column) -> Column:
    """Sum of squared direct differences of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, d: a + d)


def row_shares(counts: DataFrame, count: str, parts: int) -> DataFrame:
    """counts with part, start, size and valid: each row's count cut into contiguous shares of equal size, the last ones padded."""
    size = F.ceil(F.col(count) / parts)
    shares = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("size", size).withColumn("start", F.col("part") * size)
    return shares.withColumn("valid", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col(count) - F.col("start"))))
