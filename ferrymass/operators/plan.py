"""Plans as tables (problem, i, j, ...): coupling, marginals, residual, gauge, objective, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrymass.functions.exprs import xlogy

KEYS = ["problem"]


def coupling(cost: DataFrame, f: DataFrame, g: DataFrame, eps: float, regularizer: str = "shannon") -> DataFrame:
    """problem, i, j, c, mass from potentials f (problem, i, f) and g (problem, j, g); cells off the support drop out.

    Spark broadcasts a potential table only while its own size estimate allows.
    """
    gap = F.col("f") + F.col("g") - F.col("c")
    mass = F.exp(gap / eps) if regularizer == "shannon" else F.greatest(gap, F.lit(0.0)) / eps
    return cost.join(f, ["problem", "i"]).join(g, ["problem", "j"]).select("problem", "i", "j", "c", mass.alias("mass"))


def marginal(plan: DataFrame, axis: str) -> DataFrame:
    return plan.groupBy("problem", axis).agg(F.sum("mass").alias("mass"))


def residual(plan: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """problem, error: the larger of the two L1 distances between the plan's marginals and the measures a (i, mass), b (j, mass)."""
    parts = []
    for axis, want in (("i", a), ("j", b)):
        have = marginal(plan, axis).withColumnRenamed("mass", "have")
        parts.append(want.join(have, ["problem", axis], "full").groupBy("problem").agg(F.sum(F.abs(F.coalesce("have", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0)))).alias("error")))
    return parts[0].unionByName(parts[1]).groupBy("problem").agg(F.max("error").alias("error"))


def objective(plan: DataFrame, eps: float) -> DataFrame:
    """problem, objective: sum of c p + eps p (ln p - 1), with 0 ln 0 = 0."""
    p: Column = F.col("mass")
    return plan.groupBy("problem").agg(F.sum(F.col("c") * p + eps * (xlogy(p) - p)).alias("objective"))


def gauge(f: DataFrame, g: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Potentials with the a-weighted mean of f moved to g."""
    mean = f.join(a, ["problem", "i"]).groupBy("problem").agg((F.sum(F.col("mass") * F.col("f")) / F.sum("mass")).alias("mean"))
    return (
        f.join(mean, "problem").select("problem", "i", (F.col("f") - F.col("mean")).alias("f")),
        g.join(mean, "problem").select("problem", "j", (F.col("g") + F.col("mean")).alias("g")),
    )


def apply_plan(plan: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """problem, i and the plan's row sums of each value column of values (problem, j, ...)."""
    return plan.join(values, ["problem", "j"]).groupBy("problem", "i").agg(*[F.sum(F.col("mass") * F.col(c)).alias(c) for c in columns])


def tile(plan: DataFrame, i0: int, j0: int, size: int) -> DataFrame:
    return plan.filter(F.col("i").between(i0, i0 + size - 1) & F.col("j").between(j0, j0 + size - 1))


def transpose(cost: DataFrame) -> DataFrame:
    return cost.select(*[F.col("j").alias("i") if c == "i" else F.col("i").alias("j") if c == "j" else c for c in cost.columns])
