"""Seeded problems: draws of one generator in a fixed order, made on the driver as they are small, and handed to Spark as tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.plans import blocked
from ferrymass.sources.archive import array_digest

CLOUD = "problem string, idx long, {0} array<double>, mass double"
QUANTUM = "problem string, n int, m int, cost_re array<double>, cost_im array<double>, a_re array<double>, a_im array<double>, b_re array<double>, b_im array<double>"


@dataclass(frozen=True)
class Workload:
    """Tables of a problem by name, the digest of the arrays they were made of, and the generator's state after the draws."""

    tables: dict[str, DataFrame]
    digest: str
    rng_state: dict


def flow_workload(spark: SparkSession, n: int, energy: str = "entropy", seed: int = 0) -> Workload:
    """starts: a density on n even cells of the unit interval, a cosine for the entropy and a seeded one otherwise."""
    rng = np.random.default_rng(seed)
    x = (np.arange(n) + 0.5) / n
    rho = (1 + 0.2 * np.cos(np.pi * x)) / n if energy == "entropy" else rng.uniform(0.1, 1.0, n)
    if energy != "entropy":
        rho = rho / rho.sum()
    starts = spark.createDataFrame([(f"{energy}-{n}-{seed}", rho.tolist())], "problem string, rho array<double>")
    return Workload({"starts": starts}, array_digest(x[:, None], np.full(n, 1 / n), rho), rng.bit_generator.state)


def classical_workload(spark: SparkSession, n: int, m: int, features: int, seed: int = 0) -> Workload:
    """x and y: normal points with masses drawn evenly from 0.1 to 1 and scaled to sum to 1."""
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, features)), rng.normal(size=(m, features))
    a, b = rng.uniform(0.1, 1, n), rng.uniform(0.1, 1, m)
    a, b = a / a.sum(), b / b.sum()
    name = f"classical-{n}-{m}-{seed}"
    table = lambda p, w, c: spark.createDataFrame([(name, k, v, q) for k, (v, q) in enumerate(zip(p.tolist(), w.tolist(), strict=True))], CLOUD.format(c))
    return Workload({"x": table(x, a, "x"), "y": table(y, b, "y")}, array_digest(x, y, a, b), rng.bit_generator.state)


def quantum_workload(spark: SparkSession, n: int, m: int, seed: int = 0) -> Workload:
    """problems: one packed row of two density matrices and a Hermitian cost."""
    rng = np.random.default_rng(seed)

    def square(k: int) -> np.ndarray:
        return rng.normal(size=(k, k)) + 1j * rng.normal(size=(k, k))

    def density(k: int) -> np.ndarray:
        raw = square(k)
        full = raw @ raw.conj().T + 0.2 * np.eye(k)
        return full / np.trace(full)

    a, b = density(n), density(m)
    raw = square(n * m)
    cost = (raw + raw.conj().T) * 0.1
    parts = [v for t in (cost, a, b) for v in (t.real.ravel().tolist(), t.imag.ravel().tolist())]
    return Workload({"problems": spark.createDataFrame([(f"quantum-{n}-{m}-{seed}", n, m, *parts)], QUANTUM)}, array_digest(a, b, cost), rng.bit_generator.state)


def cloud_objective(x: DataFrame, y: DataFrame, potentials: DataFrame, eps: float) -> DataFrame:
    """problem, objective of clouds solved by blocked.solve_each: linear cost and entropy of each one's plan, by blocks."""
    out = None
    for (name,) in x.select("problem").distinct().toLocalIterator():
        own = lambda t: t.filter(F.col("problem") == name)  # noqa: B023, E731
        side = lambda axis, c: own(potentials).filter(F.col("axis") == axis).select("idx", F.col("value").alias(c))  # noqa: B023, E731
        found = blocked.objective(blocked.apply(own(x), own(y), side(0, "f"), side(1, "g"), eps), eps).select(F.lit(name).alias("problem"), "objective")
        out = found if out is None else out.unionByName(found)
    return out
