"""First-order flow steps as tables of cells: problems of any size, any number at once.

A step minimises dt F(rho) + <c, p> / 2 with row sums rho and column sums given,
by dual-first primal-dual iterations. The plan lies in a table of cells; densities
and multipliers are tables of rows and columns. An iteration is one pass that
writes the cells anew, where rows and columns come to the cells by broadcast as
their counts allow, and one aggregate of both sides' sums and all residuals, of
which one row a row, column and task shuffles. What an iteration replaces is
deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist, remove
from ferrymass.functions import exprs
from ferrymass.operators.measures import finite
from ferrymass.plans import relational

CONVERGED, LIMIT, INVALID, FAILED = range(4)


@dataclass(frozen=True)
class Energy:
    """A cell's value and prox, as columns of its density, and of what it needs to know of the cell: volume, target or potential."""

    value: Callable[[Column, Column], Column]
    prox: Callable[[Column, Column, Column], Column]


def entropy(weight: float = 1.0) -> Energy:
    return Energy(lambda rho, w: exprs.entropy_value(rho, w, weight), lambda z, alpha, w: exprs.entropy_prox(z, alpha * weight, w))


def quadratic(weight: float = 1.0) -> Energy:
    return Energy(lambda rho, w: exprs.quadratic_value(rho, w, weight), lambda z, alpha, w: exprs.quadratic_prox(z, alpha, w, weight))


def potential() -> Energy:
    return Energy(lambda rho, w: w * rho, lambda z, alpha, w: exprs.potential_prox(z, alpha, w))


@dataclass
class Step:
    """Where a step stands: the plan's cells, rows, columns, and a line for each problem (problem, iterations, error, status)."""

    cells: DataFrame
    rows: DataFrame
    columns: DataFrame
    told: DataFrame

    def objective(self, energy: Energy, dt: float) -> DataFrame:
        """problem, objective: dt F(rho) + <c, p> / 2."""
        parts = [self.rows.groupBy("problem").agg((dt * F.sum(energy.value(F.col("rho"), F.col("w")))).alias("part")), self.cells.groupBy("problem").agg((F.sum(F.col("c") * F.col("p")) / 2).alias("part"))]
        return parts[0].unionByName(parts[1]).groupBy("problem").agg(F.sum("part").alias("objective"))


def _sides(cost: DataFrame, density: DataFrame, previous: DataFrame, primal_step: float | None, dual_step: float | None, theta: float, dt: float) -> DataFrame:
    """problem, n, m, total, tau, sigma, valid of every problem."""
    good = lambda c: finite(F.col(c)) & (F.col(c) >= 0)
    rows = density.groupBy("problem").agg(F.count("*").alias("n"), F.bool_and(finite(F.col("w"))).alias("ok"))
    columns = previous.groupBy("problem").agg(F.count("*").alias("m"), F.sum("mass").alias("total"), F.bool_and(good("mass")).alias("mass_ok"))
    cells = cost.groupBy("problem").agg(F.count("*").alias("cells"), F.bool_and(finite(F.col("c"))).alias("cost_ok"))
    both = rows.join(columns, "problem").join(cells, "problem", "left")
    norm = F.sqrt(exprs.operator_norm_squared(F.col("n").cast("double"), F.col("m").cast("double")))
    both = both.withColumn("tau", 0.99 / norm if primal_step is None else F.lit(primal_step)).withColumn("sigma", 0.99 / norm if dual_step is None else F.lit(dual_step)).withColumn("norm", norm)
    fit = F.col("ok") & F.col("mass_ok") & F.col("cost_ok") & (F.col("cells") == F.col("n") * F.col("m")) & (F.col("total") > 0) & (F.col("tau") > 0) & (F.col("sigma") > 0)
    fit = fit & (F.col("tau") * F.col("sigma") * F.col("norm") * F.col("norm") < 1) & F.lit(0 <= theta <= 1 and dt > 0)
    return both.select("problem", "n", "m", "total", "tau", "sigma", F.coalesce(fit, F.lit(False)).alias("valid"))


def start(cost: DataFrame, density: DataFrame, previous: DataFrame, dt: float, primal_step: float | None = None, dual_step: float | None = None, theta: float = 1.0) -> Step:
    """The first state: an even density and the product plan. cost has problem, i, j, c for every pair, density problem, i, w, previous problem, j, mass."""
    facts = persist(_sides(cost, density, previous, primal_step, dual_step, theta, dt), "step-facts")
    fit = facts.filter("valid").drop("valid")
    even = F.col("total") / F.col("n")
    rows = density.join(fit, "problem").select("problem", "i", F.col("w").cast("double").alias("w"), "tau", "sigma", even.alias("rho"), even.alias("br"), F.lit(0.0).alias("y1"))
    columns = previous.join(fit, "problem").select("problem", "j", F.col("mass").cast("double").alias("mass"), "sigma", F.lit(0.0).alias("y2"))
    rows, columns = relational._kept(rows, rows.count(), "step-rows"), relational._kept(columns, columns.count(), "step-columns")
    p = F.col("rho") * F.col("mass") / F.col("total")
    cells = cost.join(fit.select("problem", "total"), "problem").join(relational._near(rows.select("problem", "i", "rho", "tau"), rows.count()), ["problem", "i"]).join(relational._near(columns.select("problem", "j", "mass"), columns.count()), ["problem", "j"])
    cells = persist(cells.select("problem", "i", "j", F.col("c").cast("double").alias("c"), "tau", p.alias("p"), p.alias("bp"), F.lit(0.0).alias("stay")), "step-cells")
    told = facts.select("problem", F.lit(0).alias("iterations"), F.lit(float("inf")).alias("error"), F.when(F.col("valid"), LIMIT).otherwise(INVALID).alias("status"))
    return Step(cells, rows, columns, relational._kept(told, told.count(), "step-told"))


def _sums(cells: DataFrame) -> DataFrame:
    """problem, i or j, and the sums of p and bp and the largest stay over it: both sides of the cells in one pass."""
    return cells.groupingSets([["problem", "i"], ["problem", "j"]], "problem", "i", "j").agg(F.grouping("i").alias("side"), F.sum("p").alias("sp"), F.sum("bp").alias("sbp"), F.max("stay").alias("stay"))


def pdhg(at: Step, energy: Energy, dt: float, iterations: int, tolerance: float | None = None, theta: float = 1.0) -> Step:
    """The state after so many iterations more. A problem whose error, the largest of all residuals, meets the tolerance stays as it is from then on."""
    cells, rows, columns, told = at.cells, at.rows, at.columns, at.told
    n, m, t = rows.count(), columns.count(), told.count()
    sums = relational._kept(_sums(cells), n + m, "step-sums")
    for _ in range(iterations):
        live = told.filter(F.col("status") == LIMIT).select("problem", F.lit(True).alias("live"))
        if live.isEmpty():
            break
        going = lambda df: df.join(F.broadcast(live) if t <= relational.BROADCAST_ROWS else live, "problem", "left").withColumn("live", F.coalesce("live", F.lit(False)))  # noqa: B023, E731
        step = lambda new, old: F.when(F.col("live"), new).otherwise(F.col(old))
        r = going(rows.join(relational._near(sums.filter("side = 0").select("problem", "i", "sbp"), n), ["problem", "i"]))
        r = r.withColumn("y1", step(F.col("y1") + F.col("sigma") * (F.col("sbp") - F.col("br")), "y1"))
        r = r.withColumn("new", step(energy.prox(F.col("rho") + F.col("tau") * F.col("y1"), F.col("tau") * dt, F.col("w")), "rho"))
        r = r.withColumn("br", step(F.col("new") + theta * (F.col("new") - F.col("rho")), "br")).drop("rho", "sbp").withColumnRenamed("new", "rho")
        c = going(columns.join(relational._near(sums.filter("side = 1").select("problem", "j", "sbp"), m), ["problem", "j"]))
        c = c.withColumn("y2", step(F.col("y2") + F.col("sigma") * (F.col("sbp") - F.col("mass")), "y2")).drop("sbp", "live")
        old = rows, columns, cells, sums
        rows, columns = relational._kept(r, n, "step-rows"), relational._kept(c, m, "step-columns")
        x = cells.join(relational._near(rows.select("problem", "i", "y1", "live"), n), ["problem", "i"]).join(relational._near(columns.select("problem", "j", "y2"), m), ["problem", "j"])
        pull = F.col("c") / 2 + F.col("y1") + F.col("y2")
        x = x.withColumn("new", step(F.greatest(F.col("p") - F.col("tau") * pull, F.lit(0.0)), "p"))
        stay = F.abs(F.col("new") - F.greatest(F.col("new") - pull, F.lit(0.0)))
        cells = persist(x.select("problem", "i", "j", "c", "tau", F.col("new").alias("p"), step(F.col("new") + theta * (F.col("new") - F.col("p")), "bp").alias("bp"), stay.alias("stay")), "step-cells")
        rows = rows.drop("live")
        sums = relational._kept(_sums(cells), n + m, "step-sums")
        still = F.abs(F.col("rho") - energy.prox(F.col("rho") + F.col("y1"), F.lit(dt), F.col("w")))
        parts = [
            rows.join(sums.filter("side = 0").select("problem", "i", "sp", "stay"), ["problem", "i"]).select("problem", F.greatest(F.abs(F.col("sp") - F.col("rho")), still, "stay").alias("e")),
            columns.join(sums.filter("side = 1").select("problem", "j", "sp"), ["problem", "j"]).select("problem", F.abs(F.col("sp") - F.col("mass")).alias("e")),
        ]
        errors = reduce(DataFrame.unionByName, parts).groupBy("problem").agg(F.max("e").alias("new"))
        on = (F.col("status") == LIMIT) & F.col("new").isNotNull()
        status = F.when(F.isnan("new") | (F.col("new") == float("inf")), FAILED)
        status = status.otherwise(LIMIT) if tolerance is None else status.when(F.col("new") <= tolerance, CONVERGED).otherwise(LIMIT)
        joined = told.join(errors, "problem", "left")
        joined = joined.select("problem", F.when(on, F.col("iterations") + 1).otherwise(F.col("iterations")).alias("iterations"), F.when(on, F.col("new")).otherwise(F.col("error")).alias("error"), F.when(on, status).otherwise(F.col("status")).alias("status"))
        before, told = told, relational._kept(joined, t, "step-told")
        remove(*old, before)
    return Step(cells, rows, columns, told)
