"""solve(): one call for the four kinds of transport over packed or long tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist
from ferrymass.operators.measures import problem_status
from ferrymass.plans import fold, grouped, relational

#: Cells per problem up to which a whole quadratic solve is one expression; larger problems go by joins.
FOLD_CELLS = 1 << 16


@dataclass(frozen=True)
class SolverConfig:
    epsilon: float
    tolerance: float = 1e-8
    max_iterations: int = 50_000

    def __post_init__(self):
        for name in ("epsilon", "tolerance"):
            value = getattr(self, name)
            if not (math.isfinite(value) and value > 0):
                raise ValueError(f"{name} must be finite and positive")
        if self.max_iterations != int(self.max_iterations) or not 0 < self.max_iterations < 2**31:
            raise ValueError("max_iterations must be a positive 32-bit integer")


def _judged(plan: DataFrame, axes: list[str], marginals: list[DataFrame], tolerance: float) -> DataFrame:
    """The plan with error, the largest L1 distance of a marginal from its measure, and status."""
    plan, parts = persist(plan, "judged-plan"), None
    for axis, want in zip(axes, marginals, strict=True):
        have = plan.groupBy("problem", axis).agg(F.sum("mass").alias("have"))
        gap = F.abs(F.coalesce("have", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0)))
        part = want.select("problem", axis, "mass").join(have, ["problem", axis], "full").groupBy("problem").agg(F.sum(gap).alias("error"))
        parts = part if parts is None else parts.unionByName(part)
    errors = parts.groupBy("problem").agg(F.max("error").alias("error"))
    status = F.when(F.isnan("error") | F.col("error").isNull(), "numerical_error").when(F.col("error") <= tolerance, "converged").otherwise("max_iterations")
    return plan.join(errors, "problem").withColumn("status", status)


def _with_invalid(solved: DataFrame, cost: DataFrame, state: DataFrame) -> DataFrame:
    """The solved problems' rows and the invalid ones' with no mass."""
    lost = cost.join(state.filter("NOT valid").select("problem"), "problem", "left_semi")
    lost = lost.withColumns({"mass": F.lit(0.0), "iterations": F.lit(0), "error": F.lit(float("inf")), "status": F.lit("invalid")})
    return solved.unionByName(lost.select(*solved.columns))


def _dense(cost: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Problems of at most FOLD_CELLS cells whose cost has every pair of their cells and no other."""
    count = lambda t, name: t.groupBy("problem").agg(F.count("*").alias(name))
    met = cost.join(a.select("problem", "i"), ["problem", "i"], "left_semi").join(b.select("problem", "j"), ["problem", "j"], "left_semi")
    sizes = count(cost, "cells").join(count(met, "met"), "problem").join(count(a, "n"), "problem").join(count(b, "m"), "problem")
    return sizes.filter((F.col("cells") <= FOLD_CELLS) & (F.col("cells") == F.col("met")) & (F.col("cells") == F.col("n") * F.col("m"))).select("problem")


def _two(cost: DataFrame, a: DataFrame, b: DataFrame, config: SolverConfig, regularizer: str) -> DataFrame:
    """Small dense problems whole, one a row; the others by joins."""
    state = persist(problem_status(cost, [a, b], config.epsilon, config.tolerance), "problem-status")
    fit = state.filter("valid").select("problem")
    whole = cost
    cost, a, b = (t.join(fit, "problem", "left_semi") for t in (cost, a, b))
    small = persist(_dense(cost, a, b), "small-problems")
    rest = [t.join(small, "problem", "left_anti") for t in (cost, a, b)]
    packed = fold.pack(*[t.join(small, "problem", "left_semi") for t in (cost, a, b)])
    solved = persist(fold.solve(packed, config.epsilon, config.max_iterations, regularizer, tolerance=config.tolerance), "plan-solved")
    plan = fold.plan(solved, config.epsilon, regularizer)
    if regularizer == "shannon":  # cells of no mass have no part in a plan
        for t, axis in ((a, "i"), (b, "j")):
            plan = plan.join(t.filter("mass > 0").select("problem", axis), ["problem", axis], "left_semi")
    plan = plan.join(solved.select("problem", "iterations"), "problem")
    if not rest[0].isEmpty():
        plan = plan.unionByName(_by_joins(*rest, config, regularizer))
    return _with_invalid(_judged(plan, ["i", "j"], [a, b], config.tolerance), whole, state)


def _by_joins(cost: DataFrame, a: DataFrame, b: DataFrame, config: SolverConfig, regularizer: str) -> DataFrame:
    if regularizer == "quadratic":
        plan, done = relational.quadratic(cost, a, b, config.epsilon, config.max_iterations, config.tolerance)
        return plan.withColumn("iterations", F.lit(done))
    named = cost.withColumnsRenamed({"i": "i0", "j": "i1"})
    values, ended = relational.sinkhorn(named, [a.withColumnRenamed("i", "i0"), b.withColumnRenamed("j", "i1")], config.epsilon, config.max_iterations, config.tolerance)
    plan = relational.plan(named, values, config.epsilon).join(ended.select("problem", "iterations"), "problem")
    return plan.withColumnsRenamed({"i0": "i", "i1": "j"})


#: What the numbers of grouped's problems stand for.
STATUS = ["converged", "max_iterations", "invalid", "numerical_error", "inner_solve_failed", "line_search_failed"]


def solve(cost: DataFrame, marginals: list[DataFrame], config: SolverConfig, problem: str = "classical", regularizer: str = "shannon") -> DataFrame:
    """The coupling table, with error, iterations and status of its problem: converged, max_iterations, numerical_error or invalid.

    Classical costs are (problem, i, j, c) or, for more marginals, (problem, i0,
    i1, ..., c); quantum ones are packed rows, whose status may also be
    line_search_failed. Small problems with a cost for every pair are solved each
    to its own end; those solved by joins stop together, so their iterations are
    those of the slowest. An invalid problem, one with a cost or mass that is not
    finite, a negative mass or masses that differ, has its cost's rows with no
    mass.
    """
    kind = (problem, regularizer)
    if kind in (("quantum", "quadratic"), ("quantum", "von_neumann")):
        found = grouped.solve(cost, regularizer, config.epsilon, config.tolerance, config.max_iterations)
        return found.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS)), F.col("status") + 1))
    if problem == "classical" and regularizer in ("shannon", "quadratic") and len(marginals) == 2 and "i" in cost.columns:
        return _two(cost, *marginals, config, regularizer)
    if kind != ("classical", "shannon"):
        raise ValueError(f"unsupported combination: {kind} with {len(marginals)} marginals")
    values, ended = relational.sinkhorn(cost, marginals, config.epsilon, config.max_iterations, config.tolerance)
    ended = persist(ended, "plan-ended")
    plan = relational.plan(cost, values, config.epsilon).join(ended.filter("status <> 'invalid'").select("problem", "iterations"), "problem")
    judged = _judged(plan, [f"i{k}" for k in range(len(marginals))], [m.join(ended.filter("status <> 'invalid'"), "problem", "left_semi") for m in marginals], config.tolerance)
    return _with_invalid(judged, cost, ended.select("problem", (F.col("status") != "invalid").alias("valid")))
