"""Entropic flow steps whose transport goes by blocks: densities and potentials are tables, and no cost or plan is ever stored.

A step minimises F(rho) + T_eps(rho, previous) / (2 dt). The outer loop takes
mirror steps down the gradient F' + f / (2 dt), where f is the potential of the
inner transport, and halves a step until the dual objective falls enough. The
grid of the points is placed once; each evaluation deals the new masses to the
groups and goes on from the last potentials.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist, remove
from ferrymass.functions import exprs
from ferrymass.plans import blocked

CONVERGED, LIMIT, INVALID, FAILED, INNER, SEARCH = range(6)
#: Halvings of a step at most, and the share of the slope by which the objective must fall.
TRIALS, FALL = 30, 1e-4
TINY = float(np.finfo(float).tiny)


@dataclass(frozen=True)
class Energy:
    """A cell's value and gradient, as columns of its density and of what it needs to know of the cell."""

    value: Callable[[Column, Column], Column]
    gradient: Callable[[Column, Column], Column]


def entropy(weight: float = 1.0) -> Energy:
    return Energy(lambda rho, w: exprs.entropy_value(rho, w, weight), lambda rho, w: exprs.entropy_gradient(rho, w, weight))


def quadratic(weight: float = 1.0) -> Energy:
    return Energy(lambda rho, w: exprs.quadratic_value(rho, w, weight), lambda rho, w: weight * (rho - w))


def potential() -> Energy:
    return Energy(lambda rho, w: w * rho, lambda rho, w: w)


@dataclass
class Told:
    """How a step ended: the density (idx, rho), the outer iterations, the error, the status, the objective and the inner sweeps."""

    rho: DataFrame
    iterations: int
    error: float
    status: int
    objective: float | None = None
    sweeps: int = 0


def _evaluate(cloud: blocked.Cloud, cells: DataFrame, energy: Energy, dt: float, at: tuple[DataFrame, DataFrame], inner_tolerance: float, inner_limit: int) -> dict | None:
    """The objective, gradient and stationarity at a density (idx, w, rho), from potentials by group; None where the transport fails."""
    own = blocked.weighed(cloud, cells.select("idx", F.col("rho").alias("mass")))
    f, g, sweeps, error, status = blocked.iterate(own, *at, inner_limit, inner_tolerance)
    if status != CONVERGED:
        return None
    long = blocked._long(own.sides[0], f, "f").select("idx", "f")
    grad = energy.gradient(F.col("rho"), F.col("w")) + F.col("f") / (2 * dt)
    table = persist(cells.join(long, "idx").withColumn("grad", grad), "mirror-cells")
    sums = table.agg(F.sum(energy.value(F.col("rho"), F.col("w"))).alias("value"), F.sum(F.col("f") * F.col("rho")).alias("f"), F.sum("rho").alias("mass"), (F.sum(F.col("rho") * F.col("grad")) / F.sum("rho")).alias("mean")).first()
    facing = blocked._long(own.sides[1], g, "g").filter("mass > 0").agg(F.sum(F.col("g") * F.col("mass")).alias("g"), F.sum("mass").alias("mass")).first()
    still = table.agg(F.max(F.abs(F.col("rho") * (F.col("grad") - F.lit(sums["mean"]))))).first()[0]
    # Columns are met after a sweep, so the plan's mass is theirs.
    dual = sums["f"] + facing["g"] - cloud.eps * facing["mass"]
    return {"value": sums["value"] + dual / (2 * dt), "table": table, "still": still, "error": error, "at": (f, g), "sweeps": sweeps}


def _moved(table: DataFrame, size: float) -> DataFrame:
    """idx, w, rho after a mirror step, of the same mass and nowhere under the least normal number, and before."""
    z = F.ln("rho") - size * F.col("grad")
    top = table.agg(F.max(z), F.sum("rho")).first()
    raw = table.select("idx", "w", F.exp(z - F.lit(top[0])).alias("e"))
    total = raw.agg(F.sum("e")).first()[0]
    floored = persist(raw.select("idx", "w", F.greatest(F.lit(top[1]) * F.col("e") / F.lit(total), F.lit(TINY)).alias("rho")), "mirror-floored")
    have = floored.agg(F.sum("rho")).first()[0]
    return floored.withColumn("rho", F.col("rho") * F.lit(top[1] / have))


def entropic_step(points: DataFrame, previous: DataFrame, energy: Energy, dt: float, eps: float, tolerance: float, limit: int, inner_tolerance: float = 1e-10, inner_limit: int = 10_000, rate: float = 1.0, geometry: blocked.Geometry = blocked.squared_distances, block: int | None = None) -> Told:
    """A step from previous (idx, y, mass) over points (idx, x, w), beginning with an even density.

    Outside its domain a step is INVALID; INNER if a transport fails, SEARCH if no
    trial falls enough. The objective is the one that the search compares.
    """
    count, mass = points.count(), previous.agg(F.sum("mass")).first()[0] or 0.0
    even = points.select("idx", "w", F.lit(mass / max(count, 1)).alias("rho"))
    sources = points.select("idx", "x", F.lit(mass / max(count, 1)).alias("mass"))
    fit = all(math.isfinite(v) and v > 0 for v in (dt, tolerance, inner_tolerance, rate)) and inner_tolerance <= tolerance and min(limit, inner_limit) >= 0
    if not fit or not blocked._valid(sources, previous, eps, None):
        return Told(even.select("idx", "rho"), 0, math.inf, INVALID)
    cloud = blocked.place(sources, previous, eps, block, geometry)
    begun = tuple(blocked._by_group(side, None, "") for side in cloud.sides)
    state = _evaluate(cloud, even, energy, dt, begun, inner_tolerance, inner_limit)
    done, sweeps, size, status, error = 0, 0, rate, INNER if state is None else LIMIT, math.inf
    while state is not None:
        sweeps += state["sweeps"]
        error = max(state["still"], state["error"])
        if not math.isfinite(error):
            status = FAILED
        elif error <= tolerance:
            status = CONVERGED
        if status != LIMIT or done >= limit:
            break
        own, trial = size, None
        for _ in range(TRIALS):
            moved = _moved(state["table"], own)
            trial = _evaluate(cloud, moved, energy, dt, state["at"], inner_tolerance, inner_limit)
            if trial is None:
                break
            slope = state["table"].select("idx", "grad", F.col("rho").alias("old")).join(moved, "idx").agg(F.sum(F.col("grad") * (F.col("rho") - F.col("old")))).first()[0]
            if trial["value"] <= state["value"] + FALL * slope + 16 * np.finfo(float).eps * (1 + abs(state["value"])):
                break
            remove(trial["table"])
            own /= 2
        else:
            status = SEARCH
            break
        if trial is None:
            status = INNER
            break
        remove(state["table"])
        state, size, done = trial, own, done + 1
    remove(cloud.grid)
    if state is None:
        return Told(even.select("idx", "rho"), 0, math.inf, status)
    return Told(state["table"].select("idx", "rho"), done, error, status, state["value"], sweeps)


def flow(points: DataFrame, start: DataFrame, energy: Energy, dt: float, eps: float, steps: int, tolerance: float, limit: int, **options) -> tuple[DataFrame, list[Told]]:
    """slot, time, idx, rho of a flow from a density (idx, mass) over points (idx, x, w), and how each step ended.

    Time and density advance only where a step converged; after one that did not,
    the flow stays where it is.
    """
    current, time, told = start.select("idx", F.col("mass").alias("rho")), 0.0, []
    out = current.select(F.lit(0).alias("slot"), F.lit(0.0).alias("time"), "idx", "rho")
    for k in range(1, steps + 1):
        if not told or told[-1].status == CONVERGED:
            previous = points.select("idx", F.col("x").alias("y")).join(current.withColumnRenamed("rho", "mass"), "idx")
            told.append(entropic_step(points, previous, energy, dt, eps, tolerance, limit, **options))
            if told[-1].status == CONVERGED:
                current, time = persist(told[-1].rho, "flow-density"), time + dt
        out = out.unionByName(current.select(F.lit(k).alias("slot"), F.lit(time).alias("time"), "idx", "rho"))
    return out, told
