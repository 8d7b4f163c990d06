"""Column expressions of the numerical core. All are built-in functions and stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def safe_ln(x: Column) -> Column:
    """ln with ln 0 = -inf; Spark's own gives null."""
    return F.when(x > 0, F.ln(x)).otherwise(neg_inf())


def xlogy(x: Column, y: Column | None = None) -> Column:
    """x ln y (y is x by default) with 0 ln 0 = 0."""
    return F.when(x > 0, x * F.ln(x if y is None else y)).otherwise(F.lit(0.0))


def log_add_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == neg_inf(), top).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def array_lse(values: Column) -> Column:
    """log of the sum of exponentials of an array, one pass, shifted by the running maximum; -inf for none."""
    start = F.struct(neg_inf().alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, z: Column) -> Column:
        up = F.struct(z.alias("m"), (acc["s"] * F.exp(acc["m"] - z) + 1.0).alias("s"))
        in_place = F.struct(acc["m"].alias("m"), (acc["s"] + F.exp(z - acc["m"])).alias("s"))
        return F.when(z > acc["m"], up).when(z == neg_inf(), acc).otherwise(in_place)

    return F.aggregate(values, start, step, lambda acc: F.when(acc["s"] > 0, acc["m"] + F.ln(acc["s"])).otherwise(neg_inf()))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def threshold(values: Column, target: Column) -> Column:
    """t with sum(max(t - z, 0)) = target over the array's elements z."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def step(u: Column, z: Column) -> Column:
        t = (target + u["s"] + z) / (u["n"] + 1)
        return F.when(t >= z, F.struct((u["n"] + 1).alias("n"), (u["s"] + z).alias("s"), t.alias("t"))).otherwise(u)

    return F.aggregate(F.array_sort(values), start, step, lambda u: u["t"])


def simplex(values: Column, mass: Column) -> Column:
    """Euclidean projection of an array onto the vectors of non-negative entries that sum to mass."""
    t = threshold(F.transform(values, lambda v: -v), mass)
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(t, F.size(values)).alias("t")), lambda z: F.greatest(z["v"] + z["t"], F.lit(0.0)))


def entropy_prox(z: Column, alpha: Column, weight: Column, steps: int = 80) -> Column:
    """The root x of x + alpha ln(x / weight) = z by bisection in ln x; max(z, 0) where alpha is 0."""
    tiny = math.log(2.2250738585072014e-308)
    low = F.lit(tiny)
    high = F.greatest(F.ln(F.greatest(z, weight, F.lit(1.0))) + 1.0, F.ln(weight) + z / F.greatest(alpha, F.lit(1e-300)))
    high = F.least(high, F.lit(709.0))

    def step(b: Column, _: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2
        above = F.exp(mid) + alpha * (mid - F.ln(weight)) > z
        return F.struct(F.when(above, b["lo"]).otherwise(mid).alias("lo"), F.when(above, mid).otherwise(b["hi"]).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("lo"), high.alias("hi")), step, lambda b: F.exp((b["lo"] + b["hi"]) / 2))
    return F.when(alpha == 0, F.greatest(z, F.lit(0.0))).otherwise(root)


def entropy_value(rho: Column, volume: Column, weight: float = 1.0) -> Column:
    """A cell's share of weight * sum(rho ln rho - rho ln volume - rho)."""
    return weight * (xlogy(rho) - rho * F.ln(volume) - rho)


def entropy_gradient(rho: Column, volume: Column, weight: float = 1.0) -> Column:
    return F.lit(0.0) if weight == 0 else weight * (safe_ln(rho) - F.ln(volume))


def quadratic_value(rho: Column, target: Column, weight: float = 1.0) -> Column:
    return weight / 2 * (rho - target) * (rho - target)


def quadratic_prox(z: Column, alpha: Column, target: Column, weight: float = 1.0) -> Column:
    return F.greatest((z + alpha * weight * target) / (1 + alpha * weight), F.lit(0.0))


def potential_prox(z: Column, alpha: Column, potential: Column) -> Column:
    return F.greatest(z - alpha * potential, F.lit(0.0))


def operator_norm_squared(n: Column, m: Column) -> Column:
    """Squared norm of the map from an n by m plan and a density to row residuals and column sums."""
    return (m + n + 1 + F.sqrt((m + 1 - n) * (m + 1 - n) + 4 * n * m)) / 2


def predicted_speedup(operation: Column, total: Column, factor: Column, overhead: Column | float = 0.0) -> Column:
    """How much faster a solve of total seconds gets when operation seconds of it run factor times as fast, at some overhead; null outside the domain."""
    extra = overhead if isinstance(overhead, Column) else F.lit(float(overhead))
    fit = (operation >= 0) & (total > 0) & (factor > 0) & (extra >= 0) & (operation <= total)
    return F.when(fit, total / (total - operation + operation / factor + extra))


def finite_or_null(x: Column) -> Column:
    """NaN and the infinities as null, as strict JSON wants them."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def softmax_step(rho: Column, gradient: Column, step: float) -> Column:
    """rho exp(-step gradient) scaled to rho's mass: arrays cell by cell. Cells of no mass stay empty."""
    z = F.zip_with(rho, gradient, lambda r, g: F.when(r > 0, F.ln(r) - step * g).otherwise(neg_inf()))

    def scaled(pair: Column) -> Column:
        total = pair["m"] - array_lse(pair["z"])
        return F.element_at(F.transform(F.array(F.struct(total.alias("t"), pair["z"].alias("z"))), lambda q: F.transform(q["z"], lambda x: F.when(x > neg_inf(), F.exp(x + q["t"])).otherwise(F.lit(0.0)))), 1)

    both = F.transform(F.array(F.struct(F.ln(array_sum(rho)).alias("m"), z.alias("z"))), scaled)
    return F.element_at(both, 1)
