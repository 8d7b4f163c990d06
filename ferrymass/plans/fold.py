"""Small problems, one row each: whole solves as one expression, batched over any number of problems.

A row holds a and b (arrays of masses) and cost (array of rows). Sweeps are a
fold over a sequence; given a tolerance, once the residual meets it the state
passes through unchanged. Cells of no mass get potential -inf and plan 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrymass.functions.exprs import array_lse, array_sum, neg_inf, safe_ln, threshold


def pack(cost: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """problem, i_of, j_of, a, b, cost, back from long tables; back is the cost by columns."""

    def measure(df: DataFrame, axis: str, name: str) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(axis, "mass")))
        return df.groupBy("problem").agg(F.transform(cells, lambda x: x["mass"]).alias(name), F.transform(cells, lambda x: x[axis]).alias(f"{axis}_of"))

    def lines(by: str, along: str, name: str) -> DataFrame:
        line = cost.groupBy("problem", by).agg(F.transform(F.array_sort(F.collect_list(F.struct(along, "c"))), lambda x: x["c"]).alias("line"))
        return line.groupBy("problem").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "line"))), lambda x: x["line"]).alias(name))

    return measure(a, "i", "a").join(measure(b, "j", "b"), "problem").join(lines("i", "j", "cost"), "problem").join(lines("j", "i", "back"), "problem")


def _soft(mass: Column, lines: Column, other: Column, eps: float) -> Column:
    """eps (ln mass - lse((other - line) / eps)) for each line."""
    return F.zip_with(mass, lines, lambda p, line: F.when(p > 0, eps * (safe_ln(p) - array_lse(F.zip_with(other, line, lambda g, c: (g - c) / eps)))).otherwise(neg_inf()))


def _hard(mass: Column, lines: Column, other: Column, eps: float) -> Column:
    return F.zip_with(mass, lines, lambda p, line: threshold(F.zip_with(line, other, lambda c, g: c - g), p * eps))


def _mean_zero(state: Column, a: Column) -> Column:
    mean = array_sum(F.zip_with(a, state["f"], lambda p, f: F.when(p > 0, p * f).otherwise(F.lit(0.0)))) / array_sum(a)
    # Bound once, as lambdas would otherwise evaluate it for every cell.
    return F.element_at(F.transform(F.array(F.struct(mean.alias("m"), state.alias("s"))), lambda z: F.struct(F.transform(z["s"]["f"], lambda f: f - z["m"]).alias("f"), F.transform(z["s"]["g"], lambda g: g + z["m"]).alias("g"))), 1)


def _error(s: Column, regularizer: str, eps: float) -> Column:
    """L1 distance of the plan's row sums from a; after a sweep the columns are met."""
    mass = lambda gap: F.when(gap > neg_inf(), F.exp(gap / eps)).otherwise(F.lit(0.0)) if regularizer == "shannon" else F.greatest(gap, F.lit(0.0)) / eps
    have = F.zip_with(s["f"], F.col("cost"), lambda f, line: array_sum(F.zip_with(line, s["g"], lambda c, g: mass(f + g - c))))
    return array_sum(F.zip_with(have, F.col("a"), lambda h, p: F.abs(h - p)))


#: Sweeps of one inner fold; a problem that is done skips whole inner folds.
INNER = 1000


def solve(problems: DataFrame, eps: float, sweeps: int, regularizer: str = "shannon", state: bool = False, tolerance: float | None = None) -> DataFrame:
    """problems with f and g after so many sweeps; with state, f and g of the rows are where they start.

    With a tolerance a problem stops once its error is at most that or NaN, and
    has error and iterations too.
    """
    half = _soft if regularizer == "shannon" else _hard
    zero = lambda c: F.transform(c, lambda p: F.when(p > 0, F.lit(0.0)).otherwise(neg_inf()) if regularizer == "shannon" else F.lit(0.0))
    start = F.struct(F.col("f"), F.col("g")) if state else F.struct(zero(F.col("a")).alias("f"), zero(F.col("b")).alias("g"))

    def sweep(s: Column, _: Column) -> Column:
        rows = F.transform(F.array(half(F.col("a"), F.col("cost"), s["g"], eps)), lambda f: F.struct(f.alias("f"), half(F.col("b"), F.col("back"), f, eps).alias("g")))
        new = F.element_at(rows, 1)
        return _mean_zero(new, F.col("a")) if regularizer == "shannon" else new

    if tolerance is None:
        return problems.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, sweep)).withColumn("f", F.col("_s.f")).withColumn("g", F.col("_s.g")).drop("_s")

    def judged(s: Column, x: Column) -> Column:
        new = F.transform(F.array(sweep(s, x)), lambda n: F.struct(n["f"].alias("f"), n["g"].alias("g"), _error(n, regularizer, eps).alias("error"), (s["iterations"] + 1).alias("iterations")))
        return F.when(going(s), F.element_at(new, 1)).otherwise(s)

    # Spark orders NaN above all numbers.
    going = lambda s: (s["error"] > tolerance) & ~F.isnan(s["error"]) & (s["iterations"] < sweeps)
    start = F.struct(start["f"].alias("f"), start["g"].alias("g"), F.lit(float("inf")).alias("error"), F.lit(0).alias("iterations"))
    inner = lambda s, _: F.when(going(s), F.aggregate(F.sequence(F.lit(1), F.lit(min(sweeps, INNER))), s, judged)).otherwise(s)
    solved = problems.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(-(-sweeps // INNER))), start, inner))
    return solved.withColumns({c: F.col(f"_s.{c}") for c in ("f", "g", "error", "iterations")}).drop("_s")


def plan(solved: DataFrame, eps: float, regularizer: str = "shannon") -> DataFrame:
    """problem, i, j, c, mass of solved problems."""
    rows = solved.select("problem", "g", "j_of", F.explode(F.arrays_zip("i_of", "f", "cost")).alias("r"))
    cells = rows.select("problem", F.col("r.i_of").alias("i"), F.col("r.f").alias("f"), F.explode(F.arrays_zip(F.col("j_of").alias("j"), F.col("g").alias("g"), F.col("r.cost").alias("c"))).alias("x"))
    gap = F.col("f") + F.col("x.g") - F.col("x.c")
    mass = F.when(gap > neg_inf(), F.exp(gap / eps)).otherwise(F.lit(0.0)) if regularizer == "shannon" else F.greatest(gap, F.lit(0.0)) / eps
    return cells.select("problem", "i", F.col("x.j").alias("j"), F.col("x.c").alias("c"), mass.alias("mass"))


def potentials(solved: DataFrame) -> DataFrame:
    """problem, axis, idx, value."""
    f = solved.select("problem", F.lit(0).alias("axis"), F.explode(F.arrays_zip(F.col("i_of").alias("idx"), F.col("f").alias("value"))).alias("x"))
    g = solved.select("problem", F.lit(1).alias("axis"), F.explode(F.arrays_zip(F.col("j_of").alias("idx"), F.col("g").alias("value"))).alias("x"))
    return f.unionByName(g).select("problem", "axis", F.col("x.idx").alias("idx"), F.col("x.value").alias("value"))
