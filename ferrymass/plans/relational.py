"""Any number of marginals over a long cost table that is laid out once and never moves.

The cost is written once for each axis, dealt by that axis's cells, so that a task
that sums over an axis emits one row for each cell it meets. In a half sweep all
potentials go to every task by broadcast, which their count allows, the current
plan is summed by cell in one pass, and one row a cell and task shuffles. A
potential changes by eps times the log of its mass over that sum. Near a solution
the sums are near the masses, so nothing overflows; a half sweep where a sum comes
near the ends of what a double holds, as a first one at a small epsilon may, is
taken again with the maximum out first. Potentials of few rows live in the driver
between half sweeps; larger ones are written, and what they replace is deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrymass.checkpoints import has_state, load_state, persist, remove, save_state
from ferrymass.functions.exprs import neg_inf
from ferrymass.operators import measures as checks
from ferrymass.operators import projection

#: Rows of a potential that go to every task by broadcast, some 100 MB; the cost is shuffled to larger ones.
BROADCAST_ROWS = 1_000_000
#: Rows of a potential that the driver holds between half sweeps.
HELD_ROWS = 100_000
#: Cells of a part of a layout, about; lines of more cells are split.
CELLS = 1 << 18
#: Sums between these are taken as they are.
LEAST, MOST = 1e-200, 1e200


def _near(values: DataFrame, rows: int) -> DataFrame:
    """A potential with a hint to broadcast it while it is small."""
    return F.broadcast(values) if rows <= BROADCAST_ROWS else values


def _joined(cost: DataFrame, values: list[DataFrame], sizes: list[int] | None = None) -> DataFrame:
    out = cost
    for k, v in enumerate(values):
        own = v.select("problem", f"i{k}", f"v{k}")
        out = out.join(own if sizes is None else _near(own, sizes[k]), ["problem", f"i{k}"])
    return out


def log_sums(terms: DataFrame, keys: list[str], z: str, rows: int | None = None) -> DataFrame:
    """keys and lse: the log of the sum of exp(z) over the rows of each key, by two aggregations with partial sums.

    The first finds each key's maximum, the second sums what is left above it;
    a key whose terms are all -inf has -inf, one with a NaN or null has NaN. rows
    says how many keys there are at most, where that is known.
    """
    value = F.coalesce(F.col(z), F.lit(float("nan")))
    top = terms.groupBy(*keys).agg(F.max(value).alias("_m"))  # Spark orders NaN above all numbers
    met = terms.join(top if rows is None else _near(top, rows), keys)
    shifted = met.select(*keys, "_m", F.when(F.col("_m") == neg_inf(), F.lit(0.0)).otherwise(F.exp(value - F.col("_m"))).alias("_e"))
    summed = shifted.groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum("_e").alias("_s"))
    return summed.select(*keys, F.when(F.col("_m") == neg_inf(), neg_inf()).otherwise(F.col("_m") + F.ln("_s")).alias("lse"))


def lay_out(live: DataFrame, axes: int) -> list[DataFrame]:
    """The cost written once for each axis, dealt by its cells; a line of over CELLS cells by its other cells too."""
    total, out = live.count(), []
    for a in range(axes):
        longest = 1 if total <= CELLS else live.groupBy("problem", f"i{a}").count().agg(F.max("count")).first()[0]
        split = F.pmod(F.xxhash64(*[f"i{k}" for k in range(axes) if k != a]), F.lit(-(-longest // CELLS)))
        out.append(persist(live.repartition(max(1, -(-total // CELLS)), "problem", f"i{a}", split), f"cost-by-{a}"))
    return out


def half_sums(layout: DataFrame, values: list[DataFrame], sizes: list[int], a: int, eps: float, shifted: bool = False) -> DataFrame:
    """problem, ia, lse: the log of the current plan's sum over each cell of axis a; shifted takes the maximum out first."""
    total = reduce(Column.__add__, [F.col(f"v{k}") for k in range(len(values))])
    terms = _joined(layout, values, sizes).select("problem", f"i{a}", ((total - F.col("c")) / eps).alias("z"))
    if shifted:
        return log_sums(terms, ["problem", f"i{a}"], "z", sizes[a])
    return terms.groupBy("problem", f"i{a}").agg(F.sum(F.exp("z")).alias("_s")).select("problem", f"i{a}", F.when(F.col("_s") > 0, F.ln("_s")).otherwise(neg_inf()).alias("lse"))


def _kept(df: DataFrame, rows: int, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if rows <= HELD_ROWS else persist(df, name)


def _half(layout: DataFrame, values: list[DataFrame], sizes: list[int], a: int, eps: float) -> DataFrame:
    """problem, ia, mass, va, gap: the new potential of axis a, and how far the old one's sums were from the masses."""
    none = F.lit(float("nan"))
    for shifted in (False, True):
        new = values[a].select("problem", f"i{a}", "mass", f"v{a}").join(half_sums(layout, values, sizes, a, eps, shifted), ["problem", f"i{a}"], "left")
        far = F.coalesce(~F.exp("lse").between(LEAST, MOST), F.lit(False))  # a cell without a cost has none
        moved = F.col(f"v{a}") + eps * (F.ln("mass") - F.coalesce("lse", none))
        gap = F.coalesce(F.abs(F.exp("lse") - F.col("mass")), none)
        out = _kept(new.select("problem", f"i{a}", "mass", moved.alias(f"v{a}"), gap.alias("gap"), far.alias("far")), sizes[a], f"potential-{a}")
        if shifted or out.filter("far").isEmpty():
            return out.drop("far")
        remove(out)


def sinkhorn(cost: DataFrame, measures: list[DataFrame], eps: float, sweeps: int, tolerance: float | None = None, start: list[DataFrame] | None = None, save: str | None = None, every: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Potentials (problem, ik, vk, mass) for each axis, and how each problem ended: problem, iterations, error, status.

    cost has problem, i0, i1, ..., c; measures[k] has problem, ik, mass. Cells
    of no mass never join. A problem outside the domain (a cost or mass that is
    not finite, a negative mass, masses that differ) is invalid and not solved.
    With a tolerance the loop ends once the largest L1 residual of every problem
    is at most that; a residual that is no number ends its problem as a numerical
    error. start resumes from potentials: where a cell has mass, one that is not
    finite counts as zero. save is a folder where every so many sweeps write a
    generation of potentials, and from whose last one the same problem goes on.
    """
    k = len(measures)
    spark = cost.sparkSession
    state = persist(checks.problem_status(cost, measures, eps, tolerance), "problem-status")
    fit = state.filter("valid").select("problem")
    measures = [m.filter("mass > 0").join(fit, "problem", "left_semi") for a, m in enumerate(measures)]
    live = cost.join(fit, "problem", "left_semi")
    for a, m in enumerate(measures):
        live = live.join(m.select("problem", f"i{a}"), ["problem", f"i{a}"], "left_semi")
    live = persist(live, "live-cost")
    layouts = lay_out(live.select("problem", *[f"i{a}" for a in range(k)], "c"), k)
    sizes = [m.count() for m in measures]
    done, identity = 0, ""
    if save:
        marks = live.agg(F.count("*"), F.expr("bit_xor(xxhash64(*))")).first()
        identity = f"sinkhorn {k} {eps!r} {marks[0]} {marks[1]}"
        if has_state(spark, save):
            held = load_state(spark, save, identity)
            done = held.agg(F.max("sweeps")).first()[0]
            start = [held.filter(F.col("axis") == a).select("problem", F.col("cell").cast(measures[a].schema[f"i{a}"].dataType).alias(f"i{a}"), F.col("value").alias(f"v{a}")) for a in range(k)]
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    values = []
    for a, m in enumerate(measures):
        begun = m.join(start[a].select("problem", f"i{a}", f"v{a}"), ["problem", f"i{a}"], "left").withColumn(f"v{a}", finite(F.col(f"v{a}"))) if start else m.withColumn(f"v{a}", F.lit(0.0))
        values.append(_kept(begun.select("problem", f"i{a}", "mass", f"v{a}"), sizes[a], f"potential-{a}"))
    errors = None
    while done < sweeps:
        for a in range(k):
            old, values[a] = values[a], _half(layouts[a], values, sizes, a, eps)
            remove(old)
        done += 1
        parts = [v.groupBy("problem").agg(F.sum("gap").alias("e")) for v in values]
        errors = reduce(DataFrame.unionByName, parts).groupBy("problem").agg(F.max("e").alias("error"))
        if save and done % every == 0:
            whole = [v.select("problem", F.lit(a).alias("axis"), F.col(f"i{a}").cast("string").alias("cell"), F.col(f"v{a}").alias("value"), F.lit(done).alias("sweeps")) for a, v in enumerate(values)]
            save_state(reduce(DataFrame.unionByName, whole), save, identity, keep=2)
        if tolerance is not None and errors.filter((F.col("error") > tolerance) & ~F.isnan("error")).isEmpty():
            break
    remove(live, *layouts)
    ended = state.join(errors, "problem", "left") if errors is not None else state.withColumn("error", F.lit(float("inf")))
    status = F.when(~F.col("valid"), "invalid").when(F.isnan("error"), "numerical_error")
    status = status.otherwise("max_iterations") if tolerance is None else status.when(F.col("error") <= tolerance, "converged").otherwise("max_iterations")
    ended = ended.select("problem", F.when(F.col("valid"), done).otherwise(0).alias("iterations"), F.coalesce("error", F.lit(float("inf"))).alias("error"), status.alias("status"))
    return [v.drop("gap") for v in values], ended


def gauge(values: list[DataFrame]) -> list[DataFrame]:
    """All but the last axis get weighted mean zero; the last one takes what they lose."""
    moved, out = None, []
    for a, v in enumerate(values[:-1]):
        mean = v.groupBy("problem").agg((F.sum(F.col("mass") * F.col(f"v{a}")) / F.sum("mass")).alias("mean"))
        out.append(v.join(mean, "problem").withColumn(f"v{a}", F.col(f"v{a}") - F.col("mean")).drop("mean"))
        moved = mean if moved is None else moved.unionByName(mean)
    last = len(values) - 1
    total = moved.groupBy("problem").agg(F.sum("mean").alias("mean"))
    return [*out, values[-1].join(total, "problem").withColumn(f"v{last}", F.col(f"v{last}") + F.col("mean")).drop("mean")]


def plan(cost: DataFrame, values: list[DataFrame], eps: float) -> DataFrame:
    """The cost's rows on the support, with mass."""
    total = reduce(lambda x, y: x + y, [F.col(f"v{b}") for b in range(len(values))])
    return _joined(cost, values).withColumn("mass", F.exp((total - F.col("c")) / eps)).drop(*[f"v{b}" for b in range(len(values))])


def resumable(values: DataFrame, measure: DataFrame, axis: str, name: str) -> DataFrame:
    """problem, valid: whether potentials can be resumed from: finite where the measure has mass, -inf (or absent) elsewhere."""
    both = measure.join(values.select("problem", axis, name), ["problem", axis], "left")
    v: Column = F.col(name)
    on = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return both.groupBy("problem").agg(F.bool_and(F.when(F.col("mass") > 0, on).otherwise(v.isNull() | (v == neg_inf()))).alias("valid"))


#: Cells of a line that one task sorts; the levels of longer ones are found by rounds of partial sums.
LINE = 1 << 20


def _level(line: DataFrame, k: str, eps: float, longest: int) -> DataFrame:
    """problem, k, t: the least of (eps mass + sum of the n least x) / n over n."""
    if longest > LINE:
        found = projection.thresholds(line.select(F.struct("problem", k).alias("line"), "x", "mass"), "line", F.col("x"), F.col("mass") * eps)
        return found.select("line.*", "t")
    w = Window.partitionBy("problem", k).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = line.select("problem", k, ((F.col("mass") * eps + F.sum("x").over(w)) / F.count("*").over(w)).alias("t"))
    return level.groupBy("problem", k).agg(F.min("t").alias("t"))


def quadratic(cost: DataFrame, a: DataFrame, b: DataFrame, eps: float, sweeps: int, tolerance: float | None) -> tuple[DataFrame, int]:
    """Quadratic plans (problem, i, j, c, mass) of problems that no row can hold, and the sweeps done.

    The potential of a line is the least of (eps mass + sum of the k least of
    c - other) / k over k. Ends as sinkhorn does.
    """
    cost = persist(cost, "quadratic-cost")
    sides = {"i": a.select("problem", "i", "mass"), "j": b.select("problem", "j", "mass")}
    values = {k: m.select("problem", k, F.lit(0.0).alias(f"v{k}")) for k, m in sides.items()}
    longest = {k: cost.groupBy("problem", k).count().agg(F.max("count")).first()[0] or 0 for k in sides}
    plan, done = None, 0
    while done < sweeps:
        for k, other in (("i", "j"), ("j", "i")):
            line = cost.join(values[other], ["problem", other]).join(sides[k], ["problem", k]).withColumn("x", F.col("c") - F.col(f"v{other}"))
            old, values[k] = values[k], persist(_level(line, k, eps, longest[k]).withColumnRenamed("t", f"v{k}"), f"quadratic-{k}")
            if done:  # what it starts from may be a table of the caller's
                remove(old)
        done += 1
        gap = F.col("vi") + F.col("vj") - F.col("c")
        plan = cost.join(values["i"], ["problem", "i"]).join(values["j"], ["problem", "j"]).select("problem", "i", "j", "c", (F.greatest(gap, F.lit(0.0)) / eps).alias("mass"))
        if tolerance is None:
            continue
        have = plan.groupBy("problem", "i").agg(F.sum("mass").alias("have"))
        worst = have.join(sides["i"], ["problem", "i"]).groupBy("problem").agg(F.sum(F.abs(F.col("have") - F.col("mass"))).alias("e")).agg(F.max("e")).first()[0] or 0.0
        if not worst > tolerance:
            break
    return plan, done
