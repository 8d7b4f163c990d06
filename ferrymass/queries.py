"""Queries over the tables of a data folder, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist
from ferrymass.functions import exprs
from ferrymass.operators import matrices, measures, plan, projection, spectral
from ferrymass.plans import blocked, fold, grouped, relational, steps
from ferrymass.sources import archive, configs, generate, workloads
from ferrymass.streaming import flow

EPS, SWEEPS = 0.25, 15


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(x, digits: int = 6):
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def _shares(df: DataFrame, key: str, axis: str, problem=None) -> DataFrame:
    counted = df.groupBy((F.lit("all") if problem is None else F.col(problem)).alias("problem"), F.col(key).cast("int").alias(axis)).agg(F.count("*").cast("double").alias("mass"))
    return measures.normalise(counted, ["problem"])


def _demand(spark, sf, problem=None):
    return _shares(_read(spark, sf, "customer"), "c_nationkey", "i", problem)


def _supply(spark, sf):
    return _shares(_read(spark, sf, "supplier"), "s_nationkey", "j")


def _nation_cost(spark, sf, i: DataFrame, j: DataFrame) -> DataFrame:
    """Every nation with demand against every one with supply: 1 for another region, and the distance of keys."""
    n = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").alias("reg"))
    left = i.select("problem", "i").join(n.withColumnsRenamed({"k": "i", "reg": "ri"}), "i")
    right = j.select("j").distinct().join(n.withColumnsRenamed({"k": "j", "reg": "rj"}), "j")
    # Nations on either side: 25 at every scale.
    pairs = left.join(F.broadcast(right))
    return pairs.select("problem", "i", "j", (F.when(F.col("ri") != F.col("rj"), 1.0).otherwise(0.0) + F.abs(F.col("i") - F.col("j")) / 25.0).alias("c"))


def _nations(spark, sf, problem=None):
    a, b = _demand(spark, sf, problem), _supply(spark, sf)
    if problem:
        b = a.select("problem").distinct().join(F.broadcast(b.drop("problem")))
    return _nation_cost(spark, sf, a, b), a, b


def _solved(spark, sf, problem=None, sweeps=SWEEPS, regularizer="shannon", eps=EPS):
    return fold.solve(fold.pack(*_nations(spark, sf, problem)), eps, sweeps, regularizer)


_SQL_BASE = """
a AS (SELECT 'all' AS problem, c_nationkey AS i, count(*) / (sum(count(*)) OVER ())::DOUBLE AS mass FROM customer GROUP BY c_nationkey),
b AS (SELECT 'all' AS problem, s_nationkey AS j, count(*) / (sum(count(*)) OVER ())::DOUBLE AS mass FROM supplier GROUP BY s_nationkey),
cost AS (SELECT a.problem, a.i, b.j, (CASE WHEN x.n_regionkey <> y.n_regionkey THEN 1.0 ELSE 0.0 END)::DOUBLE + abs(a.i - b.j) / 25.0::DOUBLE AS c
         FROM a JOIN b USING (problem) JOIN nation x ON x.n_nationkey = a.i JOIN nation y ON y.n_nationkey = b.j)"""

_SQL_SEGMENTS = _SQL_BASE.replace("SELECT 'all' AS problem, c_nationkey AS i, count(*) / (sum(count(*)) OVER ())::DOUBLE AS mass FROM customer GROUP BY c_nationkey", "SELECT c_mktsegment AS problem, c_nationkey AS i, count(*) / (sum(count(*)) OVER (PARTITION BY c_mktsegment))::DOUBLE AS mass FROM customer GROUP BY c_mktsegment, c_nationkey").replace("SELECT 'all' AS problem, s_nationkey AS j, count(*) / (sum(count(*)) OVER ())::DOUBLE AS mass FROM supplier GROUP BY s_nationkey", "SELECT p.problem, s.j, s.mass FROM (SELECT DISTINCT c_mktsegment AS problem FROM customer) p, (SELECT s_nationkey AS j, count(*) / (sum(count(*)) OVER ())::DOUBLE AS mass FROM supplier GROUP BY s_nationkey) s")


def sweeps_sql(base: str, tail: str, eps: float = EPS, sweeps: int = SWEEPS) -> str:
    """Alternate scaling unrolled into one CTE for each half sweep; f and g are gauged at the end."""
    parts = [base.strip(), "g0 AS MATERIALIZED (SELECT problem, j, 0.0::DOUBLE AS v FROM b)"]
    for k in range(1, sweeps + 1):
        parts.append(f"f{k} AS MATERIALIZED (SELECT problem, i, {eps} * (ln(any_value(a.mass)) - ln(sum(exp((g.v - c) / {eps})))) AS v FROM cost JOIN g{k - 1} g USING (problem, j) JOIN a USING (problem, i) GROUP BY problem, i)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT problem, j, {eps} * (ln(any_value(b.mass)) - ln(sum(exp((f.v - c) / {eps})))) AS v FROM cost JOIN f{k} f USING (problem, i) JOIN b USING (problem, j) GROUP BY problem, j)")
    parts.append(f"mean AS (SELECT problem, sum(mass * v) / sum(mass) AS m FROM f{sweeps} JOIN a USING (problem, i) GROUP BY problem)")
    parts.append(f"f AS (SELECT problem, i, v - m AS v FROM f{sweeps} JOIN mean USING (problem)), g AS (SELECT problem, j, v + m AS v FROM g{sweeps} JOIN mean USING (problem))")
    parts.append(f"plan AS (SELECT problem, i, j, c, exp((f.v + g.v - c) / {eps}) AS mass FROM cost JOIN f USING (problem, i) JOIN g USING (problem, j))")
    return "WITH " + ",\n".join(parts) + "\n" + tail


def _stable_half(side: str, axis: str, other: str, potential: str, mass: str, eps: float) -> str:
    """One half sweep with the maximum taken out first."""
    z = f"(g.v - c) / {eps}"
    return f"""{side} AS MATERIALIZED (SELECT problem, {axis}, {eps} * (ln(any_value({mass}.mass)) - (any_value(top) + ln(sum(exp(z - top))))) AS v
        FROM (SELECT problem, {axis}, {z} AS z, max({z}) OVER (PARTITION BY problem, {axis}) AS top FROM cost JOIN {potential} g USING (problem, {other})) JOIN {mass} USING (problem, {axis}) GROUP BY problem, {axis})"""


def stable_sql(base: str, tail: str, eps: float, sweeps: int) -> str:
    """As sweeps_sql, for an epsilon at which plain sums of exponentials underflow; potentials are left as they are."""
    parts = [base.strip(), "g0 AS MATERIALIZED (SELECT problem, j, 0.0::DOUBLE AS v FROM b)"]
    for k in range(1, sweeps + 1):
        parts += [_stable_half(f"f{k}", "i", "j", f"g{k - 1}", "a", eps), _stable_half(f"g{k}", "j", "i", f"f{k}", "b", eps)]
    parts.append(f"plan AS (SELECT problem, i, j, c, exp((f.v + g.v - c) / {eps}) AS mass FROM cost JOIN f{sweeps} f USING (problem, i) JOIN g{sweeps} g USING (problem, j))")
    return "WITH " + ",\n".join(parts) + "\n" + tail


def hard_sql(base: str, tail: str, eps: float, sweeps: int) -> str:
    """Alternate thresholds of the quadratic regulariser: the least of (eps mass + sum of the n least of cost - other) / n over n."""
    parts = [base.strip(), "g0 AS MATERIALIZED (SELECT problem, j, 0.0::DOUBLE AS v FROM b)"]
    half = """{new} AS MATERIALIZED (SELECT problem, {k}, min(({eps} * mass + s) / n) AS v FROM (SELECT problem, {k}, mass, sum(x) OVER w AS s, row_number() OVER w AS n
        FROM (SELECT problem, {k}, {m}.mass, c - g.v AS x FROM cost JOIN {old} g USING (problem, {o}) JOIN {m} USING (problem, {k})) WINDOW w AS (PARTITION BY problem, {k} ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY problem, {k})"""
    for n in range(1, sweeps + 1):
        parts += [half.format(new=f"f{n}", k="i", o="j", m="a", old=f"g{n - 1}", eps=eps), half.format(new=f"g{n}", k="j", o="i", m="b", old=f"f{n}", eps=eps)]
    parts.append(f"plan AS (SELECT problem, i, j, c, greatest(f.v + g.v - c, 0) / {eps} AS mass FROM cost JOIN f{sweeps} f USING (problem, i) JOIN g{sweeps} g USING (problem, j))")
    return "WITH " + ",\n".join(parts) + "\n" + tail


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_PLAN_SQL = "SELECT problem, i, j, round(mass, 6) + 0.0 AS mass FROM plan"


@_query(sweeps_sql(_SQL_BASE, _PLAN_SQL))
def q_sinkhorn_plan(spark, sf):
    return fold.plan(_solved(spark, sf), EPS).select("problem", "i", "j", _r("mass").alias("mass"))


@_query(sweeps_sql(_SQL_SEGMENTS, _PLAN_SQL))
def q_sinkhorn_batch(spark, sf):
    return fold.plan(_solved(spark, sf, "c_mktsegment"), EPS).select("problem", "i", "j", _r("mass").alias("mass"))


@_query(sweeps_sql(_SQL_BASE, "SELECT problem, 0 AS axis, i AS idx, round(v, 6) + 0.0 AS value FROM f UNION ALL SELECT problem, 1, j, round(v, 6) + 0.0 FROM g"))
def q_sinkhorn_potentials(spark, sf):
    return fold.potentials(_solved(spark, sf)).select("problem", "axis", "idx", _r("value").alias("value"))


@_query(sweeps_sql(_SQL_BASE, "SELECT problem, round(greatest((SELECT sum(abs(s - mass)) FROM (SELECT i, sum(mass) AS s FROM plan GROUP BY i) JOIN a USING (i)), (SELECT sum(abs(s - mass)) FROM (SELECT j, sum(mass) AS s FROM plan GROUP BY j) JOIN b USING (j))), 6) + 0.0 AS error FROM (SELECT DISTINCT problem FROM a)", sweeps=2))
def q_sinkhorn_residual(spark, sf):
    _, a, b = _nations(spark, sf)
    return plan.residual(fold.plan(_solved(spark, sf, sweeps=2), EPS), a, b).select("problem", _r("error").alias("error"))


@_query(sweeps_sql(_SQL_BASE, f"SELECT problem, round(sum(c * mass + {EPS} * mass * (ln(mass) - 1)), 6) + 0.0 AS objective FROM plan GROUP BY problem"))
def q_sinkhorn_objective(spark, sf):
    return plan.objective(fold.plan(_solved(spark, sf), EPS), EPS).select("problem", _r("objective").alias("objective"))


@_query(sweeps_sql(_SQL_BASE, _PLAN_SQL))
def q_sinkhorn_resume(spark, sf):
    """Six sweeps, then nine from there: as fifteen at once."""
    half = _solved(spark, sf, sweeps=6)
    return fold.plan(fold.solve(half, EPS, SWEEPS - 6, state=True), EPS).select("problem", "i", "j", _r("mass").alias("mass"))


@_query(sweeps_sql(_SQL_BASE, _PLAN_SQL))
def q_relational_sinkhorn(spark, sf):
    cost, a, b = _nations(spark, sf)
    long = cost.withColumnsRenamed({"i": "i0", "j": "i1"})
    values, _ = relational.sinkhorn(long, [a.withColumnRenamed("i", "i0"), b.withColumnRenamed("j", "i1")], EPS, SWEEPS)
    return relational.plan(long, values, EPS).select("problem", F.col("i0").alias("i"), F.col("i1").alias("j"), _r("mass").alias("mass"))


@_query(stable_sql(_SQL_SEGMENTS, _PLAN_SQL, 0.01, 6))
def q_relational_small_epsilon(spark, sf):
    """Every market segment against all suppliers at an epsilon where most terms of a plain sum are zero."""
    cost, a, b = _nations(spark, sf, "c_mktsegment")
    long = cost.withColumnsRenamed({"i": "i0", "j": "i1"})
    values, _ = relational.sinkhorn(long, [a.withColumnRenamed("i", "i0"), b.withColumnRenamed("j", "i1")], 0.01, 6)
    return relational.plan(long, values, 0.01).select("problem", F.col("i0").alias("i"), F.col("i1").alias("j"), _r("mass").alias("mass"))


_THREE = [("i0", "lineitem", "l_returnflag"), ("i1", "lineitem", "l_linestatus"), ("i2", "orders", "o_orderpriority")]


def _three_sql(sweeps: int, eps: float) -> str:
    measure = "{k} AS (SELECT {c} AS {k}, ascii({c}) % 7 / 7.0::DOUBLE AS x, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM {t} GROUP BY {c})"
    parts = [measure.format(k=f"m{n}", c=c, t=t).replace(f"AS m{n},", f"AS {k},") for n, (k, t, c) in enumerate(_THREE)]
    parts.append("cost AS (SELECT i0, i1, i2, abs(m0.x - m1.x) + abs(m0.x - m2.x) + abs(m1.x - m2.x) AS c FROM m0, m1, m2)")
    parts += [f"v0_{k} AS (SELECT i{k}, 0.0::DOUBLE AS v FROM m{k})" for k in range(3)]
    last = ["v0_0", "v0_1", "v0_2"]
    for n in range(1, sweeps + 1):
        for k in range(3):
            o = [x for x in range(3) if x != k]
            parts.append(f"v{n}_{k} AS MATERIALIZED (SELECT i{k}, {eps} * (ln(any_value(p)) - ln(sum(exp((x.v + y.v - c) / {eps})))) AS v FROM cost JOIN {last[o[0]]} x USING (i{o[0]}) JOIN {last[o[1]]} y USING (i{o[1]}) JOIN m{k} USING (i{k}) GROUP BY i{k})")
            last[k] = f"v{n}_{k}"
    return "WITH " + ",\n".join(parts) + f" SELECT i0, i1, i2, round(exp((x.v + y.v + z.v - c) / {eps}), 6) + 0.0 AS mass FROM cost JOIN {last[0]} x USING (i0) JOIN {last[1]} y USING (i1) JOIN {last[2]} z USING (i2)"


@_query(_three_sql(8, 0.2))
def q_sinkhorn_three_marginal(spark, sf):
    """Return flags, line statuses and order priorities, coupled at the distance of their codes."""
    ms = [measures.normalise(_read(spark, sf, t).groupBy(F.lit("all").alias("problem"), F.col(c).alias(k)).agg(F.count("*").cast("double").alias("mass")), ["problem"]) for k, t, c in _THREE]
    x = [m.select("problem", f"i{k}", (F.ascii(f"i{k}") % 7 / 7.0).alias(f"x{k}")) for k, m in enumerate(ms)]
    # Values of three flag columns: a few rows each.
    cost = x[0].join(x[1], "problem").join(x[2], "problem").withColumn("c", F.abs(F.col("x0") - F.col("x1")) + F.abs(F.col("x0") - F.col("x2")) + F.abs(F.col("x1") - F.col("x2"))).drop("x0", "x1", "x2")
    values, _ = relational.sinkhorn(cost, ms, 0.2, 8)
    return relational.plan(cost, values, 0.2).select("i0", "i1", "i2", _r("mass").alias("mass"))


@_query(f"""WITH {_SQL_SEGMENTS}, sums AS (SELECT problem, sum(CASE WHEN problem = 'MACHINERY' THEN mass * 2 ELSE mass END) AS s, bool_or(problem = 'HOUSEHOLD' AND i = 5) AS negative FROM a GROUP BY problem)
SELECT problem, NOT (abs(s - 1) > 1e-9 OR negative OR EXISTS (SELECT 1 FROM cost c WHERE c.problem = sums.problem AND c.problem = 'BUILDING' AND c.i = 3)) AS valid FROM sums""")
def q_problem_status(spark, sf):
    """Market segments, one spoilt by a cost that is no number, one by a negative mass, one by too much mass."""
    cost, a, b = _nations(spark, sf, "c_mktsegment")
    cost = cost.withColumn("c", F.when((F.col("problem") == "BUILDING") & (F.col("i") == 3), F.lit(float("nan"))).otherwise(F.col("c")))
    a = a.withColumn("mass", F.when((F.col("problem") == "HOUSEHOLD") & (F.col("i") == 5), -F.col("mass")).when(F.col("problem") == "MACHINERY", 2 * F.col("mass")).otherwise(F.col("mass")))
    return measures.problem_status(cost, [a, b], EPS, 1e-8)


@_query(f"""WITH {_SQL_SEGMENTS} SELECT problem, CASE WHEN problem = 'BUILDING' THEN 'invalid' ELSE 'converged' END AS status, count(*) AS cells, CASE WHEN problem = 'BUILDING' THEN 0.0 ELSE 1.0 END::DOUBLE AS mass FROM cost GROUP BY problem""")
def q_solve_status(spark, sf):
    """solve() over every market segment, one of which has an infinite cost: the others go on to the tolerance."""
    from ferrymass import api

    cost, a, b = _nations(spark, sf, "c_mktsegment")
    cost = cost.withColumn("c", F.when((F.col("problem") == "BUILDING") & (F.col("i") % 2 == 1), F.lit(float("inf"))).otherwise(F.col("c")))
    out = api.solve(cost, [a, b], api.SolverConfig(1.0, 1e-6, 200))
    return out.groupBy("problem", "status").agg(F.count("*").alias("cells"), _r(F.sum("mass")).alias("mass"))


@_query(sweeps_sql(_SQL_BASE, "SELECT problem, bool_and(abs(v) < 1e300) AS valid FROM f GROUP BY problem"))
def q_resume_status(spark, sf):
    """Potentials of a solve can be resumed from."""
    solved = fold.potentials(_solved(spark, sf)).filter("axis = 0").select("problem", F.col("idx").alias("i"), F.col("value").alias("v"))
    return relational.resumable(solved, _demand(spark, sf), "i", "v")


@_query("SELECT 'all' AS problem, c_nationkey AS i, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) + 0.0 AS mass FROM customer GROUP BY c_nationkey")
def q_measure_histogram(spark, sf):
    return _demand(spark, sf).select("problem", "i", _r("mass").alias("mass"))


@_query("""WITH a AS (SELECT c_mktsegment AS problem, c_nationkey AS i, sum(c_acctbal) AS mass FROM customer GROUP BY 1, 2)
SELECT problem, 2::BIGINT AS axes, (min(mass) >= 0 AND sum(mass) > 0) AS valid FROM a GROUP BY problem""")
def q_measure_validate(spark, sf):
    """Account balances of each segment by nation, which may be negative, against the same mass spread by nation."""
    a = _read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("problem"), F.col("c_nationkey").alias("i")).agg(F.sum("c_acctbal").alias("mass"))
    return measures.check(a.select("problem", F.lit(0).alias("axis"), "mass").unionByName(a.select("problem", F.lit(1).alias("axis"), "mass")))


def _balances(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Mean balances in thousands of each nation's customers and suppliers, as positions."""
    place = lambda t, key, value, k: _read(spark, sf, t).groupBy(F.lit("all").alias("problem"), F.col(key).cast("int").alias(f"i{k}")).agg((F.avg(value) / 1e3).alias(f"x{k}"))
    return place("customer", "c_nationkey", "c_acctbal", 0), place("supplier", "s_nationkey", "s_acctbal", 1)


def _cost_sql(body: str) -> str:
    return f"""WITH x AS (SELECT c_nationkey AS i, avg(c_acctbal) / 1e3 AS x FROM customer GROUP BY 1), y AS (SELECT s_nationkey AS j, avg(s_acctbal) / 1e3 AS y FROM supplier GROUP BY 1)
SELECT 'all' AS problem, i::INT AS i0, j::INT AS i1, round({body}, 6) + 0.0 AS c FROM x, y"""


def _cost(spark, sf, kind: str) -> DataFrame:
    return generate.cost_between([*_balances(spark, sf)], kind).withColumn("c", _r("c"))


@_query(_cost_sql("(x - y) * (x - y)"))
def q_cost_euclidean(spark, sf):
    """What customers' balances in each nation are from suppliers' in each."""
    return _cost(spark, sf, "euclidean")


@_query(_cost_sql("1.0 / (abs(x - y) + 1.0)"))
def q_cost_weak_coulomb(spark, sf):
    return _cost(spark, sf, "weak-coulomb")


@_query("""WITH x AS (SELECT DISTINCT p_size AS i FROM part), y AS (SELECT DISTINCT l_quantity::INT AS j FROM lineitem)
SELECT 'all' AS problem, i::INT AS i0, j AS i1, round(CASE WHEN i = j THEN 1e6 ELSE 1.0::DOUBLE / abs(i - j) END, 6) + 0.0 AS c FROM x, y""")
def q_cost_strong_coulomb(spark, sf):
    """Sizes of parts against quantities of lines: fifty each."""
    place = lambda t, c, k: _read(spark, sf, t).select(F.lit("all").alias("problem"), F.col(c).cast("int").alias(f"i{k}"), F.col(c).cast("double").alias(f"x{k}")).distinct()
    return generate.cost_between([place("part", "p_size", 0), place("lineitem", "l_quantity", 1)], "strong-coulomb").withColumn("c", _r("c"))


@_query("""WITH r AS (SELECT c_mktsegment AS problem, n_regionkey AS i, avg(c_acctbal) / 1e3 AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT problem, a.i AS i0, b.i AS i1, c.i AS i2, round(pow(a.x - b.x, 2) + pow(a.x - c.x, 2) + pow(b.x - c.x, 2), 6) + 0.0 AS c FROM r a JOIN r b USING (problem) JOIN r c USING (problem)""")
def q_cost_three_marginal(spark, sf):
    """Three regions' balances in each market segment."""
    n = _read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("i"))
    r = _read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("problem"), "i").agg((F.avg("c_acctbal") / 1e3).alias("x"))  # nations: 25
    return generate.cost_between([r.withColumnsRenamed({"i": f"i{k}", "x": f"x{k}"}) for k in range(3)]).withColumn("c", _r("c"))


@_query("""WITH f AS (SELECT o_orderstatus AS problem, avg(o_totalprice) / 1e5 AS m, stddev_samp(o_totalprice) / 1e5 AS s FROM orders GROUP BY o_orderstatus, o_orderpriority),
d AS (SELECT problem, i::INT AS idx, avg(exp(-pow((-1 + 6 * i / 63.0::DOUBLE - m) / s, 2) / 2) / s) AS d FROM f, range(64) t(i) GROUP BY 1, 2)
SELECT problem, idx, round(d / sum(d) OVER (PARTITION BY problem), 8) + 0.0 AS mass FROM d""")
def q_gaussian_marginal(spark, sf):
    """Normal fits of the prices of each priority's orders, mixed for each status."""
    fits = _read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("problem"), "o_orderpriority").agg((F.avg("o_totalprice") / 1e5).alias("loc"), (F.stddev_samp("o_totalprice") / 1e5).alias("scale"))
    return generate.gaussian_mixtures(fits, 64, -1.0, 5.0).withColumn("mass", _r("mass", 8))


def _cloud(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


_DIST = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@_query(f"SELECT x.vec_id AS i, y.vec_id AS j, round({_DIST}, 5) + 0.0 AS c FROM embeddings x, embeddings y WHERE x.label < 5 AND y.label >= 5")
def q_pointcloud_cost(spark, sf):
    """Every vector of the lower half of labels against every one of the upper half."""
    cloud = _cloud(spark, sf)
    return blocked.tiles(cloud.filter("label < 5").select(F.col("idx").alias("i"), "x"), cloud.filter("label >= 5").select(F.col("idx").alias("j"), F.col("x").alias("y")), digits=5)


_PAIRS_BASE = f"""
e AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS p FROM embeddings),
pairs AS (SELECT DISTINCT x.label AS lx, y.label AS ly FROM e x, e y WHERE x.label < y.label),
a AS (SELECT lx || '-' || ly AS problem, vec_id AS i, p AS mass FROM pairs JOIN e ON label = lx),
b AS (SELECT lx || '-' || ly AS problem, vec_id AS j, p AS mass FROM pairs JOIN e ON label = ly),
cost AS (SELECT x.label || '-' || y.label AS problem, x.vec_id AS i, y.vec_id AS j, {_DIST} AS c FROM e x JOIN e y ON x.label < y.label)"""


@_query(sweeps_sql(_PAIRS_BASE, "SELECT problem, 0 AS axis, i AS idx, round(v, 5) + 0.0 AS value FROM f UNION ALL SELECT problem, 1, j, round(v, 5) + 0.0 FROM g", eps=0.3, sweeps=5))
def q_blocked_sinkhorn(spark, sf):
    """Every pair of labels as a problem of its own, evenly weighted."""
    e = measures.normalise(_cloud(spark, sf).withColumn("mass", F.lit(1.0)), ["label"])
    labels = e.select("label").distinct()
    pairs = labels.withColumnRenamed("label", "lx").join(F.broadcast(labels.withColumnRenamed("label", "ly")), F.col("lx") < F.col("ly"))  # ten labels
    named = pairs.select("lx", "ly", F.concat_ws("-", "lx", "ly").alias("problem"))
    x = e.join(F.broadcast(named), F.col("label") == F.col("lx")).select("problem", "idx", "x", "mass")
    y = e.join(F.broadcast(named), F.col("label") == F.col("ly")).select("problem", "idx", F.col("x").alias("y"), "mass")
    return blocked.solve_each(x, y, 0.3, 5).select("problem", "axis", "idx", _r("value", 5).alias("value"))


_HALVES_BASE = f"""
a AS (SELECT 'all' AS problem, vec_id AS i, 1.0::DOUBLE / count(*) OVER () AS mass FROM embeddings WHERE label < 5),
b AS (SELECT 'all' AS problem, vec_id AS j, 1.0::DOUBLE / count(*) OVER () AS mass FROM embeddings WHERE label >= 5),
cost AS (SELECT 'all' AS problem, x.vec_id AS i, y.vec_id AS j, {_DIST} AS c FROM embeddings x, embeddings y WHERE x.label < 5 AND y.label >= 5)"""


@_query(sweeps_sql(_HALVES_BASE, "SELECT 0 AS axis, i AS idx, round(v, 5) + 0.0 AS value FROM f UNION ALL SELECT 1, j, round(v, 5) + 0.0 FROM g", eps=0.3, sweeps=3))
def q_blocked_halves(spark, sf):
    """The lower half of labels against the upper one as a single problem, by blocks."""
    cloud = _cloud(spark, sf)
    x, y = cloud.filter("label < 5"), cloud.filter("label >= 5")
    n, m = max(x.count(), 1), max(y.count(), 1)
    f, g, *_ = blocked.solve(x.select("idx", "x", F.lit(1.0 / n).alias("mass")), y.select("idx", F.col("x").alias("y"), F.lit(1.0 / m).alias("mass")), 0.3, 3, last=False)
    return f.select(F.lit(0).alias("axis"), "idx", _r("f", 5).alias("value")).unionByName(g.select(F.lit(1).alias("axis"), "idx", _r("g", 5).alias("value")))


def _half_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The lower half's vectors and the upper half's, evenly weighted."""
    cloud = _cloud(spark, sf).withColumn("first", F.element_at("x", 1))
    x, y = cloud.filter("label < 5"), cloud.filter("label >= 5")
    n, m = max(x.count(), 1), max(y.count(), 1)
    return x.select("idx", "x", F.lit(1.0 / n).alias("mass")), y.select("idx", F.col("x").alias("y"), F.lit(1.0 / m).alias("mass"), "label", "first")


def _half_plan(spark, sf, values: list[str]) -> DataFrame:
    """Sums over each vector of the lower half's row of the plan after three sweeps, with values of the upper half's vectors."""
    a, b = _half_sides(spark, sf)
    f, g, *_ = blocked.solve(a, b.drop("label", "first"), 0.3, 3, last=False)
    return blocked.apply(a, b, f, g, 0.3, values)


@_query(sweeps_sql(_HALVES_BASE, "SELECT round(sum(mass), 6) + 0.0 AS mass, round(sum(c * mass), 6) + 0.0 AS linear, round(sum(mass * (ln(mass) - 1)), 5) + 0.0 AS entropy, round(sum(c * mass + 0.3 * mass * (ln(mass) - 1)), 6) + 0.0 AS objective FROM plan", eps=0.3, sweeps=3))
def q_cloud_objective(spark, sf):
    """What the plan between the halves costs, without a row for a pair."""
    a, b = _half_sides(spark, sf)
    found = blocked.objective_after(a, b.drop("label", "first"), 0.3, 3)
    return found.select(_r("mass").alias("mass"), _r("linear").alias("linear"), _r("entropy", 5).alias("entropy"), _r("objective").alias("objective"))


@_query(sweeps_sql(_HALVES_BASE, "SELECT i AS idx, round(1e4 * sum(mass * label), 4) + 0.0 AS label, round(1e4 * sum(mass * embedding[1]::DOUBLE), 4) + 0.0 AS first FROM plan JOIN embeddings ON vec_id = j GROUP BY i", eps=0.3, sweeps=3))
def q_cloud_apply(spark, sf):
    """The plan's products with two features of the upper half's vectors, for each vector of the lower half."""
    found = _half_plan(spark, sf, ["label", "first"])
    return found.select("idx", _r(1e4 * F.col("label"), 4).alias("label"), _r(1e4 * F.col("first"), 4).alias("first"))


@_query(f"WITH {_SQL_BASE} SELECT problem, i, j, round(c, 6) + 0.0 AS c FROM cost WHERE i BETWEEN 4 AND 11 AND j BETWEEN 8 AND 15")
def q_cost_tile(spark, sf):
    return plan.tile(_nations(spark, sf)[0], 4, 8, 8).withColumn("c", _r("c")).select("problem", "i", "j", "c")


@_query(f"WITH {_SQL_BASE} SELECT problem, i AS j, j AS i, round(c, 6) + 0.0 AS c FROM cost")
def q_cost_transpose(spark, sf):
    return plan.transpose(_nations(spark, sf)[0]).withColumn("c", _r("c")).select("problem", "i", "j", "c")


@_query(f"WITH {_SQL_BASE} SELECT problem, i, round(ln(sum(exp(-c / {EPS}))), 6) + 0.0 AS lse FROM cost GROUP BY problem, i")
def q_row_lse(spark, sf):
    cost = _nations(spark, sf)[0].withColumn("z", -F.col("c") / EPS)
    return relational.log_sums(cost, ["problem", "i"], "z").select("problem", "i", _r("lse").alias("lse"))


@_query(f"WITH {_SQL_BASE} SELECT problem, j, round(ln(sum(exp(-c / {EPS}))), 6) + 0.0 AS lse FROM cost GROUP BY problem, j")
def q_lse_partial_final(spark, sf):
    """Partial maxima and then partial shifted sums, each merged by a shuffle of one row a key and task."""
    cost = _nations(spark, sf)[0].withColumn("z", -F.col("c") / EPS)
    return relational.log_sums(cost, ["problem", "j"], "z").select("problem", "j", _r("lse").alias("lse"))


@_query(sweeps_sql(_SQL_BASE, "SELECT problem, i, round(sum(mass * (j / 25.0::DOUBLE)), 6) + 0.0 AS position, round(sum(mass * n_regionkey), 6) + 0.0 AS region FROM plan JOIN nation ON n_nationkey = j GROUP BY problem, i"))
def q_apply_transport_features(spark, sf):
    values = _read(spark, sf, "nation").select(F.lit("all").alias("problem"), F.col("n_nationkey").cast("int").alias("j"), (F.col("n_nationkey") / 25.0).alias("position"), F.col("n_regionkey").cast("double").alias("region"))
    out = plan.apply_plan(fold.plan(_solved(spark, sf), EPS), values, ["position", "region"])
    return out.select("problem", "i", _r("position").alias("position"), _r("region").alias("region"))


@_query(sweeps_sql(_SQL_BASE, "SELECT problem, i, round(sum(mass * j) / sum(mass), 5) + 0.0 AS centre FROM plan GROUP BY problem, i"))
def q_barycentric_projection(spark, sf):
    p = fold.plan(_solved(spark, sf), EPS)
    return p.groupBy("problem", "i").agg(_r(F.sum(F.col("mass") * F.col("j")) / F.sum("mass"), 5).alias("centre"))


@_query("""WITH z AS (SELECT o_orderpriority AS k, o_orderkey AS id, o_totalprice / 1e5 AS z FROM orders),
r AS (SELECT k, z, row_number() OVER w AS n, sum(z) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM z WINDOW w AS (PARTITION BY k ORDER BY z, id))
SELECT k, round(max_by((2.5 + s) / n, n), 6) + 0.0 AS t FROM r WHERE (2.5 + s) / n >= z GROUP BY k""")
def q_quadratic_threshold(spark, sf):
    found = projection.thresholds(_read(spark, sf, "orders"), "o_orderpriority", F.col("o_totalprice") / 1e5, 2.5)
    return found.select(F.col("o_orderpriority").alias("k"), _r("t").alias("t"))


@_query("""WITH v AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal / 1e4 AS v FROM supplier),
r AS (SELECT k, v, row_number() OVER w AS n, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM v WINDOW w AS (PARTITION BY k ORDER BY v DESC, id)),
t AS (SELECT k, max_by((s - 1) / n, n) AS t FROM r WHERE v > (s - 1) / n GROUP BY k)
SELECT v.id, round(greatest(v - t, 0.0) + 1e-9, 6) + 0.0 AS x FROM v JOIN t USING (k)""")
def q_simplex_projection(spark, sf):
    v = _read(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1e4).alias("v"))
    # Balances have few digits, so many results lie halfway between two roundings.
    return projection.simplex(v, "s_nationkey", "v").select("id", _r(F.col("x") + 1e-9).alias("x"))


@_query(hard_sql(_SQL_BASE, _PLAN_SQL, 0.5, 6))
def q_quadratic_plan(spark, sf):
    return fold.plan(_solved(spark, sf, sweeps=6, regularizer="quadratic", eps=0.5), 0.5, "quadratic").select("problem", "i", "j", _r("mass").alias("mass"))


@_query(hard_sql(_SQL_SEGMENTS, _PLAN_SQL, 0.5, 3))
def q_quadratic_by_joins(spark, sf):
    """Every market segment by sorted running sums, as problems too large for a row are solved."""
    found, _ = relational.quadratic(*_nations(spark, sf, "c_mktsegment"), 0.5, 3, None)
    return found.select("problem", "i", "j", _r("mass").alias("mass"))


_DENSITY = "WITH r AS (SELECT c_nationkey AS i, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM customer GROUP BY 1)"


@_query(f"{_DENSITY} SELECT round(sum(p * ln(p) - p * ln(0.04) - p), 6) + 0.0 AS entropy, round(sum(1.5 * (p - 0.04) * (p - 0.04)), 6) + 0.0 AS quadratic, round(sum(p * i), 6) + 0.0 AS potential FROM r")
def q_energies(spark, sf):
    p = F.col("mass")
    return _demand(spark, sf).agg(_r(F.sum(exprs.entropy_value(p, F.lit(0.04)))).alias("entropy"), _r(F.sum(exprs.quadratic_value(p, F.lit(0.04), 3.0))).alias("quadratic"), _r(F.sum(p * F.col("i"))).alias("potential"))


@_query(f"{_DENSITY} SELECT i, round(2 * (ln(p) - ln(0.04)), 6) + 0.0 AS entropy, round(greatest((p + 0.3 * 3 * 0.04) / (1 + 0.3 * 3), 0), 6) + 0.0 AS quadratic, round(greatest(p - 0.001 * i, 0), 6) + 0.0 AS potential FROM r")
def q_gradient_and_prox(spark, sf):
    p = F.col("mass")
    return _demand(spark, sf).select("i", _r(exprs.entropy_gradient(p, F.lit(0.04), 2.0)).alias("entropy"), _r(exprs.quadratic_prox(p, F.lit(0.3), F.lit(0.04), 3.0)).alias("quadratic"), _r(exprs.potential_prox(p, F.lit(0.001), F.col("i"))).alias("potential"))


@_query(f"{_DENSITY} SELECT i, round(p * 50 + 0.7 * ln(p * 50 / 0.04), 6) + 0.0 AS z, round(p * 50, 6) + 0.0 AS x FROM r")
def q_entropy_prox(spark, sf):
    """Of z = x + alpha ln(x / w), made from known x, the x again."""
    z = F.col("mass") * 50 + 0.7 * F.ln(F.col("mass") * 50 / 0.04)
    return _demand(spark, sf).select("i", _r(z).alias("z"), _r(exprs.entropy_prox(z, F.lit(0.7), F.lit(0.04))).alias("x"))


@_query(f"{_DENSITY} SELECT i, round(CASE WHEN p > 0.04 THEN p * ln(p) ELSE 0 END, 6) + 0.0 AS entropy, round(ln(exp(p * 9) + exp(i / 5.0::DOUBLE)), 6) + 0.0 AS either FROM r")
def q_log_terms(spark, sf):
    """x ln x with zeros, and the log of a sum of two exponentials."""
    p = F.col("mass")
    return _demand(spark, sf).select("i", _r(exprs.xlogy(F.when(p > 0.04, p).otherwise(0.0))).alias("entropy"), _r(exprs.log_add_exp(p * 9, F.col("i") / 5.0)).alias("either"))


@_query(f"{_DENSITY}, e AS (SELECT i, p * exp(-0.5 * (i / 25.0::DOUBLE)) AS e FROM r) SELECT i, round(e / sum(e) OVER (), 6) + 0.0 AS mass FROM e")
def q_mirror_step(spark, sf):
    """A mass-preserving mirror step down the gradient i / 25."""
    packed = _demand(spark, sf).groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("i", "mass"))).alias("d"))  # 25 nations
    rho, grad = F.transform("d", lambda x: x["mass"]), F.transform("d", lambda x: x["i"] / 25.0)
    done = packed.select(F.arrays_zip(F.transform("d", lambda x: x["i"]).alias("i"), exprs.softmax_step(rho, grad, 0.5).alias("mass")).alias("z"))
    return done.select(F.explode("z").alias("z")).select("z.i", _r("z.mass").alias("mass"))


@_query("""WITH x AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), y AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1)
SELECT k, n, m, round((m + n + 1 + sqrt((m + 1 - n) * (m + 1 - n) + 4.0 * n * m)) / 2.0, 6) + 0.0 AS norm2 FROM x JOIN y USING (k)""")
def q_operator_norm(spark, sf):
    """Of the map that a flow between each nation's customers and suppliers would have."""
    count = lambda t, key, name: _read(spark, sf, t).groupBy(F.col(key).alias("k")).agg(F.count("*").alias(name))
    both = count("customer", "c_nationkey", "n").join(count("supplier", "s_nationkey", "m"), "k")
    return both.withColumn("norm2", _r(exprs.operator_norm_squared(F.col("n").cast("double"), F.col("m").cast("double"))))


def _matrix(spark, sf) -> DataFrame:
    """A 25 by 25 matrix on 5 x 5 states: orders of a customer nation by the total's residue class."""
    o = _read(spark, sf, "orders")
    return o.groupBy(F.lit("all").alias("problem"), (F.col("o_custkey") % 25).alias("r"), (F.col("o_orderkey") % 25).alias("c")).agg(F.count("*").cast("double").alias("re"), F.sum((F.col("o_orderkey") % 7).cast("double")).alias("im"))


_M = "WITH m AS (SELECT 'all' AS problem, o_custkey % 25 AS r, o_orderkey % 25 AS c, count(*)::DOUBLE AS re, sum(o_orderkey % 7)::DOUBLE AS im FROM orders GROUP BY 2, 3)"


@_query(f"{_M} SELECT problem, r // 5 AS r, c // 5 AS c, sum(re) AS re, sum(im) AS im FROM m WHERE r % 5 = c % 5 GROUP BY 1, 2, 3")
def q_partial_trace_second(spark, sf):
    return matrices.partial_trace(_matrix(spark, sf), 5, "first")


@_query(f"{_M} SELECT problem, r % 5 AS r, c % 5 AS c, sum(re) AS re, sum(im) AS im FROM m WHERE r // 5 = c // 5 GROUP BY 1, 2, 3")
def q_partial_trace_first(spark, sf):
    return matrices.partial_trace(_matrix(spark, sf), 5, "second")


@_query(f"{_M} SELECT problem, r, c, sum(re) / 2 AS re, sum(im) / 2 + 0.0 AS im FROM (SELECT * FROM m UNION ALL SELECT problem, c, r, re, -im FROM m) GROUP BY 1, 2, 3")
def q_hermitian_part(spark, sf):
    return matrices.hermitian_part(_matrix(spark, sf)).withColumn("im", F.col("im") + 0.0)


@_query(f"{_M} SELECT problem, sum(re * re + im * im) AS value FROM m GROUP BY 1")
def q_hs_inner(spark, sf):
    m = _matrix(spark, sf)
    return matrices.inner(m, m)


@_query(f"{_M} SELECT x.problem, round(sum(sqrt(pow(coalesce(x.re, 0) - coalesce(y.re, 0), 2) + pow(coalesce(x.im, 0) - coalesce(y.im, 0), 2))), 4) + 0.0 AS error FROM m x FULL JOIN (SELECT problem, c AS r, r AS c, re, im FROM m) y USING (problem, r, c) GROUP BY 1")
def q_quantum_residual(spark, sf):
    m = _matrix(spark, sf)
    return matrices.entry_distance(m, m.select("problem", F.col("c").alias("r"), F.col("r").alias("c"), "re", "im")).withColumn("error", _r("error", 4))


ORACLES["q_quantum_residual"] = ORACLES["q_quantum_residual"].replace("SELECT x.problem, round", "SELECT problem, round")


@_query("""WITH u AS (SELECT o_custkey % 5 AS r, o_orderkey % 5 AS c, count(*)::DOUBLE AS re, sum(o_orderkey % 7)::DOUBLE AS im FROM orders GROUP BY 1, 2), v AS (SELECT l_suppkey % 7 AS r, l_partkey % 7 AS c, count(*)::DOUBLE AS re, sum(l_linenumber)::DOUBLE AS im FROM lineitem GROUP BY 1, 2)
SELECT 'all' AS problem, r, c, sum(re) AS re, sum(im) + 0.0 AS im FROM (SELECT r * 7 + k AS r, c * 7 + k AS c, re, im FROM u, range(7) d(k) UNION ALL SELECT k * 7 + r, k * 7 + c, re, im FROM v, range(5) d(k)) GROUP BY 2, 3""")
def q_partial_trace_adjoint(spark, sf):
    """Matrices of orders and of lines, lifted to the product of their spaces."""
    entry = lambda t, r, c, n, im: _read(spark, sf, t).groupBy(F.lit("all").alias("problem"), (F.col(r) % n).alias("r"), (F.col(c) % n).alias("c")).agg(F.count("*").cast("double").alias("re"), F.sum(im).cast("double").alias("im"))
    u, v = entry("orders", "o_custkey", "o_orderkey", 5, F.col("o_orderkey") % 7), entry("lineitem", "l_suppkey", "l_partkey", 7, F.col("l_linenumber"))
    return matrices.lift_sum(u, v, 5, 7).withColumn("im", F.col("im") + 0.0)


_REGION_BASE = """
n AS (SELECT n_nationkey, n_regionkey AS r FROM nation),
ca AS (SELECT c_mktsegment AS problem, r AS i, count(*)::DOUBLE AS k FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY 1, 2),
a AS (SELECT problem, i, k / sum(k) OVER (PARTITION BY problem) AS mass FROM ca),
sb AS (SELECT r AS j, count(*)::DOUBLE AS k FROM supplier JOIN n ON s_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT problem, j, k / (SELECT sum(k) FROM sb) AS mass FROM (SELECT DISTINCT problem FROM a) p, sb),
cost AS (SELECT problem, i, j, abs(i - j) / 5.0::DOUBLE + CASE WHEN i <> j THEN 0.3 ELSE 0.0 END::DOUBLE AS c FROM a JOIN b USING (problem))"""


def _turned(n: int, seed: int) -> np.ndarray:
    """A fixed unitary matrix."""
    rng = np.random.default_rng(seed)
    return np.linalg.qr(rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n)))[0]


def _quantum_regions(spark, sf, method: str, eps: float, tolerance: float) -> DataFrame:
    """Market segments' customers by region against suppliers by region, as density matrices in turned bases.

    Turned back, the coupling is the diagonal one of the classical problem.
    """
    n = _read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"))
    count = lambda t, key, by: t.join(F.broadcast(n), F.col(key) == F.col("n_nationkey")).withColumnsRenamed({"c_mktsegment": "problem"}).groupBy(*by, "r").agg(F.count("*").cast("double").alias("k")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "k"))).alias("d"))
    a = count(_read(spark, sf, "customer"), "c_nationkey", ["problem"])
    b = count(_read(spark, sf, "supplier"), "s_nationkey", [])
    u, v = _turned(5, 1), _turned(5, 2)
    both = np.kron(u, v)

    def packed(batches):
        for t in batches:
            rows = []
            for r in t.itertuples():
                p, q = (np.bincount([int(x["r"]) for x in d], [x["k"] for x in d], 5) for d in (r.a, r.b))
                i, j = np.divmod(np.arange(25), 5)
                c = np.diag(np.abs(i - j) / 5.0 + np.where(i != j, 0.3, 0.0))
                full = [w @ m @ w.conj().T for w, m in ((both, c), (u, np.diag(p / p.sum())), (v, np.diag(q / q.sum())))]
                rows.append((r.problem, 5, 5, *[x.ravel().tolist() for m in full for x in (m.real, m.imag)]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in workloads.QUANTUM.split(", ")])

    problems = a.withColumnRenamed("d", "a").join(F.broadcast(b.withColumnRenamed("d", "b"))).mapInPandas(packed, workloads.QUANTUM)  # b is one row

    def back(batches):
        for t in batches:
            for r in t.itertuples():
                x = both.conj().T @ (np.array(r.coupling_re) + 1j * np.array(r.coupling_im)).reshape(25, 25) @ both
                d = np.real(np.diag(x))
                yield pd.DataFrame({"problem": r.problem, "status": r.status, "i": np.repeat(np.arange(5), 5), "j": np.tile(np.arange(5), 5), "mass": d, "off": np.abs(x - np.diag(np.diag(x))).max()})

    return grouped.solve(problems, method, eps, tolerance).mapInPandas(back, "problem string, status int, i int, j int, mass double, off double")


def _region_result(found: DataFrame) -> DataFrame:
    return found.select("problem", "status", "i", "j", _r("mass", 4).alias("mass"), _r("off", 4).alias("off"))


_REGION_SQL = "SELECT problem, 0 AS status, i::INT AS i, j::INT AS j, round(mass, 4) + 0.0 AS mass, 0.0::DOUBLE AS off FROM plan"


@_query(hard_sql(_REGION_BASE, _REGION_SQL, 6.0, 20))
def q_quantum_quadratic(spark, sf):
    return _region_result(_quantum_regions(spark, sf, "quadratic", 6.0, 1e-7))


@_query(stable_sql(_REGION_BASE, _REGION_SQL, 0.3, 60))
def q_quantum_entropy(spark, sf):
    return _region_result(_quantum_regions(spark, sf, "von_neumann", 0.3, 1e-8))


@_query(f"WITH {_REGION_BASE} SELECT problem, CASE WHEN problem = 'BUILDING' THEN 2 ELSE 0 END AS status FROM a GROUP BY problem")
def q_quantum_status(spark, sf):
    """A density matrix of trace other than one, and its segment's status beside those of the others."""
    return _spoilt(spark, sf)


def _spoilt(spark, sf) -> DataFrame:
    a = _read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("problem")).agg(*[F.count_if(F.col("c_nationkey") % 2 == k).cast("double").alias(f"k{k}") for k in (0, 1)])
    total = F.when(F.col("problem") == "BUILDING", 2.0).otherwise(1.0) * (F.col("k0") + F.col("k1"))
    zeros = F.array_repeat(F.lit(0.0), 4)
    diag = lambda p, q: F.array(p, F.lit(0.0), F.lit(0.0), q)
    cost = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.when(r == c, r / 4.0).otherwise(0.0))))
    half = diag(F.lit(0.5), F.lit(0.5))
    rows = a.select("problem", F.lit(2).alias("n"), F.lit(2).alias("m"), cost.alias("cost_re"), F.array_repeat(F.lit(0.0), 16).alias("cost_im"), diag(F.col("k0") / total, F.col("k1") / total).alias("a_re"), zeros.alias("a_im"), half.alias("b_re"), zeros.alias("b_im"))
    return grouped.solve(rows, "von_neumann", 0.5, 1e-6).select("problem", "status")


_SIGNED = "SELECT o_orderpriority AS problem, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / 1e6 AS p, sum(o_totalprice) / 1e6 AS q, sum(o_totalprice * (o_orderkey % 3 - 1)) / 1e6 AS r FROM orders GROUP BY 1"


@_query(f"WITH m AS ({_SIGNED}), e AS (SELECT problem, p, q, r, (p + q) / 2 AS mid, sqrt(pow((p - q) / 2, 2) + r * r) AS rad FROM m), w AS (SELECT *, greatest(mid + rad, 0) AS hi, greatest(mid - rad, 0) AS lo FROM e) SELECT problem, round(lo + hi, 3) + 0.0 AS trace, round(sqrt(lo * lo + hi * hi), 3) + 0.0 AS size FROM w")
def q_psd_projection(spark, sf):
    """The nearest positive semidefinite matrix of a symmetric one for each priority, told by its trace and norm."""
    o = _read(spark, sf, "orders")
    price = F.col("o_totalprice")
    m = o.groupBy(F.col("o_orderpriority").alias("problem")).agg((F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(-price)) / 1e6).alias("p"), (F.sum(price) / 1e6).alias("q"), (F.sum(price * (F.col("o_orderkey") % 3 - 1)) / 1e6).alias("r"))
    packed = m.select("problem", F.lit(2).alias("n"), F.array("p", "r", "r", "q").alias("re"), F.array_repeat(F.lit(0.0), 4).alias("im"))
    near = grouped.nearest_psd(packed)
    square = F.aggregate("re", F.lit(0.0), lambda s, x: s + x * x)
    return near.select("problem", _r(F.element_at("re", 1) + F.element_at("re", 4), 3).alias("trace"), _r(F.sqrt(square), 3).alias("size"))


def _pairs_matrix(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The symmetric matrices of q_psd_projection over their priority's total price as one matrix whose rows 0 to 4 and 5 to 9 they straddle, and its size."""
    o = _read(spark, sf, "orders")
    price = F.col("o_totalprice")
    own = o.groupBy((F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("k")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(-price)).alias("p"), F.sum(price).alias("q"), F.sum(price * (F.col("o_orderkey") % 3 - 1)).alias("r"))
    place = [("k", "k", F.col("p") / F.col("q")), ("k", "l", F.col("r") / F.col("q")), ("l", "k", F.col("r") / F.col("q")), ("l", "l", F.lit(1.0) - 1.5 * (F.col("k") % 2))]
    entries = F.array(*[F.struct(F.col(r).alias("r"), F.col(c).alias("c"), v.alias("re")) for r, c, v in place])
    rows = own.withColumn("l", F.col("k") + 5).select(F.lit("all").alias("problem"), F.explode(entries).alias("e")).select("problem", "e.*", F.lit(0.0).alias("im"))
    return rows, own.agg(F.lit("all").alias("problem"), (2 * F.count("*")).alias("n"))


_PAIRS_SQL = """WITH o AS (SELECT o_orderpriority AS k, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / sum(o_totalprice) AS p, 1.0::DOUBLE - 1.5 * ((o_orderpriority[1]::INT - 1) % 2) AS q, sum(o_totalprice * (o_orderkey % 3 - 1)) / sum(o_totalprice) AS r FROM orders GROUP BY 1),
e AS (SELECT k, (p + q) / 2 + sqrt(pow((p - q) / 2, 2) + r * r) AS hi, (p + q) / 2 - sqrt(pow((p - q) / 2, 2) + r * r) AS lo FROM o)"""


@_query(f"{_PAIRS_SQL} SELECT round(sum(greatest(hi, 0) + greatest(lo, 0)), 6) + 0.0 AS trace, round(sqrt(sum(pow(greatest(hi, 0), 2) + pow(greatest(lo, 0), 2))), 6) + 0.0 AS size FROM e")
def q_psd_blocks(spark, sf):
    """The nearest positive semidefinite matrix of one in blocks of four rows, told by its trace and norm."""
    m, dims = _pairs_matrix(spark, sf)
    near = persist(spectral.nearest_psd(persist(spectral.blocks(m, 4), "pair-blocks"), dims, 4), "pair-psd")
    return spectral.trace(near, 4).join(spectral.norm(near), "problem").select(_r("trace").alias("trace"), _r("norm").alias("size"))


@_query(f"{_PAIRS_SQL} SELECT (k[1]::INT - 1)::BIGINT AS k, round((exp(hi / 0.5) + exp(lo / 0.5)) / sum(exp(hi / 0.5) + exp(lo / 0.5)) OVER (), 6) + 0.0 AS mass, round(ln(sum(exp(hi / 0.5) + exp(lo / 0.5)) OVER ()), 6) + 0.0 AS log_z FROM e")
def q_gibbs_blocks(spark, sf):
    """The Gibbs state of the same matrix: what each priority holds of its trace, and the log of the partition sum."""
    m, dims = _pairs_matrix(spark, sf)
    state, z = spectral.gibbs(persist(spectral.blocks(m, 4), "pair-blocks"), dims, 4, 0.5)
    mass = spectral.entries(state, 4).filter("r = c AND r < 10").groupBy("problem", (F.col("r") % 5).alias("k")).agg(F.sum("re").alias("mass"))
    return mass.join(z, "problem").select("k", _r("mass").alias("mass"), _r("log_z").alias("log_z"))


@_query("""SELECT o_orderpriority AS problem, o_orderpriority <> '2-HIGH' AS hermitian, o_orderpriority <> '4-NOT SPECIFIED' AS unit_trace, o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') AS positive, o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS valid FROM orders GROUP BY 1""")
def q_validate_quantum(spark, sf):
    """Overlaps of customer classes over months, a density matrix for each priority; one is skewed, one bent below zero and one doubled."""
    o = _read(spark, sf, "orders").select(F.col("o_orderpriority").alias("problem"), (F.col("o_custkey") % 25).alias("r"), F.month("o_orderdate").alias("k"))
    b = o.groupBy("problem", "r", "k").agg(F.count("*").cast("double").alias("b"))
    gram = b.join(b.withColumnsRenamed({"r": "c", "b": "b2"}), ["problem", "k"]).groupBy("problem", "r", "c").agg(F.sum(F.col("b") * F.col("b2")).alias("re"))  # 25 classes a month
    whole = gram.filter("r = c").groupBy("problem").agg(F.sum("re").alias("total"))
    rho = gram.join(whole, "problem").select("problem", "r", "c", (F.col("re") / F.col("total")).alias("re"))
    at = lambda name, r, c: (F.col("problem") == name) & (F.col("r") == r) & (F.col("c") == c)
    moved = F.when(at("2-HIGH", 3, 7), F.col("re") + 0.1).when(at("3-MEDIUM", 4, 4), F.col("re") - 0.5).when(at("3-MEDIUM", 5, 5), F.col("re") + 0.5).when(F.col("problem") == "4-NOT SPECIFIED", 2 * F.col("re")).otherwise(F.col("re"))
    dims = rho.groupBy("problem").agg((F.max("r") + 1).cast("int").alias("n"))
    return spectral.validate(rho.select("problem", "r", "c", moved.alias("re"), F.lit(0.0).alias("im")), dims, size=8)


def _starts(spark, sf) -> DataFrame:
    """An hour-of-day density of 8 cells for each event type, at time 0."""
    e = _read(spark, sf, "events").groupBy("event_type", F.floor(F.hour("ts") / 3).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    rows = e.groupBy(F.col("event_type").alias("problem")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sum("n").alias("t"))
    return flow.initialize(rows.select("problem", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)) / F.col("t")).alias("rho")))


_CELLS = """c AS (SELECT event_type AS problem, cell, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type)::DOUBLE AS p
FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT range AS cell FROM range(8)) LEFT JOIN (SELECT event_type, hour(ts) // 3 AS cell, count(*) AS n FROM events GROUP BY 1, 2) USING (event_type, cell))"""


def _flow_result(found: DataFrame) -> DataFrame:
    return found.select("problem", "slot", _r("time", 4).alias("time"), "status", F.posexplode("rho").alias("cell", "mass")).withColumn("mass", _r("mass", 3))


def _flow_sql(steps: list[str], dt: float) -> str:
    parts, slots = [_CELLS, "s0 AS (SELECT problem, cell, p FROM c)"], len(steps)
    parts += [f"s{k + 1} AS ({body.format(old=f's{k}')})" for k, body in enumerate(steps)]
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT problem, {k} AS slot, round(({k} * {dt})::DOUBLE, 4) + 0.0 AS time, 0 AS status, cell::INT AS cell, round(p, 3) + 0.0 AS mass FROM s{k}" for k in range(slots + 1))


#: Each cell's mass moves to where the potential's share of the step and half the squared distance are least.
_DOWNHILL = """SELECT g.problem, g.cell, coalesce(sum(m.p), 0) AS p FROM {old} g LEFT JOIN (
    SELECT x.problem, x.p, arg_min(y.cell, 0.25 * (y.cell + 0.5) / 8 + pow((x.cell - y.cell) / 8.0, 2) / 2) AS t FROM {old} x JOIN {old} y USING (problem) GROUP BY x.problem, x.cell, x.p
) m ON m.problem = g.problem AND m.t = g.cell GROUP BY 1, 2"""


@_query(_flow_sql([_DOWNHILL, _DOWNHILL], 0.25))
def q_pdhg_flow(spark, sf):
    """Two steps down a linear potential, by the first-order method."""
    return _flow_result(flow.run_chunk(_starts(spark, sf), "potential", 0.25, 2, 1e-7, 200_000))


@_query(f"""WITH {_CELLS}, best AS (SELECT x.problem, x.cell, x.p, min(0.25 * (y.cell + 0.5) / 8 + pow((x.cell - y.cell) / 8.0, 2) / 2) AS least FROM c x JOIN c y USING (problem) GROUP BY 1, 2, 3)
SELECT problem, 0 AS status, round(sum(p * least), 5) + 0.0 AS objective FROM best GROUP BY problem""")
def q_flow_objective(spark, sf):
    """What the first step of the flow minimises, at its end."""
    found = flow.run_chunk(_starts(spark, sf), "potential", 0.25, 1, 1e-7, 200_000).filter("slot = 1")
    return found.select("problem", "status", _r("objective", 5).alias("objective"))


@_query(_flow_sql([_DOWNHILL, _DOWNHILL], 0.25))
def q_pdhg_flow_resumed(spark, sf):
    """The same two steps, the second from where the first was written."""
    first = persist(flow.run_chunk(_starts(spark, sf), "potential", 0.25, 1, 1e-7, 200_000), "flow-first")
    second = flow.run_chunk(flow.resume(first), "potential", 0.25, 1, 1e-7, 200_000).filter("slot = 1").withColumn("slot", F.lit(2))
    return _flow_result(first.unionByName(second))


#: Each cell's mass is dealt by a softmax of the same two terms.
_SOFT = """SELECT problem, cell, sum(p) AS p FROM (
    SELECT x.problem, y.cell, x.p * exp(-(pow((x.cell - y.cell) / 8.0, 2) + 2 * 0.1 * (y.cell + 0.5) / 8) / 0.1) / sum(exp(-(pow((x.cell - y.cell) / 8.0, 2) + 2 * 0.1 * (y.cell + 0.5) / 8) / 0.1)) OVER (PARTITION BY x.problem, x.cell) AS p
    FROM {old} x JOIN {old} y USING (problem)) GROUP BY 1, 2"""


@_query(_flow_sql([_SOFT, _SOFT], 0.1))
def q_entropic_flow(spark, sf):
    """Two steps down a linear potential with an entropic transport term."""
    return _flow_result(flow.run_chunk(_starts(spark, sf), "potential", 0.1, 2, 1e-6, 5000, "sinkhorn", 0.1))


@_query(f"""WITH {_CELLS} SELECT problem, CASE WHEN problem = 'error' THEN 2 ELSE 0 END AS status, count(*) AS slots FROM (SELECT DISTINCT problem FROM c), range(2) GROUP BY 1""")
def q_flow_status(spark, sf):
    """A density with a negative cell is invalid and stays where it is; the others go on."""
    bad = F.when(F.col("problem") == "error", F.transform("rho", lambda x: x - 0.2)).otherwise(F.col("rho"))
    found = flow.run_chunk(flow.initialize(_starts(spark, sf).select("problem", bad.alias("rho"))), "potential", 0.25, 1, 1e-6, 100_000)
    return found.groupBy("problem").agg(F.max("status").alias("status"), F.count("*").alias("slots"))


_STEP_DT, _STEP_WEIGHT, _STEPS = 0.2, 2.0, 5


def _steps_sql() -> str:
    """Primal-dual iterations of every event type's hours towards those of all events, unrolled."""
    norm = "(((SELECT count(*) FROM w) + (SELECT count(*) FROM hours) + 1 + sqrt(1 + 4.0 * (SELECT count(*) FROM w) * (SELECT count(*) FROM hours))) / 2.0)"
    parts = [
        "hours AS (SELECT DISTINCT hour(ts) AS i FROM events)",
        "w AS (SELECT hour(ts) AS i, count(*) / (sum(count(*)) OVER ())::DOUBLE AS w FROM events GROUP BY 1)",
        "b AS (SELECT event_type AS problem, h.i AS j, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type)::DOUBLE AS mass FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN hours h LEFT JOIN (SELECT event_type, hour(ts) AS i, count(*) AS n FROM events GROUP BY 1, 2) USING (event_type, i))",
        f"s AS (SELECT 0.99 / sqrt({norm}) AS t)",
        "r0 AS (SELECT problem, w.i, w, 1.0::DOUBLE / (SELECT count(*) FROM hours) AS rho, 1.0::DOUBLE / (SELECT count(*) FROM hours) AS br, 0.0::DOUBLE AS y FROM w, (SELECT DISTINCT problem FROM b))",
        "c0 AS (SELECT problem, j, mass, 0.0::DOUBLE AS y FROM b)",
        "p0 AS (SELECT problem, i, j, pow((i - j) / 24.0::DOUBLE, 2) AS c, rho * mass AS p, rho * mass AS bp FROM r0 JOIN b USING (problem))",
    ]
    for k in range(_STEPS):
        parts += [
            f"y{k + 1} AS MATERIALIZED (SELECT problem, i, w, rho AS old, y + t * (sb - br) AS y FROM r{k} JOIN (SELECT problem, i, sum(bp) AS sb FROM p{k} GROUP BY 1, 2) USING (problem, i), s)",
            f"r{k + 1} AS MATERIALIZED (SELECT problem, i, w, rho, 2 * rho - old AS br, y FROM (SELECT *, greatest((old + t * y + t * {_STEP_DT * _STEP_WEIGHT} * w) / (1 + t * {_STEP_DT * _STEP_WEIGHT}), 0) AS rho FROM y{k + 1}, s))",
            f"c{k + 1} AS MATERIALIZED (SELECT problem, j, mass, y + t * (sb - mass) AS y FROM c{k} JOIN (SELECT problem, j, sum(bp) AS sb FROM p{k} GROUP BY 1, 2) USING (problem, j), s)",
            f"p{k + 1} AS MATERIALIZED (SELECT problem, i, j, c, p, 2 * p - old AS bp FROM (SELECT x.problem, x.i, x.j, c, x.p AS old, greatest(x.p - t * (c / 2 + r.y + q.y), 0) AS p FROM p{k} x JOIN r{k + 1} r USING (problem, i) JOIN c{k + 1} q USING (problem, j), s))",
        ]
    parts.append(f"o AS (SELECT problem, {_STEP_DT} * any_value(f) + any_value(t) / 2 AS objective FROM (SELECT problem, sum({_STEP_WEIGHT} / 2 * (rho - w) * (rho - w)) AS f FROM r{_STEPS} GROUP BY 1) JOIN (SELECT problem, sum(c * p) AS t FROM p{_STEPS} GROUP BY 1) USING (problem) GROUP BY problem)")
    return "WITH " + ",\n".join(parts) + f" SELECT problem, i::INT AS i, round(rho, 7) + 0.0 AS rho, round(objective, 7) + 0.0 AS objective FROM r{_STEPS} JOIN o USING (problem)"


@_query(_steps_sql())
def q_step_tables(spark, sf):
    """First-order iterations of a step towards all events' hours, a quadratic energy, with the plan as a table of cells."""
    e = _read(spark, sf, "events").select("event_type", F.hour("ts").alias("h"))
    hours = e.groupBy(F.col("h").alias("i")).agg(F.count("*").alias("w"))
    w = measures.normalise(hours.withColumnsRenamed({"w": "mass"}).withColumn("all", F.lit(1)), ["all"]).select("i", F.col("mass").alias("w"))
    types = e.select(F.col("event_type").alias("problem")).distinct()
    density = types.join(F.broadcast(w))  # hours of a day: 24
    own = e.groupBy(F.col("event_type").alias("problem"), F.col("h").alias("j")).agg(F.count("*").cast("double").alias("mass"))
    grid = density.select("problem", F.col("i").alias("j"))
    previous = measures.normalise(grid.join(own, ["problem", "j"], "left").fillna(0.0, ["mass"]), ["problem"])
    cost = density.select("problem", "i").join(grid, "problem").withColumn("c", F.pow((F.col("i") - F.col("j")) / 24.0, 2))
    begun = steps.start(cost, density, previous, _STEP_DT)
    done = steps.pdhg(begun, steps.quadratic(_STEP_WEIGHT), _STEP_DT, _STEPS)
    both = done.rows.join(done.objective(steps.quadratic(_STEP_WEIGHT), _STEP_DT), "problem")
    return both.select("problem", "i", _r("rho", 7).alias("rho"), _r("objective", 7).alias("objective"))


@_query("""WITH c AS (SELECT p_partkey, p_size - 2 AS n, CASE WHEN p_partkey % 5 = 0 THEN p_size - 1 ELSE p_size - 2 END AS m, ['flow', 'classical', 'quantum', 'other'][p_partkey % 4 + 1] AS kind FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'json' WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN kind = 'other' THEN 'kind' WHEN n < 1 THEN 'n' WHEN m < 1 THEN 'm' WHEN p_partkey % 11 = 0 THEN 'tolerance'
    WHEN kind = 'quantum' THEN 'backend' WHEN kind = 'flow' AND n <> m THEN 'm' END AS fault, kind AS wanted FROM c""")
def q_config_faults(spark, sf):
    """Configurations made of parts, of which some are no JSON, have a field that isn't known, or one that can't be."""
    k = F.col("p_partkey")
    n, m = F.col("p_size") - 2, F.when(k % 5 == 0, F.col("p_size") - 1).otherwise(F.col("p_size") - 2)
    kind = F.element_at(F.array(*map(F.lit, ["flow", "classical", "quantum", "other"])), (k % 4 + 1).cast("int"))
    more = F.concat(F.when(k % 7 == 0, ', "extra": 1').otherwise(""), F.when(k % 11 == 0, ', "tolerance": "0.1"').otherwise(""), F.when(k % 13 == 0, "").otherwise("}"))
    line = F.concat(F.lit('{"name": "part-'), k, F.lit('", "kind": "'), kind, F.lit('", "n": '), n, F.lit(', "m": '), m, more)
    made = _read(spark, sf, "part").select("p_partkey", kind.alias("wanted"), line.alias("value"))
    found = configs.read_configs(made).select("line", "fault")
    return made.join(found, made["value"] == found["line"]).select("p_partkey", "fault", "wanted")


@_query("SELECT event_type, round(median(value), 4) + 0.0 AS median, round(min(value), 4) + 0.0 AS least, round(max(value), 4) + 0.0 AS most, min(value) > 0 AS valid FROM events GROUP BY 1")
def q_sample_summary(spark, sf):
    out = archive.sample_summary(_read(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", _r("median", 4).alias("median"), _r("least", 4).alias("least"), _r("most", 4).alias("most"), "valid")


@_query("SELECT count(*) FILTER (event_type <> 'error' AND user_id % 2 = 0) AS completed, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error' AND user_id % 2 = 0) / 12.5, 6) + 0.0 AS runs_per_second FROM events")
def q_batch_counts(spark, sf):
    runs = _read(spark, sf, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("user_id") % 2 == 0, "completed").otherwise("running").alias("status"))
    return archive.batch_counts(runs, 12.5).withColumn("runs_per_second", _r("runs_per_second"))


@_query("SELECT event_id, round(value, 4) + 0.0 AS seconds FROM events WHERE event_type <> 'error' AND value > 0 AND value / 1000 <= 0.2")
def q_comparable_timings(spark, sf):
    """Timings of runs that converged within their tolerance; the others are left out of comparisons."""
    records = _read(spark, sf, "events").select("event_id", (F.col("event_type") != "error").alias("converged"), (F.col("value") / 1000).alias("error"), F.lit(0.2).alias("tolerance"), F.col("value").alias("seconds"))
    return archive.comparable(records).select("event_id", _r("seconds", 4).alias("seconds"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(10 / (10 - (o_orderkey % 11) + (o_orderkey % 11) / 4.0 + 0.5), 6) END::DOUBLE AS gain FROM orders WHERE o_orderkey % 11 <= 10")
def q_predicted_speedup(spark, sf):
    """What running a part of ten seconds four times as fast would gain; an infinite part, which has no answer, gives null."""
    part = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("inf"))).otherwise((F.col("o_orderkey") % 11).cast("double"))
    gain = exprs.predicted_speedup(exprs.finite_or_null(part), F.lit(10.0), F.lit(4.0), 0.5)
    return _read(spark, sf, "orders").select("o_orderkey", F.round(gain, 6).alias("gain"))


@_query("SELECT event_type AS phase, round(sum(value), 4) + 0.0 AS seconds, (count(*) = 100 AND count(DISTINCT event_id % 1000) = 100) AS complete FROM events GROUP BY 1")
def q_timing_summary(spark, sf):
    e = _read(spark, sf, "events").select((F.col("event_id") % 1000).alias("chunk"), F.col("event_type").alias("phase"), F.col("value").alias("seconds"))
    return archive.timing_summary(e, 100).withColumn("seconds", _r("seconds", 4))


@_query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, (n + 7) // 8 AS size FROM n)
SELECT event_type, n, p::INT AS part, p * size AS start, size, greatest(0, least(size, n - p * size)) AS valid FROM s, range(8) t(p)""")
def q_row_partition(spark, sf):
    """Eight contiguous shares of each type's events."""
    counts = _read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return generate.row_shares(counts, "n", 8).select("event_type", "n", "part", "start", "size", "valid")
