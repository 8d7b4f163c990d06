"""Solvers beyond their queries: blocks against whole problems, resumed and invalid steps, flows as streams, groups of one key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrymass import checkpoints
from ferrymass.operators import measures, projection
from ferrymass.plans import blocked, grouped, relational
from ferrymass.streaming import flow


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    made = []
    for name, n in (("x", 70), ("y", 45)):
        mass = rng.uniform(0.1, 1, n)
        mass[3] = 0.0
        mass /= mass.sum()
        rows = [("p", k, rng.normal(size=3).tolist(), float(q)) for k, q in enumerate(mass)]
        made.append(spark.createDataFrame(rows, f"problem string, idx long, {name} array<double>, mass double").cache())
    return made


def _values(df):
    return {(r["axis"], r["idx"]): r["value"] for r in df.collect()}


def test_blocks_give_what_a_whole_problem_gives(clouds, monkeypatch):
    x, y = clouds
    whole = blocked.solve_each(x, y, 0.5, 4).cache()
    assert whole.count() == 115 and {r["status"] for r in whole.collect()} == {1}
    monkeypatch.setattr(blocked, "WHOLE", 10)
    for numbers in (8_000_000, 0):
        monkeypatch.setattr(blocked, "BROADCAST", numbers)
        f, g, done, error, status = blocked.solve(x.drop("problem"), y.drop("problem"), 0.5, 4, block=16)
        assert status == blocked.LIMIT
        parts = {(0, r["idx"]): r["f"] for r in f.collect()} | {(1, r["idx"]): r["g"] for r in g.collect()}
        want = _values(whole)
        assert done == 4 and parts.keys() == want.keys()
        assert all(parts[k] == want[k] or abs(parts[k] - want[k]) < 1e-9 for k in want)
        assert error == pytest.approx(whole.first()["error"], abs=1e-9)
    large = blocked.solve_each(x, y, 0.5, 4)
    assert all(v == want[k] or abs(v - want[k]) < 1e-9 for k, v in _values(large).items())


@pytest.mark.parametrize("spoil", ["mass", "negative", "nan", "point", "ragged", "good"])
def test_small_and_large_clouds_end_alike(clouds, monkeypatch, spoil):
    x, y = clouds
    change = {"mass": F.col("mass") * 3, "negative": F.when(F.col("idx") == 5, -F.col("mass")).otherwise(F.col("mass")), "nan": F.when(F.col("idx") == 5, float("nan")).otherwise(F.col("mass"))}
    bent = {"point": F.array(F.lit(0.0), F.lit(float("inf")), F.lit(1.0)), "ragged": F.array(F.lit(0.0))}
    x = x.withColumn("mass", change.get(spoil, F.col("mass"))).withColumn("x", F.when(F.col("idx") == 2, bent.get(spoil, F.col("x"))).otherwise(F.col("x")))
    told = []
    for cells in (1 << 22, 10):
        monkeypatch.setattr(blocked, "WHOLE", cells)
        out = blocked.solve_each(x, y, 0.5, 3, 1e-12).collect()
        assert len(out) == 115
        told.append({(r["status"], r["iterations"], r["value"] is None, round(r["error"], 9)) for r in out})
    assert told[0] == told[1] and {t[0] for t in told[0]} == {1 if spoil == "good" else 2}


def test_clouds_go_on_from_potentials_and_from_a_folder(clouds, tmp_path):
    x, y = (t.drop("problem") for t in clouds)
    whole = blocked.solve(x, y, 0.5, 7, block=20)
    first = blocked.solve(x, y, 0.5, 3, block=20)
    again = blocked.solve(x, y, 0.5, 4, block=20, start=first[:2])
    saved = str(tmp_path / "state")
    blocked.solve(x, y, 0.5, 5, block=20, save=saved, every=2)  # ends as a driver that was killed after five sweeps would
    resumed = blocked.solve(x, y, 0.5, 7, block=20, save=saved, every=2)
    assert resumed[2] == 7 and again[2] == 4
    want = [{r[0]: r[2] for r in t.collect()} for t in whole[:2]]
    for other in (again, resumed):
        for side, t in zip(want, other[:2], strict=True):
            assert all(r[2] == side[r[0]] or abs(r[2] - side[r[0]]) < 1e-9 for r in t.collect())
    with pytest.raises(ValueError, match="another problem"):
        blocked.solve(x, y, 0.6, 7, block=20, save=saved)


def test_a_geometry_of_the_callers_own(clouds):
    x, y = (t.drop("problem") for t in clouds)
    far = lambda p, q: np.abs(p[:, None] - q[None]).sum(2)
    f, g, *_ = blocked.solve(x, y, 0.7, 6, block=20, geometry=far)
    rows = [{r[0]: r for r in t.collect()} for t in (x, y)]
    cost = far(np.array([rows[0][k]["x"] for k in sorted(rows[0])]), np.array([rows[1][k]["y"] for k in sorted(rows[1])]))
    got = grouped.shannon(cost, *(np.array([r[k]["mass"] for k in sorted(r)]) for r in rows), 0.7, 1e-300, 6)
    assert all(r["f"] == got["f"][r["idx"]] or abs(r["f"] - got["f"][r["idx"]]) < 1e-9 for r in f.collect())


def test_cloud_sums_are_those_of_the_plan(clouds):
    x, y = (t.drop("problem") for t in clouds)
    y = y.withColumn("height", F.element_at("y", 1)).withColumn("one", F.lit(2.0))
    f, g, *_ = blocked.solve(x, y, 0.5, 3, block=20)
    rows = {r["idx"]: r for r in blocked.apply(x, y, f, g, 0.5, ["height", "one"], block=20).collect()}
    px, py, vf, vg = ({r["idx"]: np.array(r[c]) for r in t.collect()} for t, c in ((x, "x"), (y, "y"), (f, "f"), (g, "g")))
    i, j = sorted(px), sorted(py)
    cost = blocked.squared_distances(np.array([px[k] for k in i]), np.array([py[k] for k in j]))
    p = np.exp((np.array([vf[k] for k in i])[:, None] + np.array([vg[k] for k in j])[None] - cost) / 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(p > 0, p * (np.log(p) - 1), 0.0).sum(1)
    height = p @ np.array([py[k][0] for k in j])
    for n, k in enumerate(i):
        assert [rows[k][c] for c in ("mass", "linear", "entropy", "height", "one")] == pytest.approx([p[n].sum(), (cost[n] * p[n]).sum(), entropy[n], height[n], 2 * p[n].sum()], abs=1e-10)
    total = blocked.objective(blocked.apply(x, y, f, g, 0.5), 0.5).first()
    assert total["objective"] == pytest.approx((cost * p).sum() + 0.5 * entropy.sum(), abs=1e-9)


def test_the_cost_stays_where_it_is(spark):
    """No exchange of a half sweep reads the cost's layout itself: all that shuffles is sums."""
    cost = spark.range(40_000).select(F.lit("p").alias("problem"), (F.col("id") % 200).cast("int").alias("i0"), F.floor(F.col("id") / 200).cast("int").alias("i1"), F.rand(1).alias("c"))
    values = [spark.range(200).select(F.lit("p").alias("problem"), F.col("id").cast("int").alias(f"i{k}"), F.lit(0.005).alias("mass"), F.lit(0.0).alias(f"v{k}")) for k in (0, 1)]
    layouts = relational.lay_out(cost, 2)
    for a in (0, 1):
        plan = relational.half_sums(layouts[a], values, [200, 200], a, 0.5)._jdf.queryExecution().executedPlan().toString()
        at = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(at) == 1 and "SortMergeJoin" not in plan and "partial_sum" in plan.split("Exchange hashpartitioning")[1]


def test_joins_go_on_from_a_folder(spark, tmp_path):
    cost = spark.createDataFrame([("p", i, j, float((3 * i + 2 * j) % 5)) for i in range(3) for j in range(4)], "problem string, i0 int, i1 int, c double")
    ms = [spark.createDataFrame([("p", i, m) for i, m in enumerate(masses)], f"problem string, i{k} int, mass double") for k, masses in enumerate(([0.2, 0.3, 0.5], [0.4, 0.1, 0.25, 0.25]))]
    saved = str(tmp_path / "state")
    whole, _ = relational.sinkhorn(cost, ms, 0.5, 9)
    relational.sinkhorn(cost, ms, 0.5, 5, save=saved, every=2)
    resumed, ended = relational.sinkhorn(cost, ms, 0.5, 9, save=saved, every=2)
    assert ended.first()["iterations"] == 9
    for a, b in zip(whole, resumed, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_large_potentials_go_by_files(spark, monkeypatch):
    cost = spark.createDataFrame([("p", i, j, float((3 * i + 2 * j) % 5)) for i in range(3) for j in range(4)], "problem string, i0 int, i1 int, c double")
    ms = [spark.createDataFrame([("p", i, m) for i, m in enumerate(masses)], f"problem string, i{k} int, mass double") for k, masses in enumerate(([0.2, 0.3, 0.5], [0.4, 0.1, 0.25, 0.25]))]
    held, _ = relational.sinkhorn(cost, ms, 0.5, 3)
    want = relational.plan(cost, held, 0.5).orderBy("i0", "i1").collect()
    for name in ("HELD_ROWS", "BROADCAST_ROWS"):
        monkeypatch.setattr(relational, name, 0)
    monkeypatch.setattr(relational, "CELLS", 3)
    before = checkpoints.written()
    values, _ = relational.sinkhorn(cost, ms, 0.5, 3, 1e-12)
    found = relational.plan(cost, values, 0.5).orderBy("i0", "i1").collect()
    assert all(a[:3] == b[:3] and abs(a["mass"] - b["mass"]) < 1e-12 for a, b in zip(want, found, strict=True))
    assert checkpoints.written() - before <= 5  # two potentials, the problems' status and the measures' own; no generation stays behind


def test_tiles_are_all_pairs(clouds):
    x, y = clouds
    found = {(r["i"], r["j"]): r["c"] for r in blocked.tiles(x.select(F.col("idx").alias("i"), "x"), y.select(F.col("idx").alias("j"), "y"), block=7).collect()}
    px, py = ({r["idx"]: np.array(r[2]) for r in t.collect()} for t in clouds)
    assert found.keys() == {(i, j) for i in px for j in py}
    assert all(found[i, j] == pytest.approx(((px[i] - py[j]) ** 2).sum()) for i, j in found)


def test_log_sums_of_odd_terms(spark):
    inf = float("inf")
    rows = [("a", -2000.0), ("a", -2001.0), ("b", -inf), ("b", -inf), ("c", float("nan")), ("c", 1.0), ("d", None), ("e", 900.0), ("e", -inf)]
    out = {r["k"]: r["lse"] for r in relational.log_sums(spark.createDataFrame(rows, "k string, z double"), ["k"], "z").collect()}
    assert out["a"] == pytest.approx(-2000 + np.log1p(np.exp(-1))) and out["b"] == -inf and np.isnan(out["c"]) and np.isnan(out["d"]) and out["e"] == 900


def test_small_epsilon_keeps_all_mass(spark):
    cost = spark.createDataFrame([("p", i, j, float((i - j) ** 2)) for i in range(3) for j in range(3)], "problem string, i0 int, i1 int, c double")
    ms = [spark.createDataFrame([("p", i, 1 / 3) for i in range(3)], f"problem string, i{k} int, mass double") for k in (0, 1)]
    values, ended = relational.sinkhorn(cost, ms, 0.001, 20, 1e-9)
    assert relational.plan(cost, values, 0.001).agg(F.sum("mass")).first()[0] == pytest.approx(1.0)
    assert ended.first()["status"] == "converged"


def test_resumed_potentials_are_checked_and_used(spark):
    rows = [("p", 0, 1.0, 0.5), ("p", 1, None, 0.5), ("p", 2, float("-inf"), 0.0), ("q", 0, 0.3, 1.0), ("q", 1, None, 0.0), ("r", 0, 0.1, 0.5), ("r", 1, 0.2, 0.0)]
    t = spark.createDataFrame(rows, "problem string, i int, v double, mass double")
    out = {r["problem"]: r["valid"] for r in relational.resumable(t.select("problem", "i", "v"), t.select("problem", "i", "mass"), "i", "v").collect()}
    assert out == {"p": False, "q": True, "r": False}


def test_problem_status(spark):
    cost = spark.createDataFrame([(p, 0, 0, None if p == "null" else 1.0) for p in ("good", "null", "alone")], "problem string, i int, j int, c double")
    a = spark.createDataFrame([("good", 0, 1.0), ("null", 0, 1.0), ("alone", 0, 1.0), ("absent", 0, 1.0)], "problem string, i int, mass double")
    b = a.filter("problem <> 'alone'").withColumnRenamed("i", "j")
    status = lambda *x: {r["problem"]: r["valid"] for r in measures.problem_status(cost, [a, b], *x).collect()}
    assert status(0.5) == {"good": True, "null": False, "alone": False, "absent": False}
    assert not any(status(0.0).values()) and not any(status(0.5, float("nan")).values())


def test_steps_can_be_resumed():
    cost, rho = flow.line_cost(8), np.full(8, 1 / 8)
    model = flow.energy_of("potential", 8)
    whole = grouped.pdhg_step(cost, rho, model, 0.2, 1e-300, 60)
    half = grouped.pdhg_step(cost, rho, model, 0.2, 1e-300, 25)
    rest = grouped.pdhg_step(cost, rho, model, 0.2, 1e-300, 60, half["state"])
    assert rest["iterations"] == 60 and np.array_equal(rest["rho"], whole["rho"])


@pytest.mark.parametrize("change", [{"previous": np.zeros(4)}, {"previous": np.array([1, np.nan, 1, 1])}, {"dt": 0.0}, {"limit": -1}, {"theta": 1.5}, {"primal_step": 5.0}])
def test_first_order_steps_outside_their_domain(change):
    given = {"cost": flow.line_cost(4), "previous": np.full(4, 0.25), "energy": flow.energy_of("quadratic", 4), "dt": 0.1, "tol": 1e-6, "limit": 10} | change
    assert grouped.pdhg_step(**given)["status"] == grouped.INVALID


@pytest.mark.parametrize("change", [{"inner_tol": 1e-3}, {"eps": -1.0}, {"start": np.array([1.0, 0, 0, 0])}, {"previous": np.full(4, np.inf)}])
def test_entropic_steps_outside_their_domain(change):
    given = {"cost": flow.line_cost(4), "previous": np.full(4, 0.25), "energy": flow.energy_of("quadratic", 4), "dt": 0.1, "eps": 0.1, "tol": 1e-6, "limit": 10} | change
    assert grouped.entropic_step(**given)["status"] == grouped.INVALID


def test_energies_and_geometries_of_the_callers_own(spark):
    class Uphill:
        """An energy of the caller's own: mass is pulled to the last cell."""

        def __init__(self, n, weight):
            self.height = -weight * np.arange(n) / n

        def value(self, rho):
            return float((self.height * rho).sum())

        def gradient(self, rho):
            return self.height

        def prox(self, z, alpha):
            return np.maximum(z - alpha * self.height, 0)

    states = flow.initialize(spark.createDataFrame([("p", [0.5, 0.5, 0.0])], "problem string, rho array<double>"))
    out = flow.run_chunk(states, Uphill, 1.0, 1, 1e-7, 100_000, weight=9.0, geometry=lambda n: 1.0 - np.eye(n)).filter("slot = 1").first()
    assert out["status"] == 0 and np.allclose(out["rho"], [0, 0, 1], atol=1e-4)


def test_flow_as_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    states = flow.initialize(spark.createDataFrame([("p", [0.7, 0.2, 0.1]), ("q", [0.1, -0.2, 1.1])], "problem string, rho array<double>"))
    states.write.parquet(source)
    for n in (1, 2):
        flow.run_stream(spark.readStream.schema(flow.STATE).parquet(source), out, str(tmp_path / "progress"), energy="quadratic", dt=0.1, steps=1, tolerance=1e-6, limit=20_000).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == 4 * n  # what was read before isn't read again
        if n == 1:
            last = rows.filter("slot = 1")
            assert {(r["problem"], r["status"], round(r["time"], 3)) for r in last.collect()} == {("p", 0, 0.1), ("q", 2, 0.0)}
            flow.resume(rows.filter("problem = 'p'")).write.mode("append").parquet(source)
            states.filter("problem = 'q'").write.mode("append").parquet(source)


def test_thresholds_of_one_large_group(spark):
    values = spark.range(5000).select(F.lit("k").alias("k"), F.when(F.col("id") % 97 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("z"))
    t = projection.thresholds(values, "k", F.col("z"), 40.0).first()["t"]
    z = np.array([r["z"] for r in values.collect() if r["z"] is not None])
    assert np.maximum(t - z, 0).sum() == pytest.approx(40.0)
