"""Matrices in blocks, steps as tables of cells, medians and thresholds by rounds, and flows in keyed state, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrymass.operators import measures, projection, spectral
from ferrymass.plans import grouped, steps
from ferrymass.sources import archive, generate
from ferrymass.streaming import flow

SIZE = 4


def _hermitian(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
    return (a + a.conj().T) / 2


def _frame(spark, matrices):
    rows = [(k, i, j, float(m[i, j].real), float(m[i, j].imag)) for k, m in matrices.items() for i in range(len(m)) for j in range(len(m)) if m[i, j]]
    return spark.createDataFrame(rows, "problem string, r int, c int, re double, im double"), spark.createDataFrame([(k, len(m)) for k, m in matrices.items()], "problem string, n int")


def _dense(df, like):
    out = {k: np.zeros(m.shape, complex) for k, m in like.items()}
    for r in spectral.entries(df, SIZE).filter("re <> 0 OR im <> 0").collect():
        out[r["problem"]][r["r"], r["c"]] = r["re"] + 1j * r["im"]
    return out


@pytest.fixture(scope="module")
def matrices():
    whole = _hermitian(6, 3)
    whole[:, 5] = whole[5, :] = 0  # an eigenvalue of zero
    return {"a": _hermitian(9, 1), "b": whole}


def test_matrices_in_blocks(spark, matrices):
    long, dims = _frame(spark, matrices)
    b = spectral.persist(spectral.blocks(long, SIZE), "test-blocks")
    assert all(np.allclose(x, matrices[k] @ matrices[k] / 2 + matrices[k]) for k, x in _dense(spectral.product(b, b, 0.5, b), matrices).items())
    assert all(np.allclose(x, grouped.psd(matrices[k]), atol=1e-9) for k, x in _dense(spectral.nearest_psd(b, dims, SIZE), matrices).items())
    state, z = spectral.gibbs(b, dims, SIZE, 0.7)
    logs = {r["problem"]: r["log_z"] for r in z.collect()}
    for k, x in _dense(state, matrices).items():
        want, log_z = grouped.gibbs(matrices[k], 0.7)
        assert np.abs(x - want).max() < 1e-9 and logs[k] == pytest.approx(log_z, abs=1e-9)


def test_density_matrices_in_blocks(spark):
    made = {"good": grouped.psd(_hermitian(9, 5)) + 0.1 * np.eye(9), "low": _hermitian(7, 6), "skew": grouped.psd(_hermitian(6, 7)) + 0.1 * np.eye(6), "two": grouped.psd(_hermitian(5, 8)) + 0.1 * np.eye(5), "edge": np.diag([1.0, 0, 0, 0, 0]) + 0j, "nan": np.eye(3) / 3 + 0j}
    made = {k: m / np.trace(m).real for k, m in made.items()}
    made["skew"][0, 3] += 0.2
    made["two"] *= 2
    made["nan"][1, 1] = np.nan
    long, dims = _frame(spark, made)
    dims = dims.unionByName(spark.createDataFrame([("absent", 3)], dims.schema))
    told = lambda strict: {r["problem"]: tuple(r)[1:] for r in spectral.validate(long, dims, strict=strict, size=SIZE).collect()}
    loose, hard = told(False), told(True)
    assert loose["good"] == (True,) * 4 and loose["edge"] == (True,) * 4 and hard["edge"] == (True, True, False, False) and hard["good"] == (True,) * 4
    assert loose["low"] == (True, True, False, False) and loose["skew"][0] is False and loose["two"] == (True, False, True, False)
    assert not loose["nan"][3] and not loose["absent"][3]


@pytest.mark.parametrize("kind", ["quadratic", "entropy", "potential"])
def test_steps_as_tables(spark, kind):
    n, m = 4, 5
    rng = np.random.default_rng(2)
    cost = rng.uniform(size=(n, m))
    masses = {"p": rng.uniform(0.1, 1, m), "q": np.r_[0, rng.uniform(0.1, 1, m - 1)], "bad": np.r_[-1.0, np.ones(m - 1)]}
    w = np.full(n, 0.25)
    numpy_energy = {"quadratic": grouped.Quadratic(w, 2.0), "entropy": grouped.Entropy(w), "potential": grouped.Potential(w)}[kind]
    energy = {"quadratic": steps.quadratic(2.0), "entropy": steps.entropy(), "potential": steps.potential()}[kind]
    c = spark.createDataFrame([(k, i, j, float(cost[i, j])) for k in masses for i in range(n) for j in range(m)], "problem string, i int, j int, c double")
    previous = spark.createDataFrame([(k, j, float(x)) for k, own in masses.items() for j, x in enumerate(own)], "problem string, j int, mass double")
    density = spark.createDataFrame([(k, i, 0.25) for k in masses for i in range(n)], "problem string, i int, w double")
    at = steps.pdhg(steps.start(c, density, previous, 0.2), energy, 0.2, 2)
    at = steps.pdhg(at, energy, 0.2, 2)  # goes on where the first two ended
    told = {r["problem"]: r for r in at.told.collect()}
    assert told["bad"]["status"] == steps.INVALID and told["bad"]["iterations"] == 0
    objective = {r["problem"]: r["objective"] for r in at.objective(energy, 0.2).collect()}
    for k in ("p", "q"):
        want = grouped.pdhg_step(cost, masses[k], numpy_energy, 0.2, 1e-300, 4)
        rho = [r["rho"] for r in at.rows.filter(F.col("problem") == k).orderBy("i").collect()]
        assert np.allclose(rho, want["rho"], atol=1e-12) and told[k]["iterations"] == 4 and told[k]["status"] == steps.LIMIT
        assert told[k]["error"] == pytest.approx(want["error"], abs=1e-12) and objective[k] == pytest.approx(want["objective"], abs=1e-12)


def test_a_step_that_has_converged_stays(spark):
    c = spark.createDataFrame([("p", 0, 0, 0.0), ("q", 0, 0, 0.0), ("q", 0, 1, 1.0), ("q", 1, 0, 1.0), ("q", 1, 1, 0.0)], "problem string, i int, j int, c double")
    previous = spark.createDataFrame([("p", 0, 1.0), ("q", 0, 0.9), ("q", 1, 0.1)], "problem string, j int, mass double")
    density = spark.createDataFrame([("p", 0, 0.0), ("q", 0, 0.0), ("q", 1, 1.0)], "problem string, i int, w double")
    at = steps.pdhg(steps.start(c, density, previous, 0.1), steps.potential(), 0.1, 3, 1e-9)
    told = {r["problem"]: tuple(r)[1:] for r in at.told.collect()}
    assert told["p"][0] == 1 and told["p"][2] == steps.CONVERGED and told["q"][0] == 3 and told["q"][2] == steps.LIMIT
    at = steps.pdhg(at, steps.potential(), 0.1, 1, 1e-9)
    assert {r["problem"]: r["iterations"] for r in at.told.collect()} == {"p": 1, "q": 4}


def test_medians_of_any_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(projection, "FEW", 3)
    monkeypatch.setattr(projection, "RANGES", 8)
    rng = np.random.default_rng(4)
    own = {"wide": (rng.normal(size=101) * 10.0 ** rng.integers(-8, 8, 101)).tolist(), "even": rng.integers(0, 9, 60).astype(float).tolist(), "same": [2.5] * 40, "two": [1.0, 4.0], "one": [7.0], None: [3.0, 1.0, 2.0], "odd": [1.0, float("nan"), None, float("inf"), 5.0], "none": [float("nan")]}
    rows = [(k, None if v is None else float(v)) for k, values in own.items() for v in values]
    got = {r["k"]: r["median"] for r in projection.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    want = {k: float(np.median([v for v in values if v is not None and np.isfinite(v)])) for k, values in own.items() if k != "none"}
    assert got == pytest.approx(want)
    out = {r["k"]: r["valid"] for r in archive.sample_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert out["two"] and out[None] and not out["odd"] and not out["none"]


def test_thresholds_keep_null_keys(spark):
    rows = [("a", 1.0), ("a", 2.0), (None, 5.0), (None, 50.0)]
    out = {r["k"]: r["t"] for r in projection.thresholds(spark.createDataFrame(rows, "k string, z double"), "k", F.col("z"), 1.5).collect()}
    assert out == {"a": 2.25, None: 6.5}


def test_normalised_measures_keep_their_columns(spark):
    rows = [("a", 1, 3.0), ("a", 2, 1.0), (None, 1, 5.0)]
    out = measures.normalise(spark.createDataFrame(rows, "problem string, i int, mass double"), ["problem"])
    assert out.columns == ["problem", "i", "mass"] and sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, 0.75), ("a", 2, 0.25), (None, 1, 1.0)], key=str)


def test_shares_of_rows(spark):
    out = generate.row_shares(spark.createDataFrame([(257,), (3,)], "n long"), "n", 8).orderBy("n", "part").collect()
    assert [r["valid"] for r in out] == [1, 1, 1, 0, 0, 0, 0, 0, *[33] * 7, 26] and out[-1]["start"] == 231


def test_flows_in_keyed_state(spark, tmp_path):
    """A stream that is stopped and started again goes on where it was; a failed step leaves its problem in place."""
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    requests = "problem string, rho array<double>"
    options = {"energy": "quadratic", "dt": 0.1, "steps": 2, "tolerance": 1e-6, "limit": 20_000}
    for rows in ([("p", [0.7, 0.2, 0.1]), ("q", [0.1, -0.2, 1.1])], [("p", None), ("q", None), ("lost", None)], [("q", [0.1, 0.2, 0.7])]):
        spark.createDataFrame(rows, requests).write.mode("append").parquet(source)
        flow.run_keyed_stream(spark.readStream.schema(requests).parquet(source), out, progress, **options).awaitTermination()
    got = spark.read.parquet(out).collect()
    batch = flow.run_chunk(flow.initialize(spark.createDataFrame([("p", [0.7, 0.2, 0.1])], requests)), "quadratic", 0.1, 4, 1e-6, 20_000).collect()
    want = {round(r["time"], 3): r["rho"] for r in batch}
    own = {round(r["time"], 3): r["rho"] for r in got if r["problem"] == "p"}
    assert own.keys() == want.keys() == {0.0, 0.1, 0.2, 0.3, 0.4} and all(np.allclose(own[t], want[t], atol=1e-12) for t in want)
    q = sorted((r["status"], round(r["time"], 3)) for r in got if r["problem"] == "q" and r["slot"] == 2)
    assert q == [(0, 0.2), (2, 0.0), (2, 0.0)] and not [r for r in got if r["problem"] == "lost"]
