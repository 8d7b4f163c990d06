"""Published cases of the reference: iterations, residuals and errors that its documents state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrymass.plans import blocked, grouped
from ferrymass.sources import workloads
from ferrymass.streaming import flow


@pytest.mark.parametrize(("n", "m", "sweeps", "residual"), [(257, 383, 113, 9.5152e-9), (514, 766, 107, 9.2876e-9)])
def test_point_clouds(spark, n, m, sweeps, residual):
    made = workloads.classical_workload(spark, n, m, 3, 42)
    even = lambda t, count: t.withColumn("mass", F.lit(1.0 / count))
    x, y = even(made.tables["x"], n), even(made.tables["y"], m)
    out = blocked.solve_each(x, y, 0.3, 50_000, 1e-8).cache()
    told = out.select("iterations", "error", "status").distinct().collect()
    assert len(told) == 1 and told[0][0] == sweeps and told[0][2] == 0
    assert told[0][1] == pytest.approx(residual, rel=1e-4)
    if n == 257:
        assert workloads.cloud_objective(x, y, out, 0.3).first()["objective"] == pytest.approx(-2.351615560320519, abs=1e-9)


def test_heat_flow(spark):
    made = workloads.flow_workload(spark, 16)
    states = flow.initialize(made.tables["starts"])
    rows = {r["slot"]: r for r in flow.run_chunk(states, "entropy", 0.02, 2, 1e-7, 50_000).collect()}
    assert [rows[k]["iterations"] for k in (1, 2)] == [637, 637] and rows[2]["time"] == pytest.approx(0.04) and rows[2]["status"] == 0
    rho, x = np.array(rows[2]["rho"]), (np.arange(16) + 0.5) / 16
    assert abs(rho.sum() - 1) == pytest.approx(1.265e-8, rel=1e-3)
    mode = (1 + 0.2 * np.exp(-0.04 * np.pi**2) * np.cos(np.pi * x)) / 16
    assert np.abs(rho - mode).sum() == pytest.approx(0.0415963, abs=1e-7)


def test_a_quantum_workload_ends_within_its_tolerance(spark):
    made = workloads.quantum_workload(spark, 2, 3, 7)
    for method, gap in (("von_neumann", True), ("quadratic", False)):
        got = grouped.solve(made.tables["problems"], method, 0.5, 1e-7).first()
        row = made.tables["problems"].first()
        x = (np.array(got["coupling_re"]) + 1j * np.array(got["coupling_im"])).reshape(6, 6)
        a = (np.array(row["a_re"]) + 1j * np.array(row["a_im"])).reshape(2, 2)
        b = (np.array(row["b_re"]) + 1j * np.array(row["b_im"])).reshape(3, 3)
        assert got["status"] == 0 and np.linalg.eigvalsh(x)[0] > -1e-7
        assert np.abs(grouped.trace_second(x, 2, 3) - a).max() < 1e-6 and np.abs(grouped.trace_first(x, 2, 3) - b).max() < 1e-6
        if gap:
            assert got["primal"] == pytest.approx(got["dual"], abs=1e-6)
    assert made.digest == workloads.quantum_workload(spark, 2, 3, 7).digest != workloads.quantum_workload(spark, 2, 3, 8).digest
