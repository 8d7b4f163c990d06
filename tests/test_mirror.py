"""Entropic steps with transport by blocks, and both residuals of a cloud, against numpy."""

import numpy as np
import pytest

from ferrymass.plans import blocked, grouped, mirror

X = np.linspace(0, 1, 5)
RHO = np.array([0.1, 0.2, 0.4, 0.2, 0.1])


@pytest.fixture(scope="module")
def tables(spark):
    points = spark.createDataFrame([(i, [float(x)], 0.2) for i, x in enumerate(X)], "idx long, x array<double>, w double").cache()
    return points, spark.createDataFrame([(i, [float(x)], float(r)) for i, (x, r) in enumerate(zip(X, RHO, strict=True))], "idx long, y array<double>, mass double").cache()


def test_a_step_by_blocks_is_a_dense_step(tables):
    want = grouped.entropic_step((X[:, None] - X[None]) ** 2, RHO, grouped.Quadratic(np.full(5, 0.2), 2.0), 0.3, 0.2, 1e-6, 1)
    got = mirror.entropic_step(*tables, mirror.quadratic(2.0), 0.3, 0.2, 1e-6, 1, block=3)
    rho = [r["rho"] for r in got.rho.orderBy("idx").collect()]
    assert np.allclose(rho, want["rho"], atol=2e-9) and got.error == pytest.approx(want["error"], abs=1e-8)
    assert (got.iterations, got.sweeps, got.status) == (1, want["sweeps"], mirror.LIMIT) and got.objective == pytest.approx(want["objective"], abs=1e-9)


def test_steps_outside_their_domain_or_without_transport(tables):
    points, previous = tables
    assert mirror.entropic_step(points, previous, mirror.entropy(), 0.3, 0.2, 1e-8, 5, inner_tolerance=1e-6).status == mirror.INVALID
    assert mirror.entropic_step(points, previous.withColumn("mass", -previous["mass"]), mirror.entropy(), 0.3, 0.2, 1e-6, 5).status == mirror.INVALID
    out, told = mirror.flow(points, previous.select("idx", "mass"), mirror.potential(), 0.3, 0.01, 2, 1e-8, 5, inner_limit=0)
    assert [t.status for t in told] == [mirror.INNER]
    rows = out.collect()
    assert len(rows) == 15 and {r["time"] for r in rows} == {0.0} and all(r["rho"] == pytest.approx(RHO[r["idx"]]) for r in rows)


def test_residuals_of_both_sides(tables, spark):
    points, y = tables
    x = points.select("idx", "x").join(y.select("idx", "mass"), "idx")
    zero = lambda t, c: t.selectExpr("idx", f"0.0D AS {c}")
    p = np.exp(-((X[:, None] - X[None]) ** 2) / 0.3)
    assert blocked.residual(x, y, zero(x, "f"), zero(y, "g"), 0.3, block=3) == pytest.approx((np.abs(p.sum(1) - RHO).sum(), np.abs(p.sum(0) - RHO).sum()))
