"""solve() goes on to the tolerance, says how it ended, and gives the same plan by joins as by fold."""

import pytest
from pyspark.sql import functions as F

from ferrymass import api


@pytest.fixture(scope="module")
def problem(spark):
    cost = spark.createDataFrame([("p", i, j, float((3 * i + 2 * j) % 5)) for i in range(3) for j in range(4)], "problem string, i int, j int, c double")
    a = spark.createDataFrame([("p", i, m) for i, m in enumerate([0.2, 0.3, 0.5])], "problem string, i int, mass double")
    b = spark.createDataFrame([("p", j, m) for j, m in enumerate([0.4, 0.1, 0.25, 0.25])], "problem string, j int, mass double")
    return cost.cache(), [a.cache(), b.cache()]


def _rows(df):
    return sorted(tuple(r) for r in df.select("i", "j", F.round("mass", 9)).collect())


def test_quadratic_stops_at_the_tolerance_and_says_so(problem):
    done = api.solve(*problem, api.SolverConfig(0.5), regularizer="quadratic").collect()
    assert len(done) == 12 and {r["status"] for r in done} == {"converged"}
    assert all(r["error"] <= 1e-8 and 1 < r["iterations"] < 50_000 for r in done)
    cut = api.solve(*problem, api.SolverConfig(0.5, max_iterations=1), regularizer="quadratic").collect()
    assert {(r["status"], r["iterations"]) for r in cut} == {("max_iterations", 1)} and cut[0]["error"] > 1e-8


def test_inner_folds_change_nothing(problem, monkeypatch):
    config = api.SolverConfig(0.5, max_iterations=5, tolerance=1e-300)
    whole = api.solve(*problem, config, regularizer="quadratic").collect()
    monkeypatch.setattr(api.fold, "INNER", 2)
    parts = api.solve(*problem, config, regularizer="quadratic").collect()
    assert sorted(whole) == sorted(parts)


def test_large_quadratic_problems_go_by_joins(problem, monkeypatch):
    config = api.SolverConfig(0.5, max_iterations=2)
    folded = _rows(api.solve(*problem, config, regularizer="quadratic"))
    monkeypatch.setattr(api, "FOLD_CELLS", 11)
    monkeypatch.setattr(api.fold, "plan", lambda solved, *x, f=api.fold.plan: f(solved.filter("1 = 0"), *x))
    assert _rows(api.solve(*problem, config, regularizer="quadratic")) == folded


def test_long_lines_go_by_rounds(problem, monkeypatch):
    cost, (a, b) = problem
    whole, _ = api.relational.quadratic(cost, a, b, 0.5, 2, None)
    want = _rows(whole)
    monkeypatch.setattr(api.relational, "LINE", 1)
    rounds, _ = api.relational.quadratic(cost, a, b, 0.5, 2, None)
    assert _rows(rounds) == want


def test_shannon_by_fold_is_shannon_by_joins(problem, monkeypatch):
    config = api.SolverConfig(0.5, max_iterations=3)
    folded = _rows(api.solve(*problem, config))
    monkeypatch.setattr(api, "FOLD_CELLS", 11)
    assert _rows(api.solve(*problem, config)) == folded


def test_sparse_costs_go_by_joins(problem):
    cost, (a, b) = problem
    out = api.solve(cost.filter("i <> 1 OR j <> 2"), [a, b], api.SolverConfig(0.5, max_iterations=3)).collect()
    assert len(out) == 11 and {(r["status"], r["iterations"]) for r in out} == {("max_iterations", 3)}


def test_quantum_statuses_are_words(spark):
    flat = [0.5, 0.0, 0.0, 0.5]
    rows = [(p, 2, 2, [0.0] * 16, [0.0] * 16, [x * k for x in flat], [0.0] * 4, flat, [0.0] * 4) for p, k in (("good", 1.0), ("heavy", 2.0))]
    cost = spark.createDataFrame(rows, "problem string, n int, m int, cost_re array<double>, cost_im array<double>, a_re array<double>, a_im array<double>, b_re array<double>, b_im array<double>")
    for kind in ("quadratic", "von_neumann"):
        out = api.solve(cost, [], api.SolverConfig(0.5, 1e-6), "quantum", kind)
        assert {r["problem"]: r["status"] for r in out.collect()} == {"good": "converged", "heavy": "invalid"}


def test_shannon_says_how_it_ended(problem):
    out = api.solve(*problem, api.SolverConfig(0.5, max_iterations=2)).collect()
    assert len(out) == 12 and {(r["status"], r["iterations"]) for r in out} == {("max_iterations", 2)}
