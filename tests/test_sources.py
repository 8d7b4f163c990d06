"""Array files, archives, reports, seeded workloads and the command line."""

import json

import numpy as np
import pytest

from ferrymass import __main__ as cli
from ferrymass import checkpoints
from ferrymass.sources import archive, generate, workloads


def test_arrays_are_written_and_read(spark, tmp_path):
    rows = [("a", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", [1], [float("inf")])]
    done = archive.write_arrays(spark.createDataFrame(rows, "name string, shape array<int>, values array<double>"), f"file://{tmp_path}").collect()
    assert {r["path"] for r in done} == {f"{tmp_path}/a.npy", f"{tmp_path}/b.npy"}
    assert np.load(tmp_path / "a.npy").shape == (2, 3) and sorted(p.name for p in tmp_path.iterdir()) == ["a.npy", "b.npy"]
    back = {r["path"].rsplit("/", 1)[1]: (list(r["shape"]), list(r["values"])) for r in archive.read_arrays(spark, str(tmp_path)).collect()}
    assert back == {"a.npy": ([2, 3], rows[0][2]), "b.npy": ([1], [float("inf")])}


def test_results_are_read_back_with_their_configuration(spark, tmp_path):
    coupling = spark.createDataFrame([("p", 0, 1, 0.5)], "problem string, i int, j int, mass double")
    told = spark.createDataFrame([(1e-9, 12)], "error double, iterations int")
    archive.save_result(coupling, told, str(tmp_path / "r"), {"epsilon": 0.5})
    again, diagnostics = archive.load_result(spark, str(tmp_path / "r"), {"epsilon": 0.5})
    assert again.collect() == coupling.collect() and diagnostics.first()["iterations"] == 12
    with pytest.raises(ValueError, match="another configuration"):
        archive.load_result(spark, str(tmp_path / "r"), {"epsilon": 0.6})


def test_digests_tell_arrays_apart():
    a = np.arange(6.0)
    assert archive.array_digest(a) != archive.array_digest(a.reshape(2, 3)) != archive.array_digest(a.astype(np.float32))
    assert archive.array_digest(a, a) == archive.array_digest(a.copy(), a[::1])
    assert archive.config_digest({"b": 1, "a": 2}) == archive.config_digest({"a": 2, "b": 1})
    assert archive.run_identity({"name": "x"}).startswith("x-")


def test_reports_are_strict_and_whole(spark, tmp_path):
    path = tmp_path / "r.json"
    archive.write_json(str(path), {"x": float("nan"), "y": [1.5, float("inf")], "z": "s"})
    assert json.loads(path.read_text()) == {"x": None, "y": [1.5, None], "z": "s"} and len(list(tmp_path.iterdir())) == 1
    events = spark.createDataFrame([(0, "execute", 0.5)], "chunk int, phase string, seconds double")
    for _ in range(2):
        archive.append_timings(events, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_row_points_do_not_depend_on_partitions(spark):
    x = {r["idx"]: r["x"] for r in generate.row_points(spark, 20, 3, 5).collect()}
    y = {r["idx"]: r["x"] for r in generate.row_points(spark, 20, 3, 5).repartition(3).collect()}
    assert x == y and x[4] == np.random.default_rng(np.random.SeedSequence([5, 0, 4])).normal(size=3).tolist()


def test_workloads_follow_their_seed(spark):
    one, two = (workloads.classical_workload(spark, 5, 4, 2, s) for s in (1, 2))
    assert one.digest == workloads.classical_workload(spark, 5, 4, 2, 1).digest != two.digest
    assert sum(r["mass"] for r in one.tables["x"].collect()) == pytest.approx(1.0)
    assert workloads.flow_workload(spark, 8, "quadratic", 3).rng_state != workloads.flow_workload(spark, 8, "quadratic", 4).rng_state


def test_tables_of_our_own_are_swept(spark):
    kept, gone = (checkpoints.persist(spark.range(3), n) for n in ("kept", "gone"))
    assert checkpoints.sweep(spark, kept) >= 1 and kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist"):
        gone.count()


def test_states_are_read_by_those_they_belong_to(spark, tmp_path):
    path = f"file://{tmp_path / 'state'}"
    with pytest.raises(ValueError, match="no such"):
        checkpoints.load_state(spark, path, "a")
    for n in (0, 1):
        assert checkpoints.save_state(spark.range(n + 2), path, "a") == n
    assert checkpoints.load_state(spark, path, "a").count() == 3 and checkpoints.load_state(spark, path, "a", 0).count() == 2
    with pytest.raises(ValueError, match="another problem"):
        checkpoints.load_state(spark, path, "b")
    spark.range(9).write.mode("overwrite").parquet(f"{path}/generation-1")
    with pytest.raises(ValueError, match="as it was written"):
        checkpoints.load_state(spark, path, "a")


def test_command_line(spark, tmp_path, capsys):
    cost, marginal, out = (str(tmp_path / n) for n in ("cost", "marginal", "out"))
    assert cli.main(["generate", "cost", "--n", "4", "--kind", "weak-coulomb", "--output", cost])["rows"] == 16
    cli.main(["generate", "marginal", "--n", "4", "--output", marginal])
    long = spark.read.parquet(cost).selectExpr("'p' AS problem", "i0 AS i", "i1 AS j", "c")
    long.write.parquet(f"{cost}-long")
    for axis in "ij":
        spark.read.parquet(marginal).selectExpr("'p' AS problem", f"idx AS {axis}", "mass").write.parquet(f"{marginal}-{axis}")
    told = cli.main(["solve", "classical", "--cost", f"{cost}-long", "--marginal", f"{marginal}-i", "--marginal", f"{marginal}-j", "--regularizer", "quadratic", "--epsilon", "0.5", "--output", out])
    assert told["problems"] == {"converged": 1} and json.loads(capsys.readouterr().out.splitlines()[-1]) == told
    assert sum(r["mass"] for r in spark.read.parquet(f"{out}/coupling").collect()) == pytest.approx(1.0)
    assert archive.load_result(spark, out)[1].first()["status"] == "converged"
