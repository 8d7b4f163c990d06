"""Configurations are read strictly, each with the first field at fault."""

import json

import pytest

from ferrymass.sources import configs

CASES = [
    ({}, None), ({"n": 8}, None), ({"n": 8, "m": None}, None), ({"kind": "classical", "n": 3, "m": 9}, None), ({"kind": "quantum", "backend": "entropy"}, None), ({"seed": 0, "inner_iterations": 0}, None),
    ({"epsilon": 1}, None), ({"backend": "pdhg", "inner_tolerance": 1.0}, None), ({"snapshot_stride": 2}, None), ({"snapshot_stride": None}, None),
    ({"nn": 8}, "unknown"), ({"schema_version": 2}, "schema_version"), ({"schema_version": True}, "schema_version"), ({"name": ""}, "name"), ({"name": "a b"}, "name"), ({"name": 5}, "name"), ({"name": "a" * 65}, "name"),
    ({"kind": "other"}, "kind"), ({"n": 0}, "n"), ({"n": 2.0}, "n"), ({"n": "8"}, "n"), ({"n": True}, "n"), ({"n": 2**31}, "n"), ({"n": 10**30}, "n"), ({"seed": -1}, "seed"), ({"steps": None}, "steps"),
    ({"snapshot_stride": 0}, "snapshot_stride"), ({"snapshot_stride": 1.5}, "snapshot_stride"), ({"epsilon": 0}, "epsilon"), ({"epsilon": "0.1"}, "epsilon"), ({"time_step": -1.0}, "time_step"), ({"tolerance": None}, "tolerance"),
    ({"dtype": "float16"}, "dtype"), ({"device": 1}, "device"), ({"backend": "entropy"}, "backend"), ({"kind": "quantum"}, "backend"), ({"energy": "potential"}, "energy"), ({"n": 3, "m": 4}, "m"), ({"inner_tolerance": 1e-3}, "inner_tolerance"),
]


def test_faults(spark):
    lines = [json.dumps(c) for c, _ in CASES] + ["[1]", "{", "", None, '{"n": 8, "n": 9}']
    rows = configs.read_configs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["fault"] for r in rows] == [f for _, f in CASES] + ["json"] * 5
    assert all((r["identity"] is None) == (r["fault"] is not None) for r in rows)
    assert (rows[1]["m"], rows[1]["epsilon"], rows[1]["name"]) == (8, 0.2, "experiment")


def test_identities(spark):
    lines = ['{"n": 8, "name": "a"}', '{"name":"a","m":8,"n":8}', '{"n": 9, "name": "a"}', '{"n": 0}']
    out = configs.read_configs(spark.createDataFrame([(x,) for x in lines], "value string"))
    names = [r["identity"] for r in out.collect()]
    assert names[0] == names[1] != names[2] and names[0].startswith("a-") and len(names[0]) == 18 and names[3] is None
    assert [tuple(r) for r in configs.repeated(out).collect()] == [(names[0], 2)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from ferrymass import checkpoints

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert checkpoints.shared_folder(session("local[4]")).startswith("file://")
    with pytest.raises(ValueError, match="share"):
        checkpoints.shared_folder(session("spark://host:7077"))
