"""Every query that has SQL, at sf0.001, against DuckDB; the entry points; and the guard for absent text operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(f"{r[i]:.5g}" if isinstance(r[i], float) and math.isfinite(r[i]) else str(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(clean)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry_points.oracle_sql()[name])
    assert got == _rows([d[0] for d in cur.description], cur.fetchall())


def test_flows_keep_mass(spark):
    for name in ("q_pdhg_flow", "q_entropic_flow"):
        mass = entry_points.queries()[name](spark, SF).groupBy("problem", "slot").sum("mass").collect()
        assert mass and all(abs(r[2] - 1) < 5e-3 for r in mass)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["problem", "i", "j", "mass"]


def test_without_the_text_operators(tmp_path):
    """The rest imports and lists its queries where their folder and the pipeline's file are gone."""
    import shutil

    shutil.copytree(ROOT / "ferrymass", tmp_path / "ferrymass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
