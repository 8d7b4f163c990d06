"""Tables written to the shared folder, so that iterations start from files and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a new one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ferrymass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def persist(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: what follows starts from files that every executor can reach.

    With gather, what many tasks make a little of is first dealt into as few parts
    as its size asks for, so that it isn't left in as many small files.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if gather else df
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables persist has written so far: a mark for sweep."""
    return len(_written)


def remove(*tables: DataFrame) -> None:
    """Delete tables that persist has written in this process; others stay, as do those that live in the driver."""
    for df in tables:
        names = {"/" + f.removeprefix("file:").lstrip("/").rsplit("/", 1)[0] for f in df.inputFiles()} if _written else set()
        for p in [p for p in _written if "/" + p.removeprefix("file:").lstrip("/") in names]:
            _delete(df.sparkSession, p)
            _written.remove(p)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> int:
    """Delete the tables that persist has written in this process since a mark, but for those that keep reads; how many went.

    Results that are still to be read depend on these tables: write them first.
    """
    held = set() if keep is None else {f.rsplit("/", 1)[0].removeprefix("file:").lstrip("/") for f in keep.inputFiles()}
    gone = [p for p in _written[since:] if p.removeprefix("file:").lstrip("/") not in held]
    for p in gone:
        _delete(spark, p)
    _written[since:] = [p for p in _written[since:] if p not in gone]
    return len(gone)


MANIFEST = "generation long, identity string, columns string, rows long"


def has_state(spark: SparkSession, path: str) -> bool:
    """Whether a whole generation has been written under path."""
    return bool(_manifest(spark, path))


def save_state(state: DataFrame, path: str, identity: str, keep: int | None = None) -> int:
    """Write a solver's state as the next generation under path and return its number.

    Its line in the manifest is written last, so a generation that a lost driver
    left half written is never read. identity says what problem and settings the
    state belongs to. With keep, so many of the last generations stay.
    """
    spark = state.sparkSession
    generation = max((r["generation"] for r in _manifest(spark, path)), default=-1) + 1
    target = f"{path}/generation-{generation}"
    state.write.mode("overwrite").parquet(target)
    line = [(generation, identity, state.schema.simpleString(), spark.read.parquet(target).count())]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    if keep is not None and generation >= keep:
        _delete(spark, f"{path}/generation-{generation - keep}")
    return generation


def load_state(spark: SparkSession, path: str, identity: str, generation: int | None = None) -> DataFrame:
    """The state of a generation, the last one by default; an error where it is absent, of another identity, or not as it was written."""
    lines = {r["generation"]: r for r in _manifest(spark, path)}
    if not lines or (generation is not None and generation not in lines):
        raise ValueError("no such state has been written")
    line = lines[max(lines) if generation is None else generation]
    if line["identity"] != identity:
        raise ValueError("the state belongs to another problem or other settings")
    state = spark.read.parquet(f"{path}/generation-{line['generation']}")
    if state.schema.simpleString() != line["columns"] or state.count() != line["rows"]:
        raise ValueError("the state is not as it was written")
    return state


def _manifest(spark: SparkSession, path: str) -> list:
    """Lines of the manifest: one for each generation."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return []
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
