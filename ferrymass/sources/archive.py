"""Result archives and array files: Parquet with a manifest, and .npy arrays read by tasks."""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.operators.projection import medians


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, values (row by row) of .npy files; pickled objects are refused."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, np.load(io.BytesIO(c), allow_pickle=False)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([(p, list(x.shape), x.astype(float).ravel().tolist()) for p, x in rows], columns=["path", "shape", "values"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(load, "path string, shape array<int>, values array<double>")


def write_arrays(arrays: DataFrame, folder: str) -> DataFrame:
    """path, bytes of the .npy files written for a table (name, shape, values), each by the task that has its row.

    folder is one that all executors reach. A file is written whole under another
    name and then renamed, so a task that is run again leaves one file.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                path = os.path.join(folder.removeprefix("file://"), f"{r.name}.npy")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    np.save(f, np.reshape(np.asarray(r.values, float), tuple(r.shape)))
                os.replace(part, path)
                rows.append((path, os.path.getsize(path)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return arrays.select("name", "shape", "values").mapInPandas(save, "path string, bytes long")


def array_digest(*arrays: np.ndarray) -> str:
    """SHA-256 over shape, type and bytes of each array in turn."""
    out = hashlib.sha256()
    for a in map(np.ascontiguousarray, arrays):
        out.update(str((a.shape, a.dtype.str)).encode())
        out.update(a.tobytes())
    return out.hexdigest()


def write_json(path: str, value) -> None:
    """A small report as strict JSON, there whole or not at all; numbers that are not finite become null."""
    def strict(v):
        if isinstance(v, dict):
            return {k: strict(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [strict(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "x", encoding="utf-8") as f:
        json.dump(strict(value), f, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def append_timings(events: DataFrame, path: str) -> None:
    """Rows (chunk, phase, seconds) added to the timing table at path."""
    events.select("chunk", "phase", "seconds").write.mode("append").parquet(path)


def config_digest(config: dict) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def run_identity(config: dict) -> str:
    return f"{config['name']}-{config_digest(config)[:16]}"


def save_result(coupling: DataFrame, diagnostics: DataFrame, path: str, metadata: dict) -> None:
    """Coupling, then diagnostics with the metadata: the second table's presence says that the first is whole."""
    coupling.write.mode("overwrite").parquet(f"{path}/coupling")
    diagnostics.withColumn("metadata", F.lit(json.dumps(metadata, sort_keys=True))).write.mode("overwrite").parquet(f"{path}/diagnostics")


def load_result(spark: SparkSession, path: str, expected: dict | None = None) -> tuple[DataFrame, DataFrame]:
    diagnostics = spark.read.parquet(f"{path}/diagnostics")
    missing = {"error", "iterations", "metadata"} - set(diagnostics.columns)
    if missing:
        raise ValueError(f"missing from the archive: {sorted(missing)}")
    row = diagnostics.select("metadata").first()
    if expected is not None and (row is None or json.loads(row[0]) != expected):
        raise ValueError("the archive was written for another configuration")
    return spark.read.parquet(f"{path}/coupling"), diagnostics


def timing_summary(events: DataFrame, chunks: int) -> DataFrame:
    """Per phase the summed seconds of events (chunk, phase, seconds), and whether all chunks are there once."""
    per = events.groupBy("phase").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"), F.count_distinct("chunk").alias("distinct"))
    return per.select("phase", "seconds", ((F.col("n") == chunks) & (F.col("distinct") == chunks)).alias("complete"))


def sample_summary(samples: DataFrame, key: str, seconds: str = "seconds") -> DataFrame:
    """key, median, least, most and valid of timings: valid where all of a key's samples are finite and positive. The median is that of the finite ones."""
    s = F.col(seconds)
    ok = F.coalesce(~F.isnan(s) & (F.abs(s) != float("inf")) & (s > 0), F.lit(False))
    ends = samples.groupBy(key).agg(F.min(s).alias("least"), F.max(s).alias("most"), F.bool_and(ok).alias("valid"))
    middle = medians(samples, key, seconds).withColumnRenamed(key, "_key")
    return ends.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "median", "least", "most", "valid")


def comparable(records: DataFrame) -> DataFrame:
    """The timing records (error, tolerance, seconds, converged, ...) that may be compared: converged, within their tolerance, finite and positive."""
    good = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    e, t, s = F.col("error"), F.col("tolerance"), F.col("seconds")
    return records.filter(F.col("converged") & good(e) & good(t) & good(s) & (e >= 0) & (t > 0) & (e <= t) & (s > 0))


def batch_counts(runs: DataFrame, wall_seconds: float) -> DataFrame:
    """completed, failed, runs_per_second of a table of runs with a status."""
    done = F.count_if(F.col("status") == "completed")
    return runs.agg(done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), (done / F.lit(float(wall_seconds))).alias("runs_per_second"))
