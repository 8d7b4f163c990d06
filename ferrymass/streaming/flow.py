"""Gradient flows of many problems at once: a trajectory table that grows by a chunk of steps, with resumable state.

State is one row per problem (problem, time, rho, status). A step advances a
problem's time and mass only if it converged; a chunk can be run again from the
last written state, and as a stream every micro-batch of requests advances the
problems it names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrymass.operators.measures import finite
from ferrymass.plans import grouped

STATE = "problem string, time double, rho array<double>, status int"
TRAJECTORY = "problem string, slot int, time double, rho array<double>, status int, iterations int, error double, objective double"


def line_cost(n: int) -> np.ndarray:
    x = (np.arange(n) + 0.5) / n
    return (x[:, None] - x[None]) ** 2


def energy_of(kind: str | Callable, n: int, weight: float = 1.0):
    """An energy on n even cells of the unit interval: one of three by name, or what a function makes of n and the weight.

    Any object with value(rho), gradient(rho) and prox(z, alpha) is an energy.
    """
    if callable(kind):
        return kind(n, weight)
    return {"entropy": lambda: grouped.Entropy(np.full(n, 1.0 / n), weight), "quadratic": lambda: grouped.Quadratic(np.full(n, 1.0 / n), weight), "potential": lambda: grouped.Potential((np.arange(n) + 0.5) / n * weight)}[kind]()


def initialize(starts: DataFrame) -> DataFrame:
    """STATE of problems (problem, rho) at time 0: converged, or invalid where a cell is null, not finite or negative, or all are zero."""
    cells = F.transform("rho", lambda x: F.coalesce(finite(x) & (x >= 0), F.lit(False)))
    total = F.aggregate("rho", F.lit(0.0), lambda a, x: a + x)
    fit = F.coalesce(F.forall(cells, lambda x: x) & (total > 0), F.lit(False))
    return starts.select("problem", F.lit(0.0).alias("time"), "rho", F.when(fit, grouped.OK).otherwise(grouped.INVALID).alias("status"))


def resume(trajectory: DataFrame) -> DataFrame:
    """STATE of each problem's last slot, from which another chunk goes on."""
    last = F.max_by(F.struct("time", "rho", "status"), "slot").alias("s")
    return trajectory.groupBy("problem").agg(last).select("problem", "s.*")


def run_chunk(state: DataFrame, energy: str | Callable, dt: float, steps: int, tolerance: float, limit: int, backend: str = "pdhg", epsilon: float = 0.1, stride: int = 1, weight: float = 1.0, geometry: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """TRAJECTORY of the problems of a STATE table: slot 0 is where they start, then every stride steps.

    objective is what the slot's last step minimised, null where no step ended.
    geometry makes the cost between n cells, squared distances on the unit
    interval if none is given. A problem whose state is not converged stays where
    it is, with its status.
    """

    advance = partial(_advance, energy=energy, dt=dt, steps=steps, tolerance=tolerance, limit=limit, backend=backend, epsilon=epsilon, stride=stride, weight=weight, geometry=geometry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _table([row for r in batch.itertuples() for row in advance(r.problem, np.array(r.rho, float), float(r.time), int(r.status))])

    return state.mapInPandas(run, TRAJECTORY)


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRAJECTORY.split(", ")])


def _advance(problem: str, rho: np.ndarray, time: float, status: int, *, energy, dt, steps, tolerance, limit, backend="pdhg", epsilon=0.1, stride=1, weight=1.0, geometry=None) -> list[tuple]:
    """TRAJECTORY rows of one problem's chunk of steps."""
    out = [(problem, 0, time, rho.tolist(), status, 0, 0.0, None)]
    cost, model = (geometry or line_cost)(len(rho)), energy_of(energy, len(rho), weight)
    got = {"iterations": 0, "error": 0.0}
    for step in range(1, steps + 1):
        if status == grouped.OK:
            got = grouped.pdhg_step(cost, rho, model, dt, tolerance, limit) if backend == "pdhg" else grouped.entropic_step(cost, rho, model, dt, epsilon, tolerance, limit)
            status = got["status"]
            if status == grouped.OK:
                rho, time = got["rho"], time + dt
        if step % stride == 0:
            out.append((problem, step // stride, time, rho.tolist(), status, got["iterations"], got["error"], got.get("objective")))
    return out


def run_stream(requests: DataFrame, out: str, checkpoint: str, **options):
    """A query over a stream of STATE rows that appends each micro-batch's trajectories to a Parquet table."""
    return requests.writeStream.foreachBatch(lambda batch, _: run_chunk(batch, **options).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keyed state lies in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_keyed_stream(requests: DataFrame, out: str, checkpoint: str, **options):
    """A query over a stream of requests (problem, rho) that keeps each problem's flow in keyed state and appends TRAJECTORY rows to a Parquet table.

    The first request of a problem brings the density it starts from; each request
    advances it by a chunk of steps, slot 0 of which is where it stands. Time,
    density and status are state, so a stream that stops goes on where it was, and
    a failed step leaves time and density in place; its status stays until a
    request brings a new density.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    class Flow(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("flow", "time double, rho array<double>, status int")

        def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
            for batch in rows:
                for own in batch["rho"]:
                    held = self.state.get() if self.state.exists() else None
                    if own is not None and (held is None or held[2] != grouped.OK):
                        rho = np.asarray(own, float)
                        fit = len(rho) and np.isfinite(rho).all() and (rho >= 0).all() and rho.sum() > 0
                        held = (0.0 if held is None else held[0], rho.tolist(), grouped.OK if fit else grouped.INVALID)
                    if held is None:
                        continue
                    done = _advance(key[0], np.array(held[1], float), float(held[0]), int(held[2]), **options)
                    self.state.update((done[-1][2], done[-1][3], done[-1][4]))
                    yield _table(done)

        def close(self) -> None:
            pass

    kept = requests.groupBy("problem").transformWithStateInPandas(statefulProcessor=Flow(), outputStructType=TRAJECTORY, outputMode="append", timeMode="none")
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
