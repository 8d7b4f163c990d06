"""Hermitian matrices in blocks: products, the nearest positive semidefinite matrix, Gibbs states and definiteness, of matrices that no row holds.

A matrix is a table of square blocks (problem, bi, bj, re, im), both arrays row by
row, with zeros beyond the matrix's own n rows (problem, n). A product joins blocks by their inner number, tasks
multiply pairs of blocks, and a shuffle adds up each block's terms. Everything
else is products, sums and one number a problem: the sign of a matrix by a
Newton-Schulz iteration, its exponential by scaling and squaring, and definiteness
by elimination block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist, remove
from ferrymass.operators.measures import finite

#: Rows of a block: 1 MB of numbers.
BLOCK = 256
SCHEMA = "problem string, bi int, bj int, re array<double>, im array<double>"
#: Steps of the sign iteration at most: eigenvalues of under 1.5^-STEPS of the norm count as zero.
STEPS = 60


def blocks(matrix: DataFrame, size: int = BLOCK) -> DataFrame:
    """SCHEMA of a matrix (problem, r, c, re, im); entries that are absent are zero, blocks without an entry too."""
    at = (F.pmod("r", F.lit(size)) * size + F.pmod("c", F.lit(size))).cast("int")
    own = matrix.groupBy("problem", F.floor(F.col("r") / size).cast("int").alias("bi"), F.floor(F.col("c") / size).cast("int").alias("bj"))
    packed = own.agg(F.collect_list(F.struct(at.alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("e"))  # size * size entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = np.zeros(size * size, complex)
                np.add.at(x, [e["at"] for e in r.e], [complex(e["re"], e["im"]) for e in r.e])
                yield _row(r.problem, r.bi, r.bj, x)

    return packed.mapInPandas(run, SCHEMA)


def entries(matrix: DataFrame, size: int, n: int | None = None) -> DataFrame:
    """problem, r, c, re, im of a matrix in blocks, the first n rows and columns."""
    long = matrix.select("problem", "bi", "bj", F.posexplode(F.arrays_zip("re", "im")).alias("at", "e"))
    out = long.select("problem", (F.col("bi") * size + F.floor(F.col("at") / size)).cast("long").alias("r"), (F.col("bj") * size + F.col("at") % size).cast("long").alias("c"), "e.re", "e.im")
    return out if n is None else out.filter((F.col("r") < n) & (F.col("c") < n))


def _row(problem, bi: int, bj: int, x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"problem": [problem], "bi": np.array([bi], np.int32), "bj": np.array([bj], np.int32), "re": [x.real.ravel()], "im": [x.imag.ravel()]})


def _square(re, im) -> np.ndarray:
    x = np.asarray(re) + 1j * np.asarray(im)
    return x.reshape(math.isqrt(len(x)), -1)


def _add(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    return pd.DataFrame({"problem": [first["problem"]], "bi": [first["bi"]], "bj": [first["bj"]], "re": [np.sum(np.stack(group["re"]), axis=0)], "im": [np.sum(np.stack(group["im"]), axis=0)]})


def product(a: DataFrame, b: DataFrame, scale: float = 1.0, plus: DataFrame | None = None) -> DataFrame:
    """scale * A B + plus."""
    right = b.select("problem", F.col("bi").alias("k"), F.col("bj").alias("j"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    met = a.withColumnRenamed("bj", "k").join(right, ["problem", "k"]).select("problem", "bi", "j", "re", "im", "re2", "im2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for t in batches:
            for r in t.itertuples():
                x = scale * (_square(r.re, r.im) @ _square(r.re2, r.im2))
                key = r.problem, r.bi, r.j
                sums[key] = sums[key] + x if key in sums else x
                if len(sums) >= 64:  # sums of 64 blocks at a time
                    for k in list(sums):
                        yield _row(*k, sums.pop(k))
        for k, x in sums.items():
            yield _row(*k, x)

    terms = met.mapInPandas(run, SCHEMA)
    return (terms if plus is None else terms.unionByName(plus)).groupBy("problem", "bi", "bj").applyInPandas(_add, SCHEMA)


def scaled(a: DataFrame, by: Column) -> DataFrame:
    """A with each entry times by, a column of a's rows."""
    return a.withColumn("_by", by).select("problem", "bi", "bj", F.expr("transform(re, x -> x * _by)").alias("re"), F.expr("transform(im, x -> x * _by)").alias("im"))


def adjoint(a: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r in t.itertuples():
                yield _row(r.problem, r.bj, r.bi, _square(r.re, r.im).conj().T)

    return a.mapInPandas(run, SCHEMA)


def total(parts: list[DataFrame]) -> DataFrame:
    """The sum of matrices."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("problem", "bi", "bj").applyInPandas(_add, SCHEMA)


def eye(dims: DataFrame, size: int, by: float = 1.0) -> DataFrame:
    """by times the identity of n rows (problem, n)."""
    own = dims.select("problem", "n", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))).alias("bi"))
    inside = lambda x: (x % (size + 1) == 0) & (F.col("bi") * size + F.floor(x / size) < F.col("n"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda x: F.when(inside(x), F.lit(float(by))).otherwise(0.0))
    return own.select("problem", "bi", F.col("bi").alias("bj"), unit.alias("re"), F.array_repeat(F.lit(0.0), size * size).alias("im"))


def _squares() -> Column:
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    return sum_of("re") + sum_of("im")


def norm(a: DataFrame) -> DataFrame:
    """problem, norm: the root of the sum of squared entries."""
    return a.groupBy("problem").agg(F.sqrt(F.sum(_squares())).alias("norm"))


def trace(a: DataFrame, size: int) -> DataFrame:
    """problem, trace: its real part."""
    own = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda s, k: s + F.get("re", k * (size + 1)))
    return a.filter("bi = bj").groupBy("problem").agg(F.sum(own).alias("trace"))


def sign(a: DataFrame, dims: DataFrame, size: int, tolerance: float = 1e-12) -> DataFrame:
    """The matrix with each eigenvalue's sign for the eigenvalue, of Hermitian a: X goes to X (3 - X^2) / 2 until it stays as it is."""
    x = persist(scaled(a.join(norm(a), "problem"), 1 / F.greatest(F.col("norm"), F.lit(1e-300))), "sign")
    for k in range(STEPS):
        inner = persist(product(x, x, -0.5, eye(dims, size, 1.5)), "sign-square")
        new = persist(product(x, inner), "sign")
        # Steps are quadratic near the end, so one in three tells soon enough.
        done = k % 3 == 2 and (total([new, scaled(x, F.lit(-1.0))]).agg(F.sum(_squares())).first()[0] or 0.0) <= tolerance**2
        remove(x, inner)
        x = new
        if done:
            break
    return x


def nearest_psd(a: DataFrame, dims: DataFrame, size: int) -> DataFrame:
    """The nearest positive semidefinite matrix: (H + H sign(H)) / 2 of the Hermitian part H."""
    h = persist(scaled(total([a, adjoint(a)]), F.lit(0.5)), "hermitian")
    turned = persist(product(h, sign(h, dims, size), 0.5, scaled(h, F.lit(0.5))), "psd")
    return scaled(total([turned, adjoint(turned)]), F.lit(0.5))


#: Terms of the exponential's series, enough for a norm of a half.
TERMS = 13


def gibbs(h: DataFrame, dims: DataFrame, size: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """exp(h / eps) over its trace, and log_z, the log of the trace, of Hermitian h by problem.

    h / eps less an upper bound of its eigenvalues, its norm, is halved until its
    norm is at most a half, its series summed, and the sum squared as often;
    every square is divided by its trace, whose logs add up. All problems are
    halved as often as the one that needs most.
    """
    bound = persist(norm(h), "gibbs-norm")
    most = bound.agg(F.max("norm")).first()[0] or 0.0
    halvings = max(0, math.ceil(math.log2(max(4 * most / eps, 1.0))))
    own = h.join(bound, "problem")
    shift = scaled(eye(dims, size).join(bound, "problem"), -F.col("norm"))
    small = persist(scaled(total([own.drop("norm"), shift]), F.lit(1.0 / (eps * 2.0**halvings))), "gibbs-small")
    x = persist(total([eye(dims, size), scaled(small, F.lit(1.0 / TERMS))]), "gibbs-series")
    for k in range(TERMS - 1, 0, -1):  # 1 + h / 1 (1 + h / 2 (1 + ...))
        new = persist(product(small, x, 1.0 / k, eye(dims, size)), "gibbs-series")
        remove(x)
        x = new
    logs = None
    for k in range(halvings + 1):
        own = persist(trace(x, size), "gibbs-trace")
        parted = persist(scaled(x.join(own, "problem"), 1 / F.col("trace")), "gibbs-part")
        step = own.select("problem", (F.log("trace") * F.lit(2.0 ** (halvings - k))).alias("log"))
        logs = step if logs is None else logs.unionByName(step)
        remove(x)
        if k < halvings:
            x = persist(product(parted, parted), "gibbs-square")
            remove(parted)
    z = logs.groupBy("problem").agg(F.sum("log").alias("log")).join(bound, "problem").select("problem", (F.col("log") + F.col("norm") / eps).alias("log_z"))
    return parted, z


def definite(a: DataFrame, dims: DataFrame, size: int) -> DataFrame:
    """problem, definite: whether a Hermitian matrix is positive definite, by elimination block by block.

    A pivot block that has no Cholesky factor ends its problem; otherwise its
    Schur complement goes on.
    """
    most, rest, bad = dims.agg(F.max("n")).first()[0] or 0, a, dims.select("problem").limit(0)
    live = dims
    for k in range(-(-most // size)):
        live = live.filter(F.col("n") > k * size)
        own = rest.filter((F.col("bi") == k) & (F.col("bj") == k)).select("problem", "re", "im")
        pivots = persist(_pivots(live.join(own, "problem", "left"), k, size), "pivots")
        lost = pivots.filter("re IS NULL").select("problem")
        bad, live = bad.unionByName(lost), live.join(lost, "problem", "left_anti")
        inverse = pivots.filter("re IS NOT NULL")
        column = rest.filter((F.col("bj") == k) & (F.col("bi") > k))
        row = rest.filter((F.col("bi") == k) & (F.col("bj") > k))
        left = rest.filter((F.col("bi") > k) & (F.col("bj") > k))
        rest = persist(product(product(column, inverse), row, -1.0, left), "schur")
    return dims.join(bad.withColumn("bad", F.lit(True)), "problem", "left").select("problem", F.col("bad").isNull().alias("definite"))


def _pivots(own: DataFrame, k: int, size: int) -> DataFrame:
    """The inverses of pivot blocks (problem, n, re, im); null where a block is absent or not positive definite."""

    def inverse(n: int, re, im) -> np.ndarray | None:
        used = min(size, n - k * size)
        if re is None or used < 1:
            return None
        x = _square(re, im)[:used, :used]
        try:
            np.linalg.cholesky((x + x.conj().T) / 2)
        except np.linalg.LinAlgError:
            return None
        out = np.zeros((size, size), complex)
        out[:used, :used] = np.linalg.inv(x)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = inverse(int(r.n), r.re, r.im)
                yield pd.DataFrame({"problem": [r.problem], "bi": np.array([k], np.int32), "bj": np.array([k], np.int32), "re": [None], "im": [None]}) if x is None else _row(r.problem, k, k, x)

    return own.mapInPandas(run, SCHEMA)


def validate(matrix: DataFrame, dims: DataFrame, tolerance: float = 1e-9, strict: bool = False, size: int = BLOCK) -> DataFrame:
    """problem, hermitian, unit_trace, positive and valid of density matrices (problem, r, c, re, im) of n rows (problem, n).

    Hermitian and of trace one within the tolerance, and with no eigenvalue below
    minus the tolerance or, if strict, none that isn't positive. The first two
    take one aggregation of the entries and their mirror images.
    """
    mirror = matrix.select("problem", F.col("c").alias("r"), F.col("r").alias("c"), (-F.col("re")).alias("re"), "im", F.lit(0.0).alias("own"), F.lit(True).alias("fit"))
    good = finite(F.col("re")) & finite(F.col("im"))
    both = matrix.select("problem", "r", "c", "re", "im", F.when(F.col("r") == F.col("c"), F.col("re")).otherwise(0.0).alias("own"), good.alias("fit")).unionByName(mirror)
    gaps = both.groupBy("problem", "r", "c").agg(F.hypot(F.sum("re"), F.sum("im")).alias("gap"), F.sum("own").alias("own"), F.bool_and("fit").alias("fit"))
    facts = gaps.groupBy("problem").agg(F.bool_and("fit").alias("fit"), (F.max("gap") <= tolerance).alias("hermitian"), (F.abs(F.sum("own") - 1) <= tolerance).alias("unit_trace"))
    facts = persist(facts, "density-facts")
    apart = facts.filter("fit AND hermitian").select("problem")
    lifted = matrix.join(apart, "problem", "left_semi")
    own = dims.join(apart, "problem", "left_semi")
    if not strict:
        unit = own.select("problem", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("r")).select("problem", "r", F.col("r").alias("c"), F.lit(2 * tolerance).alias("re"), F.lit(0.0).alias("im"))
        lifted = lifted.select("problem", "r", "c", "re", "im").unionByName(unit)
    found = definite(persist(blocks(lifted, size), "density-blocks"), own, size)
    no = F.lit(False)
    out = dims.select("problem").join(facts, "problem", "left").join(found, "problem", "left")
    out = out.select("problem", (F.coalesce("hermitian", no) & F.coalesce("fit", no)).alias("hermitian"), F.coalesce("unit_trace", no).alias("unit_trace"), F.coalesce("definite", no).alias("positive"))
    return out.withColumn("valid", F.col("hermitian") & F.col("unit_trace") & F.col("positive"))
