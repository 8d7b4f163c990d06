"""Quality classifier: a factorisation machine over hashed words and structure statistics of whole texts.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]),
so the pairwise terms cost linear time. The model is fitted on the driver with at
most SAMPLE labelled rows and is a fixed-size table (about 0.3 MB); every row is
scored in Arrow tasks from its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm import kernels
from ferrymass.llm.folds import held_out
from ferrymass.llm.store import small_batches

#: Most labelled rows that a model is fitted on; those with the smallest hash of their id.
SAMPLE = 4000
BUCKETS = 1 << 13
FACTORS = 8
THRESHOLD = 0.7
EPOCHS = 6

#: Structure statistics; each is cut into BINS steps, and each step is a feature of its own.
STATS = ("upper", "digit", "symbol", "other punctuation", "line ends", "word length", "distinct words", "top word", "words", "bytes", "distinct pairs")
BINS = 12
WIDTH = BUCKETS + len(STATS) * BINS

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "*%&#$|<>{}[]=_~^\\@+"]] = 3
_CLASS[[ord(c) for c in "!?.,;:'\"()-/`"]] = 4
_CLASS[10] = 5


def _statistics(text: str | None, words: np.ndarray, counts: np.ndarray) -> list[float]:
    blob = (text or "").encode("utf-8", "surrogatepass")
    n, m = max(len(blob), 1), max(len(words), 1)
    kinds = np.zeros(6)
    for at in range(0, len(blob), kernels.SLICE):
        kinds += np.bincount(_CLASS[np.frombuffer(blob[at : at + kernels.SLICE], np.uint8)], minlength=6)
    distinct = len(counts)
    pairs = len(np.unique(words[:-1] * np.uint64(3) + words[1:])) / max(m - 1, 1) if len(words) > 1 else 1.0
    return [
        *np.sqrt(kinds[1:] / n).tolist(),
        min(n / m / 24, 1.0),
        distinct / m,
        float(np.sqrt(counts.max() / m)) if distinct else 0.0,
        min(np.log2(1 + m) / 16, 1.0),
        min(np.log2(1 + n) / 20, 1.0),
        pairs,
    ]


def features(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text. Words share a weight of 1; every statistic has one of 1."""
    texts = list(texts)
    first = len(texts) and 0
    for first, counts, hashes in kernels.word_hashes(texts):
        at = 0
        for k, c in enumerate(counts.tolist()):
            words = hashes[at : at + c]
            at += c
            kinds, times = np.unique(words, return_counts=True)
            stats = np.array(_statistics(texts[first + k], words, times))
            steps = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
            spot = BUCKETS + np.arange(len(STATS)) * BINS + steps
            bucket = (kinds % np.uint64(BUCKETS)).astype(np.int64)
            value = times / np.sqrt((times.astype(float) ** 2).sum()) if c else times.astype(float)
            yield np.concatenate([spot, bucket]), np.concatenate([np.ones(len(STATS)), value])


class Machine:
    """Weights of a factorisation machine and its arithmetic on sparse rows."""

    def __init__(self, bias: float = 0.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = bias
        self.w = np.zeros(WIDTH)
        self.v = rng.normal(0, 0.02, (WIDTH, FACTORS))

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray):
        """Score before the sigmoid for rows laid end to end, and the factor sums that the gradient needs."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, start, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[index] * value, start) + pairs, sums, vx

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> Machine:
        rng = np.random.default_rng(11)
        sw, sv = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                index = np.concatenate([rows[i][0] for i in own])
                value = np.concatenate([rows[i][1] for i in own])
                size = np.array([len(rows[i][0]) for i in own])
                raw, sums, vx = self.raw(index, value, np.cumsum(size) - size)
                error = (1 / (1 + np.exp(-raw)) - label[own]) / len(own)
                each = np.repeat(error, size)
                gw = np.bincount(index, each * value, WIDTH) + decay * self.w
                inner = (each * value)[:, None] * (np.repeat(sums, size, axis=0) - vx)
                gv = np.stack([np.bincount(index, inner[:, f], WIDTH) for f in range(FACTORS)], axis=1) + decay * self.v
                sw += gw**2
                sv += gv**2
                self.bias -= rate * error.sum()
                self.w -= rate * gw / np.sqrt(sw)
                self.v -= 0.3 * rate * gv / np.sqrt(sv)
        return self

    def scores(self, texts) -> np.ndarray:
        out = []
        for index, value in features(texts):
            out.append(self.raw(index, value, np.array([0]))[0][0])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most sample labelled rows outside the held-out fold.

    Rows without an id or with a label other than 0 or 1 teach nothing; of
    labels that disagree on an id the smaller counts. Without labels of both
    kinds the machine knows only their share, or 0.5 for none.
    """
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = marked.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(features(b["_text"].tolist()))
            yield pd.DataFrame({"_id": b["_id"], "label": b["_label"], "index": [i.astype("<i4").tobytes() for i, _ in rows], "value": [v.astype("<f4").tobytes() for _, v in rows]})

    # Of an id with several texts the one of the least hash teaches, so a fit is the same each time.
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    found = one.mapInPandas(prepare, "_id long, label int, index binary, value binary").toPandas().sort_values("_id")
    label = found["label"].to_numpy(float)
    share = float(np.clip((label.sum() + 1) / (len(label) + 2), 0.01, 0.99))
    model = Machine(float(np.log(share / (1 - share))))
    if len(set(label.tolist())) < 2:
        model.v[:] = 0
        return model
    rows = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(found["index"], found["value"], strict=True)]
    return model.fit(rows, label)


def score_column(model: Machine, text_col: str = "text", spark: SparkSession | None = None) -> Column:
    """Score between 0 and 1 of a text column; higher: label 1 likelier. Null and empty texts have one too."""
    shared = spark.sparkContext.broadcast(model) if spark else None

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value if shared else model
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()), dtype="float64")

    return score(F.coalesce(F.col(text_col), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows get a row each, an empty table none."""
    model = fit(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(model, text_col, docs.sparkSession).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns as they were.

    A row goes by its own text, null counting as empty, so repeated rows stay or
    go together and ids have no part in the decision; a score at the threshold
    stays. Without labels of both kinds all rows have one score. An empty table
    stays empty.
    """
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(score_column(model, text_col, docs.sparkSession) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
