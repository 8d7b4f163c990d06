"""Periodic runs in texts: repeated k-gram masking, then Main-Lorentz over the segments that survive.

A run of period q and length at least max(SHORTEST, TIMES * q) overlaps itself,
moved by q, in at least max(SHORTEST - q, (TIMES - 1) * q) words, so each of its
words stands in a K-gram that the document has twice, where K is the least of
those overlaps. Words outside such K-grams can't be in a run; what is left falls
into segments. Each is halved again and again; the runs across a middle come from
the longest common extensions between the middle and the words a period away,
for all periods of a level at once. Extensions go over whole segments, so each
run is found in full at the first middle that it crosses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm.store import small_batches, tidy

SHORTEST = 24
TIMES = 3
#: The least overlap of a run with itself, over all periods.
K = min(max(SHORTEST - q, (TIMES - 1) * q) for q in range(1, SHORTEST + 1))
#: Extensions that are looked up at once.
CHUNK = 1 << 18


def masked(ids: np.ndarray) -> np.ndarray:
    """True for the words that stand in a K-gram which ids has twice or more; K-grams are told by hashes, so a few others may pass."""
    out = np.zeros(len(ids) + 1, np.int64)
    if len(ids) < SHORTEST:
        return out[:-1] > 0
    grams = np.zeros(len(ids) - K + 1, np.uint64)
    for j in range(K):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(grams)].astype(np.uint64) + np.uint64(1)
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    out[at] += 1
    out[at + K] -= 1
    return np.cumsum(out)[:-1] > 0


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For j = 0, 1, ...: a number for each stretch of 2^j words, equal for equal stretches; up to the width that none has twice, or that no two fit in."""
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(levels) - 1) <= len(ids):
        last, width = levels[-1].astype(np.int64), 1 << (len(levels) - 1)
        pairs = last[:-width] * (len(ids) + 1) + last[width:]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        if len(levels[-1]) and levels[-1].max() == len(levels[-1]) - 1:
            break  # no stretch of this width stands twice, so none that is wider does
    return levels


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from i on and from j on."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b, rank = i + got, j + got, levels[k]
        fits = np.maximum(a, b) < len(rank)
        fits[fits] = rank[a[fits]] == rank[b[fits]]
        got += fits.astype(np.int64) << k
    return got


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal before i and before j."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b, rank = i - got - (1 << k), j - got - (1 << k), levels[k]
        fits = np.minimum(a, b) >= 0
        fits[fits] = rank[a[fits]] == rank[b[fits]]
        got += fits.astype(np.int64) << k
    return got


def segment_runs(ids: np.ndarray) -> dict[tuple[int, int], int]:
    """Least period by (start, end) of the runs of ids."""
    levels, out = _ranks(ids), {}
    halves = np.array([[0, len(ids)]])
    while len(halves := halves[halves[:, 1] - halves[:, 0] >= SHORTEST]):
        middle = halves.sum(1) // 2
        most = (halves[:, 1] - halves[:, 0]) // TIMES
        ends = np.cumsum(most)
        for at in range(0, int(ends[-1]), CHUNK):
            number = np.arange(at, min(at + CHUNK, int(ends[-1])))
            which = np.searchsorted(ends, number, side="right")
            m, p = middle[which], number - (ends - most)[which] + 1
            for i in (m, m - p):  # the run's words are equal to those a period on, from the middle or from a period before it
                p_in, i_in = p[fits := (i >= 0) & (i + p <= len(ids))], i[fits]
                ahead, back = _forward(levels, i_in, i_in + p_in), _backward(levels, i_in, i_in + p_in)
                found = ahead + back >= np.maximum(SHORTEST - p_in, (TIMES - 1) * p_in)
                for start, end, period in zip((i_in - back)[found].tolist(), (i_in + p_in + ahead)[found].tolist(), p_in[found].tolist(), strict=True):
                    out[start, end] = min(period, out.get((start, end), period))
        halves = np.concatenate([np.stack([halves[:, 0], middle], 1), np.stack([middle, halves[:, 1]], 1)])
    return out


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length and period of every run of a document's words, by start and then period."""
    if len(words) < SHORTEST:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - K:
        return []  # a run repeats at least K of its words
    edge = np.diff(np.concatenate([[0], masked(ids).astype(np.int8), [0]]))
    out = []
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if end - start >= SHORTEST:
            out += [(start + s, e - s, p) for (s, e), p in segment_runs(ids[start:end]).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periodic tail that a tenth of all ids get; a null id gets none."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // len(root))))[: n - a]


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:-1] > 0


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, collapsed string"


def _scan(plant: bool, text: bool):
    def row(doc_id, own: str | None) -> tuple:
        words = (own or "").encode("utf-8", "surrogatepass").split()
        words = planted(doc_id, words) if plant else words
        found = runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        kept = b" ".join(w for w, gone in zip(words, dropped(len(words), found), strict=True) if not gone) if found else b" ".join(words)
        told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        head = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
        return (doc_id, len(found), *head, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words), kept.decode("utf-8", "surrogatepass") if text else None)

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([row(None if i is None else int(i), t) for i, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True)], columns=names, dtype=object)  # floats would round ids beside nulls
            for c in [*names[:6], "n_words"]:
                out[c] = out[c].astype("Int64")
            yield out

    return tidy(run)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, text: bool = True) -> DataFrame:
    """SCHEMA, one row for each row of docs: its runs, the one of the greatest exponent, and the text with every run cut to its first period.

    A null or empty text has no words and no runs, and repeated rows give
    repeated results; texts are met whole, one document in one task row, which
    takes some 100 bytes a word of a surviving segment. Ids are carried as text,
    so that a null id or one beyond 2^53 stays as it is. Other columns of docs
    play no part; an empty table gives no rows. plant gives a tenth of all ids
    the periodic tail of planted; without text, collapsed is null.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(_scan(plant, text), SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True, text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
