"""Benchmark decontamination: passages of every text query a BM25 index of the test items.

Impacts are scaled so that an item scores 1 against itself. Each item's postings
are split into frequent ones, whose impacts sum to at most SLACK, and the
others. Postings lie in blocks of items, and a term keeps the largest impact it
has in a block. As in block-max WAND, a passage scores the items of a block only
where the block's bound, the sum of its terms' maxima plus the most that frequent
terms can add, reaches the threshold; every item that reaches the threshold is
therefore retrieved. Retrieved items are then verified on five-word shingles of
the whole text: at least OVERLAP of the item's, with its question and its answer
each covered to at least PART.

The index goes to every task. It is built from at most SHARD_CHARS characters of
items; a larger test set is dealt into shards, each of which reads the texts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm import kernels
from ferrymass.llm.store import small_batches

OVERLAP = 0.75
PART = 0.5
BOUND = 0.5
SLACK = 0.25
BLOCK = 16
#: Words of an index entry at most; a longer item makes several. Passages have twice as many and half of them in common with the next.
ENTRY = 128
SHARD_CHARS = 16_000_000
K1, B = 1.2, 0.75

_HITS = "array<struct<item_id:bigint,bm25:double,question_overlap:double,answer_overlap:double>>"


def _hashes(text: str) -> np.ndarray:
    return next(iter(kernels.word_hashes([text])))[2]


def question_words(text: str) -> int:
    """Words before the last sentence, which is taken as the answer with as many words before it as make five; of a single sentence, two thirds of its words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    return max(0, min(ends[-1], len(words) - kernels.SHINGLE)) if ends else -(-2 * len(words) // 3)


class Index:
    """Postings of one shard of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.short: dict[bytes, list[int]] = {}
        entries: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = _hashes(text or "")
            if not len(words):
                continue
            n = len(words)
            if n < kernels.SHINGLE:
                self.short.setdefault(words.tobytes(), []).append(item_id)
                continue
            k = kernels.SHINGLE
            answer = np.arange(n - k + 1) + k > question_words(text)
            self.items.append((item_id, kernels.windows(words), answer))
            entries += [(len(self.items) - 1, words[a : a + ENTRY]) for a in range(0, n, ENTRY)]
        self.owner = np.array([o for o, _ in entries], np.int64)
        kinds = [np.unique(w, return_counts=True) for _, w in entries]
        self.terms = np.unique(np.concatenate([t for t, _ in kinds])) if kinds else np.empty(0, np.uint64)
        if not kinds:
            return
        n = len(kinds)
        row = np.repeat(np.arange(n), [len(t) for t, _ in kinds])
        term = np.searchsorted(self.terms, np.concatenate([t for t, _ in kinds]))
        tf = np.concatenate([c for _, c in kinds]).astype(float)
        df = np.bincount(term, minlength=len(self.terms))
        length = np.bincount(row, tf, n)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / length.mean()))
        impact /= np.bincount(row, impact, n)[row]
        order = np.lexsort((term, -df[term], row))
        row, term, impact = row[order], term[order], impact[order]
        running = np.cumsum(impact)
        before = running - impact
        since = running - before[np.searchsorted(row, np.arange(n))][row]
        frequent = since <= SLACK
        self.base = np.bincount(row, impact * frequent, n)
        self.entry = [(term[a:b], impact[a:b]) for a, b in zip(np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right"), strict=True)]
        self.blocks = -(-n // BLOCK)
        self.block_base = np.array([self.base[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        key = term[~frequent] * self.blocks + row[~frequent] // BLOCK
        pairs, inverse = np.unique(key, return_inverse=True)
        peak = np.zeros(len(pairs))
        np.maximum.at(peak, inverse, impact[~frequent])
        self.post_block, self.post_peak = pairs % self.blocks, peak
        self.post_start = np.searchsorted(pairs // self.blocks, np.arange(len(self.terms) + 1))
        by_term = np.argsort(term[~frequent], kind="stable")
        self.deep_entry, self.deep_impact = row[~frequent][by_term], impact[~frequent][by_term]
        self.deep_start = np.searchsorted(term[~frequent][by_term], np.arange(len(self.terms) + 1))
        self.rare = np.zeros(1 << 16, bool)
        self.rare[(self.terms[np.diff(self.post_start) > 0] & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _terms(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words that are terms; -1 for the others."""
        spot = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[spot] == words, spot, -1)

    def retrieve(self, counts: np.ndarray, words: np.ndarray) -> dict[int, dict[int, float]]:
        """For each text the items whose best passage scores BOUND or more, with that score."""
        found: dict[int, dict[int, float]] = {}
        if not len(self.terms) or not len(words):
            return found
        known = np.flatnonzero(self.rare[(words & np.uint64(0xFFFF)).astype(np.int64)])
        term = self._terms(words[known])
        known, term = known[term >= 0], term[term >= 0]
        rare = self.post_start[term + 1] > self.post_start[term]
        known, t = known[rare], term[rare]
        if not len(known):
            return found
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, known, "right")
        inner = known - (ends - counts)[doc]
        # Half passages of ENTRY words; passage p of a text has its halves p and p + 1.
        halves = -(-counts // ENTRY)
        base = np.cumsum(halves) - halves
        h = base[doc] + inner // ENTRY
        both = np.concatenate([h, np.where(inner >= ENTRY, h - 1, -1)])
        keep = both >= 0
        pair = np.unique(both[keep] * len(self.terms) + np.concatenate([t, t])[keep])
        passage, pt = pair // len(self.terms), pair % len(self.terms)
        cells, which, peaks = _spread(passage, self.blocks, self.post_start, pt, self.post_block, self.post_peak)
        bound = np.bincount(which, peaks, len(cells)) + self.block_base[cells % self.blocks]
        live = cells[bound >= BOUND - 1e-9]
        if not len(live):
            return found
        # The items of live blocks: their own impacts in place of the block's maxima.
        here = np.isin(passage, live // self.blocks)
        n = len(self.entry)
        cells, which, impacts = _spread(passage[here], n, self.deep_start, pt[here], self.deep_entry, self.deep_impact)
        bound = np.bincount(which, impacts, len(cells)) + self.base[cells % n]
        cells = cells[bound >= BOUND - 1e-9]
        has = np.zeros(len(self.terms), bool)
        for p, group in _runs(cells // n, cells % n):
            d = int(np.searchsorted(base + halves, p, "right"))
            first = int(ends[d] - counts[d]) + (p - int(base[d])) * ENTRY
            mine = self._terms(words[first : min(first + 2 * ENTRY, int(ends[d]))])
            mine = mine[mine >= 0]
            has[mine] = True
            for e in group:
                terms, impact = self.entry[e]
                score = float(impact[has[terms]].sum())
                if score >= BOUND - 1e-9:
                    best = found.setdefault(d, {})
                    best[int(self.owner[e])] = max(score, best.get(int(self.owner[e]), 0.0))
            has[mine] = False
        return found

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """Verified items of each text."""
        out: list[list[dict]] = []
        for _, counts, words in kernels.word_hashes(texts):
            found = self.retrieve(counts, words)
            at = 0
            for k, c in enumerate(counts.tolist()):
                own = words[at : at + c]
                at += c
                hits = [{"item_id": i, "bm25": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0} for i in self.short.get(own.tobytes(), [])] if c and c < kernels.SHINGLE else []
                if k in found:
                    have = next(kernels.shingles(np.array([c]), own))
                    for item, score in found[k].items():
                        item_id, run, answer = self.items[item]
                        met = np.isin(run, have)
                        q = float(met[~answer].mean()) if (~answer).any() else float(met.mean())
                        a = float(met[answer].mean()) if answer.any() else float(met.mean())
                        if met.mean() >= OVERLAP and q >= PART and a >= PART:
                            hits.append({"item_id": item_id, "bm25": score, "question_overlap": q, "answer_overlap": a})
                out.append(sorted(hits, key=lambda x: x["item_id"]))
        return out


def _spread(passage: np.ndarray, width: int, start: np.ndarray, term: np.ndarray, column: np.ndarray, weight: np.ndarray):
    """Cells (passage, column) that the terms' postings reach, and each posting's cell and weight."""
    span = start[term + 1] - start[term]
    at = np.repeat(start[term] - (np.cumsum(span) - span), span) + np.arange(span.sum())
    cells, which = np.unique(np.repeat(passage, span) * width + column[at], return_inverse=True)
    return cells, which, weight[at]


def _runs(keys: np.ndarray, values: np.ndarray):
    if not len(keys):
        return
    edges = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
        yield int(keys[a]), values[a:b].tolist()


def _shards(bench: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a shard of at most about SHARD_CHARS characters at a time. Null ids and texts without words match nothing."""
    items = bench.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("_i"), F.col(text_col).alias("_t"))
    size = items.agg(F.sum(F.length("_t") + 16)).first()[0] or 0
    shards = -(-2 * size // SHARD_CHARS) if size > SHARD_CHARS else 1
    for s in range(shards):
        yield [(r["_i"], r["_t"]) for r in items.filter(F.pmod(F.xxhash64("_i", "_t"), F.lit(shards)) == s).collect()]


def _hits(spark: SparkSession, items: list[tuple[int, str]], text_col: str) -> Column:
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Index(items))

    @F.pandas_udf(_HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scan(texts.tolist()), dtype=object)

    return scan(F.coalesce(F.col(text_col), F.lit("")))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap: a row for each text and each test item that it holds.

    Null and empty texts hold nothing, nor does anything hold an item without
    words; an item of fewer than five words is held only by a text that is just
    that. Items that repeat count each; repeated rows of docs give rows each.
    """
    parts = [docs.select(F.col(id_col).alias("doc_id"), F.explode(_hits(docs.sparkSession, items, text_col)).alias("h")).select("doc_id", "h.*") for items in _shards(bench, item_col, item_text_col)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, columns as they were. Nothing shuffles.

    A row goes by its own text: null and empty texts stay, repeated rows stay or
    go together, and ids, null or shared, have no part. Without test items, or
    for an empty table, docs is as it was.
    """
    for items in _shards(bench, item_col, item_text_col):
        docs = docs.filter(F.size(_hits(docs.sparkSession, items, text_col)) == 0)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
