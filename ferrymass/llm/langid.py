"""Language ID: an interpolated Kneser-Ney character model of order four per language.

Texts are lower-cased, other characters than letters become single spaces, and
every character is predicted from the three before it. Counts come from all
texts outside the held-out fold, summed by Spark, and no string is left out: the
models grow with the input. A model holds sorted arrays of packed strings; looking
a string up is a binary search. Models go to the tasks whole up to HELD strings;
larger ones are dealt by a string's last character but one into shards of at most
that many, and a text's cross-entropy is the sum over the shards. The language with the lowest cross-entropy per character wins; a
temperature fitted on a bounded sample of texts that the counts leave out turns
entropies into a score, and texts whose best entropy lies above a calibrated bar
can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm.folds import held_out
from ferrymass.llm.store import persist, small_batches

ORDER = 4
#: Strings in a shard of the models, all languages together: about 64 MB in a task. More make more shards; only one character's own strings can exceed it.
HELD = 2_000_000
#: One id in so many is left out of the counts and calibrates, and texts that do, at most: those of the least hash of id and text.
LEFT_OUT = 32
CALIBRATION = 1000
DISCOUNT = 0.75
UNKNOWN = "und"
CHUNK = 1 << 20

_U = np.uint64
_letter = np.array([chr(i).isalpha() for i in range(65536)])


def _codes(text: str) -> np.ndarray:
    """16-bit codes of the letters of a text, with one space for each run of anything else. Letters beyond 16 bits fold into them."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter[np.minimum(raw, 65535)]
    if len(raw) and raw.max() > 65535:
        high = raw > 65535
        letter[high] = [chr(c).isalpha() for c in raw[high].tolist()]
    code = np.where(letter, raw & 0xFFFF, 32).astype(_U)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return code[keep]


def _grams(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first, strings of each, and all strings packed 16 bits a character, the last one lowest."""
    first, held, size = 0, [], 0

    def flush():
        count = np.array([len(c) for c in held])
        code = np.concatenate(held)
        inner = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
        gram = code.copy()
        for j in range(1, ORDER):
            before = np.full(len(code), 32, _U)
            before[j:] = code[: len(code) - j] if j < len(code) else before[j:]
            gram |= np.where(inner >= j, before, _U(32)) << _U(16 * j)
        return first, count, gram

    for i, text in enumerate(texts):
        code = _codes(text or "")
        if held and size + len(code) > CHUNK:
            yield flush()
            first, held, size = i, [], 0
        held.append(code)
        size += len(code)
    if held:
        yield flush()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of each language with their counts, summed over a chunk of texts before they leave the task."""
    for b in batches:
        for lang, own in b.groupby("lang"):
            for _, _, grams in _grams(own["text"].tolist()):
                gram, times = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "times": times})


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language from its four-character counts, and from how many characters come before each single one."""

    def __init__(self, grams: np.ndarray, times: np.ndarray, single: np.ndarray, before: np.ndarray):
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.back: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(ORDER, 0, -1):
            if order == 1:
                grams, times = single, before
            keys = np.sort(grams)
            times = times[np.argsort(grams, kind="stable")].astype(float)
            context = keys >> _U(16)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(times, first) if len(keys) else np.empty(0)
            self.seen.append((keys, np.maximum(times - DISCOUNT, 0) / np.repeat(total, size)))
            self.back.append((context[first], DISCOUNT * size / total))
            # Below, a string counts once for each character that comes before it.
            lower = keys & _U((1 << 16 * (order - 1)) - 1)
            grams, times = np.unique(lower, return_counts=True)
        self.floor = 1.0 / (len(single) + 1)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor)
        for order in range(1, ORDER + 1):
            key = grams & _U((1 << 16 * order) - 1) if order < 4 else grams
            p = _find(*self.seen[ORDER - order], key, 0.0) + _find(*self.back[ORDER - order], key >> _U(16), 1.0) * p
        return p


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Shard:
    """All languages' models of the strings whose last character but one has a code from lo up to hi.

    All that the probability of such a string needs, but for the single
    characters, has that character in it too, so a shard is whole in itself.
    """

    def __init__(self, models: dict[str, KneserNey], lo: int = 0, hi: int = 1 << 16):
        self.models, self.lo, self.hi = models, lo, hi

    def sums(self, texts) -> Iterator[tuple[int, np.ndarray]]:
        """For each text its characters and, by language, the nats of those that are the shard's."""
        for _, count, grams in _grams(texts):
            kinds, which = np.unique(grams, return_inverse=True)
            last = (kinds >> _U(16)) & _U(0xFFFF)
            own = (last >= _U(self.lo)) & (last < _U(self.hi))
            cost = np.zeros((len(self.models), len(kinds)))
            for lang, m in enumerate(self.models.values()):
                cost[lang, own] = -np.log(m.probability(kinds[own]))
            ends = np.cumsum(count)
            some = count > 0
            sums = np.zeros((len(cost), len(count)))
            if len(grams):
                for lang in range(len(cost)):
                    sums[lang, some] = np.add.reduceat(cost[lang][which], (ends - count)[some])
            for k, c in enumerate(count.tolist()):
                yield c, sums[:, k]


class Choice:
    """How cross-entropies become a language and a score: temperature, and the bar for rejection."""

    def __init__(self, names: list[str]):
        self.names = names
        self.temperature = 10.0
        self.bar = np.inf

    def pick(self, chars: int, nats: np.ndarray, reject: bool) -> tuple[str, float]:
        if not chars or not self.names:
            return UNKNOWN, 0.0
        h = nats / chars
        if reject and h.min() > self.bar:
            return UNKNOWN, 0.0
        odds = np.exp(-(h - h.min()) * self.temperature)
        return self.names[int(h.argmin())], float(1 / odds.sum())

    def calibrate(self, chars: np.ndarray, nats: np.ndarray, langs: list[str]) -> Choice:
        """Temperature of the best likelihood, and a bar one deviation over the highest entropy of a text told right."""
        some = np.array([i for i in np.flatnonzero(chars) if langs[i] in self.names], np.int64)
        if len(some):
            h = nats[some] / chars[some, None]
            own = np.array([self.names.index(langs[i]) for i in some])
            gap = h - h.min(axis=1, keepdims=True)

            def loss(t: float) -> float:
                return float(np.mean(gap[np.arange(len(own)), own] * t + np.log(np.exp(-gap * t).sum(axis=1))))

            self.temperature = min((2.0**k for k in range(9)), key=loss)
            right = h.min(axis=1)[h.argmin(axis=1) == own]
            if len(right):
                self.bar = float(right.max() + right.std())
        return self


def _ranges(counts: DataFrame, held: int) -> list[tuple[int, int]]:
    """Ranges of the last character but one, each with at most held strings unless it is a single character."""
    per = counts.groupBy(_middle().alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect()
    edges, size = [0], 0
    for c, n in per:
        if size and size + n > held:
            edges.append(c)
            size = 0
        size += n
    return list(zip(edges, [*edges[1:], 1 << 16], strict=True))


def _middle() -> Column:
    return F.shiftrightunsigned("gram", 16).bitwiseAND(0xFFFF)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = HELD) -> tuple[Choice, list[Broadcast]]:
    """Models of every language that the rows outside the held-out fold name, a shard at a time. Rows without text or language teach nothing."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("own"))
    apart = (F.pmod("own", F.lit(LEFT_OUT)) == 0)
    counts = rows.filter(~apart).select("lang", "text").mapInPandas(_count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    counts = persist(counts, "langid-counts")
    pairs = counts.select("lang", F.col("gram").bitwiseAND(0xFFFFFFFF).alias("gram")).distinct()
    single = pairs.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count("*").alias("times")).toPandas()
    names = sorted(single["lang"].unique().tolist())
    # Hashes first, so that a sort carries no texts; the texts then stay with the tasks, which send sums.
    marked = rows.filter(apart).withColumn("row", F.xxhash64("own", "lang", "text"))
    chosen = marked.select("row").distinct().orderBy("row").limit(CALIBRATION)
    sample = persist(marked.join(F.broadcast(chosen), "row", "left_semi").select("row", "lang", "text"), "langid-sample")
    chars, nats, langs = {}, {}, {}
    shards = []
    for lo, hi in _ranges(counts, held):
        own = counts.filter((_middle() >= lo) & (_middle() < hi)).toPandas()
        models = {}
        for lang in names:
            many, one = own[own["lang"] == lang], single[single["lang"] == lang]
            models[lang] = KneserNey(many["gram"].to_numpy(np.int64).astype(_U), many["times"].to_numpy(np.int64), one["gram"].to_numpy(np.int64).astype(_U), one["times"].to_numpy(np.int64))
        shard = docs.sparkSession.sparkContext.broadcast(Shard(models, lo, hi))
        told = sample.select("row", "lang", "text").mapInPandas(_partial(shard, ["row", "lang"]), "row long, lang string, chars long, nats array<double>")
        for r in told.dropDuplicates(["row"]).collect():  # at most CALIBRATION rows of sums
            chars[r["row"]], langs[r["row"]] = r["chars"], r["lang"]
            nats[r["row"]] = nats.get(r["row"], 0.0) + np.array(r["nats"], float)
        shards.append(shard)
    order = sorted(chars)
    table = np.array([nats[k] for k in order]).reshape(len(order), len(names))
    return Choice(names).calibrate(np.array([chars[k] for k in order], np.int64), table, [langs[k] for k in order]), shards


def _partial(shard: Broadcast, keys: list[str]):
    """Characters and nats of each row, as far as one shard tells, beside its keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = list(shard.value.sums(b["text"].tolist()))
            yield b[keys].assign(chars=[c for c, _ in told], nats=[s.tolist() for _, s in told])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject: bool = False, held: int = HELD) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    A null text or one without a letter is und with score 0, as is every text if
    nothing could be learnt; with reject, so is one that fits no language. Of
    languages that tie the first by name wins. Repeated rows give rows each, an
    empty table none; other columns play no part. Models of more than held
    strings are sent out in shards, whose sums for a row are added up; that
    changes no result.
    """
    small_batches(docs.sparkSession)
    choice, shards = learn(docs, id_col, text_col, lang_col, held)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    answer = "struct<lang_pred:string,score:double>"

    if len(shards) == 1:

        @F.pandas_udf(answer)
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([choice.pick(c, s, reject) for c, s in shards[0].value.sums(texts.tolist())], columns=["lang_pred", "score"])

        told = rows.select("_id", "held_out", predict("text").alias("p"))
    else:

        @F.pandas_udf(answer)
        def decide(chars: pd.Series, nats: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([choice.pick(c, np.asarray(s, float), reject) for c, s in zip(chars, nats, strict=True)], columns=["lang_pred", "score"])

        rows = persist(rows.withColumn("row", F.expr("uuid()")), "langid-rows")
        parts = [rows.select("row", "text").mapInPandas(_partial(s, ["row"]), "row string, chars long, nats array<double>") for s in shards]
        sums = [F.sum(F.element_at("nats", k + 1)) for k in range(len(choice.names))]
        added = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.max("chars").alias("chars"), F.array(*sums).alias("nats"))
        told = rows.join(added, "row").select("_id", "held_out", decide("chars", "nats").alias("p"))
    return told.select(F.col("_id").alias(id_col), "held_out", "p.*")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
