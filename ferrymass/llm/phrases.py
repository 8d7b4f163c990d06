"""Phrase collocations by pivot partitioning.

A phrase belongs to its rarest word, its pivot. Words are numbered from the most
frequent on, so the pivot is the largest number. Around each occurrence of a word
a fragment keeps the neighbours that may share a phrase which that occurrence
owns: before it smaller numbers only, after it numbers that are not larger, up to
three on a side, blanks elsewhere; so every occurrence of a phrase is in the
fragment of the first occurrence of its pivot and in no other. Equal fragments are
summed in the tasks that make them, then go to their pivot, and phrases are
counted there. A pivot with over 1/HEAVY_SHARE of all words is dealt into parts by
its fragments, whose counts are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrymass.llm.store import HEAVY_SHARE, PAGE_BITS, bit_pages, filter_bits, give_back, join_spread, persist, small_batches

#: Words of a phrase at most, and occurrences that it needs.
LONGEST, SUPPORT = 4, 30
SIDE = LONGEST - 1
#: A phrase goes if a longer one that holds it has this percentage of its occurrences.
COVER = 80
SCALE = 2_000_000
TOP = 2000
#: Words whose numbers go to every task at most: the most frequent ones, some 60 MB. Others are told by hashes.
HEAD = 1 << 18
#: Numbers of other words are above this; bits of the filter that tells tasks which words those are, at most 32 MB.
FAR, FAR_BITS = 1 << 62, 1 << 28
#: Fragments that a task sums up at once.
BUFFER = 1 << 18
#: Bytes of a text that become words at once, to the end of a piece.
SLICE = 1 << 20
#: Parts in which a language's phrases are ranked before the best of all parts are.
PARTS = 64

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z; a separator becomes a byte that no text holds.
_FOLD = bytes(0xFF if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
W = [f"w{k}" for k in range(1, LONGEST + 1)]
_SLOTS = [*(f"l{k}" for k in range(SIDE, 0, -1)), "p", *(f"r{k}" for k in range(1, SIDE + 1))]


def _tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text and, between pieces, the byte 0xFF, in runs of whole pieces of SLICE bytes or more."""
    folded = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b"\xff", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].replace(b"\xff", b" \xff ").split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, f: counts of the words of a task's texts, given out whenever BUFFER of them are held."""
    held: dict[tuple[str, bytes], int] = {}

    def out() -> pa.RecordBatch:
        langs, words = zip(*held, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["lang", "word", "f"])
        held.clear()
        return batch

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            name = lang.as_py()
            for tokens in _tokens(text.as_py()):
                for w in tokens:
                    held[name, w] = held.get((name, w), 0) + 1
            if len(held) >= BUFFER // 2:
                yield from _without_marks(held, out)
    yield from _without_marks(held, out)
    give_back()


def _without_marks(held: dict, out) -> Iterator[pa.RecordBatch]:
    for key in [k for k in held if k[1] == b"\xff"]:
        del held[key]
    if held:
        yield out()


def word_counts(base: DataFrame) -> DataFrame:
    """lang, word, f of all words of base (lang, text)."""
    return base.mapInArrow(_count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(frequent: DataFrame, head: int) -> tuple[DataFrame, DataFrame | None, int]:
    """lang, word, f, id of the frequent words; the table of those beyond the head, if any; and the seed of their numbers.

    The head, at most so many words, is cut where counts, in steps of a sixteenth
    of a doubling, get too many; its words are numbered from 1 by falling counts.
    Other words are numbered by a hash of 62 bits above 2^62; where two words of
    the table meet in one, the hash's seed changes.
    """
    step = F.floor(F.log2("f") * 16).cast("int")
    steps = frequent.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # sixteen a doubling of counts
    total, least = 0, None
    for s, n in steps:
        if (total := total + n) > head:
            break
        least = s
    order = F.row_number().over(Window.orderBy(F.desc("f"), "lang", "word")).cast("long")  # of HEAD words at most
    near = frequent.filter(step >= least if least is not None else F.lit(False)).withColumn("id", order)
    if total <= head:
        return persist(near, "phrase-words"), None, 0
    far, seed, met = frequent if least is None else frequent.filter(step < least), -1, False
    while not met:
        seed += 1
        ids = persist(far.withColumn("id", _hash(seed).bitwiseAND(F.lit(FAR - 1)).bitwiseOR(F.lit(FAR))), "phrase-far")
        met = ids.groupBy("id").count().filter("count > 1").isEmpty()
    return persist(near.unionByName(ids), "phrase-words"), ids, seed


def _hash(seed: int) -> Column:
    """No word holds a tab, so the text that is hashed is that of one language and word."""
    return F.xxhash64(F.concat(F.lit(f"{seed}-"), "lang", F.lit("\t"), "word"))


class _Numbers(dict):
    """The numbers of one language's words by their bytes: the head's as given, those of words in the filter by hash, 0 for others."""

    def __init__(self, lang: str, bits: np.ndarray | None, seed: int):
        self.prefix, self.bits, self.free = f"{seed}-{lang}\t".encode("utf-8", "surrogatepass"), bits, BUFFER

    def __missing__(self, word: bytes) -> int:
        if self.bits is None or word == b"\xff":
            return 0
        import xxhash

        h = xxhash.xxh64_intdigest(self.prefix + word, seed=42)  # as the engine's own hash
        at = h & (8 * len(self.bits) - 1)
        number = h & (FAR - 1) | FAR if self.bits[at >> 3] >> (at & 7) & 1 else 0
        if self.free:
            self.free -= 1
            self[word] = number
        return number


def _fragments(ids: np.ndarray) -> pa.Table:
    """The slots of the fragments around a row of word numbers, 0 where a phrase can't go on."""
    padded = np.concatenate([np.zeros(SIDE, np.int64), ids, np.zeros(SIDE, np.int64)])
    own = padded[SIDE : len(padded) - SIDE]
    slots = {"p": own}
    for side, sign in (("l", -1), ("r", 1)):
        open_ = own > 0
        for k in range(1, SIDE + 1):
            near = padded[SIDE + sign * k : len(padded) - SIDE + sign * k]
            open_ = open_ & (near > 0) & ((near < own) if sign < 0 else (near <= own))
            slots[f"{side}{k}"] = np.where(open_, near, 0)
    some = (slots["l1"] > 0) | (slots["r1"] > 0)
    return pa.table({c: slots[c][some] for c in _SLOTS} | {"n": np.ones(int(some.sum()), np.int64)})


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(_SLOTS, use_threads=False).aggregate([("n", "sum")]).rename_columns([*_SLOTS, "n"])


def _mapper(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bits, seed = words.value
        known: dict[str, _Numbers] = {}
        for lang, word, number in head:
            known.setdefault(lang, _Numbers(lang, bits, seed))[word] = number
        held, rows, parts = [], 0, []
        for b in batches:
            parts = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                number = known.setdefault(lang, _Numbers(lang, bits, seed)).__getitem__
                for tokens in _tokens(text.as_py()):
                    parts += map(number, tokens)
                    parts.append(0)
                    if len(parts) >= BUFFER:
                        held.append(_fragments(np.array(parts, np.int64)))
                        rows, parts = rows + held[-1].num_rows, []
                    if rows >= BUFFER:
                        yield from _summed(held).to_batches()
                        held, rows = [], 0
            held.append(_fragments(np.array(parts, np.int64)))
            rows += held[-1].num_rows
        if held:
            yield from _summed(held).to_batches()
        del known, held, parts
        give_back()

    return run


def _filter(far: DataFrame | None, seed: int) -> np.ndarray | None:
    """Bits of the far words' hashes: 2^FAR_BITS at most."""
    if far is None:
        return None
    size = min(filter_bits(far.count()), FAR_BITS)
    bits = np.zeros(size // 8, np.uint8)
    for page, own in bit_pages(far.select(F.pmod(_hash(seed), F.lit(size)).alias("at")), "at").toLocalIterator():
        bits[page * PAGE_BITS // 8 : (page + 1) * PAGE_BITS // 8] = np.frombuffer(own, np.uint8)
    return bits


def _phrases_of_fragments() -> Column:
    """The phrases of a fragment that hold its pivot, blanks last; null where the fragment is too short."""
    blank, out = F.lit(0).cast("long"), []
    for before in range(SIDE + 1):
        for after in range(SIDE + 1 - before):
            if before + after == 0:
                continue
            words = [F.col(f"l{k}") for k in range(before, 0, -1)] + [F.col("p")] + [F.col(f"r{k}") for k in range(1, after + 1)]
            ends = [F.col(f"l{before}") > 0] * (before > 0) + [F.col(f"r{after}") > 0] * (after > 0)
            padded = words + [blank] * (LONGEST - len(words))
            out.append(F.when(reduce(Column.__and__, ends), F.struct(*[w.alias(n) for w, n in zip(padded, W, strict=True)])))
    return F.array(*out)


def phrase_counts(base: DataFrame, words: DataFrame, far: DataFrame | None, seed: int, total: int, support: int = SUPPORT) -> DataFrame:
    """w1 to w4 (0 for none) and a: how often each phrase occurs, for those that do often enough."""
    near = words.filter(F.col("id") < FAR).select("lang", "word", "id").collect()  # HEAD words at most
    known = base.sparkSession.sparkContext.broadcast(([(r["lang"], r["word"].encode("utf-8", "surrogatepass"), r["id"]) for r in near], _filter(far, seed), seed))
    made = base.mapInArrow(_mapper(known), ", ".join(f"{c} long" for c in [*_SLOTS, "n"]))
    bar = max(total // HEAVY_SHARE, 1)
    # Words with over one part in HEAVY_SHARE of all occurrences: fewer than HEAVY_SHARE.
    heavy = words.filter(F.col("f") > bar).select(F.col("id").alias("p"), F.ceil(F.col("f") / bar).alias("parts"))
    dealt = made.join(F.broadcast(heavy), "p", "left").withColumn("salt", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*_SLOTS), F.col("parts"))).cast("int"))
    spread = dealt.drop("parts").repartition("p", "salt")
    local = spread.select("p", "salt", "n", F.explode(_phrases_of_fragments()).alias("w")).filter("w IS NOT NULL")
    local = local.select("p", "salt", "n", "w.*").groupBy("p", "salt", *W).agg(F.sum("n").alias("a")).filter((F.col("salt") >= 0) | (F.col("a") >= support))
    local = persist(local, "phrase-local")
    split = local.filter("salt >= 0").groupBy(*W).agg(F.sum("a").alias("a")).filter(F.col("a") >= support)
    return persist(local.filter("salt < 0").select(*W, "a").unionByName(split), "phrase-counts")


def _length() -> Column:
    return reduce(Column.__add__, [(F.col(w) > 0).cast("int") for w in W])


def _part(start: int, size: int) -> list[Column]:
    """w1 to w4 of a stretch of a phrase."""
    return [(F.col(W[start + k]) if k < size else F.lit(0).cast("long")).alias(W[k]) for k in range(LONGEST)]


def _uncovered(found: DataFrame) -> DataFrame:
    """Phrases that no longer one holds with COVER percent of their occurrences."""
    inner = []
    for size in range(2, LONGEST):
        for start in range(LONGEST - size + 1):
            rest = F.col(W[start + size - 1]) > 0
            proper = F.col("length") > size
            inner.append(found.filter(rest & proper).select(*_part(start, size), F.col("a").alias("longer")))
    longest = reduce(DataFrame.unionByName, inner).groupBy(*W).agg(F.max("longer").alias("longer"))
    return found.join(longest, W, "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("a"))).drop("longer")


def _cuts(kept: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """kept with l, r and score of its lowest-scoring cut."""
    single = words.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in W[1:]], F.col("f").alias("part"))
    parts = single.unionByName(found.filter("length < 4").select(*W, F.col("a").alias("part")))
    sides = []
    for length in range(2, LONGEST + 1):
        own = kept.filter(F.col("length") == length)
        for k in range(1, length):
            for side, start, size in (("l", 0, k), ("r", k, length - k)):
                sides.append(own.select(F.struct(*W).alias("phrase"), F.lit(k).alias("k"), F.lit(side).alias("side"), *_part(start, size)))
    asked = persist(reduce(DataFrame.unionByName, sides), "phrase-cuts")
    uses = asked.groupBy(*W).agg(F.count("*").alias("uses"))
    # A frequent word begins a great many phrases: heavy parts are joined by broadcast.
    met = join_spread(asked, persist(parts.join(uses, W), "phrase-parts"), W, "uses", asked.count())
    pairs = met.groupBy("phrase", "k").agg(F.max(F.when(F.col("side") == "l", F.col("part"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part"))).alias("r"))
    pairs = pairs.select("phrase.*", "k", "l", "r").join(kept, W)
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)")
    best = pairs.withColumn("score", score).groupBy(*W).agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("length").alias("length"))
    return best.select(*W, "a", "length", "best.score", "best.l", "best.r")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A null language is `und`, a null text has no words, and repeated rows count
    each; ties in score and count go by the phrase's bytes. Texts of any length
    and any number of words are met whole. Other columns of docs play no part; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = persist(word_counts(base), "phrase-vocabulary")
    sizes = persist(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words, far, seed = _numbered(counts.filter(F.col("f") >= support), head)
    found = phrase_counts(base, words, far, seed, total, support).withColumn("length", _length())
    scored = _cuts(_uncovered(found), found, words)
    # A phrase's language is that of its first word.
    scored = persist(scored.join(words.select(F.col("id").alias("w1"), "lang"), "w1"), "phrase-scored")
    best = [F.desc("score"), F.desc("a")]
    part = F.pmod(F.xxhash64(*W), F.lit(PARTS))
    few = scored.withColumn("part", part).withColumn("rank", F.rank().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    few = persist(few.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top).drop("rank", "part"), "phrase-best")
    spelt = few.select("lang", "a", "l", "r", "score", F.struct(*W).alias("w"), F.posexplode(F.array(*W)).alias("place", "id")).filter("id > 0").join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "a", "l", "r", "score", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, doc, unnest(ps) AS piece, unnest(range(len(ps))) AS nth FROM (SELECT lang, doc, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM p)),
words AS (SELECT lang, doc, nth, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT lang, doc, nth, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
runs AS MATERIALIZED (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY doc, nth ORDER BY i)),
f AS MATERIALIZED (SELECT lang, [w1] AS g, count(*) AS f FROM runs GROUP BY ALL UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
inner_ AS (SELECT c.lang, c.g[s : s + k - 1] AS g, max(a) AS longer FROM c, range(2, 4) x(k), range(1, 4) y(s) WHERE k < len(c.g) AND s + k - 1 <= len(c.g) GROUP BY ALL),
kept AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
halves AS MATERIALIZED (SELECT lang, g, a, cut, g[1 : cut] AS x, g[cut + 1 : len(g)] AS y FROM kept, range(1, 4) x(cut) WHERE cut < len(g)),
cuts AS (SELECT h.lang, h.g, a, cut, fx.f AS l, fy.f AS r, ((2000000::HUGEINT * a) // (fx.f + fy.f))::BIGINT AS score FROM halves h JOIN f fx ON fx.lang = h.lang AND fx.g = h.x JOIN f fy ON fy.lang = h.lang AND fy.g = h.y),
least AS (SELECT lang, g, a, min({'score': score, 'cut': cut, 'l': l, 'r': r}) AS b FROM cuts GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score FROM least)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
