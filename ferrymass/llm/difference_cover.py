"""Suffix array by the difference cover {1, 2} modulo 3, as Spark sorts and joins, and the repeats that it shows.

The triples of sampled suffixes are named in sorted order; where names repeat, the
string of names is ranked by the same function. The remaining suffixes are merged by
counting: two sorts by plain keys, remaining against either sampled class, say how
many of the other class come before each suffix, and the counts add up to its rank.
No step compares within a group of equal triples, so a hot triple is dealt like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrymass.llm.store import join_counted, persist

WIDTH = 50
#: A string of names of at most so many is ranked by one task.
BASE = 1 << 18


def _offsets(df: DataFrame, part: str, *totals: str) -> DataFrame:
    """The sums of totals over smaller part numbers: a row a partition, whatever the rows."""
    sums = sorted(tuple(r) for r in df.groupBy(part).agg(*[F.sum(t) for t in totals]).collect())
    before = [list(accumulate((r[k + 1] for r in sums), initial=0)) for k in range(len(totals))]
    rows = [(r[0], *[b[i] for b in before]) for i, r in enumerate(sums)]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{part} int", *[f"{t}_off long" for t in totals]]))


def _counted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with before (rows before it in order) and zeros (rows with zero = 1 before it). Order must have no ties."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, zeros = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            flag = b["zero"].to_numpy()
            after = zeros + np.cumsum(flag)
            yield b.assign(part=np.int32(part), one=1, before=seen + np.arange(len(b)), zeros=after - flag)
            seen, zeros = seen + len(b), int(after[-1]) if len(b) else zeros

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = persist(ordered.mapInPandas(number, f"{fields}, part int, one long, before long, zeros long"), name)
    moved = local.join(F.broadcast(_offsets(local, "part", "one", "zero")), "part")
    return moved.select(*df.columns, (F.col("before") + F.col("one_off")).alias("before"), (F.col("zeros") + F.col("zero_off")).alias("zeros"))


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of one short string by doubling."""
    rows = pd.concat([pd.DataFrame({"pos": [], "c": []}, dtype="int64"), *batches]).sort_values("pos")
    rank = np.unique(rows["c"].to_numpy(np.int64), return_inverse=True)[1] + 1
    step = 1
    while len(rank) and rank.max() < len(rank):
        key = rank * (len(rank) + 1) + np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        rank = np.unique(key, return_inverse=True)[1] + 1
        step *= 2
    yield pd.DataFrame({"pos": rows["pos"].to_numpy(), "rank": rank.astype(np.int64)})


def suffix_ranks(string: DataFrame, n: int, base: int = BASE) -> DataFrame:
    """pos, rank (from 1) of every suffix of a string given as pos (0 to n - 1) and c (1 or more)."""
    if n <= base:
        return string.select("pos", "c").coalesce(1).mapInPandas(_whole, "pos long, rank long")
    # A block of three suffixes with the five characters that their triples meet.
    k = F.floor(F.col("pos") / 3).cast("long")
    j = (F.col("pos") % 3).cast("int")
    own = F.struct(k.alias("k"), j.alias("j"), "c")
    spread = string.select(F.explode(F.when((j < 2) & (k > 0), F.array(own, F.struct((k - 1).alias("k"), (j + 3).alias("j"), "c"))).otherwise(F.array(own))).alias("x")).select("x.*")
    blocks = persist(spread.groupBy("k").agg(*[F.coalesce(F.max(F.when(F.col("j") == i, F.col("c"))), F.lit(0)).alias(f"c{i}") for i in range(5)]), "cover-blocks")
    # The empty suffix stands in where no triple of the first class would reach past the end.
    empty = n if n % 3 == 1 else -1
    first, last = F.col("k") * 3 + 1, F.col("k") * 3 + 2
    triples = blocks.select(F.explode(F.array(F.struct(first.alias("pos"), F.col("c1").alias("x"), F.col("c2").alias("y"), F.col("c3").alias("z")), F.struct(last.alias("pos"), F.col("c2").alias("x"), F.col("c3").alias("y"), F.col("c4").alias("z")))).alias("t")).select("t.*").filter((F.col("pos") < n) | (F.col("pos") == empty))
    n1 = (n + 1) // 3 + (empty >= 0)
    samples = n1 + n // 3
    kinds = triples.groupBy("x", "y", "z").agg(F.count("*").alias("times")).withColumn("zero", F.lit(0).cast("long"))
    names = persist(_counted(kinds, ["x", "y", "z"], "cover-kinds").select("x", "y", "z", "times", (F.col("before") + 1).alias("name")), "cover-names")
    different = names.count()
    named = join_counted(triples, names, ["x", "y", "z"], "times", samples)
    if different == samples:
        ranks = named.select("pos", F.col("name").alias("r"))
    else:
        third = F.floor(F.col("pos") / 3).cast("long")
        inner = persist(named.select(F.when(F.col("pos") % 3 == 1, third).otherwise(third + n1).alias("pos"), F.col("name").alias("c")), "cover-string")
        ranks = suffix_ranks(inner, samples, base).select(F.when(F.col("pos") < n1, F.col("pos") * 3 + 1).otherwise((F.col("pos") - n1) * 3 + 2).alias("pos"), F.col("rank").alias("r"))
    ranks = persist(ranks, "cover-ranks").withColumn("k", F.floor(F.col("pos") / 3).cast("long")).withColumn("j", (F.col("pos") % 3).cast("int"))
    near = ranks.select("k", "j", "r").unionByName(ranks.filter("j = 1 AND k > 0").select((F.col("k") - 1).alias("k"), F.lit(4).alias("j"), "r"))
    near = near.groupBy("k").agg(*[F.max(F.when(F.col("j") == i, F.col("r"))).alias(f"r{i}") for i in (1, 2, 4)])
    full = persist(blocks.join(near, "k", "left").select("k", "c0", "c1", "c2", "c3", *[F.coalesce(f"r{i}", F.lit(0)).alias(f"r{i}") for i in (1, 2, 4)]), "cover-full")
    zero, one = F.lit(1).cast("long").alias("zero"), F.lit(0).cast("long").alias("zero")
    rest = (F.col("k") * 3).alias("pos")
    with_first = full.select(rest, F.col("c0").alias("a"), F.col("r1").alias("b"), F.lit(0).cast("long").alias("own"), zero).unionByName(full.filter("r1 > 0").select(first.alias("pos"), F.col("c1").alias("a"), F.col("r2").alias("b"), F.col("r1").alias("own"), one))
    with_last = full.select(rest, F.col("c0").alias("a"), F.col("c1").alias("b"), F.col("r2").alias("d"), F.lit(0).cast("long").alias("own"), zero).unionByName(full.filter("r2 > 0").select(last.alias("pos"), F.col("c2").alias("a"), F.col("c3").alias("b"), F.col("r4").alias("d"), F.col("r2").alias("own"), one))
    with_first, with_last = _counted(with_first, ["a", "b"], "cover-first"), _counted(with_last, ["a", "b", "d"], "cover-last")
    # before counts the suffix's own class in with_first, and only the others in with_last.
    parts = with_first.select("pos", (F.when(F.col("zero") == 1, F.col("before")).otherwise(F.col("own") - 1 + F.col("zeros"))).alias("r")).unionByName(with_last.select("pos", F.when(F.col("zero") == 1, F.col("before") - F.col("zeros")).otherwise(F.col("own") - 1 + F.col("zeros")).alias("r")))
    return parts.groupBy("pos").agg(F.sum("r").alias("r")).filter(F.col("pos") < n).select("pos", (F.col("r") + (0 if empty >= 0 else 1)).alias("rank"))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        size = b["text"].map(len).to_numpy(np.int64) + 1
        yield b.assign(part=np.int32(part), size=size, at=at + np.cumsum(size) - size)
        at += int(size.sum())


def _characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start, text in zip(b["start"].tolist(), b["text"], strict=True):
            c = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 2, 1)
            yield pd.DataFrame({"pos": start + np.arange(len(c)), "c": c})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for doc, start, text in zip(b["doc"].tolist(), b["start"].tolist(), b["text"], strict=True):
            for a in range(0, max(0, len(text) - WIDTH + 1), 100_000):
                z = min(a + 100_000, len(text) - WIDTH + 1)
                yield pd.DataFrame({"pos": np.arange(start + a, start + z), "doc": doc, "prefix": [text[i : i + WIDTH] for i in range(a, z)]})


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of runs of equal prefixes, from 0 in each partition."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        if not len(b):
            continue
        prefix = b["prefix"].to_numpy()
        new = np.array([p != q for p, q in zip(prefix, [last, *prefix[:-1]], strict=True)])
        number = run + np.cumsum(new)
        yield pd.DataFrame({"part": np.int32(part), "pos": b["pos"], "doc": b["doc"], "run": number, "prefix": b["prefix"]})
        run, last = int(number[-1]), prefix[-1]


def covered_positions(texts: DataFrame, base: int = BASE) -> DataFrame:
    """uid, at: where in each text a WIDTH-byte string begins that also begins in a text of smaller doc.

    texts has uid, doc (both long) and text (binary).
    """
    local = persist(texts.select("uid", "doc", "text").mapInPandas(_placed, "uid long, doc long, text binary, part int, size long, at long"), "cover-texts")
    n = local.agg(F.sum("size")).first()[0] or 0
    placed = local.join(F.broadcast(_offsets(local, "part", "size")), "part").select("uid", "doc", "text", (F.col("at") + F.col("size_off")).alias("start"))
    string = persist(placed.select("start", "text").mapInPandas(_characters, "pos long, c long"), "cover-string")
    ranks = suffix_ranks(string, n, base)
    windows = placed.select("doc", "start", "text").mapInPandas(_windows, "pos long, doc long, prefix binary")
    ordered = windows.join(ranks, "pos").repartitionByRange("rank").sortWithinPartitions("rank")
    runs = persist(ordered.select("pos", "doc", "prefix").mapInPandas(_neighbours, "part int, pos long, doc long, run long, prefix binary"), "cover-runs")
    # The ends of each partition say which runs go on in the next: two prefixes a partition.
    ends = runs.groupBy("part").agg(F.max("run").alias("last"), F.min_by("prefix", "run").alias("a"), F.max_by("prefix", "run").alias("z")).orderBy("part").collect()
    base_of, at, before = [], 0, None
    for e in ends:
        at -= before is not None and bytes(e["a"]) == before
        base_of.append((e["part"], at))
        at, before = at + e["last"] + 1, bytes(e["z"])
    offset = texts.sparkSession.createDataFrame(base_of, "part int, off long")
    numbered = runs.join(F.broadcast(offset), "part").select("pos", "doc", (F.col("run") + F.col("off")).alias("run"))
    least = persist(numbered.groupBy("run").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("times")).filter("least < most"), "cover-least")
    hit = join_counted(numbered, least, ["run"], "times", n).filter(F.col("doc") > F.col("least")).select("pos")
    # Positions return to their text by blocks of the string; a text of any length meets its own blocks only.
    block = 1 << 16
    spans = placed.select("uid", "start", (F.col("start") + F.octet_length("text")).alias("end")).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    return hit.withColumn("block", F.floor(F.col("pos") / block)).join(spans, "block").filter("pos >= start AND pos < end").select("uid", (F.col("pos") - F.col("start")).alias("at"))
