"""N-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A text's set holds its distinct runs of five words as 64-bit hashes. Sizes fall
into bands with the limits b, 4b/3 + 1, ...; two sets that link lie in one band or
in adjacent ones. For each limit b the universe of hashes is cut into m segments,
m a little over b/3 + 1. Linked sets of n1 and n2 differ in at most
H = (n1 + n2) / 7 elements, so at most H of their segments differ and the rest are
the same subsets; those that are not empty meet as equal keys. A set indexes the
segments of its own band's limit and of the limit below.

Allocation follows cost. Keys that over HOT sets share are not enumerated. A pair
that meets elsewhere is kept only if the keys it shares, with the hot ones that
both hold, reach the number that pigeonhole demands. Sets whose hot and empty
segments could hide a partner altogether meet on the hot keys among themselves:
first each with the most typical of its key, and once linked sets have collapsed into
components, the sets of mixed keys by their rarest elements. Sets whose empty segments alone could
hide a partner (small ones) also index the one-deletion neighbourhood of every
segment. Pairs that remain are verified on the whole sets. Nothing is capped:
every link between different sets is found or its ends are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm import kernels
from ferrymass.llm.components import components
from ferrymass.llm.store import drop_members, join_counted, keep_members, persist, small_batches, tidy

#: Sets that share a key before it counts as hot.
HOT = 16
#: Index entries that one slot of the index holds on average, and that a task packs at a time.
PER_SLOT = 200_000
FLUSH = 200_000
#: Cells by which elements are counted to tell rare ones: 1 MB in a task. With more elements than cells the order is less telling and as right.
CELLS = 1 << 18
#: Entries of 12 bytes that a task of the index reads.
PER_TASK = 1_300_000
#: A key of over this part of all entries, and of PER_SLOT, is kept out of its slot, so there are fewer such keys than this.
HEAVY_KEYS = 100_000
#: Of texts, by their hash, one in so many tells which keys are that heavy.
PROBE = 64
#: Sets of one element that meet in one task.
PER_ELEMENT = 500
#: Fingerprints that a task remembers to spare repeats, at most; the slots drop the others.
SEEN = 50_000

_U = np.uint64
_ENTRY = np.dtype([("key", "<u4"), ("set", "<i8")])
_HEAVY = np.dtype([("key", "<i8"), ("set", "<i8")])


def _limits() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out)


LIMITS = _limits()


def segments(limit: int) -> int:
    """Segments of the universe for a limit: one over the most differences, and an eighth for those that stay empty."""
    most = limit // 3
    return most + 3 + most // 8


def _subsets(u: np.ndarray, band: int):
    """Number, hash and size of the set's non-empty segments at a band's limit. u is sorted, so segments are runs."""
    m = segments(int(LIMITS[band]))
    seg = (((u >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    return seg[first], np.add.reduceat(kernels.mix(u), first), first


def _key(seg: np.ndarray, total: np.ndarray, band: int) -> np.ndarray:
    return kernels.mix(total + kernels.mix(seg.astype(_U) * _U(4096) + _U(band)))


def index_keys(u: np.ndarray):
    """Keys of a set at its band's limit and at the one below, and (n, its band, non-empty segments at each).

    A set is short of segments where its empty ones could hide all that a
    partner must have in common with it; then each segment's subsets of one
    element less are keys too, so a pair that differs by one element in a
    segment meets there.
    """
    n = len(u)
    band = int(np.searchsorted(LIMITS, n))
    keys, filled = [], []
    for b in (band, band - 1):
        if b < 0:
            filled.append(0)
            continue
        seg, total, first = _subsets(u, b)
        keys.append(_key(seg, total, b))
        filled.append(len(seg))
        most = n // 3 if b == band else (n + int(LIMITS[b])) // 7
        if len(seg) <= most:
            own = np.repeat(np.arange(len(seg)), np.diff(np.append(first, n)))
            less = total[own] - kernels.mix(u)
            alone = less == 0
            keys.append(_key(seg[own][~alone], less[~alone], b))
            # A segment of one element has only the empty subset below it; its element is the key by which such sets meet.
            keys.append(kernels.mix(kernels.mix(u) + _U(b)))
    return np.unique(np.concatenate(keys)), (n, band, filled[0], filled[1])


def _set_id(u: np.ndarray) -> int:
    return int(np.sum(kernels.mix(u ^ _U(0x5851F42D4C957F2D)), dtype=_U).astype(np.int64))


def _sets(texts) -> Iterator[np.ndarray]:
    for _, counts, words in kernels.word_hashes(texts):
        yield from kernels.shingles(counts, words)


#: What _meet tells of a text, in the order of its array, and of the pairs and hot keys of a slot.
FACTS = ["doc_id", "no_id", "mark", "set", "n", "band", "up", "low"]
MET = "a long, b long, shared long, key long, row array<long>"
#: Slots from here down hold FACTS of texts instead of index entries.
TOLD = -(1 << 40)
#: Index entries of a text are about one in so many of its bytes; texts of the shortest words have three times as many.
BYTES_PER_ENTRY = 5


def _keyed(texts) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """Of each text its set's fingerprint, index keys, and size and segments."""
    for u in _sets(texts):
        # An empty set's fingerprint is 0.
        yield (_set_id(u), *index_keys(u)) if len(u) else (0, np.empty(0, _U), (0, 0, 0, 0))


def _slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key & _U(0xFFFFFFFF)) % _U(slots)).astype(np.int64)


def _name(key: np.ndarray, slots: int) -> np.ndarray:
    """What a key is told by: its slot and its upper half."""
    return (_slot_of(key, slots) << 32) + (key >> _U(32)).astype(np.int64)


def _names(slots: int):
    """Names of the keys of the probed texts, once for each set that a task meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for own, keys, _ in _keyed(b["text"].tolist()):
                if own not in seen:
                    yield pd.DataFrame({"key": _name(keys, slots)})
                if len(seen) < SEEN:
                    seen.add(own)

    return run


def _entries(slots: int, heavy: np.ndarray):
    """Index entries of texts' sets, packed by slot: (key: 4 bytes, set: 8 bytes); those of heavy keys, as (key: 8, set: 8), by set in slots below 0; a batch's FACTS in one from TOLD down.

    A set has its entries where the task meets it first. Nothing of a text is
    written between its hashes and the shuffle of its entries.
    """

    def deal(slot: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
        order = np.argsort(slot, kind="stable")
        slot, entry = slot[order], entry[order]
        first = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1)) if len(slot) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(slot))
        return pd.DataFrame({"slot": slot[first], "entries": [entry[a:z].tobytes() for a, z in zip(first, ends, strict=True)]})

    def flush(keys: list[np.ndarray], sets: list[int]) -> Iterator[pd.DataFrame]:
        key = np.concatenate(keys)
        own = np.repeat(np.array(sets, np.int64), [len(k) for k in keys])
        if len(heavy):
            name = _name(key, slots)
            apart = heavy[np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)] == name
            out = np.empty(int(apart.sum()), _HEAVY)
            out["key"], out["set"] = name[apart], own[apart]
            if len(out):
                yield deal(-1 - (out["set"] & 0xFFFFF), out)
            key, own = key[~apart], own[~apart]
        entry = np.empty(len(key), _ENTRY)
        entry["key"], entry["set"] = (key >> _U(32)).astype("<u4"), own
        if len(entry):
            yield deal(_slot_of(key, slots), entry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        keys, sets, held = [], [], 0
        for b in batches:
            told = []
            for own, found, facts in _keyed(b["text"].tolist()):
                told.append((own, *facts))
                if own not in seen and len(found):
                    keys.append(found)
                    sets.append(own)
                    held += len(found)
                if len(seen) < SEEN:
                    seen.add(own)
                if held >= FLUSH:
                    yield from flush(keys, sets)
                    keys, sets, held = [], [], 0
            if told:
                row = np.column_stack([b["doc_id"].to_numpy(np.int64), b["no_id"].to_numpy(np.int64), b["mark"].to_numpy(np.int64), np.array(told, np.int64)])
                yield pd.DataFrame({"slot": [TOLD - int(row[0, 2] & 0xFFFF)], "entries": [row.tobytes()]})
        if held:
            yield from flush(keys, sets)

    return run


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MET of each slot: pairs of sets with the keys they share (a, b, shared), and hot keys with their sets (key, a); or the texts' FACTS (row)."""
    slot, parts = None, []
    for batch in batches:
        for s, entries in zip(batch["slot"].tolist(), batch["entries"], strict=True):
            if s != slot and parts:
                yield _slot(slot, parts)
                parts = []
            slot = s
            parts.append(entries)
    if parts:
        yield _slot(slot, parts)


def _slot(slot: int, parts: list[bytes]) -> pd.DataFrame:
    if slot <= TOLD:
        rows = np.frombuffer(b"".join(parts), np.int64).reshape(-1, len(FACTS))
        return pd.DataFrame({"a": np.int64(0), "b": np.int64(0), "shared": np.int64(0), "key": np.int64(0), "row": list(rows)})
    if slot < 0:
        entry = np.unique(np.frombuffer(b"".join(parts), _HEAVY))
        return pd.DataFrame({"a": entry["set"].astype(np.int64), "b": np.int64(0), "shared": np.int64(0), "key": entry["key"].astype(np.int64), "row": None})
    entry = np.frombuffer(b"".join(parts), _ENTRY)
    key, own = entry["key"], entry["set"]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for c in range(2, HOT + 1):
        runs = first[size == c]
        if len(runs):
            i, j = np.triu_indices(c, 1)
            left.append(own[runs[:, None] + i].ravel())
            right.append(own[runs[:, None] + j].ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    shared = np.diff(np.append(edge, len(a)))
    pairs = pd.DataFrame({"a": a[edge], "b": b[edge], "shared": shared.astype(np.int64), "key": np.int64(0)})
    hot = np.repeat(size > HOT, size)
    keys = (np.int64(slot) << 32) + key[hot].astype(np.int64)
    return pd.concat([pairs, pd.DataFrame({"a": own[hot], "b": np.int64(0), "shared": np.int64(0), "key": keys})]).assign(row=None)


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = list(_sets(b["text"].tolist()))
        yield pd.DataFrame({"mark": b["mark"].to_numpy(), "set": [_set_id(u) if len(u) else 0 for u in sets], "elements": [u.view(np.int64) for u in sets]})


def _elements(named: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """set, elements (array) of the named sets, each made of the rows that its mark names."""
    wanted = persist(reps.join(named, "set").select("set", "mark"), "near-wanted", gather=True)
    made = keep_members(texts.select("mark", "text"), wanted, "mark").mapInPandas(tidy(_arrays), "mark long, set long, elements array<long>")
    return persist(wanted.join(made, ["mark", "set"]).groupBy("set").agg(F.first("elements").alias("elements")), "near-sets")


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a, b that link. Whole sets are made anew from one text of each set that a pair names."""
    named = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    elements = _elements(named, docs, reps)
    x = elements.withColumnsRenamed({"set": "a", "elements": "x"})
    y = elements.withColumnsRenamed({"set": "b", "elements": "y"})
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), F.size(F.array_intersect("x", "y")).cast("long").alias("same"))
    return persist(both.filter("100 * same >= 75 * (n + m - same)").select("a", "b"), "near-links", gather=True)


def _mark(id_col: str, text_col: str) -> Column:
    """What a row is told by: its id and text, so that texts under one id stay apart and rows without an id count."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies for every row of docs.

    n_shingles is the size of the text's set; component_id the smallest id that
    links reach, the row's own included; n_copies the rows with the very same
    set. Null, empty and blank texts have no shingles, link with nothing and are
    their own component. Repeated rows give rows each, and so does each text of an
    id that has several. A null id takes part, links others and is never the
    smallest unless all are null. An empty table gives no rows; other columns play
    no part. Sets are told apart by a 64-bit fingerprint.
    """
    return _classes(docs, id_col, text_col).drop("mark").withColumnRenamed("doc_id", id_col)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_copies with each row's mark."""
    spark = docs.sparkSession
    small_batches(spark)
    own_id = F.col(id_col).cast("long")
    # A null beside large ids would turn an Arrow batch's ids into rounded floats.
    texts = docs.select(F.coalesce(own_id, F.lit(0)).alias("doc_id"), own_id.isNull().alias("no_id"), _mark(id_col, text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    entries = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_PER_ENTRY + 1
    slots = min(max(16, entries // PER_SLOT), 1 << 30)
    bar = max(PER_SLOT, entries // HEAVY_KEYS)
    probed = texts.filter(F.pmod(F.xxhash64("text"), F.lit(PROBE)) == 0).select("text").mapInPandas(tidy(_names(slots)), "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * PROBE > bar)
    heavy = np.sort(np.array([r["key"] for r in probed.select("key").collect()], np.int64))
    packed = texts.mapInPandas(tidy(_entries(slots, heavy)), "slot long, entries binary")
    tasks = -(-entries // PER_TASK)
    met = persist(packed.repartition(tasks, "slot").sortWithinPartitions("slot").mapInPandas(tidy(_meet), MET), "near-met", gather=True)
    rows = persist(met.filter("row IS NOT NULL").select(*[F.col("row")[k].alias(c) for k, c in enumerate(FACTS)]), "near-rows")
    rows = rows.withColumn("doc_id", F.when(F.col("no_id") == 0, F.col("doc_id"))).drop("no_id")
    met = met.filter("row IS NULL").drop("row")
    least = F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    info = persist(rows.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), least.alias("mark"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("up").alias("up"), F.first("low").alias("low")), "near-info")

    hot = met.filter("key <> 0").select("key", F.col("a").alias("set"))
    hot_of = persist(hot.groupBy("set").agg(F.count("*").alias("hot")), "near-hot")
    limit = F.array(*[F.lit(int(x)) for x in LIMITS])
    low_limit = F.element_at(F.filter(limit, lambda x: x < F.col("n")), -1)
    facts = persist(
        info.select("set", "n", "band", "up", "low").join(hot_of, "set", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
        .withColumn("exposed", (F.col("hot") > 0) & ((F.col("up") - F.floor(F.col("n") / 3) <= F.col("hot")) | (F.col("low") - F.floor((F.col("n") + F.coalesce(low_limit, F.lit(0))) / 7) <= F.col("hot")))),
        "near-facts",
    )
    counted = met.filter("key = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(_as(facts, "a"), "a").join(_as(facts, "b"), "b")
    pairs = persist(counted.filter(_alike() & (F.col("shared") + F.least("a_hot", "b_hot") >= _must())).select("a", "b", "shared"), "near-pairs")

    # First every set's least and best partner, and the most typical set of each hot key (the original of edited copies has the largest share of hot keys); most links of a group follow from these.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    chosen = both.groupBy("a").agg(F.min("b").alias("least"), F.max_by("b", "shared").alias("best"))
    chosen = chosen.select("a", F.explode(F.array("least", "best")).alias("b"))
    exposed = persist(hot.join(facts.filter("exposed").drop("exposed"), "set"), "near-exposed")
    leaders = exposed.groupBy("key").agg(F.max(F.struct((F.col("hot") / (F.col("up") + F.col("low"))).alias("share"), "set", "n")).alias("lead"), F.count("*").alias("size"))
    star = join_counted(exposed, persist(leaders, "near-leaders"), ["key"], "size", exposed.count()).filter(4 * F.least("n", "lead.n") >= 3 * F.greatest("n", "lead.n")).select(F.col("set").alias("a"), F.col("lead.set").alias("b"))
    first = _ordered(chosen.unionByName(star))
    reps = info.select("set", "mark")
    links = _verify(persist(first, "near-first"), texts, reps)
    label = persist(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "near-label")

    # Then the pairs whose ends are still apart.
    rest = _apart(pairs.select("a", "b"), label).unionByName(_hot_pairs(exposed, label, texts, reps))
    more = _verify(persist(_ordered(rest).join(first, ["a", "b"], "left_anti"), "near-rest"), texts, reps)
    label = persist(components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "near-label")

    named = info.join(label.withColumnRenamed("node", "set"), "set", "left").select("set", "rep", "copies", F.coalesce("label", "set").alias("label"))
    named = persist(named, "near-named")
    groups = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("sets"))
    named = join_counted(named, persist(groups, "near-groups"), ["label"], "sets", named.count())
    full = join_counted(rows.filter("n > 0"), persist(named.select("set", "component_id", "copies"), "near-sets"), ["set"], "copies", rows.count())
    out = full.select("mark", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("copies").alias("n_copies"))
    return out.unionByName(rows.filter("n = 0").select("mark", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies")))


def _as(facts: DataFrame, side: str) -> DataFrame:
    return facts.select(F.col("set").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "band", "up", "low", "hot")])


def _alike() -> Column:
    """Whether the sizes of a and b allow a link at all."""
    return 4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")


def _must() -> Column:
    """Keys that a linked pair shares at least, by pigeonhole.

    Of one band, both have segments at both limits; of adjacent ones, at the
    limit of the smaller one's band.
    """
    most = F.floor((F.col("a_n") + F.col("b_n")) / 7)
    own = F.greatest("a_up", "b_up") - most
    low = F.greatest("a_low", "b_low") - most
    between = F.greatest(F.when(F.col("a_band") > F.col("b_band"), F.col("a_low")).otherwise(F.col("a_up")), F.when(F.col("b_band") > F.col("a_band"), F.col("b_low")).otherwise(F.col("b_up"))) - most
    return F.when(F.col("a_band") == F.col("b_band"), F.greatest(own, F.lit(0)) + F.greatest(low, F.lit(0))).otherwise(between)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _label(df: DataFrame, node: str, label: DataFrame, name: str) -> DataFrame:
    return df.join(label.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    return _label(_label(pairs, "a", label, "la"), "b", label, "lb").filter("la <> lb").select("a", "b")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many elements of the task's sets fall into each cell."""
    times = np.zeros(CELLS, np.int64)
    for b in batches:
        if len(b):
            times += np.bincount(np.concatenate([np.asarray(x, np.int64) for x in b["elements"]]) & (CELLS - 1), minlength=CELLS)
    cell = np.flatnonzero(times)
    yield pd.DataFrame({"cell": cell.astype(np.int32), "times": times[cell]})


def _heads(often):
    """The rarest quarter of each set's elements, and one, with their places from 0; those that no other set can have are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places, picked = [], []
            for elements in b["elements"]:
                e = np.asarray(elements, np.int64)
                times = often.value[e & (CELLS - 1)]
                first = np.lexsort((e, times))[: len(e) // 4 + 1]
                places.append(np.flatnonzero(times[first] > 1))
                picked.append(e[first[places[-1]]])
            if places:
                size = [len(x) for x in places]
                n = b["elements"].map(len).to_numpy(np.int64)
                yield pd.DataFrame({"set": np.repeat(b["set"].to_numpy(), size), "comp": np.repeat(b["comp"].to_numpy(), size), "n": np.repeat(n, size), "at": np.concatenate(places), "element": np.concatenate(picked)})

    return run


def _hot_pairs(exposed: DataFrame, label: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs among the exposed sets whose hot keys hold more than one component.

    What linked sets share is at least three quarters of the larger one, so with
    elements ordered by how few of these sets hold their cell, two linked sets have an
    element in common among the first quarter (and one) of the larger and the first
    seventh (and one) of the smaller: from the first element in common on, each has
    3/7 of both sizes left. Sets that merely contain a frequent passage, and edited
    copies that are too far apart, differ there; only pairs of different components
    are of interest.
    """
    marked = _label(exposed.select("key", "set"), "set", label, "comp")
    mixed = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    left = persist(marked.join(mixed, "key", "left_semi").select("set", "comp").distinct(), "near-mixed")
    held = persist(_elements(left.select("set"), docs, reps).join(left, "set"), "near-held")
    counted = held.select("elements").mapInPandas(tidy(_cells), "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    times = np.zeros(CELLS, np.int64)
    for cell, n in counted.collect():  # CELLS rows at most
        times[cell] = n
    often = docs.sparkSession.sparkContext.broadcast(times)
    head = persist(held.mapInPandas(tidy(_heads(often)), "set long, comp long, n long, at long, element long"), "near-head")
    spread = head.groupBy("element").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("sets")).filter("lo <> hi").select("element", "sets")
    head = join_counted(head, persist(spread, "near-spread"), ["element"], "sets", head.count()).filter("sets IS NOT NULL")
    # An element's sets are dealt over as many tasks as it takes, and meet all the others there.
    parts = F.ceil(F.col("sets") / PER_ELEMENT).cast("int")
    head = persist(head.withColumn("parts", parts), "near-heads")
    x = head.filter("7 * at <= n").select("element", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), F.col("set").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"))
    y = head.select("element", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    far_enough = "7 * (na - ia) >= 3 * (na + nb) AND 7 * (nb - ib) >= 3 * (na + nb)"
    return x.join(y, ["element", "part"]).filter(f"ca <> cb AND (na < nb OR na = nb AND a < b) AND 4 * na >= 3 * nb AND {far_enough}").select("a", "b").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with, of each component, the rows that have its smallest id; columns as they were.

    A row goes by its own id and text, so another text under the same id has no
    part in it. A null id goes where its component has an id, and stays where all
    are null. Rows that repeat both id and text stay or go together. Texts without
    a word stay; an empty table stays empty. Only rows that may go are shuffled.
    """
    found = _classes(docs, id_col, text_col)
    gone = persist(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("mark").distinct(), "near-gone")
    return drop_members(docs.select(F.struct(*docs.columns).alias("_row"), _mark(id_col, text_col).alias("mark")), gone, "mark").select("_row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
