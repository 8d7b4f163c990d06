"""Substring dedup: every byte of a 50-byte string that also starts in a document with a smaller id is removed.

A sampled suffix sort: instead of all suffixes only sampled ones are sorted, and
the sample is one that two equal strings of WIDTH bytes always share: the
position, within the string, of its least GRAM-byte hash. Three passes.

1. The sampled positions' hashes, 4 bytes each, are dealt into slots and sorted;
   those that two texts or more have set a bit in a filter of fixed size.
2. Sampled positions that hit the filter are dealt by hash with the bytes around
   them, after equal surroundings within a task have been reduced to the smallest
   id's. A slot sorts the WIDTH-byte strings of equal samples and compares each
   with the first of its run: it is covered if that one's id is smaller.
3. Covered strings are merged per text and cut out.

A sample that very many texts hold, amid different text, would make a slot of any
size. The first pass counts samples, and where one is heavy the second sends its
strings one by one under their own hashes, reduced within a task to the smallest
id's; then no task meets more of a string than the others have flushed.

A larger corpus fills the filter, which costs shuffling and never changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm import kernels
from ferrymass.llm.store import PAGE_BITS, keep_members, persist, small_batches, tidy

WIDTH = 50
GRAM = 20
SPAN = WIDTH - GRAM + 1
CONTEXT = WIDTH + SPAN - 1
FILTER_BITS = 1 << 27
PER_SLOT = 50_000
FLUSH = 400_000
FLUSH_CONTEXTS = 40_000
#: Contexts that are cut out of texts, and that a slot compares, at a time.
CHUNK = 8_000
#: A sample of over this part of all, and of PER_SLOT, is heavy, so there are fewer heavy ones than this.
HEAVY_SAMPLES = 100_000
#: Bytes of one text that are hashed at a time; the next piece overlaps it by WIDTH - 1.
PIECE = 1 << 19
#: Bytes that a task reads of what is dealt by slot.
PER_TASK = 16 << 20
#: An id that no document has precedence over: that of null ids.
LAST = (1 << 63) - 1

_U = np.uint64
_LOW = _U((1 << 24) - 1)
_ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i8"), ("n", "<i2"), ("bytes", f"V{CONTEXT}")])
_STRING = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i8")])
_COVER = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<i8"), ("end", "<i8")])


class Run:
    """Sampled positions of some texts laid end to end: hash, text, first string that has it as its sample, and how many in a row do."""

    def __init__(self, blobs: list[bytes], shift: list[int]):
        self.raw = np.frombuffer(b"".join(blobs), np.uint8)
        size = np.array([len(b) for b in blobs])
        self.base = np.cumsum(size) - size
        self.shift = np.array(shift)
        n = len(self.raw)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(kernels._BYTE[self.raw] * kernels._power(kernels._PRIME, "up", n), out=self.total[1:])
        if n < WIDTH:
            self.hash, self.text, self.first, self.n = (np.empty(0, t) for t in (_U, np.int64, np.int64, np.int64))
            return
        gram = self.hashes(np.arange(n - GRAM + 1), GRAM)
        least = (gram & ~_LOW) | np.arange(len(gram), dtype=_U)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: width - SPAN], least[SPAN - width :])
        sample = (least & _LOW).astype(np.int64)
        whole = np.repeat(self.base + size - WIDTH, size)[: len(sample)] >= np.arange(len(sample))
        start = np.flatnonzero(whole)
        text = np.searchsorted(self.base, start, "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], (sample[start][1:] != sample[start][:-1]) | (text[1:] != text[:-1])])) if len(start) else start
        self.first, self.text, self.hash = start[edge], text[edge], gram[sample[start[edge]]]
        self.n = np.diff(np.append(edge, len(start)))

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the bytes at each start, wherever they lie."""
        end = start + length
        return kernels.mix((self.total[end] - self.total[start]) * kernels._power(kernels._INVERSE, "down", len(self.total))[start])


def _runs(batch: pd.DataFrame) -> Iterator[tuple[Run, np.ndarray, np.ndarray]]:
    """Runs of a batch's texts with each text's id and mark."""
    blobs, shift, docs, marks, size = [], [], [], [], 0
    for doc, mark, text in zip(batch["doc"].tolist(), batch["mark"].tolist(), batch["text"].tolist(), strict=True):
        blob = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(blob) - WIDTH + 1), PIECE):
            piece = blob[at : at + PIECE + WIDTH - 1]
            if blobs and size + len(piece) > kernels.SLICE:
                yield Run(blobs, shift), np.array(docs), np.array(marks)
                blobs, shift, docs, marks, size = [], [], [], [], 0
            blobs.append(piece)
            shift.append(at)
            docs.append(doc)
            marks.append(mark)
            size += len(piece)
    if blobs:
        yield Run(blobs, shift), np.array(docs), np.array(marks)


def _deal(slot: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
    order = np.argsort(slot, kind="stable")
    slot, entry = slot[order], entry[order]
    first = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1 if len(slot) else 0))
    ends = np.append(first[1:], len(slot))
    return pd.DataFrame({"slot": slot[first], "entries": [entry[a:z].tobytes() for a, z in zip(first, ends, strict=True)]})


def _slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h & _U(0xFFFFFFFF)) % _U(slots)).astype(np.int64)


def _bit_of(slot, key):
    return (kernels.mix((np.asarray(slot).astype(_U) << _U(32)) + key.astype(_U)) % _U(FILTER_BITS)).astype(np.int64)


def _sample(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for r, _, _ in _runs(b):
                order = np.lexsort((r.hash, r.text))
                h, t = r.hash[order], r.text[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.empty(0, bool)
                held.append(h[new])
                size += len(held[-1])
                if size >= FLUSH:
                    h = np.concatenate(held)
                    yield _deal(_slot_of(h, slots), (h >> _U(32)).astype("<u4"))
                    held, size = [], 0
        if size:
            h = np.concatenate(held)
            yield _deal(_slot_of(h, slots), (h >> _U(32)).astype("<u4"))

    return run


def _by_slot(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
    slot, parts = None, []
    for batch in batches:
        for s, e in zip(batch["slot"].tolist(), batch["entries"], strict=True):
            if s != slot and parts:
                yield slot, b"".join(parts)
                parts = []
            slot = s
            parts.append(e)
    if parts:
        yield slot, b"".join(parts)


def _name(h: np.ndarray, slots: int) -> np.ndarray:
    """What a sample is told by: its slot and its hash's upper half."""
    return (_slot_of(h, slots) << 32) + (h >> _U(32)).astype(np.int64)


def _repeated(bar: int):
    """The filter's bit of each sample of two texts or more, and its name where it is heavy, else -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slot, data in _by_slot(batches):
            key, times = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
            key, times = key[times > 1], times[times > 1]
            yield pd.DataFrame({"at": _bit_of(slot, key), "heavy": np.where(times > bar, (slot << 32) + key.astype(np.int64), -1)})

    return run


def _least_of(entry: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of kind and id, and whether each has its kind's smallest id."""
    order = np.lexsort((entry["doc"], kind))
    entry, kind = entry[order], kind[order]
    first = np.concatenate([[True], kind[1:] != kind[:-1]])
    return entry, entry["doc"] == entry["doc"][np.flatnonzero(first)][np.cumsum(first) - 1]


def _contexts(slots: int, bits, heavy: np.ndarray):
    """Sampled positions that hit the filter, with their surroundings, and strings that a smaller id in the same task covers. Heavy samples' strings go in slots above the others."""

    def covers(gone: np.ndarray, length) -> Iterator[pd.DataFrame]:
        if len(gone):
            cover = np.empty(len(gone), _COVER)
            cover["doc"], cover["mark"], cover["start"] = gone["doc"], gone["mark"], gone["at"]
            cover["end"] = gone["at"] + length
            cover = _merge(cover)
            yield _deal(-1 - _slot_of(cover["mark"].astype(_U), slots), cover)

    def flush(held: list[np.ndarray], kinds: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        entry, mine = _least_of(np.concatenate(held), np.concatenate(kinds))
        # Rows that share the smallest id are all sent on.
        yield _deal(_slot_of(entry["hash"][mine], slots), entry[mine])
        yield from covers(entry[~mine], entry["n"][~mine] - 1 + WIDTH)

    def strings(r: Run, some: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> Iterator[pd.DataFrame]:
        for a in range(0, len(some), CHUNK):
            own = some[a : a + CHUNK]
            n = r.n[own]
            start = np.repeat(r.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = np.repeat(r.text[own], n)
            entry = np.empty(len(start), _STRING)
            entry["hash"], entry["doc"], entry["mark"], entry["at"] = r.hashes(start, WIDTH), doc[text], mark[text], start - r.base[text] + r.shift[text]
            entry, mine = _least_of(entry, entry["hash"])
            yield _deal(slots + _slot_of(entry["hash"][mine], slots), entry[mine])
            yield from covers(entry[~mine], WIDTH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page = np.frombuffer(bits.value, np.uint8)
        held, kinds, size = [], [], 0
        for b in batches:
            for r, doc, mark in _runs(b):
                at = _bit_of(_slot_of(r.hash, slots), r.hash >> _U(32))
                hit = np.flatnonzero((page[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if len(heavy) and len(hit):
                    name = _name(r.hash[hit], slots)
                    apart = heavy[np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)] == name
                    yield from strings(r, hit[apart], doc, mark)
                    hit = hit[~apart]
                for a in range(0, len(hit), CHUNK):
                    some = hit[a : a + CHUNK]
                    start, n, text = r.first[some], r.n[some], r.text[some]
                    entry = np.zeros(len(some), _ENTRY)
                    entry["hash"], entry["doc"], entry["mark"], entry["n"] = r.hash[some], doc[text], mark[text], n
                    entry["at"] = start - r.base[text] + r.shift[text]
                    spread = np.minimum(start.astype(np.int32)[:, None] + np.arange(CONTEXT, dtype=np.int32), np.int32(len(r.raw) - 1))
                    inside = np.arange(CONTEXT) < (n + WIDTH - 1)[:, None]
                    entry["bytes"] = np.ascontiguousarray(r.raw[spread] * inside).view(f"V{CONTEXT}").ravel()
                    held.append(entry)
                    kinds.append(r.hashes(start, n + WIDTH - 1) + n.astype(_U))
                    size += len(some)
                    if size >= FLUSH_CONTEXTS:
                        yield from flush(held, kinds)
                        held, kinds, size = [], [], 0
        if size:
            yield from flush(held, kinds)

    return run


def _merge(cover: np.ndarray) -> np.ndarray:
    """Covered stretches of each text, joined where they touch."""
    cover = cover[np.lexsort((cover["start"], cover["mark"], cover["doc"]))]
    if len(cover) < 2:
        return cover
    new = (cover["doc"][1:] != cover["doc"][:-1]) | (cover["mark"][1:] != cover["mark"][:-1])
    group = np.concatenate([[0], np.cumsum(new)])
    reach = np.maximum.accumulate(cover["end"] + group * (1 << 40))
    new |= cover["start"][1:] + group[1:] * (1 << 40) > reach[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    out = cover[first].copy()
    out["end"] = np.maximum.reduceat(cover["end"], first)
    return out


def _met(name: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Covers of the strings, each told by its name, that one of a smaller id equals."""
    order = np.lexsort((doc, name))
    first = np.concatenate([[True], name[order][1:] != name[order][:-1]])
    least = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    hit = order[doc[order] > least]
    cover = np.empty(len(hit), _COVER)
    cover["doc"], cover["mark"], cover["start"], cover["end"] = doc[hit], mark[hit], start[hit], start[hit] + WIDTH
    return _merge(cover)


def _covered(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up = kernels._power(kernels._PRIME, "up", CONTEXT)
        down = kernels._power(kernels._INVERSE, "down", CONTEXT)[:SPAN]
        for slot, data in _by_slot(batches):
            if slot < 0:
                yield _spans(_merge(np.frombuffer(data, _COVER)))
                continue
            if slot >= slots:
                own = np.frombuffer(data, _STRING)
                yield _spans(_met(own["hash"], own["doc"], own["mark"], own["at"]))
                continue
            entry = np.frombuffer(data, _ENTRY)
            entry = entry[np.argsort(entry["hash"], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], entry["hash"][1:] != entry["hash"][:-1]]))
            several = np.repeat(np.minimum.reduceat(entry["doc"], edge) != np.maximum.reduceat(entry["doc"], edge), np.diff(np.append(edge, len(entry))))
            entry = entry[several]
            covers = []
            # Whole groups of equal samples, CHUNK at a time.
            edge = np.append(np.flatnonzero(np.concatenate([[True], entry["hash"][1:] != entry["hash"][:-1]])) if len(entry) else [], len(entry)).astype(int)
            at = 0
            while at < len(edge) - 1:
                to = max(at + 1, int(np.searchsorted(edge, edge[at] + CHUNK)) - 1)
                group = entry[edge[at] : edge[to]]
                at = to
                names, rows, inners = [], [], []
                for a in range(0, len(group), CHUNK):
                    part = group[a : a + CHUNK]
                    raw = np.frombuffer(part["bytes"].tobytes(), np.uint8).reshape(len(part), CONTEXT)
                    total = np.zeros((len(part), CONTEXT + 1), _U)
                    np.cumsum(kernels._BYTE[raw] * up, axis=1, out=total[:, 1:])
                    string = kernels.mix((total[:, WIDTH : WIDTH + SPAN] - total[:, :SPAN]) * down)
                    row, inner = np.nonzero(np.arange(SPAN) < part["n"][:, None])
                    names.append(string[row, inner])
                    rows.append(row + a)
                    inners.append(inner)
                row = np.concatenate(rows)
                covers.append(_met(np.concatenate(names), group["doc"][row], group["mark"][row], group["at"][row] + np.concatenate(inners)))
            if covers:
                yield _spans(_merge(np.concatenate(covers)))

    return run


def _spans(cover: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({c: cover[c].copy() for c in ("doc", "mark", "start", "end")})


def _cut(text: str, starts, ends) -> tuple[bytes, list[tuple[int, int]], int]:
    """What stays of a text's bytes, the runs removed, and the length before."""
    blob = text.encode("utf-8", "surrogatepass")
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(blob[at:a])
        at = b
    return b"".join([*kept, blob[at:]]), runs, len(blob)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 500):
            rows = []
            part = b.iloc[at : at + 500]
            for doc_id, no_id, text, spans in zip(part["doc_id"].tolist(), part["no_id"].tolist(), part["text"], part["spans"], strict=True):
                spans = [] if spans is None else spans
                kept, runs, n = _cut(text, [int(s["start"]) for s in spans], [int(s["end"]) for s in spans])
                rows.append((doc_id, no_id, n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _bits(positions: DataFrame) -> bytes:
    """The filter as bytes on the driver: FILTER_BITS bits whatever the input, or 16 MB."""
    pages = positions.groupBy(F.floor(F.col("at") / PAGE_BITS).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(PAGE_BITS))).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in pages.toLocalIterator():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    return bytes(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every row of docs.

    Null texts are empty. Texts of fewer than 50 bytes lose nothing. Rows with
    the same id never cover each other; a null id comes after all others. Cuts
    may fall within a character, as they go by bytes. An empty table gives no
    rows; other columns play no part. Equal strings are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text, own_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    # A null beside large ids would turn an Arrow batch's ids into rounded floats.
    texts = docs.select(F.coalesce(own_id, F.lit(LAST)).alias("doc"), own_id.isNull().alias("no_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = int(min(max(16, size // 16 // PER_SLOT), 1 << 30))
    source = texts.select("doc", "mark", "text")
    packed = source.mapInPandas(tidy(_sample(slots)), "slot long, entries binary")
    counted = packed.repartition(-(-(size // 4 + 1) // PER_TASK), "slot").sortWithinPartitions("slot")
    repeated = persist(counted.mapInPandas(tidy(_repeated(max(PER_SLOT, size // 16 // HEAVY_SAMPLES))), "at long, heavy long"), "repeat-bits", gather=True)
    bits = spark.sparkContext.broadcast(_bits(repeated))
    heavy = np.sort(np.array([r["heavy"] for r in repeated.filter("heavy >= 0").select("heavy").collect()], np.int64))
    dealt = source.mapInPandas(tidy(_contexts(slots, bits, heavy)), "slot long, entries binary").repartition(-(-(size * 3 // 2 + 1) // PER_TASK), "slot").sortWithinPartitions("slot")
    covers = persist(dealt.mapInPandas(tidy(_covered(slots)), "doc long, mark long, start long, end long"), "repeat-covers", gather=True)
    spans = persist(covers.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumn("key", F.xxhash64("doc", "mark")), "repeat-spans")
    # Only texts that may lose something meet their spans; the filter passes the others by.
    keyed = texts.withColumn("key", F.xxhash64("doc", "mark"))
    keys = spans.select("key")
    touched = keep_members(keyed, keys, "key").select("doc", "no_id", "mark", "text").join(spans.drop("key"), ["doc", "mark"], "left").select("doc", "no_id", "text", "spans")
    untouched = keep_members(keyed, keys, "key", inside=False).select("doc", "no_id", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    done = touched.unionByName(untouched).withColumnRenamed("doc", "doc_id").mapInPandas(tidy(_finish), "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id").withColumnRenamed("doc_id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
