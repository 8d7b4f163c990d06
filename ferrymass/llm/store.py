"""Tables that cut lineage, and joins that survive one very frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist

__all__ = ["bit_is_set", "bit_pages", "drop_members", "filter_bits", "give_back", "join_counted", "join_spread", "keep_members", "persist", "small_batches", "tidy"]

#: A key counts as heavy when it holds over one part in so many of the rows, so there are fewer heavy keys than this.
HEAVY_SHARE = 1000
#: Spark's own limit of an Arrow batch, 64 MB, is several times that as Python strings.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches that tasks hand to Python are of at most 4 MB, or one row, unless the session says otherwise."""
    if spark.conf.get(BATCH).rstrip("bB") == str(64 << 20):
        spark.conf.set(BATCH, str(4 << 20))


def give_back() -> None:
    """Returns a Python worker's free memory to the system at the end of a task, as workers live on and would keep it."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def tidy(run):
    """A task function over batches that gives back its memory when the batches are done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of rows to one row per key, where groups[count] says how many rows each key has.

    Keys that hold over 1/HEAVY_SHARE of the rows are fewer than HEAVY_SHARE, a
    proven bound, and join by broadcast; no shuffle meets them. The others are
    small groups and join by a shuffle on the key.
    """
    bar = max(total // HEAVY_SHARE, 1000)
    heavy = groups.filter(F.col(count) > bar)
    if total <= bar:
        return rows.join(groups, keys, "left")
    marks = heavy.select(*keys, F.lit(True).alias("_heavy"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    hot = marked.filter("_heavy").drop("_heavy").join(F.broadcast(heavy), keys, "left")
    rest = marked.filter("_heavy IS NULL").drop("_heavy").join(groups.filter(F.col(count) <= bar), keys, "left")
    return hot.unionByName(rest)


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """As join_counted, but rows are read once: heavy keys' rows take part in the shuffle, dealt by a hash of the whole row."""
    bar = max(total // HEAVY_SHARE, 1000)
    if total <= bar:
        return rows.join(groups, keys, "left")
    values = F.struct(*[c for c in groups.columns if c not in keys])
    heavy = groups.filter(F.col(count) > bar).select(*keys, values.alias("_heavy"))
    light = groups.filter(F.col(count) <= bar).select(*keys, F.lit(0).cast("long").alias("_salt"), values.alias("_light"))
    salt = F.when(F.col("_heavy").isNotNull(), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))).otherwise(0)
    joined = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).join(light, [*keys, "_salt"], "left")
    found = F.coalesce("_heavy", "_light")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in groups.columns if c not in keys])


PAGE_BITS = 32768
#: Bits of a filter that goes to every task, at most: 128 MB. Beyond some 10^8 members more rows pass by chance, which costs shuffling and never changes a result.
FILTER_BITS = 1 << 30


def filter_bits(members: int) -> int:
    """Bits of a filter for so many members: 16 each, rounded up to a power of two, from 2^20 up to FILTER_BITS."""
    return min(max(1 << 20, 1 << (16 * max(members, 1) - 1).bit_length()), FILTER_BITS)


def bit_pages(positions: DataFrame, at: str) -> DataFrame:
    """A bitmap as pages of 4096 bytes: page, bits."""
    return positions.groupBy(F.floor(F.col(at) / PAGE_BITS).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.pmod(F.col(at), F.lit(PAGE_BITS))).alias("bits"))


def bit_is_set(position, bits):
    """Whether the bit at position is set in its page; no page, no bit."""
    inner = F.pmod(position, F.lit(PAGE_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(inner / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(inner, F.lit(8)).cast("int")) == 1, F.lit(False))


def keep_members(rows: DataFrame, members: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key may be among members: all that are, and some by chance, told by a filter of bounded size. Rows don't shuffle.

    Without inside, the other rows. members is a written table, as it is read twice.
    """
    bits = filter_bits(members.count())
    pages = bit_pages(members.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("at")), "at")
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = rows.withColumn("page", F.floor(spot / PAGE_BITS).cast("long")).join(F.broadcast(pages), "page", "left")
    hit = bit_is_set(spot, F.col("bits"))
    return marked.filter(hit if inside else ~hit).drop("page", "bits")


def drop_members(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in the written table gone. Only rows that the filter lets through are shuffled."""
    kept = keep_members(rows, gone, key, inside=False)
    return kept.unionByName(keep_members(rows, gone, key).join(gone.select(key).distinct(), key, "left_anti").select(*kept.columns))
