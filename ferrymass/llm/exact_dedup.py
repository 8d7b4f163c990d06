"""Exact dedup: two-pass Bloom filtering, then grouping of the possibly repeated rows only.

Pass 1 hashes every text to one bit in each of two filters and marks the bits
hit more than once; it shuffles pre-aggregated bit positions, not rows. Pass 2
tests every text against both filters. A text that misses one is unique and passes
straight through; only texts that hit both shuffle, by SHA-256.

The filters have 16 bits a row, up to a fixed number (store.FILTER_BITS), so what
is broadcast is bounded. A larger corpus raises the share of false hits, which
costs shuffling and never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm.store import PAGE_BITS, bit_is_set, bit_pages, filter_bits, join_counted, persist


def _position(text: Column, seed: int, bits: int) -> Column:
    h = F.xxhash64(text) if not seed else F.xxhash64(text, F.lit(seed))
    return F.pmod(h, F.lit(bits))


def _repeated_bits(texts: DataFrame, seed: int, bits: int) -> DataFrame:
    """Pages of the filter of bits that two rows or more share: page, bits (4096 bytes)."""
    at = texts.select(_position(F.col("_text"), seed, bits).alias("at")).groupBy("at").count().filter("count > 1")
    return bit_pages(at, "at")


def _tested(rows: DataFrame) -> DataFrame:
    """rows, which have _text, with _maybe: whether another may have the same text."""
    base, bits = rows, filter_bits(rows.count())
    for seed in (0, 1):
        spot = _position(F.col("_text"), seed, bits)
        pages = _repeated_bits(base, seed, bits).withColumnsRenamed({"page": "_page", "bits": f"_bits{seed}"})
        rows = rows.withColumn("_page", F.floor(spot / PAGE_BITS).cast("long")).join(F.broadcast(pages), "_page", "left").drop("_page")
    hit = [bit_is_set(_position(F.col("_text"), seed, bits), F.col(f"_bits{seed}")) for seed in (0, 1)]
    return rows.withColumn("_maybe", hit[0] & hit[1]).drop("_bits0", "_bits1")


def _sha() -> Column:
    return F.sha2(F.encode("_text", "UTF-8"), 256)


def _groups(maybe: DataFrame) -> tuple[DataFrame, int]:
    """Of each text among the possibly repeated rows the id that stays and the rows; and how many rows there are."""
    groups = persist(maybe.groupBy("text_sha256").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    return groups, groups.agg(F.sum("group_size")).first()[0] or 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and '' are one
    group. Of equal texts the row with the largest id stays; rows that repeat an
    id and text count in group_size and are all marked kept if that id stays. A
    null id never wins over another; rows of a text that only null ids have are
    all kept. An id may have several texts, each judged by itself. An empty table
    gives no rows; other columns of docs, whatever their names, play no part.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tested = persist(_tested(texts).select("_id", _sha().alias("text_sha256"), "_maybe"), "exact-tested")
    unique = tested.filter("NOT _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = tested.filter("_maybe").select("_id", "text_sha256")
    groups, total = _groups(maybe)
    found = join_counted(maybe, groups, ["text_sha256"], "group_size", total).select("_id", "keep_id", "group_size", "text_sha256")
    return unique.unionByName(found).select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup does not keep; columns as they were.

    A row goes by its own id and text: another text under the same id has no part
    in it, and a null id goes where the text has a row with an id. Rows that
    repeat both id and text, or share a text that only null ids have, stay
    together. Unique texts pass without a shuffle; an empty table stays empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tested = _tested(rows)
    maybe = tested.filter("_maybe").select("_row", "_id", _sha().alias("text_sha256"))
    groups, total = _groups(maybe)
    kept = join_counted(maybe, groups, ["text_sha256"], "group_size", total).filter(F.col("_id").eqNullSafe(F.col("keep_id")))
    return tested.filter("NOT _maybe").select("_row").unionByName(kept.select("_row")).select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
