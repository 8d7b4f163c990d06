"""Chat formatting: cumulative snapshots collapse to the longest one before rendering.

Every turn prefix of a conversation has a rolling hash: the sums, over its turns,
of two hashes of position, role and text. A logged conversation whose whole hash
is a proper prefix hash of another is an earlier snapshot of it; anti-joins drop
those, and equal ones keep the smallest id. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrymass.llm.store import join_counted, persist

PREFIX = ["k", "s1", "s2"]


def _numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their place k in the conversation. Null roles and texts count as empty."""
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("k", F.row_number().over(order).cast("long"))


def _prefixes(numbered: DataFrame) -> DataFrame:
    """conv_id, k, s1, s2, more: a row for each turn prefix; more tells whether turns follow."""
    order = Window.partitionBy("conv_id").orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolling(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "k", "role", "text").cast("decimal(20,0)")).over(so_far)

    return numbered.select("conv_id", "k", rolling(1).alias("s1"), rolling(2).alias("s2"), F.lead("k").over(order).isNotNull().alias("more"))


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged, n_absorbed of the conversations that are no prefix of another.

    n_logged counts equal ones, itself included, and n_absorbed the logged ones
    that are its earlier snapshots; a snapshot of several counts with each.
    """
    prefixes = persist(_prefixes(_numbered(turns, conv, turn, role, text)), "chat-prefixes")
    whole = persist(prefixes.filter("NOT more").groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged")), "chat-whole")
    part = prefixes.filter("more").groupBy(*PREFIX).agg(F.count("*").alias("rows"))
    seen = persist(whole.join(part, PREFIX, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))), "chat-seen")
    kept = persist(seen.filter("rows = 0").select("conv_id", F.col("k").alias("n_turns"), "n_logged"), "chat-maximal")
    # A snapshot that very many conversations begin with meets their prefixes without a shuffle.
    snapshots = seen.filter("rows > 0").select(*PREFIX, F.col("n_logged").alias("n"), "rows")
    own = prefixes.filter("more").select("conv_id", *PREFIX).join(kept.select("conv_id"), "conv_id", "left_semi")
    met = join_counted(own, snapshots, PREFIX, "rows", prefixes.count()).filter("n IS NOT NULL").groupBy("conv_id").agg(F.sum("n").alias("n_absorbed"))
    return kept.join(met, "conv_id", "left").withColumn("n_absorbed", F.coalesce("n_absorbed", F.lit(0).cast("long")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged, n_absorbed, rendered for every maximal conversation.

    Turns are taken in the order of turn (null first), role, text; rows that
    repeat count once; null roles and texts are empty; rows without a
    conversation id belong to none and are left out. A conversation that equals
    another is represented by the smallest id. An empty table gives no rows.
    Columns beside the four named play no part.
    """
    kept = persist(maximal(turns, conv, turn, role, text), "chat-kept")
    numbered = _numbered(turns, conv, turn, role, text).join(kept.select("conv_id"), "conv_id", "left_semi")
    line = F.transform(F.sort_array(F.collect_list(F.struct("k", "role", "text"))), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return numbered.groupBy("conv_id").agg(F.array_join(line, "").alias("rendered")).join(kept, "conv_id").select("conv_id", "n_turns", "n_logged", "n_absorbed", "rendered")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH rows AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows
), lines AS (
    SELECT conv_id, k, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM numbered
), prefixes AS (
    SELECT conv_id, k, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS rendered,
           count(*) OVER (PARTITION BY conv_id) AS n FROM lines
), whole AS (
    SELECT min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_logged, rendered FROM prefixes WHERE k = n GROUP BY k, rendered
), absorbed AS (
    SELECT p.conv_id, sum(w.n_logged)::BIGINT AS n_absorbed FROM prefixes p JOIN whole w ON w.n_turns = p.k AND w.rendered = p.rendered WHERE p.k < p.n GROUP BY p.conv_id
)
SELECT conv_id, n_turns, n_logged, coalesce(n_absorbed, 0)::BIGINT AS n_absorbed, rendered FROM whole w LEFT JOIN absorbed USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.k < p.n AND p.k = w.n_turns AND p.rendered = w.rendered)
"""
