"""Line dedup by a log-template tree of fixed depth.

A line's place in the tree is its token count and its first LEADING tokens, or
all of a shorter line's, with tokens that hold a digit generalised. Within a leaf
that enough documents reach, a token stays in the template only where enough
documents have it at that place; other places are variable fields. Templates with
a constant token that recur over enough documents are dropped, whatever their
length; the more of a template is variable, the more documents it takes. Every
step is an aggregation by leaf, place or template, so a leaf that holds any share
of all lines is summed by parts and never met as a whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrymass.llm.store import join_spread, persist

LEADING = 3
#: Documents that a template must recur in.
DOCUMENTS = 3
#: Share of constant tokens from which that many documents are enough; each variable field more doubles them.
CONSTANT = 0.75
FIELD = "<*>"


def _words(line: Column) -> Column:
    """What a line has between white space."""
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def _general(words: Column) -> Column:
    """Words as tokens: those with a digit generalised."""
    return F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _tokens(line: Column) -> Column:
    return _general(_words(line))


def _leaf(line: Column) -> Column:
    """A line's leaf; null for one without a token that stays as it is. Words are made once, and only the leading ones generalised."""
    own = lambda t: F.when(F.exists(t, lambda w: (w != FIELD) & ~w.rlike("[0-9]")), F.xxhash64(F.size(t), _general(F.slice(t, 1, LEADING))))
    return F.element_at(F.transform(F.array(_words(line)), own), 1)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("uid", "who", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs.

    Lines end at line feeds; what stays is joined by them again. Rows with the
    same id are one document, each with a null id one of its own; a line that
    repeats within one counts once. Lines without a token, or whose tokens all
    hold digits, stay. A template goes from DOCUMENTS documents on where CONSTANT
    of its tokens are constant; each field beyond that doubles the number. Texts
    of any length are split once; rows that repeat lose the same lines. A null
    text is empty: one empty line. An empty table gives no rows; other columns
    play no part.
    """
    uid, own_id = F.monotonically_increasing_id(), F.col(id_col)
    base = docs.select(uid.alias("uid"), own_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = persist(base.withColumn("who", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("uid")))), "lines-docs")
    # A filter on the leaf in the same stage would make it twice; lines without one are left out by what reads them.
    leaves = persist(_lines(base).select("uid", "who", "line", _leaf(F.col("text")).alias("leaf")), "lines-leaves").filter("leaf IS NOT NULL")
    common = leaves.groupBy("leaf", "who").agg(F.count("*").alias("own")).groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("own").alias("size")).filter(F.col("docs") >= documents)
    common = persist(common, "lines-common")
    total = leaves.count()
    marked = persist(join_spread(leaves, common.select("leaf", "size"), ["leaf"], "size", total).filter("size IS NOT NULL").select("uid", "line", "leaf"), "lines-marked")
    wanted = marked.groupBy("uid").agg(F.collect_list(F.struct("line", "leaf")).alias("at"))
    # A text is split once and its lines are picked by number, however many there are.
    pick = lambda lines: F.transform("at", lambda e: F.struct(e["line"].alias("line"), e["leaf"].alias("leaf"), F.element_at(lines, e["line"] + 1).alias("text")))
    chosen = base.join(wanted, "uid").select("uid", "who", F.explode(F.element_at(F.transform(F.array(F.split("text", "\n")), pick), 1)).alias("e"))
    chosen = chosen.select("uid", "who", "e.line", "e.leaf", _tokens(F.col("e.text")).alias("t"))
    chosen = persist(chosen.withColumn("kind", F.xxhash64("leaf", "t")), "lines-chosen")
    lines_left = chosen.count()
    # A leaf's distinct lines first, so that copies are met once each. Of each one's documents as many
    # as a place must have are enough to tell whether it has them.
    some = chosen.select("kind", "who").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("who"))).filter(F.col("nth") <= documents)
    some = some.groupBy("kind").agg(F.collect_list("who").alias("some"))
    kinds = persist(chosen.groupBy("kind", "leaf", "t").agg(F.count("*").alias("rows")).join(some, "kind"), "lines-kinds")
    # The leading tokens are those of all the leaf.
    places = kinds.select("leaf", "kind", "some", F.posexplode("t").alias("place", "token")).filter(F.col("place") >= LEADING)
    places = places.withColumn("key", F.xxhash64("leaf", "place", "token"))
    held = places.filter(F.col("token") != FIELD).select("key", F.explode("some").alias("who"), (1 / F.size("some")).alias("part"))
    held = held.groupBy("key", "who").agg(F.sum("part").alias("part")).groupBy("key").agg(F.count("*").alias("docs"), F.ceil(F.sum("part")).alias("times"))
    steady = persist(held.filter(F.col("docs") >= documents).select("key", "times"), "lines-steady")
    kept = join_spread(places.select("kind", "place", "token", "key"), steady, ["key"], "times", kinds.agg(F.sum(F.size("t"))).first()[0] or 0)
    rest = kept.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("times").isNotNull(), F.col("token")).otherwise(F.lit(FIELD)).alias("token")))).alias("p"))
    tail = F.coalesce(F.transform("p", lambda x: x["token"]), F.array().cast("array<string>"))
    template = kinds.join(rest, "kind", "left").select("kind", "leaf", "rows", F.concat(F.slice("t", 1, LEADING), tail).alias("template"))
    size, constant = F.size("template"), F.size(F.filter("template", lambda x: x != FIELD))
    needed = documents * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(CONSTANT * size - constant)))
    template = persist(template.filter(constant > 0).select("kind", "rows", F.xxhash64("leaf", "template").alias("name"), needed.alias("needed")), "lines-templates")
    named = persist(join_spread(chosen.select("uid", "who", "line", "kind"), template, ["kind"], "rows", lines_left).filter("name IS NOT NULL").select("uid", "who", "line", "name", "needed"), "lines-named")
    recurring = named.groupBy("name", "who").agg(F.count("*").alias("own"), F.first("needed").alias("needed")).groupBy("name").agg(F.count("*").alias("docs"), F.sum("own").alias("size"), F.first("needed").alias("needed"))
    recurring = persist(recurring.filter(F.col("docs") >= F.col("needed")).select("name", "size"), "lines-recurring")
    gone = join_spread(named.select("uid", "line", "name"), recurring, ["name"], "size", lines_left).filter("size IS NOT NULL")
    gone = gone.groupBy("uid").agg(F.collect_set("line").alias("gone"))
    lines = F.split("text", "\n")
    drop = F.coalesce("gone", F.array().cast("array<int>"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.element_at(F.transform(F.array(lines), lambda own: F.transform(numbers, lambda i: F.element_at(own, i + 1))), 1)
    text = F.when(F.size(drop) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return base.join(gone, "uid", "left").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"), text.alias("kept_text"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
