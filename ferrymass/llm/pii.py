"""PII: patterns find protected entities, corpus co-occurrence finds the terms that give them away.

Entities are the base spans, email, ip, card, phone, and secrets: runs of twenty
letters and digits or more that carry as much information as random ones, told by
their many different characters. A term (a run of letters) near entities of a kind discloses the kind by PMI(term; kind) / IC(kind), where
PMI = log(p(term, kind) / (p(term) p(kind))) and IC = -log p(kind), all by
documents of the whole corpus: 1 for a term that never occurs without the kind
nearby, 0 for an independent one. Terms above DISCLOSURE are spans of kind term
wherever they stand outside entities, in documents without an entity too.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm.store import join_spread, keep_members, persist

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
#: The first so many are those of the base.
BASE = 4
#: Different characters of a secret at least, and digits.
VARIED, DIGITS = 8, 4
#: Code points on either side of an entity in which a term counts as near.
WINDOW = 64
#: Share of a kind's information content that a term may reveal.
DISCLOSURE = 0.9
#: Documents in which a term must be near the kind before it says anything.
SUPPORT = 3

# A run can only start a match where it begins or where the last match ended, so
# long runs that lead nowhere are passed over once, not once for each character.
# Labels are possessive: they can't be given back to any use, and a group that may
# be would take a frame of the stack for each.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9\x20-]{2,}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"[A-Za-z0-9]{20,}"
_TERM = r"\p{L}{3,}"
#: Separators that don't stand singly between digits; each becomes one letter, so places stay and runs of _CARD are matches.
_LOOSE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Matches that are gathered before they are joined to the others: appending copies an array.
RUN = 256
#: Code points of a part of a text from which stretches are cut.
CHUNK = 256


def _places(text: Column, pattern: str, kind: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Matches of pattern as spans in code points: what stands between them gives their places. Given wanted, only matches for which it is true."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    none = F.array().cast(_SPAN)

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["g"]
        last = first + F.length(p["m"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("end"), p["m"].alias("value"))
        out = F.array_append(acc["out"], span)
        return F.struct(last.alias("at"), (out if wanted is None else F.when(wanted(p["m"]), out).otherwise(acc["out"])).alias("out"))

    return _bound(pairs, lambda every: _gathered(every, none, step))


def _gathered(every: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step appends to out, an array that starts as none, over the elements of every; at starts at 0. Appending copies, so it goes by runs."""

    def run(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(every, k * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(every) / RUN).cast("int")), F.struct(F.lit(0).alias("at"), none.alias("out")), run, lambda acc: acc["out"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _part_ok(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.concat(F.lit("0"), F.substring(short, 1, 4)).cast("int") <= 255)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Entities of a non-null text, by start and then kind. Patterns run only on texts that hold their rarest character."""
    none = F.array().cast(_SPAN)
    email = F.when(F.contains(text, F.lit("@")), _places(text, _EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_places(text, _IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), _part_ok))).otherwise(none)
    runs = _places(F.regexp_replace(text, _LOOSE, "x"), _CARD, 2)

    def card_ok(s: Column) -> Column:
        d = _digits(s["value"])
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)

    card = F.when(text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), F.filter(runs, card_ok)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_places(text, _PHONE, 3), lambda s: F.length(_digits(s["value"])).between(10, 15))).otherwise(none)
    return F.sort_array(F.concat(email, ip, card, phone))


def entity_spans(text: Column) -> Column:
    """Base spans and secrets of a non-null text, by start and then kind."""

    def random_like(s: Column) -> Column:
        each = F.split(s["value"], "")
        return (F.length(_digits(s["value"])) >= DIGITS) & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(each)) >= VARIED)

    secret = F.when(text.rlike("[A-Za-z0-9]{20}"), F.filter(_places(text, _SECRET, KINDS.index("secret")), random_like)).otherwise(F.array().cast(_SPAN))
    return F.sort_array(F.concat(base_spans(text), secret))


def _chunks(text: Column) -> Column:
    """The text in parts of CHUNK code points, from which _cut takes stretches without counting from the start, and its length."""
    return F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), 0).alias("parts"), F.length(text).alias("size"))


def _cut(chunks: Column, low: Column, high: Column) -> Column:
    first = F.floor(low / CHUNK).cast("int")
    joined = F.array_join(F.slice(chunks["parts"], first + 1, F.ceil(high / CHUNK).cast("int") - first), "")
    return F.when(high > low, F.substring(joined, low - first * CHUNK + 1, high - low)).otherwise(F.lit(""))


def _windows(text: Column, spans: Column) -> Column:
    """Terms near each entity, with their places: array of (kind, term, start, end). Terms that the window's edge cuts don't count."""

    def side(chunks: Column, s: Column, low: Column, high: Column) -> Column:
        inner = F.filter(_places(_cut(chunks, low, high), _TERM, KINDS.index("term")), lambda t: ((t["start"] > 0) | (low == 0) | (low == s["end"])) & ((low + t["end"] < high) | (high == chunks["size"]) | (high == s["start"])))
        return F.transform(inner, lambda t: F.struct(s["kind"].alias("kind"), F.lower(t["value"]).alias("term"), (low + t["start"]).alias("start"), (low + t["end"]).alias("end")))

    both = lambda c, s: F.concat(side(c, s, F.greatest(F.lit(0), s["start"] - WINDOW), s["start"]), side(c, s, s["end"], F.least(c["size"], s["end"] + WINDOW)))
    return _bound(_chunks(text), lambda c: F.flatten(F.transform(spans, lambda s: both(c, s))))


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with disjoint spans, in order, replaced."""
    own = F.struct(_chunks(text).alias("chunks"), spans.alias("spans"))

    def joined(x: Column) -> Column:
        last = lambda k: F.coalesce(F.get(x["spans"], k)["end"], F.lit(0))
        pieces = F.transform(x["spans"], lambda s, k: F.concat(_cut(x["chunks"], last(k - 1), s["start"]), by(s)))
        return F.concat(F.array_join(pieces, ""), _cut(x["chunks"], last(F.size(x["spans"]) - 1), x["chunks"]["size"]))

    return _bound(own, joined)


def _outside(text: Column, spans: Column) -> Column:
    """The text with a zero for each code point of an entity, so that places stay and no term reaches into one."""

    def step(acc: Column, s: Column) -> Column:
        rest = F.struct(F.greatest(acc["at"], s["start"]).alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["out"], rest).alias("out")))

    return _replaced(text, _bound(spans, lambda every: _gathered(every, F.array().cast(_SPAN), step)), lambda s: F.repeat(F.lit("0"), s["end"] - s["start"]))


def disclosing_terms(found: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, term of the terms whose disclosure of the kind is above the threshold."""
    near = found.filter(F.size("near") > 0).select("uid", F.explode("near").alias("x")).select("uid", "x.kind", "x.term").distinct()
    joint = persist(near.groupBy("kind", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT), "pii-joint")
    wanted = persist(joint.select("term").distinct(), "pii-terms")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), 0))).alias("term"))
    often = keep_members(words, wanted, "term").groupBy("term").agg(F.count("*").alias("often"))
    kinds = found.select("uid", F.explode(F.array_distinct(F.transform("spans", lambda s: s["kind"]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("docs"))
    total = found.count()
    # Five kinds at most.
    ratio = F.log(F.col("both") * F.lit(float(total)) / (F.col("often") * F.col("docs"))) / F.log(F.lit(float(total)) / F.col("docs"))
    return joint.join(often, "term").join(F.broadcast(kinds), "kind").filter((F.col("docs") < total) & (ratio > DISCLOSURE)).select("kind", "term")


def with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """found with added: every place of every term in the texts outside entities. Only texts that may hold a term are shuffled."""
    terms = persist(terms.select("term").distinct(), "pii-marked")
    held = F.array_distinct(F.transform(F.regexp_extract_all("outside", F.lit(_TERM), 0), F.lower))
    hits = persist(keep_members(found.select("uid", F.explode(held).alias("term")), terms, "term"), "pii-hits")
    # The filter lets others through by chance; the join tells them.
    counted = persist(hits.groupBy("term").agg(F.count("*").alias("rows")).join(terms, "term", "left_semi"), "pii-counted")
    own = join_spread(hits, counted, ["term"], "rows", hits.count()).filter("rows IS NOT NULL")
    own = persist(own.groupBy("uid").agg(F.collect_set("term").alias("terms")), "pii-own")
    places = _places(F.col("outside"), _TERM, KINDS.index("term"), lambda m: F.array_contains("terms", F.lower(m)))
    lowered = F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    none = F.array().cast(_SPAN)
    meant = keep_members(found, own, "uid").join(own, "uid", "left").withColumn("added", F.when(F.col("terms").isNotNull(), lowered).otherwise(none)).drop("terms")
    return meant.unionByName(keep_members(found, own, "uid", inside=False).withColumn("added", none))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all (arrays of start, kind, end, value), and clean, the sanitised text, for every row of docs.

    Null texts are empty and have no spans; places are code points, ends
    exclusive. Rows that repeat, or share an id, or have none, each count as a
    document; an empty table gives no rows; other columns play no part. Entities
    near a term only say whether it discloses; a term that does is marked in
    every text. Terms are runs of three letters or more that stand near a kind in
    SUPPORT documents.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", entity_spans(F.col("text")).alias("spans"))
    near = F.when(F.size("spans") > 0, _windows(F.col("text"), F.col("spans")))
    masked = F.when(F.size("spans") > 0, _outside(F.col("text"), F.col("spans")))
    found = persist(based.select("uid", "doc_id", "text", "spans", near.alias("near"), masked.alias("masked")), "pii-found")
    terms = persist(disclosing_terms(found, texts), "pii-disclosing")
    told = with_terms(found.drop("near").withColumn("outside", F.coalesce("masked", "text")).drop("masked"), terms)
    merged = told.select("doc_id", "text", F.filter("spans", lambda s: s["kind"] < BASE).alias("base"), F.sort_array(F.concat("spans", "added")).alias("all"))
    return merged.select("doc_id", "base", "all", F.when(F.size("all") > 0, sanitise(F.col("text"), F.col("all"))).otherwise(F.col("text")).alias("clean"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and terms removed. Of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]" if k != "term" else "") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["out"], s).alias("out")))

    return _replaced(text, _bound(F.sort_array(spans), lambda every: _gathered(every, F.array().cast(_SPAN), step)), lambda s: F.element_at(names, s["kind"] + 1))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(spans: str, wanted: Callable[[Column], Column]) -> Column:
    """Spans of the kinds for which wanted is true."""
    return F.size(F.filter(spans, lambda s: wanted(s["kind"]))).cast("long")


def _base_counts() -> list[Column]:
    return [_count("base", F.lit(k).__eq__).alias(f"n_{KINDS[k]}") for k in range(BASE)]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    more = [_count("all", lambda kind: kind == KINDS.index("secret")).alias("n_secret"), _count("all", lambda kind: kind < KINDS.index("term")).alias("n_entities")]
    return found.select("doc_id", *_base_counts(), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), *more, F.sha2("clean", 256).alias("clean_sha256"))
