"""Line-first cleaning: rules for punctuation, navigation and boilerplate judge each line, failing lines go, and documents that lose too much text go too.

Everything is an expression over one row, so nothing shuffles and no Python runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document needs so many words.
WORDS = 10
#: Percent of words that may stand in repeated windows.
REPEATED = 20
#: Words of a window.
WINDOW = 5
#: Percent of the characters of lines with a word that failing lines may hold.
LOST = 50
#: A line fails where symbols and exclamation marks are over one in so many of its characters.
SYMBOL_SHARE = 10
SYMBOLS = "#*$%&|<>"
#: A line of fewer words without a mark at its end is a heading or a menu entry.
PHRASE = 4
#: A line with so many of " | " is a menu.
BARS = 3
SPACE = r"\x20\x09-\x0D"
END = r'[.!?…:;,"”»)\]][ \t\x0B\f\r]*$'
BOILERPLATE = ["all rights reserved", "licensed under", "released under", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "lorem ipsum", "{", "}"]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    """Code points of a class of characters."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _repeats(sorted_pairs: Column, field: str) -> Column:
    """Positions of the elements of a sorted array of (field, i) whose field stands there twice or more."""
    own = lambda p, k: F.get(p, k)[field]
    twice = _let(sorted_pairs, lambda p: F.filter(p, lambda e, k: F.coalesce(own(p, k - 1) == e[field], F.lit(False)) | F.coalesce(own(p, k + 1) == e[field], F.lit(False))))
    return F.sort_array(F.transform(twice, lambda e: e["i"]))


def _covered(positions: Column) -> Column:
    """How many words windows at sorted positions cover."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(positions, none, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])


def repeated_words(words: Column) -> Column:
    """Words of an array in windows of WINDOW words that stand in it twice or more.

    Windows are told by hashes first; those whose hash repeats, few as a rule,
    are then compared word by word.
    """

    def exact(own: Column, hashes: Column) -> Column:
        likely = _repeats(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), "h")
        spelt = F.sort_array(F.transform(likely, lambda i: F.struct(F.array_join(F.slice(own, i + 1, WINDOW), " ").alias("s"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(_repeats(spelt, "s")))

    def windows(own: Column) -> Column:
        single = F.transform(own, lambda w: F.xxhash64(w))
        return _let(single, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    return _let(words, lambda own: F.when(F.size(own) < WINDOW + 1, F.lit(0)).otherwise(_let(windows(own), lambda h: exact(own, h))))


def failing(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    noisy = line.rlike(f"[{SYMBOLS}!]") & (SYMBOL_SHARE * _count(line, SYMBOLS + "!") > F.length(line) - _count(line, SPACE))
    menu = (F.length(line) - F.length(F.replace(line, F.lit(" | "), F.lit("")))) >= 3 * BARS
    entry = ~line.rlike(END) & (F.size(_words(line)) < PHRASE)
    stock = _let(F.lower(line), lambda x: reduce(Column.__or__, [x.contains(b) for b in BOILERPLATE]))
    return noisy | menu | entry | stock


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars, line_chars, clean_text, base_failed, kept.

    A null text has no words and fails; so does any text of under WORDS words.
    Lines are parted by line feeds; only lines with a word are judged, and
    clean_text holds those that stay, joined by line feeds. Repeated rows are
    judged alike, texts of any length as a whole. Columns of docs with any of
    these names are replaced; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("again")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("same"), F.length(F.array_join(x, "")).alias("chars"), F.filter(x, lambda y: ~failing(y)).alias("good")))
    out = docs.withColumns({"_words": words, "_lines": split, "n_symbols": _count(text, SYMBOLS).cast("long")})
    out = out.withColumns({
        "n_words": F.col("_words.n").cast("long"),
        "word_chars": F.col("_words.chars").cast("long"),
        "n_repeat_words": F.col("_words.again").cast("long"),
        "n_dup_lines": F.col("_lines.same").cast("long"),
        "n_lines": F.col("_lines.n").cast("long"),
        "n_failed_lines": (F.col("_lines.n") - F.size("_lines.good")).cast("long"),
        "line_chars": F.col("_lines.chars").cast("long"),
        "lost_chars": (F.col("_lines.chars") - F.length(F.array_join("_lines.good", ""))).cast("long"),
        "clean_text": F.array_join("_lines.good", "\n"),
    }).drop("_words", "_lines")
    bad = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", bad).withColumn("kept", ~bad & (100 * F.col("lost_chars") <= LOST * F.col("line_chars")))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, with what is left of their texts; columns as before."""
    judged = judge(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text")), "_text").filter("kept")
    return judged.select("_doc.*", "clean_text").withColumn(text_col, F.col("clean_text")).select(*docs.columns) if "clean_text" not in docs.columns else judged.select(*[F.col("clean_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars"]


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*COLUMNS)


_STOCK = "|".join(f"[{b}]" if len(b) == 1 else b for b in BOILERPLATE)
_PATTERN = "[^\\x20\\x09-\\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT uid, regexp_extract_all(text, '{_PATTERN}') AS ws FROM d)),
win AS (SELECT uid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY uid ORDER BY i)),
twice AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
again AS (SELECT uid, count(*) AS n FROM (SELECT DISTINCT uid, i + k AS i FROM twice, range({WINDOW}) r(k)) GROUP BY uid),
counts AS (SELECT uid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY uid),
l AS (SELECT * FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_PATTERN}')),
j AS (SELECT uid, line, length(line) AS chars,
    {SYMBOL_SHARE} * length(regexp_replace(line, '[^{SYMBOLS}!]', '', 'g')) > length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))
    OR length(line) - length(replace(line, ' | ', '')) >= {3 * BARS}
    OR (len(regexp_extract_all(line, '{_PATTERN}')) < {PHRASE} AND NOT regexp_matches(line, '{END}'))
    OR regexp_matches(lower(line), '{_STOCK}') AS bad FROM l),
s AS (SELECT uid, count(*) AS n, count(*) - count(DISTINCT line) AS same, sum(chars) AS chars, count_if(bad) AS failed, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM j GROUP BY uid),
r AS (SELECT doc_id, coalesce(counts.n, 0) AS n_words, coalesce(counts.chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(same, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    coalesce(s.n, 0) AS n_lines, coalesce(failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(s.chars, 0) AS line_chars FROM d LEFT JOIN counts USING (uid) LEFT JOIN again USING (uid) LEFT JOIN s USING (uid)),
b AS (SELECT *, n_words < {WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {LOST} * line_chars AS kept, n_lines, n_failed_lines, lost_chars FROM b
"""
