"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ferrymass.llm import byte_bpe, chat, decontam, exact_dedup, langid, line_templates, ngram_join, pii, quality, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, page long, n long, set string, key string, count long, spans string, score double"
EXTRA = (1, 1, 1, "a", "b", 2, "c", 0.5)
ROWS = [
    (1, None, None, None, None, *[None] * 8),
    (2, "", "en", "x", 0, *EXTRA),
    (3, "   \n\t ", "en", "x", 6, *EXTRA),
    (4, "one", "en", "x", 3, *EXTRA),
    (5, "one", "de", "y", 3, *EXTRA),
    (5, "one", "de", "y", 3, *EXTRA),
    (6, "word " * 30_000, "de", "y", 150_000, *EXTRA),
    (7, "écrit à 🎉 jean@example.org ce soir", "fr", "y", 34, *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (6, 0, 1), (7, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "two")], "item_id long, text string")


def test_exact(odd, empty):
    out = [tuple(r) for r in exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(out) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (6, 6, 1, True), (7, 7, 1, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 5, 6, 7}


def test_ngram_join(odd, empty):
    out = [tuple(r) for r in ngram_join.near_copies(odd).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(out) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7)]
    assert ngram_join.near_copies(empty).count() == 0
    assert ngram_join.drop_near_copies(odd).columns == odd.columns


def test_pii(odd, empty):
    out = {r["doc_id"]: r for r in pii.find_pii(odd).collect()}
    assert len(out) == 7
    assert [(s["start"], s["kind"], s["end"]) for s in out[7]["base"]] == [(10, 0, 26)]
    assert not any(out[k]["base"] for k in range(1, 7))
    assert pii.find_pii(empty).count() == 0


def test_substring(odd, empty):
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert out[1]["n_bytes"] == 0 and out[6]["n_removed"] == 0 and out[6]["n_bytes"] == 150_000
    assert out[7]["kept_sha256"] == hashlib.sha256(ROWS[7][1].encode()).hexdigest()
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_lines(odd, empty):
    out = [tuple(r) for r in line_templates.drop_templates(odd).select("doc_id", "n_lines", "n_dropped").collect()]
    assert sorted(out) == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0)]
    assert line_templates.drop_templates(empty).count() == 0


def test_langid(odd, empty):
    out = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(empty).count() == 0
    blind = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}


def test_quality(odd, empty, labels):
    out = quality.classify(odd, labels).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality.classify(empty, labels).count() == 0
    assert len(quality.classify(odd, labels.limit(0)).collect()) == len(ROWS)
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_bpe(odd, empty):
    out = {r["doc_id"]: r for r in byte_bpe.digests(odd).collect()}
    assert out[1]["n_tokens"] == out[2]["n_tokens"] == 0
    for r in ROWS:
        assert out[r[0]]["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
    assert byte_bpe.digests(empty).count() == 0


def test_decontam(odd, empty, bench):
    out = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, bench).collect()}
    assert out == {(4, 1), (5, 1)}
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0
    clean = decontam.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3, 6, 7]


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi", 1),
        (1, 1, "assistant", "yes", 1),
        (2, 0, "user", "hi", 1),
        (3, 0, "user", "hi", 1),
        (3, 1, "assistant", "yes", 1),
        (3, 1, "assistant", "yes", 1),
        (4, 0, None, None, 1),
        (None, 0, "user", "lost", 1),
        (5, 0, "user", "hi", 1),
        (5, 1, "assistant", "no", 1),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, k int")
    out = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["n_absorbed"], r["rendered"]) for r in chat.format_chats(turns).collect()}
    assert out[1] == (2, 2, 1, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n")
    assert set(out) == {1, 4, 5}
    assert chat.format_chats(turns.limit(0)).count() == 0
