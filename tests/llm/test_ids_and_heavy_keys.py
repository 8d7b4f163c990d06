"""Null ids, ids beyond 2^53, one id with several texts, and keys that very many rows share."""

import hashlib
import random

import numpy as np
import pytest

from ferrymass.llm import byte_bpe, exact_dedup, ngram_join, substring_dedup

BIG = (1 << 60) + 1
SCHEMA = "doc_id long, text string"


def _words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_exact_copies_go_by_id_and_text(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (9, "C"), (12, "C"), (None, "A"), (None, "D"), (None, "D"), (BIG, "E"), (None, "E")]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((tuple(r) for r in exact_dedup.drop_exact_copies(frame).collect()), key=str)
    assert kept == sorted([(5, "B"), (9, "A"), (12, "C"), (None, "D"), (None, "D"), (BIG, "E")], key=str)
    told = exact_dedup.exact_dedup(frame).filter("kept").collect()
    assert len(told) == len(kept)


def test_near_copies_of_null_and_shared_ids(spark):
    a, b, c = _words(1, 200), _words(2, 200), _words(3, 200)
    near = lambda w, k: " ".join(w[:k] + ["x"] + w[k + 1 :])
    rows = [(7, near(a, 0)), (None, near(a, 1)), (None, near(b, 0)), (None, near(b, 1)), (7, near(c, 0)), (BIG, near(c, 1)), (BIG, near(a, 2))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    out = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.near_copies(frame).collect()), key=str)
    assert out == sorted([(7, 7), (None, 7), (None, None), (None, None), (7, 7), (BIG, 7), (BIG, 7)], key=str)
    kept = sorted((tuple(r) for r in ngram_join.drop_near_copies(frame).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_one_id_with_two_texts_links_neither_to_the_other(spark):
    a, b = _words(4, 100), _words(5, 100)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b[:-1])), (3, " ".join(a[:-1]))]
    out = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(1, 1), (2, 1), (3, 1)}
    rows = [(4, " ".join(a)), (4, " ".join(b)), (2, " ".join(b[:-1])), (3, " ".join(a[:-1]))]
    out = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(2, 2), (3, 3), (4, 2), (4, 3)]


@pytest.mark.parametrize("operator", [byte_bpe.digests, substring_dedup.remove_repeats, ngram_join.near_copies])
def test_large_ids_beside_null(spark, operator):
    rows = [(BIG, "one text"), (None, "another text"), (BIG + 2, None)]
    assert sorted(str(r["doc_id"]) for r in operator(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()) == sorted(map(str, [BIG, None, BIG + 2]))


def test_heavy_index_keys_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    base = _words(7, 90)
    rows = []
    for k in range(120):
        words = base[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words[: 90 - rng.randrange(12)])))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = lambda: sorted(tuple(r) for r in ngram_join.near_copies(frame).collect())
    plain = found()
    monkeypatch.setattr(ngram_join, "PER_SLOT", 20)
    monkeypatch.setattr(ngram_join, "PROBE", 1)
    monkeypatch.setattr(ngram_join, "PER_ELEMENT", 3)
    assert found() == plain


def test_heavy_samples_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    stem = "https://example.org/a/b"
    rows = [(k, "".join(rng.choices("abcdef ", k=40)) + stem + "".join(rng.choices("abcdef ", k=rng.randrange(60)))) for k in range(90)]
    rows += [(k, rows[k - 90][1] + "tail") for k in range(90, 120)] + [(200, stem * 9), (201, "x" + stem * 7)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = lambda: sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).drop("kept").collect())
    plain = found()
    assert sum(r[2] for r in plain) > 1000
    monkeypatch.setattr(substring_dedup, "PER_SLOT", 5)
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    assert found() == plain


def test_long_words_are_encoded(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rng = random.Random(9)
    texts = ["a" * 200_000, "ab" * 40_000, "the" * 5000 + "ing" * 3000, "日本語" * 2000, " " * 9000, "!?" * 3000, "".join(rng.choices("etaoinsh", k=4000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1500))]
    out = {r["doc_id"]: r for r in byte_bpe.digests(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for k, t in enumerate(texts):
        ids = np.array(coder.encode_ordinary(t), "<u4")
        assert out[k]["n_tokens"] == len(ids) and out[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
