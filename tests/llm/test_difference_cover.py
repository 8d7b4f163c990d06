"""The difference-cover suffix array against sorting, and its repeats against the substring dedup operator's definition."""

from __future__ import annotations

import random

import pytest

from ferrymass.llm import difference_cover


@pytest.mark.parametrize("text", ["banana" * 7, "a" * 40, "mississippi" * 4 + "x", "abcab" * 8])
def test_ranks_are_those_of_sorted_suffixes(spark, text):
    string = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, c long")
    got = {r["pos"]: r["rank"] for r in difference_cover.suffix_ranks(string, len(text), base=12).collect()}
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert got == {p: k + 1 for k, p in enumerate(order)}


def test_covered_positions_are_those_of_a_smaller_document(spark):
    rng = random.Random(5)
    shared = bytes(rng.choices(b"abcdef ", k=90))
    texts = [bytes(rng.choices(b"abcdef ", k=rng.randrange(0, 120))) for _ in range(6)]
    texts += [texts[0] + shared, shared + texts[1], shared, b"", b"z" * 130, b"z" * 70]
    rows = [(i, i // 2 if i < 4 else i, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in difference_cover.covered_positions(spark.createDataFrame(rows, "uid long, doc long, text binary"), base=100).collect()}
    least: dict[bytes, int] = {}
    for _, doc, t in rows:
        for a in range(len(t) - 49):
            least[t[a : a + 50]] = min(doc, least.get(t[a : a + 50], doc))
    assert got == {(uid, a) for uid, doc, t in rows for a in range(len(t) - 49) if least[t[a : a + 50]] < doc}
