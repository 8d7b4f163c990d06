"""Leaves of lines, made from words that are split once, against those of whole token lists."""

import pytest
from pyspark.sql import functions as F

from ferrymass.llm import line_templates


@pytest.mark.parametrize("leading", [1, 3])
def test_a_leaf_is_that_of_all_tokens(spark, monkeypatch, leading):
    monkeypatch.setattr(line_templates, "LEADING", leading)
    lines = ["", "  ", "12 34", "<*> 5", "a", "a b1 c d", " a  b2\tc e ", "a b1 c", "<*> x", "é 7 ü", "1a 2b c"]
    made = spark.createDataFrame([(t,) for t in lines], "text string")
    t = line_templates._tokens(F.col("text"))
    want = F.when(F.exists(t, lambda x: x != "<*>"), F.xxhash64(F.size(t), F.slice(t, 1, leading)))
    rows = made.select("text", want.alias("want"), line_templates._leaf(F.col("text")).alias("leaf")).collect()
    assert [r["leaf"] for r in rows] == [r["want"] for r in rows]
    assert {r["text"] for r in rows if r["leaf"] is None} == {"", "  ", "12 34", "<*> 5"}
