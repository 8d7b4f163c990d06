"""What the n-gram join leaves on disk."""

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ferrymass.llm import ngram_join


def test_index_keys_are_not_written(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k // 3) * 7 + i}" for i in range(40 + k % 3)) if k else None) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    persist, kept = ngram_join.persist, {}

    def told(df, name, gather=False):
        kept[name] = persist(df, name, gather)
        return kept[name]

    monkeypatch.setattr(ngram_join, "persist", told)
    assert len(ngram_join.near_copies(frame).collect()) == 30
    assert not [n for n, t in kept.items() if any(isinstance(f.dataType, BinaryType) for f in t.schema)]
    facts = kept["near-rows"]
    assert facts.columns == ngram_join.FACTS and facts.count() == 30
    assert facts.filter("n = 0").select("doc_id", F.col("set")).collect() == [(0, 0)]
