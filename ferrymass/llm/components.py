"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrymass.llm.store import join_counted, persist, tidy


#: Links that one task replaces by a forest: some 100 MB.
PART = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's links replaced by links to the smallest member they reach within it: as connected, and fewer."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), PART // 10):
        out = [(x, root(x)) for x in nodes[at : at + PART // 10]]
        yield pd.DataFrame([(x, r) for x, r in out if x != r], columns=["u", "v"], dtype="int64")


def _least(edges: DataFrame) -> DataFrame:
    """Edges u, v with the least of u's neighbourhood; a node with very many neighbours meets it by broadcast."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    least = persist(least, "least")
    return join_counted(edges, least, ["u"], "n", edges.count())


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (u, v: long): label is the least node that links reach.

    Nodes without links are absent; links to itself and repeated links change
    nothing; no links give no rows. Parts of PART links become forests first;
    where more than one part is left, stars follow, whose rounds grow with the
    logarithm of the largest component. Each is written to the shared folder.
    """
    links = links.filter("u <> v")
    parts = -(-links.count() // PART)
    edges = persist(links.repartition(max(1, parts)).mapInPandas(tidy(_forest), "u long, v long"), "edges")
    before = None
    while parts > 1:
        state = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = persist(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = persist(_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small = _least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        edges = persist(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    pairs = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return pairs.unionByName(pairs.select(F.col("label").alias("node"), "label").distinct())
