"""Thresholds, simplex projections and medians of groups of any size: no group is ever gathered or sorted.

The threshold t with sum(max(t - z, 0)) = target is the mean of the z below it,
plus target over their number. From the mean of all, t falls with the set of z
below it until that set stays as it is: a few rounds of one partial aggregation,
over rows that are written anew whenever half of them have gone. A median is
found by counts in ranges that shrink from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrymass.checkpoints import persist, remove

#: Keys whose levels go to every task by broadcast, and live in the driver between rounds; more are written and joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Ranges of a key that a round counts, and values of a key that one task may sort.
RANGES, FEW = 256, 1000


def _with(rows: DataFrame, levels: DataFrame, key: str, keys: int) -> DataFrame:
    """rows with the level of their key; null is a key too."""
    own = levels.withColumnRenamed(key, "_key")
    return rows.join(F.broadcast(own) if keys <= BROADCAST_KEYS else own, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def _kept(levels: DataFrame, keys: int) -> DataFrame:
    return levels.sparkSession.createDataFrame(levels.toArrow(), levels.schema) if keys <= BROADCAST_KEYS else persist(levels, "levels")


def _level(rows: DataFrame, key: str) -> DataFrame:
    made = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.max("target").alias("target"))
    return made.select(key, "n", ((F.col("s") + F.col("target")) / F.col("n")).alias("t"))


def thresholds(values: DataFrame, key: str, z: Column, target: Column | float) -> DataFrame:
    """key, t with sum(max(t - z, 0)) = target over the rows of each key; target is positive, and one for a key. Null and NaN values take no part; null is a key."""
    aim = target if isinstance(target, Column) else F.lit(float(target))
    rows = persist(values.select(key, z.cast("double").alias("z"), aim.alias("target")).filter("z IS NOT NULL AND NOT isnan(z)"), "threshold-values")
    keys = rows.select(key).distinct().count()
    levels = _kept(_level(rows, key), keys)
    held = levels.agg(F.sum("n")).first()[0] or 0
    while True:
        below = _with(rows, levels.select(key, "t"), key, keys).filter("z < t").select(key, "z", "target")
        new = _kept(_level(below, key), keys)
        left = new.agg(F.sum("n")).first()[0] or 0
        # Sets only shrink, so they are all as they were if their sizes' sum is.
        same = left == levels.agg(F.sum("n")).first()[0] or not left
        if left < held / 2 and not same:
            fewer = persist(below, "threshold-values")
            remove(rows)
            rows, held = fewer, left
        remove(levels)
        levels = new
        if same:
            remove(rows)
            return levels.select(key, "t")


def simplex(values: DataFrame, key: str, v: str, mass: float = 1.0) -> DataFrame:
    """values with x: for each key the nearest entries to v that are not negative and sum to mass."""
    levels = persist(thresholds(values, key, -F.col(v), mass), "simplex-level")
    return _with(values, levels, key, levels.count()).withColumn("x", F.greatest(F.col(v) + F.col("t"), F.lit(0.0))).drop("t")


def medians(values: DataFrame, key: str, v: str) -> DataFrame:
    """key, median of the finite values of each key: the middle one, or the mean of the two in the middle.

    A round counts each key's values in RANGES equal ranges between the least and
    the greatest that are left, and goes on with the range that holds the middle
    one. Ranges of one value are done, those of FEW values are sorted. Keys
    without a finite value have none; null is a key.
    """
    x = F.col(v).cast("double")
    rows = persist(values.select(key, x.alias("x")).filter(F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), "median-values")
    whole, facts = rows, [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    first = rows.groupBy(key).agg(*facts)
    keys = rows.select(key).distinct().count()
    state = _kept(first.withColumn("skip", F.floor((F.col("n") - 1) / 2)), keys)
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > FEW)
    while not state.filter(wide).isEmpty():
        near = _with(rows, state.filter(wide).select(key, "lo", "hi", "skip"), key, keys).filter("x BETWEEN lo AND hi")
        # Halved first, as the width of a range of large numbers may be too large itself.
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1))
        counted = near.groupBy(key, part.alias("part"), "skip").agg(*facts)
        upto = F.sum("n").over(Window.partitionBy(key).orderBy("part"))  # RANGES rows a key
        held = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("n") <= F.col("skip")))
        found = held.select(key, "n", "lo", "hi", (F.col("skip") - F.col("upto") + F.col("n")).alias("skip"))
        new = _kept(found.unionByName(state.filter(~wide)), keys)
        fewer = persist(_with(rows, new.select(key, "lo", "hi"), key, keys).filter("x BETWEEN lo AND hi").select(key, "x"), "median-values")
        if rows is not whole:
            remove(rows)
        rows, state = fewer, new
    few = _with(rows, state.select(key, "lo", "hi", "skip", "n"), key, keys).filter("x BETWEEN lo AND hi AND lo < hi").groupBy(key, "skip").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # FEW values
    middle = few.select(key, F.element_at("xs", (F.col("skip") + 1).cast("int")).alias("m")).unionByName(state.filter("lo = hi").select(key, F.col("lo").alias("m")))
    middle = _kept(middle, keys)
    beside = _with(whole, middle, key, keys).groupBy(key, "m").agg(F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("m")).alias("upto"), F.min(F.when(F.col("x") > F.col("m"), F.col("x"))).alias("next"))
    even = (F.col("n") % 2 == 0) & (F.col("upto") <= F.floor(F.col("n") / 2))
    return beside.select(key, F.when(even, F.col("m") / 2 + F.col("next") / 2).otherwise(F.col("m")).alias("median"))
