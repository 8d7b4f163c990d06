"""Configurations of experiments as a table: lines of JSON are read strictly, and each has its values or the field at fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2**31 - 1

#: Every field with its default, in the order in which they are checked.
CHOICES = {"kind": ("flow", ["flow", "classical", "quantum"]), "dtype": ("float64", ["float32", "float64"]), "device": ("cpu", ["cpu", "gpu"]), "energy": ("entropy", ["entropy", "quadratic"])}
COUNTS = {"n": (16, 1), "m": (None, 1), "features": (1, 1), "seed": (42, 0), "max_iterations": (10_000, 1), "inner_iterations": (10_000, 0), "steps": (3, 1), "chunk_size": (1, 1), "block_size": (32, 1)}
NUMBERS = {"epsilon": 0.2, "time_step": 0.02, "tolerance": 1e-6, "inner_tolerance": 1e-10}
BACKENDS = {"flow": ["pdhg", "sinkhorn", "blocked"], "classical": ["sinkhorn", "blocked"], "quantum": ["entropy", "quadratic"]}
NAME = "^[A-Za-z0-9_-]{1,64}$"

FIELDS = ["schema_version", "name", "backend", "snapshot_stride", *CHOICES, *COUNTS, *NUMBERS]



def _kind(field: str) -> Column:
    """The type that a field has in its line; null where it is absent."""
    return F.schema_of_variant(F.col(f"_{field}"))


def _value(field: str, kind: str) -> Column:
    return F.try_variant_get(F.col(f"_{field}"), "$", kind)


def _count_bad(field: str, least: int, none: bool) -> Column:
    whole = (_kind(field) == "BIGINT") & _value(field, "bigint").between(least, LARGEST)
    absent = F.col(f"_{field}").isNull() | ((_kind(field) == "VOID") if none else F.lit(False))
    return ~absent & ~F.coalesce(whole, F.lit(False))


def _number_bad(field: str) -> Column:
    value = _value(field, "double")
    good = (_kind(field).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(field).startswith("DECIMAL")) & (value > 0) & (value < float("inf"))
    return F.col(f"_{field}").isNotNull() & ~F.coalesce(good, F.lit(False))


def _text_bad(field: str, good: Column) -> Column:
    return F.col(f"_{field}").isNotNull() & ~F.coalesce((_kind(field) == "STRING") & good, F.lit(False))


def read_configs(lines: DataFrame, column: str = "value") -> DataFrame:
    """line, fault, every field and identity: one row for each line of JSON.

    fault is null for a configuration that stands, else the first field at fault,
    `unknown` for a line with a field that isn't known, or `json` for one that is
    no object. A field that is absent has its default, m that of n. A count is a
    whole number of its range, never a text, a truth value or a fraction; numbers
    are finite and positive. A backend fits its kind; a flow has as many targets
    as sources and, but for the first-order backend, an inner tolerance of at
    most the outer one. identity is the name and sixteen digits of the digest of
    all values in order.
    """
    parsed = lines.select(F.col(column).alias("line"), F.try_variant_get(F.try_parse_json(column), "$", "map<string, variant>").alias("_fields"))
    raw = parsed.withColumns({f"_{f}": F.element_at("_fields", f) for f in FIELDS})
    texts = {c: F.coalesce(_value(c, "string"), F.lit(default)) for c, (default, _) in CHOICES.items()} | {"name": F.coalesce(_value("name", "string"), F.lit("experiment")), "backend": F.coalesce(_value("backend", "string"), F.lit("blocked"))}
    counts = {c: F.coalesce(_value(c, "bigint"), F.lit(default).cast("long")) for c, (default, _) in COUNTS.items()}
    counts["m"] = F.coalesce(_value("m", "bigint"), counts["n"])
    values = texts | counts | {c: F.coalesce(_value(c, "double"), F.lit(default)) for c, default in NUMBERS.items()} | {"schema_version": F.coalesce(_value("schema_version", "bigint"), F.lit(1).cast("long")), "snapshot_stride": _value("snapshot_stride", "bigint")}
    full = raw.withColumns(values)
    fits = reduce(Column.__or__, [(F.col("kind") == k) & F.col("backend").isin(*b) for k, b in BACKENDS.items()])
    flow = F.col("kind") == "flow"
    faults = [
        (F.col("_fields").isNull(), "json"),
        (F.size(F.array_except(F.map_keys("_fields"), F.array(*map(F.lit, FIELDS)))) > 0, "unknown"),
        (F.col("_schema_version").isNotNull() & ~F.coalesce((_kind("schema_version") == "BIGINT") & (F.col("schema_version") == 1), F.lit(False)), "schema_version"),
        (_text_bad("name", F.col("name").rlike(NAME)), "name"),
        (_text_bad("kind", F.col("kind").isin(*CHOICES["kind"][1])), "kind"),
        *[(_count_bad(c, least, c == "m"), c) for c, (_, least) in COUNTS.items()],
        (_count_bad("snapshot_stride", 1, True), "snapshot_stride"),
        *[(_number_bad(c), c) for c in NUMBERS],
        *[(_text_bad(c, F.col(c).isin(*CHOICES[c][1])), c) for c in ("dtype", "device")],
        (_text_bad("backend", F.lit(True)) | ~fits, "backend"),
        (_text_bad("energy", F.col("energy").isin(*CHOICES["energy"][1])), "energy"),
        (flow & (F.col("n") != F.col("m")), "m"),
        (flow & (F.col("backend") != "pdhg") & (F.col("inner_tolerance") > F.col("tolerance")), "inner_tolerance"),
    ]
    fault = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in faults])
    digest = F.substring(F.sha2(F.to_json(F.struct(*sorted(FIELDS))), 256), 1, 16)
    out = full.withColumn("fault", fault)
    return out.select("line", "fault", *FIELDS, F.when(F.col("fault").isNull(), F.concat_ws("-", "name", digest)).alias("identity"))


def repeated(configs: DataFrame) -> DataFrame:
    """identity, lines of configurations that stand more than once, which a batch may not hold."""
    return configs.groupBy("identity").agg(F.count("identity").alias("lines")).filter("lines > 1")
