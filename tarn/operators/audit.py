"""Checks and lookups of manifests: expectations, alignment, suffix lookup, next ids, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, rules: dict[str, Column], unique: str | None = None) -> DataFrame:
    """EXP-01: (expectation, violations), all rules in one pass; a rule that is NULL is violated. ``unique`` counts keys that repeat (FLT-09)."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("expectation"), F.col(n).alias("violations")) for n in rules))).alias("r")).select("r.*")
    if unique:
        rows = rows.unionByName(df.groupBy(unique).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit("unique_key").alias("expectation"), "violations"))
    return rows


def require(checked: DataFrame) -> None:
    """Stops on violations: ``checked`` is the result of ``expectations`` (one row a rule)."""
    bad = {r.expectation: r.violations for r in checked.filter("violations > 0").collect()}
    if bad:
        raise ValueError(f"expectations violated: {bad}")


def alignment(a: DataFrame, b: DataFrame, key: str, truth: str) -> DataFrame:
    """JOI-08: how two tables with unique keys differ in keys and truths, from one full join."""
    j = a.select(key, F.col(truth).alias("_a"), F.lit(1).alias("_l")).join(b.select(key, F.col(truth).alias("_b"), F.lit(1).alias("_r")), key, "full")
    left, right = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return j.agg(F.count("_l").alias("left_rows"), F.count("_r").alias("right_rows"), F.count_if(left & ~right).alias("only_left"), F.count_if(right & ~left).alias("only_right"), F.count_if(left & right & (F.col("_a") != F.col("_b"))).alias("unequal"))


def by_suffix(asked: DataFrame, key: str, raw: str, files: DataFrame, path: str, found: str) -> DataFrame:
    """JOI-09: (key, found). An equal path wins; else the first file (least ``found``) whose path the given one ends with, capitals aside. Any suffix may match, so
    each unmatched path is probed with its suffixes of the lengths that files have: an equi-join in place of all pairs."""
    norm = asked.select(key, F.translate(raw, "\\", "/").alias("_p"))
    exact = norm.join(files.groupBy(F.col(path).alias("_p")).agg(F.min(found).alias("_e")), "_p", "left")
    lengths = files.agg(F.collect_set(F.length(path)).alias("_n"))  # bounded by the longest path
    rest = exact.filter(F.col("_e").isNull()).crossJoin(F.broadcast(lengths))
    tails = rest.select(key, F.explode(F.transform(F.filter("_n", lambda n: n <= F.length("_p")), lambda n: F.lower(F.right(F.col("_p"), n)))).alias("_t"))
    hits = tails.join(files.groupBy(F.lower(path).alias("_t")).agg(F.min(found).alias("_f")), "_t").groupBy(key).agg(F.min("_f").alias("_f"))
    return exact.join(hits, key, "left").select(key, F.coalesce("_e", "_f").alias(found))


def sequence_hint(name: Column) -> Column:
    """STR-03: prefix and block of 25 of the first letters followed by three or more digits; empty if there are none."""
    p = r"([A-Za-z_]+)(\d{3,})"
    number = F.regexp_extract(name, p, 2)
    return F.when(number != "", F.concat(F.lower(F.regexp_extract(name, p, 1)), F.lit("_block_"), F.format_string("%04d", F.floor(number.try_cast("bigint") / 25)))).otherwise("")


def next_id(df: DataFrame, col: str, prefix: str, digits: int) -> DataFrame:
    """SRC-14: the number after the greatest one in use; 1 for an empty table."""
    n = F.coalesce(F.max(F.regexp_extract(col, r"(\d+)$", 1).try_cast("bigint")), F.lit(0)) + 1
    return df.agg(F.format_string(f"{prefix}%0{digits}d", n).alias("next_id"))


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """PRJ-03: columns that are missing, with a default."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c.lower() not in have})
