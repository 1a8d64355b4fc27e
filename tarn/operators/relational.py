"""Manifest joins, margins, rates and splits: plain DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import cut


def null_rates(df: DataFrame, *cols: str) -> DataFrame:
    """AGG-10: percent of NULL (or NaN) in each column, all in one aggregate, as rows."""
    empty = lambda c: F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    one = df.agg(*(F.round(F.avg(empty(c).cast("int")) * 100, 4).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("pct")) for c in cols))).alias("r")).select("r.*")


def describe_columns(df: DataFrame, by: str, *cols: str) -> DataFrame:
    """AGG-11, 12: mean, sample deviation, minimum, maximum and nulls of each column by group; NaN counts as NULL."""
    clean = df.select(by, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols))
    one = clean.groupBy(by).agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in cols))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), *(F.col(f"{c}.{k}").alias(k) for k in ("mean", "std", "least", "most", "nulls"))) for c in cols))
    return one.select(by, F.explode(rows).alias("r")).select(by, "r.*")


def first_row(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """FLT-10: the columns ``keep`` of the first row of each key in the order of ``order``, combined before the shuffle."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(*by, *(F.col(f"_r.{c}").alias(c) for c in keep))


def first_match(*rules: tuple[Column, str], otherwise: str) -> Column:
    """An ordered cascade of conditions."""
    return F.coalesce(*(F.when(c, F.lit(v)) for c, v in rules), F.lit(otherwise))


def in_order(df: DataFrame, *order: Column | str, parts: int | None = None, **sums: str) -> DataFrame:
    """Adds ``_part``, ``_at`` (how many rows come before in ``order``, which must leave no ties) and, by name, the sum of a column over those rows. No task sees all rows: ranges of the order are
    numbered each on its own, then moved by the totals of the ranges before them (a row a range). ``parts`` fixes the number of ranges."""
    dealt = cut(df.repartitionByRange(*([parts] if parts else []), *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_at"), *(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    moved = totals.select(F.col("_part").alias("_of"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_by_{n}") for n in ("_at", *sums)))
    w = Window.partitionBy("_part").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    here = {"_at": F.row_number().over(w) - 1} | {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
    out = dealt.withColumns({f"_in_{n}": c for n, c in here.items()}).join(F.broadcast(moved), F.col("_part") == F.col("_of"))
    return out.select(*df.columns, "_part", *((F.col(f"_in_{n}") + F.col(f"_by_{n}")).alias(n) for n in here))


def groups_in_order(sizes: DataFrame, key: str, n: str, total: int, seed: str = "split", train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """SPL-01: groups in a seeded order fill train, then valid, then test; the group that crosses a target still goes there.
    ``sizes`` has one row a group. Train is a run at the beginning of the order, so what came before in the rest is a difference."""
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    a = in_order(sizes.select(key, n, seeded.alias("_o")), "_o", key, _before=n)
    in_train = F.col("_before") < int(total * train)
    taken = a.filter(in_train).agg(F.coalesce(F.max(F.col("_before") + F.col(n)), F.lit(0)).alias("_taken"))  # one row
    rest = F.col("_before") - F.col("_taken")
    return a.crossJoin(F.broadcast(taken)).select(key, n, F.when(in_train, "train").when(rest < int(total * valid), "valid").otherwise("test").alias("split"))


def numbered_groups(df: DataFrame, group: str) -> DataFrame:
    """SPL-05: (group, fold, n): leave-one-group-out folds, numbered from 0 in the order of the groups; NULL first."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return in_order(sizes, F.asc_nulls_first(group)).select(group, F.col("_at").cast("int").alias("fold"), "n")


#: quantile sketches are off by at most one rank in so many
ACCURACY = 10_000
#: distinct values that may be sorted together
ENOUGH = 100_000


def _numbers(df: DataFrame, cols: list[str], by: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns v0, v1, ... without NaN beside the keys b0, b1, ..."""
    keys = [f"b{i}" for i in range(len(by))]
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]
    return df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), *values), keys


def _grouped_medians(df: DataFrame, cols: list[str], by: list[str], enough: int) -> DataFrame:
    """(b0, b1, ..., c, median) of column number c, rows without a value left out.

    One scan sketches all columns and brackets each one's middle; a second counts, below the bracket, and value by value within it, combined before the shuffle. So equal values cost one row, and what is left are two ten-thousandths of the distinct
    values. While more than ``enough`` are left for a median, they are cut into runs of which one goes on."""
    x, keys = _numbers(df, cols, by)
    wide = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    one = x.groupBy(*keys).agg(*(F.struct(F.count(f"v{i}").alias("n"), F.percentile_approx(f"v{i}", wide, ACCURACY).alias("q")).alias(f"s{i}") for i in range(len(cols))))
    names = [f"s{i}" for i in range(len(cols))]
    if keys:
        one = cut(one)
        met = x.join(one.select(*(F.col(k).alias(f"o{k}") for k in keys), *names), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys)))
        bounds = [(F.col(f"s{i}.q")[0], F.col(f"s{i}.q")[1]) for i in range(len(cols))]
        sizes = one.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"s{i}.n").alias("n")) for i in range(len(cols))))).alias("s")).select(*keys, "s.*")
    else:
        row = one.first()
        met = x
        edges = [row[n].q or [None, None] for n in names]
        bounds = [tuple(F.lit(v).cast("double") for v in e) for e in edges]
        sizes = df.sparkSession.createDataFrame([(i, row[n].n) for i, n in enumerate(names)], "c int, n bigint")
    at = lambda i: F.when(F.col(f"v{i}") < bounds[i][0], float("-inf")).when(F.col(f"v{i}") <= bounds[i][1], F.col(f"v{i}"))
    each = met.select(*keys, F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("c"), at(i).alias("v")) for i in range(len(cols)))), lambda s: s["v"].isNotNull())).alias("s"))
    left = cut(each.groupBy(*keys, F.col("s.c").alias("c"), F.col("s.v").alias("v")).agg(F.count("*").alias("m")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys), F.col("c") == F.col("oc"))
    sizes = sizes.filter("n > 0").withColumnsRenamed({k: f"o{k}" for k in [*keys, "c"]})
    while True:
        per = left.groupBy(*keys, "c").agg(F.count("*").alias("k"))
        if (per.agg(F.max("k")).first()[0] or 0) <= enough:
            break
        runs = left.groupBy(*keys, "c").agg(F.percentile_approx("v", [i / 128 for i in range(1, 128)], ACCURACY).alias("q")).withColumnsRenamed({k: f"o{k}" for k in [*keys, "c"]})
        run = F.size(F.filter("q", lambda e: e < F.col("v")))
        numbered = left.join(runs, same).select(*keys, "c", "v", "m", run.alias("run"))
        sums = numbered.groupBy(*keys, "c", "run").agg(F.sum("m").alias("m")).groupBy(*keys, "c").agg(F.sort_array(F.collect_list(F.struct("run", "m"))).alias("runs"))  # 128 at most
        low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        before = lambda r: F.aggregate(F.filter("runs", lambda s: s["run"] < r), F.lit(0).cast("bigint"), lambda a, s: a + s["m"])
        where = lambda rank: F.array_max(F.transform(F.filter("runs", lambda s: before(s["run"]) <= rank), lambda s: s["run"]))
        kept = sums.join(sizes, same).select(*(F.col(k).alias(f"o{k}") for k in [*keys, "c"]), where(low).alias("from"), where(high).alias("to"))
        v = F.when(F.col("run") < F.col("from"), float("-inf")).otherwise(F.col("v"))
        left = cut(numbered.join(kept, same).filter(F.col("run") <= F.col("to")).groupBy(*keys, "c", v.alias("v")).agg(F.sum("m").alias("m")))
    lists = left.groupBy(*keys, "c").agg(F.sort_array(F.collect_list(F.struct("v", "m"))).alias("vs")).join(sizes, same)
    # the value at a rank: the last one before which no more than so many values stand
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v"))
    at_rank = lambda rank: F.aggregate("vs", start, lambda a, s: F.struct((a["seen"] + s["m"]).alias("seen"), F.when(a["seen"] <= rank, s["v"]).otherwise(a["v"]).alias("v")))["v"]
    return lists.select(*keys, "c", ((at_rank(F.floor((F.col("n") - 1) / 2)) + at_rank(F.floor(F.col("n") / 2))) / 2).alias("median"))


def exact_median(df: DataFrame, col: str, *by: str, enough: int = ENOUGH) -> DataFrame:
    """AGG-14: (by, median) of the values that are neither NULL nor NaN, exact (the mean of the middle two), without a group's values in one task's memory."""
    found = _grouped_medians(df, [col], list(by), enough)
    return found.select(*(F.col(f"b{i}").alias(c) for i, c in enumerate(by)), "median")


def medians(df: DataFrame, cols: list[str], enough: int = ENOUGH) -> dict[str, float | None]:
    """ML-01: exact medians of many columns over all rows, in two scans; None for a column without values."""
    found = {r.c: r.median for r in _grouped_medians(df, cols, [], enough).collect()}  # a row a column
    return {c: found.get(i) for i, c in enumerate(cols)}


def fit_scale(df: DataFrame, *cols: str) -> DataFrame:
    """ML-01, 02: exact medians fill NULLs, then population mean and deviation scale. Medians, means and deviations are single numbers and go into the plan."""
    med = medians(df, list(cols))
    full = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(med[c]).cast("double")) for c in cols})
    stats = full.agg(*(F.avg(c).alias(f"a_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)).first()
    return full.withColumns({c: (F.col(c) - F.lit(stats[f"a_{c}"]).cast("double")) / F.lit(stats[f"s_{c}"] or 1.0) for c in cols})
