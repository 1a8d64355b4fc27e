"""Mixing sources to target weights by systematic sampling (operator 4). DataFrame and SQL functions only.

Sources in order of code point, null last, weigh WEIGHTS in turn and share BUDGET times all words; a source stops at MOST times its words and its excess goes to the
others by weight until none is above. That is the largest water level l with target = min(MOST * size, l * weight) and all targets
together the budget: with sources in order of size / weight, those below the level are full.

A document of a source is expected target / size times, the same for each. Prefix sums of that in a fixed order, plus one random offset a source,
cross whole numbers; it is emitted once for each crossing. The order goes by size class first and
turns around from class to class, so that what a source takes in words stays near its target; and of OFFSETS offsets, evenly spaced from a random one,
the source gets the one whose words come nearest, which matters where a few long documents make up a source. The prefix sum is rank * expectation; ranks come from blocks (source, size class, salt) whose counts are summed first, so that no source,
however hot, is ranked in one task.

Nulls: null text has size 0; null sources are one source. Sources without words have target 0 and take none. Repeated rows and equal ids are documents of their own.
Empty tables give no rows. Other columns are ignored. Reruns agree: offsets and orders are hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._spark import cut, fresh

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
BLOCK = 1_000
OFFSETS = 32
SEED = "mix"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash(*parts: Column | str) -> Column:
    """32 bits of an md5, as any SQL engine computes it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to one row a source with ``source`` and ``size``."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sources.withColumn("w", weight).withColumn("full_at", F.lit(float(MOST)) * F.col("size") / F.col("w"))
    upto = Window.orderBy("full_at", "w", F.col("source").asc_nulls_last())
    sums = ranked.withColumn("total", F.sum("size").over(Window.partitionBy())).withColumn("filled", F.coalesce(F.sum(F.col("size")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("open_w", F.sum("w").over(upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the level if this source and all after it were open; the least full_at that reaches it decides
    sums = sums.withColumn("level", (F.lit(BUDGET) * F.col("total") - F.lit(float(MOST)) * F.col("filled")) / F.col("open_w"))
    final = sums.withColumn("final", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(Window.partitionBy()))
    return final.select("source", "n", "size", F.least(F.lit(float(MOST)) * F.col("size"), F.coalesce(F.col("final.level"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def copies(light: DataFrame) -> DataFrame:
    """From rows with source, size and tie (an order of equal documents), adds source_size, target and copies."""
    light = cut(light.withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int")))
    # a row a source and size class, of which there are some 80 at most
    kinds = cut(light.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    per = targets(kinds.groupBy("source").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"),
        ((_hash(F.lit(SEED), F.coalesce(F.col("source"), F.lit("")))) / F.lit(float(1 << 32))).alias("offset"),
    )
    known = kinds.select("source", F.col("class").alias("k"), F.ceil(F.col("n") / BLOCK).alias("salts")).join(per, F.col("source").eqNullSafe(F.col("s"))).drop("source")
    rows = light.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))).drop("s", "k").withColumn("salt", F.pmod(F.col("tie"), F.col("salts")))
    key = ["source", "class", "salt"]
    # counts are of (source, class, salt): the blocks before each, in order, are summed over this small table
    block = rows.groupBy(*key).agg(F.count("*").alias("c"))
    # blocks of one source are its rows / BLOCK and one a class at most: a thousandth of its rows
    block = block.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*(F.col(k).alias(f"b_{k}") for k in key), "before")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.when(F.col("class") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "tie", "key")))
    joined = ranked.join(block, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("salt") == F.col("b_salt")))
    placed = cut(joined.withColumn("rank", F.col("before") + F.col("nth")).drop(*(f"b_{k}" for k in key), "before", "nth", "salt", "salts", "class"))
    up = lambda at: F.least(F.floor(F.col("rank") * F.col("rate") + at) - F.floor((F.col("rank") - 1) * F.col("rate") + at), F.ceil(F.col("rate")))
    moved = [F.col("offset") + i / OFFSETS - F.floor(F.col("offset") + i / OFFSETS) for i in range(OFFSETS)]
    words_at = placed.groupBy("source").agg(F.first("target").alias("t"), F.first("offset").alias("offset"), *(F.sum(up(at) * F.col("size")).alias(f"w{i}") for i, at in enumerate(moved)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{i}") - F.col("t")).alias("gap"), F.lit(i).alias("i")) for i in range(OFFSETS))))["i"]
    chosen = words_at.select(F.col("source").alias("s"), (F.col("offset") + nearest / OFFSETS - F.floor(F.col("offset") + nearest / OFFSETS)).alias("at"))
    return placed.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", up(F.col("at"))).drop("s", "at", "rank", "offset", "rate")


def _light(docs: DataFrame, *more: Column) -> DataFrame:
    # of the text as well, so that rows without or with one doc_id are spread over blocks
    tie = _hash(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select("doc_id", "source", words("text").alias("size"), tie.alias("tie"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("key"), *more)


def digest(docs: DataFrame) -> DataFrame:
    return copies(_light(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """All columns of the documents taken, a row for each copy, and ``copy`` (1, 2; another name if there is one).

    Copies are decided on light rows (doc_id, source, a hash of the text). Each task then hashes its decisions and texts stream past them, shuffled once and never sorted.
    Rows that repeat a document entirely are one key there: their copies are summed and dealt out again; only if there are such rows, rows are sorted by that key."""
    name, mark, nth = fresh(docs, "copy", "mark", "nth")
    got = copies(_light(docs, F.xxhash64("text").alias("mark"))).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("mark").alias("m_mark"), "copies")
    times = cut(got.groupBy("m_id", "m_source", "m_mark").agg(F.sum("copies").cast("int").alias("m_copies"), F.count("*").alias("m_rows")).filter("m_copies > 0"))
    key = [F.col("m_id"), F.col("m_source"), F.col("m_mark")]
    taken = docs.withColumn(mark, F.xxhash64("text")).join(times.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(key[0]) & F.col("source").eqNullSafe(key[1]) & (F.col(mark) == key[2]))
    own = F.col("m_copies")
    if not times.filter("m_rows > 1").isEmpty():
        taken = taken.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(mark)))
        own = F.floor(F.col(nth) * own / F.col("m_rows")) - F.floor((F.col(nth) - 1) * own / F.col("m_rows"))
    each = taken.select(*(F.col(f"`{c}`") for c in docs.columns), F.posexplode(F.array_repeat(F.lit(0), own.cast("int"))).alias(name, mark))
    return each.drop(mark).withColumn(name, F.col(name) + 1)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS tie FROM documents
), c AS (SELECT *, floor(log2(size + 1.0::DOUBLE) * 4)::INT AS class FROM d),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS ssize FROM c GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
f AS (SELECT *, 2.0::DOUBLE * ssize / w AS full_at, sum(ssize) OVER () AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(ssize) OVER (ORDER BY full_at, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY full_at, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lv AS (SELECT arg_min(level, full_at) AS level FROM l WHERE full_at >= level),
t AS (SELECT source, n, ssize, least(2.0::DOUBLE * ssize, lv.level * w) AS target,
          ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM l, lv),
r AS (SELECT doc_id, c.source, size, ssize, target, off, CASE WHEN ssize > 0 THEN target / ssize ELSE 0 END AS rate,
          row_number() OVER (PARTITION BY c.source ORDER BY class, tie % ceil(m / 1000.0)::BIGINT, CASE WHEN class % 2 = 0 THEN size ELSE -size END, tie, doc_id) AS k
      FROM (SELECT *, count(*) OVER (PARTITION BY source, class) AS m FROM c) c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
o AS (SELECT off, rate, k, size, target, source, j, off + j / 32.0::DOUBLE - floor(off + j / 32.0::DOUBLE) AS u FROM r, range(32) x(j)),
g AS (SELECT source, j, any_value(u) AS u, abs(sum(least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) * size) - any_value(target)) AS gap FROM o GROUP BY source, j),
b AS (SELECT source, arg_min(u, [gap, j]) AS u FROM g GROUP BY source)
SELECT doc_id, size, ssize AS source_size, target,
       (least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) * size)::BIGINT AS taken FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
