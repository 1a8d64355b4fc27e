"""What the operators of this subpackage share on Spark's side."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: hot keys that ``join_hot`` broadcasts, at most, for each shuffle partition
HOT_PER_PARTITION = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``. Where it is unset (tests, one machine) a temporary
    folder is made; on a cluster that is refused, since executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
            spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lost executors cost nothing that was done before."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of ``text``), counted."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(f"`{text}`"))).alias("b")).first()
    return int(row.n), int(row.b or 0)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row a ``key``, neither null) where one key may hold a large share of the rows.

    ``weight`` says how many rows each key has. Keys with more than a HOT_PER_PARTITION-th part of an even partition's rows are hot; there can be
    no more than HOT_PER_PARTITION of them for each shuffle partition, whatever the data, so they are broadcast and their rows stay where they are. The rest is shuffled, with
    no key left that fills a task."""
    spark = rows.sparkSession
    most = HOT_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum(weight)).first()[0] or 0
    limit = max(100, total // most)
    hot = facts.filter(F.col(weight) > limit)
    rest = facts.filter(F.col(weight) <= limit)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(rest, key))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_hash(text: str) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def by_text(docs: DataFrame, keep: list[str], text: str, run, made: str) -> DataFrame:
    """``mapInArrow`` over the texts: ``run`` gets batches of the columns k0, k1, ... (``keep``) and ``body``, and returns k0, k1, ... and the columns ``made``; names of ``keep`` may be any
    but those."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    inner = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("body"))
    out = inner.mapInArrow(run, ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), made]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
