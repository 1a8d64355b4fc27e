"""Exact and near duplicates by 64-bit hashes, leakage between splits, and connected components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.pose import _settled
from tarn.session import cut


def exact_groups(df: DataFrame, key: str, body: str) -> DataFrame:
    """DUP-01: groups of two or more rows of equal content, by SHA-256."""
    sha = F.sha2(F.col(body).cast("binary"), 256)
    return df.filter(F.col(body).isNotNull()).select(key, "split", sha.alias("sha")).groupBy("sha").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.count_distinct("split").alias("splits")).filter("n >= 2")


@lru_cache(1 << 16)
def _bits(word: str) -> bytes:
    return hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8]


def simhash(df: DataFrame, key: str, body: str) -> DataFrame:
    """64-bit hash of each text in two halves (hi, lo): the sign of the sum of its distinct words' md5 bits; NULL texts have none. Rows are hashed by themselves in Arrow batches, nothing is
    shuffled. (As a fold over arrays in Columns the same took 80 microseconds a word; exploded words shuffle 64 sums a text.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = re.compile(r"[ \t\n\x0b\f\r]+")
        for batch in batches:
            out = np.zeros((batch.num_rows, 8), np.uint8)
            for i, text in enumerate(batch.column("body")):
                words = {*space.split(text.as_py().lower())}
                ones = np.unpackbits(np.frombuffer(b"".join(map(_bits, words)), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > len(words))
            halves = out.view(">u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["key", "hi", "lo"])

    light = df.select(F.col(key).alias("key"), F.col(body).alias("body")).filter(F.col("body").isNotNull())
    return light.mapInArrow(run, f"key {dict(df.dtypes)[key]}, hi bigint, lo bigint").withColumnRenamed("key", key)


def hamming():
    return F.bit_count(F.col("a_hi").bitwiseXOR(F.col("b_hi"))) + F.bit_count(F.col("a_lo").bitwiseXOR(F.col("b_lo")))


def _part(value: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << bits) - 1))


def _without(value: Column, at: int, bits: int) -> Column:
    """The number without ``bits`` bits from bit ``at`` on."""
    return F.shiftleft(F.shiftrightunsigned(value, at + bits), at).bitwiseOR(value.bitwiseAND(F.lit((1 << at) - 1)))


def _spans(total: int, parts: int) -> list[tuple[int, int]]:
    width = total // parts
    return [(i * width, width if i < parts - 1 else total - (parts - 1) * width) for i in range(parts)]


def _rest(band: int, hi: str, lo: str) -> Column:
    """The 48 bits of a hash beside one of its four bands of 16."""
    h, low = F.col(hi), F.col(lo)
    if band < 2:
        return F.shiftleft(h.bitwiseAND(F.lit(65535)) if band == 0 else F.shiftright(h, 16), 32).bitwiseOR(low)
    return F.shiftleft(h, 16).bitwiseOR(low.bitwiseAND(F.lit(65535)) if band == 2 else F.shiftright(low, 16))


#: hashes of a bucket from which it is split further
FULL = 2_000


def candidates(one: DataFrame, most: int, full: int = FULL) -> DataFrame:
    """(a_key, a_hi, a_lo, b_key, b_hi, b_lo, bucket, third) of hashes that meet; a pair may meet several times. ``one``: key, hi, lo, distinct hashes.

    Pairs share one of four bands of 16 bits, and of the other 48 bits one of ``most`` + 1 parts (24 bits together for ``most`` 5). A bucket of more than ``full`` hashes is split by the bits that are left: what differs in at most
    ``most`` of them shares one of ``most`` + 1 parts of these too. Candidates of N evenly spread hashes grow as N squared / 2^24, and those of a full bucket fall by another 2^6. Rows that are shuffled are a number for the bucket and the hash itself."""
    spans = _spans(48, most + 1)
    value = [F.shiftright("hi", 16), F.col("hi").bitwiseAND(F.lit(65535)), F.shiftright("lo", 16), F.col("lo").bitwiseAND(F.lit(65535))]
    # per band: its value and number in the high bits, and the rest of the hash
    bands = F.explode(F.array(*(F.struct(F.shiftleft(F.shiftleft(v, 2) + k, 34).alias("band"), _rest(k, "hi", "lo").alias("rest")) for k, v in enumerate(value)))).alias("s")
    each = one.select("key", "hi", "lo", bands).select("key", "hi", "lo", "s.band", "s.rest")
    met = each.select("key", "hi", "lo", "rest", F.explode(F.array(*(F.col("band") + F.lit(i << 24) + _part(F.col("rest"), at, bits) for i, (at, bits) in enumerate(spans)))).alias("bucket"))
    sized = _settled(met.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1"))
    part = F.shiftright("bucket", 24).bitwiseAND(F.lit(1023))
    left = F.coalesce(*(F.when(part == i, _without(F.col("rest"), at, bits)) for i, (at, bits) in enumerate(spans)))
    thirds = _spans(48 - max(bits for _, bits in spans), most + 1)
    sized = _settled(sized.select("key", "hi", "lo", "bucket", F.when(F.col("n") > full, left).alias("left")))
    third = F.when(F.col("left").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(*(F.lit(i << 32) + _part(F.col("left"), at, bits) for i, (at, bits) in enumerate(thirds))))
    split = sized.select("key", "hi", "lo", "bucket", F.explode(third).alias("third"))
    side = lambda p: split.select(*(F.col(c).alias(f"{p}_{c}") for c in ("key", "hi", "lo")), "bucket", "third")
    return side("a").join(side("b"), ["bucket", "third"]).filter("a_key < b_key")


def near_pairs(hashes: DataFrame, most: int, full: int = FULL) -> DataFrame:
    """DUP-02 and DUP-03: pairs at most ``most`` bits apart that share one of four 16-bit bands. One row a distinct hash (min key) goes in, so copies never multiply; a pair is kept where it meets in the first
    band, first part and, in a full bucket, first third part that it shares, which needs no distinct."""
    one = hashes.groupBy("hi", "lo").agg(F.min("key").alias("key"))
    near = candidates(one, most, full).withColumn("distance", hamming()).filter(F.col("distance") <= most)
    spans = _spans(48, most + 1)
    thirds = _spans(48 - max(bits for _, bits in spans), most + 1)
    x, y = F.col("hi"), F.col("lo")
    near = _settled(near.select("a_key", "b_key", "distance", "bucket", "third", F.col("a_hi").bitwiseXOR(F.col("b_hi")).alias("hi"), F.col("a_lo").bitwiseXOR(F.col("b_lo")).alias("lo")))
    gaps = (F.shiftright(x, 16), x.bitwiseAND(F.lit(65535)), F.shiftright(y, 16), y.bitwiseAND(F.lit(65535)))
    band = F.coalesce(*(F.when(g == 0, k) for k, g in enumerate(gaps)))
    rest = F.coalesce(*(F.when(F.col("band") == k, _rest(k, "hi", "lo")) for k in range(4)))
    near = _settled(_settled(near.withColumn("band", band)).withColumn("rest", rest))
    part = F.coalesce(*(F.when(_part(F.col("rest"), at, bits) == 0, i) for i, (at, bits) in enumerate(spans)))
    near = _settled(near.withColumn("part", part))
    left = F.coalesce(*(F.when(F.col("part") == i, _without(F.col("rest"), at, bits)) for i, (at, bits) in enumerate(spans)))
    near = _settled(near.withColumn("left", left))
    first = F.coalesce(*(F.when(_part(F.col("left"), at, bits) == 0, i) for i, (at, bits) in enumerate(thirds)))
    here = (F.shiftright("bucket", 34).bitwiseAND(F.lit(3)) == F.col("band")) & (F.shiftright("bucket", 24).bitwiseAND(F.lit(1023)) == F.col("part")) & ((F.col("third") < 0) | (F.shiftright("third", 32) == first))
    return near.filter(here).select("a_key", "b_key", "distance")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """DUP-06/07: (node, root), root the least node of the component. Labels pass along edges and jump along labels; each round is
    checkpointed, so the plan stays short and lost executors lose nothing."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        jump = cut(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left").select("node", "root", F.coalesce(F.least("to", "far"), F.col("to")).alias("to")))
        if jump.filter("to <> root").isEmpty():
            return label
        label = jump.select("node", F.col("to").alias("root"))


def cross_split(hashes: DataFrame, most: int) -> DataFrame:
    """DUP-04: ``exact`` for a hash found in several splits (a_key = b_key, its least key), ``near`` for two hashes at most ``most`` bits apart
    found in different splits. One row a distinct hash goes into the pairing."""
    home = hashes.groupBy("hi", "lo").agg(F.min("key").alias("key"), F.collect_set("split").alias("s"))
    exact = home.filter(F.size("s") > 1).select(F.col("key").alias("a_key"), F.col("key").alias("b_key"), F.lit("exact").alias("kind"))
    at = lambda p: home.select(F.col("key").alias(f"{p}_key"), F.col("s").alias(f"{p}_s"))
    near = near_pairs(hashes, most).join(at("a"), "a_key").join(at("b"), "b_key").filter(F.size(F.array_union("a_s", "b_s")) > 1)
    return near.select("a_key", "b_key", F.lit("near").alias("kind")).unionByName(exact)
