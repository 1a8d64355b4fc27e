"""N-gram Jaccard join by MinHash banding (operator 2).

Two texts are linked when the Jaccard likeness of their sets of SHINGLE-word runs (words are ``[^\\x20\\x09-\\x0D]+``, unchanged) is
THRESHOLD or more. Rows per band and bands follow from the recall asked for at the threshold (``banding``).

1. Every text gets its band hashes. Equal texts form a class; from here on each class is one row.
2. Band hashes are shuffled. A bucket is what shares a band hash; buckets of one class end here, and of buckets with the same members only that of the first band goes on.
3. *Verify.* Each class sends its full shingle set (64-bit hashes) to its buckets. A pair is compared in the bucket of the first band it shares, so once, whatever it shares
   besides. Small buckets are packed into tasks of BLOCK_BYTES; a larger bucket is cut into blocks of that size by hash, and tasks compare block
   with block. Intersections are counted exactly; link counts and, for each class, one member of its group leave the task, never pairs.
4. Components of these give the near-duplicate groups.

Pairs that share no band are never compared, so unrelated texts that a chain of buckets connects cost nothing. Recall of a single pair at likeness exactly THRESHOLD
is RECALL by the formula of banding, higher above; links are verified on whole sets, and none is wrong but for collisions of 64-bit shingle hashes. The comparisons of one
bucket of very many *different* texts still grow with its square, spread over its block pairs, and each of its sets is sent once a block.

Nulls and texts without words have no shingles and link to nothing (each such text is its own class; equal ones share it). Fewer
than SHINGLE words: one shingle of all words. Repeated rows are copies. A null key is kept as a row but never represents a class unless all
its copies have null keys. Other columns are ignored. Very long texts are handled alone. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import cut, fresh, join_hot, text_hash
from tarn.llm._words import Words, ngrams, word_chunks

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
MOST_HASHES = 256
BLOCK_BYTES = 8 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands reach ``recall`` at ``threshold`` within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(words: Words, d: int, k: int = SHINGLE, grams: np.ndarray | None = None) -> np.ndarray:
    """The distinct shingle hashes of text d."""
    lo, hi = words.first[d], words.first[d + 1]
    if hi - lo < k:
        return ngrams(words.hash[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64)
    return np.unique(grams[lo : hi - k + 1] if grams is not None else ngrams(words.hash[lo:hi], k))


class _Signer:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64((1 << 64) - 1))
        for i in range(0, len(x), 512):
            part = x[i : i + 512, None] * self.a
            part += self.b
            np.minimum(least, part.min(0), out=least)
        top = (least >> np.uint64(32)).reshape(self.bands, self.rows)
        return ngrams_rows(top) ^ np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def ngrams_rows(x: np.ndarray) -> np.ndarray:
    """One hash for each row of x."""
    out = np.zeros(len(x), np.uint64)
    for c in range(x.shape[1]):
        out = (out ^ x[:, c]) * np.uint64(0xD1342543DE82EF95)
        out ^= out >> np.uint64(29)
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """key, cls (a hash of the text), bands (null without shingles), size (distinct shingles) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches):
        signer = _Signer(bands, rows)
        for batch in batches:
            out: list = []
            sizes: list[int] = []
            for i, j, words in word_chunks(batch.column("text")):
                grams = ngrams(words.hash, k)
                for d in range(j - i):
                    s = shingles(words, d, k, grams)
                    sizes.append(len(s))
                    out.append(signer(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("cls"), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["key", "cls", "bands", "size"])

    hashed = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_hash(f"`{text}`").alias("cls"))
    return hashed.mapInArrow(sign, f"key {kind}, cls binary, bands array<bigint>, size bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each connected component, by label passing with pointer jumping; each round is written."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")).filter("u <> v")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left").select("node", F.coalesce(F.least("next", "far"), F.col("next")).alias("next"), "root")
        jump = cut(jump)
        if jump.filter("next <> root").isEmpty():
            return label
        label = jump.select("node", F.col("next").alias("root"))


def _compare(left: list[np.ndarray], right: list[np.ndarray], within: bool, bands: tuple[np.ndarray, np.ndarray], idx: int, threshold: float):
    """Exact likeness of the pairs (within: of left alone) whose first shared band is ``idx``. Yields (left index, right indices linked)."""
    sizes = np.array([len(x) for x in right])
    _, ids = np.unique(np.concatenate([*left, *right] if not within else left), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(x) for x in left]), *([] if within else [np.cumsum(sizes) + sum(map(len, left))])]).astype(np.int64)
    other = at if within else at[len(left) :]
    here = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    mine, theirs = (b[:, :idx] for b in bands)
    for i in range(len(left)):
        n = int(at[i + 1] - at[i])
        may = (sizes >= threshold * n - 1e-9) & (n >= threshold * sizes - 1e-9)
        if within:
            may[: i + 1] = False
        if idx and may.any():
            some = np.flatnonzero(may)
            may[some] = ~(theirs[some] == mine[i]).any(1)
        some = np.flatnonzero(may)
        if not len(some):
            continue
        own = ids[at[i] : at[i + 1]]
        here[own] = True
        long = sizes[some]
        start = np.cumsum(long) - long
        spread = np.repeat(other[some] - start, long) + np.arange(long.sum())
        shared = np.add.reduceat(here[ids[spread]].astype(np.int64), start)
        here[own] = False
        # shared / (n + size - shared) >= threshold, without a division
        yield i, some[shared >= threshold * (n + long - shared) - 1e-9]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _verify(threshold: float, bands: int):
    def verify(table: pa.Table) -> pa.Table:
        """Links within one task: cls, root (a member of its group in a bucket), links, linked rows."""
        cls, copies = table.column("cls").to_pylist(), table.column("copies").to_numpy()
        side, band, first = (table.column(c).to_numpy() for c in ("side", "band", "idx"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        marks = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, bands)
        order = np.argsort(band, kind="stable")
        links, rows = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        forest = _Forest(len(cls))
        for unit in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            within = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
            lefts = unit if within else unit[side[unit] == 0]
            rights = unit if within else unit[side[unit] == 1]
            if not len(lefts) or not len(rights):
                continue
            for i, found in _compare([sets[x] for x in lefts], [sets[x] for x in rights], within, (marks[lefts], marks[rights]), int(first[unit[0]]), threshold):
                if not len(found):
                    continue
                me, them = lefts[i], rights[found]
                links[me] += len(them)
                rows[me] += copies[them].sum()
                links[them] += 1
                rows[them] += copies[me]
                for x in them.tolist():
                    forest.tie(int(me), x)
        keep = np.flatnonzero(links > 0).tolist()
        return pa.table({"cls": pa.array([cls[i] for i in keep], pa.binary()), "root": pa.array([cls[forest.root(i)] for i in keep], pa.binary()), "links": pa.array(links[keep], pa.int64()), "rows": pa.array(rows[keep], pa.int64())})

    return verify


def _units(classes: DataFrame, block_bytes: int) -> DataFrame:
    """cls and its buckets to compare in: (band, idx, pack, blocks); at most one a band."""
    entries = classes.select("cls", "size", F.posexplode("bands").alias("idx", "band"))
    mark = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"m{i}") for i in range(2)]
    buckets = entries.groupBy("band").agg(F.count("*").alias("n"), (F.sum("size") * 8 + F.count("*") * 300).alias("bytes"), F.min("idx").alias("idx"), *mark).filter("n > 1")
    # buckets with the same members: the first band's stands for all
    units = buckets.groupBy("n", "bytes", "m0", "m1").agg(F.min(F.struct("idx", "band")).alias("b")).select("b.band", "b.idx", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    units = cut(units)
    packs = max(1, int(units.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0) // block_bytes)
    units = units.select("band", "blocks", F.when(F.col("blocks") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(packs))).alias("pack"))
    return entries.join(units, "band").groupBy("cls").agg(F.collect_list(F.struct("band", "idx", "pack", "blocks")).alias("units"))


def _groups(docs: DataFrame, key: str, text: str, k: int, threshold: float, recall: float, most: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(key and cls of every row; of every class text_id, copies, bare, links, rows and the representative (least key, its cls) of its group), both written."""
    bands, rows = banding(threshold, recall, most)
    light = cut(signatures(docs, key, text, k, bands, rows))
    classes = cut(light.groupBy("cls").agg(F.min("key").alias("text_id"), F.count("*").alias("copies"), F.first("bands", True).alias("bands"), F.first("size").alias("size")))
    placed = cut(_units(classes, block_bytes).join(classes.select("cls", "text_id", "copies", "bands"), "cls"))

    def sets(batches):
        for batch in batches:
            out: list = []
            for i, j, words in word_chunks(batch.column("text")):
                grams = ngrams(words.hash, k)
                out += [shingles(words, d, k, grams).tobytes() for d in range(j - i)]
            marks = [np.array(x, np.int64).tobytes() for x in batch.column("bands").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cls", "copies", "units")] + [pa.array(marks, pa.binary()), pa.array(out, pa.binary())], ["cls", "copies", "units", "bands", "shingles"])

    body = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_hash(f"`{text}`").alias("cls2"))
    # the light side is hashed; texts stream past it without a sort
    found = body.join(placed.hint("shuffle_hash"), (F.col("cls") == F.col("cls2")) & F.col("text_id").eqNullSafe(F.col("key"))).select("cls", "copies", "units", "bands", "text")
    if _repeats(light):  # rows that repeat key and text would send their set twice
        found = found.dropDuplicates(["cls"])
    sent = found.mapInArrow(sets, "cls binary, copies bigint, units array<struct<band:bigint,idx:int,pack:bigint,blocks:int>>, bands binary, shingles binary")
    each = sent.select("cls", "copies", "bands", "shingles", F.explode("units").alias("u")).select("cls", "copies", "bands", "shingles", "u.*", F.pmod(F.xxhash64("cls"), F.col("u.blocks")).cast("int").alias("own"))
    # block i meets itself and each block j > i: side 0 is the lower block, side 1 the upper; packs are lo = hi = -1
    meets = F.expr("if(blocks = 1, array(struct(-1 as lo, -1 as hi, 0 as side)), transform(sequence(0, blocks - 1), j -> struct(least(own, j) as lo, greatest(own, j) as hi, int(own > j) as side)))")
    dealt = each.select("cls", "copies", "bands", "shingles", "band", "idx", "pack", F.explode(meets).alias("m")).select("cls", "copies", "bands", "shingles", "band", "idx", "pack", "m.*")
    linked = cut(dealt.groupBy("pack", "lo", "hi").applyInArrow(_verify(threshold, bands), "cls binary, root binary, links bigint, rows bigint"))
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    groups = components(linked.select("cls", F.col("root").alias("other")), "cls", "other").withColumnRenamed("node", "cls")
    own = F.struct(F.col("text_id").isNull().alias("none"), "text_id", F.col("cls").alias("rep_cls"))
    head = groups.join(classes.select("cls", "text_id"), "cls").groupBy("root").agg(F.min(own).alias("rep"))
    facts = groups.join(head, "root").join(counts, "cls").select("cls", "rep", "links", "rows")
    info = classes.select("cls", "text_id", "copies", F.col("bands").isNull().alias("bare")).join(facts, "cls", "left")
    return light.select("key", "cls"), cut(info.withColumn("rep", F.coalesce("rep", own)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, text_id (least key with the same text), class_id (least key of its near-duplicate group),
    n_links (different texts linked to its text), n_linked_docs (documents linked to it, copies of its own text included)."""
    light, info = _groups(docs, key, text, k, threshold, recall, most, block_bytes)
    info = info.select("cls", "text_id", F.col("rep.text_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).alias("n_linked_docs"), "copies")
    return join_hot(light, info, "cls", "copies").select(F.col("key").alias(key), "text_id", "class_id", "n_links", "n_linked_docs")


def _repeats(light: DataFrame) -> bool:
    return not light.groupBy("key", "cls").count().filter("count > 1").isEmpty()


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents with all their columns, of each near-duplicate group only the one with the least key (null keys last; of rows that share the
    least key, one text by its hash, and one row of that). A key that repeats with unrelated texts keeps them all. Documents without words link to nothing and all stay."""
    options = dict(k=SHINGLE, threshold=THRESHOLD, recall=RECALL, most=MOST_HASHES, block_bytes=BLOCK_BYTES) | settings
    light, info = _groups(docs, key, text, **options)
    ruled = join_hot(light, info.filter(~F.col("bare")).select("cls", "copies", "rep"), "cls", "copies")
    stays = F.col("key").eqNullSafe(F.col("rep.text_id")) & (F.col("cls") == F.col("rep.rep_cls"))
    gone = ruled.filter(~stays).select(F.col("key").alias("g_key"), F.col("cls").alias("g_cls")).distinct()
    mark, = fresh(docs, "mark")
    marked = docs.withColumn(mark, text_hash(f"`{text}`"))

    def same(a: str, b: str):
        return F.col(f"`{key}`").eqNullSafe(F.col(a)) & (F.col(mark) == F.col(b))

    # decisions are light rows that each task hashes; texts stream past them without a sort
    kept = marked.join(gone.hint("shuffle_hash"), same("g_key", "g_cls"), "left_anti")
    twice = cut(ruled.filter(stays).groupBy("key", "cls").count().filter("count > 1").select(F.col("key").alias("t_key"), F.col("cls").alias("t_cls")))
    if twice.isEmpty():
        return kept.drop(mark)
    repeated = kept.join(twice, same("t_key", "t_cls"), "left_semi").dropDuplicates([key, mark])
    return kept.join(twice, same("t_key", "t_cls"), "left_anti").unionByName(repeated).drop(mark)
