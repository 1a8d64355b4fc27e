"""Operator 13: alignment of two tokenisers' tokens.

Tokeniser A encodes a space and the text, tokeniser B the text (and adds the space itself), so both cut the same bytes. B's tokens are a static index of intervals: their starts and ends are sorted, so a bisection gives the run
of B tokens that an A token overlaps. A gap between two A tokens that no B token spans is the border of a group. All A-B pairs within a group are linked; how many documents hold a pair of ids linked is counted over the whole corpus, and each document is scored by those counts.

Where the work goes: texts are encoded and aligned where they lie, and what the count needs (the distinct pairs of a text and how often each occurs) is written to the shared folder once. Counts are pre-aggregated before
their shuffle. To score, no more than ``HOT_PAIRS`` pairs, those of the highest counts, are sent to every task as sorted arrays (20 bytes a pair); a text's pairs that aren't among them are shuffled to the rest of the counts. Both ways give
the same sums, and the second is left out when there is no such pair.

Edge cases: texts that are null or empty, or that either tokeniser can't give back byte for byte (B normalises some), have no tokens: zeros, and '' for the groups. Rows that repeat count as documents of their own. Texts are encoded whole. Columns that are
kept may have any names but those of the results.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import by_text, cut, shared_dir
from tarn.llm.byte_pairs import Memo, Tokens, blocks

#: pairs whose counts every task gets, at most
HOT_PAIRS = 1 << 20
#: links of a group that are listed one by one
SHORT = 4096
#: how a byte-level tokeniser cuts texts into words (a fixed value: its library's own pattern)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ids are below this, so a document of a block and a pair fit in 64 bits
_IDS = 1 << 20
#: texts whose tokens are held at once (a longer text stands alone)
BLOCK_BYTES = 1 << 18


def _letters_of_bytes() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Both:
    """The two tokenisers, and the bytes of each of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # byte-level words never depend on each other, so each distinct one is encoded once; other kinds of tokeniser see whole texts
        byte_level = json.loads(a_json).get("pre_tokenizer") or {}
        self.memo = Memo(regex.compile(WORDS).findall, self._words) if byte_level.get("type") == "ByteLevel" and byte_level.get("use_regex") and not byte_level.get("add_prefix_space") else None
        byte = _letters_of_bytes()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_tokens, self.b_tokens = Tokens(self.a_bytes), Tokens(self.b_bytes)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, at = _flat([e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)])
        return ids, np.diff(at)

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(tokens of all texts, where each text's begin, and end) of both; none where a text is empty or isn't given back."""
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        if self.memo is None:
            ours = _flat([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        else:
            ids, count = self.memo.encode(spaced)
            ours = ids, np.concatenate([[0], np.cumsum(count)])
        theirs = _flat(self.b.encode(texts, num_threads=1))
        want, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        same = np.diff(ends) > 1
        for (ids, at), tokens in ((ours, self.a_tokens), (theirs, self.b_tokens)):
            got, before = tokens.joined(ids)
            if len(got) == len(want) and (before[at] == ends).all():
                off = np.flatnonzero(got != want)
                same[np.searchsorted(ends, off, "right") - 1] = False
            else:
                same &= np.array([got[i:j].tobytes() == r for r, i, j in zip(raw, before[at[:-1]], before[at[1:]], strict=True)])
        return (ours, theirs) if same.all() else (_only(ours, same), _only(theirs, same))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, ids)])
    return np.fromiter(chain.from_iterable(ids), np.int32, at[-1]), at


def _only(tokens: tuple[np.ndarray, np.ndarray], same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = tokens
    per = np.diff(at)
    return ids[np.repeat(same, per)], np.concatenate([[0], np.cumsum(per * same)])


@functools.lru_cache(2)
def both(a_json: bytes, b_model: bytes) -> Both:
    """One pair of tokenisers a worker, kept between tasks."""
    return Both(a_json, b_model)


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) up to the end of each group, from the sizes in bytes of the tokens of one stream."""
    if not len(a_size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")  # of the B tokens that an A token overlaps
    beyond = np.searchsorted(b_end - b_size, a_end, "left")
    border = np.append(beyond[:-1] <= first[1:], True)
    return np.flatnonzero(border) + 1, beyond[border]


class Aligned:
    """The tokens and groups of a block of texts: ids ``a`` and ``b``, and how many tokens of each lie up to each group's end; ``a_at``, ``b_at`` and ``g_at`` say where each text's begin, and end."""

    def __init__(self, known: Both, texts: list[str]):
        (self.a, self.a_at), (self.b, self.b_at) = known.encode(texts)
        self.a_ends, self.b_ends = groups(known.a_tokens.size[self.a], known.b_tokens.size[self.b])  # texts end where groups do
        self.g_at = np.searchsorted(self.a_ends, self.a_at, "right")

    def lists(self) -> list[pa.ListArray]:
        """Both ids and both ends, the latter counted from the text's beginning, a list for each text."""
        per = np.diff(self.g_at)
        parts = (self.a, self.a_at), (self.b, self.b_at), (self.a_ends - np.repeat(self.a_at[:-1], per), self.g_at), (self.b_ends - np.repeat(self.b_at[:-1], per), self.g_at)
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32))) for values, at in parts]


def _by_block(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """``make`` of the texts (last column) of each block of a batch, beside the block's other columns."""
    for batch in batches:
        i = 0
        for block in blocks(batch.column(batch.num_columns - 1), BLOCK_BYTES):
            made = make(block)
            part = batch.slice(i, len(block))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.values()], [*batch.schema.names[:-1], *made])
            i += len(block)


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, then the token ids ``a`` and ``b`` and, for each group, how many tokens of each lie up to its end: ``a_ends``, ``b_ends``. The driver reads both vocabularies (about 2 MB) and sends them with the plan."""
    a_json, b_model = Path(a_path).read_bytes(), Path(b_path).read_bytes()

    def run(batches):
        known = both(a_json, b_model)
        return _by_block(batches, lambda texts: dict(zip(("a", "b", "a_ends", "b_ends"), Aligned(known, texts).lists(), strict=True)))

    return by_text(docs, keep, text, run, "a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _links(a: np.ndarray, b: np.ndarray, doc: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document and pair as one number, how often it occurs), sorted and distinct, of groups with ``na`` and ``nb`` tokens. Where a group has more than SHORT links, the ids of a side are made distinct within each group first, so it costs its distinct pairs only."""

    def distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * _IDS + ids, return_counts=True)
        return key % _IDS, times, np.bincount(key // _IDS, minlength=len(sizes))

    plain = len(na) == 0 or int((na * nb).max()) <= SHORT
    if not plain:
        (a, ta, na), (b, tb, nb) = distinct(a, na), distinct(b, nb)
    width = np.repeat(nb, na)  # B ids that each A id meets
    left = np.repeat(np.arange(len(a)), width)
    step = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
    right = np.repeat(np.repeat(np.cumsum(nb) - nb, na), width) + step
    key = (np.repeat(np.repeat(doc, na), width) * _IDS + a[left]) * _IDS + b[right]
    if plain:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], (ta[left] * tb[right])[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.diff(np.append(begin, len(key))) if plain else np.add.reduceat(times, begin)


def _names(ids: np.ndarray, last: np.ndarray, end: str) -> np.ndarray:
    """Decimal ids, each with a comma after it, or ``end`` after the last of its group."""
    names = _decimal(",")[ids]
    names[last] = _decimal(end)[ids[last]]
    return names


@functools.lru_cache(3)
def _decimal(end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(1 << 16)], object)


def linked(block: Aligned) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a block: the number of links and the groups as text (``a1,a2|b1;a3|b2,b3``); then the distinct linked pairs (A id * 2**20 + B id), how often each occurs, and where each text's begin, and end."""
    a, b, ga, gb = (x.astype(np.int64) for x in (block.a, block.b, block.a_ends, block.b_ends))
    texts = len(block.a_at) - 1
    doc = np.repeat(np.arange(texts), np.diff(block.g_at))
    na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    key, times = _links(a, b, doc, na, nb)
    upto = np.searchsorted(key, np.arange(texts + 1) * _IDS * _IDS)
    count = np.zeros(texts, np.int64)
    np.add.at(count, doc, na * nb)
    # tokens in the order of the text: those of A, then those of B, group by group
    words = np.empty(len(a) + len(b), object)
    words[np.arange(len(a)) + np.repeat(gb - nb, na)] = _names(a, ga - 1, "|")
    words[np.arange(len(b)) + np.repeat(ga, nb)] = _names(b, gb - 1, ";")
    words, bounds = words.tolist(), (block.a_at + block.b_at).tolist()
    return count, ["".join(words[p:q])[:-1] for p, q in itertools.pairwise(bounds)], key % (_IDS * _IDS), times, upto


def links(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, then n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens) and the distinct linked ``pairs`` with the ``times`` each occurs; a block at a time, from texts to counts."""
    a_json, b_model = Path(a_path).read_bytes(), Path(b_path).read_bytes()

    def row(block: Aligned) -> dict[str, pa.Array]:
        count, names, pairs, times, upto = linked(block)
        sha = [hashlib.sha256(n.encode()).hexdigest() if n else "" for n in names]
        lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x)) for x in (pairs, times)]
        sizes = {n: pa.array(np.diff(at)) for n, at in (("n_a", block.a_at), ("n_b", block.b_at), ("n_groups", block.g_at))}
        return sizes | {"n_links": pa.array(count), "groups_sha256": pa.array(sha, pa.string()), "pairs": lists[0], "times": lists[1]}

    def run(batches):
        known = both(a_json, b_model)
        return _by_block(batches, lambda texts: row(Aligned(known, texts)))

    return by_text(docs, keep, text, run, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(linked: DataFrame, pairs: str = "pairs") -> DataFrame:
    """(pair, n, best): how many rows hold each pair linked, and whether no pair of the same A id is held by more. A pair is in a row's list once."""
    held = linked.select(F.explode(f"`{pairs}`").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    held = cut(held.withColumn("a", F.shiftright("pair", _IDS.bit_length() - 1)))
    most = held.groupBy("a").agg(F.max("n").alias("most"))
    return held.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_from(counts: DataFrame, limit: int) -> tuple[int, bool]:
    """(the count from which pairs are hot, whether others remain): a power of two such that at most ``limit`` pairs reach it."""
    sizes = {r.k: r.c for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}  # at most 63 rows
    held, least = 0, 64
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > limit:
            break
        held, least = held + sizes[k], k
    return 1 << min(least, 62), held < sum(sizes.values())


def score(linked: DataFrame, counts: DataFrame, row: str = "row", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(``row``, n_best, count_sum) of rows with ``pairs`` and ``times``; ``row`` names each row once. ``n_best``: links whose pair is ``best``; ``count_sum``: the sum, over links, of their pair's count."""
    least, more = _hot_from(counts, hot_pairs)
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    sent = linked.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, n, best = sent.value
        for pairs, times in batches:
            (key, at), (count, _) = _lists(pairs), _lists(times)
            row = np.repeat(np.arange(len(pairs)), np.diff(at))
            place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            found = known[place] == key if len(known) else np.zeros(len(key), bool)
            sums = np.zeros((2, len(pairs)), np.int64)
            where = place[found]
            np.add.at(sums[0], row[found], count[found] * best[where])
            np.add.at(sums[1], row[found], count[found] * n[where])
            cold = [pa.array(np.cumsum([0, *np.bincount(row[~found], minlength=len(pairs))]), pa.int32())]
            yield pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), *(pa.ListArray.from_arrays(cold[0], pa.array(x[~found])) for x in (key, count))], ["n_best", "count_sum", "pairs", "times"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    seen = linked.select(row, F.arrow_udf(run, "struct<n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>>")("pairs", "times").alias("s"))
    known = seen.select(row, "s.n_best", "s.count_sum")
    if not more:
        return known
    rare = seen.select(row, F.explode(F.arrays_zip("s.pairs", "s.times")).alias("p")).select(row, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rare.join(counts.filter(F.col("n") < least), "pair").select(row, F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return known.unionByName(rest).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def scored(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``keep``, then n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens), n_best and count_sum of each row."""
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("text"))
    made = links(plain, a_path, b_path, names).withColumn("row", F.monotonically_increasing_id())
    where = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    made.write.parquet(where)
    kept = spark.read.parquet(where)
    sums = score(kept.select("row", "pairs", "times"), cut(pair_counts(kept)), hot_pairs=hot_pairs)
    out = kept.drop("pairs", "times").join(sums, "row").drop("row")
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    import public_tokenizers

    return scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
