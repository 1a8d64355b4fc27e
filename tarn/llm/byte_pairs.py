"""Operator 11: byte-level BPE by replaying the merges over all words at once.

Encoding a word never depends on other words, so a corpus is cut into blocks of texts (``BLOCK_BYTES``), and each block's *distinct* words are replayed together (``REPLAY_WORDS`` at a time): their
bytes lie in one flat array, an inverted index leads from each mergeable pair (named by the rank of its merge) to the positions where it stands, and merges are applied in rank order
to exactly those positions. A merge touches its two neighbours only: their new pairs are entered in the index. Nothing is shuffled; memory is bounded by a block, the vocabulary and ``MEMO_WORDS`` words
whose tokens a worker remembers between blocks, those met in most blocks (that saves time and changes no result).

Edge cases: null counts as empty (no tokens, empty decoded text); a text of any length is encoded whole; a word of any length costs n log n; rows that repeat are encoded each; other columns are kept,
and those named like a result are replaced by it. Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import by_text

BLOCK_BYTES = 1 << 20
#: words replayed together: their index and positions then fit in a core's cache, which takes half the time of all of a block's words at once
REPLAY_WORDS = 4_000
MEMO_WORDS = 250_000
MEMO_CHARS = 64


class Memo:
    """Tokens of words that were met before, as arrays: the number of each word, where its tokens lie in ``flat``, how many they are, and in how many blocks it was. ``words`` cuts a text into words, ``tokens`` finds those of new words."""

    def __init__(self, words: Callable[[str], list[str]], tokens: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.words, self.tokens = words, tokens
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self._keep(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, flat: np.ndarray, count: np.ndarray, seen: np.ndarray) -> None:
        self.flat, self.count, self.seen = flat, count, seen
        self.first = np.cumsum(count) - count

    def _learn(self, words: list[str]) -> None:
        tokens, counts = self.tokens(words)
        begin = len(self.count)
        self.memo.update(zip(words, range(begin, begin + len(words)), strict=True))
        self._keep(np.concatenate([self.flat, tokens]), np.concatenate([self.count, counts]), np.concatenate([self.seen, np.zeros(len(words), np.int64)]))

    def _tidy(self, long: list[str]) -> None:
        """Drop long words, and when the memo is full those met in the fewest blocks."""
        if len(self.memo) <= MEMO_WORDS and not long:
            return
        stay = np.ones(len(self.count), bool)
        stay[[self.memo[w] for w in long]] = False
        if len(self.memo) > MEMO_WORDS:
            stay[np.argsort(-self.seen, kind="stable")[MEMO_WORDS // 2 :]] = False
            self.seen //= 2
        number = np.cumsum(stay) - 1
        self.memo = {w: int(number[i]) for w, i in self.memo.items() if stay[i]}
        self._keep(self.flat[np.repeat(stay, self.count)], self.count[stay], self.seen[stay])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, number of each text's)."""
        cut = [self.words(t) for t in texts]
        words = list(chain.from_iterable(cut))
        new = list(set(words).difference(self.memo))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        self.seen[np.unique(at)] += 1
        size = self.count[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        self._tidy([w for w in new if len(w) > MEMO_CHARS])
        return ids, np.diff(upto)


class Tokens:
    """The bytes of each token of a vocabulary, one after the other; b"" where an id is free."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens])
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, how many lie before each token, and in all)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])


class Merges(Memo):
    """A vocabulary as ranks: ``rank[bytes]`` is a token's id and, for tokens of two bytes or more, the turn of the merge that makes it. ``pattern`` cuts texts into words."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        super().__init__(regex.compile(pattern).findall, self.tokens_of)
        rows = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)])
        # the merge of each pair of bytes, -1 if there is none
        self.double = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs: dict[int, int] = {}  # what ``pair`` found, by both ids in one number
        self.known = Tokens([self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)])

    def pair(self, left: int, right: int) -> int:
        """The rank of the merge of two tokens, -1 if there is none."""
        found = self.pairs[left << 24 | right] = self.rank.get(self.bytes[left] + self.bytes[right], -1)
        return found

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, number of each word's): all merges of the vocabulary, in rank order, over all words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # one slot before each word and one after the last keep words apart
        starts = np.cumsum(sizes + 1) - sizes
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        gap = np.zeros(len(data), bool)
        gap[np.append(starts - 1, len(data) - 1)] = True
        token = self.single[data]
        token[gap] = -1
        now = np.full(len(data), -1)  # the merge that the pair starting here would be
        now[:-1] = np.where(gap[:-1] | gap[1:], -1, self.double[data[:-1], data[1:]])
        at = np.flatnonzero(now >= 0)
        at = at[np.argsort(now[at], kind="stable")]
        found, begin = np.unique(now[at], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(at, begin[1:]), strict=True)} if len(at) else {}
        turns = list(index)
        heapq.heapify(turns)
        token, now = token.tolist(), now.tolist()
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        known, pair = self.pairs, self.pair
        while turns:
            r = heapq.heappop(turns)
            late = -1  # positions before this one wait: their word has an earlier merge to do first
            places = index.pop(r)
            if len(places) > 1:
                places.sort()
            for p in places:
                if now[p] != r:
                    continue
                if p < late:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(turns, r)
                    index[r].append(p)
                    continue
                q = after[p]
                n = after[p] = after[q]
                before[n] = p
                token[p], token[q], now[q] = r, -2, -1
                early = False
                right, x = token[n], before[p]
                left = token[x]
                if right < 0:
                    now[p] = -1
                else:
                    m = known.get(r << 24 | right)
                    if m is None:
                        m = pair(r, right)
                    now[p] = m
                    if m >= 0:
                        if m in index:
                            index[m].append(p)
                        else:
                            index[m] = [p]
                            heapq.heappush(turns, m)
                        early = m < r
                if left >= 0:
                    m = known.get(left << 24 | r)
                    if m is None:
                        m = pair(left, r)
                    now[x] = m
                    if m >= 0:
                        if m in index:
                            index[m].append(x)
                        else:
                            index[m] = [x]
                            heapq.heappush(turns, m)
                        early |= m < r
                if early:
                    late = p
                    while token[late] != -1:
                        late = after[late]
        tokens = np.array(token)
        alive = np.concatenate([[0], np.cumsum(tokens >= 0)])
        return tokens[tokens >= 0].astype(np.int32), alive[starts + sizes] - alive[starts]

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of new words, number of each word's). A word that is a token itself is that token; the others are replayed."""
        raw = [w.encode() for w in words]
        ids = np.fromiter((self.rank.get(r, -1) for r in raw), np.int32, len(raw))
        counts = np.ones(len(raw), np.int64)
        rest = np.flatnonzero(ids < 0)
        parts = []
        for i in range(0, len(rest), REPLAY_WORDS):
            some = rest[i : i + REPLAY_WORDS]
            tokens, counts[some] = self.replay([raw[j] for j in some.tolist()])
            parts.append(tokens)
        out = np.repeat(ids, counts)
        out[np.repeat(ids < 0, counts)] = np.concatenate([np.zeros(0, np.int32), *parts])
        return out, counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, how many bytes lie before each and in all)."""
        if (self.known.size[ids] == 0).any():
            raise ValueError("an id is not in the vocabulary")
        return self.known.joined(ids)


@functools.lru_cache(4)
def merges(ranks: bytes, pattern: str) -> Merges:
    """One vocabulary a worker, kept between tasks."""
    return Merges(ranks, pattern)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` bytes together; a longer one alone; null is empty."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + limit, "right")))
        yield [t or "" for t in texts.slice(i, j - i).to_pylist()]
        i = j


def encoder(ranks_path: str, pattern: str):
    """A column function: text to token ids. The driver reads the vocabulary (under 1 MB) and sends it with the plan."""
    ranks = Path(ranks_path).read_bytes()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = merges(ranks, pattern)
        for batch in batches:
            values, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for block in blocks(batch):
                ids, count = known.encode(block)
                values.append(ids)
                sizes.append(count)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(values)))

    return encode


def decoder(ranks_path: str, pattern: str):
    """A column function: token ids to the bytes they stand for. An id that the vocabulary lacks is an error."""
    ranks = Path(ranks_path).read_bytes()

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = merges(ranks, pattern)
        for batch in batches:
            ids = batch.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy())])
            parts, i = [], 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
                data, before = known.decode(ids[at[i] : at[j]])
                parts.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(before[at[i : j + 1] - at[i]].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
                i = j
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decode


def _standard() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``ids``, the tokens of the whole ``text``."""
    own = _standard() if ranks_path is None or pattern is None else ()
    return docs.withColumn(ids, encoder(ranks_path or own[0], pattern or own[1])(F.col(f"`{text}`")))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for."""
    own = _standard() if ranks_path is None or pattern is None else ()
    return df.withColumn(decoded, decoder(ranks_path or own[0], pattern or own[1])(F.col(f"`{ids}`")))


def joined(ids: Column) -> Column:
    """Decimal ids with one space between them."""
    return F.concat_ws(" ", ids.cast("array<string>"))


def round_trip(docs: DataFrame, keep: list[str], text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep``, then ``ids`` and what they ``decoded`` to: encoding and decoding in one pass, a block at a time, so a task runs one worker and holds one block. Kept columns may have any names but those two."""
    own = _standard() if ranks_path is None or pattern is None else ()
    ranks, words = Path(ranks_path or own[0]).read_bytes(), pattern or own[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merges(ranks, words)
        for batch in batches:
            i = 0
            for block in blocks(batch.column(batch.num_columns - 1)):
                ids, count = known.encode(block)
                data, before = known.decode(ids)
                at = np.concatenate([[0], np.cumsum(count)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                back = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(before[at].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, len(block)).columns[:-1], lists, back], [*batch.schema.names[:-1], "ids", "decoded"])
                i += len(block)

    return by_text(docs, keep, text, run, "ids array<int>, decoded binary")


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: number and hash of the tokens, hash of what they decode to."""
    coded = round_trip(docs, ["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
