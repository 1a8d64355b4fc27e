"""Operator 12: fill-in-the-middle examples, cut by succinct rank and select.

A block of texts is one stream of UTF-8 bytes. One bit a byte says whether a token (a run of ASCII letters, or any other single character) begins there; the bits are packed, and a directory holds
how many are set before each block of 512. ``rank`` of a text's end less that of its start is its number of tokens n, and ``select`` of two token numbers gives the bytes at which it is cut. Rows stay where they are; nothing is shuffled.

Edge cases: null counts as empty, and an empty text is ``plain``; a text that holds a marker is ``plain`` too, so markers in an output are never ambiguous; a null doc_id counts as the empty string in the hash; rows that
repeat get the same answer; a prefix, middle or suffix may be empty. Other columns are kept, and those named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._words import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: of 100 texts so many are cut, and of 100 cut ones so many put the suffix first
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MADE = "struct<n bigint, form string, prefix_chars bigint, middle_chars bigint, output string>"
_WORD = 64  # bits of a word
_BLOCK = 8  # words of a block


class Bits:
    """A packed bit vector with a popcount directory."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        size = _WORD * _BLOCK // 8
        # at least one empty block at the end, so that every position has a block
        padded = np.zeros((len(packed) // size + 1) * size, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8").reshape(-1, _BLOCK)
        self.ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.ones.sum(1))])
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        block, word, bit = at // (_WORD * _BLOCK), at // _WORD % _BLOCK, (at % _WORD).astype(np.uint64)
        whole = np.where(np.arange(_BLOCK) < word[:, None], self.ones[block], 0).sum(1)
        low = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th set bit, counted from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        upto = np.cumsum(self.ones[block], 1)
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, upto[np.arange(len(k)), np.maximum(word - 1, 0)], 0)
        set_ = (self.words[block, word][:, None] >> np.arange(_WORD, dtype=np.uint64)) & np.uint64(1)
        bit = (np.cumsum(set_, 1, dtype=np.int64) > left[:, None]).argmax(1)
        return (block * _BLOCK + word) * _WORD + bit


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at each byte where a token begins: the first letter of a run, and the first byte of any other character. Runs end where texts do."""
    letter = _LETTER[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = letter
    before[offsets] = False
    return np.where(letter, ~before[:-1], (data & 0xC0) != 0x80)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, byte where the middle begins, byte where it ends) of each text of a stream."""
    bits = Bits(boundaries(data, offsets))
    ranks = bits.rank(offsets)
    n = np.diff(ranks)
    out = []
    units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), 0)
    for u in units:
        where = offsets[1:].copy()
        inner = u < n
        where[inner] = bits.select(ranks[:-1][inner] + u[inner])
        out.append(where)
    return n, *out


def _dice(doc_id: str) -> Column:
    h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def _arrange(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for text, dice in batches:
        h = dice.flatten().to_numpy().reshape(-1, 4)
        cols: tuple[list, ...] = ([], [], [], [], [])
        for i, j, data, offsets in chunks(text):
            n, left, right = cuts(data, offsets, h[i:j, 0], h[i:j, 1])
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            heads, middles = chars[left] - chars[offsets[:-1]], chars[right] - chars[left]
            raw = data.tobytes()
            for k in range(j - i):
                body, a, b = raw[offsets[k] : offsets[k + 1]], int(left[k] - offsets[k]), int(right[k] - offsets[k])
                plain = not body or h[i + k, 2] % 100 >= CUT_PERCENT or any(m in body for m in marks)
                if plain:
                    row = (int(n[k]), "plain", None, None, body)
                else:
                    p, s, m = marks[0] + body[:a], marks[1] + body[b:], marks[2] + body[a:b]
                    first = h[i + k, 3] % 100 < SUFFIX_FIRST_PERCENT
                    row = (int(n[k]), "spm" if first else "psm", int(heads[k]), int(middles[k]), s + p + m if first else p + s + m)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        made[4] = made[4].cast(pa.string())
        yield pa.StructArray.from_arrays(made, ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``, the text as it goes into training."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    taken = {c.lower() for c in names}
    made = "made"
    while made in {c.lower() for c in docs.columns}:
        made = f"_{made}"
    out = docs.withColumn(made, F.arrow_udf(_arrange, _MADE)(F.col(f"`{text}`"), _dice(doc_id)))
    return out.select(*(f"`{c}`" for c in docs.columns if c.lower() not in taken), *(F.col(made)[c].alias(c) for c in names))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone."""
    out = F.col(output)
    before = lambda m: F.substr(F.substring_index(out, m, 1), F.lit(len(m) + 1))
    between = lambda m, n: F.substring_index(F.substring_index(out, m, -1), n, 1)
    middle = F.substring_index(out, MIDDLE, -1)
    psm = F.concat(before(SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, before(PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: hashes of each output and of what is restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS h4 FROM d),
n AS (SELECT *, len(w)::BIGINT AS n FROM w),
c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT doc_id, n, form, t, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM p
"""
