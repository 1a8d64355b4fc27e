"""Language identification by cross-parsing entropy (operator 10).

Each language is a suffix automaton over a bounded sample of its labelled text. A text is parsed greedily into the longest phrases
that occur in that sample; phrases * log2(sample length) / symbols is an estimate of the cross entropy, and the language with the least wins. The sample's bounds are parameters: at most
``per_language`` documents a language, chosen by a hash of doc_id, and of each a piece of at most ``piece`` characters from a place in the whole text that another hash chooses. Every text is
parsed whole, and every language with a labelled document is learned.

Symbols are the UTF-8 bytes of lower-case letters, so letters of any script count; all other characters, runs of them, count as one space. Texts are cut in segments of ``SEGMENT``
symbols that are parsed side by side, one step for all segments at once; a cut costs at most one phrase in SEGMENT symbols, the same for
each language. A byte that no sample has is a phrase of its own. A language takes some 5 MB in each worker and ``per_language * piece`` characters on the driver.

Nulls: null text or one without a letter is ``und`` with score 0. Documents with null lang or null doc_id are classified, never learned from. Nothing learned: all are ``und``.
Ties go to the first language by code point. Repeated rows get equal answers. Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._spark import by_text
from tarn.llm._words import chunks

PER_LANGUAGE = 120
PIECE = 400
SEGMENT = 512
MOST_LITERALS = 1_000


class Automaton:
    """The parse table of the suffix automaton of ``text``. A step gives next state * 4 + phrases ended.

    States with one edge, most of them, keep it in ``only`` and ``to``; the others have a row of ``rows``, and row 0 is what any state does without an edge."""

    def __init__(self, text: list[int], symbols: int):
        go = edges(text)
        start = np.full(symbols, -1, np.int64)
        for c, t in go[0].items():
            start[c] = t * 4
        # no edge: the phrase ends and the symbol starts the next one; a symbol the sample lacks is a phrase itself
        rows = [np.where(start >= 0, start + 1, 2), np.where(start >= 0, start, 1)]
        self.symbols = symbols
        self.only, self.to, self.row = np.full(len(go), 255, np.uint8), np.zeros(len(go), np.int32), np.zeros(len(go), np.int32)
        for s, own in enumerate(go):
            if s == 0:
                self.row[0] = 1
            elif len(own) == 1:
                ((c, t),) = own.items()
                self.only[s], self.to[s] = c, t * 4
            elif own:
                self.row[s] = len(rows)
                row = rows[0].copy()
                for c, t in own.items():
                    row[c] = t * 4
                rows.append(row)
        self.rows = np.stack(rows).astype(np.int32).ravel()

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.where(self.only[state] == c, self.to[state], self.rows[self.row[state] * self.symbols + c])


def edges(text: list[int]) -> list[dict[int, int]]:
    """The edges of each state of the suffix automaton of ``text``."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = cur
    return go


class Parser:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.letter = np.zeros(0x110000, bool)
        self.letter[np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)] = True
        found = [self._bytes([samples[lang]])[0] for lang in self.langs]
        self.code = np.zeros(256, np.uint8)
        self.code[0x20] = 1
        used = [b for b in np.unique(np.concatenate([np.zeros(0, np.uint8), *found])).tolist() if b != 0x20]
        self.code[used] = np.arange(2, len(used) + 2)
        self.tables = [Automaton(self.code[x].tolist(), len(used) + 2) for x in found]
        self.bits = [math.log2(max(2, len(x))) for x in found]

    def _bytes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the letters of all texts, with one space for what is between, and how many each text has."""
        texts = [t.lower() for t in texts]
        at = np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = ~self.letter[codes]
        again = np.zeros(len(codes), bool)
        again[1:] = space[1:] & space[:-1]
        first = at[:-1][at[:-1] < len(codes)]
        again[first] = space[first]
        codes = np.where(space, np.uint32(0x20), codes)
        size = np.where(again, 0, 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
        total = np.concatenate([[0], np.cumsum(size)])
        data = codes[~again].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return np.frombuffer(data, np.uint8), np.diff(total[at])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts (1 is the space, 0 a byte that no sample has), and how many each has."""
        data, sizes = self._bytes(texts)
        return self.code[data], sizes

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[language, text] phrase counts."""
        texts = len(sizes)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(texts), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        long = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-long, kind="stable")
        owner, begin, long = owner[order], begin[order], long[order]
        out = np.zeros((len(self.langs), texts), np.int64)
        if not len(owner):
            return out
        active = np.searchsorted(-long, -np.arange(1, SEGMENT + 1), "right")
        steps = []
        for i in range(int(long[0])):
            steps.append(codes[begin[: active[i]] + i])
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int32)
            for c in steps:
                n = len(c)
                v = table.step(state[:n], c)
                count[:n] += v & 3
                state[:n] = v >> 2
            out[k] = np.bincount(owner, count + (state > 0), texts)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        codes, sizes = self.encode(texts)
        letters = np.concatenate([[0], np.cumsum(codes != 1)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        none = (letters[at[1:]] == letters[at[:-1]]) | (not self.langs)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases(codes, sizes) * np.array(self.bits)[:, None]
        best = cost.argmin(0)
        least = cost.min(0)
        rest = cost.copy()
        rest[best, np.arange(len(texts))] = np.inf
        second = rest.min(0) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(second + least, 1e-9))
        return ["und" if n else self.langs[b] for n, b in zip(none, best, strict=True)], [0.0 if n else float(s) for n, s in zip(none, score, strict=True)]


_parsers: dict[int, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, piece: int = PIECE, fold: int | None = 1) -> dict[str, str]:
    """A sample of text per language, from documents outside the fold (crc32 of doc_id as text, mod 3)."""
    known = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("body")).filter("id is not null and lang is not null")
    if fold is not None:
        known = known.filter(F.crc32(F.col("id").cast("binary")) % 3 != fold)
    dice = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30))
    rates = {r["lang"]: 2 * per_language / r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not rates:
        return {}
    # about twice the documents wanted, so that few rows of any language meet in the ranking
    share = [(k, int(min(1.0, v) * (1 << 30))) for k, v in sorted(rates.items())]
    if len(share) <= MOST_LITERALS:
        # a literal: texts needn't move to meet a few numbers
        rate = F.element_at(F.create_map(*(F.lit(x) for pair in share for x in pair)), F.col("lang"))
        some = known.filter(dice < rate)
    else:
        some = known.join(docs.sparkSession.createDataFrame(share, "lang string, rate long"), "lang").filter(dice < F.col("rate"))
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("body") - piece + 1, F.lit(1))) + 1
    some = some.filter("body is not null").select("lang", dice.alias("dice"), "id", F.substring(F.col("body"), place.cast("int"), F.lit(piece)).alias("body"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "id", "body"))
    out: dict[str, list[str]] = {}
    for r in sorted(some.withColumn("nth", nth).filter(F.col("nth") <= per_language).collect(), key=lambda r: (r["lang"], r["nth"])):
        out.setdefault(r["lang"], []).append(r["body"].lower())
    samples = {k: " ".join(v) for k, v in out.items()}
    return {k: v for k, v in samples.items() if any(c.isalpha() for c in v)}


def identify(docs: DataFrame, samples: dict[str, str], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of each document."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        parser = _parser(samples)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("body")):
                raw = data.tobytes()
                langs, scores = parser.predict([raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in range(j - i)])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return by_text(docs, keep, text, run, "lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, fit(docs), ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")
