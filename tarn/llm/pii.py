"""Personal data by bootstrapped contextual extraction (operator 6).

*Base* entities come from fixed patterns (email, ip, card, phone), whole texts, leftmost and non-overlapping per kind. They are the seeds. A *candidate* is any
identifier-like string (digits with separators, a card number within a longer run of digits, or a string with @; of any length) with its context; its lexical patterns are the two words before
it, the one word before it with the marks between, and the pair of words around it. Patterns and instances form a graph that Spark scores in turn:

    confidence(pattern, kind) = sum of its instances' scores for the kind / number of its distinct instances,
                                those without a score for the kind whose shape it allows counted DOUBT each
    score(instance, kind)     = 1 for seeds, else 1 - product over its good patterns of (1 - confidence), if the kind allows its shape

A pattern is good from CONFIDENCE and SUPPORT distinct scored instances on. After ROUNDS rounds, candidates that the base patterns missed, whose score for a kind reaches
CONFIDENCE and whose shape the kind allows, become spans; a seed's string counts as known wherever it occurs. Base spans always stay.

Texts are read once; what goes on is one light row per document, written to the shared folder. Pattern counts are summed before the shuffle; nothing is collected.

Nulls: null text has no spans. Null or repeated doc_ids get their own rows. Empty tables give no rows. Longer digit runs than any
kind allows fail as base and are not retried there; the cards in them are candidates. Positions are code points, end exclusive. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import cut, text_hash
from tarn.llm._words import chunks

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
SUPPORT = 3
ROUNDS = 3
DOUBT = 0.5
BROADCAST_BYTES = 4 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits does: from within the run the dots would be missed as well
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NEAR = frozenset(" \t\n\r\f\v\"'<>,;|@")
_RUN = re.compile(r"[+(]?[0-9](?:[\x20()./_-]{0,2}+[0-9])++")
_GROUP = re.compile(r"[0-9]++")
_MARKS = re.compile(r"[\s0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that long runs stay linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text)}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() < 38 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def shape_allows(kind: str, s: str) -> bool:
    n, dots = len(_digits(s)), s.count(".")
    if "@" in s:
        return kind == "email"
    return {"email": False, "ip": dots == 3 and n <= 12, "card": 12 <= n <= 19 and "+" not in s, "phone": 7 <= n <= 15 and (dots != 3 or n > 12)}[kind]


def _context(text: str, start: int, end: int) -> list[str]:
    ahead = text[max(0, start - 60) : start].lower()
    before, after = list(_WORD.finditer(ahead))[-2:], _WORD.findall(text[end : end + 40].lower())[:1]
    out = []
    if len(before) == 2:
        out.append(f"< {before[0][0]} {before[1][0]}")
    if before:
        out.append(f": {before[-1][0]}{_MARKS.sub('', ahead[before[-1].end() :])[:3]}")
    if before and after:
        out.append(f"- {before[-1][0]} {after[0]}")
    return out


def _identifiers(text: str) -> list[tuple[int, int]]:
    """Identifier-like strings, in order: what surrounds an @, and runs of six or more digits; of runs longer than a card the cards in them."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > done and text[a - 1] not in _NEAR:
            a -= 1
        while b < len(text) and text[b] not in _NEAR:
            b += 1
        if a < at and b > at + 1:
            out.append((a, b))
        done = b
        at = text.find("@", b)
    for m in _RUN.finditer(text):
        if text[max(0, m.start() - 1) : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum():
            continue  # a part of something longer
        n = sum("0" <= c <= "9" for c in m[0])
        if 6 <= n <= 19:
            out.append(m.span())
        elif n > 19:
            groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
            i = 0
            while i < len(groups):
                digits, best = "", 0
                for j in range(i, len(groups)):
                    digits += text[groups[j][0] : groups[j][1]]
                    if len(digits) > 19:
                        break
                    if len(digits) >= 13 and luhn(digits):
                        best = j + 1
                if best:
                    out.append((groups[i][0], groups[best - 1][1]))
                i = best or i + 1
    return sorted(out)


def candidates(text: str, found: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seeds and other identifier-like strings with their patterns and the kinds their shape allows."""
    out = [{"start": a, "end": b, "instance": text[a:b], "seed": k, "kinds": [], "patterns": _context(text, a, b)} for k in KINDS for a, b in found[k]]
    taken, last = sorted((a, b) for k in KINDS for a, b in found[k]), 0
    at = 0
    for a, b in _identifiers(text):
        while at < len(taken) and taken[at][0] < b:
            last = max(last, taken[at][1])
            at += 1
        if last > a:  # a seed overlaps it
            continue
        instance = text[a:b]
        kinds = [k for k in KINDS if shape_allows(k, instance)]
        if kinds and (patterns := _context(text, a, b)):
            out.append({"start": a, "end": b, "instance": instance, "seed": None, "kinds": kinds, "patterns": patterns})
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "struct<start:int,end:int,instance:string,seed:string,kinds:array<string>,patterns:array<string>>"
_SPAN_PA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.string()), ("kinds", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))


def scan(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep``, base (spans) and found (seeds and candidates) of each document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    mark = np.zeros(256, bool)
    mark[[*range(0x30, 0x3A), 0x40]] = True

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("_text")):
                total = np.concatenate([[0], np.cumsum(mark[data])])
                some = total[offsets[1:]] > total[offsets[:-1]]
                spans, found, raw = [[]] * (j - i), [[]] * (j - i), memoryview(data)
                for d in np.flatnonzero(some).tolist():
                    body = str(raw[offsets[d] : offsets[d + 1]], "utf-8", "replace")
                    own = base(body)
                    spans[d] = [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in own[k]]
                    found[d] = candidates(body, own)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in range(len(keep))), pa.array(spans, _SPAN_PA), pa.array(found, _FOUND_PA)], [*keep, "base", "found"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"base {_SPANS}, found array<{_FOUND}>")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, doubt: float = DOUBT) -> DataFrame:
    """(instance, kind, score) of what is known in the end, seeds and unseen instances, from edges (pattern, instance, seed, kinds its shape allows)."""
    edges = cut(edges.distinct())
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    seeds = edges.filter("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    unseen = edges.filter("seed is null").join(seeds.select("instance").distinct(), "instance", "left_anti").select("pattern", "instance", "kinds")
    could = unseen.select("pattern", "instance", F.explode("kinds").alias("kind")).distinct().groupBy("pattern", "kind").agg(F.count("*").alias("could"))
    about = cut(size.join(could, "pattern", "left").groupBy("pattern", "n").agg(F.map_from_entries(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "could")))).alias("could")))
    scores = seeds.withColumn("new", F.lit(0))
    for _ in range(rounds):
        open_ = F.coalesce(F.try_element_at("could", F.col("kind")), F.lit(0)) - F.col("new")
        good = (
            edges.select("pattern", "instance").distinct().join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"), F.sum("new").alias("new"))
            .filter(F.col("support") >= support).join(about, "pattern").withColumn("conf", F.least(F.lit(1.0), F.col("mass") / (F.col("n") - (1 - doubt) * open_))).filter(F.col("conf") >= confidence).select("pattern", "kind", "conf")
        )
        hits = unseen.join(good, "pattern").filter(F.array_contains("kinds", F.col("kind")))
        new = cut(hits.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score")))
        scores = seeds.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return scores.filter(F.col("score") >= confidence).drop("new")


def _learned(light: DataFrame, row: str, confidence: float, support: int, rounds: int) -> DataFrame:
    """(row, learned spans) of the rows that have any, from rows with ``found``."""
    each = light.filter(F.size("found") > 0).select(row, F.explode("found").alias("f")).select(row, "f.*")
    edges = each.select(F.explode_outer("patterns").alias("pattern"), "instance", "seed", "kinds")
    learned = score_patterns(edges, rounds, confidence, support)
    hits = each.filter("seed is null").join(learned, "instance").filter(F.array_contains("kinds", F.col("kind")))
    hits = hits.groupBy(row, "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    return hits.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("learned"))


def extract(docs: DataFrame, keep: list[str], text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep`` (light ones: they are written and shuffled), base and learned (arrays of kind, start, end) of each document."""
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    light = scan(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{text}`").alias("_t")), list(names.values()), "_t")
    light = cut(light.withColumn("uid", F.monotonically_increasing_id()))
    out = light.select("uid", *names.values(), "base").join(_learned(light, "uid", confidence, support, rounds), "uid", "left")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "base", F.coalesce("learned", F.array().cast(_SPANS)).alias("learned"))


def _joined(spans):
    """kind:start:end by kind as listed, then start, comma-joined."""
    place = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(place), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = extract(docs, ["doc_id"])
    number = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *number, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "learned")).alias("spans"))


def _masked(body: str, learned: list[dict]) -> str:
    """Each span replaced by <kind>; of spans that overlap the first, the longest of equal starts, gives its name to all they cover."""
    spans = [(a, -b, k) for k, own in base(body).items() for a, b in own] + [(x["start"], -x["end"], x["kind"]) for x in learned]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [body[at:a], f"<{kind}>"]
        at = max(at, -b)
    return "".join([*out, body[at:]])


def mask(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """All documents with all their columns; each span of personal data is replaced by <kind>, and ``n_chars``, if there is one, follows.

    Spans depend on a text and on what was learned, so what was learned is kept by a hash of the text, for the texts that have any. If that is
    at most BROADCAST_BYTES, measured, texts are not shuffled at all; beyond it they stream once past its hashed partitions."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).withColumn("mark", text_hash(names[text]))
    light = scan(inner.select("mark", F.col(names[text]).alias("_t")), ["mark"], "_t").filter(F.size("found") > 0).select("mark", "found").dropDuplicates(["mark"])
    hits = cut(_learned(cut(light), "mark", confidence, support, rounds))
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("learned")).alias("spans")).first()
    hits = F.broadcast(hits) if 64 * (size.n + (size.spans or 0)) <= BROADCAST_BYTES else hits.hint("shuffle_hash")
    body, number = names[text], names.get(n_chars)
    schema = inner.drop("mark").schema

    def run(batches):
        some = re.compile("[0-9@]")
        for batch in batches:
            texts, learned, changed = batch.column(body).to_pylist(), batch.column("learned"), []
            known = learned.is_valid().to_pylist()
            for i, t in enumerate(texts):
                if t is not None and some.search(t):
                    new = _masked(t, learned[i].as_py() if known[i] else [])
                    if new != t:
                        changed.append(i)
                        texts[i] = new
            columns = {c: batch.column(c) for c in schema.names}
            if changed:
                columns[body] = pa.array(texts, columns[body].type)
                if number:
                    counts = columns[number].to_pylist()
                    for i in changed:
                        counts[i] = len(texts[i])
                    columns[number] = pa.array(counts, columns[number].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return inner.join(hits, "mark", "left").select(*schema.names, "learned").mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in names.items()))
