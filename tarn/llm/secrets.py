"""Secret scans with a recursive decoding worklist (operator 3).

Layer 0 is the text; its spans are the base. The worklist then unwraps what is encoded within each layer: percent- and Unicode-escaped
characters (with the tokens around them, as far as a match can reach), base64 runs (in all four phases, and joined over line breaks where lines have 16 letters or more), and gzip, zlib, bz2,
xz and zstd streams anywhere inside decoded bytes, those of escapes included. Bytes that aren't clean UTF-8 are scanned where they are text. Every new layer is scanned like the text and put on the worklist
until nothing new comes. A content is scanned once, but its spans are mapped wherever it occurs; one content is entered once at one place, which ends cycles.
Each layer carries a map to the text: for escapes each decoded character maps to the characters that made it, for base64 and compressed layers all of it maps to the whole run
(all wrapped lines if it reaches over a break), or to the part between / - _ or the end of a stream where the rest of the run is something else.

Spans of decoded layers are added to the base spans; base spans stay. Kinds: assign, access, hex. Positions are code points, end exclusive.

Compressed layers are read whole, all members, in pieces of LAYER_BYTES (a parameter against decompression bombs) that overlap by OVERLAP; of larger ones only
what can hold a secret is kept. ``n_cut`` counts pieces that end in a run longer than the overlap, and zstd streams where zstandard isn't installed.

Base64 runs under 16 letters decode to less than 12 bytes, which can hold no secret (the shortest has 16 characters).

Nulls: null text has no spans. Empty and repeated rows each get their row. Whole texts are scanned; the time is linear in the length of a layer and in the number of layers. An escape that is
itself escaped four times or more in one way (%2525..., \\u005cu005c..., \\x5cx5c..., &#38;#38;...) is brought to its last level in one step, so depth costs nothing (100,000 levels: 0.2 s); what is nested deep in
several ways by turns still costs its depth times its length. Not unwrapped: UTF-16, deflate without a header, named HTML entities, and escapes of other forms (%u003d, \\u{3d}, \\U0000003d). Other columns are ignored.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import io
import lzma
import re
import zlib

try:
    import zstandard
except ModuleNotFoundError:  # its streams are counted as cut
    zstandard = None

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import by_text
from tarn.llm._words import chunks

KINDS = ("assign", "access", "hex")
LAYER_BYTES = 8 << 20
OVERLAP = 64 << 10
CACHE_BYTES = 64 << 20

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_TOKEN = re.compile(r"[^\s\"'<>]+")
_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED_END = re.compile(r"[A-Za-z0-9+/_-]{16,}\Z")
_WRAPPED_REST = re.compile(r"(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_RAW = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
_SHORT = dict(zip("nrtabfv0\\'\"", "\n\r\t\a\b\f\v\0\\'\""))
_RAW_X = re.compile(_RAW.pattern + r"|\\[nrtabfv0\\'\"]")
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\udc80-\udcff]")
_CLEAN = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\udc80-\udcff]{12,}")
_ANY_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in one layer."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _unit(s: str) -> tuple[list[str], list[int]]:
    """Characters that one run of escapes stands for, and the escape number at which each begins."""
    if s[0] == "&":
        n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        return ([chr(n)], [0]) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else ([], [])
    step, skip = (6, 2) if s[:2] == "\\u" else (4, 2) if s[:2] == "\\x" else (3, 1)
    values = [int(s[i + skip : i + step], 16) for i in range(0, len(s), step)]
    if step == 6:
        chars, at, i = [], [], 0
        while i < len(values):
            v = values[i]
            if 0xD800 <= v < 0xDC00 and i + 1 < len(values) and 0xDC00 <= values[i + 1] < 0xE000:
                chars.append(chr(0x10000 + ((v - 0xD800) << 10) + values[i + 1] - 0xDC00))
                at.append(i)
                i += 2
                continue
            chars.append("�" if 0xD800 <= v < 0xE000 else chr(v))
            at.append(i)
            i += 1
        return chars, at
    raw = bytes(values)
    try:
        chars = list(raw.decode())
    except UnicodeDecodeError:
        chars = list(raw.decode("latin-1"))
        return chars, list(range(len(chars)))
    at, n = [], 0
    for c in chars:
        at.append(n)
        n += len(c.encode())
    return chars, at


def unescape(s: str) -> tuple[str, list[int]]:
    """Decoded text and, for each of its characters and the end, where it begins in ``s``."""
    out, at, done = [], [], 0
    for m in _UNIT.finditer(s):
        out += s[done : m.start()]
        at += range(done, m.start())
        chars, where = _unit(m[0])
        step = len(m[0]) if m[0][0] == "&" else 6 if m[0][:2] == "\\u" else 4 if m[0][:2] == "\\x" else 3
        out += chars
        at += [m.start() + w * step for w in where]
        done = m.end()
    out += s[done:]
    at += range(done, len(s))
    return "".join(out), [*at, len(s)]


#: an escaped escape sign, escaped again and again: a level removes one
_NESTED = re.compile(r"%(?:25){4,}(?=[0-9A-Fa-f]{2})|\\(?:u005[cC]){4,}(?=u[0-9A-Fa-f]{4})|\\(?:x5[cC]){4,}(?=x[0-9A-Fa-f]{2})|&(?:#38;){4,}(?=#)|&(?:#x26;){4,}(?=#)")


#: characters of a level, by the first two of the escape
_LEVEL = {"%2": 2, "\\u": 5, "\\x": 3, "&#3": 4, "&#x": 5}


def collapsed(s: str) -> tuple[str, list[int], int] | None:
    """``unescape`` for runs of four levels or more, all at once: each run becomes the one escape that is left in the end. None if there is no such run; the last value is how many levels the deepest had."""
    out, at, done, levels = [], [], 0, 0
    for m in _NESTED.finditer(s):
        levels = max(levels, (len(m[0]) - 1) // (_LEVEL.get(m[0][:2]) or _LEVEL[m[0][:3]]))
        out.append(s[done : m.start() + 1])
        at += range(done, m.start() + 1)
        done = m.end()
    if not done:
        return None
    return "".join([*out, s[done:]]), [*at, *range(done, len(s) + 1)], levels


_LONG_RUN = re.compile(rb"[A-Za-z0-9+/_=%\\\s-]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def inflate(data: bytes, limit: int):
    """Content of a compressed stream and of all its members, in pieces of at most ``limit`` bytes up to where it is damaged; returns the bytes it takes, 0 if damaged or not ended."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        try:
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as d:
                while piece := d.read(limit):
                    yield piece
        except zstandard.ZstdError:
            pass
        return 0
    if data[:3] == b"BZh":
        kind, new = data[:3], bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\x00":
        kind, new = data[:6], lzma.LZMADecompressor
    else:
        kind, new = data[:2], lambda: zlib.decompressobj(47)
    at = 0
    while data[at : at + len(kind)] == kind:
        d, feed = new(), at
        try:
            while not d.eof:
                rest = getattr(d, "unconsumed_tail", b"")
                if not rest and getattr(d, "needs_input", True):
                    rest = data[feed : feed + (1 << 16)]
                    feed += len(rest)
                    if not rest and feed >= len(data) and not (piece := d.decompress(b"", limit)):
                        return 0
                    elif not rest:
                        yield piece
                        continue
                if piece := d.decompress(rest, limit):
                    yield piece
        except (zlib.error, OSError, lzma.LZMAError, EOFError):  # damaged from here on
            return 0
        at = feed - len(d.unused_data)
    return at


def _matter(body: str) -> list[str]:
    """The parts of a text in which anything can be found."""
    found = [body[a:b] for a, _, b in scan(body)] + [m[0] for r in (_WRAPPED, _BASE64) for m in r.finditer(body)]
    return found + ([body[a:b] for a, b in _regions(body)] if _ANY_ESCAPE.search(body) else [])


def _opened(data: bytes, limit: int, chain: frozenset = frozenset()) -> tuple[list[tuple[str, int, int, bool]], int, int]:
    """(texts compressed anywhere in some bytes, each with the bytes it takes and whether its stream is complete; streams; streams cut)."""
    out, streams, cut, at = [], 0, 0, 0
    first = len(data) > 1 and data[0] & 15 == 8 and data[0] <= 0x78 and (data[0] << 8 | data[1]) % 31 == 0
    while first or (m := _MAGIC.search(data, at)) is not None:
        start = 0 if first else m.start()
        first = False
        at = start + 1
        if zstandard is None and data[start : start + 4] == b"\x28\xb5\x2f\xfd":
            cut += 1
            continue
        stream, carry, texts, used, last, mark = inflate(data[start:], limit), b"", {}, 0, None, None
        while True:
            try:
                piece = next(stream)
            except StopIteration as end:
                used = end.value
                break
            body = carry + piece
            if last is None:
                mark = _mark(body)
                if mark in chain:
                    break
            else:  # more than one piece: of each only what matters is kept
                texts |= dict.fromkeys(_matter(last))
            last = _text(body)
            more, n, c = _opened(body, limit, chain | {mark})
            texts |= dict.fromkeys(t for t, *_ in more)
            streams, cut = streams + n + bool(more), cut + c
            carry = body[-OVERLAP:]
            if len(piece) == limit and len(carry) == OVERLAP and _LONG_RUN.fullmatch(carry):
                cut += 1
        if last is None:
            continue
        at = start + (used or 1)
        out += [(t, start, at if used else len(data), used > 0) for t in (last, *texts)]
    return out, streams, cut


def _text(data: bytes) -> str:
    """UTF-8; bytes that aren't stand for themselves."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _worth(body: str) -> bool:
    return bool(_BASE64.search(body) or _ANY_ESCAPE.search(body) or scan(body))


def _run(core: str, limit: int) -> tuple[list[tuple[str, int, int, int, int]], int, int]:
    """(texts in a base64 run with the characters they take, and the phase and byte at which a text begins or -1 for a stream; streams; streams cut).

    A run that is text as a whole is one layer. Otherwise its start may belong to something else, since / - _ are letters too: all four phases are
    decoded, and clean stretches and compressed streams are taken from anywhere in them."""
    n, out, whole, streams, cut = len(core), [], [], 0, 0
    letters = core.replace("-", "+").replace("_", "/")
    parts = [m.end() for m in re.finditer(r"[/_-]", core)]
    for phase in range(4):
        part = letters[phase:]
        if len(part) % 4 == 1:
            part = part[:-1]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        if not data:
            continue
        body = data.decode("utf-8", "surrogateescape")
        odd = len(_ODD.findall(body))
        opened, k, c = _opened(data, limit)
        streams, cut = streams + k, cut + c
        for t, x, y, complete in opened:
            end = phase + 4 * (y // 3) + (0, 2, 3)[y % 3]
            out.append((t, phase + 4 * (x // 3), n if y == len(data) else min(n, end), -1, -1))
            if complete:
                whole.append(out[-1][1:3])
        if phase == 0 and odd * 8 <= len(body):
            out.append((body if not odd else data.decode("latin-1"), 0, n, 0, 0))
            if not odd:
                break
            continue
        at = done = 0
        own = [s for s in parts if s >= phase and (s - phase) % 4 == 0] if phase else [0, *(s for s in parts if s % 4 == 0)]
        for m in _CLEAN.finditer(body):
            x = at + len(body[done : m.start()].encode("utf-8", "surrogateescape"))
            y = x + len(m[0].encode())
            at, done = y, m.end()
            if not _worth(m[0]):
                continue
            a = phase + 4 * (x // 3)
            i = bisect.bisect_left(own, phase + 4 * (-(-x // 3)))
            if i < len(own) and own[i] <= a + 8:
                a = own[i]
            elif i:
                a = own[i - 1]
            z = phase + 4 * (y // 3)
            j = bisect.bisect_left(parts, z + 1)
            out.append((m[0], a, n if y == len(data) or j == len(parts) else parts[j] - 1, phase, x))
    out = [t for t in out if t[3] < 0 or not any(a <= t[1] and t[2] <= b for a, b in whole)]  # text by chance within a stream
    return out, streams, cut


def _crosses(body: str, begin: int, phase: int, breaks: list[int]) -> bool:
    """Whether anything in a text decoded from wrapped lines reaches over a line break."""
    raw = body.encode("utf-8", "surrogateescape").decode("latin-1")
    places = [(a, b) for a, _, b in scan(raw)] + [m.span() for r in (_BASE64, _UNIT) for m in r.finditer(raw)]
    return any(bisect.bisect_right(breaks, phase + 4 * (begin + a) / 3) < bisect.bisect_left(breaks, phase + 4 * (begin + b) / 3) for a, b in places)


def _raw_bytes(layer: str) -> tuple[bytes, list[int]]:
    """The bytes that a layer's escapes stand for, other characters as latin-1, and where each of them and the end begins."""
    out, at, done = [], [], 0
    for m in (_RAW_X if "\\x" in layer else _RAW).finditer(layer):
        out.append(layer[done : m.start()])
        at += range(done, m.start())
        s = m[0]
        if s[0] == "&":
            n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        elif s[0] == "%" or s[1] in "xu":
            n = int(s[-2:], 16)
        else:
            n = ord(_SHORT[s[1]])
        out.append(chr(n) if n < 256 else "?")
        at.append(m.start())
        done = m.end()
    out.append(layer[done:])
    at += range(done, len(layer) + 1)
    return "".join(out).encode("latin-1", "replace"), at


def _mark(body: str | bytes) -> bytes:
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass") if isinstance(body, str) else body, digest_size=16).digest()


def _within(outer, inner):
    """The map of a layer to the text, from its parent's map and its own to the parent: None is identity, (a, b) a whole run, else an array."""
    if outer is None or isinstance(outer, tuple):
        return inner if outer is None else outer
    return (int(outer[inner[0]]), int(outer[inner[1]])) if isinstance(inner, tuple) else outer[inner]


def _regions(layer: str) -> list[tuple[int, int]]:
    """Places to unescape: each escaped token with two tokens on either side (a match has three at most) and with the lines of wrapped base64 it is in."""
    tokens = np.array([m.span() for m in _TOKEN.finditer(layer)], np.int64).reshape(-1, 2)
    units = np.array([m.start() for m in _UNIT.finditer(layer)], np.int64)
    out: list[tuple[int, int]] = []
    for i in np.unique(np.searchsorted(tokens[:, 0], units, "right") - 1).tolist():
        a, b = int(tokens[max(i - 2, 0), 0]), int(tokens[min(i + 2, len(tokens) - 1), 1])
        if out and b <= out[-1][1]:
            continue
        while (line := layer.rfind("\n", 0, a)) >= 0 and not layer[line:a].strip() and (not out or a > out[-1][1]):
            before = layer.rfind("\n", 0, line) + 1
            m = _WRAPPED_END.search(layer[before:line].rstrip("\r"))
            if m is None:
                break
            a = before + m.start()
            if layer[before:a].strip():
                break
        if (m := _WRAPPED_REST.match(layer, b)) is not None:
            b = m.end()
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _unwrap(layer: str, limit: int) -> tuple[list[tuple[str, tuple | np.ndarray]], int, int]:
    """(layers within one layer, each with its map to it; streams inflated; streams cut)."""
    out, streams, cut, deepest = [], 0, 0, 1
    if _ANY_ESCAPE.search(layer):
        for a, b in _regions(layer):
            body, at, *levels = collapsed(layer[a:b]) or unescape(layer[a:b])
            deepest = max([deepest, *levels])
            if body != layer[a:b]:
                out.append((body, a + np.array(at, np.int64)))
        streams += deepest - 1  # levels that were taken at once count as layers
        raw, at = _raw_bytes(layer)
        opened, k, c = _opened(raw, limit)
        opened = [(t, x, y) for t, x, y, _ in opened if at[y] - at[x] != y - x]
        streams, cut = streams + k, cut + c
        out += [(t, (at[x], at[y])) for t, x, y in opened]
    wrapped: list[tuple[int, int]] = []
    for m in _WRAPPED.finditer(layer):
        pieces = list(re.finditer(r"[A-Za-z0-9+/_-]+", m[0]))
        breaks = np.cumsum([len(x[0]) for x in pieces])[:-1].tolist()
        got, k, c = _run("".join(x[0] for x in pieces), limit)
        got = [x for x in got if (_crosses(x[0], x[4], x[3], breaks) if x[3] >= 0 else bisect.bisect_right(breaks, x[1]) < bisect.bisect_left(breaks, x[2]))]
        if got:
            streams, cut = streams + k, cut + c
            out += [(x[0], m.span()) for x in got]
        if any(x[3] < 0 for x in got):
            wrapped.append(m.span())
    for m in _BASE64.finditer(layer):
        core = m[0].rstrip("=")
        got, k, c = _run(core, limit)
        streams, cut = streams + k, cut + c
        i = bisect.bisect_right(wrapped, (m.start(), len(layer))) - 1
        part = i >= 0 and m.end() <= wrapped[i][1]  # its stream goes on in the next lines
        out += [(t, (m.start() + a, m.end() if b == len(core) else m.start() + b)) for t, a, b, phase, _ in got if not part or phase >= 0]
    return out, streams, cut


def worklist(text: str, limit: int = LAYER_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, spans of decoded layers mapped to the text, layers, layers cut)."""
    first, root = scan(text), _mark(text)
    added: set[tuple[int, int, int]] = set()
    known: dict[bytes, tuple[list, list | None]] = {}  # what a content holds: its spans, and its layers with their maps (up to CACHE_BYTES, beyond that they are unwrapped anew)
    seen: set = set()
    work: list = [(text, root, None)]
    layers = cut = held = 0
    while work:
        body, mark, where = work.pop()
        spans, own = known.get(mark, (None, None))
        if own is None:
            inner, streams, short = _unwrap(body, limit)
            own = [(x, _mark(x), at) for x, at in inner]
            if spans is None:
                layers += streams + (mark != root)
                cut += short
                spans = scan(body) if mark != root else first
                size = sum(4 * len(x) + (0 if isinstance(at, tuple) else at.nbytes) for x, _, at in own)
                fits = held + size <= CACHE_BYTES
                held += size * fits
                known[mark] = spans, own if fits else None
        if where is not None:
            for a, k, b in spans:
                x, y = _within(where, (a, b))
                added.add((x, k, y))
        for x, k, at in own:
            place = _within(where, at)
            key = k, place if isinstance(place, tuple) else hashlib.blake2b(place.tobytes(), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                work.append((x, k, place))
    return first, sorted(added - set(first)), layers, cut


_LONG = 16


def _flags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold anything: a long run of base64 letters (hex among them), an escape, or a keyword."""
    run = np.zeros(256, bool)
    run[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2B, 0x2F, 0x2D, 0x5F]] = True
    total = np.concatenate([[0], np.cumsum(run[data])])
    out = np.zeros(len(offsets), np.int32)
    hit = np.flatnonzero(total[_LONG:] - total[:-_LONG] == _LONG) if len(total) > _LONG else np.zeros(0, np.int64)
    raw = data.tobytes()
    low = raw.lower()
    places = [hit]
    for word in (b"passw", b"secret", b"token", b"api", b"AKIA", b"\\u", b"\\x", b"&#"):
        at, found, where = 0, [], raw if word.isupper() or not word.isalpha() else low
        while (at := where.find(word, at)) >= 0:
            found.append(at)
            at += len(word)
        places.append(np.array(found, np.int64))
    percent = np.flatnonzero(data == 0x25)
    digit = np.zeros(256, bool)
    digit[[*range(0x30, 0x3A), *range(0x41, 0x47), *range(0x61, 0x67)]] = True
    percent = percent[percent + 2 < len(data)]
    places.append(percent[digit[data[percent + 1]] & digit[data[percent + 2]]])
    for p in places:
        np.add.at(out, np.searchsorted(offsets, p, "right") - 1, 1)
    return out[:-1] > 0


_SPANS = "array<struct<start:int,kind:string,end:int>>"
_SPAN_PA = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def find(docs: DataFrame, keep: list[str], text: str = "text", limit: int = LAYER_BYTES) -> DataFrame:
    """The columns ``keep``, base and decoded (arrays of start, kind, end), n_layers, n_cut of each document."""
    names = [f"k{i}" for i in range(len(keep))]

    def spans(x):
        return [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x]

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("body")):
                n, raw = j - i, memoryview(data)
                base, decoded, layers, cuts = [[]] * n, [[]] * n, [0] * n, [0] * n
                for d in np.flatnonzero(_flags(data, offsets)).tolist():
                    first, more, layers[d], cuts[d] = worklist(str(raw[offsets[d] : offsets[d + 1]], "utf-8", "replace"), limit)
                    base[d], decoded[d] = spans(first), spans(more)
                part = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(base, _SPAN_PA), pa.array(decoded, _SPAN_PA), pa.array(layers, pa.int64()), pa.array(cuts, pa.int64())], [*names, "base", "decoded", "n_layers", "n_cut"])

    return by_text(docs, keep, text, run, f"base {_SPANS}, decoded {_SPANS}, n_layers bigint, n_cut bigint")


def _joined(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(place)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = find(docs, ["doc_id"])
    number = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *number, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "decoded")).alias("spans"), "n_layers", "n_cut")
