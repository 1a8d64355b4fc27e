"""Byte-pair merges, fill-in-the-middle cuts and alignment against plain versions of each, on odd rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import SCHEMA, corpus

from tarn.llm import alignment, byte_pairs, fill_middle

ODD = [None, "", " ", "\n\n  \t", "a" * 5000, "abab" * 700 + "é", "don't  we'll ＡＢ １２ ٣", "<|endoftext|> <unk> ▁ \x00\x1f", "漢字かな交じり文" * 40, "🙂👩‍👩‍👧 🇩🇪", "x<P>y", "Zß" * 30 + "  \u0085 end", " two  spaces ", "ﬁ ﬀ ① ｱ"]


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts and the small corpus, with repeated rows, null ids and columns named like results."""
    rows = [(10_000 + i, t, None, None, 0, 7, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*corpus(), *rows, rows[5]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return byte_pairs.merges(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def bag(rows):
    return collections.Counter(map(tuple, rows))


# ---- merges


def test_tokens_of_a_corpus(odd, plain):
    want = bag((r.doc_id, len(ids := plain.encode_ordinary(r.text or "")), sha(" ".join(map(str, ids))), sha(r.text or "")) for r in odd.collect())
    assert bag(byte_pairs.digest(odd).collect()) == want


def test_other_columns_stay(odd):
    got = byte_pairs.decode(byte_pairs.encode(odd))
    assert got.columns == [*odd.columns, "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in got.collect())
    assert byte_pairs.encode(odd, ids="score").columns == odd.columns  # replaced, not doubled


def test_empty_table(empty):
    for op in (byte_pairs, fill_middle, alignment):
        assert op.digest(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab 't'\n", max_size=200))
def test_any_text(plain, known, text):
    ids = known.encode([text])[0]
    assert ids.tolist() == plain.encode_ordinary(text) and known.decode(ids)[0].tobytes() == text.encode()


def _one_by_one(word, rank):
    """The tokens of a word by looking for the pair of least rank, the leftmost of equals, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_vocabularies_whose_ranks_fall_back():
    """In made-up vocabularies a merge can make a pair of a lower rank possible: that one goes first within its word."""
    rng = random.Random(5)
    for _ in range(150):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 290:
            tokens.add(bytes(rng.choices(b"abc", k=rng.randint(2, 5))))
        long = [t for t in tokens if len(t) > 1]
        rng.shuffle(long)
        table = [bytes([b]) for b in range(256)] + long
        lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(table))
        m = byte_pairs.Merges(lines, r"\S+")
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 14))) for _ in range(60)]
        tokens, count = m.replay(words)
        assert [t.tolist() for t in np.split(tokens, np.cumsum(count)[:-1])] == [_one_by_one(w, m.rank) for w in words]


def test_long_word_and_full_memo(plain, known, monkeypatch):
    text = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert known.encode([text])[0].tolist() == plain.encode_ordinary(text)
    assert text not in known.memo
    monkeypatch.setattr(byte_pairs, "MEMO_WORDS", 3)
    monkeypatch.setattr(byte_pairs, "REPLAY_WORDS", 2)
    for t in ("one twoo threee fourr", "fivve one twoo", "sixx", "y" * 70, "one twoo"):
        want = plain.encode_ordinary(t)
        ids, count = known.encode([t, "", t])
        assert ids.tolist() == want * 2 and count.tolist() == [len(want), 0, len(want)] and len(known.memo) <= 3 and sorted(known.memo.values()) == list(range(len(known.memo)))
    known.forget()


def test_unknown_ids():
    m = byte_pairs.Merges(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (2 * b) for b in range(256)), r"\S+")
    assert m.decode(np.array([130]))[0].tobytes() == b"A"
    with pytest.raises(ValueError, match="not in the vocabulary"):
        m.decode(np.array([130, 131]))


def test_blocks_keep_every_text():
    texts = pa.array(["x", "aa", None, "b" * 9, "c", "d", "é"])
    assert list(byte_pairs.blocks(texts.slice(1), 3)) == [["aa", ""], ["b" * 9], ["c", "d"], ["é"]]
    assert list(byte_pairs.blocks(texts.slice(0, 0))) == []


# ---- cuts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=3000), st.integers(0, 9))
def test_rank_and_select(bits, thin):
    bits = np.array([b and i % (thin + 1) == 0 for i, b in enumerate(bits)], bool)
    made = fill_middle.Bits(bits)
    at = np.arange(len(bits) + 1)
    assert made.rank(at).tolist() == [int(bits[:i].sum()) for i in at]
    places = np.flatnonzero(bits)
    assert made.total == len(places) and made.select(np.arange(len(places))).tolist() == places.tolist()


def _cut(doc_id, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(w), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(w), form, len(p), len(m), out


def test_cuts_of_a_corpus(odd):
    made = fill_middle.fill_in_middle(odd)
    assert made.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [(*_cut(r.doc_id, r.text), r.text or "") for r in odd.collect()]
    got = made.withColumn("back", fill_middle.restored()).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert bag(got) == bag(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert bag(fill_middle.digest(odd).collect()) == bag((*w[:5], sha(w[5]), sha(w[6])) for w in want)


def test_markers_that_cuts_could_forge(spark):
    rows = [(i, t) for i, t in enumerate(["<<P>", "<S S> <M", "P>S>M>" * 3, "< P > <", "a<b>c<Sd", "<P<S<M" * 5])]
    docs = spark.createDataFrame([(i + 100 * k, t) for k in range(40) for i, t in rows], "doc_id long, text string")
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored()).collect()
    assert all(r.back == r.text for r in got) and any(r.form == "spm" for r in got)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, text string, made int, N int")
    r = fill_middle.fill_in_middle(docs).first()
    assert r.made == 5 and r.n == 3


# ---- alignment


A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _ends(tokens):
    at, out = 0, []
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def _aligned(rows):
    """The query's rows by sets and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(A)
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in enumerate(_byte_letters())}
    piece = {i: bytes(byte[c] for c in p) for p, i in a_of.get_vocab().items() if p != "<|endoftext|>"}
    of_b = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    made, count = [], collections.Counter()
    for doc, text in rows:
        text = text or ""
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        ta, tb = [piece[i] for i in a], [of_b(i) for i in b]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            made.append((doc, None))
            continue
        ea, eb = _ends(ta), _ends(tb)
        cuts = sorted({*ea} & {*eb})
        side = lambda ids, ends, lo, hi: [i for i, e in zip(ids, ends, strict=True) if lo < e <= hi]
        parts = [(side(a, ea, lo, hi), side(b, eb, lo, hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        pairs = [(x, y) for p, q in parts for x in p for y in q]
        count.update({*pairs})
        made.append((doc, (len(a), len(b), parts, pairs)))
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc, m in made:
        if m is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, parts, pairs = m
            names = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in parts)
            out.append((doc, na, nb, len(parts), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), sha(names)))
    return out


def _byte_letters():
    """The stand-in of each byte: itself if Latin-1 prints it, else the next free letter from U+0100."""
    free, out = 0x100, []
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


@pytest.fixture(scope="module")
def short(odd):
    """The odd rows, without the longest, which the plain version takes too long for."""
    return odd.filter("text IS NULL OR length(text) < 3000").cache()


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_alignment_of_a_corpus(short, hot):
    """All pair counts sent to all tasks, some of them, and none: the same rows."""
    want = _aligned([(r.doc_id, r.text) for r in short.collect()])
    got = alignment.scored(short, A, B, ["doc_id"], hot_pairs=hot).select(*COLUMNS).collect()
    assert bag(got) == bag(want)
    assert any(r[1] == 0 and r[7] == "" for r in want) and any(r[4] > r[3] for r in want)


def test_long_groups_give_the_same(short, monkeypatch):
    known = alignment.both(open(A, "rb").read(), open(B, "rb").read())
    texts = [r.text or "" for r in short.collect()]
    plain = alignment.linked(alignment.Aligned(known, texts))
    monkeypatch.setattr(alignment, "SHORT", 1)
    for x, y in zip(plain, alignment.linked(alignment.Aligned(known, texts)), strict=True):
        assert list(x) == list(y)


def test_aligned_tokens_are_real(odd):
    """Groups cut both token lists; the bytes on both sides of each are equal."""
    known = alignment.both(open(A, "rb").read(), open(B, "rb").read())
    rows = alignment.align(odd, A, B, ["doc_id"]).collect()
    assert len(rows) == odd.count()
    for _, ours, theirs, a_ends, b_ends in rows:
        assert len(a_ends) == len(b_ends) and (not a_ends or (a_ends[-1], b_ends[-1]) == (len(ours), len(theirs)))
        i = j = 0
        for p, q in zip(a_ends, b_ends, strict=True):
            assert b"".join(known.a_bytes[x] for x in ours[i:p]) == b"".join(known.b_bytes[x] for x in theirs[j:q]) and p > i and q > j
            i, j = p, q


def test_kept_columns_may_have_any_name(short):
    names = ["doc_id", "text", "n_a", "row", "pairs"]
    clash = short.selectExpr("doc_id", "text", "1 AS n_a", "2 AS row", "3 AS pairs")
    got = alignment.scored(clash, A, B, ["doc_id", "row", "pairs"])
    assert set(names[3:]) < set(got.columns) and {(r["row"], r["pairs"]) for r in got.collect()} == {(2, 3)} and got.count() == short.count()
