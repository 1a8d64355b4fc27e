"""Learned personal data: pattern scores against brute force, unseen identifiers in realistic contexts, masking."""

import collections
import random

from pyspark.sql import functions as F

from tarn.llm import pii


def brute_scores(edges, rounds, confidence, support, doubt):
    size, could = collections.defaultdict(set), collections.defaultdict(set)
    seeded = {i for _, i, s, _ in edges if s}
    for p, i, s, kinds in edges:
        size[p].add(i)
        if not s and i not in seeded:
            for k in kinds:
                could[p, k].add(i)
    seeds = {(i, s): 1.0 for _, i, s, _ in edges if s}
    scores = dict(seeds)
    for _ in range(rounds):
        good = {}
        for p, own in size.items():
            for k in pii.KINDS:
                known = {i: scores[i, k] for i in own if (i, k) in scores}
                open_ = could[p, k] - set(known)
                if len(known) >= support and (c := min(1.0, sum(known.values()) / (len(own) - (1 - doubt) * len(open_)))) >= confidence:
                    good[p, k] = c
        new = collections.defaultdict(lambda: 1.0)
        for (p, k), c in good.items():
            for i in could[p, k]:
                new[i, k] *= max(1 - c, 1e-9)
        scores = seeds | {ik: 1 - v for ik, v in new.items()}
    return {ik: v for ik, v in scores.items() if v >= confidence}


def test_pattern_scores(spark):
    rng = random.Random(9)
    edges = []
    for _ in range(400):
        p = rng.randrange(12)
        seeded = rng.random() < (0.95, 0.9, 0.6, 0.2)[p % 4]
        n = rng.randrange(40)
        edges.append((f"p{p}", f"s{n}" if seeded else f"u{n}", ("phone", "card")[n % 7 == 0] if seeded else None, [] if seeded else (["phone"], ["card", "phone"], ["email"])[n % 3]))
    df = spark.createDataFrame(edges, "pattern string, instance string, seed string, kinds array<string>")
    for confidence, support, doubt in ((0.8, 3, 0.5), (0.5, 2, 1.0)):
        got = {(r.instance, r.kind): r.score for r in pii.score_patterns(df, 3, confidence, support, doubt).collect()}
        want = brute_scores(edges, 3, confidence, support, doubt)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert any(k[0].startswith("u") for k in want)


def test_unseen_identifiers_in_context(spark):
    """Identifiers no base pattern takes, in sentences of the kind that hold some it does; numbers of other use as decoys."""
    rng = random.Random(4)
    filler = "the a of report we were then also there again north blue under after early".split()
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    seen = {"phone": lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", "email": lambda: f"{digits(3)}x@mail.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    unseen = {"phone": lambda: rng.choice((f"{digits(3)}.{digits(3)}.{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}")), "email": lambda: f"user{digits(4)}@intranet"}
    frames = {"phone": ("you can call me at {} in the evening", "phone: {}", "tel. {} (office)", "reach us under number {} please"), "email": ("mail: {}", "write to address {} for details", "contact <{}> now"), "ip": ("logged in from host {} at noon",)}
    decoys = ("order number {} was shipped", "invoice {} is due", "page {} of the book", "serial: {}")
    rows, planted, clean = [], {}, set()
    for i in range(1500):
        words = rng.choices(filler, k=20)
        roll, at = rng.random(), rng.randrange(20)
        kind = rng.choice(("phone", "email"))
        if roll < 0.3:
            kind = rng.choice(("phone", "email", "ip"))
            words[at] = rng.choice(frames[kind]).format(seen[kind]())
        elif roll < 0.36:
            value = unseen[kind]()
            words[at] = rng.choice(frames[kind]).format(value)
            planted[i] = (kind, value)
        elif roll < 0.6:
            words[at] = rng.choice(decoys).format(digits(rng.choice((7, 10, 12))))
            clean.add(i)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    text = dict(rows)
    hit = sum(any(s.kind == k and text[i][s.start : s.end] == v for s in got[i].learned) for i, (k, v) in planted.items())
    wrong = sum(len(got[i].learned) for i in clean) + sum(any((s.kind, text[i][s.start : s.end]) != planted[i] for s in got[i].learned) for i in planted)
    recall, precision = hit / len(planted), hit / max(1, hit + wrong)
    assert recall > 0.9 and precision > 0.95, (recall, precision)


def test_cards_in_long_runs_and_long_addresses(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "340000000000009"]
    rows = [(i, f"card number: {c} is valid") for i, c in enumerate(cards)] + [(10, f"card number: {cards[0]} {cards[2]} is valid"), (11, "id " + "7" * 200), (12, "card number: 4539 1488 0343 6467 4111 1111 1111 1111 is valid")]
    rows += [(20 + i, f"mail: a{i}@b.example.com ok") for i in range(4)] + [(30, "mail: " + "x" * 300 + "@" + "y" * 300 + " ok"), (31, "@" * 1000), (32, "a@" * 500)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.learned] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[10] == [("card", 13, 29), ("card", 30, 46)] and got[11] == [] and got[12] == [("card", 13, 32), ("card", 33, 52)]
    assert got[30] == [("email", 6, 607)] and got[31] == []
    many = "+1 (509) 555-6973 " * 30 + "509-555-7777"
    assert [x["instance"] for x in pii.candidates(f"w {many}", pii.base(f"w {many}")) if not x["seed"]] in ([], ["509-555-7777"])


def test_mask_of_odd_rows(spark, empty, monkeypatch):
    rows = [(i, f"please call me at +1 (509) 555-{1000 + i} today", 1) for i in range(12)] + [(99, "please call me at (509) 555-7777 today", 2), (99, "please call me at (509) 555-7777 today", 2), (None, "x@y.zz, 1.2.3.4", 3), (None, None, None), (7, "", 0), (8, "nothing 12", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("mark", F.lit(1)).withColumn("learned", F.array(F.lit("z"))).withColumn("c0", F.struct(F.lit(1).alias("a")))
    for limit in (4 << 20, 0):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        out = pii.mask(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
        done = "please call me at <phone> today"
        assert got == collections.Counter({**{(i, done, len(done)): 1 for i in range(12)}, (99, done, len(done)): 2, (None, "<email>, <ip>", 13): 1, (None, None, None): 1, (7, "", 0): 1, (8, "nothing 12", 9): 1})
    assert pii.mask(empty).collect() == [] and pii.mask(empty).columns == empty.columns
