"""Language identification: phrases against brute force, scripts, odd rows, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import language

SF = "/root/testdata/sf0.001"


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_language_phrases_and_accuracy(spark, empty):
    rng = random.Random(4)
    sample = "".join(rng.choices("abc ", k=300)).replace("  ", " ")
    p = language.Parser({"x": sample})
    for _ in range(30):
        t = "".join(rng.choices("abcd ", k=rng.randrange(1, 400)))
        codes, sizes = p.encode([t, "", t[:7]])
        want = [brute_phrases(bytes(codes[a:b]), bytes(p.encode([sample])[0])) for a, b in zip(np.cumsum([0, *sizes]), np.cumsum(sizes))]
        assert p.phrases(codes, sizes)[0].tolist() == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !?", "en"), (None, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(odd, {"en": "abc"}, ["doc_id"]).orderBy("doc_id").collect()] == ["en", "und", "und"]
    assert {r.lang_pred for r in language.identify(odd, {}, ["doc_id"]).collect()} == {"und"} and language.digest(empty).collect() == []


def test_phrases_over_many_segments():
    rng = random.Random(8)
    sample = "".join(rng.choices("abcdé ", k=700))
    p = language.Parser({"x": sample, "y": sample[::-1] + " zz"})
    texts = ["".join(rng.choices("abcdéz ", k=k)) for k in (511, 512, 513, 1024, 5000)]
    codes, sizes = p.encode(texts)
    samples = [bytes(p.encode([s])[0]) for s in (sample, sample[::-1] + " zz")]
    at = np.cumsum([0, *sizes])
    got = p.phrases(codes, sizes)
    for k in range(2):
        for d in range(len(texts)):
            own = bytes(codes[at[d] : at[d + 1]])
            assert got[k][d] == sum(brute_phrases(own[i : i + language.SEGMENT], samples[k]) for i in range(0, len(own), language.SEGMENT))


def test_scripts_with_many_letters():
    """Two languages of one large alphabet: letters are told apart however many there are."""
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(6000)]
    a, b = ["".join(rng.sample(han, 2)) for _ in range(300)], ["".join(rng.sample(han, 2)) for _ in range(300)]
    p = language.Parser({"a": " ".join(rng.choices(a, k=4000)), "b": " ".join(rng.choices(b, k=4000)), "en": "the cat sat on the mat " * 50})
    texts = [" ".join(rng.choices(words, k=30)) for words in (a, b) for _ in range(20)] + ["the mat sat"]
    assert p.predict(texts)[0] == ["a"] * 20 + ["b"] * 20 + ["en"]


def test_sample_bounds_and_places(spark):
    """The piece comes from anywhere in a text, and no language takes more documents than asked for."""
    rows = [(i, "licence header in english " * 40 + " ".join(random.Random(i).choices(words, k=600)), lang) for lang, words in (("xx", ["blar", "gnof", "krut"]), ("yy", ["mimi", "lolo", "sasa"])) for i in range(0 if lang == "xx" else 5000, 400 if lang == "xx" else 5400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.fit(docs, per_language=50, piece=200)
    assert set(got) == {"xx", "yy"} and all(len(v) <= 50 * 201 for v in got.values())
    assert all(sum(w in v for w in words) == 3 for v, words in ((got["xx"], ("blar", "gnof", "krut")), (got["yy"], ("mimi", "lolo", "sasa"))))
    assert got == language.fit(docs.repartition(7), per_language=50, piece=200)


def test_clashing_columns_and_repeats(spark, docs):
    odd = docs.withColumn("lang_pred", F.lit("x")).withColumn("dice", F.lit(1)).withColumn("held_out", F.lit("y"))
    got = [tuple(r) for r in language.digest(odd).collect()]
    assert len(got) == docs.count() and all(r[2] in ("en", "de", "fr", "und") and 0 <= r[3] <= 1 for r in got)
    none = [r for r in got if r[0] == 4000]
    assert none[0][2:] == ("und", 0.0)
    assert {r.lang_pred for r in language.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
