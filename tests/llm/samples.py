"""A small corpus with nulls, repeats, ties, empty and long texts, and columns whose names clash with results."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string"


def corpus(seed=3, n=60):
    """Documents that share passages, with copies, near copies, nulls, repeated rows and columns whose names clash with results."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    base = rng.choices(words, k=300)
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.choice((0, 1, 3, 4, 5, 19, 20, 21, 80, 300)))
        if i % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) :]
        rows.append([i * 3, rng.choice((" ", "\n", "  ")).join(w), rng.choice(("en", "de", None)), rng.choice(("a", "a", "b", None)), 0, 7, "x"])
    for i in range(6):
        copy = list(rows[20 + i])
        rows.append([1000 + i, copy[1], *copy[2:]])
        rows.append([2000 + i, " ".join([*base[: 80 + i], f"z{i}", *base[81 + i :]]), "en", "a", 0, 7, "x"])
    rows.append([3000, "the " * 3000, "en", "b", 0, 7, "x"])
    rows += [[4000, None, None, None, None, None, None], [None, "only a text", "en", "a", 0, 7, "x"], list(rows[0]), [4001, "É" * 30 + " ß x", "fr", "a", 0, 7, "x"]]
    return [tuple(r) for r in rows]
