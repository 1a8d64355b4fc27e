"""Escapes of escapes: all levels at once gives what one level after the other ends at, and where."""

import random
import time

import pytest

from tarn.llm import secrets

FORMS = {"percent": ("%", "25", "41"), "u": ("\\", "u005c", "u0041"), "x": ("\\", "x5C", "x41"), "decimal": ("&", "#38;", "#65;"), "hex": ("&", "#x26;", "#x41;")}


def nested(form, depth):
    sign, again, last = FORMS[form]
    return sign + again * depth + last


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("depth", [0, 1, 3, 4, 5, 17])
def test_a_secret_at_any_depth(form, depth):
    text = f"so password=bcdefghijkl{nested(form, depth)} end"
    base, added, _, cut = secrets.worklist(text)
    want = (text.index("password"), 0, text.index(" end"))
    assert want in {*base, *added} and cut == 0


def test_all_levels_at_once_end_where_single_ones_do():
    rng = random.Random(8)
    for _ in range(200):
        parts = [rng.choice(["a", "=", " ", "%", "\\", "&", "25", "zz", nested(rng.choice([*FORMS]), rng.randrange(12))]) for _ in range(rng.randrange(1, 9))]
        text = "".join(parts)
        slow = text
        while (s := secrets.unescape(slow)[0]) != slow:
            slow = s
        fast, seen = text, 0
        while (s := (secrets.collapsed(fast) or secrets.unescape(fast))[0]) != fast:
            fast, seen = s, seen + 1
        assert fast == slow and seen < 40
        made = secrets.collapsed(text)
        if made:
            body, at, _ = made
            assert len(at) == len(body) + 1 and at[-1] == len(text) and all(body[i] == text[a] for i, a in enumerate(at[:-1])) and at == sorted(at)


@pytest.mark.parametrize("form", FORMS)
def test_depth_costs_no_time(form):
    text = f"password=bcdefghijkl{nested(form, 100_000)} " + "x" * 1000
    began = time.monotonic()
    _, added, layers, _ = secrets.worklist(text)
    assert (0, 0, text.index(" ")) in added and layers == 100_001
    assert time.monotonic() - began < 10
