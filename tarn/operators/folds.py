"""Splits by group that depend on every earlier choice.

Groups that are alike (of one size, or with the same counts of each class) stand together in the order, and what happens to a run of them has a short form: a few stretches in which the same picks repeat. Only
the distinct kinds of groups pass through one task, a row a kind with the number of its groups, and only counters are its state; the groups themselves stay in ranges of the order, and each finds its pick from its number within its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.relational import in_order

SPLITS = ("train", "valid", "test")
#: a stretch of a run: from which number on, how many groups, and the picks that repeat in it
_STRETCHES = "array<struct<start bigint, length bigint, picks array<int>>>"


def seeded(key: str, seed: str):
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))


def filled(room: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Stretches of ``count`` groups of one size, each to the split with the most room (ties: the first; no room anywhere: the first). Changes ``room``."""
    out, at = [], 0
    while at < count:
        order = sorted(range(len(room)), key=lambda k: (-room[k], k))
        if size == 0 or room[order[0]] <= 0:
            pick = order[0] if room[order[0]] > 0 else 0
            room[pick] -= size * (count - at)
            out.append((at, count - at, [pick]))
            break
        # those within one group of the fullest are served in turn, until another has more room or one has none left
        turn = [k for k in order if (room[k], -k) > (room[order[0]] - size, -order[0]) and room[k] > 0]
        last = turn[-1]
        rounds = (count - at) // len(turn)
        rounds = min(rounds, (room[last] - 1) // size + 1)
        for k in order[len(turn) :]:
            # the last one's room before its last turn must still come before that of k
            gap = room[last] - room[k] - (0 if last < k else 1)
            rounds = min(rounds, gap // size + 1 if gap >= 0 else 0)
        if rounds < 1:
            turn, rounds = turn[:1], 1
        for k in turn:
            room[k] -= size * rounds
        out.append((at, rounds * len(turn), turn))
        at += rounds * len(turn)
    return out


def repeated(picks: list[int], longest: int) -> list[tuple[int, int, list[int]]]:
    """Stretches of a list of picks: at each place the period, up to ``longest``, that covers most."""
    out, at = [], 0
    while at < len(picks):
        best = (1, 1)
        for p in range(1, longest + 1):
            n = p
            while at + n < len(picks) and picks[at + n] == picks[at + n - p]:
                n += 1
            if n > best[0] and (n > p or p == 1):
                best = (n, p)
        out.append((at, best[0], picks[at : at + best[1]]))
        at += best[0]
    return out


def dealt(held: np.ndarray, whole: np.ndarray, row: np.ndarray, count: int) -> list[tuple[int, int, list[int]]]:
    """Stretches of ``count`` groups with the class counts ``row``, each to the fold that then has the least mean, over classes, of the spread of class shares (ties: fewest rows, then the first). Changes ``held``.
    When all folds have had one in turn they are as far apart as before, so the same turn repeats to the end."""
    folds, picks = len(held), []
    while len(picks) < count:
        best = None
        for f in range(folds):
            held[f] += row
            cost = (round(float((held / whole).std(axis=0).mean()), 12), float(held[f].sum()), f)
            held[f] -= row
            best = cost if best is None or cost < best else best
        held[best[2]] += row
        picks.append(best[2])
        if not row.any():
            return [(0, count, picks[:1])]
        turn = picks[-folds:]
        if len({*turn}) == folds and len(picks) < count:
            left = count - len(picks)
            held += row * (left // folds)
            for f in turn[: left % folds]:
                held[f] += row
            return [*repeated(picks, folds), (len(picks), left, turn)]
    return repeated(picks, folds)


def _picked(groups: DataFrame, kind: list[str], order: list[Column | str], run) -> DataFrame:
    """``groups`` with ``pick``: ``run`` makes the stretches of each kind from (kind columns, count) in order. A kind may hold most groups: its stretches meet it by range of the order, so no key is larger than a range."""
    kinds = groups.groupBy(*kind).agg(F.count("*").alias("_count"))
    types = dict(groups.dtypes)
    names = ", ".join(f"{c} {types[c]}" for c in kind)
    # one row a kind
    runs = kinds.repartition(1).sortWithinPartitions(*order[: len(kind)]).mapInPandas(run, f"{names}, _first bigint, _runs {_STRETCHES}")
    placed = in_order(groups, *order)
    there = placed.select("_part", *kind).distinct()
    found = there.join(runs, kind).withColumnsRenamed({c: f"_r_{c}" for c in kind} | {"_part": "_r_part"})
    same = F.col("_part") == F.col("_r_part")
    for c in kind:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    nth = F.col("_at") - F.col("_first")
    stretch = F.get(F.filter("_runs", lambda s: (s["start"] <= nth) & (nth < s["start"] + s["length"])), F.lit(0))
    pick = F.get(stretch["picks"], ((nth - stretch["start"]) % F.size(stretch["picks"])).cast("int"))
    return placed.join(found, same).select(*groups.columns, pick.alias("pick"))


def _stretches(kinds: Iterator[pd.DataFrame], kind: list[str], make) -> Iterator[pd.DataFrame]:
    first = 0
    for b in kinds:
        rows, starts = [], []
        for *values, count in b[[*kind, "_count"]].itertuples(index=False):
            rows.append([{"start": s, "length": n, "picks": [int(x) for x in p]} for s, n, p in make(values, int(count))])
            starts.append(first)
            first += int(count)
        yield b[kind].assign(_first=starts, _runs=rows)


def greedy_split(sizes: DataFrame, key: str, n: str, total: int, seed: str = "split", train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """SPL-02: largest group first (then in a seeded order), each to the split with the most room left (ties: train, valid, test; no room anywhere: train)."""
    goal = [int(total * train), int(total * valid)]
    goal.append(total - sum(goal))

    def run(kinds: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = list(goal)
        yield from _stretches(kinds, [n], lambda values, count: filled(room, int(values[0]), count))

    groups = sizes.select(key, n, seeded(key, seed).alias("_o"))
    return _picked(groups, [n], [F.desc(n), "_o", key], run).select(key, n, F.element_at(F.array(*map(F.lit, SPLITS)), F.col("pick") + 1).alias("split"))


def stratified_folds(df: DataFrame, group: str, label: str, classes: list, folds: int = 5, seed: str = "42") -> DataFrame:
    """SPL-03, SPL-04: (group, fold). Groups in order of falling spread of their class counts (ties: counts of the first class, then of the second and so on, greatest first, then in seeded order) go to the fold that then has
    the least mean, over classes, of the spread of class shares between folds; ties to the fold with fewest rows."""
    cols = [f"n{i}" for i in range(len(classes))]
    counts = df.groupBy(group).agg(*(F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)))
    totals = counts.agg(*(F.sum(c).alias(c) for c in cols)).first()
    whole = np.array([max(1, totals[c] or 0) for c in cols])
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    spread = F.round(F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in cols), F.lit(0.0)) / len(cols)), 9)

    def run(kinds: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((folds, len(cols)))
        yield from _stretches(kinds, ["_s", *cols], lambda values, count: dealt(held, whole, np.array(values[1:], float), count))

    groups = counts.withColumns({"_s": spread, "_o": seeded(group, seed)})
    return _picked(groups, ["_s", *cols], [F.desc("_s"), *map(F.desc, cols), "_o", group], run).select(group, F.col("pick").alias("fold"))


def augment(train: DataFrame, label: str, key: str, features: list[str], targets: list, each: int, level: float = 0.015, seed: int = 42) -> DataFrame:
    """SPL-08: ``each`` new rows per target class, half between two rows of the class (weight .15 to .85, half the noise), half a row with noise of ``level``
    deviations. Randomness is a hash of class and number, so reruns agree. Sources are drawn, with repeats, from a seeded
    random 4 * ``each`` rows of the class; about twice as many are let through by a hash before they are ranked, so no task ranks a whole class. All original rows stay unchanged."""
    from pyspark.sql import Window

    src = train.filter(F.col(label).isin(*targets)).select(label, key, *features)
    stats = src.groupBy(label).agg(*(F.stddev_pop(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(f"_s_{c}") for c in features))
    share = src.groupBy(label).agg((F.lit(8.0 * each) / F.count("*")).alias("_share")).withColumnRenamed(label, "_l")  # a row a target class
    dice = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit("dice")), F.lit(1 << 30)) / float(1 << 30)
    few = src.join(F.broadcast(share), F.col(label) == F.col("_l")).filter(dice < F.col("_share")).drop("_l", "_share")
    stats = stats.join(few.groupBy(label).agg(F.least(F.count("*"), F.lit(4 * each)).alias("_n")), label)
    ranked = few.withColumn("_i", F.row_number().over(Window.partitionBy(label).orderBy(seeded(key, str(seed)), key))).filter(F.col("_i") <= 4 * each).withColumn("_i", F.col("_i") - 1)
    unit = lambda *parts: (F.pmod(F.xxhash64(F.lit(seed), label, "_k", *map(F.lit, parts)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda c: F.sqrt(-2 * F.log(unit("u", c))) * F.cos(6.283185307179586 * unit("v", c))
    new = stats.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumns({"_blend": F.col("_k") < each // 2, "_a": F.floor(unit("a") * F.col("_n")).cast("int"), "_b": F.floor(unit("b") * F.col("_n")).cast("int"), "_w": 0.15 + 0.70 * unit("w")})
    side = lambda p: ranked.select(F.col(label).alias(f"{p}_l"), F.col("_i").alias(f"{p}_i"), *(F.col(c).alias(f"{p}_{c}") for c in features))
    new = new.join(side("A"), (F.col(label) == F.col("A_l")) & (F.col("_a") == F.col("A_i"))).join(side("B"), (F.col(label) == F.col("B_l")) & (F.col("_b") == F.col("B_i")))
    value = lambda c: F.when(F.col("_blend"), F.col("_w") * F.col(f"A_{c}") + (1 - F.col("_w")) * F.col(f"B_{c}") + 0.5 * level * F.col(f"_s_{c}") * normal(c)).otherwise(F.col(f"A_{c}") + level * F.col(f"_s_{c}") * normal(c))
    made = new.select(label, F.concat_ws("_", F.lit("aug"), F.col(label).cast("string"), F.col("_k").cast("string")).alias(key), *(value(c).alias(c) for c in features))
    return train.select(label, F.col(key).cast("string").alias(key), *features).unionByName(made)
