"""Gradient-boosted trees with second-order gain on softmax or logistic loss, from distributed histograms (ML-03, ML-04); many models share each pass over the table (ML-07).

Features become bins of one byte once (cuts at quantiles). A level of all trees of a round, of all models, is one job: each task adds the gradients of its rows to histograms (class, node, feature, bin), the
histograms of a node meet by a shuffle and are summed, and only the best split of each node comes to the driver. What is shuffled and collected depends on the models' shape, not on the rows.
Gradients are fixed-point integers, so sums are exact in any order and a task that runs again changes nothing; the trees are those of a plain version on one machine.

Rows with a NULL label, or one that isn't among the classes, are left out. NULL and NaN are missing: a split sends them to the side where they gain more (right on ties). Rows are drawn by a hash of their key, so rows that share a key
are drawn together. A table without rows, or with one class, gives trees without splits. Ties between splits go to the first feature, then the least cut.
"""

from __future__ import annotations

import dataclasses
import json
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.relational import ACCURACY, _numbers, in_order
from tarn.session import cut

#: gain under which a node stays a leaf
LEAST_GAIN = 1e-6
#: rounds after which margins are written out; until then each pass adds the latest trees' values again
ROUNDS_HELD = 10
#: cells of histograms that a task holds (16 bytes each); models beyond that wait for another job
CELLS = 4_000_000
#: weights may be up to this
HEAVIEST = 16


@dataclass(frozen=True)
class Params:
    """``rows`` and ``columns`` are the shares drawn for each round and tree, ``child`` the least sum of second derivatives on a side, ``gamma`` the least gain, ``alpha`` and ``lam`` penalties on a leaf's absolute and squared value.
    With ``patience``, training stops when the loss on held-out rows hasn't fallen for so many rounds, and the best round's trees are kept."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    child: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    patience: int = 0
    seed: int = 42

    def shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0.0)

    def leaf(self, g, h):
        return -self.shrunk(g) / (h + self.lam) * self.rate if h + self.lam > 0 else 0.0

    def score(self, g, h):
        return self.shrunk(g) ** 2 / np.maximum(h + self.lam, 1e-300)


@dataclass
class Tree:
    """Nodes in the order they were made, node 0 first. ``feature`` is -1 in leaves; ``at`` is the bin up to which values go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.at[node], self.missing_left[node], self.left[node], self.gain[node] = feature, at, missing_left, first, gain
        for v in values:
            self.feature.append(-1)
            self.at.append(0)
            self.missing_left.append(False)
            self.left.append(0)
            self.gain.append(0.0)
            self.value.append(v)
        return first, first + 1

    def nodes(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of each row."""
        feature, at, left, lost = (np.array(x) for x in (self.feature, self.at, self.left, self.missing_left))
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            n = node[inner]
            b = bins[inner, feature[n]]
            goes = np.where(b == missing, lost[n], b <= at[n])
            node[inner] = left[n] + ~goes

    def values(self, bins: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, missing)]


@dataclass
class Boosted:
    """Trees of each round (one, or one a class) with what is needed to apply them: feature names in order, class names, and the cuts between bins."""

    features: list[str]
    classes: list[str]
    cuts: list[list[float]]
    trees: list[list[Tree]]

    @property
    def missing(self) -> int:
        return max(map(len, self.cuts), default=0) + 1

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.where(np.isnan(x[:, f]), self.missing, np.searchsorted(cuts, x[:, f], "left"))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        margins = np.zeros((len(x), outputs(len(self.classes))))
        for r in self.trees:
            for k, t in enumerate(r):
                margins[:, k] += t.values(bins, self.missing)
        return chances(margins)

    def predicted(self, *features: Column) -> Column:
        """Probabilities, an array in the order of the classes, of columns in the order of the features."""
        model, width = self, len(self.features)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                p = model.probabilities(x)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<double>")(F.array(*(c.cast("double") for c in features)))

    def splits(self) -> list[tuple[int, int, int, str | None, float | None, float, float]]:
        """(round, class, node, feature, threshold, gain, value) of every node; a leaf has no feature, an inner node the value 0."""
        out = []
        for r, trees in enumerate(self.trees):
            for k, t in enumerate(trees):
                for n, f in enumerate(t.feature):
                    leaf = f < 0
                    out.append((r, k, n, None if leaf else self.features[f], None if leaf else [*self.cuts[f], float("inf")][min(t.at[n], len(self.cuts[f]))], 0.0 if leaf else t.gain[n], t.value[n] if leaf else 0.0))
        return out

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["features"], d["classes"], d["cuts"], [[Tree(**t) for t in r] for r in d["trees"]])


def outputs(classes: int) -> int:
    """Trees a round: two classes need one margin."""
    return 1 if classes == 2 else classes


def chances(margins: np.ndarray) -> np.ndarray:
    """Class probabilities of margins."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], 1)
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(p: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives for tree k, as fixed-point integers (in doubles)."""
    if p.shape[1] == 2:
        q = p[:, 1]
        g, h = q - (y == 1), q * (1 - q)
    else:
        q = p[:, k]
        g, h = q - (y == k), 2 * q * (1 - q)
    return np.rint(g * w * scale), np.rint(np.maximum(h, 1e-16) * w * scale)


def drawn(keys: np.ndarray, params: Params, turn: int) -> np.ndarray:
    """Which rows a round sees: a hash of key, seed and round against the share."""
    if params.rows >= 1:
        return np.ones(len(keys), bool)
    x = keys.astype(np.uint64) ^ np.uint64((params.seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32) < np.uint64(int(params.rows * (1 << 32)))


def columns_of(params: Params, turn: int, k: int, width: int) -> np.ndarray:
    """Which features a tree may split on."""
    allowed = np.zeros(width, bool)
    n = max(1, int(width * params.columns))
    allowed[random.Random(f"{params.seed}:{turn}:{k}").sample(range(width), n)] = True
    return allowed


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, params: Params, scale: float) -> tuple[int, int, bool, float, tuple[int, ...]]:
    """(feature, bin, whether missing goes left, gain, (G, H of the left; of the right)) from histograms (features, bins; the last bin is the missing ones); feature -1 if no split gains enough."""
    total = g[0].sum(), h[0].sum()
    whole = params.score(total[0] / scale, total[1] / scale)
    found = (-1, 0, False, 0.0, (0, 0, 0, 0))
    left = np.cumsum(g[:, :-1], 1), np.cumsum(h[:, :-1], 1)
    gains = []
    for lost in (False, True):
        gl, hl = (c + x[:, -1:] * lost for c, x in zip(left, (g, h), strict=True))
        gr, hr = total[0] - gl, total[1] - hl
        fits = (hl > 0) & (hr > 0) & (hl / scale >= params.child) & (hr / scale >= params.child) & allowed[:, None]
        gain = (params.score(gl / scale, hl / scale) + params.score(gr / scale, hr / scale) - whole) / 2 - params.gamma
        gains.append(np.where(fits, gain, -np.inf))
    most = np.maximum(gains[0], gains[1])
    at = int(most.argmax())
    f, b = divmod(at, most.shape[1])
    if most[f, b] > LEAST_GAIN:
        lost = bool(gains[1][f, b] > gains[0][f, b])
        gl, hl = (int(c[f, b] + x[f, -1] * lost) for c, x in zip(left, (g, h), strict=True))
        found = (f, b, lost, float(most[f, b]), (gl, hl, int(total[0]) - gl, int(total[1]) - hl))
    return found


def _spans(edges: list[float], low: list[bool], high: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(lows, highs) of the brackets from their edges by turns, those that touch joined; an edge that is not needed is infinite."""
    lows = [-np.inf if far else v for v, far in zip(edges[::2], low, strict=True)]
    highs = [np.inf if far else v for v, far in zip(edges[1::2], high, strict=True)]
    out: list[list[float]] = []
    for a, b in sorted(zip(lows, highs, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array([a for a, _ in out], float), np.array([b for _, b in out], float)


def _counted(x: DataFrame, spans: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(c, slot, v, m): how often column number c has the value v within its bracket (slot 2j + 1), and how many values lie in the gap before it (slot 2j, v -inf); counted by batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c, (lows, highs) in enumerate(spans):
                v = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                slot = 2 * np.searchsorted(highs, v, "left")
                slot += v >= np.append(lows, np.inf)[slot // 2]
                slot[slot > 2 * len(highs)] = 2 * len(highs)  # +inf above the last bracket
                gaps = np.bincount(slot[slot % 2 == 0], minlength=1)
                at = np.flatnonzero(gaps)
                own, first, times = np.unique(v[slot % 2 == 1], return_index=True, return_counts=True)
                parts.append((np.full(len(at) + len(own), c), np.concatenate([at, slot[slot % 2 == 1][first]]), np.concatenate([np.full(len(at), -np.inf), own + 0.0]), np.concatenate([gaps[at], times])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["c", "slot", "v", "m"])

    return x.mapInArrow(run, "c int, slot int, v double, m bigint")


def quantile_cuts(df: DataFrame, features: list[str], bins: int, slack: float = 2.0) -> list[list[float]]:
    """Distinct values of each feature at the ranks ceil(i * n / bins), 0 < i < bins, of its n values; exact, in two scans.

    One scan sketches all features and brackets each rank by ``slack`` times the sketch's error; a second counts value by value within brackets, and one row a gap between them. So a few ten-thousandths of the distinct values a rank are
    left to be numbered in order, range by range, and only the cuts come here. If a rank isn't within its bracket, all are widened, in the end to all values."""
    x, _ = _numbers(df, features, [])
    names = x.columns
    while True:
        share = slack / ACCURACY
        low, high = ([i / bins + s for i in range(1, bins)] for s in (-share, share))
        points = [min(1.0, max(0.0, p)) for pair in zip(low, high, strict=True) for p in pair]
        row = x.agg(*(F.struct(F.count(v).alias("n"), F.percentile_approx(v, points, ACCURACY).alias("q")).alias(v) for v in names)).first()
        sizes = [row[v].n for v in names]
        spans = [_spans(row[v].q, [p <= 0 for p in low], [p >= 1 for p in high]) if row[v].n else (np.array([]), np.array([])) for v in names]
        numbered = in_order(_counted(x, spans).groupBy("c", "slot", "v").agg(F.sum("m").alias("m")), "c", "slot", "v", before="m")
        n, first = (F.get(F.array(*(F.lit(k).cast("bigint") for k in ks)), F.col("c")) for ks in (sizes, [sum(sizes[:i]) for i in range(len(sizes))]))
        # how many of the ranks are among the values up to here
        passed = lambda seen: F.least(F.floor(seen * bins / n), F.lit(bins - 1))
        numbered = numbered.withColumn("before", F.col("before") - first)
        found = numbered.filter(passed(F.col("before") + F.col("m")) > passed(F.col("before"))).select("c", "slot", "v").collect()
        if all(r.slot % 2 for r in found):
            return [sorted({r.v for r in found if r.c == c}) for c in range(len(features))]
        slack = max(2.0, slack * 16)


@dataclass
class Training:
    """One model in the making. ``out``: the fold that it doesn't see and is judged on (None: it sees all rows)."""

    params: Params
    out: int | None
    trees: list[list[Tree]] = field(default_factory=list)
    now: list[Tree] = field(default_factory=list)
    frontier: list[list[int]] = field(default_factory=list)
    held: int = 0  # rounds whose values are in the written margins
    losses: list[float] = field(default_factory=list)
    confusion: np.ndarray | None = None
    done: bool = False
    dropped: bool = False  # given up by ``keep_half``


class Table:
    """Rows as keys, classes, folds, weights and bins; written once, and again with margins every ROUNDS_HELD rounds."""

    def __init__(self, df: DataFrame, features: list[str], classes: list[str], key: list[str], label: str, fold: str | None, weight: str | None, bins: int):
        if not 2 <= bins <= 250:
            raise ValueError("bins must be from 2 to 250")
        y = F.coalesce(*(F.when(F.col(f"`{label}`") == c, i) for i, c in enumerate(classes)))
        rows = df.withColumn("_y", y).filter(F.col("_y").isNotNull())
        self.features, self.classes, self.cuts = features, classes, quantile_cuts(rows, features, bins)
        self.missing = max(map(len, self.cuts), default=0) + 1
        cuts, missing = self.cuts, self.missing

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            shape = Boosted(features, classes, cuts, [])
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(features))
                packed = shape.binned(x).astype(np.uint8)
                yield pa.array([r.tobytes() for r in packed], pa.binary())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        x = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
        w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
        k = F.xxhash64(*(F.col(f"`{c}`") for c in key))
        self.rows = cut(rows.select(k.alias("key"), F.col("_y").cast("int").alias("y"), (F.col(f"`{fold}`").cast("int") if fold else F.lit(-1)).alias("fold"), w.alias("w"), F.arrow_udf(run, "binary")(x).alias("bins"), F.array().cast("array<double>").alias("margins")))
        facts = self.rows.agg(F.count("*").alias("n"), F.max("w").alias("w")).first()
        if (facts.w or 0) > HEAVIEST:
            raise ValueError(f"weights must not be over {HEAVIEST}")
        self.scale = float(1 << min(36, 57 - int(facts.n).bit_length()))

    @property
    def width(self) -> int:
        return len(self.features)


@dataclass
class _Rows:
    key: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    w: np.ndarray
    bins: np.ndarray
    margins: np.ndarray


def _rows(batch: pa.RecordBatch, width: int) -> _Rows:
    col = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    n = len(batch)
    fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, width).astype(np.int64)
    return _Rows(col("key"), col("y"), fold, col("w"), bins, batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))


def _margins(rows: _Rows, t: Training, place: int | None, k: int, missing: int) -> np.ndarray:
    m = rows.margins[:, place * k : (place + 1) * k].copy() if place is not None else np.zeros((len(rows.y), k))
    for trees in t.trees[t.held :]:
        for i, tree in enumerate(trees):
            m[:, i] += tree.values(rows.bins, missing)
    return m


def _add_up(table: Table, models: dict[int, Training], places: dict[int, int], level: int, turn: int) -> DataFrame:
    """(model, cls, node, sums): histograms of the frontier's nodes, and at level 0 (cls -1) what the held-out rows say; summed by task only."""
    width, missing, scale, classes = table.width, table.missing, table.scale, len(table.classes)
    size, k = missing + 1, outputs(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = _rows(batch, width)
            cell = np.arange(width) * size + rows.bins
            for m, t in models.items():
                p = chances(_margins(rows, t, places.get(m), k, missing))
                seen = np.ones(len(rows.y), bool) if t.out is None else rows.fold != t.out
                if level <= 0:
                    away = ~seen
                    own = sums.setdefault((m, -1), np.zeros(2 + classes * classes, np.int64))
                    loss = -np.log(np.maximum(p[np.arange(len(p)), rows.y], 1e-15))[away]
                    own[0] += int(np.rint(loss * scale).sum())
                    own[1] += int(away.sum())
                    own[2:] += np.bincount(rows.y[away] * classes + p[away].argmax(1), minlength=classes * classes)
                if level < 0:
                    continue
                seen &= drawn(rows.key, t.params, turn)
                for c in range(k):
                    if not t.frontier[c]:
                        continue
                    place = np.full(len(t.now[c].feature), -1)
                    place[t.frontier[c]] = np.arange(len(t.frontier[c]))
                    slot = place[t.now[c].nodes(rows.bins, missing)]
                    use = seen & (slot >= 0)
                    g, h = gradients(p[use], rows.y[use], rows.w[use], c, scale)
                    at = (slot[use][:, None] * (width * size) + cell[use]).ravel()
                    n = len(t.frontier[c]) * width * size
                    both = sums.setdefault((m, c), np.zeros((2, n), np.int64))
                    for i, x in enumerate((g, h)):
                        both[i] += np.bincount(at, np.repeat(x, width), n).astype(np.int64)
        out: tuple[list, ...] = ([], [], [], [])
        for (m, c), s in sums.items():
            parts = [(-1, s)] if c < 0 else list(zip(models[m].frontier[c], np.moveaxis(s.reshape(2, -1, width * size), 1, 0), strict=True))
            for node, x in parts:
                for values, v in zip(out, (m, c, node, np.ascontiguousarray(x).tobytes()), strict=True):
                    values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["model", "cls", "node", "sums"])

    return table.rows.mapInArrow(run, "model int, cls int, node int, sums binary")


def _decided(table: Table, models: dict[int, Training], places: dict[int, int], level: int, turn: int) -> list:
    """The best split of each node, and at level 0 the held-out sums: the sums of all tasks meet by (model, cls, node), and a few numbers for each of these come here."""
    width, size, scale, k = table.width, table.missing + 1, table.scale, outputs(len(table.classes))
    params = {m: t.params for m, t in models.items()}
    allowed = {(m, c): columns_of(p, turn, c, width) for m, p in params.items() for c in range(k)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for m, c, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(raw, np.int64)
                key = (m, c, node)
                sums[key] = sums[key] + x if key in sums else x
        out = []
        for (m, c, node), x in sums.items():
            if c < 0:
                out.append((m, c, node, -1, 0, False, 0.0, x.tolist()))
            else:
                g, h = x.reshape(2, width, size)
                f, b, lost, gain, parts = best_split(g, h, allowed[m, c], params[m], scale)
                out.append((m, c, node, f, b, lost, gain, [*parts, int(g[0].sum()), int(h[0].sum())]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["model", "cls", "node", "feature", "at", "lost", "gain", "sums"])

    met = _add_up(table, models, places, level, turn).repartition("model", "cls", "node")
    return met.mapInArrow(run, "model int, cls int, node int, feature int, at int, lost boolean, gain double, sums array<bigint>").collect()


def _shares(models: dict[int, Training], cells: int) -> Iterator[dict[int, Training]]:
    """Models in groups whose histograms a task can hold."""
    group, held = {}, 0
    for m, t in models.items():
        need = cells * max(1, sum(map(len, t.frontier)))
        if group and held + need > CELLS:
            yield group
            group, held = {}, 0
        group[m], held = t, held + need
    if group:
        yield group


def _judged(t: Training, sums: list[int], scale: float, classes: int) -> None:
    t.losses.append(sums[0] / scale / sums[1] if sums[1] else float("nan"))
    t.confusion = np.array(sums[2:]).reshape(classes, classes)
    p = t.params
    if p.patience and len(t.losses) - 1 - int(np.nanargmin(t.losses)) >= p.patience and sums[1]:
        t.done = True


def macro_f1(confusion: np.ndarray) -> float:
    """Mean F1 over classes that occur or are predicted; 0 if there is none."""
    seen = confusion.sum(0) + confusion.sum(1)
    f1 = 2 * np.diag(confusion)[seen > 0] / seen[seen > 0]
    return float(f1.mean()) if len(f1) else 0.0


def train(table: Table, trainings: list[Training], keep_half: dict[int, list[list[int]]] | None = None) -> None:
    """Train all models at once, in place. ``keep_half``: at these rounds (number of rounds done), of groups of models (each a list of numbers) still in training, only the half with the better mean macro F1 on their
    held-out rows goes on (ties: the earlier group); the others stop where they are."""
    k, classes = outputs(len(table.classes)), len(table.classes)
    places: dict[int, int] = {}
    base = table.rows
    turn = 0
    while True:
        alive = {m: t for m, t in enumerate(trainings) if not t.done and len(t.trees) < t.params.rounds}
        # a last look at the models whose rounds are over
        over = {m: t for m, t in enumerate(trainings) if not t.done and len(t.trees) == t.params.rounds and len(t.losses) <= t.params.rounds and t.out is not None}
        for group in _shares(over, 1):
            for r in _decided(table, group, places, -1, turn):
                _judged(trainings[r.model], r.sums, table.scale, classes)
        if not alive:
            break
        for t in alive.values():
            t.now, t.frontier = [Tree() for _ in range(k)], [[0] for _ in range(k)]
        level = 0
        while True:
            growing = {m: t for m, t in alive.items() if any(t.frontier) and level < t.params.depth}
            if not growing:
                break
            rows = [r for group in _shares(growing, table.width * (table.missing + 1)) for r in _decided(table, group, places, level, turn)]
            for r in sorted((r for r in rows if r.cls < 0), key=lambda r: r.model):
                _judged(trainings[r.model], r.sums, table.scale, classes)
            for t in growing.values():
                t.frontier = [[] for _ in range(k)]
            for r in sorted((r for r in rows if r.cls >= 0), key=lambda r: (r.model, r.cls, r.node)):
                t = trainings[r.model]
                p, tree, s = t.params, t.now[r.cls], [v / table.scale for v in r.sums]
                if r.feature < 0:
                    tree.value[r.node] = float(p.leaf(s[4], s[5]))
                else:
                    t.frontier[r.cls] += tree.split(r.node, r.feature, r.at, r.lost, r.gain, (float(p.leaf(s[0], s[1])), float(p.leaf(s[2], s[3]))))
            if level == 0 and keep_half and turn in keep_half:
                groups = [[m for m in g if m in alive] for g in keep_half[turn]]
                ranked = sorted((g for g in groups if g), key=lambda g: -float(np.mean([macro_f1(trainings[m].confusion) for m in g])))
                for m in (m for g in ranked[(len(ranked) + 1) // 2 :] for m in g):
                    trainings[m].done = trainings[m].dropped = True
            for m in [m for m, t in alive.items() if t.done]:
                del alive[m]
            level += 1
        for t in alive.values():
            t.trees.append(t.now)
        turn += 1
        if turn % ROUNDS_HELD == 0 and any(len(t.trees) < t.params.rounds for t in alive.values()):
            places = _hold(table, {m: t for m, t in alive.items() if len(t.trees) <= t.params.rounds}, places)
    for t in trainings:
        t.now, t.frontier = [], []
        if t.params.patience and t.losses and t.out is not None and not np.isnan(t.losses).all():
            t.trees = t.trees[: int(np.nanargmin(t.losses))]
    table.rows = base


def _hold(table: Table, models: dict[int, Training], places: dict[int, int]) -> dict[int, int]:
    """Write the margins of ``models`` beside the rows; returns where each model's are."""
    width, missing, k = table.width, table.missing, outputs(len(table.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch, width)
            m = np.concatenate([_margins(rows, t, places.get(i), k, missing) for i, t in models.items()], 1)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], batch.schema.names)

    table.rows = cut(table.rows.mapInArrow(run, table.rows.schema))
    for t in models.values():
        t.held = len(t.trees)
    return {m: i for i, m in enumerate(models)}


def fit(df: DataFrame, features: list[str], classes: list[str], params: Params, key: list[str], label: str = "label", fold: str | None = None, out: int | None = None, weight: str | None = None, bins: int = 64) -> Boosted:
    """One model of all rows, or of those outside the fold ``out``, on which its loss is judged (needed for ``patience``)."""
    table = Table(df, features, classes, key, label, fold, weight, bins)
    t = Training(params, out)
    train(table, [t])
    return Boosted(features, classes, table.cuts, t.trees)


def search(df: DataFrame, features: list[str], classes: list[str], draws: list[Params], folds: list[int], key: list[str], label: str = "label", fold: str = "fold", bins: int = 64, halve_at: tuple[int, ...] = ()) -> list[tuple[Params, float, int, bool]]:
    """ML-07: (draw, mean macro F1 over the folds, rounds trained, whether it was trained to its end) in the order of the draws. All draws on all folds are trained in the same passes over one binned table; with ``halve_at``, after these numbers of rounds only the better half
    of the draws goes on; the others keep the score that they had and can't be chosen. A row's fold should be that of its group (``folds.stratified_folds``)."""
    table = Table(df, features, classes, key, label, fold, None, bins)
    trainings = [Training(p, k) for p in draws for k in folds]
    groups = [list(range(i * len(folds), (i + 1) * len(folds))) for i in range(len(draws))]
    train(table, trainings, {r: groups for r in halve_at})
    out = []
    for p, g in zip(draws, groups, strict=True):
        out.append((p, float(np.mean([macro_f1(trainings[m].confusion) for m in g])), max(len(trainings[m].trees) for m in g), not any(trainings[m].dropped for m in g)))
    return out
