"""Two calibrated views to three dimensions, and the quality rules on the result.

Rows hold arrays: ``p1``, ``p2`` (joints of [x, y] pixels at capture size) and ``c1``, ``c2`` (confidences). A row a joint goes through plain projections in generated code: undistortion by fixed-point
iteration, rectification, and triangulation by the least eigenvector of a 4x4 normal matrix (Newton steps on its characteristic polynomial from below, then cofactors). Rigs are a small table,
a row a calibration, broadcast to the joints. What the rules need of a pair's joints (counts, sums, single joints) is combined before the one shuffle, which carries a row a pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.geometry import decimals

JOINTS = 17
CORE = (5, 6, 11, 12)
#: rounds that undo the distortion, and that find the least eigenvalue
UNDISTORT, NEWTON = 5, 12


@dataclass(frozen=True)
class Rig:
    """A stereo calibration: intrinsics K, distortions D (k1 k2 p1 p2 k3), rotation and shift from the first camera to the second, rectifying rotations and projections."""

    K1: np.ndarray
    D1: np.ndarray
    K2: np.ndarray
    D2: np.ndarray
    R: np.ndarray
    T: np.ndarray
    R1: np.ndarray
    R2: np.ndarray
    P1: np.ndarray
    P2: np.ndarray
    scale: tuple[float, float] = field(default=(640 / 1920, 480 / 1080))

    @classmethod
    def of(cls, doc: dict) -> Rig:
        """From a calibration document (SRC-12); the shift has two spellings."""
        k, e, r = doc["intrinsics_refined"], doc["extrinsics"], doc["rectification"]
        shift = e["translation_vector_T"] if "translation_vector_T" in e else e["translation_vector_T_m"]
        a = lambda v: np.asarray(v, float)
        return cls(a(k["K1"]), a(k["D1"]).ravel(), a(k["K2"]), a(k["D2"]).ravel(), a(e["rotation_matrix_R"]), a(shift).ravel(), a(r["R1"]), a(r["R2"]), a(r["P1"]), a(r["P2"]))


    def numbers(self) -> dict[str, float]:
        """All numbers that the joints' projections use, by name, in the order of NUMBERS."""
        out = {"sx": self.scale[0], "sy": self.scale[1]}
        for v, K, D, R, P in ((1, self.K1, self.D1, self.R1, self.P1), (2, self.K2, self.D2, self.R2, self.P2)):
            d = np.pad(D[:5], (0, max(0, 5 - len(D))))
            out |= {f"fx{v}": K[0, 0], f"fy{v}": K[1, 1], f"cx{v}": K[0, 2], f"cy{v}": K[1, 2], f"sk{v}": K[0, 1], f"k1{v}": d[0], f"k2{v}": d[1], f"t1{v}": d[2], f"t2{v}": d[3], f"k3{v}": d[4]}
            H = P[:, :3] @ R
            out |= {f"h{i}{j}{v}": H[i, j] for i in range(3) for j in range(3)} | {f"p{i}{j}{v}": P[i, j] for i in range(3) for j in range(4)}
        out |= {f"r{i}{j}": self.R[i, j] for i in range(3) for j in range(3)} | {f"q{i}{j}": self.R1[i, j] for i in range(3) for j in range(3)} | {f"m{i}": self.T[i] for i in range(3)}
        return {k: float(v) for k, v in out.items()}


def example_rig(turn: float = 0.15, apart: float = 0.5) -> Rig:
    """Two cameras ``apart`` metres apart, the second turned inwards a little; rectified onto their baseline."""
    c, s = np.cos(turn), np.sin(turn)
    R, T = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), np.array([-apart, 0.0, 0.04 * apart])
    x = -(R.T @ T) / np.linalg.norm(T)
    x = x * np.sign(x[0])
    y = np.cross([0, 0, 1.0], x)
    y /= np.linalg.norm(y)
    R1 = np.stack([x, y, np.cross(x, y)])
    K = np.array([[520.0, 0, 320], [0, 515, 240], [0, 0, 1]])
    base = np.linalg.norm(T)
    P1, P2 = np.hstack([K, np.zeros((3, 1))]), np.hstack([K, K @ np.array([[-base], [0], [0]])])
    return Rig(K, np.array([-0.12, 0.03, 0.001, -0.0008, 0.0]), K, np.array([-0.10, 0.02, -0.0005, 0.0006, 0.0]), R, T, R1, R1 @ R.T, P1, P2)


def example_rigs() -> dict[str, Rig]:
    """Ten rigs that differ in distance and angle, CAL_001 to CAL_010."""
    return {f"CAL_{k:03d}": example_rig(0.10 + 0.01 * k, 0.35 + 0.03 * k) for k in range(1, 11)}


NUMBERS = {name: i for i, name in enumerate(example_rig().numbers())}


def with_rigs(df: DataFrame, rigs: Rig | dict[str, Rig]) -> DataFrame:
    """Adds the rig's numbers to each row, an array ``rig``: one rig for all, or that of ``calibration_id`` (NULL where there is none)."""
    if isinstance(rigs, Rig):
        return df.withColumn("rig", F.array(*map(F.lit, rigs.numbers().values())))
    table = df.sparkSession.createDataFrame([(k, list(r.numbers().values())) for k, r in rigs.items()], "_calibration string, rig array<double>")
    # a row a rig, made on the driver: small by construction
    return df.join(F.broadcast(table), F.col("calibration_id") == F.col("_calibration"), "left").drop("_calibration")


class _Rig:
    """The numbers of a row's rig as they stand in expressions: ``g.fx1`` is ``rig[2]``."""

    def __getattr__(self, name: str) -> str:
        return f"rig[{NUMBERS[name]}]"

    def __getitem__(self, name: str) -> str:
        return getattr(self, name)


g = _Rig()


def distorted(x: str, y: str, v: int) -> tuple[str, str]:
    """Pixels of normalised points in view ``v`` (GEO-13): radial and tangential distortion, then the camera's matrix."""
    r = f"({x} * {x} + {y} * {y})"
    radial = f"(1 + {r} * ({g[f'k1{v}']} + {r} * ({g[f'k2{v}']} + {r} * {g[f'k3{v}']})))"
    dx = f"({x} * {radial} + 2 * {g[f't1{v}']} * {x} * {y} + {g[f't2{v}']} * ({r} + 2 * {x} * {x}))"
    dy = f"({y} * {radial} + {g[f't1{v}']} * ({r} + 2 * {y} * {y}) + 2 * {g[f't2{v}']} * {x} * {y})"
    return f"{g[f'fx{v}']} * {dx} + {g[f'sk{v}']} * {dy} + {g[f'cx{v}']}", f"{g[f'fy{v}']} * {dy} + {g[f'cy{v}']}"


def second_frame(p: tuple[str, str, str]) -> list[str]:
    """A point of the first camera's frame in the second's."""
    return ["(" + " + ".join([*(g[f"r{i}{k}"] + " * " + p[k] for k in range(3)), g[f"m{i}"]]) + ")" for i in range(3)]


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (h, i, k) = m
    return f"({a} * ({e} * {k} - {f} * {i}) - {b} * ({d} * {k} - {f} * {h}) + {c} * ({d} * {i} - {e} * {h}))"


def _over(a: str, b: str) -> str:
    return f"coalesce(try_divide({a}, {b}), double('NaN'))"


def _step(df: DataFrame, keep: list[str], **made: str) -> DataFrame:
    """Some columns and new ones. The one-row ``inline`` keeps the steps apart, so that nested expressions aren't repeated at every use and generated code falls into methods that are small enough to be compiled."""
    return df.selectExpr(*keep, *(f"{e} AS {n}" for n, e in made.items())).select(F.inline(F.array(F.struct(*keep, *made))))


def lift(pairs: DataFrame, rigs: Rig | dict[str, Rig], guard: bool = False) -> DataFrame:
    """A row a joint of each pair: ``pair`` (128 bits of hash that stand for the pair's row, so it is the same if a task runs again; equal rows share it), ``rest`` (the pair's other columns), ``j``, ``ok`` (both views are sure, from 0.25 on, and the joint has a place), x, y, z in the first
    camera's frame, rx, ry, rz in the rectified one, and reprojection errors e1, e2 in pixels at calibration size (GEO-08 to 13); NaN where there is no place. A pair without 17 joints, or without a rig, has no joint that is ok;
    NULL and NaN coordinates have no place, a missing confidence isn't sure. ``guard`` replaces a vanishing weight by 1e-7 (GEO-11)."""
    arrays = ("p1", "p2", "c1", "c2")
    fits = F.lit(True)
    for c in arrays:
        fits = fits & F.coalesce(F.size(c) == JOINTS, F.lit(False))
    own = ["calibration_id"] if isinstance(rigs, dict) else []
    whole = [F.col(f"`{c}`") for c in pairs.columns]
    numbered = pairs.select(F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit("pair"), *whole).alias("b")).alias("pair"), F.struct(*(c for c in pairs.columns if c not in arrays)).alias("rest"), *own, *arrays)
    df = numbered.select("pair", "rest", *own, F.posexplode_outer(F.when(fits, F.arrays_zip(*arrays))).alias("j", "s"))
    df = with_rigs(df, rigs)
    base, nan = ["pair", "rest", "j", "sure", "rig"], "double('NaN')"
    sure = "coalesce(if(isnan(s.c1) OR isnan(s.c2), NULL, least(s.c1, s.c2)), -1D)"
    sure = f"if(s.c1 IS NULL OR s.c2 IS NULL, -1D, {sure})"
    df = _step(df, ["pair", "rest", "j"], sure=sure, rig=f"coalesce(rig, array_repeat({nan}, {len(NUMBERS)}))", **{f"{a}{v}": f"coalesce(get(s.p{v}, {i}), {nan}) * coalesce(rig[{NUMBERS[f's{a}']}], {nan})" for v in (1, 2) for i, a in enumerate("xy")})
    seen = ["x1", "y1", "x2", "y2"]
    v0 = {v: f"((y{v} - {g[f'cy{v}']}) / {g[f'fy{v}']})" for v in (1, 2)}
    u0 = {v: f"((x{v} - {g[f'cx{v}']} - {g[f'sk{v}']} * {v0[v]}) / {g[f'fx{v}']})" for v in (1, 2)}
    flat = {f"{n}{v}": f"coalesce({e[v]}, {nan})" for n, e in (("u", u0), ("v", v0), ("a", u0), ("b", v0)) for v in (1, 2)}
    df = _step(df, [*base, *seen], **flat)
    for _ in range(UNDISTORT):
        new = {}
        for v in (1, 2):
            x, y = f"a{v}", f"b{v}"
            r = f"({x} * {x} + {y} * {y})"
            radial = f"(1 + {r} * ({g[f'k1{v}']} + {r} * ({g[f'k2{v}']} + {r} * {g[f'k3{v}']})))"
            new[x] = _over(f"u{v} - (2 * {g[f't1{v}']} * {x} * {y} + {g[f't2{v}']} * ({r} + 2 * {x} * {x}))", radial)
            new[y] = _over(f"v{v} - ({g[f't1{v}']} * ({r} + 2 * {y} * {y}) + 2 * {g[f't2{v}']} * {x} * {y})", radial)
        df = _step(df, [*base, *seen, "u1", "v1", "u2", "v2"], **new)
    row = lambda v, i: f"({g[f'h{i}0{v}']} * a{v} + {g[f'h{i}1{v}']} * b{v} + {g[f'h{i}2{v}']})"
    df = _step(df, [*base, *seen], **{f"{a}{v}": _over(row(v, i), row(v, 2)) for v in (1, 2) for i, a in enumerate("uv")})
    # two rows a view; their products summed are the normal matrix
    df = _step(df, [*base, *seen], **{f"n{2 * v + i - 2}{k}": f"({a}{v} * {g[f'p2{k}{v}']} - {g[f'p{i}{k}{v}']})" for v in (1, 2) for i, a in enumerate("uv") for k in range(4)})
    upper = [(i, k) for i in range(4) for k in range(i, 4)]
    matrix = [f"w{i}{k}" for i, k in upper]
    df = _step(df, [*base, *seen], **{f"w{i}{k}": " + ".join(f"n{r}{i} * n{r}{k}" for r in range(4)) for i, k in upper})
    w = lambda i, k: f"w{min(i, k)}{max(i, k)}"
    minor = lambda i, k, m=w: _det3([[m(r, c) for c in range(4) if c != k] for r in range(4) if r != i])
    df = _step(
        df, [*base, *seen, *matrix], c3="w00 + w11 + w22 + w33", c2=" + ".join(f"(w{i}{i} * w{k}{k} - w{i}{k} * w{i}{k})" for i, k in upper if i < k),
        c1=" + ".join(minor(i, i) for i in range(4)), c0=f"w00 * {minor(0, 0)} - w01 * {minor(0, 1)} + w02 * {minor(0, 2)} - w03 * {minor(0, 3)}", least="0D",
    )
    coefficients = ["c3", "c2", "c1", "c0"]
    slope = "(((4 * least - 3 * c3) * least + 2 * c2) * least - c1)"
    for _ in range(NEWTON):
        df = _step(df, [*base, *seen, *matrix, *coefficients], least=f"least - coalesce(try_divide((((least - c3) * least + c2) * least - c1) * least + c0, {slope}), 0D)")
    shifted = lambda i, k: f"({w(i, k)} - least)" if i == k else w(i, k)
    df = _step(df, [*base, *seen], size=f"-{slope}", **{f"e{i}": f"{'-' if i % 2 == 0 else ''}{minor(3, i, shifted)}" for i in range(4)})
    place = {f"r{a}": _over(f"e{i}", "e3") for i, a in enumerate("xyz")}
    if guard:  # the weight of the unit vector is under 1e-7
        place = {n: f"if(e3 < 1e-14 * size, {_over(f'e{i}', 'sqrt(greatest(e3 * size, 0D)) * 1e-7')}, {place[n]})" for i, n in enumerate(place)}
    df = _step(df, [*base, *seen], **place)
    df = _step(df, [*base, *seen, "rx", "ry", "rz"], **{a: " + ".join(f"{g[f'q{k}{i}']} * r{b}" for k, b in enumerate("xyz")) for i, a in enumerate("xyz")})
    other = second_frame(("x", "y", "z"))
    kept = ["rx", "ry", "rz", "x", "y", "z"]
    df = _step(df, [*base, *seen, *kept], a1=_over("x", "z"), b1=_over("y", "z"), a2=_over(other[0], other[2]), b2=_over(other[1], other[2]))
    pixels = {v: distorted(f"a{v}", f"b{v}", v) for v in (1, 2)}
    df = _step(df, [*base[:4], *kept], **{f"e{v}": f"sqrt(pow({pixels[v][0]} - x{v}, 2) + pow({pixels[v][1]} - y{v}, 2))" for v in (1, 2)})
    ok = "sure >= 0.25D AND abs(rx) < 1e300 AND abs(ry) < 1e300 AND abs(rz) < 1e300"
    return df.selectExpr("pair", "rest", "j", f"coalesce({ok}, false) AS ok", "x", "y", "z", "rx", "ry", "rz", "e1", "e2")


def _gap(a: tuple, b: tuple) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _lengths(p: dict[int, Column], keys: tuple[str, str, str]) -> tuple[Column, Column]:
    at = lambda j: tuple(p[j][k] for k in keys)
    middle = lambda i, j: tuple((x + y) / 2 for x, y in zip(at(i), at(j), strict=True))
    return _gap(at(5), at(6)), _gap(middle(5, 6), middle(11, 12))


#: rigs whose cameras stand so far apart or so near that depth can't be trusted
DEGENERATE = ("CAL_006", "CAL_010")


def final_quality(pairs: DataFrame, rigs: Rig | dict[str, Rig], keep: float = 65.0, degenerate: tuple[str, ...] = DEGENERATE) -> DataFrame:
    """QC-04: ``decision``, ``status`` (PASS, REVIEW, FAIL), ``reason`` and the measures behind them (NULL after an early exit). Needs ``capture_id``, ``calibration_id``, ``posture``, ``verdict`` and
    ``score`` (of ``pairs.correspondence``), p1, p2, c1, c2. Early exits in order: no target, wrong person, degenerate rig. Joints with an error over ``keep`` are masked."""
    df = lift(pairs, rigs)
    df = df.withColumns({"seen": F.col("ok") & (F.col("rz") >= 0.3), "e": (F.col("e1") + F.col("e2")) / 2})
    df = df.withColumns({"fine": F.coalesce(F.col("seen") & (F.col("e") <= keep), F.lit(False))})
    deep_enough = F.col("fine") & (F.col("rz") > 0.4) & (F.col("rz") < 8.0)
    df = df.groupBy("pair").agg(
        F.first("rest").alias("rest"), _copies(), F.count_if("seen").alias("total"), F.count_if("fine").alias("core"), F.coalesce(F.max(F.when(F.col("seen") & ~F.col("fine"), F.col("e"))), F.lit(0.0)).alias("worst"),
        F.avg(F.when(F.col("fine"), F.col("e"))).alias("core_err"), F.avg(F.when(deep_enough, F.col("rz"))).alias("depth"),
        *(F.max(F.when(F.col("fine") & (F.col("j") == j), F.col(f"r{a}"))).alias(f"{a}_{j}") for j in CORE for a in "xyz"),
    )
    shoulder, torso = _lengths({j: {a: F.col(f"{a}_{j}") for a in "xyz"} for j in CORE}, ("x", "y", "z"))
    names = [c for c in pairs.columns if c not in ("p1", "p2", "c1", "c2")]
    df = _repeated(df.withColumns({c: F.col(c) / F.col("copies") for c in ("total", "core")}))
    df = df.select(*(F.col("rest")[c].alias(c) for c in names), *(F.col(c).cast("int").alias(c) for c in ("total", "core")), "worst", "core_err", "depth", shoulder.alias("shoulder"), torso.alias("torso"))
    deep = F.coalesce(F.col("depth").between(0.50, 3.80), F.lit(False))
    span = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    full = (F.col("core") >= 8) & deep & span("shoulder", 0.15, 0.65) & span("torso", 0.22, 0.85) & (F.col("core_err") <= 45.0)
    baselines = {k: f"{np.linalg.norm(r.T):.1f}" for k, r in rigs.items()} if isinstance(rigs, dict) else {k: f"{np.linalg.norm(rigs.T):.1f}" for k in degenerate}
    apart = F.coalesce(*(F.when(F.col("calibration_id") == k, v) for k, v in sorted(baselines.items()) if k in degenerate), F.lit("?"))
    empty = F.col("posture") == "reject"
    says = lambda text, *values: F.format_string(text, *values)
    rules = [
        (F.col("verdict") == "NO_TARGET", "EXCLUDE_3D", F.when(empty, "PASS").otherwise("FAIL"), F.when(empty, "Clean negative sample (empty chair)").otherwise("Target lost")),
        (F.col("verdict") == "WRONG_PERSON", "EXCLUDE_3D_WRONG_PERSON", F.lit("FAIL"), says("Strong evidence of cross-camera person mismatch (score=%d)", "score")),
        (F.col("calibration_id").isin(*degenerate), "EXCLUDE_3D_DEGENERATE_RIG", F.lit("FAIL"), says("Rig %s excluded (Baseline=%sm)", "calibration_id", apart)),
        (full, "INCLUDE_3D_FULL", F.lit("PASS"), says("Full 3D: %d/17 core joints, core_err=%spx, Z=%sm", "core", decimals(F.col("core_err"), 1), decimals(F.col("depth"), 2))),
        ((F.col("core") >= 4) & deep, "INCLUDE_3D_WITH_MASKING", F.lit("REVIEW"), says("Partial 3D: %d/17 core joints - usable with NaN masking", "core")),
        (F.col("verdict") == "SUSPICIOUS", "EXCLUDE_3D_SUSPICIOUS_CORRESPONDENCE", F.lit("FAIL"), says("Suspicious correspondence (score=%d) + insufficient core joints (%d)", "score", "core")),
        (F.lit(True), "EXCLUDE_3D", F.lit("FAIL"), says("Insufficient core joints (%d/17) or depth anomaly (Z=%sm)", "core", decimals(F.coalesce("depth", F.lit(0.0)), 2))),
    ]
    rule = F.coalesce(*(F.when(c, i) for i, (c, *_) in enumerate(rules)))
    df = df.withColumn("rule", rule)
    pick = lambda k: F.coalesce(*(F.when(F.col("rule") == i, r[k] if k > 1 else F.lit(r[k])) for i, r in enumerate(rules)))
    late = lambda c: F.when(F.col("rule") > 2, F.col(c))
    measures = {"core": "core", "total": "total", "core_err": "core_err", "masked_err": "worst", "shoulder": "shoulder", "torso": "torso", "depth": "depth"}
    return df.select("capture_id", "calibration_id", "verdict", pick(1).alias("decision"), pick(2).alias("status"), pick(3).alias("reason"), *(late(c).alias(n) for n, c in measures.items()))


def _copies() -> Column:
    """How many equal rows a pair stands for."""
    return F.count_if(F.coalesce(F.col("j"), F.lit(0)) == 0).alias("copies")


def _repeated(df: DataFrame) -> DataFrame:
    """A row for each of the ``copies``."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy", "copies")


def live_pose(pairs: DataFrame, rig: Rig | dict[str, Rig]) -> DataFrame:
    """QC-08: joints x{j}, y{j}, z{j} in the first camera's frame (NULL where unsure or not deeper than 0.2), ``core_err`` and ``code``,
    the first failing check of one live pair or VALID_3D. Only the first camera's reprojection counts."""
    df = lift(pairs, rig, guard=True)
    there = F.col("ok") & (F.col("z") > 0.2)
    at = lambda j, c, when=None: F.max(F.when((F.col("j") == j) & (F.lit(True) if when is None else when), F.col(c)))
    df = df.groupBy("pair").agg(F.first("rest").alias("rest"), _copies(), *(at(j, a, there).alias(f"{a}{j}") for j in range(JOINTS) for a in "xyz"), *(at(j, "e1").alias(f"e_{j}") for j in CORE))
    df = _repeated(df)
    gone = F.coalesce(*(F.when(F.col(f"z{j}").isNull(), F.lit(f"REJECT_3D_INVALID_CORE_JOINT_{j}")) for j in CORE))
    torso = _lengths({j: {a: F.col(f"{a}{j}") for a in "xyz"} for j in CORE}, ("x", "y", "z"))[1]
    err = (F.col("e_5") + F.col("e_6") + F.col("e_11") + F.col("e_12")) / 4
    code = F.coalesce(gone, F.when(~torso.between(0.15, 0.90), "REJECT_3D_TORSO_LENGTH"), F.when(~F.coalesce(err <= 45.0, F.lit(False)), "REJECT_3D_REPROJECTION"), F.lit("VALID_3D"))
    return df.select(F.col("rest.capture_id").alias("capture_id"), code.alias("code"), err.alias("core_err"), *(f"{a}{j}" for j in range(JOINTS) for a in "xyz"))


def live_gate(pairs: DataFrame, rig: Rig | dict[str, Rig]) -> DataFrame:
    """The code and error of ``live_pose``."""
    return live_pose(pairs, rig).select("capture_id", "code", "core_err")


def variants(df: DataFrame) -> DataFrame:
    """QC-05 (``plain``) and QC-06 (``by_posture``) from joints, depth, shoulder and torso lengths."""
    enough = lambda good: F.when((F.col("joints") >= 8) & good, "PASS").when(F.col("joints") >= 5, "REVIEW").otherwise("FAIL")
    depth = F.coalesce((F.col("depth") > 0.5) & (F.col("depth") < 4.5), F.lit(False))
    within = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    fits = F.when(F.col("posture").isin("upright", "forward_head"), within("shoulder", 0.18, 0.68) & within("torso", 0.28, 0.85)).otherwise(within("shoulder", 0.15, 1.20))
    return df.withColumns({"plain": enough(depth), "by_posture": enough(fits)})


def synthetic_pairs(pose: DataFrame, rigs: Rig | dict[str, Rig] | None = None) -> DataFrame:
    """Poses of ``pose3d`` (17 joints) as seen by a rig's two cameras, that of the row's ``calibration_id`` (by label) where there are several: stands in for captured pairs. A masked joint is unsure; a few second views are shifted, so that errors occur."""
    df = with_rigs(pose.withColumn("calibration_id", F.format_string("CAL_%03d", (F.col("label") + 1).cast("int"))), rigs or example_rig())
    X = {j: tuple(f"({move} + {by} * coalesce({a}{j}, 0D))" for a, by, move in (("x", "0.6D", "0D"), ("y", "0.6D", "0D"), ("z", "0.4D", "1.8D"))) for j in range(JOINTS)}
    df = _step(df, ["vec_id", "label", "calibration_id", "rig", *(f"x{j}" for j in range(JOINTS))], **{f"s{j}": f"array({', '.join(second_frame(X[j]))})" for j in range(JOINTS)}, **{f"f{j}": f"array({', '.join(X[j])})" for j in range(JOINTS)})

    def pixel(p: str, v: int, move: Column) -> Column:
        x, y = distorted(f"({p}[0] / {p}[2])", f"({p}[1] / {p}[2])", v)
        return F.array(F.expr(f"({x}) / {g.sx}"), F.expr(f"({y}) / {g.sy}") + move)

    off = lambda j: F.when((F.col("vec_id") + j) % 11 == 0, 400.0).otherwise(0.0)
    sure = F.array(*(F.when(F.col(f"x{j}").isNull(), 0.1).otherwise(0.9) for j in range(JOINTS)))
    rank = F.when(F.col("vec_id") % 7 < 5, 1).otherwise((F.col("vec_id") % 5 + 1).cast("int"))
    verdict = F.element_at(F.array(*map(F.lit, ("SAME_PERSON", "LIKELY_SAME", "SUSPICIOUS", "WRONG_PERSON", "NO_TARGET"))), rank)
    points = F.element_at(F.array(*map(F.lit, (0, 2, 4, 5, 0))), rank)
    return df.select(
        F.col("vec_id").alias("capture_id"), "calibration_id", verdict.alias("verdict"), points.alias("score"), F.when(F.col("label") == 9, "reject").otherwise("upright").alias("posture"), sure.alias("c1"), sure.alias("c2"),
        F.array(*(pixel(f"f{j}", 1, F.lit(0.0)) for j in range(JOINTS))).alias("p1"), F.array(*(pixel(f"s{j}", 2, off(j)) for j in range(JOINTS))).alias("p2"),
    )


def calibration_verdict(error: Column) -> Column:
    """QC-09: good under 1 pixel, acceptable up to 2, else to be repeated."""
    return F.when(error < 1.0, "GOOD").when(error <= 2.0, "ACCEPTABLE").when(error.isNotNull(), "REPEAT")
