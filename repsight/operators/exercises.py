"""Exercise specifications: joint angles, form rules and messages as columns.

Every rule is a native column expression over the pose array, evaluated
before any shuffle (map side), for both body sides at once: the side is only
known after the first frame of a set is found by a scan, and keeping both
variants lets the expensive 33-point array be dropped before the exchange.

Per side ``s`` (``L``/``R``) the feature step adds:

``rep_s``   the angle that drives the repetition latch (elbow / knee)
``aux_s``   the second displayed angle (body / hip)
``fu_s``    form is good if the latch is up after this frame
``fd_s``    form is good if the latch is down after this frame
``iu_s``    issue bits if up   (bit 0, 1, 2 = first, second, third message)
``idn_s``   issue bits if down
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import joint_angle, limb_angle, np_round, py_fixed

SIDES = ("L", "R")


def part_index(part: str, side: str) -> int:
    left, right = K.BODY_PART_INDEX[part]
    return left if side == "L" else right


def landmark(pose: Column, index: int) -> Column:
    """Null-safe landmark lookup (``get`` returns null when out of range)."""
    return F.get(pose, index)


def point_angle(pose: Column, i1: int, i2: int, i3: int) -> Column:
    p1, p2, p3 = landmark(pose, i1), landmark(pose, i2), landmark(pose, i3)
    return joint_angle(p1["x"], p1["y"], p2["x"], p2["y"], p3["x"], p3["y"])


def _not_nan(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _bits(*flags: Column) -> Column:
    """Pack issue flags (True = issue) into an int, bit i for flag i."""
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return out


# ---------------------------------------------------------------------------
# feature primitives (stage 1) and rules (stage 2)
# ---------------------------------------------------------------------------

# Rounded coordinates the rules compare: (part, axis, decimals).
ROUNDED = [
    ("wrist", "x", 1), ("shoulder", "x", 1), ("knee", "y", 2), ("wrist", "y", 2), ("toes", "y", 2),
    ("ankle", "x", 1), ("knee", "x", 1), ("toes", "x", 1),
]


def _case_index(exercise: Column, side: str, feat: str, pos: int) -> Column:
    out = None
    for ex, triples in COMPUTE_TRIPLES.items():
        idx = F.lit(part_index(triples[feat][pos], side))
        out = F.when(exercise == ex, idx) if out is None else out.when(exercise == ex, idx)
    return out


def limbs(pose: Column, side: str, exercise: Column) -> dict[str, Column]:
    """The limbs of the two angles as vectors (joints chosen per row by exercise)."""
    out = {}
    for feat in ("rep", "aux"):
        a, b, c = [F.get(pose, _case_index(exercise, side, feat, k)) for k in range(3)]
        for axis in ("x", "y"):
            out[f"c_{feat}u{axis}_{side}"] = a[axis] - b[axis]
            out[f"c_{feat}v{axis}_{side}"] = c[axis] - b[axis]
    return out


def primitives(pose: Column, side: str) -> dict[str, Column]:
    """Stage 1: the two angles, from the columns of ``limbs``, and rounded coordinates."""
    out = {}
    for feat in ("rep", "aux"):
        out[f"{feat}_{side}"] = limb_angle(*[_c(f"c_{feat}{limb}", side) for limb in ("ux", "uy", "vx", "vy")])
    for part, axis, n in ROUNDED:
        out[f"c_{part}{axis}{n}_{side}"] = np_round(landmark(pose, part_index(part, side))[axis], n)
    return out


def _c(name: str, side: str) -> Column:
    return F.col(f"{name}_{side}")


def pushup_rules(side: str, deviation: Column) -> dict[str, Column]:
    elbow, body = _c("rep", side), _c("aux", side)
    tol = deviation + F.lit(K.VARIATION)
    body_aligned = _not_nan(body) & (body > F.lit(K.GOAL_BODY_ANGLE) - tol) & (body < F.lit(K.GOAL_BODY_ANGLE) + tol)
    shoulders_aligned = (_c("c_wristx1", side) == _c("c_shoulderx1", side)) | (
        _not_nan(elbow) & (elbow <= F.lit(K.ELBOW_THRESHOLD))
    )
    knees_up = _c("c_kneey2", side) < F.least(_c("c_wristy2", side), _c("c_toesy2", side))
    shoulders_aligned = F.coalesce(shoulders_aligned, F.lit(False))
    knees_up = F.coalesce(knees_up, F.lit(False))
    body_aligned = F.coalesce(body_aligned, F.lit(False))
    good = shoulders_aligned & knees_up & body_aligned
    bits = _bits(~shoulders_aligned, ~knees_up, ~body_aligned)
    return {"fu": good, "fd": good, "iu": bits, "idn": bits}


def squat_rules(side: str, deviation: Column) -> dict[str, Column]:
    knee_a, hips = _c("rep", side), _c("aux", side)
    var = F.lit(K.VARIATION)
    shoulders_over = F.coalesce(_c("c_shoulderx1", side) - _c("c_anklex1", side) < var, F.lit(False))
    # latch up after this frame
    ktf_up = F.coalesce(_c("c_kneex1", side) - _c("c_anklex1", side) < var, F.lit(False))
    standing = _not_nan(knee_a) & (knee_a > F.lit(K.UP_THRESHOLD))
    hips_up = F.when(standing, F.coalesce(_not_nan(hips) & ((F.lit(180.0) - hips) < deviation), F.lit(False))).otherwise(
        F.lit(True)
    )
    # latch down after this frame
    ktf_down = F.coalesce(_c("c_kneex1", side) - _c("c_toesx1", side) < var, F.lit(False))
    moving = _not_nan(knee_a) & (knee_a < F.lit(K.UP_THRESHOLD)) & (knee_a > F.lit(K.DOWN_THRESHOLD))
    hips_range = _not_nan(hips) & (F.lit(45.0) - deviation < hips) & (hips < F.lit(90.0) + deviation)
    hips_down = F.when(moving, F.lit(True)).otherwise(F.coalesce(hips_range, F.lit(False)))
    return {
        "fu": ktf_up & hips_up & shoulders_over,
        "fd": ktf_down & hips_down & shoulders_over,
        "iu": _bits(~ktf_up, ~hips_up, ~shoulders_over),
        "idn": _bits(~ktf_down, ~hips_down, ~shoulders_over),
    }


def pushup_message(bits: Column) -> Column:
    text = F.concat_ws(
        ", ",
        F.when(bits.bitwiseAND(1) != 0, F.lit(K.PUSHUP_MSG_SHOULDERS)),
        F.when(bits.bitwiseAND(2) != 0, F.lit(K.PUSHUP_MSG_KNEES)),
        F.when(bits.bitwiseAND(4) != 0, F.lit(K.PUSHUP_MSG_BODY)),
    )
    return F.when(bits == 0, F.lit(K.PUSHUP_GOOD)).otherwise(text)


def squat_message(bits: Column, down: Column, hips: Column) -> Column:
    hips_txt = py_fixed(hips, 1)
    knees = F.when(down, F.lit(K.SQUAT_MSG_KNEES_DOWN)).otherwise(F.lit(K.SQUAT_MSG_KNEES_UP))
    down_tpl, up_tpl = (t.split("{}") for t in (K.SQUAT_MSG_HIPS_DOWN, K.SQUAT_MSG_HIPS_UP))
    hips_msg = F.when(down, F.concat(F.lit(down_tpl[0]), hips_txt, F.lit(down_tpl[1]))).otherwise(
        F.concat(F.lit(up_tpl[0]), hips_txt, F.lit(up_tpl[1]))
    )
    text = F.concat_ws(
        ", ",
        F.when(bits.bitwiseAND(1) != 0, knees),
        F.when(bits.bitwiseAND(2) != 0, hips_msg),
        F.when(bits.bitwiseAND(4) != 0, F.lit(K.SQUAT_MSG_SHOULDERS)),
    )
    return F.when(bits == 0, F.lit(K.SQUAT_GOOD)).otherwise(text)


# ---------------------------------------------------------------------------
# registry (E1, E2): one spec per exercise
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class ExerciseSpec:
    """Everything the engine needs to know about one exercise.

    ``rep``/``aux``: body parts (first, joint, last) of the latch angle and
    of the second angle; ``rules(side, deviation)``: column builders for
    ``fu``/``fd``/``iu``/``idn`` over the stage-1 columns; ``message(bits,
    down, aux)``: the issue text; ``display``: (name, "rep"|"aux", parts) of
    the stored/displayed angles; ``interest``: landmarks of interest in order;
    ``tag``: short name used in column names.
    """

    name: str
    tag: str
    rep: tuple[str, str, str]
    aux: tuple[str, str, str]
    rules: Callable[[str, Column], dict[str, Column]]
    message: Callable[[Column, Column, Column], Column]
    display: tuple[tuple[str, str, tuple[str, str, str]], ...]
    interest: tuple[str, ...]


REGISTRY: dict[str, ExerciseSpec] = {}


def register(spec: ExerciseSpec) -> ExerciseSpec:
    """Add an exercise; every operator dispatches over the registry with CASE."""
    REGISTRY[spec.name] = spec
    return spec


register(ExerciseSpec(
    name="push-ups", tag="pu",
    rep=("wrist", "elbow", "shoulder"),
    # the displayed body angle lists the ankle; its value is computed with the knee
    aux=("shoulder", "hip", "knee"),
    rules=lambda side, dev: pushup_rules(side, dev),
    message=lambda bits, down, aux: pushup_message(bits),
    display=(("elbow", "rep", ("wrist", "elbow", "shoulder")), ("body", "aux", ("shoulder", "hip", "ankle"))),
    interest=("shoulder", "elbow", "wrist", "hip", "ankle", "knee", "toes"),
))
register(ExerciseSpec(
    name="squats", tag="sq",
    rep=("ankle", "knee", "hip"),
    aux=("shoulder", "hip", "knee"),
    rules=lambda side, dev: squat_rules(side, dev),
    message=squat_message,
    display=(("knee", "rep", ("ankle", "knee", "hip")), ("hip", "aux", ("shoulder", "hip", "knee"))),
    interest=("shoulder", "wrist", "hip", "ankle", "knee", "toes"),
))

class _View(Mapping):
    """One property of every registered exercise, read from the registry at each use."""

    def __init__(self, of: Callable[[ExerciseSpec], object]):
        self.of = of

    def __getitem__(self, name: str):
        return self.of(REGISTRY[name])

    def __iter__(self) -> Iterator[str]:
        return iter(REGISTRY)

    def __len__(self) -> int:
        return len(REGISTRY)


# Views of the registry used by operators and the SQL oracle.
COMPUTE_TRIPLES = _View(lambda s: {"rep": s.rep, "aux": s.aux})
RULE_BUILDERS = _View(lambda s: s.rules)
DISPLAY_ANGLES = _View(lambda s: [tuple(d) for d in s.display])
INTEREST_PARTS = _View(lambda s: list(s.interest))
TAGS = _View(lambda s: s.tag)


def deviation_of(strictness: Column) -> Column:
    """Strictness level -> degrees; unknown level -> null (rejected upstream)."""
    m = F.create_map(*[x for k, v in K.STRICTNESS_DEGREES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.lower(strictness))


def side_flag(pose: Column) -> Column:
    """Facing left when the left elbow is more visible than the right (ties: right)."""
    li, ri = K.SIDE_LANDMARKS
    return landmark(pose, li)["visibility"] > landmark(pose, ri)["visibility"]


def add_primitives(df: DataFrame, exercise: Column, pose_col: str = "landmarks") -> DataFrame:
    """Stage 1: ``left_first``, per-side angles ``rep_s``/``aux_s`` and rounded coordinates.

    The limbs are a projection of their own: they are referenced several times
    an angle, and one method with all of it is too long for the JVM to compile.
    """
    pose = F.col(pose_col)
    out = df.withColumns({n: c for side in SIDES for n, c in limbs(pose, side, exercise).items()})
    cols = {"left_first": side_flag(pose)}
    for side in SIDES:
        cols.update(primitives(pose, side))
    return out.withColumns(cols)


def add_rules(df: DataFrame, exercise: Column, deviation: Column, suffix: str = "") -> DataFrame:
    """Stage 2: ``fu``/``fd``/``iu``/``idn`` per side from the stage-1 columns."""
    out = df.withColumn("__dev", deviation)
    cols = {}
    for side in SIDES:
        per_ex = {ex: build(side, F.col("__dev")) for ex, build in RULE_BUILDERS.items()}
        for feat in ("fu", "fd", "iu", "idn"):
            expr = None
            for ex, feats in per_ex.items():
                expr = F.when(exercise == ex, feats[feat]) if expr is None else expr.when(exercise == ex, feats[feat])
            cols[f"{feat}_{side}{suffix}"] = expr
    return out.withColumns(cols).drop("__dev")


def drop_primitives(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("c_")])


def with_features(df: DataFrame, exercise: Column, deviation: Column, pose_col: str = "landmarks") -> DataFrame:
    """Add per-side feature columns (see module doc) and ``left_first``.

    Two projections: stage 1 computes the angles and rounded coordinates once;
    stage 2 derives the rules from those columns.  Catalyst keeps the stages
    apart because the angles are expensive and referenced several times.
    ``exercise`` may vary per row (a CASE over the registry); unknown
    exercises produce null features.
    """
    return drop_primitives(add_rules(add_primitives(df, exercise, pose_col), exercise, deviation))


FLAGS = ("fu", "fd", "iu", "idn")


def rule_variants(df: DataFrame, pose_col: str = "landmarks") -> DataFrame:
    """Every rule variant as columns, computed from the pose (map side), pose dropped.

    Adds ``left_first``, ``aux_{side}``, ``rep_{tag}_{side}`` and
    ``{flag}_{side}_{tag}_{level}`` for each exercise, strictness level and
    side; ``select_variant`` later picks the row's variant from its settings.
    """
    out = df
    specs = list(REGISTRY.values())
    for i, spec in enumerate(specs):
        out = add_primitives(out, F.lit(spec.name), pose_col)
        for side in SIDES:
            out = out.withColumnRenamed(f"rep_{side}", f"rep_{spec.tag}_{side}")
        for level, dev in K.STRICTNESS_DEGREES.items():
            tmp = out.withColumns({f"rep_{side}": F.col(f"rep_{spec.tag}_{side}") for side in SIDES})
            tmp = add_rules(tmp, F.lit(spec.name), F.lit(dev), suffix=f"_{spec.tag}_{level}")
            out = tmp.drop(*[f"rep_{side}" for side in SIDES])
        out = drop_primitives(out)
        if i < len(specs) - 1:  # side flag and second angle do not depend on the exercise
            out = out.drop("left_first", *[f"aux_{side}" for side in SIDES])
    return out.drop(pose_col)


ISSUES = (1 << 31) - 1


def pack_flags(names: list[str]) -> Column:
    """The four flag columns (``FLAGS``) of a rule in one number; nulls count as 0."""
    fu, fd, iu, idn = [F.coalesce(F.col(n).cast("bigint"), F.lit(0).cast("bigint")) for n in names]
    return fu.bitwiseOR(F.shiftleft(fd, 1)).bitwiseOR(F.shiftleft(iu, 2)).bitwiseOR(F.shiftleft(idn, 33))


def unpack_flags(r: Column) -> dict[str, Column]:
    """The flags of a number of ``pack_flags``."""
    return {
        "fu": r.bitwiseAND(1) != 0, "fd": r.bitwiseAND(2) != 0,
        "iu": F.shiftright(r, 2).bitwiseAND(ISSUES).cast("int"), "idn": F.shiftright(r, 33).cast("int"),
    }


def pack_variants(df: DataFrame) -> DataFrame:
    """The columns of ``rule_variants`` as two arrays, so a row that crosses exchanges and checkpoints stays narrow.

    ``angles``: for each side its second angle, then the latch angle of each
    exercise; ``rules``: for each side, exercise and strictness level the four
    flags in one number (``variant_places`` gives the places).
    """
    angles, rules, given = [], [], []
    for side in SIDES:
        given += [f"aux_{side}", *[f"rep_{tag}_{side}" for tag in TAGS.values()]]
        angles += [F.col(f"aux_{side}"), *[F.col(f"rep_{tag}_{side}") for tag in TAGS.values()]]
        for tag in TAGS.values():
            for level in K.STRICTNESS_DEGREES:
                names = [f"{f}_{side}_{tag}_{level}" for f in FLAGS]
                given += names
                rules.append(pack_flags(names))
    return df.withColumns({"angles": F.array(*angles), "rules": F.array(*rules)}).drop(*given)


def variant_places(names: list[str], side: str) -> tuple[int, dict[str, int], dict[tuple[str, str], int]]:
    """Places of a side's second angle, of its latch angles by exercise and of its rules by exercise and level."""
    k, levels = SIDES.index(side), list(K.STRICTNESS_DEGREES)
    first, rule = k * (1 + len(names)), k * len(names) * len(levels)
    places = {(ex, lv): rule + i * len(levels) + j for i, ex in enumerate(names) for j, lv in enumerate(levels)}
    return first, {ex: first + 1 + i for i, ex in enumerate(names)}, places


def select_variant(df: DataFrame, exercise: Column, strictness: Column) -> DataFrame:
    """Per-side ``rep``/``aux``/flags of the row's exercise and strictness level in place of the packed variants.

    Unknown exercises or levels give nulls.
    """
    level = F.lower(strictness)
    picked, flags = {}, {}
    for side in SIDES:
        aux, reps, places = variant_places(list(REGISTRY), side)
        place = rule = F.lit(None).cast("int")
        for ex, at in reps.items():
            place = F.when(exercise == ex, F.lit(at)).otherwise(place)
        for (ex, lv), at in places.items():
            rule = F.when((exercise == ex) & (level == lv), F.lit(at)).otherwise(rule)
        picked |= {f"rep_{side}": F.get("angles", place), f"aux_{side}": F.get("angles", F.lit(aux)), f"__rule_{side}": F.get("rules", rule)}
        flags |= {f"{f}_{side}": c for f, c in unpack_flags(F.col(f"__rule_{side}")).items()}
    return df.withColumns(picked).drop("angles", "rules").withColumns(flags).drop(*[f"__rule_{side}" for side in SIDES])


def pick_side(df: DataFrame, left: str = "left_side") -> DataFrame:
    """Collapse the per-side columns to the side found at the set's first frame."""
    lf = F.col(left)
    cols = {}
    for feat in ("rep", "aux", "fu", "fd", "iu", "idn", "pfu", "pfd"):
        if f"{feat}_L" in df.columns:
            cols[feat] = F.when(lf, F.col(f"{feat}_L")).otherwise(F.col(f"{feat}_R"))
    out = df.withColumns(cols)
    return out.drop(*[c for c in out.columns if c[-2:] in ("_L", "_R")])


def message(exercise: Column, bits: Column, down: Column, aux: Column) -> Column:
    out = None
    for name, spec in REGISTRY.items():
        m = spec.message(bits, down, aux)
        out = F.when(exercise == name, m) if out is None else out.when(exercise == name, m)
    return out


def angles_data(exercise: Column, rep: Column, aux: Column, left: Column) -> Column:
    """The nested per-frame ``angles_data`` value (two named angles with indices)."""
    out = None
    for ex, specs in DISPLAY_ANGLES.items():
        elems = []
        for name, feat, parts in specs:
            val = rep if feat == "rep" else aux
            idx = F.when(
                left, F.array(*[F.lit(part_index(p, "L")) for p in parts])
            ).otherwise(F.array(*[F.lit(part_index(p, "R")) for p in parts]))
            elems.append(F.struct(F.lit(name).alias("name"), val.alias("value"), idx.alias("joint_indices")))
        arr = F.array(*elems)
        out = F.when(exercise == ex, arr) if out is None else out.when(exercise == ex, arr)
    return out


def interest_map(exercise: Column, left: Column) -> Column:
    """``ldmrks_of_interest``: landmark index -> body part, for the set's side."""
    out = None
    for ex, parts in INTEREST_PARTS.items():
        m_left = F.map_from_arrays(
            F.array(*[F.lit(part_index(p, "L")) for p in parts]), F.array(*[F.lit(p) for p in parts])
        )
        m_right = F.map_from_arrays(
            F.array(*[F.lit(part_index(p, "R")) for p in parts]), F.array(*[F.lit(p) for p in parts])
        )
        m = F.when(left, m_left).otherwise(m_right)
        out = F.when(exercise == ex, m) if out is None else out.when(exercise == ex, m)
    return out
