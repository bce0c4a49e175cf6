"""Column-level numeric helpers: joint angle and the rounding rules.

All helpers return native Spark ``Column`` expressions, so they stay inside
whole-stage codegen.  The rounding helpers reproduce, bit for bit, the four
rounding behaviours the analysed application mixes:

* ``np_round``   numpy ``np.round(x, n)`` (round half to even on x*10^n)
* ``sql_round``  the SQL engine's ``round(double, n)`` (half away from zero on x*10^n)
* ``py_round``   Python ``round(x, n)`` (correctly rounded decimal of the binary value)
* ``py_fixed``   Python ``f"{x:.{n}f}"`` text
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def joint_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle in degrees at point b between the limbs b->a and b->c.

    ``acos(dot(u, v) / (|u| |v|))``.  A null coordinate yields null (bad input);
    a zero-length limb yields NaN, as numpy does; a cosine that rounds outside
    [-1, 1] also yields NaN (no clamping, as in the reference behaviour).
    """
    ax, ay, bx, by, cx, cy = map(_c, (ax, ay, bx, by, cx, cy))
    return limb_angle(ax - bx, ay - by, cx - bx, cy - by)


def limb_angle(ux, uy, vx, vy) -> Column:
    """``joint_angle`` of the limbs u and v (null where a coordinate of theirs is null)."""
    ux, uy, vx, vy = map(_c, (ux, uy, vx, vy))
    dot = ux * vx + uy * vy
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.try_divide(dot, norm)
    # x/0 in numpy is +-inf (or NaN for 0/0); arccos of either is NaN.
    angle = F.coalesce(F.degrees(F.acos(cosine)), nan())
    any_null = ux.isNull() | uy.isNull() | vx.isNull() | vy.isNull()
    return F.when(any_null, F.lit(None).cast("double")).otherwise(angle)


def np_round(x, n: int) -> Column:
    """numpy ``np.round(x, n)``: rint(x * 10^n) / 10^n."""
    s = float(10 ** n)
    return F.rint(_c(x) * s) / s


def sql_round(x, n: int) -> Column:
    """``round(double, n)`` of the analysed SQL engine: half away from zero on x*10^n."""
    x = _c(x)
    s = float(10 ** n)
    return F.signum(x) * F.floor(F.abs(x) * s + 0.5) / s


def py_fixed(x, n: int) -> Column:
    """Python ``f"{x:.nf}"``; NaN prints ``nan`` as Python does."""
    x = _c(x)
    txt = F.regexp_replace(F.format_number(x, n), ",", "")
    return F.when(F.isnan(x), F.lit("nan")).otherwise(txt)


def py_round(x, n: int) -> Column:
    """Python ``round(x, n)`` for doubles."""
    x = _c(x)
    return F.when(F.isnan(x), nan()).otherwise(
        F.regexp_replace(F.format_number(x, n), ",", "").cast("double")
    )


def js_to_fixed0(x) -> Column:
    """JavaScript ``x.toFixed(0)`` for x >= 0 (ties go up)."""
    return F.floor(_c(x) + 0.5).cast("bigint")


def round6(x) -> Column:
    """Output normalisation used by the oracle comparison: 6 decimals, half up.

    NaN and infinities pass through (``floor`` would turn them into integers).
    """
    x = _c(x)
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(1e12))
    return F.when(finite, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x)


def invert_map(m) -> Column:
    """Swap keys and values of a map column (F13); duplicate values keep the last key, null values go (no map has a null key)."""
    entries = F.map_entries(_c(m))

    def stays(e: Column, i: Column) -> Column:
        later = F.slice(entries, i + 2, F.size(entries))
        return e["value"].isNotNull() & ~F.coalesce(F.exists(later, lambda x: x["value"] == e["value"]), F.lit(False))

    return F.map_from_entries(F.transform(F.filter(entries, stays), lambda e: F.struct(e["value"], e["key"])))
