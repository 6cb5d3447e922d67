"""Box geometry as column expressions (SPA01-06, 16-18, 24, 32; PRJ05, 13, 26, 33; FUN21).

A box is a struct or array-free set of four columns: functions take a ``Box`` of columns, so plans stay inside generated
code. A null coordinate or a degenerate box has area 0 and overlaps nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", row: Column | None = None) -> Box:
    """The columns ``<prefix>x1`` to ``<prefix>y2``, of a struct if one is given."""
    names = [f"{prefix}{c}" for c in ("x1", "y1", "x2", "y2")]
    return Box(*(row[n] if row is not None else F.col(n) for n in names))


def from_array(values: Column, scale: float = 1.0) -> Box:
    return Box(*(values[i] / F.lit(scale) for i in range(4)))


def _positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x.cast("double"))


def valid(b: Box) -> Column:
    return F.coalesce((b.x1 < b.x2) & (b.y1 < b.y2), F.lit(False))


def area(b: Box) -> Column:
    """SPA01"""
    return F.when(valid(b), _positive(b.x2 - b.x1) * _positive(b.y2 - b.y1)).otherwise(F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    wide = _positive(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    high = _positive(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return F.when(valid(a) & valid(b), wide * high).otherwise(F.lit(0.0))


def crossed(a: Box, b: Box) -> Column:
    """The intersection of valid boxes whose sides cross."""
    return (F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)).cast("double") * (F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)).cast("double")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """SPA02, SPA03: 0 where the union is empty."""
    both = intersection(a, b)
    return _ratio(both, area(a) + area(b) - both)


def containment(a: Box, b: Box) -> Column:
    """SPA02: the intersection over the smaller area."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def fraction_of(a: Box, b: Box) -> Column:
    """SPA05: the part of ``a`` that ``b`` covers."""
    return _ratio(intersection(a, b), area(a))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def center_inside(inner: Box, outer: Box) -> Column:
    """JOI14: borders count as inside."""
    x, y = center(inner)
    return x.between(outer.x1, outer.x2) & y.between(outer.y1, outer.y2)


def same_face(a: Box, b: Box, least_iou: float = 0.2, reach: float = 0.42) -> Column:
    """SPA06: enough overlap, or centres nearer than a share of the longest side (1 at least)."""
    (ax, ay), (bx, by) = center(a), center(b)
    side = F.greatest(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1, F.lit(1)).cast("double")
    return (iou(a, b) >= least_iou) | (F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= F.lit(reach) * side)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_box(b: Box, high: int = 1000) -> Column:
    """PRJ13: a struct of whole numbers in 0..high, rounded half to even, or null if nothing is left."""
    parts = [F.greatest(F.lit(0), F.least(F.lit(high), F.bround(x.cast("double"), 0).cast("int"))) for x in b]
    made = F.struct(*(p.alias(n) for p, n in zip(parts, Box._fields, strict=True)))
    return F.when((parts[0] < parts[2]) & (parts[1] < parts[3]), made)


def relative_to(inner: Box, outer: Box) -> Column:
    """SPA24: area ratio, centre and size of ``inner`` in ``outer``; null where the ratio or centre is out of range."""
    x, y = center(inner)
    wide, high = (outer.x2 - outer.x1).cast("double"), (outer.y2 - outer.y1).cast("double")
    ratio, cx, cy = _ratio(area(inner), area(outer)), (x - outer.x1) / wide, (y - outer.y1) / high
    sound = (ratio > 0) & (ratio <= 1) & cx.between(0, 1) & cy.between(0, 1)
    made = F.struct(ratio.alias("area_ratio"), cx.alias("center_x"), cy.alias("center_y"), ((inner.x2 - inner.x1) / wide).alias("width"), ((inner.y2 - inner.y1) / high).alias("height"))
    return F.when((wide > 0) & (high > 0) & sound, made)


def scaled(values: Column) -> Column:
    """PRJ33: if any coordinate is over 1, all are thousandths; clamped to 0..1, four places half to even."""
    thousandths = F.exists(values, lambda x: x > 1)
    return F.transform(values, lambda x: F.bround(clamp(F.when(thousandths, x / F.lit(1000.0)).otherwise(x.cast("double")), 0.0, 1.0), 4))


def recentered(b: Box, toward: Box, share: float, high: float = 1000.0) -> Box:
    """SPA17: moved by a share of the way to another box's centre, within 0..high."""
    (x, y), (tx, ty) = center(b), center(toward)
    dx, dy = (tx - x) * share, (ty - y) * share
    return Box(*(clamp(c + d, 0.0, high) for c, d in zip(b, (dx, dy, dx, dy), strict=True)))


def placed(b: Box, frame: Box, unit: float = 1000.0) -> Box:
    """SPA18: coordinates of a tile or crop as those of the page that holds it."""
    wide, high = frame.x2 - frame.x1, frame.y2 - frame.y1
    return Box(frame.x1 + b.x1 * wide / unit, frame.y1 + b.y1 * high / unit, frame.x1 + b.x2 * wide / unit, frame.y1 + b.y2 * high / unit)


def size_bin(height: Column, whole: Column) -> Column:
    """PRJ05: by the share of the height."""
    share = height / whole
    return F.when(share < 0.035, "tiny").when(share < 0.07, "small").when(share < 0.14, "medium").otherwise("large")


def suspicious(b: Box) -> Column:
    """PRJ26: the reasons for which a face box on the 0..1000 scale is doubtful."""
    wide, high = (b.x2 - b.x1).cast("double"), (b.y2 - b.y1).cast("double")
    reasons = F.array(
        F.when((F.greatest(wide / high, high / wide) > 1.85) & (high > 95), "aspect"),
        F.when(wide * high / 1e6 > 0.045, "area"),
        F.when(high > 260, "height"),
        F.when(wide > 260, "width"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def tiles(wide: Column, high: Column, parts: int = 2, share: float = 0.6) -> Column:
    """SPA32: an array of overlapping tiles, each a share of the side."""
    step = (1.0 - share) / (parts - 1)
    return F.array(*[F.struct(F.floor(wide * (i * step)).cast("int").alias("x1"), F.floor(high * (j * step)).cast("int").alias("y1"), F.ceil(wide * (i * step + share)).cast("int").alias("x2"), F.ceil(high * (j * step + share)).cast("int").alias("y2")) for j in range(parts) for i in range(parts)])


def evenly(values: Column, most: int) -> Column:
    """SPA16, SMP26: at most ``most`` elements at evenly spaced places, first and last among them."""
    n = F.size(values)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1)), 0).cast("int"))
    return F.when(n <= most, values).otherwise(F.transform(places, lambda i: F.get(values, i)))


def unit_scaled(b: Box) -> Box:
    """SPA04 where no field says the scale: a box on 0 to 1 or on 0 to 1000 as one on 0 to 1; null where it is outside both
    or has no area."""
    corners = (b.x1, b.y1, b.x2, b.y2)
    least, most = F.least(*corners), F.greatest(*corners)
    ok = (least >= 0) & (most <= 1000) & (b.x2 > b.x1) & (b.y2 > b.y1)
    return Box(*[F.when(ok & (most <= 1), x).when(ok, x / 1000.0) for x in corners])


def by_field(unit: Column, thousandths: Column) -> Column:
    """SPA04: the field that holds four numbers decides the scale, the unit field first; array<double> on 0 to 1, or null
    where neither field has four numbers or the chosen box has no area. Coordinates outside the page stay as they are."""
    four = lambda v: F.coalesce(F.size(v) == 4, F.lit(False))
    chosen = F.when(four(unit), unit.cast("array<double>")).when(four(thousandths), F.transform(thousandths.cast("array<double>"), lambda x: x / 1000.0))
    whole = F.forall(chosen, lambda x: x.isNotNull())
    return F.when(whole & (F.get(chosen, F.lit(0)) < F.get(chosen, F.lit(2))) & (F.get(chosen, F.lit(1)) < F.get(chosen, F.lit(3))), chosen)
