"""Box and point functions. A box is ARRAY<DOUBLE> or ARRAY<INT> of x1, y1, x2, y2; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped(v: Column, top: Column) -> Column:
    return F.least(F.greatest(F.bround(v, 0).cast("int"), F.lit(0)), top)


def _ordered(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    box = F.array(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))
    return F.when((F.greatest(x1, x2) > F.least(x1, x2)) & (F.greatest(y1, y2) > F.least(y1, y2)), box)


def normalize_box(box: Column, width: Column, height: Column) -> Column:
    """Shares of the image if no coordinate is above 1.5, else pixels; null if nothing is left."""
    share = F.array_max(box) <= 1.5
    v = [box[i].cast("double") * F.when(share, (width, height)[i % 2]).otherwise(F.lit(1)) for i in range(4)]
    w, h = (width - 1).cast("int"), (height - 1).cast("int")
    return F.when(F.size(box) == 4, _ordered(_clamped(v[0], w), _clamped(v[1], h), _clamped(v[2], w), _clamped(v[3], h)))


def normalize_square_box(box: Column, size: Column) -> Column:
    """Pixels of a square image."""
    top = (size - 1).cast("int")
    v = [_clamped(box[i].cast("double"), top) for i in range(4)]
    return F.when(F.size(box) == 4, _ordered(*v))


def normalize_unit_box(box: Column, size: Column, least_area: int = 1) -> Column:
    """Shares of ``size - 1`` if all coordinates lie in [0, 1], else pixels; small boxes are dropped."""
    share = (F.array_max(box) <= 1) & (F.array_min(box) >= 0)
    top = (size - 1).cast("int")
    v = [_clamped(box[i].cast("double") * F.when(share, (size - 1).cast("double")).otherwise(F.lit(1.0)), top) for i in range(4)]
    out = F.when(F.size(box) == 4, _ordered(*v))
    return F.when(area(out) >= least_area, out)


def area(box: Column) -> Column:
    return F.greatest(F.lit(0), box[2] - box[0]) * F.greatest(F.lit(0), box[3] - box[1])


def intersect(a: Column, b: Column) -> Column:
    x1, y1, x2, y2 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def shrink(box: Column, ratio: float) -> Column:
    """Take ``ratio`` (0.45 at most) of its extent off each side; unchanged if nothing would be left."""
    r = min(max(ratio, 0.0), 0.45)
    dx, dy = F.bround((box[2] - box[0]) * F.lit(r), 0).cast("int"), F.bround((box[3] - box[1]) * F.lit(r), 0).cast("int")
    small = F.array(box[0] + dx, box[1] + dy, box[2] - dx, box[3] - dy)
    return F.when((small[2] > small[0]) & (small[3] > small[1]), small).otherwise(box)


def normalize_points(points: Column, width: Column, height: Column) -> Column:
    """Pixels inside the image, the first of equal ones; shares of the image are scaled point by point."""

    def one(p: Column) -> Column:
        share = (p[0] <= 1.5) & (p[1] <= 1.5)
        x = _clamped(p[0].cast("double") * F.when(share, width).otherwise(F.lit(1)), (width - 1).cast("int"))
        y = _clamped(p[1].cast("double") * F.when(share, height).otherwise(F.lit(1)), (height - 1).cast("int"))
        return F.array(x, y)

    return F.array_distinct(F.transform(F.filter(points, lambda p: F.size(p) >= 2), one))


def oversized(box: Column, width: Column, height: Column, most: float) -> Column:
    return area(box) / (width * height) > most
