"""Boxes, polygons (arrays of [x, y]) and affine maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def iou(a, b) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / (area(a) + area(b) - both + 1e-9)


def turned(p: Column) -> Column:
    """The points, begun with the second."""
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def area(p: Column) -> Column:
    return F.abs(total(F.zip_with(p, turned(p), lambda a, b: a[0] * b[1] - b[0] * a[1]))) / 2


def bbox(polygons: Column) -> Column:
    """[x0, y0, x1, y1] of all points, cut to whole numbers."""
    points = F.flatten(polygons)
    x, y = F.transform(points, lambda q: q[0]), F.transform(points, lambda q: q[1])
    return F.transform(F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)), lambda v: v.cast("int"))


def centre(polygons: Column) -> Column:
    points = F.flatten(polygons)
    x, y = F.transform(points, lambda q: q[0]), F.transform(points, lambda q: q[1])
    return F.array((F.array_min(x) + F.array_max(x)) / 2, (F.array_min(y) + F.array_max(y)) / 2)


def contains(p: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does a ray to the right cross an odd number of edges?"""
    crosses = lambda a, b: ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / F.when(b[1] == a[1], 1.0).otherwise(b[1] - a[1]) + a[0])
    return F.size(F.filter(F.zip_with(p, turned(p), crosses), lambda c: c)) % 2 == 1


def to_unit(p: Column, width: Column, height: Column) -> Column:
    """Pixels to [0, 1], clamped."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.transform(p, lambda q: F.array(clamp(q[0] / width), clamp(q[1] / height)))


def proper(polygons: Column) -> Column:
    """Polygons of three points or more with some area."""
    return F.filter(polygons, lambda p: (F.size(p) >= 3) & (area(p) > 1e-8))


def main_parts(polygons: Column, fraction: float) -> Column:
    """Polygons of at least that fraction of the largest area."""
    largest = F.array_max(F.transform(polygons, area))
    return F.filter(polygons, lambda p: area(p) >= fraction * largest)


def affine(m: Column, q: Column) -> Column:
    """[x, y] under a matrix of two rows and three columns."""
    row = lambda r: m[r][0] * q[0] + m[r][1] * q[1] + m[r][2]
    return F.array(row(0), row(1))


def contained(width: Column, height: Column, box_width: Column, box_height: Column) -> tuple[Column, Column, Column]:
    """scale, left, top of an image that is fitted whole into a box, centred."""
    scale = F.least(box_width / width, box_height / height)
    return scale, (box_width - width * scale) / 2, (box_height - height * scale) / 2


def rotated_extent(width: Column, height: Column, degrees: Column) -> Column:
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.array(width * c + height * s, width * s + height * c)


def window_in(centre_: Column, size: Column, limit: Column) -> Column:
    """Start of a window of that size around a centre, kept inside [0, limit]."""
    return F.greatest(F.lit(0.0), F.least(centre_ - size / 2, limit - size))


def principal_axis(x: Column, y: Column, key: str) -> dict[str, Column]:
    """Aggregates of points: the angle, in degrees, of the larger axis of their covariance (closed form in two dimensions)."""
    sxx, syy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return {"angle": F.degrees(F.atan2(2 * sxy, sxx - syy)) / 2, "major": (sxx + syy) / 2 + F.sqrt(F.pow((sxx - syy) / 2, F.lit(2)) + sxy * sxy)}
