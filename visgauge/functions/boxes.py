"""Boxes as arrays of four doubles, x y w h or corners x1 y1 x2 y2, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(xywh: Column) -> Column:
    """x y w h as corners; an error for a negative width or height."""
    box = F.array(xywh[0], xywh[1], xywh[0] + xywh[2], xywh[1] + xywh[3])
    return F.when((xywh[2] < 0) | (xywh[3] < 0), F.raise_error(F.lit("a box has a negative size"))).otherwise(box)


def sides(box: Column) -> Column:
    """Corners as x y w h; null where the box has no area."""
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.array(box[0], box[1], box[2] - box[0], box[3] - box[1]))


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes by corners, 0 where the union is empty."""
    common = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def size_name(pixels: Column) -> Column:
    """small below 32 x 32 pixels, medium below 96 x 96, else large."""
    return F.when(pixels < 32.0**2, "small").when(pixels < 96.0**2, "medium").otherwise("large")


def normalized(xywh: Column, width: Column, height: Column) -> Column:
    """Pixel x y w h as corners between 0 and 1; null for a size or a box without extent."""
    x1, x2 = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v, width))) for v in (xywh[0], xywh[0] + xywh[2]))
    y1, y2 = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v, height))) for v in (xywh[1], xywh[1] + xywh[3]))
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def centre(box: Column) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def direction(dx: Column, dy: Column, ties_horizontal: bool = True) -> Column:
    """Where the first of two centres lies, from the second: dx and dy are second minus first."""
    flat = F.abs(dx) >= F.abs(dy) if ties_horizontal else F.abs(dx) > F.abs(dy)
    return F.when(flat, F.when(dx > 0, "to the left of").otherwise("to the right of")).otherwise(F.when(dy > 0, "above").otherwise("below"))


def crop_around(box: Column, width: Column, height: Column, padding: float, least: int) -> Column:
    """A square around a box, padded and of a least side, moved into the image; whole pixels."""
    side = F.least(F.greatest(F.greatest(box[2] - box[0], box[3] - box[1]) * (1 + 2 * padding), F.lit(float(least))), F.least(width, height).cast("double"))
    cx, cy = centre(box)
    x = F.greatest(F.lit(0.0), F.least(cx - side / 2, width - side))
    y = F.greatest(F.lit(0.0), F.least(cy - side / 2, height - side))
    return F.transform(F.array(x, y, x + side, y + side), lambda v: F.bround(v).cast("int"))
