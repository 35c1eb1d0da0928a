"""Box arithmetic as columns. A box is ARRAY<numeric> [x1, y1, x2, y2]; rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the integer scale of normalised coordinates.
NORM_MAX = 1000


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(lo), F.least(as_col(hi), v))


def _corner(box: Column, i: int) -> Column:
    return F.element_at(box, i + 1)


def _positive(w: Column, h: Column, value: Column, what: str) -> Column:
    """value, or an error where a page has no extent."""
    return F.when((w > 0) & (h > 0), value).otherwise(F.raise_error(F.format_string(f"{what}: non-positive dims w=%s h=%s", w.cast("string"), h.cast("string"))))


def pixel_to_norm(box: Column, w: Column, h: Column) -> Column:
    """Page pixels to the 0..1000 grid, clamped; a null box gives null, a page without extent is an error."""
    axis = (w, h, w, h)
    got = F.array(*(F.rint(clamp(_corner(box, i).cast("double") / axis[i] * NORM_MAX, 0.0, float(NORM_MAX))).cast("int") for i in range(4)))
    return F.when(box.isNotNull(), _positive(w, h, got, "pixel_to_norm"))


def norm_to_pixel(box: Column, w: Column, h: Column) -> Column:
    """The 0..1000 grid to page pixels, clamped to the page."""
    axis = (w, h, w, h)
    got = F.array(*(F.rint(clamp(_corner(box, i).cast("double") / NORM_MAX * axis[i], 0.0, axis[i].cast("double"))).cast("int") for i in range(4)))
    return F.when(box.isNotNull(), _positive(w, h, got, "norm_to_pixel"))


#: Form boxes arrive on the 0..1000 grid.
form_box_to_pixel = norm_to_pixel


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; corners may come in any order; no common area gives 0."""

    def span(box: Column, lo: int, hi: int) -> tuple[Column, Column]:
        p, q = _corner(box, lo).cast("double"), _corner(box, hi).cast("double")
        return F.least(p, q), F.greatest(p, q)

    (ax1, ax2), (ay1, ay2), (bx1, bx2), (by1, by2) = span(a, 0, 2), span(a, 1, 3), span(b, 0, 2), span(b, 1, 3)
    wide, high = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    shared = wide * high
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - shared
    return F.when(a.isNotNull() & b.isNotNull(), F.when((wide <= 0) | (high <= 0) | (union <= 0), F.lit(0.0)).otherwise(shared / union))


def quad_to_bbox(quad: Column) -> Column:
    """Points [[x, y], ...] (any number) to their upright bounding box."""
    xs, ys = F.transform(quad, lambda p: F.element_at(p, 1)), F.transform(quad, lambda p: F.element_at(p, 2))
    return F.array(*(F.rint(v.cast("double")).cast("int") for v in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))))


def has_area(box: Column) -> Column:
    return (_corner(box, 2) > _corner(box, 0)) & (_corner(box, 3) > _corner(box, 1))


def clamp_box(box: Column, w: Column, h: Column) -> Column:
    """Rounded first, then clamped to the page."""
    axis = (w, h, w, h)
    return F.array(*(clamp(F.rint(_corner(box, i).cast("double")).cast("int"), F.lit(0), axis[i].cast("int")) for i in range(4)))


def box_width(box: Column) -> Column:
    return _corner(box, 2) - _corner(box, 0)


def box_height(box: Column) -> Column:
    return _corner(box, 3) - _corner(box, 1)


def overlap(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch do not overlap."""
    return (_corner(a, 2) > _corner(b, 0)) & (_corner(b, 2) > _corner(a, 0)) & (_corner(a, 3) > _corner(b, 1)) & (_corner(b, 3) > _corner(a, 1))
