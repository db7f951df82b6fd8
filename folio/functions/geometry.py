"""Bounding-box arithmetic as Column functions; boxes are column-name prefixes of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def intersection(p: str, q: str) -> Column:
    """Common area of two boxes; 0 if they only touch or are apart."""
    w = F.least(F.col(f"{p}x2"), F.col(f"{q}x2")) - F.greatest(F.col(f"{p}x1"), F.col(f"{q}x1"))
    h = F.least(F.col(f"{p}y2"), F.col(f"{q}y2")) - F.greatest(F.col(f"{p}y1"), F.col(f"{q}y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(p: str, q: str) -> Column:
    both = intersection(p, q)
    return both / (area(p) + area(q) - both)


def anchors(p: str = "") -> dict[str, Column]:
    """The nine anchor points of a box, as x and y by name."""
    x = {"left": F.col(f"{p}x1"), "center": (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2, "right": F.col(f"{p}x2")}
    y = {"top": F.col(f"{p}y1"), "middle": (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2, "bottom": F.col(f"{p}y2")}
    return {f"{v}_{h}_{axis}": c for v, b in y.items() for h, a in x.items() for axis, c in (("x", a), ("y", b))}


def expand(pix: float, width: float, height: float) -> dict[str, Column]:
    """A box grown by pix on each side, within (0, 0, width, height)."""
    low = lambda c: F.greatest(F.col(c) - pix, F.lit(0.0))
    return {"x1": low("x1"), "y1": low("y1"), "x2": F.least(F.col("x2") + pix, F.lit(float(width))), "y2": F.least(F.col("y2") + pix, F.lit(float(height)))}


def shrink(pix: int) -> dict[str, Column]:
    """A box less pix on each side, which leaves a pixel at least; what x allows bounds y as well."""
    room = lambda a, b: F.floor((F.col(b) - F.col(a) - 1) / 2)
    in_x = F.greatest(F.lit(0), F.least(F.lit(pix), room("x1", "x2")))
    in_y = F.greatest(F.lit(0), F.least(in_x, room("y1", "y2")))
    return {"x1": F.col("x1") + in_x, "y1": F.col("y1") + in_y, "x2": F.col("x2") - in_x, "y2": F.col("y2") - in_y}


def rotated(box: Column, quarter: Column, width: float, height: float) -> Column:
    """A struct of x1, y1, x2 and y2 after `quarter` turns (0 to 3) of its page of width and height."""
    x1, y1, x2, y2 = (box[c] for c in ("x1", "y1", "x2", "y2"))
    turned = {1: (y1, height - x2, y2, height - x1), 2: (width - x2, height - y2, width - x1, height - y1), 3: (width - y2, x1, width - y1, x2)}
    pick = lambda k, same: F.when(quarter == 1, turned[1][k]).when(quarter == 2, turned[2][k]).when(quarter == 3, turned[3][k]).otherwise(same)
    return F.struct(*[pick(k, same).alias(name) for k, (name, same) in enumerate((("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))])


def rotate_all(boxes: Column, quarter: Column, width: float, height: float) -> Column:
    """Each box of an array (a table's or text's boxes) turned; null boxes stay."""
    return F.transform(boxes, lambda b: F.when(b.isNotNull(), rotated(b, quarter, width, height)))


def rotate(quarter: Column, width: float, height: float) -> dict[str, Column]:
    """The columns of a box after `quarter` turns (0 to 3) of its page of width and height."""
    out = rotated(F.struct("x1", "y1", "x2", "y2"), quarter, width, height)
    return {c: out[c] for c in ("x1", "y1", "x2", "y2")}


def axis_iou(p: str, q: str, axis: str) -> Column:
    """Common length over the whole extent on one axis; 0 if apart."""
    a1, a2, b1, b2 = (F.col(f"{s}{axis}{k}") for s in (p, q) for k in (1, 2))
    both = F.least(a2, b2) - F.greatest(a1, b1)
    return F.when(both > 0, both / (F.greatest(a2, b2) - F.least(a1, b1))).otherwise(F.lit(0.0))


CORNERS = ("x1", "y1", "x2", "y2")


def scaled(x: float | Column, y: float | Column, p: str = "") -> dict[str, Column]:
    """A box times x and y. Divide by passing reciprocals of exact powers, else divide the columns."""
    return {c: F.col(f"{p}{c}") * (x if c[0] == "x" else y) for c in CORNERS}


def shifted(x: float | Column, y: float | Column, p: str = "") -> dict[str, Column]:
    return {c: F.col(f"{p}{c}") + (x if c[0] == "x" else y) for c in CORNERS}


def whole(how: str, p: str = "") -> dict[str, Column]:
    """Corners as whole numbers: round (half to even), int (towards zero), ceil or floor."""
    ways = {"round": F.bround, "int": lambda c: c, "ceil": F.ceil, "floor": F.floor}
    return {c: ways[how](F.col(f"{p}{c}")).cast("long") for c in CORNERS}


def distance(ax: Column, ay: Column, bx: Column, by: Column, method: str = "euclidean") -> Column:
    """Between two points, euclidean or manhattan."""
    if method == "manhattan":
        return F.abs(ax - bx) + F.abs(ay - by)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap_length(p: str, q: str, axis: str) -> Column:
    """Common length on an axis; below 0 where the boxes are apart."""
    return F.least(F.col(f"{p}{axis}2"), F.col(f"{q}{axis}2")) - F.greatest(F.col(f"{p}{axis}1"), F.col(f"{q}{axis}1"))


def guarded_iou(p: str, q: str) -> Column:
    """IoU of boxes that may be empty: the union counts as 1e-6 at least."""
    both = intersection(p, q)
    return both / F.greatest(area(p) + area(q) - both, F.lit(1e-6))


def guarded_iof(p: str, q: str) -> Column:
    """The part of box q that lies in box p; q's area counts as 1e-6 at least."""
    return intersection(p, q) / F.greatest(area(q), F.lit(1e-6))


def soft_iou(p: str, q: str, axis: str) -> Column:
    """Common length on an axis over the whole extent plus 1e-5; below 0 across a gap."""
    extent = F.greatest(F.col(f"{p}{axis}2"), F.col(f"{q}{axis}2")) - F.least(F.col(f"{p}{axis}1"), F.col(f"{q}{axis}1"))
    return overlap_length(p, q, axis) / (extent + F.lit(1e-5))


def is_relative(width: Column, height: Column) -> Column:
    """Whether a box is in parts of its page: its far corner is within the page, give or take a pixel."""
    most = 1 + 1 / F.least(width, height)
    return F.col("x2").between(F.lit(0.0), most) & F.col("y2").between(F.lit(0.0), most)


def relative(width: Column, height: Column) -> dict[str, Column]:
    """The box in parts of its page, whatever it is in."""
    own = is_relative(width, height)
    return {c: F.when(own, F.col(c)).otherwise(F.col(c) / (width if c[0] == "x" else height)) for c in CORNERS}


def absolute(width: Column, height: Column) -> dict[str, Column]:
    """The box in pixels of its page, whatever it is in."""
    own = is_relative(width, height)
    return {c: F.when(own, F.col(c) * (width if c[0] == "x" else height)).otherwise(F.col(c)) for c in CORNERS}


def crop_box(width: float, height: float, zoom: float = 1.0) -> dict[str, Column]:
    """Pixels of a relative box on a page image, towards zero. The caller leaves out boxes without a pixel."""
    return {c: (F.col(c) * (width if c[0] == "x" else height) * zoom).cast("int") for c in CORNERS}


def sub_box(p: str, q: str, x: Column, y: Column) -> dict[str, Column]:
    """Box q as seen from box p's corner, scaled by x and y, rounded up."""
    return {c: F.ceil((F.col(f"{q}{c}") - F.col(f"{p}{c[0]}1")) * (x if c[0] == "x" else y)) for c in CORNERS}


def clamped(width: float, height: float) -> dict[str, Column]:
    """A box moved into an image of width and height; a pixel wide and high at least."""
    out: dict[str, Column] = {}
    for axis, size in (("x", width), ("y", height)):
        low = F.greatest(F.lit(0.0), F.least(F.col(f"{axis}1"), F.lit(float(size - 1))))
        out[f"{axis}1"] = low.cast("int")
        out[f"{axis}2"] = F.greatest(low + 1, F.least(F.col(f"{axis}2"), F.lit(float(size)))).cast("int")
    return out
