"""Rectangles, matrices, rotations and page boxes as column expressions.

A rectangle is struct<x0,y0,x1,y1>, a matrix struct<a,b,c,d,e,f> (row vectors:
x' = a x + c y + e, y' = b x + d y + f), a point struct<x,y>, all doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Page sizes in points.
SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0),
         "legal": (612.0, 1008.0), "tabloid": (792.0, 1224.0), "ledger": (792.0, 1224.0)}
ANCHORS = ("top-left", "top-center", "top-right", "center-left", "center", "center-right", "bottom-left", "bottom-center", "bottom-right")


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in fields.items()])


def point(x, y) -> Column:
    return _struct(x=x, y=y)


def rect(x0, y0, x1, y1) -> Column:
    """A rectangle with its corners in order."""
    return _struct(x0=F.least(x0, x1), y0=F.least(y0, y1), x1=F.greatest(x0, x1), y1=F.greatest(y0, y1))


def from_xywh(x, y, w, h) -> Column:
    return rect(x, y, x + w, y + h)


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def center(r: Column) -> Column:
    return point((r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2)


def translate(r: Column, dx, dy) -> Column:
    return _struct(x0=r["x0"] + dx, y0=r["y0"] + dy, x1=r["x1"] + dx, y1=r["y1"] + dy)


def grow(r: Column, d) -> Column:
    return _struct(x0=r["x0"] - d, y0=r["y0"] - d, x1=r["x1"] + d, y1=r["y1"] + d)


def union(a: Column, b: Column) -> Column:
    return _struct(x0=F.least(a["x0"], b["x0"]), y0=F.least(a["y0"], b["y0"]), x1=F.greatest(a["x1"], b["x1"]), y1=F.greatest(a["y1"], b["y1"]))


def bounds(r: Column) -> Column:
    """Aggregate: the bounding box of a group's rectangles."""
    return F.struct(F.min(r["x0"]).alias("x0"), F.min(r["y0"]).alias("y0"), F.max(r["x1"]).alias("x1"), F.max(r["y1"]).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    """Open overlap: touching edges do not count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle; null where there is none."""
    common = _struct(x0=F.greatest(a["x0"], b["x0"]), y0=F.greatest(a["y0"], b["y0"]), x1=F.least(a["x1"], b["x1"]), y1=F.least(a["y1"], b["y1"]))
    return F.when(intersects(a, b), common)


def contains(a: Column, b: Column) -> Column:
    return (b["x0"] >= a["x0"]) & (b["y0"] >= a["y0"]) & (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"])


def contains_point(r: Column, p: Column) -> Column:
    return p["x"].between(r["x0"], r["x1"]) & p["y"].between(r["y0"], r["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def hits(glyph: Column, area: Column) -> Column:
    """Whether a glyph box belongs to an area: its centre does, or a quarter of it."""
    whole = width(glyph) * height(glyph)
    return contains_point(area, center(glyph)) | ((whole > 0) & (overlap_area(glyph, area) >= 0.25 * whole))


def flip(r: Column, page_height) -> Column:
    """Between y upwards and y downwards."""
    return _struct(x0=r["x0"], y0=page_height - r["y1"], x1=r["x1"], y1=page_height - r["y0"])


def matrix(a, b, c, d, e, f) -> Column:
    return _struct(a=a, b=b, c=c, d=d, e=e, f=f)


def scaling(sx, sy) -> Column:
    return matrix(sx, 0, 0, sy, 0, 0)


def rotation(degrees: Column) -> Column:
    turn = F.radians(degrees)
    return matrix(F.cos(turn), F.sin(turn), -F.sin(turn), F.cos(turn), 0, 0)


def then(m: Column, n: Column) -> Column:
    """First ``m``, then ``n``."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"])


def invert(m: Column) -> Column:
    """The inverse; null where the determinant is below 1e-12."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    safe = F.when(F.abs(det) < 1e-12, None).otherwise(det)
    full = matrix(
        m["d"] / safe, -m["b"] / safe, -m["c"] / safe, m["a"] / safe,
        (m["c"] * m["f"] - m["d"] * m["e"]) / safe, (m["b"] * m["e"] - m["a"] * m["f"]) / safe)
    return F.when(safe.isNotNull(), full)


def linear(m: Column) -> Column:
    return matrix(m["a"], m["b"], m["c"], m["d"], 0, 0)


def apply(m: Column, p: Column) -> Column:
    return point(m["a"] * p["x"] + m["c"] * p["y"] + m["e"], m["b"] * p["x"] + m["d"] * p["y"] + m["f"])


def transform(r: Column, m: Column) -> Column:
    """Bounding box of the transformed corners."""
    xs = [m["a"] * r[x] + m["c"] * r[y] + m["e"] for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [m["b"] * r[x] + m["d"] * r[y] + m["f"] for x in ("x0", "x1") for y in ("y0", "y1")]
    return _struct(x0=F.least(*xs), y0=F.least(*ys), x1=F.greatest(*xs), y1=F.greatest(*ys))


def quarter_turn(degrees: Column) -> Column:
    """Clockwise quarter turns, 0 to 3, nearest to an angle."""
    return F.pmod(F.round(degrees / 90.0).cast("int"), F.lit(4))


def turned(rotation_degrees: Column, by) -> Column:
    """A page rotation (0, 90, 180, 270) after another turn."""
    return F.pmod(rotation_degrees + by, F.lit(360)).cast("int")


def swaps_axes(rotation_degrees: Column) -> Column:
    return F.pmod(rotation_degrees, F.lit(180)) == 90


def display_width(box: Column, rotation_degrees: Column) -> Column:
    return F.when(swaps_axes(rotation_degrees), height(box)).otherwise(width(box))


def display_height(box: Column, rotation_degrees: Column) -> Column:
    return F.when(swaps_axes(rotation_degrees), width(box)).otherwise(height(box))


def user_to_display(box: Column, rotation_degrees: Column) -> Column:
    """Matrix from file coordinates to the page as shown, origin at its lower left."""
    r = F.pmod(rotation_degrees, F.lit(360))
    return (
        F.when(r == 90, matrix(0, -1, 1, 0, -box["y0"], box["x1"]))
        .when(r == 180, matrix(-1, 0, 0, -1, box["x1"], box["y1"]))
        .when(r == 270, matrix(0, 1, -1, 0, box["y1"], -box["x0"]))
        .otherwise(matrix(1, 0, 0, 1, -box["x0"], -box["y0"])))


def display_to_user(box: Column, rotation_degrees: Column) -> Column:
    return invert(user_to_display(box, rotation_degrees))


def page_size(name: str) -> tuple[float, float]:
    """(width, height) of a named size, ``-landscape`` for the wide way."""
    base, wide = name.strip().lower(), False
    if base.endswith("-landscape"):
        base, wide = base[: -len("-landscape")], True
    if base not in SIZES:
        raise ValueError(f"unknown page size {name!r}")
    w, h = SIZES[base]
    return (max(w, h), min(w, h)) if wide else (w, h)


def place(anchor: str, area_w, area_h, w, h, margin) -> Column:
    """Lower left corner of a w by h box at one of nine anchors of an area."""
    if anchor not in ANCHORS:
        raise ValueError(f"unknown anchor {anchor!r}")
    rows, _, column = anchor.partition("-")
    column = column or "center"
    x = {"left": margin, "center": (area_w - w) / 2, "right": area_w - w - margin}[column]
    y = {"top": area_h - h - margin, "center": (area_h - h) / 2, "bottom": margin}[rows]
    return point(x, y)


def fit(box: Column, rotation_degrees: Column, target_w: float, target_h: float, mode: str = "fit") -> Column:
    """Matrix that scales a page box to a target size and centres it: fit, fill or stretch."""
    tw = F.when(swaps_axes(rotation_degrees), target_h).otherwise(target_w)
    th = F.when(swaps_axes(rotation_degrees), target_w).otherwise(target_h)
    sw, sh = F.greatest(width(box), F.lit(1.0)), F.greatest(height(box), F.lit(1.0))
    rx, ry = tw / sw, th / sh
    pick = {"fit": F.least, "fill": F.greatest}.get(mode)
    if pick is None and mode != "stretch":
        raise ValueError(f"unknown fit mode {mode!r}")
    sx, sy = (pick(rx, ry), pick(rx, ry)) if pick else (rx, ry)
    return matrix(sx, 0, 0, sy, (tw - sw * sx) / 2 - box["x0"] * sx, (th - sh * sy) / 2 - box["y0"] * sy)


def crop(area: Column, media: Column) -> Column:
    """The crop box of an area: its part inside the media box; an error if there is none."""
    return F.coalesce(intersection(area, media), F.raise_error(F.lit("crop area is outside the page")).cast("struct<x0:double,y0:double,x1:double,y1:double>"))


# Permission bits (counted from 1) of the standard security handler.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high": 12}
ALWAYS = ~0xFFF | 0xC0  # reserved bits that are set


def permission_bits(**flags) -> Column:
    """The permission integer of flag columns or booleans; missing flags are refused."""
    value = F.lit(ALWAYS & 0xFFFFFFFF)
    for name, allowed in flags.items():
        allowed = allowed if isinstance(allowed, Column) else F.lit(bool(allowed))
        value = value + F.when(allowed, 1 << (PERMISSIONS[name] - 1)).otherwise(0)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def permission(bits: Column, name: str) -> Column:
    return F.getbit(bits, F.lit(PERMISSIONS[name] - 1)) == 1
