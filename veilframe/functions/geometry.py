"""Box and scalar expressions, Column to Column. Boxes are four columns x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", struct: Column | None = None) -> Box:
    """The four columns of a box, by prefix or out of a struct."""
    get = (lambda n: struct[n]) if struct is not None else (lambda n: F.col(prefix + n))
    return get("x1"), get("y1"), get("x2"), get("y2")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, _lit(low)), _lit(high))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def trunc0(x: Column) -> Column:
    """Toward zero, with negatives at 0, as a long."""
    return F.greatest(F.floor(x).cast("long"), F.lit(0).cast("long"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) * 0.5, (b[1] + b[3]) * 0.5


def holds_center(outer: Box, inner: Box, margin: float = 0.0) -> Column:
    """Whether inner's centre lies in outer, widened by a share of its sides."""
    cx, cy = center(inner)
    ex, ey = (outer[2] - outer[0]) * margin, (outer[3] - outer[1]) * margin
    return (cx >= outer[0] - ex) & (cx <= outer[2] + ex) & (cy >= outer[1] - ey) & (cy <= outer[3] + ey)


def letterbox(w: Column, h: Column, size: int) -> dict[str, Column]:
    """How an image of w x h fits a square: scale, new size and padding on the left and top."""
    scale = F.lit(float(size)) / F.greatest(w, h)
    nw, nh = F.round(w * scale).cast("int"), F.round(h * scale).cast("int")
    return {"scale": scale, "new_w": nw, "new_h": nh, "pad_x": F.floor((F.lit(size) - nw) / 2).cast("int"), "pad_y": F.floor((F.lit(size) - nh) / 2).cast("int")}


def unletterbox(b: Box, scale, pad_x, pad_y, w, h, flip: Column) -> Box:
    """A box of the square back in the image; mirrored if it was found in the mirrored image."""
    w, h = _lit(float(w)), _lit(float(h))
    x = [clamp((b[i] - pad_x) / scale, 0.0, w) for i in (0, 2)]
    y = [clamp((b[i] - pad_y) / scale, 0.0, h) for i in (1, 3)]
    mirrored = [clamp(w - 1.0 - v, 0.0, w) for v in (x[1], x[0])]
    return F.when(flip, mirrored[0]).otherwise(x[0]), y[0], F.when(flip, mirrored[1]).otherwise(x[1]), y[1]


def rect_span(b: Box, margin: float, w: int, h: int) -> tuple[Column, Column, Column, Column]:
    """Whole pixels [x1, x2) x [y1, y2) of a box widened by a margin; at least one pixel."""
    mw, mh = (b[2] - b[0]) * margin, (b[3] - b[1]) * margin
    x1, y1 = trunc0(b[0] - mw), trunc0(b[1] - mh)
    x2 = F.greatest(F.least(F.ceil(b[2] + mw).cast("long"), F.lit(w)), x1 + 1)
    y2 = F.greatest(F.least(F.ceil(b[3] + mh).cast("long"), F.lit(h)), y1 + 1)
    return x1, y1, x2, y2


def head_region(b: Box, w: int, h: int) -> Box:
    """The upper part of a standing figure: 8 % in from the sides, 5 % above to 30 % below the top."""
    bw, bh = b[2] - b[0], b[3] - b[1]
    return clamp(b[0] + bw * 0.08, 0.0, float(w)), clamp(b[1] - bh * 0.05, 0.0, float(h)), clamp(b[2] - bw * 0.08, 0.0, float(w)), clamp(b[1] + bh * 0.3, 0.0, float(h))


def face_margin(width: Column, eye_dist: Column, base: int) -> Column:
    """Horizontal margin of a face in pixels: wider when the eyes stand closer than in a front view."""
    bw = F.greatest(width, F.lit(1.0))
    short = clamp(bw * 0.35 - eye_dist, 0.0, bw * 0.35)
    return F.when(eye_dist.isNull(), F.lit(base).cast("long")).otherwise(F.lit(base) + F.floor(short * 0.6).cast("long"))


def face_span(b: Box, ex: Column, ey, w: int, h: int) -> tuple[Column, Column, Column, Column]:
    ey = _lit(ey)
    return (
        F.greatest(trunc0(b[0]) - ex, F.lit(0).cast("long")),
        F.greatest(trunc0(b[1]) - ey, F.lit(0).cast("long")),
        F.least(trunc0(b[2]) + 1 + ex, F.lit(w).cast("long")),
        F.least(trunc0(b[3]) + 1 + ey, F.lit(h).cast("long")),
    )


def crop_span(b: Box, w: int, h: int) -> tuple[Column, Column, Column, Column]:
    """x, y, width and height of a crop: columns begin and end on even pixels, two at least."""
    even = lambda c: (c - c % 2).cast("long")
    x1 = even(F.least(trunc0(b[0]), F.lit(max(w - 2, 0)).cast("long")))
    y1 = F.least(trunc0(b[1]), F.lit(max(h - 2, 0)).cast("long"))
    up = lambda c, most: F.least(F.greatest(F.ceil(c).cast("long"), F.lit(0).cast("long")), F.lit(most).cast("long"))
    x2 = even(F.greatest(up(b[2], w), x1 + 2))
    y2 = F.greatest(up(b[3], h), y1 + 2)
    return x1, y1, x2 - x1, y2 - y1


def near_edge(b: Box, w: int, h: int, margin: float = 12.0) -> Column:
    return (b[0] < margin) | (b[1] < margin) | (b[2] > w - margin) | (b[3] > h - margin)


def fade(lost: Column, max_lost: int) -> Column:
    """0 through the first half of the hold, then evenly to 1; no fade for holds under 4."""
    begin = max_lost // 2
    if max_lost < 4:
        return F.lit(0.0)
    return F.when(lost <= begin, F.lit(0.0)).otherwise(F.least((lost - begin) / F.lit(float(max_lost - begin)), F.lit(1.0)))


def fade_pixels(fade_: Column, bw: Column, bh: Column) -> Column:
    return F.ceil(fade_ * 0.5 * F.greatest(bw, bh)).cast("long")


def hold_pixels(vx: Column, vy: Column, lost: Column) -> Column:
    """By how much a held mask grows, from its speed and how long it is held."""
    return clamp(F.round((F.abs(vx) + F.abs(vy)) * 0.5 * (lost + 1)).cast("long"), F.lit(6).cast("long"), F.lit(24).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, within -1 and 1."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, clamp(dot(a, b) / n, -1.0, 1.0)).otherwise(F.lit(0.0))


def unit(a: Column, tiny: float = 1e-6) -> Column:
    """A vector over its length; zeros where the length is not over tiny."""
    return F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > tiny, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def bitrate(long_side: Column) -> Column:
    m = 1_000_000
    return F.when(long_side <= 1280, 3 * m).when(long_side <= 1920, 6 * m).when(long_side <= 2560, 10 * m).otherwise(20 * m)


def h_m_s(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss under an hour; 00:00 for negatives."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))
