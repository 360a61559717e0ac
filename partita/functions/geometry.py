"""Box geometry as columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from partita.functions.draws import hashed


class Box(NamedTuple):
    """Four columns: corners x1, y1, x2, y2, or centre and size cx, cy, w, h."""

    a: Column
    b: Column
    c: Column
    d: Column

    def named(self, *names: str) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, names)]


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return Box(*(F.col(prefix + n) for n in names))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def to_corners(b: Box, width: float | Column = 1.0, height: float | Column = 1.0) -> Box:
    """Centre and size in shares of the image to corner pixels."""
    cx, cy, w, h = b
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_centre(b: Box, width: float | Column = 1.0, height: float | Column = 1.0) -> Box:
    """Corner pixels to centre and size in shares of the image."""
    x1, y1, x2, y2 = b
    return Box((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)


def pixels_to_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, clip: bool = True, least: float | None = None) -> Box:
    """Left-top pixels and size to centre and size in shares.

    clip: first cut to the image, at least one pixel a side. Otherwise the shares are clamped, and `least` is the smallest side.
    """
    if clip:
        x, y = clamp(x, F.lit(0.0), width - 1), clamp(y, F.lit(0.0), height - 1)
        w, h = F.greatest(F.lit(1.0), F.least(w, width - x)), F.greatest(F.lit(1.0), F.least(h, height - y))
    cx, cy, sw, sh = (x + w / 2) / width, (y + h / 2) / height, w / width, h / height
    low = 0.0 if least is None else least
    return Box(clamp(cx, 0.0, 1.0), clamp(cy, 0.0, 1.0), clamp(sw, low, 1.0), clamp(sh, low, 1.0))


def whole_image(margin: float = 0.05) -> Box:
    """The box of an image that shows one symbol."""
    return Box(F.lit(0.5), F.lit(0.5), F.lit(1 - 2 * margin), F.lit(1 - 2 * margin))


def oriented_to_corners(points: Column) -> Box:
    """Eight numbers x, y, x, y, ... to the upright box around them; NULL in all four where there aren't eight."""
    ok = F.size(points) == 8
    xs, ys = F.filter(points, lambda p, i: i % 2 == 0), F.filter(points, lambda p, i: i % 2 == 1)
    return Box(*(F.when(ok, c) for c in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))))


def relative_to_crop(symbol: Box, crop: Box, least: float = 0.05) -> Box:
    """A symbol's box in shares of a crop (both corners): NULL for an empty symbol or crop, or a side under `least`."""
    cw, ch = crop.c - crop.a, crop.d - crop.b
    empty = (symbol.a == 0) & (symbol.b == 0) & (symbol.c == 0) & (symbol.d == 0)
    safe_w, safe_h = F.when(cw > 0, cw), F.when(ch > 0, ch)
    x1, y1 = clamp((symbol.a - crop.a) / safe_w, 0.0, 1.0), clamp((symbol.b - crop.b) / safe_h, 0.0, 1.0)
    x2, y2 = clamp((symbol.c - crop.a) / safe_w, 0.0, 1.0), clamp((symbol.d - crop.b) / safe_h, 0.0, 1.0)
    ok = ~empty & (cw > 0) & (ch > 0) & (x2 - x1 >= least) & (y2 - y1 >= least)
    return Box(*(F.when(ok, c) for c in ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)))


def area(b: Box) -> Column:
    return (b.c - b.a) * (b.d - b.b)


def intersection(p: Box, q: Box) -> Column:
    """The common area of two corner boxes, 0 if they don't meet."""
    w = F.greatest(F.lit(0.0), F.least(p.c, q.c) - F.greatest(p.a, q.a))
    h = F.greatest(F.lit(0.0), F.least(p.d, q.d) - F.greatest(p.b, q.b))
    return w * h


def iou(p: Box, q: Box, clamp_areas: bool = False) -> Column:
    """Intersection over union of corner boxes; 0 where the union isn't positive. clamp_areas: inverted boxes count as empty."""
    common = intersection(p, q)
    one, two = area(p), area(q)
    if clamp_areas:
        one = F.greatest(F.lit(0.0), p.c - p.a) * F.greatest(F.lit(0.0), p.d - p.b)
        two = F.greatest(F.lit(0.0), q.c - q.a) * F.greatest(F.lit(0.0), q.d - q.b)
    union = one + two - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def iou_centre(p: Box, q: Box) -> Column:
    return iou(to_corners(p), to_corners(q))


def aspect(w: Column, h: Column) -> Column:
    """w / h; infinite where h is 0 (Spark's ANSI mode would raise)."""
    return F.when(h == 0, F.lit(float("inf"))).otherwise(w / F.when(h != 0, h))


def normalised(b: Box, width: Column, height: Column) -> Box:
    return Box(clamp(b.a / width, 0.0, 1.0), clamp(b.b / height, 0.0, 1.0), clamp(b.c / width, 0.0, 1.0), clamp(b.d / height, 0.0, 1.0))


def widened_line(b: Box, thin: float = 0.01, target: float = 0.015) -> Box:
    """A line's box (centre form) narrower than `thin` gets `target` as its width; its centre stays inside the image."""
    w = F.when(b.c < thin, F.lit(target)).otherwise(b.c)
    return Box(F.when(b.c < thin, clamp(b.a, target / 2, 1 - target / 2)).otherwise(b.a), b.b, w, b.d)


def shrunk_oversize(b: Box, most: float = 0.1, target: float = 0.05) -> Box:
    """A box (centre form) of an area over `most` is brought to at most the area `target`; its centre is moved inside.

    Upright boxes (h / w over 5) keep their height and get a fifteenth of it as width, 0.01 at least; flat ones (under 0.2) the
    other way round; where that is still too large, and for all other shapes, both sides shrink evenly.
    """
    big, ratio = b.c * b.d > most, F.when(b.c > 0, b.d / F.when(b.c > 0, b.c)).otherwise(1.0)
    w = F.when(ratio > 5, F.greatest(F.least(b.c, b.d / 15), F.lit(0.01))).otherwise(b.c)
    h = F.when(ratio < 0.2, F.greatest(F.least(b.d, b.c / 15), F.lit(0.01))).otherwise(b.d)
    even = F.when(w * h > target, F.sqrt(F.lit(target) / F.when(w * h > 0, w * h))).otherwise(1.0)
    w, h = F.when(big, F.least(w * even, F.lit(1.0))).otherwise(b.c), F.when(big, F.least(h * even, F.lit(1.0))).otherwise(b.d)
    return Box(F.when(big, clamp(b.a, w / 2, 1 - w / 2)).otherwise(b.a), F.when(big, clamp(b.b, h / 2, 1 - h / 2)).otherwise(b.b), w, h)


def shrunk_to_size(b: Box, width: Column, height: Column, bias: Column, key: Column, seed: int = 42, jitter: float = 0.3) -> Box:
    """A box (centre form) replaced by a class's target size, each side jittered by up to `jitter` from a hash of `key`.

    bias 'top' or 'bottom' moves the centre a quarter of the old height; centres stay inside the image.
    """
    draw = lambda n: 1 + jitter * (hashed(key, F.lit(seed), F.lit(n)) % 20001 / 10000 - 1)
    w, h = width * draw(1), height * draw(2)
    cy = b.b + F.when(bias == "top", -0.25 * b.d).when(bias == "bottom", 0.25 * b.d).otherwise(0.0)
    return Box(clamp(b.a, w / 2, 1 - w / 2), clamp(cy, h / 2, 1 - h / 2), w, h)


def reference_size(b: Box, rule: Column, width: Column, height: Column) -> Box:
    """A class's reference size by rule: 'top' keeps the upper edge, 'center' the centre, any other rule the box; a NULL side stays."""
    on = F.coalesce(rule.isin("top", "center") & (width.isNotNull() | height.isNotNull()), F.lit(False))
    w, h = F.when(on, F.coalesce(width, b.c)).otherwise(b.c), F.when(on, F.coalesce(height, b.d)).otherwise(b.d)
    return Box(b.a, F.when(on & (rule == "top"), clamp(b.b - b.d / 2 + h / 2, h / 2, 1 - h / 2)).otherwise(b.b), w, h)


def top_fixed(b: Box, width: float, height: float) -> Box:
    """A box of fixed size at the old one's upper edge."""
    return Box(b.a, clamp(b.b - b.d / 2 + height / 2, height / 2, 1 - height / 2), F.lit(width), F.lit(height))


def box_text(b: Box) -> Column:
    return F.format_string("%.1f,%.1f,%.1f,%.1f", *b)


def bucket(x: Column, edges: list[float]) -> Column:
    """The number of the half-open bin of x, the last bin being closed; NULL outside."""
    out = F.when((x >= edges[-2]) & (x <= edges[-1]), F.lit(len(edges) - 2))
    for k in range(len(edges) - 2):
        out = out.when((x >= edges[k]) & (x < edges[k + 1]), F.lit(k))
    return out
