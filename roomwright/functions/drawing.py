"""Column functions for pictures: pixels, crops, colours, SVG elements."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_size(width: Column, height: Column, longest: int = 1024) -> Column:
    """struct(w, h) in pixels of a drawing, at least 4 each."""
    w, h = F.greatest(width, F.lit(1e-9)), F.greatest(height, F.lit(1e-9))
    scale = F.lit(float(longest)) / F.greatest(w, h)
    return F.struct(F.greatest(F.ceil(w * scale), F.lit(4)).cast("int").alias("w"), F.greatest(F.ceil(h * scale), F.lit(4)).cast("int").alias("h"))


def to_pixel(x: Column, y: Column, x0: Column, y0: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """struct(px, py): truncated, y downwards, kept inside the image."""
    px = ((x - x0) / width * (w - 1)).cast("int")
    py = (h - 1 - (y - y0) / height * (h - 1)).cast("int")
    return F.struct(F.greatest(F.lit(0), F.least(w - 1, px)).alias("px"), F.greatest(F.lit(0), F.least(h - 1, py)).alias("py"))


def from_pixel(px: Column, py: Column, x0: Column, y0: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    x = x0 + px / F.greatest(w - 1, F.lit(1)) * width
    y = y0 + (1.0 - py / F.greatest(h - 1, F.lit(1))) * height
    return F.struct(x.alias("x"), y.alias("y"))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, share: float = 0.25, least: float = 0.5) -> Column:
    """struct(x0, y0, x1, y1) of a room with a margin on each side."""
    px, py = F.greatest(F.lit(least), (x1 - x0) * share), F.greatest(F.lit(least), (y1 - y0) * share)
    return F.struct((x0 - px).alias("x0"), (y0 - py).alias("y0"), (x1 + px).alias("x1"), (y1 + py).alias("y1"))


def pastel(number: Column, count: Column) -> Column:
    """struct(r, g, b) from 0 to 1: hues spread evenly, lightness 0.72, saturation 0.55."""
    light, full = 0.72, 0.55
    high = light + full - light * full
    low = 2 * light - high
    hue = number / F.greatest(count, F.lit(1))

    def part(shift: float) -> Column:
        t = F.pmod(hue + shift, F.lit(1.0))
        return F.when(t < 1 / 6, low + (high - low) * 6 * t).when(t < 0.5, high).when(t < 2 / 3, low + (high - low) * 6 * (F.lit(2 / 3) - t)).otherwise(low)

    return F.struct(part(1 / 3).alias("r"), part(0.0).alias("g"), part(-1 / 3).alias("b"))


def escaped(text: Column) -> Column:
    out = text
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def svg_line(sx: Column, sy: Column, ex: Column, ey: Column, layer: Column) -> Column:
    return F.format_string('<line x1="%.4f" y1="%.4f" x2="%.4f" y2="%.4f" data-layer="%s"/>', sx, sy, ex, ey, escaped(layer))


def svg_text(x: Column, y: Column, text: Column, layer: Column) -> Column:
    return F.format_string('<text x="%.4f" y="%.4f" data-layer="%s" font-size="1" fill="#333333" stroke="none">%s</text>', x, y, escaped(layer), escaped(text))


def svg_ring(ring: Column, fill: Column, label: Column) -> Column:
    points = F.array_join(F.transform(ring, lambda p: F.format_string("%.4f,%.4f", p["x"], p["y"])), " ")
    return F.format_string('<polygon points="%s" fill="%s" fill-opacity="0.55"><title>%s</title></polygon>', points, fill, escaped(label))


def svg_arc(cx: Column, cy: Column, radius: Column, start: Column, end: Column) -> Column:
    """Path data of an arc; an end at or before the start lies one turn later. Turns are compared in degrees, so that no half
    circle counts as large."""
    a = F.radians(start)
    b = F.when(end <= start, F.radians(end) + 2 * math.pi).otherwise(F.radians(end))
    large = F.when(F.when(end <= start, end + 360).otherwise(end) - start > 180, 1).otherwise(0)
    return F.format_string("M %.4f %.4f A %.4f %.4f 0 %d 1 %.4f %.4f", cx + radius * F.cos(a), cy + radius * F.sin(a), radius, radius, large, cx + radius * F.cos(b), cy + radius * F.sin(b))


def hex_colour(rgb: Column) -> Column:
    return F.format_string("#%02x%02x%02x", *[F.floor(rgb[c] * 255 + 0.5) for c in "rgb"])
