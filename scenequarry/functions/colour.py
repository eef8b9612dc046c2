"""Colour expressions on 0..255 channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def scaled(c: Column) -> Column:
    """c / 255 - 0.5."""
    return c / 255.0 - 0.5


def standardised(c: Column, mean: float, std: float) -> Column:
    return (c / 255.0 - mean) / std


def rgb_to_hsv(rows: DataFrame, rgb: tuple[str, str, str] = RGB) -> DataFrame:
    """Add h, s (0..1) and v (0..255)."""
    r, g, b = map(F.col, rgb)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    h = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    return rows.withColumns({"h": F.pmod(h / 6.0, F.lit(1.0)), "s": F.when(top > 0, span / top).otherwise(0.0), "v": top.cast("double")})


def hsv_to_rgb(rows: DataFrame, hsv: tuple[str, str, str] = ("h", "s", "v"), rgb: tuple[str, str, str] = RGB) -> DataFrame:
    h, s, v = map(F.col, hsv)
    i = F.floor(h * 6.0)
    f = h * 6.0 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))
    pick = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    return rows.withColumns(dict(zip(rgb, (pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)))))


def segment_colour(segment: Column) -> tuple[Column, Column, Column]:
    """A colour for a segment id; the three moduli are fixed values."""
    return tuple((segment * 217 % m) % 256 for m in (256, 311, 541))


def contrast(rows: DataFrame, blend: float, by: str = "scene_id", rgb: tuple[str, str, str] = RGB) -> DataFrame:
    """Blend each channel with its stretch over the scene's range."""
    edge = rows.groupBy(by).agg(*(f(c).alias(f"_{n}{c}") for c in rgb for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.join(edge, by)
    for c in rgb:
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        full = F.when(hi > lo, (F.col(c) - lo) * 255.0 / (hi - lo)).otherwise(F.col(c))
        out = out.withColumn(c, (1 - blend) * F.col(c) + blend * full)
    return out.drop(*(f"_{n}{c}" for c in rgb for n in ("lo", "hi")))
