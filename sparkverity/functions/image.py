"""Columns over image scores and pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = (0.55, 0.25, 0.20)


def fuse(cnn: Column, ela: Column, phash: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted sum; a missing score counts as 0.5."""
    a, b, c = (F.coalesce(x, F.lit(0.5)) * F.lit(w) for x, w in zip((cnn, ela, phash), weights, strict=True))
    return a + b + c


def fuse_renormalised(cnn: Column, ela: Column, phash: Column) -> Column:
    """Without a hash score the other two carry all the weight."""
    return F.when(phash.isNull(), (F.lit(0.55) * cnn + F.lit(0.25) * ela) / F.lit(0.80)).otherwise(
        F.lit(0.55) * cnn + F.lit(0.25) * ela + F.lit(0.20) * phash
    )


def window_level(px: Column, centre: float, width: float) -> Column:
    low, high = centre - width / 2, centre + width / 2
    return F.transform(px, lambda x: ((F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double"))) - low) / (high - low) * 255.0).cast("int"))


def rescale(px: Column) -> Column:
    """Linear to 0..255; all zeros for a flat image."""
    low, high = F.array_min(px), F.array_max(px)
    return F.when(high > low, F.transform(px, lambda x: ((x - low) * 255.0 / (high - low)).cast("int"))).otherwise(F.transform(px, lambda x: F.lit(0)))


def slope_intercept(px: Column, slope: float, intercept: float) -> Column:
    return F.transform(px, lambda x: x * slope + intercept)


def recompression_difference(a: Column, b: Column, scale: int = 10, *, wrap: bool = True) -> Column:
    """Scaled difference of two 8-bit images; wrapping in 8 bits, or the true one cut at 255."""

    def one(x: Column, y: Column) -> Column:
        if wrap:
            return F.pmod(F.pmod(x - y, F.lit(256)) * scale, F.lit(256))
        return F.least(F.abs(x - y) * scale, F.lit(255))

    return F.zip_with(a, b, one)


def difference_score(px: Column, area: Column | None = None) -> Column:
    mean = F.aggregate(px, F.lit(0.0), lambda s, x: s + x) / F.size(px) / 255.0
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))
    return mean if area is None else F.lit(0.7) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / 15.0)) + F.lit(0.3) * mean


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b) + 1e-8)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
