"""Expressions on single pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of luma, of sRGB to Y, the white point's curve, and the ramp of the confidence.
LUMA = (0.299, 0.587, 0.114)
LUMINANCE = (0.212671, 0.715160, 0.072169)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey of 8-bit RGB, rounded."""
    return F.floor(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 0.5).cast("int")


def _linear(u: Column) -> Column:
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def lightness(r: Column, g: Column, b: Column) -> Column:
    """L of Lab in 8-bit encoding (0..255). Only L is ever used, so a and b aren't computed."""
    y = sum(w * _linear(c / 255.0) for w, c in zip(LUMINANCE, (r, g, b), strict=True))
    f = F.when(y > 0.008856, F.cbrt(y) * 116 - 16).otherwise(y * 903.3)
    return f * 2.55


def narrow(v: Column) -> Column:
    """16 to 8 bits by the high byte."""
    return F.shiftright(v.cast("int"), 8)


def narrow_scaled(v: Column) -> Column:
    """16 to 8 bits by division, for previews."""
    return F.floor(v / 257).cast("int")


def clipped(v: Column, most: int) -> Column:
    """Into 0..most, fractions cut off."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))).cast("int")


def confidence(energy: Column) -> Column:
    """0 where a pixel has no energy at all, 1 from 1e-8 on; a ramp over its logarithm between."""
    return F.least(F.greatest((F.log10(energy + 1e-40) + 20) / 12, F.lit(0.0)), F.lit(1.0))
