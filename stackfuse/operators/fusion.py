"""Laplacian pyramids and their energy-weighted fusion, over relations of pixels."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..session import kept
from . import spatial as S


def level_count(height: int, width: int, most: int = 6) -> int:
    """How often the smaller side can be halved while it is over 16."""
    side, levels = min(height, width), 0
    while side > 16 and levels < most:
        side, levels = side // 2, levels + 1
    return levels


def sizes(height: int, width: int, levels: int) -> list[tuple[int, int]]:
    out = [(height, width)]
    for _ in range(levels):
        out.append(((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2))
    return out


def pyramid(df: DataFrame, keys: Sequence[str], height: int, width: int, levels: int) -> list[DataFrame]:
    """The bands, fine to coarse, and last the rest. Each is (keys, y, x, v)."""
    out, now, size = [], df.select(*keys, "y", "x", "v"), sizes(height, width, levels)
    for k in range(levels):
        low = S.reduced(now, keys)
        guess = S.expanded(low, keys, *size[k]).withColumnRenamed("v", "g")
        out.append(now.join(guess, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("v") - F.col("g")).alias("v")))
        now = low
    return [*out, now]


def collapsed(bands: list[DataFrame], keys: Sequence[str], height: int, width: int) -> DataFrame:
    """The image of a pyramid."""
    size = sizes(height, width, len(bands) - 1)
    now = bands[-1]
    for k in reversed(range(len(bands) - 1)):
        up = S.expanded(now, keys, *size[k]).withColumnRenamed("v", "g")
        now = bands[k].join(up, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("v") + F.col("g")).alias("v"))
    return now


def stacked(bands: list[DataFrame]) -> DataFrame:
    """All levels as one relation with a level column."""
    return functools.reduce(DataFrame.unionByName, (b.withColumn("level", F.lit(k)) for k, b in enumerate(bands)))


def region_energy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean of squares over 3 x 3 pixels, as `e`."""
    return _with_energy(df, keys).select(*keys, "y", "x", "e")


def _with_energy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return S.box(df.withColumn("e", F.col("v") * F.col("v")), keys, 3, "e")


def region_deviation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The standard deviation over 3 x 3 pixels, as `d`."""
    return _with_deviation(df, keys).select(*keys, "y", "x", "d")


def _with_deviation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = df.withColumns({"m": F.col("v"), "q": F.col("v") * F.col("v")})
    for axis in ("x", "y"):  # both values in one pass over the lines of each axis
        for value in ("m", "q"):
            both = S.filtered(both, keys, axis, [1 / 3] * 3, first=-1, value=value)
    return both.withColumn("d", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))).drop("m", "q")


def region_entropy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean over 8 x 8 pixels of the binary entropy of values scaled to 0..1 over the image, as `h`."""
    return S.box(_with_bits(df, keys), keys, 8, "h").select(*keys, "y", "x", "h")


def _with_bits(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entropy of each pixel, as `h`, before it is averaged."""
    eps = 1e-10
    image, p = Window.partitionBy(*keys), F.col("p")
    lo, hi = F.min("v").over(image), F.max("v").over(image)
    scaled = df.withColumn("p", (F.col("v") - lo) / (hi - lo + eps))
    return scaled.withColumn("h", 0.0 - p * F.log2(p + eps) - (1 - p) * F.log2(1 - p + eps)).drop("p")


def _with_deviation_and_entropy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`d` and `h` in one pass over the lines of each axis."""
    both = _with_bits(df, keys).withColumns({"m": F.col("v"), "q": F.col("v") * F.col("v")})
    for axis in ("x", "y"):
        for value, size in (("m", 3), ("q", 3), ("h", 8)):
            both = S.filtered(both, keys, axis, [1 / size] * size, first=-(size // 2), value=value)
    return both.withColumn("d", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))).drop("m", "q")


def weighed(bands: list[DataFrame], keys: Sequence[str], sharpness: float) -> list[DataFrame]:
    """The bands with focus weights `e`: of bands the energy, of the rest deviation and entropy; to the power of sharpness.

    A pixel keeps its value through the filters, so nothing is joined, and after the first pass over whole images of the rest
    nothing more is dealt out."""
    fine = [_with_energy(b, keys).withColumn("e", F.pow("e", F.lit(sharpness))) for b in bands[:-1]]
    rest = _with_deviation_and_entropy(bands[-1], keys)
    return [*fine, rest.withColumn("e", F.pow((F.col("d") + F.col("h")) * 0.5, F.lit(sharpness))).drop("d", "h")]


def weights(bands: list[DataFrame], keys: Sequence[str], sharpness: float) -> list[DataFrame]:
    """The weights alone."""
    return [b.drop("v") for b in weighed(bands, keys, sharpness)]


def sums(bands: list[DataFrame], energy: list[DataFrame], frame: str, keys: Sequence[str]) -> list[DataFrame]:
    """Per level and pixel over all frames: se, sex, sx, n. Sums combine before the shuffle; keys: those of an image but frame.

    The bands may be files of a byte or less a pixel. Their size says nothing of the memory that a broadcast of them takes in
    the driver, so these joins are never one."""
    on = [k for k in energy[0].columns if k in keys]
    return summed([b.hint("merge").join(e, [*on, "y", "x"]) for b, e in zip(bands, energy, strict=True)], frame, keys)


def summed(both: list[DataFrame], frame: str, keys: Sequence[str]) -> list[DataFrame]:
    """The same of bands that have their weights."""
    own = [k for k in keys if k != frame]
    return [b.groupBy(*own, "y", "x").agg(F.sum("e").alias("se"), F.sum(F.col("e") * F.col("v")).alias("sex"), F.sum("v").alias("sx"), F.count(F.lit(1)).alias("n")) for b in both]


def finished(part: DataFrame) -> DataFrame:
    """The weighted mean where there is energy, the plain one where there is none."""
    a = P.confidence(F.col("se"))
    value = a * F.col("sex") / (F.col("se") + 1e-40) + (1 - a) * F.col("sx") / F.col("n")
    return part.withColumn("v", value).drop("se", "sex", "sx", "n")


def fused(df: DataFrame, keys: Sequence[str], height: int, width: int, levels: int | None = None, sharpness: float = 4.0, frame: str = "frame_idx", light: DataFrame | None = None, light_keys: Sequence[str] | None = None) -> DataFrame:
    """A stack as one image: (keys without frame, y, x, v), not clipped.

    df: the pixels of all frames and, where keys have one, channels; those with a null among the keys belong to no frame. light:
    the lightness that weighs them, by default the values themselves. Bands that are used several times are written to the
    shared folder once.
    """
    levels = level_count(height, width) if levels is None else levels
    made = pyramid(df.where(functools.reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))), keys, height, width, levels)
    if light is None:
        both = weighed([kept(b, "bands") for b in made] if levels else made, keys, sharpness)
        parts = summed(both, frame, keys)
    else:
        own = light_keys or keys
        energy = weights([kept(b, "bands") for b in pyramid(light, own, height, width, levels)], own, sharpness)
        parts = sums([kept(b, "bands") for b in made], energy, frame, keys)
    return collapsed([finished(x) for x in parts], [k for k in keys if k != frame], height, width)
