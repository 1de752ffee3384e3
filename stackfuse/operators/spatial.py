"""Filters over images as relations: one row per pixel, with y, x, a value and key columns.

A filter along one axis is a window over the pixels of a line: its neighbours come as an array of the frame's rows, and the
weighted sum is an expression on that array. So a separable filter costs a shuffle per axis, and no pixel is multiplied by the
number of taps. Images must be dense: every (y, x) from 0 on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The five binomial weights.
BINOMIAL = tuple(w / 16 for w in (1, 4, 6, 4, 1))


def reflect(i: Column, n: Column) -> Column:
    """Mirrored at the edges, with the edge pixel doubled; any distance."""
    j = F.pmod(i, 2 * n)
    return F.when(j < n, j).otherwise(2 * n - 1 - j)


def reflect_101(i: Column, n: Column) -> Column:
    """Mirrored at the edges, with the edge pixel once."""
    j = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
    return F.when(j < n, j).otherwise(2 * n - 2 - j)


def along(df: DataFrame, keys: Sequence[str], axis: str, reach: int, made: Callable[[Callable[[Column], Column], Column, Column], dict[str, Column]], value: str = "v") -> DataFrame:
    """Columns made from the neighbours on one axis, up to reach on either side.

    made(at, i, n): at(j) is the value at place j of the line (null outside reach), i the pixel's place, n the line's length.
    """
    line = Window.partitionBy(*keys, "y" if axis == "x" else "x")
    near = F.collect_list(value).over(line.orderBy(axis).rowsBetween(-reach, reach))
    i, n = F.col(axis), F.col("_n")
    at = lambda j: F.get(F.col("_near"), (j - F.greatest(i - reach, F.lit(0))).cast("int"))
    ready = df.withColumns({"_near": near, "_n": F.count(F.lit(1)).over(line).cast("int")})
    return ready.withColumns(made(at, i, n)).drop("_near", "_n")


def filtered(df: DataFrame, keys: Sequence[str], axis: str, taps: Sequence[float], border=reflect, first: int | None = None, value: str = "v") -> DataFrame:
    """The sum of taps over neighbours; taps begin at offset first (by default they are centred)."""
    first = -(len(taps) // 2) if first is None else first
    reach = max(abs(first), abs(first + len(taps) - 1))
    add = lambda at, i, n: {value: sum((float(w) * at(border(i + o, n)) for o, w in enumerate(taps, first) if w), F.lit(0.0))}
    return along(df, keys, axis, reach, add, value)


def separable(df: DataFrame, keys: Sequence[str], taps_y: Sequence[float], taps_x: Sequence[float], border=reflect, first: int | None = None, value: str = "v") -> DataFrame:
    return filtered(filtered(df, keys, "x", taps_x, border, first, value), keys, "y", taps_y, border, first, value)


def box(df: DataFrame, keys: Sequence[str], size: int, value: str = "v") -> DataFrame:
    """The mean over size x size pixels; an even size reaches one pixel further back than forth."""
    return separable(df, keys, [1 / size] * size, [1 / size] * size, reflect, -(size // 2), value)


def gaussian(size: int) -> list[float]:
    """Weights for the usual sigma of a size."""
    import math

    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def blur(df: DataFrame, keys: Sequence[str], size: int, value: str = "v") -> DataFrame:
    return separable(df, keys, gaussian(size), gaussian(size), reflect_101, None, value)


def reduced(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Half the size (rounded up): binomial filter, even pixels. Odd columns go before the second pass."""
    half = filtered(df, keys, "x", BINOMIAL, value=value).where("x % 2 = 0").withColumn("x", F.expr("x div 2").cast("int"))
    return filtered(half, keys, "y", BINOMIAL, value=value).where("y % 2 = 0").withColumn("y", F.expr("y div 2").cast("int"))


def expanded(df: DataFrame, keys: Sequence[str], height: int, width: int, value: str = "v") -> DataFrame:
    """Twice the size, cut to height x width: zeros between pixels, binomial filter times two per axis, mirrored on the
    stuffed grid. Taps that meet a zero are never computed."""
    for axis, size in (("x", width), ("y", height)):

        def pair(at, i, n):
            out = []
            for odd in (0, 1):
                total = F.lit(0.0)
                for o, w in enumerate(BINOMIAL, -2):
                    j = reflect(2 * i + odd + o, 2 * n)
                    total = total + F.when(j % 2 == 0, 2 * w * at(F.floor(j / 2))).otherwise(0.0)
                out.append(F.struct((2 * i + odd).cast("int").alias("p"), total.alias("s")))
            return {"_two": F.array(*out)}

        both = along(df, keys, axis, 2, pair, value).drop(axis, value)
        df = both.withColumn("_one", F.explode("_two")).withColumns({axis: F.col("_one.p"), value: F.col("_one.s")}).drop("_two", "_one").where(F.col(axis) < size)
    return df


def area_halved(df: DataFrame, keys: Sequence[str], factor: int = 2, value: str = "v") -> DataFrame:
    """Area interpolation by a whole factor: the mean of each factor x factor square."""
    return df.groupBy(*keys, F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).agg(F.avg(value).alias(value))


def area_resized(df: DataFrame, keys: Sequence[str], height: int, width: int, to_height: int, to_width: int, value: str = "v") -> DataFrame:
    """Area interpolation to a smaller size: each pixel gives to the one or more targets that it overlaps, by the overlap."""
    for axis, size, to in (("x", width, to_width), ("y", height, to_height)):
        scale = size / to
        i = F.col(axis)
        target = F.explode(F.sequence(F.floor(i / scale).cast("int"), F.least(F.ceil((i + 1) / scale) - 1, F.lit(to - 1)).cast("int")))
        share = F.greatest(F.least(i + 1, (F.col("_t") + 1) * scale) - F.greatest(i.cast("double"), F.col("_t") * scale), F.lit(0.0)) / scale
        spread = df.withColumn("_t", target).withColumn(value, F.col(value) * share)
        other = "y" if axis == "x" else "x"
        df = spread.groupBy(*keys, other, F.col("_t").alias(axis)).agg(F.sum(value).alias(value))
    return df


def sobel_energy(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Squared length of the 5 x 5 Sobel gradient, as `e`."""
    deriv, smooth = (-1, -2, 0, 2, 1), (1, 4, 6, 4, 1)
    two = lambda at, i, n: {"_d": sum(float(w) * at(reflect_101(i + o, n)) for o, w in enumerate(deriv, -2) if w), "_s": sum(float(w) * at(reflect_101(i + o, n)) for o, w in enumerate(smooth, -2))}
    both = along(df, keys, "x", 2, two, value)
    gx = along(both, keys, "y", 2, lambda at, i, n: {"_gx": sum(float(w) * at(reflect_101(i + o, n)) for o, w in enumerate(smooth, -2))}, "_d")
    gy = along(gx, keys, "y", 2, lambda at, i, n: {"_gy": sum(float(w) * at(reflect_101(i + o, n)) for o, w in enumerate(deriv, -2) if w)}, "_s")
    return gy.withColumn("e", F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).drop("_d", "_s", "_gx", "_gy")


def laplacian(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """The 3 x 3 Laplacian: 2 in the corners, -8 in the middle."""
    sides = along(df, keys, "x", 1, lambda at, i, n: {"_c": 2.0 * at(reflect_101(i - 1, n)) + 2.0 * at(reflect_101(i + 1, n))}, value)
    corners = along(sides, keys, "y", 1, lambda at, i, n: {"_k": at(reflect_101(i - 1, n)) + at(reflect_101(i + 1, n))}, "_c")
    return corners.withColumn(value, F.col("_k") - 8.0 * F.col(value)).drop("_c", "_k")


#: Half widths of the rows of a 7 x 7 ellipse.
ELLIPSE = (0, 2, 3, 3, 3, 2, 0)


def dilated(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """The greatest value under a 7 x 7 ellipse; nothing counts outside the image."""
    wide = along(df, keys, "x", 3, lambda at, i, n: {f"_w{w}": F.greatest(*(F.coalesce(at(i + o), at(i)) for o in range(-w, w + 1)), F.lit(float("-inf"))) for w in sorted({*ELLIPSE})}, value)
    for w in sorted({*ELLIPSE}):
        rows = [o for o, have in enumerate(ELLIPSE, -3) if have == w]
        wide = along(wide, keys, "y", 3, lambda at, i, n, rows=rows, w=w: {f"_w{w}": F.greatest(*(F.when((i + o >= 0) & (i + o < n), at(i + o)).otherwise(float("-inf")) for o in rows))}, f"_w{w}")
    return wide.withColumn(value, F.greatest(*(F.col(f"_w{w}") for w in sorted({*ELLIPSE})))).drop(*(f"_w{w}" for w in {*ELLIPSE}))
