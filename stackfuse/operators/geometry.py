"""Affine warps, canvases, neighbours and sub-stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import reflect

WARP = ("a00", "a01", "tx", "a10", "a11", "ty")
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def warp_struct(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in WARP))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def composed(a: Column, b: Column) -> Column:
    """First b, then a."""
    return F.struct(
        (a["a00"] * b["a00"] + a["a01"] * b["a10"]).alias("a00"),
        (a["a00"] * b["a01"] + a["a01"] * b["a11"]).alias("a01"),
        (a["a00"] * b["tx"] + a["a01"] * b["ty"] + a["tx"]).alias("tx"),
        (a["a10"] * b["a00"] + a["a11"] * b["a10"]).alias("a10"),
        (a["a10"] * b["a01"] + a["a11"] * b["a11"]).alias("a11"),
        (a["a10"] * b["tx"] + a["a11"] * b["ty"] + a["ty"]).alias("ty"),
    )


def identity() -> Column:
    return F.struct(*(F.lit(v).alias(c) for c, v in zip(WARP, IDENTITY, strict=True)))


def near_identity(w: Column, tolerance: float, relative: float = 1e-5) -> Column:
    """The linear part against that of the identity, each entry within tolerance (and a relative part where it is 1)."""
    one = tolerance + relative
    return (F.abs(w["a00"] - 1) <= one) & (F.abs(w["a11"] - 1) <= one) & (F.abs(w["a01"]) <= tolerance) & (F.abs(w["a10"]) <= tolerance)


def negligible(w: Column, least_shift: float = 5.0) -> Column:
    return (F.hypot(w["tx"], w["ty"]) < least_shift) & near_identity(w, 1e-3)


def plausible(w: Column, seed_x: Column, seed_y: Column, long_edge: float, shift: float = 0.15, bend: float = 0.02) -> Column:
    """Not far from the seed's shift, and a linear part close to that of the identity."""
    off = F.sqrt((w["a00"] - 1) * (w["a00"] - 1) + w["a01"] * w["a01"] + w["a10"] * w["a10"] + (w["a11"] - 1) * (w["a11"] - 1))
    return (F.hypot(w["tx"] - seed_x, w["ty"] - seed_y) <= shift * long_edge) & (off <= bend)


def message(label: Column, w: Column) -> Column:
    return F.format_string("%s: rotation %+.2f°  shift (%+.1f, %+.1f) px", label, F.degrees(F.atan2(w["a10"], w["a00"])), w["ty"], w["tx"])


def constrained(w: Column, rotation: bool = False, scale: bool = False, shear: bool = False, translation: bool = False) -> Column:
    """The warp without the freedoms that are named, from the closed singular value decomposition of its linear part.

    M = R(a) diag(s0, s1) R(-b) with s0 >= |s1|; its rotation is U V' = R(a - b) where s1 > 0.
    """
    if not (rotation or scale or shear or translation):
        return w
    e, f = (w["a00"] + w["a11"]) / 2, (w["a00"] - w["a11"]) / 2
    g, h = (w["a10"] + w["a01"]) / 2, (w["a10"] - w["a01"]) / 2
    q, r = F.hypot(e, h), F.hypot(f, g)
    a1, a2 = F.atan2(g, f), F.atan2(h, e)
    beta, phi = (a2 - a1) / 2, (a2 + a1) / 2  # V' turns by beta, U by phi
    s0, s1 = q + r, F.abs(q - r)
    if scale:
        mean = F.sqrt(F.abs(s0 * s1))
        s0, s1 = F.when(mean > 0, s0 / mean).otherwise(s0), F.when(mean > 0, s1 / mean).otherwise(s1)
    if rotation or shear:
        if rotation and shear:
            m = (s0, F.lit(0.0), F.lit(0.0), s1)
        elif rotation:  # V S V'
            c, s = F.cos(beta), F.sin(beta)
            m = (c * c * s0 + s * s * s1, c * s * (s1 - s0), c * s * (s1 - s0), s * s * s0 + c * c * s1)
        else:  # the rotation times the scales
            c, s = F.cos(a2), F.sin(a2)
            m = (c * s0, 0.0 - s * s1, s * s0, c * s1)
    else:
        cb, sb, cp, sp = F.cos(beta), F.sin(beta), F.cos(phi), F.sin(phi)
        m = (cp * s0 * cb - sp * s1 * sb, 0.0 - cp * s0 * sb - sp * s1 * cb, sp * s0 * cb + cp * s1 * sb, 0.0 - sp * s0 * sb + cp * s1 * cb)
    if not (rotation or scale or shear):
        m = (w["a00"], w["a01"], w["a10"], w["a11"])
    tx, ty = (F.lit(0.0), F.lit(0.0)) if translation else (w["tx"], w["ty"])
    return F.struct(m[0].alias("a00"), m[1].alias("a01"), tx.alias("tx"), m[2].alias("a10"), m[3].alias("a11"), ty.alias("ty"))


def chained(steps: DataFrame, stack: Sequence[str], reference: int, least_shift: float = 5.0, no_rotation: bool = False, whole_path: bool = True, **freedoms: bool) -> DataFrame:
    """Warps of all frames to the reference: steps (stack, frame_idx, warp columns, converged) take a frame to its neighbour
    on the reference's side; they are composed outwards from it, both ways.

    A step that didn't converge adds nothing. Where the sum so far is negligible the frame gets the identity, and the sum
    goes on. whole_path: the freedoms bind the sum as well as the steps. A stack's steps are one small array.
    """
    limits = {"rotation": no_rotation, **freedoms}
    bound = steps.select(*stack, "frame_idx", constrained(warp_struct(), **limits).alias("w"), "converged")
    out = []
    for side in (1, -1):
        part = bound.where(F.col("frame_idx") > reference if side == 1 else F.col("frame_idx") < reference)
        near = F.abs(F.col("frame_idx") - reference)
        rows = part.groupBy(*stack).agg(F.array_sort(F.collect_list(F.struct(near.cast("int").alias("near"), "frame_idx", "w", "converged"))).alias("steps"))

        def path(total):
            total = let(total, lambda x: constrained(x, **limits)) if whole_path else total
            if no_rotation:
                return let(total, lambda x: F.struct(F.lit(1.0).alias("a00"), F.lit(0.0).alias("a01"), x["tx"].alias("tx"), F.lit(0.0).alias("a10"), F.lit(1.0).alias("a11"), x["ty"].alias("ty")))
            return total

        def add(acc, s):
            total = F.when(s["converged"], path(composed(acc["sum"], s["w"]))).otherwise(acc["sum"])

            def kept(x):
                own = F.when(s["converged"] & negligible(x, least_shift), identity()).otherwise(x)
                return F.struct(x.alias("sum"), F.concat(acc["out"], F.array(F.struct(s["frame_idx"].alias("frame_idx"), own.alias("w")))).alias("out"))

            return let(total, kept)

        kind = "array<struct<frame_idx:int,w:struct<" + ",".join(f"{c}:double" for c in WARP) + ">>>"
        start = F.struct(identity().alias("sum"), F.array().cast(kind).alias("out"))
        out.append(rows.select(*stack, F.explode(F.aggregate("steps", start, add, lambda acc: acc["out"])).alias("o")).select(*stack, "o.frame_idx", "o.w.*"))
    own = steps.select(*stack).distinct().select(*stack, F.lit(reference).alias("frame_idx"), *(F.lit(v).alias(c) for c, v in zip(WARP, IDENTITY, strict=True)))
    return out[0].unionByName(out[1]).unionByName(own)


def canvas(warps: DataFrame, stack: Sequence[str], height: int, width: int, crop: bool = False) -> DataFrame:
    """Per stack the canvas (width, height) and its offset, from the corners of all warped frames: around all of them, or
    (crop) what all of their boxes share, if they share anything."""
    corners = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (0, width) for y in (0, height))))
    moved = warps.select(*stack, "frame_idx", *WARP, corners.alias("k"))
    x, y = F.col("a00") * F.col("k.x") + F.col("a01") * F.col("k.y") + F.col("tx"), F.col("a10") * F.col("k.x") + F.col("a11") * F.col("k.y") + F.col("ty")
    boxes = moved.groupBy(*stack, "frame_idx").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    every = boxes.groupBy(*stack).agg(F.min("x0").alias("ox0"), F.max("x1").alias("ox1"), F.min("y0").alias("oy0"), F.max("y1").alias("oy1"), F.max("x0").alias("ix0"), F.min("x1").alias("ix1"), F.max("y0").alias("iy0"), F.min("y1").alias("iy1"))
    share = (F.col("ix1") > F.col("ix0")) & (F.col("iy1") > F.col("iy0")) & F.lit(crop)
    pick = lambda c: F.when(share, F.col("i" + c)).otherwise(F.col("o" + c))
    side = lambda a, b: F.greatest(F.ceil(pick(b) - pick(a)), F.lit(1)).cast("int")
    return every.select(*stack, side("x0", "x1").alias("width"), side("y0", "y1").alias("height"), (0.0 - pick("x0")).alias("off_x"), (0.0 - pick("y0")).alias("off_y"))


#: The slope of the cubic at a distance of one; a fixed value.
CUBIC = -0.75


def _cubic(d):
    """The weight of a pixel at distance d, under 2."""
    near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
    return F.when(d <= 1, near).otherwise(((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC)


def warped(df: DataFrame, warps: DataFrame, keys: Sequence[str], stack_frame: Sequence[str], height: int, width: int, to_height: int, to_width: int, fill: bool = True, cubic: bool = False) -> DataFrame:
    """Bilinear (or bicubic) warp of dense images: each target pixel looks back through the inverse; outside, the image is
    mirrored (fill) or 0. Targets are made from the warps, so only sources that are needed meet them in one equi-join. A target
    costs 4 (or 16) shuffled rows; whole frames of real size go through plans/blocks.py instead."""
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a10")
    grid = warps.select(*stack_frame, *WARP, F.explode(F.sequence(F.lit(0), F.lit(to_height - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    px, py = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    back = grid.select(*stack_frame, "y", "x", ((F.col("a11") * px - F.col("a01") * py) / det).alias("sx"), ((F.col("a00") * py - F.col("a10") * px) / det).alias("sy"))
    x0, y0 = F.floor("sx"), F.floor("sy")
    taps, offsets, share = [], (-1, 0, 1, 2) if cubic else (0, 1), _cubic if cubic else lambda d: 1 - d
    for dy in offsets:
        for dx in offsets:
            w = share(F.abs(F.col("sy") - y0 - dy)) * share(F.abs(F.col("sx") - x0 - dx))
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < height) & (xx >= 0) & (xx < width)
            weight = w if fill else F.when(inside, w).otherwise(0.0)
            taps.append(F.struct(reflect(yy, F.lit(height)).cast("int").alias("fy"), reflect(xx, F.lit(width)).cast("int").alias("fx"), weight.alias("w")))
    spread = back.select(*stack_frame, F.col("y").alias("ty"), F.col("x").alias("tx"), F.explode(F.array(*taps)).alias("k")).select(*stack_frame, "ty", "tx", F.col("k.fy").alias("y"), F.col("k.fx").alias("x"), "k.w")
    found = spread.join(df, [*stack_frame, "y", "x"])
    return found.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def neighbour_pairs(frames: DataFrame, stack: Sequence[str], reference: int) -> DataFrame:
    """Each frame with its neighbour on the reference's side."""
    line = Window.partitionBy(*stack).orderBy("frame_idx")
    both = frames.select(*stack, "frame_idx", F.lag("frame_idx").over(line).alias("_before"), F.lead("frame_idx").over(line).alias("_after"))
    return both.where(F.col("frame_idx") != reference).select(*stack, "frame_idx", F.when(F.col("frame_idx") > reference, F.col("_before")).otherwise(F.col("_after")).alias("neighbour_idx"))


def global_pairs(frames: DataFrame, stack: Sequence[str], reference: int) -> DataFrame:
    return frames.where(F.col("frame_idx") != reference).select(*stack, "frame_idx", F.lit(reference).alias("neighbour_idx"))


def slabs(counts: DataFrame, stack: Sequence[str], size: int, overlap: int, layer: int = 1) -> DataFrame:
    """Sub-stacks of n frames (column n): slab_idx, start_idx, end_idx (exclusive), label."""
    if size < 2:
        raise ValueError("a slab has at least two frames")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and under the slab's size")
    step = max(1, size - overlap)
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    every = counts.where("n > 0").select(*stack, "n", F.explode(F.sequence(F.lit(0), last)).alias("slab_idx"))
    start = F.col("slab_idx") * step
    return every.select(*stack, F.lit(layer).alias("layer"), "slab_idx", start.alias("start_idx"), F.least(start + size, F.col("n")).cast("int").alias("end_idx"), F.format_string(f"slab_{layer}_%03d", F.col("slab_idx") + 1).alias("label"))


def members(ranges: DataFrame, stack: Sequence[str]) -> DataFrame:
    """slab_idx and frame_idx: ranges spread out, so that frames meet them in an equi-join."""
    return ranges.select(*stack, "slab_idx", F.explode(F.sequence(F.col("start_idx"), F.col("end_idx") - 1)).alias("frame_idx"))
