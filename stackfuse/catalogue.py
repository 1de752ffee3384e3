"""The operators as queries over the test tables; their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pixels as P
from .operators import focus, fusion, geometry
from .operators import spatial as S
from .oracle import ORACLE_SQL
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FRAME = ["frame_idx"]
STACK = ["stack_id", "frame_idx"]
SIDE, LEVELS = 32, 1


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _pixels(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "y", "x", "v")


# ---- sources


@query
def frames_ordered(spark, sf_dir):
    return T.ordered(T.file_listing(spark, sf_dir)).select("frame_idx", "path")


@query
def ext_filter(spark, sf_dir):
    files = T.file_listing(spark, sf_dir)
    return files.where(T.supported(F.col("path"))).select(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).alias("ext")).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


# ---- single pixels


@query
def gray_luma(spark, sf_dir):
    return T.raster_rgb(spark, sf_dir).select("frame_idx", "y", "x", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


@query
def lab_lightness(spark, sf_dir):
    return _rounded(T.raster_rgb(spark, sf_dir).select("frame_idx", "y", "x", P.lightness(F.col("r"), F.col("g"), F.col("b")).alias("v")), "v")


@query
def depth_shift(spark, sf_dir):
    wide = T.raster_grey(spark, sf_dir).withColumn("v", (F.col("v") * 257 + F.col("y") * 3).cast("int"))
    return wide.select("frame_idx", "y", "x", P.narrow(F.col("v")).alias("shifted"), P.narrow_scaled(F.col("v")).alias("scaled"))


@query
def clip_cast(spark, sf_dir):
    return T.raster_grey(spark, sf_dir).select("frame_idx", "y", "x", P.clipped(F.col("v") * 1.75 - 60.5, 255).alias("v"))


@query
def confidence_alpha(spark, sf_dir):
    raster = T.raster_grey(spark, sf_dir)
    return _rounded(raster.select("frame_idx", "y", "x", P.confidence(F.col("v") / 25000000000000000.0).alias("alpha")), "alpha")


# ---- filters


@query
def area_downscale(spark, sf_dir):
    return S.area_halved(T.raster_grey(spark, sf_dir), FRAME)


@query
def area_resize(spark, sf_dir):
    return _rounded(S.area_resized(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 13, 20), "v", digits=8)


@query
def pyr_reduce(spark, sf_dir):
    return _pixels(S.reduced(T.raster_grey(spark, sf_dir), FRAME), *FRAME)


@query
def pyr_expand(spark, sf_dir):
    return _pixels(S.expanded(T.raster_grey(spark, sf_dir), FRAME, 63, 64), *FRAME)


@query
def pyr_laplacian(spark, sf_dir):
    return fusion.stacked(fusion.pyramid(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2))


@query
def pyr_collapse(spark, sf_dir):
    return fusion.collapsed(fusion.pyramid(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2), FRAME, SIDE, SIDE)


@query
def region_energy(spark, sf_dir):
    return _rounded(fusion.region_energy(T.raster_grey(spark, sf_dir), FRAME), "e")


@query
def region_deviation(spark, sf_dir):
    return _rounded(fusion.region_deviation(T.raster_grey(spark, sf_dir), FRAME), "d")


@query
def region_entropy(spark, sf_dir):
    return _rounded(fusion.region_entropy(T.raster_grey(spark, sf_dir), FRAME), "h")


@query
def gauss_blur(spark, sf_dir):
    return _rounded(S.blur(T.raster_grey(spark, sf_dir), FRAME, 15), "v").select("frame_idx", "y", "x", "v")


@query
def sobel_energy(spark, sf_dir):
    return S.sobel_energy(T.raster_grey(spark, sf_dir), FRAME).select("frame_idx", "y", "x", "e")


@query
def laplacian3(spark, sf_dir):
    return _pixels(S.laplacian(T.raster_grey(spark, sf_dir), FRAME), *FRAME)


@query
def dilate7(spark, sf_dir):
    return _pixels(S.dilated(T.raster_grey(spark, sf_dir), FRAME), *FRAME)


@query
def clahe_tile_hist(spark, sf_dir):
    return focus.tile_histograms(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2).select("frame_idx", "ty", "tx", "v", "n")


@query
def clahe_lut(spark, sf_dir):
    hist = focus.tile_histograms(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2)
    return focus.tile_tables(hist, FRAME, 256)


@query
def clahe_equalise(spark, sf_dir):
    return focus.equalised(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2)


# ---- focus


@query
def focus_mask_p30(spark, sf_dir):
    return focus.focus_mask(T.raster_grey(spark, sf_dir), FRAME)


@query
def mask_population(spark, sf_dir):
    return focus.focus_mask(T.raster_grey(spark, sf_dir), FRAME).groupBy("frame_idx").agg(F.sum("mask").cast("long").alias("n"))


def _mask_pair(spark, sf_dir):
    raster = T.raster_grey(spark, sf_dir)
    a = raster.select("frame_idx", "y", "x", (F.col("v") >= 140).cast("int").alias("mask"))
    b = raster.select((F.col("frame_idx") + 1).alias("frame_idx"), "y", "x", (F.col("v") >= 20 * F.col("frame_idx") + 60).cast("int").alias("mask"))
    return a, b


@query
def mask_intersection(spark, sf_dir):
    return focus.combined_masks(*_mask_pair(spark, sf_dir), FRAME, 350)


@query
def tenengrad_score(spark, sf_dir):
    return _rounded(focus.tenengrad(T.raster_grey(spark, sf_dir), FRAME), "e").select("frame_idx", "y", "x", "e")


@query
def tenengrad_equalised(spark, sf_dir):
    """The score map as scoring makes it: of the equalised image."""
    even = focus.equalised(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, 2)
    return _rounded(focus.tenengrad(even, FRAME), "e").select("frame_idx", "y", "x", "e")


def _scores(spark, sf_dir):
    return focus.high_low_ratio(focus.tenengrad(T.raster_grey(spark, sf_dir), FRAME), FRAME)


@query
def hf_lf_ratio(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "score")


def _stack_scores(spark, sf_dir):
    return T.embedding_stacks(spark, sf_dir).groupBy(*STACK).agg(((64 * F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v")) / 409600.0).alias("score"))


@query
def cull_threshold(spark, sf_dir):
    return focus.culled(_stack_scores(spark, sf_dir), 2.6, ["stack_id"])


@query
def cull_top2_floor(spark, sf_dir):
    return focus.culled(_stack_scores(spark, sf_dir), 1000.0, ["stack_id"])


@query
def cull_kept_frames(spark, sf_dir):
    """Frames of the kept ones only: a semi-join before any pixel is worked on."""
    kept = focus.culled(_stack_scores(spark, sf_dir), 2.6, ["stack_id"]).where("kept")
    return T.embedding_stacks(spark, sf_dir).join(kept, STACK, "left_semi").groupBy(*STACK).agg(F.sum("v").alias("v"))


# ---- fusion


def _parts(spark, sf_dir):
    bands = fusion.pyramid(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, LEVELS)
    return fusion.sums(bands, fusion.weights(bands, FRAME, 4.0), "frame_idx", FRAME)


@query
def focus_weights(spark, sf_dir):
    bands = fusion.pyramid(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, LEVELS)
    weights = fusion.stacked([w.withColumnRenamed("e", "v") for w in fusion.weights(bands, FRAME, 1.0)])
    return _rounded(weights, "v")


@query
def fuse_partial(spark, sf_dir):
    parts = fusion.stacked([p.withColumnsRenamed({"se": "v"}) for p in _parts(spark, sf_dir)])
    ratio = parts.select("level", "y", "x", (F.col("sex") / (F.col("v") + 1e-40)).alias("mean"), "sx", "n", F.log10(F.col("v") + 1e-40).alias("log_se"))
    return _rounded(ratio, "mean", "sx", "log_se", digits=5)


@query
def fuse_final(spark, sf_dir):
    return _rounded(fusion.stacked([fusion.finished(p) for p in _parts(spark, sf_dir)]), "v", digits=5)


@query
def fuse_stack(spark, sf_dir):
    """The flagship: seven frames as one sharp image."""
    image = fusion.fused(T.raster_grey(spark, sf_dir), FRAME, SIDE, SIDE, LEVELS)
    return _rounded(image, "v", digits=5)


@query
def fuse_stacks(spark, sf_dir):
    """Ten stacks at once, levels 0: the top level's weights alone."""
    return _rounded(fusion.fused(T.embedding_stacks(spark, sf_dir), STACK, 8, 8, 0), "v", digits=5)


@query
def fuse_rgb(spark, sf_dir):
    """Three channels, weighed by lightness, which is filtered once for all of them; 8-bit output."""
    rgb = T.raster_rgb(spark, sf_dir)
    light = rgb.select("frame_idx", "y", "x", P.lightness(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    melted = rgb.select("frame_idx", "y", "x", F.posexplode(F.array(*(F.col(c).cast("double") for c in "rgb"))).alias("c", "v"))
    image = fusion.fused(melted, ["frame_idx", "c"], SIDE, SIDE, LEVELS, light=light, light_keys=FRAME)
    return _rounded(image, "v", digits=4).select("c", "y", "x", "v")


# ---- warps


def _steps(spark, sf_dir):
    return T.affine_steps(spark, sf_dir).withColumn("converged", F.col("frame_idx") % 4 != 3)


@query
def neighbour_pairs(spark, sf_dir):
    return geometry.neighbour_pairs(T.affine_steps(spark, sf_dir), ["stack_id"], 2)


@query
def global_pairs(spark, sf_dir):
    return geometry.global_pairs(T.affine_steps(spark, sf_dir), ["stack_id"], 2)


@query
def affine_chain(spark, sf_dir):
    return _rounded(geometry.chained(_steps(spark, sf_dir), ["stack_id"], 2, least_shift=1.5), *geometry.WARP, digits=9)


@query
def affine_translate_chain(spark, sf_dir):
    return _rounded(geometry.chained(_steps(spark, sf_dir), ["stack_id"], 2, least_shift=0.0, no_rotation=True), *geometry.WARP, digits=6)


def _odd_warps(spark, sf_dir):
    return T.affine_steps(spark, sf_dir).withColumns({"a00": F.col("a00") + 0.01 * F.col("frame_idx"), "a11": F.col("a11") + 0.25, "a01": F.col("a01") * 512 + 0.125})


def _constrained(spark, sf_dir, **limits):
    w = _odd_warps(spark, sf_dir).select("stack_id", "frame_idx", geometry.constrained(geometry.warp_struct(), **limits).alias("w"))
    return _rounded(w.select("stack_id", "frame_idx", "w.*"), *geometry.WARP, digits=8)


@query
def warp_no_shear(spark, sf_dir):
    return _constrained(spark, sf_dir, shear=True)


@query
def warp_no_scale(spark, sf_dir):
    return _constrained(spark, sf_dir, scale=True)


@query
def warp_no_rotation(spark, sf_dir):
    return _constrained(spark, sf_dir, rotation=True)


@query
def warp_constrain_all(spark, sf_dir):
    return _constrained(spark, sf_dir, rotation=True, scale=True, shear=True, translation=True)


@query
def warp_validate(spark, sf_dir):
    w = geometry.warp_struct()
    return _odd_warps(spark, sf_dir).select("stack_id", "frame_idx", geometry.plausible(w, F.lit(0.5), F.lit(-0.5), 16.0, bend=0.3).alias("plausible"))


@query
def warp_negligible(spark, sf_dir):
    w = geometry.warp_struct()
    return T.affine_steps(spark, sf_dir).select("stack_id", "frame_idx", geometry.negligible(w, 2.5).alias("negligible"), geometry.near_identity(w, 1e-4).alias("pure_translation"))


@query
def warp_message(spark, sf_dir):
    return T.affine_steps(spark, sf_dir).select("stack_id", "frame_idx", geometry.message(F.concat(F.lit("frame "), F.col("frame_idx").cast("string")), geometry.warp_struct()).alias("message"))


@query
def canvas_expand(spark, sf_dir):
    return _rounded(geometry.canvas(T.affine_steps(spark, sf_dir), ["stack_id"], 32, 48), "off_x", "off_y")


@query
def canvas_crop(spark, sf_dir):
    return _rounded(geometry.canvas(T.affine_steps(spark, sf_dir), ["stack_id"], 32, 48, crop=True), "off_x", "off_y")


def _warped(spark, sf_dir, fill, cubic=False):
    """Every warp of every chain, over the whole canvas."""
    warps = T.affine_steps(spark, sf_dir)
    keys = ["stack_id", *FRAME]
    raster = T.raster_grey(spark, sf_dir).join(warps.select(*keys), FRAME)
    return _rounded(geometry.warped(raster, warps, keys, keys, SIDE, SIDE, SIDE, SIDE, fill, cubic), "v").select(*keys, "y", "x", "v")


@query
def warp_bilinear(spark, sf_dir):
    return _warped(spark, sf_dir, True)


@query
def warp_bicubic(spark, sf_dir):
    return _warped(spark, sf_dir, True, True)


@query
def warp_no_fill(spark, sf_dir):
    return _warped(spark, sf_dir, False)


# ---- sub-stacks


@query
def slab_ranges(spark, sf_dir):
    counts = T.embedding_stacks(spark, sf_dir).groupBy("stack_id").agg(F.countDistinct("frame_idx").cast("int").alias("n"))
    return geometry.slabs(counts, ["stack_id"], 10, 3)


def _slab(df, keys, n, size, overlap, layer):
    ranges = geometry.slabs(df.sparkSession.range(1).select(F.lit(n).alias("n")), [], size, overlap, layer)
    return df.join(F.broadcast(geometry.members(ranges, [])), "frame_idx")  # size x slabs rows of a stack of n frames


@query
def slab_fuse(spark, sf_dir):
    """Sub-stacks of three frames, one shared with the next, all in one query."""
    spread = _slab(T.raster_grey(spark, sf_dir), FRAME, 7, 3, 1, 1)
    return _rounded(fusion.fused(spread, ["slab_idx", "frame_idx"], SIDE, SIDE, 0), "v", digits=5)


@query
def slab_recursive(spark, sf_dir):
    """Sub-stacks, cut to 8 bits as files would be, fused again."""
    first = fusion.fused(_slab(T.raster_grey(spark, sf_dir), FRAME, 7, 3, 1, 1), ["slab_idx", "frame_idx"], SIDE, SIDE, 0)
    again = first.select(F.col("slab_idx").alias("frame_idx"), "y", "x", P.clipped(F.round("v", 5), 255).cast("double").alias("v"))
    return _rounded(fusion.fused(again, FRAME, SIDE, SIDE, 0), "v", digits=5)


# ---- incremental


@query
def preview_running(spark, sf_dir):
    """What a preview holds after each frame: running sums."""
    upto = Window.partitionBy("y", "x").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    e = fusion.region_energy(T.raster_grey(spark, sf_dir), FRAME).join(T.raster_grey(spark, sf_dir), [*FRAME, "y", "x"])
    run = e.select("frame_idx", "y", "x", F.sum("e").over(upto).alias("se"), F.sum(F.col("e") * F.col("v")).over(upto).alias("sex"), F.sum("v").over(upto).alias("sx"), F.count(F.lit(1)).over(upto).alias("n"))
    return _rounded(run, "se", "sex", "sx", digits=3)


@query
def stream_state_sum(spark, sf_dir):
    """The state of a stream of events at its end, read as a stream."""
    from .streaming import incremental

    return incremental.event_state(spark, sf_dir)


@query
def stream_frames(spark, sf_dir):
    """Ten stacks through the stateful fusion, to the end of the stream: frames, and the mean of the fused image."""
    from .streaming import incremental

    return _rounded(incremental.stack_state(spark, sf_dir), "mean", digits=4)


@query
def stream_fuse(spark, sf_dir):
    """The same stacks' images at the stream's end: those of fuse_stacks, from running sums."""
    from .streaming import incremental

    return _rounded(incremental.stack_fused(spark, sf_dir), "v", digits=5)


# ---- blocks: arrays instead of pixel rows


@query
def block_fuse(spark, sf_dir):
    """fuse_stack on arrays, one row per frame; equal to the relations."""
    from .plans import blocks

    return _rounded(blocks.fuse_pixels(T.raster_grey(spark, sf_dir), SIDE, SIDE, LEVELS), "v", digits=5)


@query
def phase_shift(spark, sf_dir):
    from .plans import blocks

    return blocks.known_shifts(spark, sf_dir)


@query
def ecc_affine(spark, sf_dir):
    from .plans import blocks

    return blocks.known_affines(spark, sf_dir)
