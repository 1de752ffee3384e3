"""Focus scores, masks and culling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import spatial as S


def tile_histograms(df: DataFrame, keys: Sequence[str], height: int, width: int, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Per tile and grey value its count, clipped, with what was clipped dealt out evenly: (keys, ty, tx, v, n)."""
    th, tw = -(-height // tiles), -(-width // tiles)
    most = max(int(clip * th * tw / 256), 1)
    counts = df.groupBy(*keys, F.expr(f"y div {th}").cast("int").alias("ty"), F.expr(f"x div {tw}").cast("int").alias("tx"), F.col("v").cast("int").alias("v")).count()
    lists = counts.groupBy(*keys, "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("v", "count"))).alias("had"), F.sum(F.greatest(F.col("count") - most, F.lit(0))).alias("over"))
    every = lists.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    rest = F.col("over") % 256
    step = F.greatest(F.floor(256 / F.greatest(rest, F.lit(1))), F.lit(1))
    extra = F.when((rest > 0) & (F.col("v") % step == 0) & (F.floor(F.col("v") / step) < rest), 1).otherwise(0)
    n = F.least(F.coalesce(F.col("had")[F.col("v")], F.lit(0)), F.lit(most)) + F.floor(F.col("over") / 256) + extra
    return every.select(*keys, "ty", "tx", "v", n.cast("long").alias("n"))


def tile_tables(hist: DataFrame, keys: Sequence[str], area: int) -> DataFrame:
    """The equalising table of each tile: (keys, ty, tx, v, lut)."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "ty", "tx").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select(*keys, "ty", "tx", "v", F.least(F.floor(upto * 255.0 / area + 0.5), F.lit(255)).cast("int").alias("lut"))


def equalised(df: DataFrame, keys: Sequence[str], height: int, width: int, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalisation: four tiles' tables, blended bilinearly by the distance to their middles."""
    th, tw = -(-height // tiles), -(-width // tiles)
    lut = tile_tables(tile_histograms(df, keys, height, width, tiles, clip), keys, th * tw)
    gy, gx = F.col("y") / th - 0.5, F.col("x") / tw - 0.5
    corners = []
    for dy in (0, 1):
        for dx in (0, 1):
            wy = (gy - F.floor(gy)) if dy else 1 - (gy - F.floor(gy))
            wx = (gx - F.floor(gx)) if dx else 1 - (gx - F.floor(gx))
            clamp = lambda t: F.least(F.greatest(t, F.lit(0)), F.lit(tiles - 1)).cast("int")
            corners.append(F.struct(clamp(F.floor(gy) + dy).alias("ty"), clamp(F.floor(gx) + dx).alias("tx"), (wy * wx).alias("w")))
    spread = df.select(*keys, "y", "x", F.col("v").cast("int").alias("v"), F.explode(F.array(*corners)).alias("k")).select(*keys, "y", "x", "v", "k.*")
    return spread.join(lut, [*keys, "ty", "tx", "v"]).groupBy(*keys, "y", "x").agg(F.floor(F.sum(F.col("w") * F.col("lut")) + 0.5).cast("double").alias("v"))


def high_low_ratio(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of score maps `e`: fine against coarse energy where there is any, as `score`; 0 for an empty map. The maps are used twice,
    so they are written to the shared folder once."""
    df = kept(df.select(*keys, "y", "x", "e"), "scores")
    peak = df.groupBy(*keys).agg(F.max("e").alias("peak"))  # a row per image
    norm = df.join(peak, list(keys)).select(*keys, "y", "x", (F.col("e") / (F.col("peak") + 1e-8)).alias("v")).withColumn("low", F.col("v"))
    both = S.blur(norm, keys, 31, "low")
    here = F.col("v") > 0.01
    hf = F.avg(F.when(here, (F.col("v") - F.col("low")) * (F.col("v") - F.col("low"))))
    lf = F.avg(F.when(here, F.col("low") * F.col("low")))
    return both.groupBy(*keys).agg(hf.alias("hf"), lf.alias("lf")).select(*keys, F.when(F.col("lf") > 0, F.col("hf") / F.col("lf")).otherwise(0.0).alias("score"))


def tenengrad(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score maps `e` of grey images of 0..255."""
    return S.sobel_energy(df.select(*keys, "y", "x", (F.col("v") / 255.0).alias("v")), keys)


def culled(scores: DataFrame, threshold: float, stack: Sequence[str] = ()) -> DataFrame:
    """Adds `kept`: scores of threshold or more; all where all scores are 0; where fewer than two pass, the best two too."""
    whole = Window.partitionBy(*stack) if stack else Window.partitionBy(F.lit(0))
    passed = F.col("score") >= threshold
    ranked = scores.withColumns({"_rank": F.row_number().over(whole.orderBy(F.desc("score"), "frame_idx")), "_passed": F.sum(passed.cast("int")).over(whole), "_peak": F.max("score").over(whole)})
    kept = (F.col("_peak") == 0) | passed | ((F.col("_passed") < 2) & (F.col("_rank") <= 2))
    return ranked.withColumn("kept", kept).drop("_rank", "_passed", "_peak")


def focus_mask(df: DataFrame, keys: Sequence[str], percentile: float = 0.3) -> DataFrame:
    """Pixels at or over the percentile of the smoothed squared Laplacian, dilated: `mask` (0 or 1)."""
    sharp = S.blur(S.laplacian(df, keys).withColumn("v", F.col("v") * F.col("v")), keys, 15)
    # rounded, so that equal sharpness stays equal however it was summed
    sharp = sharp.withColumn("v", F.round("v", 6))
    cut = sharp.groupBy(*keys).agg(F.expr(f"percentile(v, {percentile})").alias("cut"))
    over = sharp.join(cut, list(keys)).select(*keys, "y", "x", F.when(F.col("v") >= F.col("cut") - 1e-7, 1.0).otherwise(0.0).alias("v"))
    return S.dilated(over, keys).select(*keys, "y", "x", F.col("v").cast("int").alias("mask"))


def combined_masks(a: DataFrame, b: DataFrame, keys: Sequence[str], least: int = 100) -> DataFrame:
    """Per pair the pixels in both masks; where those are under least, the pixels in either; where those are too, all."""
    both = a.withColumnRenamed("mask", "m").join(b.withColumnRenamed("mask", "k"), [*keys, "y", "x"])
    every, either = F.col("m").bitwiseAND(F.col("k")), F.col("m").bitwiseOR(F.col("k"))
    counts = both.groupBy(*keys).agg(F.sum(every).alias("n_and"), F.sum(either).alias("n_or"))  # a row per pair
    return both.join(counts, list(keys)).select(*keys, "y", "x", F.when(F.col("n_and") >= least, every).when(F.col("n_or") >= least, either).otherwise(1).alias("mask"))
