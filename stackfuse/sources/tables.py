"""Rasters, stacks and warps made of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable

EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dense(raw: DataFrame, values: list[str]) -> DataFrame:
    axis = lambda c: raw.agg(F.array_sort(F.collect_set(c)).alias(c))  # noqa: E731  one row each: a few places
    grid = axis("frame_idx").crossJoin(axis("y")).crossJoin(axis("x"))
    for c in ("frame_idx", "y", "x"):
        grid = grid.withColumn(c, F.explode(c))
    return grid.join(raw, ["frame_idx", "y", "x"], "left").select("frame_idx", "y", "x", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def _cells(lineitem: DataFrame):
    return lineitem.groupBy((F.col("l_linenumber").cast("int") - 1).alias("frame_idx"), (F.col("l_orderkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x"))


def raster_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven frames of 32 x 32: frame_idx, y, x, v."""
    cells = _cells(table(spark, sf_dir, "lineitem")).agg(F.floor(F.avg("l_quantity") * 5).cast("int").alias("v"))
    return _dense(cells, ["v"]).withColumn("v", F.col("v").cast("double"))


def raster_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c, k: F.floor(F.avg(F.round(F.col(c) * 100)) * k).cast("int")
    cells = _cells(table(spark, sf_dir, "lineitem")).agg(F.floor(F.avg("l_quantity") * 5).cast("int").alias("r"), whole("l_discount", 25).alias("g"), whole("l_tax", 30).alias("b"))
    return _dense(cells, ["r", "g", "b"])


def embedding_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stacks of 8 x 8 frames: stack_id, frame_idx, y, x, v. Frames are dealt out whole, before they become pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("stack_id"), "vec_id", "embedding")
    numbered = rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("stack_id").orderBy("vec_id")) - 1).cast("int"))
    cells = numbered.repartition("stack_id", "frame_idx").select("stack_id", "frame_idx", F.posexplode("embedding").alias("p", "e"))
    return cells.select("stack_id", "frame_idx", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("double").alias("v"))


def event_cells(events: DataFrame) -> DataFrame:
    """Counts of events: stack_id (type), frame_idx (day), y (user), x (hour), v."""
    return events.groupBy(F.col("event_type").alias("stack_id"), (F.dayofmonth("ts") - 1).cast("int").alias("frame_idx"), (F.col("user_id") % 8).cast("int").alias("y"), F.hour("ts").cast("int").alias("x")).agg(F.count(F.lit(1)).alias("v"))


def affine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chains of five warps."""
    n = F.col("n_nationkey")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("stack_id"),
        (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("int").alias("frame_idx"),
        (1 + d(n % 3 - 1) / 1024).alias("a00"),
        (d(n % 2) / 2048).alias("a01"),
        d(n % 5 - 2).alias("tx"),
        (0.0 - d(n % 2) / 2048).alias("a10"),
        (1 + d(n % 3 - 1) / 1024).alias("a11"),
        d(n * 3 % 7 - 3).alias("ty"),
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*(F.lit(x) for x in (".jpg", ".JPEG", ".png", ".TIF", ".tiff", ".webp", ".gif", ".txt")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 8).cast("int"))).alias("path"))


def supported(path) -> object:
    """Whether a path ends in an image extension, in any case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*EXTENSIONS)


def ordered(files: DataFrame, stack: str | None = None) -> DataFrame:
    """Image files by path, numbered from 0 in each stack. By default a stack is a folder, so no task orders all files."""
    rows = files.where(supported(F.col("path"))).withColumn("stack_id", F.col(stack) if stack else F.regexp_extract("path", r"^(.*?)[^/]*$", 1))
    return rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("stack_id").orderBy("path")) - 1).cast("int"))
