"""Whole runs with files around them: a folder at once, or arrays one after another as a camera would give them."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from .plans.run import FocusStackConfig, RunResult, run
from .sources import images as I
from .streaming.incremental import PreviewCallback, StreamingFocusStacker


def slab_saver(output: Path, extension: str | None, quality: int, spark: SparkSession) -> Callable[[str, np.ndarray], None]:
    """Saves sub-stacks beside the output, by their labels."""
    folder = output.parent / "stackfuse_slabs"

    def save(label: str, image: np.ndarray) -> None:
        I.write(image, folder / f"{label}.{(extension or 'tiff').lstrip('.')}", quality, spark)

    return save


def preview_saver(folder: Path, quality: int, spark: SparkSession) -> PreviewCallback:
    """Saves the preview after each image as preview_NNN.jpg, NNN being how many there are."""

    def save(image: np.ndarray, count: int) -> None:
        I.write(image, folder / f"preview_{count:03d}.jpg", quality, spark)

    return save


def _saved(result: RunResult, output: Path, quality: int, spark: SparkSession, began: float) -> RunResult:
    if result.image is not None:
        I.write(result.image, output, quality, spark)
        print(f"Saved {output} in {time.time() - began:.1f} s")
    return result


def stack(
    folder: Path, output: Path | None = None, workers: int = 3, quality: int = 95, slab: tuple[int, int] | None = None, output_steps: bool = False, only_slab: bool = False, recursive_slab: bool = False, slab_format: str | None = None, spark: SparkSession | None = None
) -> RunResult:
    """A folder's images, fused and saved (stacked.jpg in the folder by default)."""
    spark, began = spark or SparkSession.builder.getOrCreate(), time.time()
    output = output or Path(folder) / "stacked.jpg"
    saver = slab_saver(output, slab_format, quality, spark) if output_steps or only_slab else None
    return _saved(run(FocusStackConfig(folder, workers=workers, slab=slab, only_slab=only_slab, recursive_slab=recursive_slab, on_slab=saver), None, spark), output, quality, spark, began)


def stack_streaming(
    images: Sequence[np.ndarray], output: Path, reference_size: tuple[int, int], workers: int = 3, quality: int = 95, reference: int = -1, cull_threshold: float | None = None, keep_size: bool = False, slab: tuple[int, int] | None = None, output_steps: bool = False,
    only_slab: bool = False, recursive_slab: bool = False, slab_format: str | None = None, on_preview: PreviewCallback | None = None, preview_scale: float = 0.25, spark: SparkSession | None = None, **options,
) -> RunResult:
    """Images pushed one at a time, in the order they were taken; then fused and saved. options: others of StreamingFocusStacker."""
    spark, began = spark or SparkSession.builder.getOrCreate(), time.time()
    saver = slab_saver(output, slab_format, quality, spark) if output_steps or only_slab else None
    stream = StreamingFocusStacker(reference_size, reference, cull_threshold, workers=workers, slab=slab, only_slab=only_slab, recursive_slab=recursive_slab, on_slab=saver, on_preview=on_preview, preview_scale=preview_scale, spark=spark, **options)
    for image in images:
        stream.add_image(image)
    return _saved(stream.finish(keep_size), output, quality, spark, began)
