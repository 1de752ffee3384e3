"""Command line: stacks a folder of images."""

from __future__ import annotations

import argparse
import sys
import time
from importlib import metadata
from pathlib import Path

from pyspark.sql import SparkSession

from . import demo
from .plans.run import FocusStackConfig, Interrupted, resolve_images, run
from .sources import images as I
from .sources.tables import EXTENSIONS

FLAGS = (
    ("--no-align", "images are registered already"),
    ("--keep-size", "keep the size of the input; warps are applied in place"),
    ("--crop", "crop to what all images cover"),
    ("--no-fill", "black instead of mirrored edges"),
    ("--global-align", "align each image to the reference instead of its neighbour"),
    ("--no-rotation", "leave out rotation"),
    ("--no-scale", "leave out scale"),
    ("--no-shear", "leave out shear"),
    ("--no-translation", "leave out shifts"),
    ("--full-res", "align at full resolution (by default at 1024 pixels)"),
    ("--output-steps", "save the fused sub-stacks too"),
    ("--only-slab", "stop after the sub-stacks"),
    ("--recursive-slab", "sub-stacks of sub-stacks"),
    ("--streaming", "push the images one at a time, as they would be taken"),
    ("--version", "show the version"),
    ("--formats", "list the image formats"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stackfuse", description="Fuses a focus-bracketed folder of images into one.")
    p.add_argument("folder", type=Path, nargs="?")
    p.add_argument("--output", type=Path, help="default: stacked.jpg in the folder")
    p.add_argument("--reference", type=int, default=-1)
    p.add_argument("--min-shift", type=float, default=5.0)
    p.add_argument("--levels", type=int, default=0)
    p.add_argument("--quality", type=int, default=95)
    p.add_argument("--sharpness", type=float, default=4.0)
    p.add_argument("--cull", type=float, nargs="?", const=0.6, default=None, metavar="THRESHOLD", help="drop images that score less (absolute)")
    p.add_argument("--workers", type=int, default=3, help="parallel tasks; 0: all cores")
    p.add_argument("--slab", type=int, nargs=2, metavar=("SIZE", "OVERLAP"))
    p.add_argument("--slab-format", default=None, metavar="EXT")
    p.add_argument("--preview-dir", type=Path, metavar="DIR", help="with --streaming: save a preview after each image")
    p.add_argument("--preview-scale", type=float, default=0.25, metavar="SCALE", help="the previews' size as a part of the images'")
    for flag, text in FLAGS:
        p.add_argument(flag, action="store_true", help=text)
    return p


def version() -> str:
    try:
        return metadata.version("stackfuse")
    except metadata.PackageNotFoundError:  # run from its folder
        from . import __version__

        return __version__


def _streamed(args: argparse.Namespace, output: Path, slab: tuple[int, int] | None, spark: SparkSession) -> int:
    """The folder's images, one after another; each comes to the driver as a camera would hand it over."""
    frames, size = resolve_images(spark, args.folder)
    images = (I.array(r) for r in frames.orderBy("frame_idx").toLocalIterator())
    preview = demo.preview_saver(args.preview_dir, args.quality, spark) if args.preview_dir else None
    names = ("no_rotation", "no_scale", "no_shear", "no_translation", "full_res", "min_shift", "levels", "sharpness", "no_fill")
    demo.stack_streaming(
        images, output, size, args.workers, args.quality, args.reference, args.cull, args.keep_size, slab, args.output_steps, args.only_slab, args.recursive_slab, args.slab_format, preview, args.preview_scale, spark, **{n: getattr(args, n) for n in names}
    )
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.version:
        print(f"stackfuse {version()}")
        return 0
    if args.formats:
        print("Files are taken by these endings, in either case: " + " ".join(sorted(EXTENSIONS)))
        return 0
    if args.folder is None:
        p.error("a folder is needed")
    if not args.folder.is_dir():
        print(f"there is no folder {args.folder}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master(f"local[{args.workers or '*'}]").appName("stackfuse").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4").getOrCreate()
    output = args.output or args.folder / ("stacked_streaming.jpg" if args.streaming else "stacked.jpg")
    on_slab = demo.slab_saver(output, args.slab_format, args.quality, spark) if args.output_steps or args.only_slab else None
    slab = tuple(args.slab) if args.slab else None

    def progress(fraction, stage, message):
        if message:
            print(f"  {fraction * 100:5.1f}%  {message}")

    began = time.time()
    names = ("no_align", "keep_size", "crop", "no_fill", "reference", "cull", "global_align", "no_rotation", "no_scale", "no_shear", "no_translation", "full_res", "min_shift", "levels", "sharpness", "workers", "only_slab", "recursive_slab")
    try:
        if args.streaming:
            return _streamed(args, output, slab, spark)
        done = run(FocusStackConfig(args.folder, slab=slab, on_slab=on_slab, **{n: getattr(args, n) for n in names}), progress, spark)
        if done.image is not None:
            I.write(done.image, output, args.quality, spark)
            print(f"Saved {output} in {time.time() - began:.1f} s")
    except Interrupted:
        print("Interrupted.")
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
