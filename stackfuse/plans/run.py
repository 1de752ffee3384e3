"""A stack from its images to the fused one: scores, culling, alignment, canvas, sub-stacks, fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import focus, fusion, geometry
from ..session import Interrupted, interruptible, kept
from ..sources import images as I
from . import blocks as B

Stage = Literal["loading", "culling", "aligning", "stacking", "slabbing", "complete"]
ProgressCallback = Callable[[float, str, str], None]
SlabCallback = Callable[[str, np.ndarray], None]
InterruptCallback = Callable[[], bool]


@dataclass
class CullEntry:
    path: str | int
    score: float
    kept: bool


@dataclass
class CullResult:
    entries: list[CullEntry]
    cutoff: float
    n_culled: int

    @property
    def kept(self) -> list:
        return [e.path for e in self.entries if e.kept]


@dataclass
class RunResult:
    image: np.ndarray | None
    slabs: list[np.ndarray] | None


@dataclass(frozen=True)
class FocusStackConfig:
    """images: a folder, a list of paths, a list of arrays, or a DataFrame of frames.

    cull: keep frames that score so much or more (absolute); None: all. reference -1: the middle of the kept frames. levels 0:
    by the size. slab: (size, overlap). canvas_fit 'stretch' fits frames to an enlarged canvas before they are moved; 'pad'
    leaves their scale.
    """

    images: object
    no_align: bool = False
    keep_size: bool = False
    crop: bool = False
    no_fill: bool = False
    reference: int = -1
    cull: float | None = None
    global_align: bool = False
    no_rotation: bool = False
    no_scale: bool = False
    no_shear: bool = False
    no_translation: bool = False
    full_res: bool = False
    min_shift: float = 5.0
    levels: int = 0
    sharpness: float = 4.0
    workers: int = 3
    slab: tuple[int, int] | None = None
    only_slab: bool = False
    recursive_slab: bool = False
    on_slab: SlabCallback | None = None
    interrupt: InterruptCallback | None = None
    canvas_fit: str = "stretch"
    freedoms: dict = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        if self.slab is not None:  # at once, not after the alignment
            check_slab(*self.slab)
        self.freedoms.update(no_rotation=self.no_rotation, no_scale=self.no_scale, no_shear=self.no_shear, no_translation=self.no_translation)


def check_slab(size: int, overlap: int) -> None:
    if size < 2:
        raise ValueError("a slab takes two images or more")
    if not 0 <= overlap < size:
        raise ValueError(f"slabs of {size} images can't share {overlap} of them")


def resolve_images(spark: SparkSession, images) -> tuple[DataFrame, tuple[int, int]]:
    """Frames, and the (width, height) of the first. Of files, only the first two headers are looked at."""
    if isinstance(images, (str, Path)) or not isinstance(images, DataFrame) and len(images := list(images)) >= 2 and not isinstance(images[0], np.ndarray):
        source = str(images) if isinstance(images, (str, Path)) else [str(p) for p in images]
        found = I.probe(spark, source)
        if len(found) < 2:
            raise ValueError(f"two images or more are needed; there are {len(found)}")
        return I.from_files(spark, source), found[0][:2]
    if not isinstance(images, DataFrame):
        if len(images) < 2:
            raise ValueError(f"two images or more are needed; there are {len(images)}")
        return I.from_arrays(spark, images), (images[0].shape[1], images[0].shape[0])
    found = images.select("frame_idx", "width", "height").orderBy("frame_idx").limit(2).collect()
    if len(found) < 2:
        raise ValueError(f"two images or more are needed; there are {len(found)}")
    return images, (found[0]["width"], found[0]["height"])


load_images = resolve_images


def cull_unfocused_images(frames: DataFrame, reference_size: tuple[int, int], threshold: float = 0.05, progress: ProgressCallback | None = None) -> tuple[DataFrame, CullResult]:
    """The frames that are kept (numbered anew from 0), and all scores."""
    width, height = reference_size
    marked = focus.culled(B.scores(frames, height, width), threshold, ["stack_id"])
    rows = marked.join(frames.select("stack_id", "frame_idx", "origin"), ["stack_id", "frame_idx"]).orderBy("frame_idx").select("frame_idx", "origin", "score", "kept").collect()  # a row per image
    entries = [CullEntry(r["origin"] if r["origin"] is not None else r["frame_idx"], r["score"], r["kept"]) for r in rows]
    if progress:
        for i, e in enumerate(entries):
            progress((i + 1) / len(entries), "culling", f"Scored {e.path}: {e.score:.4f}")
    numbers = {r["frame_idx"]: i for i, r in enumerate([r for r in rows if r["kept"]])}
    if len(numbers) < 2:
        raise ValueError("Fewer than 2 images survive culling.")
    return _renumbered(frames, numbers), CullResult(entries, threshold, len(entries) - len(numbers))


def _renumbered(frames: DataFrame, numbers: dict[int, int]) -> DataFrame:
    table = frames.sparkSession.createDataFrame(sorted(numbers.items()), "frame_idx int, number int")
    return frames.join(table, "frame_idx").withColumn("frame_idx", F.col("number")).select(frames.columns)


def _shifted(cfg, spark, steps: dict[int, tuple[np.ndarray, bool]], n: int, reference: int, whole_path: bool = True) -> list[np.ndarray]:
    """Steps to neighbours, composed outwards from the reference; as geometry.chained, for one stack."""
    schema = "stack_id string, frame_idx int, " + ", ".join(f"{c} double" for c in geometry.WARP) + ", converged boolean"
    rows = [("stack", i, *map(float, m.ravel()), bool(ok)) for i, (m, ok) in steps.items()]
    df = geometry.chained(spark.createDataFrame(rows, schema), ["stack_id"], reference, cfg.min_shift, cfg.no_rotation, whole_path, scale=cfg.no_scale, shear=cfg.no_shear, translation=cfg.no_translation)
    found = {r["frame_idx"]: np.array([r[c] for c in geometry.WARP]).reshape(2, 3) for r in df.collect()}
    return [found.get(i, np.eye(2, 3)) for i in range(n)]


def align_images(frames: DataFrame, n: int, size: tuple[int, int], cfg: FocusStackConfig, reference: int, progress: ProgressCallback | None = None) -> list[np.ndarray]:
    """A warp to the reference for each frame. All pairs are estimated in one job; only the small warps are folded in order."""
    spark = frames.sparkSession
    width, height = size
    numbers = frames.select("stack_id", "frame_idx")
    pairs = geometry.global_pairs(numbers, ["stack_id"], reference) if cfg.global_align else geometry.neighbour_pairs(numbers, ["stack_id"], reference)
    found = B.pair_warps(frames, pairs, height, width, cfg.full_res).collect()  # six numbers per image
    steps = {r["frame_idx"]: (np.array([r[c] for c in geometry.WARP]).reshape(2, 3), r["converged"]) for r in found}
    if progress:
        for k, i in enumerate(sorted(steps)):
            progress((k + 1) / len(steps), "aligning", describe(f"Image {i}", steps[i][0]))
    if not cfg.global_align:
        return _shifted(cfg, spark, steps, n, reference)
    out = []
    for i in range(n):
        m, ok = steps.get(i, (np.eye(2, 3), False))
        m = K.constrain(m, **cfg.freedoms)
        quiet = np.hypot(*m[:, 2]) < cfg.min_shift and np.allclose(m[:, :2], np.eye(2), atol=1e-3)
        out.append(np.eye(2, 3) if i == reference or not ok or quiet else m)
    return out


def describe(label: str, m: np.ndarray) -> str:
    return f"{label}: rotation {np.degrees(np.arctan2(m[1, 0], m[0, 0])):+.2f}°  shift ({m[1, 2]:+.1f}, {m[0, 2]:+.1f}) px"


def compute_canvas(warps: Sequence[np.ndarray], src_size: tuple[int, int], keep_size: bool = False, crop: bool = False):
    w, h, moved = K.canvas(list(warps), *src_size, keep_size, crop)
    return (w, h), moved


def fused_frames(frames: DataFrame, warps: Sequence[np.ndarray] | None, levels: int, sharpness: float, canvas_size: tuple[int, int], no_fill: bool = False, fit: str = "stretch", depth: int | None = None) -> DataFrame:
    """A row with the fused image for each stack in frames. warps: by frame_idx."""
    width, height = canvas_size
    if warps is not None and any(not np.array_equal(m, np.eye(2, 3)) for m in warps):
        table = frames.sparkSession.createDataFrame([(i, np.asarray(m, float).ravel().tolist()) for i, m in enumerate(warps)], "frame_idx int, w array<double>")
        frames = frames.join(table, "frame_idx", "left")
    if depth is None:
        depth = I.first_depth(frames)
    levels = levels or fusion.level_count(height, width)
    return B.images(B.frame_sums(frames, height, width, levels, sharpness, not no_fill, fit), depth)


def stack_images(frames: DataFrame, warps: Sequence[np.ndarray] | None, levels: int, sharpness: float, canvas_size: tuple[int, int], no_fill: bool = False, fit: str = "stretch", depth: int | None = None) -> dict[str, np.ndarray]:
    """The fused image of each stack in frames, on the driver. warps: by frame_idx."""
    done = fused_frames(frames, warps, levels, sharpness, canvas_size, no_fill, fit, depth)
    return {r["stack_id"]: I.array(r) for r in done.toLocalIterator()}  # an image per stack, one at a time


def slab_ranges(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    check_slab(size, overlap)
    out, start = [], 0
    while True:
        out.append((start, min(start + size, n)))
        if out[-1][1] == n:
            return out
        start += max(1, size - overlap)


def slab_images(frames: DataFrame, n: int, warps: Sequence[np.ndarray] | None, size: int, overlap: int, levels: int, sharpness: float, canvas_size: tuple[int, int], no_fill: bool = False, only_slab: bool = False, recursive: bool = False, on_slab=None, interrupt=None, progress=None, fit: str = "stretch"):
    """Sub-stacks of a layer are fused in one job; layers follow each other. A list with only_slab, else an image."""
    spark = frames.sparkSession
    depth, layer = I.first_depth(frames), 1
    while True:
        ranges = slab_ranges(n, size, overlap)
        rows = [(k, f"slab_{layer}_{k + 1:03d}", a, b) for k, (a, b) in enumerate(ranges)]
        table = spark.createDataFrame(rows, "slab int, label string, a int, b int")
        owner = table.select("label", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame_idx"))  # equi-join of frames and slabs
        spread = frames.join(owner, "frame_idx").withColumn("stack_id", F.col("label")).drop("label")
        # a layer is fused in one job, and stays in the shared folder; images come to the driver one at a time where asked for
        done = kept(fused_frames(spread, warps, levels, sharpness, canvas_size, no_fill, fit, depth), "slabs").join(table.select(F.col("label").alias("stack_id"), "slab"), "stack_id")
        images = []
        if on_slab or only_slab or len(ranges) == 1:
            for r in done.orderBy("slab").toLocalIterator():
                image = I.array(r)
                if only_slab or len(ranges) == 1:
                    images.append(image)
                if on_slab:
                    on_slab(r["stack_id"], image)
                if interrupt and interrupt():
                    raise Interrupted
        if progress:
            for k in range(len(ranges)):
                progress((k + 1) / len(ranges), "slabbing", f"Layer {layer}: slab {k + 1} of {len(ranges)}")
        if only_slab:
            return images
        if len(ranges) == 1:
            return images[0]
        frames = done.select(F.lit("stack").alias("stack_id"), F.col("slab").alias("frame_idx"), F.lit(None).cast("string").alias("origin"), "width", "height", "n_channels", "depth", "data")
        n, warps, layer = len(ranges), None, layer + 1
        if n <= size or not recursive:
            return next(iter(stack_images(frames, None, levels, sharpness, canvas_size, no_fill, fit, depth).values()))


def pick_reference(reference: int, n: int) -> int:
    if reference < 0:
        return n // 2
    if reference >= n:
        raise ValueError(f"there is no image {reference} to align to: they are numbered 0 to {n - 1}")
    return reference


def run(cfg: FocusStackConfig, progress: ProgressCallback | None = None, spark: SparkSession | None = None) -> RunResult:
    """The whole run. Images are decoded once, into the shared folder. An interrupt cancels the jobs that are running."""
    spark = spark or SparkSession.builder.getOrCreate()
    tell = progress or (lambda *_: None)

    def part(a: float, b: float):
        return lambda f, stage, message: tell(a + f * (b - a), stage, message)

    tell(0.0, "loading", "Loading images")
    with interruptible(spark, cfg.interrupt):
        frames, size = resolve_images(spark, cfg.images)
        frames = kept(frames, "frames")
        if cfg.cull is not None:
            frames, result = cull_unfocused_images(frames, size, cfg.cull, part(0.02, 0.05))
            n = len(result.kept)
            tell(0.05, "culling", f"Culled {result.n_culled} of {len(result.entries)} images")
        else:
            n = frames.count()
        reference = pick_reference(cfg.reference, n)
        warps = [np.eye(2, 3)] * n
        if not cfg.no_align:
            tell(0.08, "aligning", "Aligning images")
            warps = align_images(frames, n, size, cfg, reference, part(0.08, 0.30))
        return fuse(frames, n, size, warps, cfg, part(0.30, 0.95), tell)


def fuse(frames: DataFrame, n: int, size, warps, cfg, progress, tell) -> RunResult:
    """The last part, which streams share: canvas, sub-stacks, fusion."""
    levels = cfg.levels or fusion.level_count(size[1], size[0])
    canvas_size, moved = compute_canvas(warps, size, cfg.keep_size, cfg.crop)
    if cfg.slab:
        recursive = cfg.recursive_slab and not cfg.only_slab
        done = slab_images(frames, n, moved, *cfg.slab, levels, cfg.sharpness, canvas_size, cfg.no_fill, cfg.only_slab, recursive, cfg.on_slab, cfg.interrupt, progress, cfg.canvas_fit)
        tell(1.0, "complete", "Done")
        return RunResult(None, done) if cfg.only_slab else RunResult(done, None)
    progress(0.0, "stacking", "Fusing images")
    image = next(iter(stack_images(frames, moved, levels, cfg.sharpness, canvas_size, cfg.no_fill, cfg.canvas_fit).values()))
    progress(1.0, "stacking", "Fused")
    tell(1.0, "complete", "Done")
    return RunResult(image, None)


