"""Stacks whose frames arrive one after another.

FrameStream keeps frames in a folder and holds only what the next frame needs: the last grey image and the preview's sums.
Structured Streaming fuses many stacks at once: the state of a stack is the running sums of its fused image, never a frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K
from ..operators import fusion
from ..plans import blocks as B
from ..plans import run as R
from ..session import shared
from ..sources import images as I
from ..sources import tables as T

PreviewCallback = Callable[[np.ndarray, int], None]


class FrameStream:
    """Push frames with add_image, then finish. Each is scored and aligned to the one before it as it comes.

    All frames are aligned and culled afterwards, so chains pass through culled frames. chain 'strict' binds the freedoms to
    steps only; 'batch' binds them to the path as well, as run does. compat_preview divides plain sums by the number of
    levels + 1 instead of the number of images.
    """

    def __init__(
        self,
        reference_size: tuple[int, int],
        reference: int = -1,
        cull_threshold: float | None = None,
        no_rotation: bool = False,
        no_scale: bool = False,
        no_shear: bool = False,
        no_translation: bool = False,
        full_res: bool = False,
        min_shift: float = 5.0,
        levels: int = 0,
        sharpness: float = 4.0,
        no_fill: bool = False,
        workers: int = 3,
        slab: tuple[int, int] | None = None,
        only_slab: bool = False,
        recursive_slab: bool = False,
        on_slab=None,
        on_preview: PreviewCallback | None = None,
        preview_scale: float = 0.25,
        chain: str = "strict",
        compat_preview: bool = False,
        spark: SparkSession | None = None,
    ):
        self.size, self.cull_threshold, self.chain, self.compat = reference_size, cull_threshold, chain, compat_preview
        self.config = R.FocusStackConfig(
            None, no_fill=no_fill, reference=reference, no_rotation=no_rotation, no_scale=no_scale, no_shear=no_shear, no_translation=no_translation, full_res=full_res, min_shift=min_shift, levels=levels, sharpness=sharpness, workers=workers, slab=slab, only_slab=only_slab, recursive_slab=recursive_slab, on_slab=on_slab
        )
        self.on_preview, self.scale = on_preview, min(1.0, max(0.05, preview_scale))
        self.spark = spark or SparkSession.builder.getOrCreate()
        T.importable(self.spark)
        self.at = f"{shared(self.spark)}/frames-{uuid.uuid4().hex}"
        self.scores: list[float] = []
        self.steps: list[tuple[np.ndarray, bool]] = []
        self.last = None
        self.path = np.eye(2, 3)
        self.sums: dict = {}
        self.white = 255

    def add_image(self, image: np.ndarray) -> None:
        width, height = self.size
        if image.shape[:2] != (height, width):
            raise ValueError(f"the stream has images of {width} x {height}; this one has {image.shape[1]} x {image.shape[0]}")
        i = len(self.scores)
        grey = K.grey(B.narrow(image))
        self.scores.append(K.focus_score(grey))
        most = 2**31 if self.config.full_res else min(1024, max(grey.shape))
        prep = K.prepared(grey, most)
        step, ok = np.eye(2, 3), False
        if self.last is not None:
            step, ok = K.aligned(self.last[0], grey, self.config.full_res, self.last[1], prep)
            self.steps.append((step, ok))
        self.last = (grey, prep)
        frame = self.spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in I.record("stack", i, None, image))], I.FRAMES)
        frame.coalesce(1).write.mode("append").parquet(self.at)
        if self.on_preview:
            if ok:
                self.path = K.compose(self.path, K.constrain(step, **self.config.freedoms))
            self._add_preview(image)
            self.on_preview(self.get_preview(), i + 1)

    def _add_preview(self, image: np.ndarray) -> None:
        self.white = 65535 if image.dtype == np.uint16 else 255
        h, w = (max(1, round(n * self.scale)) for n in image.shape[:2])
        small = K.resize(image.astype(float), h, w)
        m = self.path.copy()
        m[:, 2] *= self.scale
        if not np.array_equal(m, np.eye(2, 3)):
            small = K.warp(small, m, h, w, not self.config.no_fill)
        B._accumulate(self.sums, "preview", small, self.white, self.config.levels or fusion.level_count(h, w), self.config.sharpness)

    def get_preview(self) -> np.ndarray | None:
        """The image so far in 8 bits; None without a preview callback or a frame."""
        if not self.on_preview or not self.sums:
            return None
        levels = len(self.sums)
        bands = [K.finish(se, sex, sx, levels if self.compat else n) for _, (se, sex, sx, n) in sorted(self.sums.items(), key=lambda kv: kv[0][1])]
        return np.clip(K.collapse(bands) / (257 if self.white == 65535 else 1), 0, 255).astype(np.uint8)

    def flush_preview(self) -> None:
        """Nothing waits: previews are made as frames come."""

    def finish(self, keep_size: bool = False, crop: bool = False, progress=None) -> R.RunResult:
        import dataclasses

        n = len(self.scores)
        if n < 2:
            raise ValueError(f"two images or more are needed; there are {n}")
        kept = list(range(n))
        if self.cull_threshold is not None and max(self.scores) > 0:
            kept = [i for i in kept if self.scores[i] >= self.cull_threshold]
            if len(kept) < 2:
                best = sorted(range(n), key=lambda i: (-self.scores[i], i))[:2]
                kept = sorted({*kept, *best})
        reference = kept[len(kept) // 2] if self.config.reference < 0 else R.pick_reference(self.config.reference, n)
        frames = self.spark.read.schema(I.FRAMES).parquet(self.at)
        steps = {i + 1: s for i, s in enumerate(self.steps) if i + 1 > reference}
        if reference:  # the other way, afresh: the inverse of a step isn't what alignment finds
            pairs = self.spark.range(reference).select(F.lit("stack").alias("stack_id"), F.col("id").cast("int").alias("frame_idx"), (F.col("id") + 1).cast("int").alias("neighbour_idx"))
            for r in B.pair_warps(frames, pairs, self.size[1], self.size[0], self.config.full_res).collect():
                steps[r["frame_idx"]] = (np.array([r[c] for c in R.geometry.WARP]).reshape(2, 3), r["converged"])
        warps = R._shifted(self.config, self.spark, steps, n, reference, self.chain == "batch")
        cfg = dataclasses.replace(self.config, keep_size=keep_size, crop=crop)
        tell = progress or (lambda *_: None)
        return R.fuse(R._renumbered(frames, {i: k for k, i in enumerate(kept)}), len(kept), self.size, [warps[i] for i in kept], cfg, tell, tell)


StreamingFocusStacker = FrameStream


# ---- Structured Streaming


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, and reads its last results: a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number:09d}")  # the same batch again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a table may be one file or a folder of them."""
    T.importable(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*")


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per cell of a stream of events, as they stand at its end: updates of a streaming aggregation, the last for each
    cell."""
    counts = T.event_cells(_stream(spark, sf_dir, "events"))
    keys = ["stack_id", "frame_idx", "y", "x"]
    updates = _drained(counts, "update")
    return updates.groupBy(*keys).agg(F.max_by("v", "batch").alias("v"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as they come, as frames of 8 x 8 pixels: stack_id, vec_id, pixels."""
    return _stream(spark, sf_dir, "embeddings").select(F.col("label").alias("stack_id"), "vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("double")).alias("pixels"))


def _fuse_frames(side: int, sharpness: float):
    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Adds frames to a stack's sums (energy, energy times value, value, count) and returns the image so far."""
        kept = state.get if state.exists else None
        acc = {}
        if kept:
            se, sex, sx = (np.frombuffer(bytes(x)).reshape(side, side) for x in kept[:3])
            acc[("stack", 0)] = [se.copy(), sex.reshape(side, side, 1).copy(), sx.reshape(side, side, 1).copy(), kept[3]]
        for b in batches:
            for pixels in b.sort_values("vec_id")["pixels"]:
                B._accumulate(acc, "stack", np.asarray(pixels, float).reshape(side, side, 1), 255, 0, sharpness)
        se, sex, sx, n = acc[("stack", 0)]
        state.update((se.tobytes(), sex.tobytes(), sx.tobytes(), n))
        image = K.finish(se, sex, sx, n)[:, :, 0]
        y, x = np.mgrid[0:side, 0:side]
        yield pd.DataFrame({"stack_id": key[0], "y": y.ravel(), "x": x.ravel(), "v": image.ravel(), "n": n})

    return work


def _fused_updates(spark: SparkSession, sf_dir: str, sharpness: float = 4.0) -> DataFrame:
    """The images of all stacks after each batch of a stream; one shuffle of the frames, by stack."""
    grouped = _vectors(spark, sf_dir).groupBy("stack_id")
    return grouped.applyInPandasWithState(_fuse_frames(8, sharpness), "stack_id int, y int, x int, v double, n long", "se binary, sex binary, sx binary, n long", "update", GroupStateTimeout.NoTimeout)


def stack_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stacks fused by a stateful operator as their frames arrive: the images at the stream's end."""
    updates = _drained(_fused_updates(spark, sf_dir), "update")
    return updates.groupBy("stack_id", "y", "x").agg(F.max_by("v", "batch").alias("v"))


def stack_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames each of these stacks has at the stream's end, and the mean of its image."""
    updates = _drained(_fused_updates(spark, sf_dir), "update").withColumn("v", F.round("v", 9))
    last = updates.groupBy("stack_id", "y", "x").agg(F.max_by("v", "batch").alias("v"), F.max("n").alias("n"))
    return last.groupBy("stack_id").agg(F.max("n").alias("n"), F.avg("v").alias("mean"))
