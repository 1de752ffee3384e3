"""Whole frames as rows: scores, alignment and fusion for images too large for a row per pixel.

Frames are independent up to the sums, so each task scores or fuses the frames it holds and passes on sums for each level, cut
into blocks of rows; the blocks of a level meet in one aggregation by (stack, level, block). A frame's bytes are never
shuffled but for pairing with a neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import fusion
from ..sources import images as I
from ..sources import tables as T

#: Rows of a level in a block.
BLOCK_ROWS = 256
SUMS = "stack_id string, level int, block int, height int, width int, channels int, n long, se binary, sex binary, sx binary"


def narrow(img: np.ndarray) -> np.ndarray:
    """8 bits of either depth, as floats."""
    return (img >> 8 if img.dtype == np.uint16 else img).astype(float)


def _sized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    return img if img.shape[:2] == (height, width) else K.resize(img.astype(float), height, width)


def scores(frames: DataFrame, height: int, width: int) -> DataFrame:
    """stack_id, frame_idx, score: one pass, no shuffle."""

    def work(batches):
        for b in batches:
            for r in b.to_pylist():
                grey = K.grey(np.floor(_sized(narrow(I.array(r)), height, width)))
                yield pa.RecordBatch.from_pydict({"stack_id": [r["stack_id"]], "frame_idx": pa.array([r["frame_idx"]], pa.int32()), "score": pa.array([K.focus_score(grey)], pa.float64())})

    return frames.mapInArrow(work, "stack_id string, frame_idx int, score double")


WARPS = "stack_id string, frame_idx int, neighbour_idx int, a00 double, a01 double, tx double, a10 double, a11 double, ty double, converged boolean"


def pair_warps(frames: DataFrame, pairs: DataFrame, height: int, width: int, full: bool = False) -> DataFrame:
    """The warp of each frame to its neighbour: pairs (stack_id, frame_idx, neighbour_idx). All pairs at once, as none needs
    another's result. Only grey images meet in the joins."""

    def greys(batches):
        for b in batches:
            for r in b.to_pylist():
                grey = np.floor(K.grey(np.floor(_sized(narrow(I.array(r)), height, width)))).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"stack_id": [r["stack_id"]], "frame_idx": pa.array([r["frame_idx"]], pa.int32()), "grey": pa.array([grey.tobytes()], pa.binary())})

    def work(batches):
        for b in batches:
            for r in b.to_pylist():
                ref, src = (np.frombuffer(r[c], np.uint8).reshape(height, width).astype(float) for c in ("other", "grey"))
                m, ok = K.aligned(ref, src, full)
                flat = m.ravel().tolist()
                yield pa.RecordBatch.from_pydict(
                    {"stack_id": [r["stack_id"]], "frame_idx": pa.array([r["frame_idx"]], pa.int32()), "neighbour_idx": pa.array([r["neighbour_idx"]], pa.int32()), **{c: pa.array([v], pa.float64()) for c, v in zip(("a00", "a01", "tx", "a10", "a11", "ty"), flat, strict=True)}, "converged": [ok]}
                )

    grey = frames.mapInArrow(greys, "stack_id string, frame_idx int, grey binary")
    other = grey.select("stack_id", F.col("frame_idx").alias("neighbour_idx"), F.col("grey").alias("other"))
    both = pairs.join(grey, ["stack_id", "frame_idx"]).join(other, ["stack_id", "neighbour_idx"])
    return both.select("stack_id", "frame_idx", "neighbour_idx", "grey", "other").mapInArrow(work, WARPS)


#: Groups of tasks whose sums are merged first.
FAN = 16


def _rows(acc: dict) -> pa.RecordBatch:
    """The sums of a task as blocks of rows."""
    rows = []
    for (stack, level), (se, sex, sx, n) in acc.items():
        for k, a in enumerate(range(0, len(se), BLOCK_ROWS)):
            part = slice(a, a + BLOCK_ROWS)
            rows.append((stack, level, k, len(se[part]), se.shape[1], sex.shape[2], n, se[part].tobytes(), sex[part].tobytes(), sx[part].tobytes()))
    kinds = (pa.string(), *(pa.int32(),) * 5, pa.int64(), *(pa.binary(),) * 3)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SUMS.split(", ")])


def _accumulate(acc: dict, stack: str, img: np.ndarray, white: int, levels: int, sharpness: float) -> None:
    light = K.lightness(img, white) if img.shape[2] == 3 else img[:, :, 0]
    weights = K.weights(K.pyramid(light, levels), sharpness)
    for level, (band, e) in enumerate(zip(K.pyramid(img, levels), weights, strict=True)):
        own = acc.setdefault((stack, level), [np.zeros_like(e), np.zeros_like(band), np.zeros_like(band), 0])
        own[0] += e
        own[1] += e[:, :, None] * band
        own[2] += band
        own[3] += 1


def frame_sums(frames: DataFrame, height: int, width: int, levels: int, sharpness: float = 4.0, fill: bool = True, fit: str = "stretch", most: int = 4) -> DataFrame:
    """Sums of all frames; with warp columns (w: six numbers) each frame is moved first.

    fit: frames of another size than the canvas are stretched to it before they are moved, or ('pad') moved as they are.
    most: stacks whose sums a task holds at once; frames should come stack by stack.
    """
    moved = "w" in frames.columns

    def work(batches):
        acc: dict = {}
        for b in batches:
            for r in b.to_pylist():
                img = I.array(r).astype(float)
                m = np.array(r["w"]).reshape(2, 3) if moved and r["w"] is not None else None
                if m is None or fit == "stretch":
                    img = _sized(img, height, width)
                if m is not None and (not np.array_equal(m, np.eye(2, 3)) or img.shape[:2] != (height, width)):
                    img = K.warp(img, m, height, width, fill)
                if not any(s == r["stack_id"] for s, _ in acc) and len({s for s, _ in acc}) >= most:
                    yield _rows(acc)
                    acc = {}
                _accumulate(acc, r["stack_id"], img, 65535 if r["depth"] == 16 else 255, levels, sharpness)
        if acc:
            yield _rows(acc)

    return frames.mapInArrow(work, SUMS)


def _merged(table: pa.Table) -> pa.Table:
    """Blocks of one place of a level, summed in a fixed order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["se"], r["sex"]))
    total = {c: np.frombuffer(rows[0][c], float).copy() for c in ("se", "sex", "sx")}
    for r in rows[1:]:
        for c, v in total.items():
            v += np.frombuffer(r[c], float)
    done = rows[0] | {c: v.tobytes() for c, v in total.items()} | {"n": sum(r["n"] for r in rows)}
    return pa.Table.from_pylist([done], schema=table.schema)


def merged(sums: DataFrame) -> DataFrame:
    """Sums of all tasks by place, in two steps: first those of some tasks, so that no group holds what every task has made."""
    some = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("stack_id", "level", "block", "part").applyInArrow(lambda t: _merged(t.drop_columns(["part"])), SUMS)
    return some.groupBy("stack_id", "level", "block").applyInArrow(_merged, SUMS)


def _finished(depth: int | None):
    def work(table: pa.Table) -> pa.Table:
        """One image out of all blocks of a stack."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["level"], r["block"]))
        bands = []
        for level in sorted({r["level"] for r in rows}):
            own = [r for r in rows if r["level"] == level]
            se = np.concatenate([np.frombuffer(r["se"], float).reshape(r["height"], r["width"]) for r in own])
            sex, sx = (np.concatenate([np.frombuffer(r[c], float).reshape(r["height"], r["width"], r["channels"]) for r in own]) for c in ("sex", "sx"))
            bands.append(K.finish(se, sex, sx, own[0]["n"]))
        img = K.collapse(bands)
        if depth is None:
            data, bits = img.tobytes(), 64
        else:
            data, bits = np.clip(img, 0, 65535 if depth == 16 else 255).astype(np.uint16 if depth == 16 else np.uint8).tobytes(), depth
        kinds = pa.schema([("stack_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("depth", pa.int32()), ("data", pa.binary())])
        return pa.Table.from_pylist([{"stack_id": rows[0]["stack_id"], "width": img.shape[1], "height": img.shape[0], "n_channels": img.shape[2], "depth": bits, "data": data}], schema=kinds)

    return work


def images(sums: DataFrame, depth: int | None) -> DataFrame:
    """An image per stack: stack_id, width, height, n_channels, depth, data; depth None keeps float64."""
    return merged(sums).groupBy("stack_id").applyInArrow(_finished(depth), "stack_id string, width int, height int, n_channels int, depth int, data binary")


def fuse_pixels(pixels: DataFrame, height: int, width: int, levels: int | None = None, sharpness: float = 4.0) -> DataFrame:
    """Relations of grey pixels through blocks: (frame_idx, y, x, v) to (y, x, v)."""
    levels = fusion.level_count(height, width) if levels is None else levels

    def gather(table: pa.Table) -> pa.Table:
        img = np.zeros((height, width, 1))
        img[table.column("y").to_numpy(), table.column("x").to_numpy(), 0] = table.column("v").to_numpy()
        acc: dict = {}
        _accumulate(acc, "stack", img, 255, levels, sharpness)
        return pa.Table.from_batches([_rows(acc)])

    done = images(pixels.groupBy("frame_idx").applyInArrow(gather, SUMS), None)

    def spread(batches):
        for b in batches:
            for r in b.to_pylist():
                img = np.frombuffer(r["data"], float).reshape(r["height"], r["width"])
                y, x = np.mgrid[0 : img.shape[0], 0 : img.shape[1]]
                yield pa.RecordBatch.from_pydict({"y": pa.array(y.ravel().astype(np.int32)), "x": pa.array(x.ravel().astype(np.int32)), "v": pa.array(img.ravel())})

    return done.mapInArrow(spread, "y int, x int, v double")


# ---- known shifts and warps, recovered


def _scene(seed: int, size: int = 96) -> np.ndarray:
    rng = np.random.default_rng(seed)
    img = rng.standard_normal((size, size))
    for _ in range(2):
        img = K.along(K.along(img, K.TAPS, 0), K.TAPS, 1)
    return np.clip(img * 60 / img.std() + 128, 0, 255)


def known_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' numbers as shifts of a random scene: what was put in and what phase correlation finds (rounded)."""
    rows = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case"), (F.col("n_nationkey") % 7 - 3).cast("int").alias("dx"), (F.col("n_nationkey") * 3 % 11 - 5).cast("int").alias("dy"))

    def work(batches: Sequence[pd.DataFrame]):
        for b in batches:
            found = []
            for case, dx, dy in zip(b.case, b.dx, b.dy, strict=True):
                src = _scene(int(case))
                found.append(K.phase_shift(np.roll(src, (dy, dx), (0, 1)), src))
            yield b.assign(found_x=[round(x) for x, _ in found], found_y=[round(y) for _, y in found])

    return rows.mapInPandas(work, "case int, dx int, dy int, found_x int, found_y int")


def known_affines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warps of the test chains put on a random scene: whether alignment finds them to a tenth of a pixel."""
    rows = T.affine_steps(spark, sf_dir).withColumn("w", F.array("a00", "a01", "tx", "a10", "a11", "ty")).select("stack_id", "frame_idx", "w")

    def work(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = np.array(r["w"]).reshape(2, 3)
                src = _scene(100 + r["stack_id"] * 5 + r["frame_idx"], 160)
                ref = np.floor(K.warp(src, m, 160, 160, cubic=True) + 0.5)
                found, ok = K.aligned(ref, np.floor(src + 0.5))
                corners = np.array([[20, 20, 1], [140, 20, 1], [20, 140, 1], [140, 140, 1]]).T
                out.append(bool(ok) and float(np.abs((found - m) @ corners).max()) < 0.1)
            yield pa.RecordBatch.from_pydict({"stack_id": b.column("stack_id"), "frame_idx": b.column("frame_idx"), "found": pa.array(out)})

    return rows.mapInArrow(work, "stack_id int, frame_idx int, found boolean")


