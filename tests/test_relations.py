"""Operators on relations, against the array kernels and against SQL on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackfuse.functions import kernels as K
from stackfuse.operators import focus, fusion, geometry
from stackfuse.operators import spatial as S
from stackfuse.sources import tables as T


def relation(spark, imgs):
    rows = [(i, y, x, float(v)) for i, img in enumerate(imgs) for (y, x), v in np.ndenumerate(img)]
    return spark.createDataFrame(rows, "frame_idx int, y int, x int, v double")


def grid(df, shape, value="v", frame=None):
    out = np.full(shape, np.nan)
    for r in (df.where(F.col("frame_idx") == frame) if frame is not None else df).collect():
        out[r["y"], r["x"]] = r[value]
    return out


@pytest.fixture(scope="module")
def imgs():
    return np.random.default_rng(7).integers(0, 256, (3, 19, 22)).astype(float)


@pytest.fixture(scope="module")
def df(spark, imgs):
    return relation(spark, imgs).cache()


@pytest.mark.parametrize(
    "op, kernel, value, shape",
    [
        (lambda d: S.reduced(d, ["frame_idx"]), K.reduce, "v", (10, 11)),
        (lambda d: S.expanded(d, ["frame_idx"], 37, 44), lambda i: K.expand(i, (37, 44)), "v", (37, 44)),
        (lambda d: fusion.region_energy(d, ["frame_idx"]), K.region_energy, "e", (19, 22)),
        (lambda d: fusion.region_deviation(d, ["frame_idx"]), K.region_deviation, "d", (19, 22)),
        (lambda d: fusion.region_entropy(d, ["frame_idx"]), K.region_entropy, "h", (19, 22)),
        (lambda d: S.sobel_energy(d, ["frame_idx"]), K.sobel_energy, "e", (19, 22)),
        (lambda d: S.area_resized(d, ["frame_idx"], 19, 22, 7, 9), lambda i: K.resize(i, 7, 9), "v", (7, 9)),
        (lambda d: focus.focus_mask(d, ["frame_idx"]), K.focus_mask, "mask", (19, 22)),
    ],
)
def test_relations_equal_kernels(df, imgs, op, kernel, value, shape):
    done = op(df).cache()
    for i in (0, 2):
        assert np.allclose(grid(done, shape, value, i), kernel(imgs[i]), atol=1e-6)


def test_fusion_of_equal_frames_is_the_frame(spark):
    img = np.random.default_rng(1).integers(0, 256, (18, 20)).astype(float)
    done = fusion.fused(relation(spark, [img] * 3), ["frame_idx"], 18, 20, 1)
    assert np.allclose(grid(done, img.shape), img, atol=1e-6)


def test_no_sharpness_gives_the_mean(df, imgs):
    done = fusion.fused(df, ["frame_idx"], 19, 22, 1, sharpness=0.0)
    assert np.allclose(grid(done, imgs[0].shape), imgs.mean(axis=0), atol=1e-6)


def test_order_of_frames_does_not_matter(df, imgs):
    turned = df.withColumn("frame_idx", 2 - F.col("frame_idx"))
    a, b = (grid(fusion.fused(d, ["frame_idx"], 19, 22, 0), imgs[0].shape) for d in (df, turned))
    assert np.allclose(a, b, atol=1e-9)


@pytest.mark.parametrize("light", [False, True])
def test_fusion_never_broadcasts_pixels(spark, df, light):
    """Files of bands are so much smaller than their rows that a broadcast of them, planned by the files, fills the driver."""
    pixels = df.select("*", F.lit(0).alias("c"))
    done = fusion.fused(pixels, ["frame_idx", "c"], 19, 22, 0, light=df if light else None, light_keys=["frame_idx"] if light else None)
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.count() == 19 * 22


def test_frames_without_a_stack_are_left_out(spark, df, imgs):
    """As the joins of the SQL do."""
    stacks = df.select(F.when(F.col("frame_idx") > 0, 7).alias("stack_id"), "frame_idx", "y", "x", "v")
    done = fusion.fused(stacks, ["stack_id", "frame_idx"], 19, 22, 0).cache()
    want = fusion.fused(df.where("frame_idx > 0"), ["frame_idx"], 19, 22, 0)
    assert [r["stack_id"] for r in done.select("stack_id").distinct().collect()] == [7]
    assert np.allclose(grid(done, imgs[0].shape), grid(want, imgs[0].shape), atol=1e-9)


def test_blocks_equal_relations(df, imgs):
    from stackfuse.plans import blocks

    a = grid(fusion.fused(df, ["frame_idx"], 19, 22, 1), imgs[0].shape)
    b = grid(blocks.fuse_pixels(df, 19, 22, 1), imgs[0].shape)
    assert np.allclose(a, b, atol=1e-7)


@pytest.mark.parametrize(
    "scores, threshold, kept",
    [([0.1, 0.5, 0.9], 0.5, [1, 2]), ([0.1, 0.2, 0.3], 0.5, [1, 2]), ([0.0, 0.0], 0.5, [0, 1]), ([0.3, 0.3, 0.3], 0.5, [0, 1]), ([0.1, 0.9, 0.2], 0.5, [1, 2])],
)
def test_cull(spark, scores, threshold, kept):
    rows = spark.createDataFrame(list(enumerate(scores)), "frame_idx int, score double")
    assert sorted(r.frame_idx for r in focus.culled(rows, threshold).where("kept").collect()) == kept


def test_chain_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    steps = {i: (np.eye(2, 3) + rng.normal(0, [[0.002, 0.002, 4]] * 2), i != 4) for i in range(7) if i != 3}
    rows = [(1, i, *m.ravel().tolist(), ok) for i, (m, ok) in steps.items()]
    df = spark.createDataFrame(rows, "stack_id int, frame_idx int, " + ", ".join(f"{c} double" for c in geometry.WARP) + ", converged boolean")
    got = {r.frame_idx: np.array([r[c] for c in geometry.WARP]).reshape(2, 3) for r in geometry.chained(df, ["stack_id"], 3, 5.0, shear=True).collect()}
    want = {3: np.eye(2, 3)}
    for side in (1, -1):
        total = np.eye(2, 3)
        for i in range(3 + side, 7 if side == 1 else -1, side):
            m, ok = steps[i]
            if ok:
                total = K.constrain(K.compose(total, K.constrain(m, no_shear=True)), no_shear=True)
            quiet = ok and np.hypot(*total[:, 2]) < 5 and np.allclose(total[:, :2], np.eye(2), atol=1e-3)
            want[i] = np.eye(2, 3) if quiet else total
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


@pytest.mark.parametrize("limits", [{"rotation": True}, {"scale": True}, {"shear": True}, {"rotation": True, "shear": True}, {"rotation": True, "scale": True, "shear": True, "translation": True}, {"translation": True}])
def test_constraints_equal_the_svd(spark, limits):
    rng = np.random.default_rng(3)
    ms = [np.eye(2, 3) + rng.normal(0, 0.3, (2, 3)) for _ in range(20)]
    df = spark.createDataFrame([(i, *m.ravel().tolist()) for i, m in enumerate(ms)], "frame_idx int, " + ", ".join(f"{c} double" for c in geometry.WARP))
    got = df.select("frame_idx", geometry.constrained(geometry.warp_struct(), **limits).alias("w")).select("frame_idx", "w.*").collect()
    for r in got:
        want = K.constrain(ms[r.frame_idx], **{f"no_{k}": v for k, v in limits.items()})
        assert np.allclose(np.array([r[c] for c in geometry.WARP]).reshape(2, 3), want, atol=1e-8)


def test_order_of_files(spark):
    files = spark.createDataFrame([("b.PNG",), ("a.jpg",), ("c.gif",), ("x.webp",), ("noext",)], "path string")
    assert [r.path for r in T.ordered(files).orderBy("frame_idx").collect()] == ["a.jpg", "b.PNG", "x.webp"]


def test_scan_reads_only_what_it_needs(spark):
    plan = T.raster_grey(spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = {line.strip() for line in plan.splitlines() if line.startswith("ReadSchema")}
    assert schemas and all("l_extendedprice" not in s and "l_comment" not in s for s in schemas)
