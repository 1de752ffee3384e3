"""Whole runs over synthetic stacks: arrays, folders, streams, the command line."""

import numpy as np
import pytest

import stackfuse as S
from stackfuse import cli
from stackfuse.functions import kernels as K
from stackfuse.sources import images as I


@pytest.fixture(scope="module")
def stack():
    """Five frames, each sharp in one band, moved by three pixels each; and the sharp scene."""
    rng = np.random.default_rng(0)
    base = np.stack([K.along(K.along(rng.standard_normal((80, 120)), K.TAPS, 0), K.TAPS, 1) for _ in range(3)], 2)
    base = np.clip(base * 200 + 128, 0, 255)
    out = []
    for i in range(5):
        img = base.copy()
        for y in range(0, 80, 16):
            if y // 16 != i:
                part = img[y : y + 16]
                for _ in range(3):
                    part = K.along(K.along(part, K.TAPS, 0), K.TAPS, 1)
                img[y : y + 16] = part
        out.append(np.clip(np.roll(img, (i - 2) * 3, 1), 0, 255).astype(np.uint8))
    return base, out


def error(img, base):
    return np.abs(img[8:-8, 16:-16].astype(float) - base[8:-8, 16:-16]).mean()


def test_run_folder_stream_agree(spark, stack, tmp_path):
    base, imgs = stack
    seen = []
    done = S.run(S.FocusStackConfig(imgs, keep_size=True, min_shift=1.0), lambda f, stage, m: seen.append((f, stage)), spark).image
    assert done.dtype == np.uint8 and error(done, base) < min(error(i, base) for i in imgs) / 3
    assert seen[0] == (0.0, "loading") and seen[-1] == (1.0, "complete")
    for i, img in enumerate(imgs):
        I.write(img, tmp_path / f"im{i}.PNG", 95, spark)
    again = S.run(S.FocusStackConfig(str(tmp_path), keep_size=True, min_shift=1.0), None, spark).image
    assert np.array_equal(done, again)
    previews = []
    stream = S.StreamingFocusStacker((120, 80), min_shift=1.0, on_preview=lambda img, n: previews.append((img.shape, n)), preview_scale=0.5, spark=spark)
    for img in imgs:
        stream.add_image(img)
    assert previews == [((40, 60, 3), n) for n in range(1, 6)]
    assert np.array_equal(stream.finish(keep_size=True).image, done)
    with pytest.raises(ValueError):
        stream.add_image(imgs[0][:-1])


def test_sixteen_bits(spark, stack):
    imgs = [i.astype(np.uint16) * 257 for i in stack[1][:2]]
    done = S.run(S.FocusStackConfig(imgs, no_align=True), None, spark).image
    assert done.dtype == np.uint16 and done.max() > 255


def test_slabs(spark, stack):
    labels = []
    done = S.run(S.FocusStackConfig(stack[1], no_align=True, slab=(2, 1), only_slab=True, on_slab=lambda label, img: labels.append(label)), None, spark)
    assert done.image is None and len(done.slabs) == 4 and labels == [f"slab_1_{i:03d}" for i in range(1, 5)]
    one = S.run(S.FocusStackConfig(stack[1], no_align=True, slab=(2, 0), recursive_slab=True), None, spark).image
    assert one.shape == (80, 120, 3)


def test_cull(spark, stack):
    frames, size = S.resolve_images(spark, stack[1])
    kept, result = S.cull_unfocused_images(frames, size, 1e9)
    assert len(result.kept) == 2 and result.n_culled == 3 and sorted(r.frame_idx for r in kept.collect()) == [0, 1]


def test_errors(spark, stack, tmp_path):
    with pytest.raises(ValueError):
        S.run(S.FocusStackConfig(stack[1][:1]), None, spark)
    with pytest.raises(ValueError):
        S.run(S.FocusStackConfig(stack[1], reference=5), None, spark)
    with pytest.raises(ValueError):
        S.FocusStackConfig(stack[1], slab=(1, 0))
    with pytest.raises(S.Interrupted):
        S.run(S.FocusStackConfig(stack[1], no_align=True, interrupt=lambda: True), None, spark)
    assert cli.main([str(tmp_path / "nothing")]) == 1
    assert cli.main(["--formats"]) == 0 and cli.main(["--version"]) == 0


def test_an_interrupt_cancels_running_jobs(spark):
    import time

    from stackfuse.session import interruptible

    began = time.time()
    with pytest.raises(S.Interrupted), interruptible(spark, lambda: time.time() - began > 1):
        spark.range(2, numPartitions=2).mapInPandas(lambda bs: [time.sleep(60)] and iter(()), "id long").count()
    assert time.time() - began < 30
    assert spark.range(3).count() == 3


def test_listed_files_of_one_name(spark, stack, tmp_path):
    for d, img in zip("ba", stack[1], strict=False):
        I.write(img, tmp_path / d / "im age.tif", 95, spark)
    frames, size = S.resolve_images(spark, [str(tmp_path / "b" / "im age.tif"), str(tmp_path / "a" / "im age.tif")])
    got = [I.array(r) for r in frames.orderBy("frame_idx").collect()]
    assert size == (120, 80) and all(np.array_equal(x, y) for x, y in zip(got, stack[1][:2], strict=True))


def test_sixteen_bit_tiff(spark, stack, tmp_path):
    imgs = [(i.astype(np.uint16) * 257) ^ 5 for i in stack[1][:2]]
    for i, img in enumerate(imgs):
        I.write(img, tmp_path / f"{i}.tiff", 95, spark)
    frames, _ = S.resolve_images(spark, str(tmp_path))
    assert all(np.array_equal(I.array(r), imgs[r.frame_idx]) for r in frames.collect())


def _tiff(img, packed, predictor=1, order="<"):
    import struct
    import zlib

    h, w, c = img.shape
    if predictor == 2:
        img = np.concatenate([img[:, :1], img[:, 1:] - img[:, :-1]], axis=1)
    data = img.astype(f"{order}u{img.dtype.itemsize}").tobytes()
    if packed == 8:
        data = zlib.compress(data)
    elif packed == 32773:
        data = b"".join(bytes([len(x) - 1]) + x for x in (data[i : i + 100] for i in range(0, len(data), 100)))
    elif packed == 5:
        bits, width, table, word = "", 9, {bytes([i]): i for i in range(256)}, b""
        put = lambda code: format(code, f"0{width}b")
        bits = put(256)
        n = 258
        for b in data:
            if word + bytes([b]) in table:
                word += bytes([b])
                continue
            bits += put(table[word])
            table[word + bytes([b])] = n
            n += 1
            width = min(12, n.bit_length())
            word = bytes([b])
            if n == 4094:
                bits += put(table[word]) + put(256)
                table, n, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
        bits += (put(table[word]) if word else "") + put(257)
        bits += "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8 * img.dtype.itemsize), (259, 3, packed), (262, 3, 2 if c > 1 else 1), (273, 4, 8), (277, 3, c), (279, 4, len(data)), (317, 3, predictor)]
    table = struct.pack(order + "H", len(tags))
    for tag, kind, value in tags:
        table += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data))
    return head + data + table + struct.pack(order + "I", 0)


@pytest.mark.parametrize("packed", [1, 5, 8, 32773])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_packed_tiff(packed, kind):
    img = (np.random.default_rng(packed).integers(0, 6, (50, 60, 3)) * 40).astype(kind)
    for predictor, order in ((1, "<"), (2, ">")):
        raw = _tiff(img, packed, predictor, order)
        assert np.array_equal(I.decode_tiff(raw), img) and I.header(raw) == (60, 50, 16 if kind is np.uint16 else 8)
    with pytest.raises(ValueError):
        I.decode_tiff(raw[:40])


def test_headers(spark, stack, tmp_path):
    I.write(stack[1][0], tmp_path / "a.jpg", 95, spark)
    I.write(stack[1][0].astype(np.uint16), tmp_path / "b.png", 95, spark)
    assert I.probe(spark, str(tmp_path)) == [(120, 80, 8), (120, 80, 16)]
    with pytest.raises(ValueError):
        I.header(b"nothing")


def test_streamed_command_line(spark, stack, tmp_path):
    for i, img in enumerate(stack[1][:3]):
        I.write(img, tmp_path / f"{i}.png", 95, spark)
    assert cli.main([str(tmp_path), "--streaming", "--keep-size", "--min-shift", "1", "--preview-dir", str(tmp_path / "p"), "--output", str(tmp_path / "o" / "out.png")]) == 0
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["preview_001.jpg", "preview_002.jpg", "preview_003.jpg"] and (tmp_path / "o" / "out.png").stat().st_size > 1000
    done = S.stack(tmp_path, tmp_path / "o" / "whole.png", slab=(2, 1), only_slab=True, spark=spark)
    assert len(done.slabs) == 2 and sorted(p.name for p in (tmp_path / "o" / "stackfuse_slabs").iterdir()) == ["slab_1_001.tiff", "slab_1_002.tiff"]


def test_jpeg_and_tiff(spark, stack, tmp_path):
    I.write(stack[1][0], tmp_path / "a.jpg", 95, spark)
    I.write(stack[1][1], tmp_path / "b.tiff", 95, spark)
    frames, size = S.resolve_images(spark, str(tmp_path))
    a, b = (I.array(r) for r in frames.orderBy("frame_idx").collect())
    assert size == (120, 80) and np.array_equal(b, stack[1][1]) and np.abs(a.astype(float) - stack[1][0]).mean() < 12
