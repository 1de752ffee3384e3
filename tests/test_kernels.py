"""Array kernels: hand-made cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackfuse import compute_canvas, compute_levels
from stackfuse.functions import kernels as K
from stackfuse.plans import run as R
from stackfuse.sources import images as I


def scene(seed, h=97, w=131):
    img = np.random.default_rng(seed).standard_normal((h, w))
    for _ in range(2):
        img = K.along(K.along(img, K.TAPS, 0), K.TAPS, 1)
    return np.clip(img * 60 / img.std() + 128, 0, 255)


@pytest.mark.parametrize("side, levels", [(8, 0), (16, 0), (17, 1), (32, 1), (33, 1), (34, 2), (64, 2), (1024, 6)])
def test_levels(side, levels):
    assert compute_levels((side, 2000)) == levels


def test_reduce_of_constant_and_impulse():
    assert np.allclose(K.reduce(np.full((5, 7), 3.0)), 3) and K.reduce(np.zeros((5, 7))).shape == (3, 4)
    img = np.zeros((9, 9))
    img[4, 4] = 256
    assert K.reduce(img)[2, 2] == 36 and K.reduce(img)[1, 2] == 6


def stuffed_expand(img, shape):
    """From the definition: zeros between pixels, convolved."""
    h, w = img.shape
    wide = np.zeros((2 * h, 2 * w))
    wide[::2, ::2] = img
    return K.separable(wide, K.TAPS * 2, K.TAPS * 2)[: shape[0], : shape[1]]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 99))
def test_expand_is_the_stuffed_filter(h, w, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float)
    shape = (2 * h - seed % 2, 2 * w)
    assert np.allclose(K.expand(img, shape), stuffed_expand(img, shape))


@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (97, 131), (33, 64, 3)])
def test_collapse_undoes_the_pyramid(shape):
    img = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    assert np.allclose(K.collapse(K.pyramid(img, 3)), img, atol=1e-9)


def test_even_window_reaches_back_four():
    img = np.zeros((20, 20))
    img[10, 10] = 64
    mean = K.box(img, 8)
    assert np.isclose(mean[7, 10], 1) and np.isclose(mean[14, 10], 1) and np.isclose(mean[6, 10], 0) and np.isclose(mean[15, 10], 0)


def test_no_energy_gives_the_plain_mean():
    zero = np.zeros((4, 4))
    assert np.allclose(K.finish(zero, np.zeros((4, 4, 1)), np.full((4, 4, 1), 30.0), 3), 10)


def test_even_images_score_0():
    assert K.focus_score(np.zeros((40, 40))) == 0.0


def test_sharper_scores_higher():
    sharp = scene(2)
    soft = K.separable(sharp, K.gaussian(15), K.gaussian(15))
    assert K.focus_score(np.floor(sharp)) > K.focus_score(np.floor(soft))


@pytest.mark.parametrize("dx, dy", [(3, -5), (0, 0), (-7, 2)])
def test_phase_shift(dx, dy):
    src = scene(3)
    x, y = K.phase_shift(np.roll(src, (dy, dx), (0, 1)), src)
    assert abs(x - dx) < 0.2 and abs(y - dy) < 0.2


def test_ecc_finds_an_affine_warp():
    src = scene(4, 160, 160)
    m = np.array([[1.004, 0.002, 3.3], [-0.002, 0.998, -2.6]])
    found, ok = K.aligned(np.floor(K.warp(src, m, 160, 160, cubic=True)), np.floor(src))
    corners = np.array([[20, 20, 1], [140, 20, 1], [20, 140, 1], [140, 140, 1]]).T
    assert ok and np.abs((found - m) @ corners).max() < 0.1


def test_what_does_not_align_is_the_identity():
    m, ok = K.aligned(np.zeros((64, 64)), scene(5, 64, 64))
    assert not ok and np.array_equal(m, np.eye(2, 3))


def test_constraints():
    iso = np.array([[1.1 * np.cos(0.1), -1.1 * np.sin(0.1), 4], [1.1 * np.sin(0.1), 1.1 * np.cos(0.1), 5]])
    assert np.allclose(K.constrain(iso, True, True, True, True), np.eye(2, 3))
    aniso = np.array([[2.0, 0, 4], [0, 0.5, 5]])
    assert np.allclose(K.constrain(aniso, True, True, True, True), [[2, 0, 0], [0, 0.5, 0]])
    assert K.constrain(aniso) is aniso
    assert np.allclose(K.compose(np.eye(2, 3), iso), iso)


def test_canvas():
    warps = [np.eye(2, 3), np.array([[1, 0, 5.0], [0, 1, -3.0]])]
    (w, h), moved = compute_canvas(warps, (20, 10))
    assert (w, h) == (25, 13) and np.allclose(moved[0][:, 2], [0, 3])
    assert compute_canvas(warps, (20, 10), crop=True)[0] == (15, 7)
    assert compute_canvas(warps, (20, 10), keep_size=True)[0] == (20, 10)
    apart = [np.eye(2, 3), np.array([[1, 0, 50.0], [0, 1, 0.0]])]
    assert compute_canvas(apart, (20, 10), crop=True)[0] == (70, 10)  # nothing is shared: around all


def test_slab_ranges():
    assert R.slab_ranges(7, 3, 1) == [(0, 3), (2, 5), (4, 7)]
    assert R.slab_ranges(8, 3, 1) == [(0, 3), (2, 5), (4, 7), (6, 8)]
    assert R.slab_ranges(2, 5, 1) == [(0, 2)]
    for size, overlap in ((1, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            R.slab_ranges(7, size, overlap)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 2, 3, 4]), st.booleans(), st.integers(0, 99))
def test_png_round_trip(h, w, channels, wide, seed):
    img = np.random.default_rng(seed).integers(0, 65536 if wide else 256, (h, w, channels)).astype(np.uint16 if wide else np.uint8)
    assert np.array_equal(I.decode_png(I.encode_png(img)), img)


def test_png_filters():
    import struct
    import zlib

    img = np.random.default_rng(0).integers(0, 256, (10, 6, 3)).astype(np.uint8)
    rows, above = [], np.zeros(18, int)
    for i, line in enumerate(img.reshape(10, 18).astype(int)):
        left, corner = np.concatenate([[0, 0, 0], line[:-3]]), np.concatenate([[0, 0, 0], above[:-3]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][i % 5]
        rows.append(bytes([i % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    raw = I.encode_png(img)
    body = zlib.compress(b"".join(rows))
    at = raw.index(b"IDAT") - 4
    size = struct.unpack(">I", raw[at : at + 4])[0]
    raw = raw[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + raw[at + 8 + size :]
    assert np.array_equal(I.decode_png(raw), img)


@pytest.mark.parametrize("raw", [b"", b"not an image", I.MAGIC + b"xx"])
def test_damaged_files_raise(raw):
    with pytest.raises(ValueError):
        I.decode_png(raw)
