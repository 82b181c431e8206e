"""Pictures: files written byte by byte here and read back; resampling against sums in fractions; the search for an axis mirror by mirror."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillwork.operators import decode, image
from quillwork.sources import io


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def packed(rows, depth):
    """Rows of samples as bytes."""
    if depth == 16:
        return rows.astype(">u2").reshape(len(rows), -1).view(np.uint8)
    if depth == 8:
        return rows.reshape(len(rows), -1).astype(np.uint8)
    flat = rows.reshape(len(rows), -1)
    return np.packbits(((flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(len(rows), -1).astype(np.uint8), axis=1)


def filtered(rows, unit, way):
    out, before = b"", [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        kind = y % 5 if way is None else way
        line = []
        for x, v in enumerate(row):
            left, up, corner = (row[x - unit] if x >= unit else 0), before[x], (before[x - unit] if x >= unit else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
        before = row
    return out


def as_png(pixels, colour, depth, interlaced=False, palette=None, way=None):
    """pixels: (h, w, channels)."""
    h, w, c = pixels.shape
    unit, body = max(1, c * depth // 8), b""
    for x0, y0, dx, dy in decode.PASSES if interlaced else ((0, 0, 1, 1),):
        part = pixels[y0::dy, x0::dx]
        if part.size:
            body += filtered(packed(part, depth), unit, way)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, colour, 0, 0, int(interlaced)])
    z = zlib.compress(body)
    return decode.PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


def luma(p):
    return ((p[..., 0].astype(int) * 19595 + p[..., 1].astype(int) * 38470 + p[..., 2].astype(int) * 7471 + 32768) >> 16).astype(np.uint8)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png(colour, depth, interlaced):
    r = np.random.default_rng(colour * 20 + depth)
    for h, w in ((1, 1), (7, 13), (16, 9)):
        pixels = r.integers(0, 1 << depth, (h, w, decode.CHANNELS[colour]))
        palette = r.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        got = decode.png(as_png(pixels, colour, depth, interlaced, palette))
        eight = pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1)) if depth < 8 else pixels
        want = luma(palette[pixels[..., 0]]) if colour == 3 else luma(eight) if colour in (2, 6) else eight[..., 0]
        assert (got == want).all() and got.shape == (h, w)


@pytest.mark.parametrize("way", range(5))
def test_png_filters(way):
    pixels = np.random.default_rng(way).integers(0, 256, (9, 6, 3))
    assert (decode.png(as_png(pixels, 2, 8, way=way)) == luma(pixels)).all()


def test_damaged():
    good = as_png(np.zeros((2, 2, 1), int), 0, 8)
    with pytest.raises(ValueError):
        decode.decoded(good[:40] + bytes([good[40] ^ 1]) + good[41:])
    with pytest.raises(ValueError):
        decode.decoded(b"\xff\xd8\xff\xe0 a JPEG")


def test_pnm():
    r = np.random.default_rng(4)
    p, q = r.integers(0, 256, (3, 5)), r.integers(0, 256, (3, 5, 3))
    text = lambda a: " ".join(map(str, a.ravel().tolist())).encode()
    assert (decode.pnm(b"P2\n# a remark\n5 3\n255\n" + text(p)) == p).all() and (decode.pnm(b"P5 5 3 255\n" + p.astype(np.uint8).tobytes()) == p).all()
    assert (decode.pnm(b"P3 5 3 255 " + text(q)) == luma(q)).all() and (decode.pnm(b"P6\n5 3\n255\n" + q.astype(np.uint8).tobytes()) == luma(q)).all()
    assert decode.pnm(b"P2 2 1 15 15 7").tolist() == [[255, 119]] and decode.pnm(b"P5 1 1 65535\n\x80\x00").tolist() == [[128]] and decode.pnm(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]


def exact(row, new):
    """A row resampled in fractions: weights of a triangle, normalised."""
    size = len(row)
    scale = Fraction(size, new)
    wide = max(scale, Fraction(1))
    out = []
    for i in range(new):
        c = (i + Fraction(1, 2)) * scale
        w = [max(Fraction(0), 1 - abs((k + Fraction(1, 2) - c) / wide)) for k in range(size)]
        out.append(sum(a * b for a, b in zip(w, row)) / sum(w))
    return out


def test_resampling():
    r = np.random.default_rng(6)
    img = r.integers(0, 256, (4, 37)).astype(np.uint8)
    for new in (5, 11, 20, 36):
        got = decode._resampled(img, new)
        want = np.array([[float(x) for x in exact([int(v) for v in row], new)] for row in img])
        assert np.abs(got - want).max() <= 0.5 + 1e-3
    big = np.full((1200, 1600), 77, np.uint8)
    assert decode.bounded(big).shape == (600, 800) and (decode.bounded(big) == 77).all() and decode.bounded(big[:800, :700]).shape == (800, 700)


def test_folder_to_features(spark, tmp_path):
    """A folder of pictures goes through the scan to the features of the arrays that were written."""
    r = np.random.default_rng(7)
    made = {}
    for k in range(4):
        img = (np.tile(r.integers(0, 256, 6), 4)[None, :] * np.ones((30, 1))).astype(np.uint8) ^ r.integers(0, 16, (30, 24)).astype(np.uint8)
        made[f"p{k}.{'PNG' if k % 2 else 'pgm'}"] = img
        (tmp_path / f"p{k}.{'PNG' if k % 2 else 'pgm'}").write_bytes(as_png(img[:, :, None], 0, 8) if k % 2 else b"P5 24 30 255\n" + img.tobytes())
    (tmp_path / "notes.txt").write_text("no picture")
    got = image.extract(image.decoded(io.scan_images(spark, str(tmp_path))), rho_step=4, step=1, lag=2).collect()
    assert {x["image"] for x in got} == set(made)
    for x in got:
        want = image.features(made[x["image"]].astype(np.float32) / np.float32(255), rho_step=4, step=1, lag=2)
        assert all(math.isclose(x[k], v, rel_tol=1e-6, abs_tol=1e-7) for k, v in want.items())


def test_axis_mirror_by_mirror():
    r = np.random.default_rng(8)
    half = r.random((20, 10)).astype(np.float32)
    e = np.concatenate([half, half[:, ::-1]], 1)
    every = [(image.reflection_score(e, float(t), float(rho), 2), float(t), float(rho)) for t in np.deg2rad(np.arange(-15, 15 + 1e-9, 3.0)) for rho in np.arange(-math.hypot(20, 20), math.hypot(20, 20), 2, dtype=np.float32)]
    top = max(s for s, _, _ in every)
    first = next(x for x in every if x[0] == top)
    theta, rho, score = image.best_axis(e, 3.0, 2, 2)
    assert (score, theta, rho) == first
