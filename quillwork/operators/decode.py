"""Pictures from bytes: PNG (all colour types and depths, interlaced too) and PNM, grey as 8 bits, and resampling to a bounded size."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np

# Fixed values of the formats.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Weights of red, green and blue in a grey value, in 65,536ths.
LUMA = (19595, 38470, 7471)
#: Bits of a resampling weight, and the longer side at most.
PRECISION, MOST = 22, 800


def grey(pixels: np.ndarray) -> np.ndarray:
    """8-bit grey of 8-bit pixels (h, w, channels): one channel as it is, three by their weights; a second or fourth is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return ((pixels[:, :, :3].astype(np.uint32) @ np.array(LUMA, np.uint32) + 0x8000) >> 16).astype(np.uint8)


def unfiltered(data: bytes, rows: int, stride: int, unit: int) -> np.ndarray:
    """The bytes of rows of a PNG once the filter that each row names is undone: none, left, above, their mean, or the nearest of left,
    above and above left to their plane. What hangs on the left goes byte by byte of a pixel; the rest is a row at once."""
    raw = np.frombuffer(data, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        way, row, above = int(raw[y, 0]), raw[y, 1:], out[y]
        if way == 0:
            out[y + 1] = row
        elif way == 1:
            for k in range(min(unit, stride)):
                out[y + 1, k::unit] = np.cumsum(row[k::unit], dtype=np.uint8)
        elif way == 2:
            out[y + 1] = row + above
        elif way in (3, 4):
            now, up, new = row.tolist(), above.tolist(), [0] * stride
            for x in range(stride):
                left, corner = (new[x - unit], up[x - unit]) if x >= unit else (0, 0)
                if way == 3:
                    guess = (left + up[x]) >> 1
                else:
                    plane = left + up[x] - corner
                    guess = min((abs(plane - left), 0, left), (abs(plane - up[x]), 1, up[x]), (abs(plane - corner), 2, corner))[2]
                new[x] = (now[x] + guess) & 255
            out[y + 1] = new
        else:
            raise ValueError(f"unknown row filter {way}")
    return out[1:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(h, width, channels) of packed samples; 16 bits keep the upper eight."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * channels].reshape(len(rows), width, channels)


def png(content: bytes) -> np.ndarray:
    """Grey 8-bit values of a PNG file. Checksums are checked; chunks that a picture doesn't need are skipped."""
    at, body, palette, head = len(PNG), [], None, None
    while at + 8 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        own = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + own) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            head = own
        elif kind == b"PLTE":
            palette = np.frombuffer(own, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(own)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("the PNG has no header")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    channels = CHANNELS[colour]
    data, unit = zlib.decompress(b"".join(body)), max(1, channels * depth // 8)
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * channels * depth + 7) // 8
        out[y0::dy, x0::dx] = _samples(unfiltered(data[at : at + h * (stride + 1)], h, stride, unit), w, channels, depth)
        at += h * (stride + 1)
    if colour == 3:
        return grey(palette[out[:, :, 0]])
    return grey(out if depth >= 8 else (out * np.uint8(255 // ((1 << depth) - 1))))


_HEAD = re.compile(rb"(P[2-6])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)")


def pnm(content: bytes) -> np.ndarray:
    """Grey 8-bit values of a PGM or PPM file, plain or binary (P2, P3, P5, P6), or a binary bitmap (P4)."""
    head = _HEAD.match(content)
    if not head:
        raise ValueError("not a PNM file")
    kind, width, height, at = head[1], int(head[3]), int(head[5]), head.end()
    if kind == b"P4":
        rows = np.frombuffer(content, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    top = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(content, at)
    most, at = int(top[1]), top.end()
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", content[at:]).split(), np.uint32)[: height * width * channels]
    else:
        values = np.frombuffer(content, ">u2" if most > 255 else np.uint8, height * width * channels, at + 1).astype(np.uint32)
    scaled = values if most == 255 else (values * 255 + most // 2) // most
    return grey(scaled.astype(np.uint8).reshape(height, width, channels))


def _weights(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of new places: the first of the old ones that count there, and their whole-number weights (a triangle as wide as the
    places it spans)."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    first = np.maximum((centre - wide + 0.5).astype(np.int64), 0)
    after = np.minimum((centre + wide + 0.5).astype(np.int64), size)
    k = first[:, None] + np.arange(int(math.ceil(wide)) * 2 + 1)[None, :]
    w = np.where(k < after[:, None], np.maximum(1.0 - np.abs((k - centre[:, None] + 0.5) / wide), 0.0), 0.0)
    return first, np.floor(w / w.sum(1, keepdims=True) * (1 << PRECISION) + 0.5).astype(np.int64)


def _resampled(img: np.ndarray, new: int) -> np.ndarray:
    """img with each row resampled to new values, rounded to 8 bits."""
    first, weights = _weights(img.shape[1], new)
    wide = np.pad(img, ((0, 0), (0, weights.shape[1]))).astype(np.int64)
    total = np.full((len(img), new), 1 << (PRECISION - 1), np.int64)
    for k in range(weights.shape[1]):
        total += wide[:, first + k] * weights[:, k]
    return np.clip(total >> PRECISION, 0, 255).astype(np.uint8)


def bounded(img: np.ndarray, most: int = MOST) -> np.ndarray:
    """img, its longer side at most `most`: along rows, then along columns."""
    h, w = img.shape
    scale = max(h, w) / most
    if scale <= 1:
        return img
    new_w, new_h = int(round(w / scale)), int(round(h / scale))
    across = _resampled(img, new_w) if new_w != w else img
    return _resampled(across.T, new_h).T if new_h != h else across


def decoded(content: bytes, most: int = MOST) -> np.ndarray:
    """Grey 8-bit values of a PNG or PNM file, at most `most` a side. Other formats (JPEG) are an error."""
    return bounded(png(content) if content.startswith(PNG) else pnm(content), most)
