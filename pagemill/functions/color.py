"""Colours: hexadecimal and HSL forms as native expressions, dominant colours of images.

Palette, by our own definition: the image is sampled to about down_size_to pixels, pixels fall into the eight octants of the RGB cube,
every octant's mean is a colour, octants below the share small_bucket are left out, the fullest come first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.packing import once


class ImageLoadError(Exception):
    """An image that can't be read."""


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb; fractions are rounded half up, values outside 0 to 255 set to the nearer end."""
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("bigint"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def rgb_hsl(r: Column, g: Column, b: Column) -> Column:
    """[hue in degrees, saturation and lightness in percent] as array<float>."""
    x, y, z = (c.cast("double") / 255 for c in (r, g, b))
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    span, light = top - low, (top + low) / 2
    turn = F.when(span == 0, 0.0).when(top == x, F.pmod((y - z) / span, F.lit(6.0))).when(top == y, (z - x) / span + 2).otherwise((x - y) / span + 4)
    sat = F.when(span == 0, 0.0).otherwise(F.try_divide(span, 1 - F.abs(2 * light - 1)))
    return F.array((turn * 60).cast("float"), (sat * 100).cast("float"), (light * 100).cast("float"))


def decode(data: bytes) -> np.ndarray:
    """Pixels of a PNG, BMP or binary PPM as rows of r, g, b; transparency is dropped."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:2] == b"P6":
            head = data.split(maxsplit=4)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(data[len(data) - w * h * 3 :], np.uint8).reshape(-1, 3)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
        raise ImageLoadError(f"the image can't be read: {e}") from e
    raise ImageLoadError("an unknown kind of image")


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    w, h, depth, color, _, _, laced = head
    if laced:
        raise ValueError("interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, stride = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    raw, rows, before = zlib.decompress(body), [], bytearray(stride)
    for y in range(h):
        way, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for i in range(stride if way else 0):
            a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            if way == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = {1: a, 2: b, 3: (a + b) // 2}[way]
            line[i] = (line[i] + near) & 255
        rows.append(line)
        before = line
    grid = np.array(rows, np.uint8).reshape(h, stride)
    if depth == 16:
        grid = grid[:, ::2]
    elif depth < 8:
        grid = np.unpackbits(grid, axis=1)[:, : w * channels * depth].reshape(h, -1, depth)
        grid = (grid * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        if color == 0:
            grid = grid * (255 // ((1 << depth) - 1))
    pixels = grid.reshape(-1, channels)
    return palette[pixels[:, 0]] if color == 3 else np.repeat(pixels[:, :1], 3, 1) if color in (0, 4) else pixels[:, :3]


def _bmp(data: bytes) -> np.ndarray:
    start, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits not in (24, 32):
        raise ValueError(f"{bits} bits")
    stride, n = (w * bits // 8 + 3) // 4 * 4, bits // 8
    grid = np.frombuffer(data[start : start + stride * abs(h)], np.uint8).reshape(abs(h), stride)[:, : w * n]
    return grid.reshape(-1, n)[:, 2::-1]


def dominant(data: bytes, has_alpha: bool = False, down_size_to: float = 10_000.0, small_bucket: float = 0.01) -> list[list[float]]:
    """The palette of an image. has_alpha has no effect, pixels are always read as three channels."""
    return dominant_pixels(decode(data), down_size_to, small_bucket)


def dominant_pixels(pixels: np.ndarray, down_size_to: float = 10_000.0, small_bucket: float = 0.01) -> list[list[float]]:
    """The palette of rows of r, g, b."""
    step = max(1, int(len(pixels) // max(1.0, down_size_to)))
    sample = pixels[::step].astype(np.int64)
    if not len(sample):
        return []
    octant = (sample[:, 0] >> 7) * 4 + (sample[:, 1] >> 7) * 2 + (sample[:, 2] >> 7)
    counts = np.bincount(octant, minlength=8)
    order = sorted((o for o in range(8) if counts[o] and counts[o] / len(sample) >= small_bucket), key=lambda o: (-counts[o], o))
    return [[float(np.float32(v // counts[o])) for v in sample[octant == o].sum(0)] for o in order]


def palette(data: Column, has_alpha: bool = False, down_size_to: float = 10_000.0, small_bucket: float = 0.01, lenient: bool = False) -> Column:
    """dominant over a binary column; lenient gives null for images that can't be read instead of failing."""

    def run(images: pa.Array) -> pa.Array:
        out = []
        for x in images.to_pylist():
            try:
                out.append(None if x is None else dominant(x, has_alpha, down_size_to, small_bucket))
            except ImageLoadError:
                if not lenient:
                    raise
                out.append(None)
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    run.__annotations__ = {"images": pa.Array, "return": pa.Array}
    return once(run, "array<array<float>>")(data)


def decoded_palette(pixels: Column, channels: Column, down_size_to: float = 10_000.0, small_bucket: float = 0.01) -> Column:
    """The palette of images that Spark has decoded: BGR bytes of 3 or 4 channels, or grey ones of 1; null for other images."""

    def run(data: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for x, n in zip(data.to_pylist(), counts.to_pylist()):
            grid = None if x is None or n not in (1, 3, 4) else np.frombuffer(x, np.uint8).reshape(-1, n)
            out.append(None if grid is None else dominant_pixels(np.repeat(grid, 3, 1) if n == 1 else grid[:, 2::-1], down_size_to, small_bucket))
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    run.__annotations__ = {"data": pa.Array, "counts": pa.Array, "return": pa.Array}
    return once(run, "array<array<float>>")(pixels, channels)
