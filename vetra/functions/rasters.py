"""Bytes of an image file to grey pixels, and grey pixels to an encoder's input; small helpers that run inside tasks."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

#: The formats taken, and the guard on the area, which is judged before anything is decoded.
FORMATS = ("PNG", "JPEG", "WEBP", "TIFF", "BMP", "PGM", "PPM")
MOST_PIXELS = 50_000_000
#: Mean and deviation of the three channels an encoder expects; its patch.
MEANS = (0.485, 0.456, 0.406)
DEVIATIONS = (0.229, 0.224, 0.225)
PATCH = 14


class BadImage(ValueError):
    """What is wrong with an image, in words for its row."""


def image_format(data: bytes) -> str | None:
    """The format by the first bytes; None where they are of no image."""
    starts = {b"\x89PNG\r\n\x1a\n": "PNG", b"\xff\xd8\xff": "JPEG", b"BM": "BMP", b"II*\0": "TIFF", b"MM\0*": "TIFF", b"P5": "PGM", b"P6": "PPM", b"GIF87a": "GIF", b"GIF89a": "GIF"}
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    return next((name for start, name in starts.items() if data.startswith(start)), None)


def guard(width: int, height: int, most: int) -> None:
    if width <= 0 or height <= 0:
        raise BadImage("no pixels")
    if width * height > most:
        raise BadImage(f"over {most} pixels")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Rounded luminance of (height, width) or (height, width, channels) bytes; an alpha channel is left out."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    # in 16 fixed bits, so equal channels give that value
    weights = np.array([19595, 38470, 7471], dtype=np.uint32)
    return ((pixels[:, :, :3].astype(np.uint32) @ weights + 32768) >> 16).astype(np.uint8)


def read_pnm(data: bytes, most: int) -> np.ndarray:
    """PGM (P5) and PPM (P6) of one byte a value."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise BadImage("not a readable image")
        fields.append(int(data[at:end]))
        at = end
    (width, height, top), channels = fields, 3 if data[:2] == b"P6" else 1
    guard(width, height, most)
    if not 0 < top < 256:
        raise BadImage("not a readable image")
    body = np.frombuffer(data, dtype=np.uint8, offset=min(at + 1, len(data)))
    if len(body) < width * height * channels:
        raise BadImage("truncated or corrupted")
    pixels = body[: width * height * channels].reshape((height, width, channels) if channels == 3 else (height, width))
    return pixels if top == 255 else (np.minimum(pixels, top).astype(np.uint32) * 255 // top).astype(np.uint8)


def read_bmp(data: bytes, most: int) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits."""
    if len(data) < 54:
        raise BadImage("truncated or corrupted")
    begin, head, width, height, _, bits, packed, _, _, _, colours = struct.unpack("<10xIIiiHHIIiiI", data[:50])
    guard(width, abs(height), most)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise BadImage("a kind of BMP that is not read")
    stride = (width * bits // 8 + 3) // 4 * 4
    if len(data) < begin + stride * abs(height):
        raise BadImage("truncated or corrupted")
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=begin).reshape(abs(height), stride)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if bits == 8:
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * (colours or 256), offset=14 + head).reshape(-1, 4)
        if pixels.max() >= len(palette):
            raise BadImage("truncated or corrupted")
        pixels = palette[pixels[:, :, 0]]
    pixels = pixels[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _unfilter(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five row filters of PNG; ``rows`` is (height, bytes a row)."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), dtype=np.uint8)
    for i, (kind, row) in enumerate(zip(kinds, rows)):
        above, now = out[i], out[i + 1]
        if kind == 0:
            now[:] = row
        elif kind == 2:
            now[:] = row + above
        elif kind == 1:  # sums along the row, a channel at a time
            for b in range(bpp):
                now[b::bpp] = np.cumsum(row[b::bpp], dtype=np.uint8)
        elif kind in (3, 4):
            left = np.zeros(bpp, dtype=np.int32)
            corner = np.zeros(bpp, dtype=np.int32)
            for at in range(0, len(row), bpp):
                up = above[at : at + bpp].astype(np.int32)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    near = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
                left = (row[at : at + bpp] + guess) & 255
                now[at : at + bpp] = left
                corner = up
        else:
            raise BadImage("truncated or corrupted")
    return out[1:]


def read_png(data: bytes, most: int) -> np.ndarray:
    """PNG of 1 to 16 bits in rows, with every checksum held against its chunk; interlaced files are not read."""
    at, packed, palette, head = 8, [], None, None
    while True:
        if at + 12 > len(data):
            raise BadImage("truncated or corrupted")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise BadImage("truncated or corrupted")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            guard(head[0], head[1], most)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise BadImage("not a readable image")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if interlaced or channels is None or depth not in (1, 2, 4, 8, 16):
        raise BadImage("a kind of PNG that is not read")
    stride = (width * channels * depth + 7) // 8
    want = height * (stride + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), want)  # no more than the header allows
    except zlib.error as e:
        raise BadImage("truncated or corrupted") from e
    if len(raw) < want:
        raise BadImage("truncated or corrupted")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, stride + 1)
    rows = _unfilter(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            rows = rows * (255 // (2**depth - 1))
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise BadImage("truncated or corrupted")
        return palette[pixels[:, :, 0]]
    return pixels


READERS = {"PNG": read_png, "BMP": read_bmp, "PGM": read_pnm, "PPM": read_pnm}


def decode(data: bytes, readers: dict | None = None, most: int = MOST_PIXELS) -> tuple[str, np.ndarray]:
    """Format and grey pixels, (height, width) bytes. ``readers`` adds format -> callable(data, most) for what isn't read here."""
    if not data:
        raise BadImage("empty")
    kind = image_format(data)
    if kind is None:
        raise BadImage("not a readable image")
    if kind not in FORMATS:
        raise BadImage(f"unsupported format {kind}")
    reader = (READERS | (readers or {})).get(kind)
    if reader is None:
        raise BadImage(f"no reader for {kind}")
    try:
        return kind, np.ascontiguousarray(grey(reader(data, most)))
    except BadImage:
        raise
    except Exception as e:  # a broken file is a row with an error, whatever a reader makes of it
        raise BadImage("truncated or corrupted") from e


@lru_cache(maxsize=64)
def cubic_taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights, both (m, taps), of the cubic filter (a = -0.5) from n to m cells; stretched where it shrinks."""
    scale = n / m
    wide = max(scale, 1.0)
    middle = (np.arange(m) + 0.5) * scale
    first = np.floor(middle - 2 * wide + 0.5).astype(np.int64)
    places = first[:, None] + np.arange(int(np.ceil(4 * wide)) + 2)
    x = np.abs((places + 0.5 - middle[:, None]) / wide)
    weight = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    weight[(places < 0) | (places >= n)] = 0
    return np.clip(places, 0, n - 1), weight / weight.sum(axis=1, keepdims=True)


def _along(pixels: np.ndarray, m: int) -> np.ndarray:
    """Columns resized to m, to bytes again; a tap at a time, so no more than one image of reals is held."""
    places, weight = cubic_taps(pixels.shape[1], m)
    out = np.zeros((len(pixels), m))
    for t in range(places.shape[1]):
        out += pixels[:, places[:, t]] * weight[:, t]
    return np.clip(np.floor(np.round(out, 6) + 0.5), 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic, first along the rows and then along the columns, rounded to bytes in between."""
    return _along(_along(pixels, width).T, height).T


def pad_to_square(pixels: np.ndarray) -> np.ndarray:
    """Centred in a square of the rounded mean; nothing is cut off."""
    height, width = pixels.shape
    side = max(height, width)
    out = np.full((side, side), np.floor(pixels.mean() + 0.5), dtype=np.uint8)
    out[(side - height) // 2 :, (side - width) // 2 :][:height, :width] = pixels
    return out


def analysis_size(height: int, width: int, short: int = 224) -> tuple[int, int]:
    """Height and width with the short side at ``short``; the other is rounded half to even."""
    scale = short / min(height, width)
    return round(height * scale), round(width * scale)


def model_input(pixels: np.ndarray, size: int) -> np.ndarray:
    """(3, size, size) of float32: padded, resized, normalised by channel."""
    if size < PATCH or size % PATCH:
        raise ValueError(f"the input size must be a multiple of {PATCH}")
    square = resize(pad_to_square(pixels), size, size).astype(np.float32) / np.float32(255)
    return np.stack([(square - np.float32(m)) / np.float32(d) for m, d in zip(MEANS, DEVIATIONS)])
