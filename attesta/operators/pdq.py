"""Perceptual hashes of pictures with numpy, in Arrow batches, and the sampling of animation frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID, KEPT, SIDE, FRAME_PIXELS = 64, 16, 8192, 50_000_000
INTERVAL_MS, SAME_FRAME, MOST_FRAMES = 1000, 2, 16
_BASIS = np.sqrt(2 / GRID) * np.cos(np.pi / 2 / GRID * np.outer(np.arange(1, KEPT + 1), 2 * np.arange(GRID) + 1))


def _smooth(plane: np.ndarray, axis: int) -> np.ndarray:
    """Moving average over about 1/128 of the axis, windows shrinking at the edges."""
    n = plane.shape[axis]
    window = max(1, -(-n // (2 * GRID)))
    ahead = (window + 2) // 2 - 1
    total = np.cumsum(np.insert(plane, 0, 0, axis=axis), axis=axis, dtype=np.float64)
    end = np.minimum(np.arange(n) + ahead + 1, n)
    start = np.maximum(np.arange(n) + ahead + 1 - window, 0)
    width = (end - start).reshape([-1 if a == axis else 1 for a in range(plane.ndim)])
    return (np.take(total, end, axis) - np.take(total, start, axis)) / width


def hash_of(dct: np.ndarray) -> str:
    """64 hex digits: a bit per coefficient above the lower median, the last row first."""
    bits = dct > np.sort(dct, axis=None)[KEPT * KEPT // 2 - 1]
    words = (bits * (1 << np.arange(KEPT))).sum(1)
    return "".join(f"{int(w):04x}" for w in words[::-1])


def transform(luma: np.ndarray) -> tuple[int, np.ndarray]:
    """Quality (0 to 100) and the low coefficients of a plane of luma."""
    for _ in range(2):
        luma = _smooth(_smooth(luma, 1), 0)
    rows, columns = (np.minimum(((np.arange(GRID) + 0.5) * n / GRID).astype(int), n - 1) for n in luma.shape)
    grid = luma[np.ix_(rows, columns)]
    steps = sum(int(np.abs(np.trunc(np.diff(grid, axis=a) * 100 / 255)).sum()) for a in (0, 1))
    return min(100, steps // 90), _BASIS @ grid @ _BASIS.T


def fingerprint(rgba: np.ndarray) -> dict:
    """Hash, quality, hash over black (where not opaque) and both mirrors of a picture (rows, columns, 4)."""
    if not rgba.size:
        return {"pdq": "0" * 64, "quality": 0, "black": None, "mirrors": ["0" * 64] * 2}
    scale = -(-max(rgba.shape[:2]) // 512)
    rgba = rgba[: rgba.shape[0] // scale * scale or None, : rgba.shape[1] // scale * scale or None].astype(np.float64)
    if scale > 1 and min(rgba.shape[:2]) >= scale:
        rgba = rgba.reshape(rgba.shape[0] // scale, scale, rgba.shape[1] // scale, scale, 4).mean((1, 3))
    gray, alpha = rgba[..., :3] @ [0.299, 0.587, 0.114], rgba[..., 3] / 255
    quality, dct = transform(gray * alpha + 255 * (1 - alpha))
    black = hash_of(transform(gray * alpha)[1]) if (alpha < 1).any() else None
    odd = np.where(np.arange(KEPT) % 2, 1, -1)
    return {"pdq": hash_of(dct), "quality": quality, "black": black, "mirrors": [hash_of(dct * odd), hash_of(dct * odd[:, None])]}


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Pixels (rows, columns, channels) of filtered lines. What needs both the left and the upper pixel is undone along antidiagonals: all their pixels at once."""
    height, width, channels = lines.shape
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # a row above and a column to the left, of zeros
    out[1:, 1:] = lines
    y = 0
    while y < height:
        kind = kinds[y]
        if kind == 1:
            out[y + 1, 1:] = np.cumsum(out[y + 1, 1:], axis=0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (out[y + 1, 1:] + out[y, 1:]) & 255
        elif kind:
            end = y
            while end < height and kinds[end] >= 3:
                end += 1
            average = kinds[y:end] == 3
            for d in range(end - y + width - 1):
                r = np.arange(max(0, d - width + 1), min(end - y, d + 1))
                row, column = y + 1 + r, 1 + d - r
                left, above, corner = out[row, column - 1], out[row - 1, column], out[row - 1, column - 1]
                to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
                nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
                out[row, column] = (out[row, column] + np.where(average[r][:, None], (left + above) // 2, nearest)) & 255
            y = end
            continue
        y += 1
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """8-bit grey, RGB or RGBA PNG without interlacing as (rows, columns, 4); None for anything else or what exceeds the limits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    width, height, depth, colour, _, _, interlace = struct.unpack_from(">LLBBBBB", data, 16)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace or not (0 < width <= SIDE and 0 < height <= SIDE and width * height <= FRAME_PIXELS):
        return None
    from attesta.operators.metadata import png_chunks

    stride = width * channels
    raw = zlib.decompressobj().decompress(b"".join(d for k, d in png_chunks(data) if k == b"IDAT"), (stride + 1) * height)
    if len(raw) < (stride + 1) * height:
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, channels))
    pixels = out
    if channels < 3:
        grey, alpha = pixels[..., :1], pixels[..., 1:] if channels == 2 else np.full((height, width, 1), 255, np.uint8)
        return np.concatenate([grey, grey, grey, alpha], 2)
    return pixels if channels == 4 else np.concatenate([pixels, np.full((height, width, 1), 255, np.uint8)], 2)


def fingerprints(files: DataFrame, key: Column, content: Column) -> DataFrame:
    """``key``, ``pdq``, ``quality``, ``black`` and ``mirrors`` per file; nulls where a file can't be decoded, never a failure."""
    arrow = pa.schema([("key", pa.string()), ("pdq", pa.string()), ("quality", pa.int32()), ("black", pa.string()), ("mirrors", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {}
                try:
                    picture = decode_png(data.as_py() or b"")
                    found = fingerprint(picture) if picture is not None else {}
                except (ValueError, zlib.error, struct.error, MemoryError):
                    pass
                yield pa.RecordBatch.from_pylist([dict.fromkeys(arrow.names) | {"key": k} | found], schema=arrow)

    return files.select(key.cast("string").alias("key"), content.alias("content")).mapInArrow(run, "key string, pdq string, quality int, black string, mirrors array<string>")


def sampled(times: Column, interval: Column) -> Column:
    """Of an array of times, ascending, those kept greedily: the first, then each at least an interval after the last kept."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(times, empty, lambda kept, t: F.when((F.size(kept) == 0) | (t >= F.get(kept, F.size(kept) - 1) + interval), F.array_append(kept, t)).otherwise(kept))


def sampled_rows(frames: DataFrame, key: str, time: str, interval: int) -> DataFrame:
    """As :func:`sampled` over rows: (``key``, ``time``) of the frames kept of each key, in one pass over sorted rows whatever a key has.

    Rows are sorted within partitions of whole keys and only the last time kept is held. Null keys or times are passed over.
    """
    schema = f"{key} {frames.schema[key].dataType.simpleString()}, {time} long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, due = None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keep.append(k != last_key or t >= due)
                if keep[-1]:
                    last_key, due = k, t + interval
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = frames.select(key, F.col(time).cast("long").alias(time)).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, schema)


def lead_frame(frames: Column) -> Column:
    """Of an array of (hash, quality) in order the first with a quality of at least 50, else the first."""
    return F.coalesce(F.get(F.filter(frames, lambda f: f["quality"] >= 50), F.lit(0)), F.get(frames, F.lit(0)))


def changed_frames(hashes: Column) -> Column:
    """Of an array of hashes those that differ by more than two bits from the last kept, at most 16."""
    from attesta.functions.hashing import hamming

    empty = F.array().cast("array<string>")
    return F.aggregate(hashes, empty, lambda kept, h: F.when((F.size(kept) < MOST_FRAMES) & F.coalesce(hamming(F.get(kept, F.size(kept) - 1), h) > SAME_FRAME, F.lit(True)), F.array_append(kept, h)).otherwise(kept))
