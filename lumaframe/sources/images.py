"""Image and RAW files: folder scans, decoding and encoding without native libraries.

Files are read through Spark's binary source, so that any file system works; pixels
are decoded inside the Arrow stage that uses them and never shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions.arrow import flat_map_rows
from lumaframe.functions.exprs import scene_name_parts
from lumaframe.operators.order import first_wins

_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # Fixed value: start of every PNG file
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
# Numeric element types of a level 5 MAT file.
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MAT_MATRIX, _MAT_COMPRESSED = 14, 15


def decode_png(data: bytes) -> np.ndarray:
    """An 8- or 16-bit grey or RGB(A) PNG as H x W x 3 doubles in [0, 1]; raises ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[3] not in _CHANNELS or head[2] not in (8, 16) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, depth, colour = head[:4]
    step = _CHANNELS[colour] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise ValueError("broken PNG") from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("broken PNG")
    lines = raw.reshape(height, width * step + 1)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        row, how = lines[y, 1:].astype(np.int64), lines[y, 0]
        if how == 0:
            now = row
        elif how == 2:
            now = (row + above) & 255
        elif how == 1:
            now = np.cumsum(row.reshape(width, step), axis=0).ravel() & 255
        else:
            now = np.zeros(width * step, np.int64)
            for x in range(width * step):
                left = now[x - step] if x >= step else 0
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    base = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v, b=base: abs(b - v))
                now[x] = (row[x] + guess) & 255
        out[y], above = now, now
    if depth == 16:
        values = out.reshape(height, width, -1, 2).astype(np.float64)
        image = (values[..., 0] * 256 + values[..., 1]) / 65_535
    else:
        image = out.reshape(height, width, -1) / 255.0
    return np.repeat(image[..., :1], 3, axis=2) if image.shape[2] < 3 else image[..., :3]


def encode_png(image: np.ndarray) -> bytes:
    """H x W x 3 as an 8-bit RGB PNG; values are scaled by 255 if none exceeds 1."""
    scale = 255.0 if image.size == 0 or image.max() <= 1 else 1.0
    pixels = np.clip(np.rint(image * scale), 0, 255).astype(np.uint8)
    height, width = pixels.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_mat(data: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a little-endian level 5 MAT file, by name."""
    if len(data) < 128 or data[126:128] != b"IM":
        raise ValueError("not a level 5 MAT file")
    out: dict[str, np.ndarray] = {}

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack("<II", buf[at : at + 8])
        if kind >> 16:  # small element: type and size share a word
            return kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)], at + 8
        return kind, buf[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != _MAT_COMPRESSED else 0)

    def matrix(body: bytes) -> None:
        _, flags, at = element(body, 0)
        if flags[0] in (1, 2, 3, 4, 5):  # cells, structs, objects, text, sparse
            return
        _, dims, at = element(body, at)
        _, name, at = element(body, at)
        kind, values, _ = element(body, at)
        shape = np.frombuffer(dims, "<i4")
        out[name.decode("latin1")] = np.frombuffer(values, "<" + _MAT_TYPES[kind]).reshape(shape, order="F")

    at = 128
    while at + 8 <= len(data):
        kind, body, at = element(data, at)
        if kind == _MAT_COMPRESSED:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind == _MAT_MATRIX:
            matrix(body)
    return out


def largest_array(arrays: dict[str, np.ndarray]) -> np.ndarray | None:
    """The array with most values, the first of equals."""
    best = None
    for a in arrays.values():
        if best is None or a.size > best.size:
            best = a
    return best


def resize(image: np.ndarray, longest: int) -> np.ndarray:
    """Shrunk so that no side exceeds ``longest``, by area averages; smaller images stay."""
    height, width = image.shape[:2]
    if max(height, width) <= longest:
        return image
    scale = longest / max(height, width)
    rows = np.linspace(0, height, max(1, round(height * scale)) + 1).astype(int)
    cols = np.linspace(0, width, max(1, round(width * scale)) + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(image, rows[:-1], axis=0), cols[:-1], axis=1)
    return sums / (np.diff(rows)[:, None, None] * np.diff(cols)[None, :, None])


def scene_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root`` with their scene folder: path, folder, file, scene (struct), content.

    The content column is read only where a query asks for it (the binary source
    prunes it).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    return files.select("path", folder.alias("folder"), F.element_at(parts, -1).alias("file"), scene_name_parts(folder).alias("scene"), "content")


def first_file(files: DataFrame, prefix: str) -> DataFrame:
    """Per folder the first file, in name order, that starts with ``prefix`` and is a PNG (any case)."""
    fits = files.where(F.upper("file").like(f"{prefix.upper()}%.PNG"))
    return first_wins(fits, ["folder"], [F.col("file")])


def noisy_with_truth(files: DataFrame) -> DataFrame:
    """(folder, scene, noisy, truth): the noisy frame of each folder, its ground truth or null."""
    noisy = first_file(files, "NOISY").select("folder", "scene", F.col("path").alias("noisy"))
    truth = first_file(files, "GT").select("folder", F.col("path").alias("truth"))
    return noisy.join(truth, "folder", "left")


def decoded(files: DataFrame, measure: Callable[[np.ndarray], list[float]], width: int) -> DataFrame:
    """(path, ok, error, values): ``measure`` of each PNG; damaged files are kept with their error.

    Filter on ``ok`` before any limit, so that a limit counts good samples only.
    """

    def make() -> Callable[..., list[tuple]]:
        def one(path: str, content: bytes | None) -> list[tuple]:
            try:
                values = [float(v) for v in measure(decode_png(bytes(content or b"")))]
            except ValueError as e:
                return [(path, False, str(e), None)]
            return [(path, len(values) == width, None, values)]

        return one

    return flat_map_rows(files, ["path", "content"], make, "path string, ok boolean, error string, values array<double>")


def scene_settings(folder_iso: Column, folder_shutter: Column, meta_iso: Column, meta_shutter: Column) -> tuple[Column, Column]:
    """Metadata wins over the folder's name, unless it is null or zero."""
    return F.coalesce(F.nullif(meta_iso, F.lit(0)), folder_iso), F.coalesce(F.nullif(meta_shutter, F.lit(0.0)), folder_shutter)
