"""Image files: size, brightness, edges, blur and difference hash of each (SRC-10, QC-13, BIT-02). One Arrow batch of files at a time, whole files only.

Pillow decodes where it is installed; without it 8-bit PNG files without interlacing are read here, and any other file is a row with ``is_corrupt`` and an ``error``.
"""

from __future__ import annotations

import struct
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.sources.files import list_files

MEASURES = "width int, height int, aspect_ratio double, brightness_mean double, edge_variance double, blur double, dhash64 string, is_corrupt boolean, error string"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """Grey values (rows, columns) of an 8-bit PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, head, body = 8, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0]:
            raise ValueError("damaged PNG file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("a kind of PNG file that isn't read here")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (width * n + 1):
        raise ValueError("damaged PNG file")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * n + 1)
    pixels = np.zeros((height + 1, width + 1, n), np.int64)
    for y in range(height):
        filter_, line = int(lines[y, 0]), lines[y, 1:].reshape(width, n).astype(np.int64)
        above = pixels[y, 1:]
        if filter_ == 0:
            out = line
        elif filter_ == 1:
            out = np.cumsum(line, 0) & 255
        elif filter_ == 2:
            out = (line + above) & 255
        else:
            out = np.zeros((width, n), np.int64)
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                if filter_ == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                left, corner = (line[x] + guess) & 255, above[x]
                out[x] = left
        pixels[y + 1, 1:] = out
    rgb = pixels[1:, 1:]
    return grey(rgb[..., :3]) if n > 2 else rgb[..., 0].astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    """The usual luma, in 16-bit fixed point."""
    return ((rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ModuleNotFoundError:
        return read_png(data)
    with Image.open(BytesIO(data)) as image:
        image.load()
        return np.asarray(image.convert("L"))


def _shrink(a: np.ndarray, size: int) -> np.ndarray:
    """Rows resampled to ``size`` by a Lanczos window of three lobes, widened when shrinking."""
    scale = max(1.0, len(a) / size)
    centre = (np.arange(size) + 0.5) * len(a) / size
    x = (np.arange(len(a))[None, :] + 0.5 - centre[:, None]) / scale
    weight = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return np.clip(np.floor(weight / weight.sum(1, keepdims=True) @ a + 0.5), 0, 255)


def difference_hash(a: np.ndarray) -> str:
    small = _shrink(_shrink(a.T.astype(float), 9).T, 8)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def edge_variance(a: np.ndarray) -> float:
    """Variance of a 3 x 3 edge filter's picture, whose border is the image's."""
    out = a.astype(float)
    if min(a.shape) > 2:
        around = sum(out[1 + dy : a.shape[0] - 1 + dy, 1 + dx : a.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        inner = np.clip(9 * out[1:-1, 1:-1] - around, 0, 255)
        out = out.copy()
        out[1:-1, 1:-1] = inner
    return float(out.var())


def blur(a: np.ndarray) -> float:
    """QC-13: variance of the Laplacian, borders mirrored; higher is sharper."""
    p = np.pad(a.astype(float), 1, mode="reflect" if min(a.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def measure(data: bytes) -> tuple:
    """The values of MEASURES; zeros and an error for what can't be decoded."""
    try:
        a = decode(data)
        h, w = a.shape
        return w, h, round(w / h, 6) if h else 0.0, round(float(a.mean()), 4), round(edge_variance(a), 4), round(blur(a), 2), difference_hash(a), False, ""
    except (OSError, ValueError, zlib.error, struct.error) as e:
        return 0, 0, 0.0, 0.0, 0.0, 0.0, "", True, f"{type(e).__name__}: {e}"


def inspect(spark: SparkSession, path: str, glob: str = "*", labels: bool = True) -> DataFrame:
    """SRC-10: one row a file: path, bytes, sha256, split, label and MEASURES."""
    files = list_files(spark, path, glob, labels)
    kept = [c for c in files.columns if c != "content"]
    kinds = dict(files.dtypes)
    types = (pa.int32(), pa.int32(), *(pa.float64(),) * 4, pa.string(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [*kept, *names])

    return files.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", " + MEASURES)
