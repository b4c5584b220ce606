"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, slices

#: Pixels of an image at most; a header that says more is taken as broken.
MOST_PIXELS = 2**31
_HEAD = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")


def write_pgm(samples: np.ndarray) -> bytes:
    """A height x width array of bytes as binary PGM."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def write_bmp(samples: np.ndarray) -> bytes:
    """A height x width (grey, 8 bits with a palette) or height x width x 3 array as BMP, rows bottom up."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    rows = samples[::-1].reshape(h, -1) if grey else samples[::-1, :, ::-1].reshape(h, -1)
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8).tobytes()
    at = 54 + palette.nbytes
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 0, 0, 256 if grey else 0, 0) + palette.tobytes() + body


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a Netpbm header")
    w, h = int(m[2]), int(m[3])
    if not (0 < w and 0 < h and w * h <= MOST_PIXELS):
        raise ValueError(f"{w} x {h} pixels")
    if kind in (b"P1", b"P4"):  # no maximum; the third number, if the pattern took one, is pixels
        head = re.match(rb"P[14](?:\s|#[^\n]*\n)+\d+(?:\s|#[^\n]*\n)+\d+\s", data)
        body = data[head.end():]
        if kind == b"P1":
            bits = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", body)), np.uint8)[: w * h] - 48
        else:
            bits = np.unpackbits(np.frombuffer(body, np.uint8, h * ((w + 7) // 8)).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits.reshape(h, w)) * 255).astype(np.uint8)
    if m[4] is None or not 0 < int(m[4]) <= 65535:
        raise ValueError("a maximum is between 1 and 65535")
    most, deep = int(m[4]), 3 if kind in (b"P3", b"P6") else 1
    body = data[m.end():]
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*", b"", body).split()[: w * h * deep], np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() <= most:
            raise ValueError("a sample is over the maximum")
    else:
        flat = np.frombuffer(body, ">u2" if most > 255 else np.uint8, w * h * deep)
    return flat.reshape((h, w, 3) if deep == 3 else (h, w)).astype(np.uint8 if most <= 255 else np.uint16)


def _bmp(data: bytes) -> np.ndarray:
    at, = struct.unpack_from("<I", data, 10)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if not (0 < w and 0 < abs(h) and w * abs(h) <= MOST_PIXELS):
        raise ValueError(f"{w} x {h} pixels")
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, compression {packed}")
    line, tall = (w * bits // 8 + 3) // 4 * 4, abs(h)
    rows = np.frombuffer(data, np.uint8, line * tall, at).reshape(tall, line)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        colours = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return colours[rows, 0] if (colours == colours[:, :1]).all() else colours[rows]
    return rows.reshape(tall, w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP (8, 24, 32 bits, not compressed) to height x width or height x width x 3."""
    return np.ascontiguousarray(_bmp(data) if data[:2] == b"BM" else _netpbm(data))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resizing: the exact mean over each target pixel's rectangle, by an integral image read between its points."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    total[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)

    def at(x: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(int), x.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        return np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part

    ys, xs = np.linspace(0, image.shape[0], height + 1), np.linspace(0, image.shape[1], width + 1)
    boxes = np.diff(np.diff(at(at(total, ys, 0), xs, 1), axis=0), axis=1)
    return boxes / ((image.shape[0] / height) * (image.shape[1] / width))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side*side bits: is each cell of the resized grey image darker than its right neighbour?"""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(resize(grey, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def peak(data: bytes) -> int:
    """The value of white: what a Netpbm header says, else 255."""
    m = _HEAD.match(data)
    return int(m[4]) if m and m[1] not in (b"P1", b"P4") else 255


def store_payload(df: DataFrame, payload_col: str = "payload", width: int = 64, form: str = "pgm") -> DataFrame:
    """Adds media: each payload (bytes, a positive multiple of width) as an 8-bit grey image of that width. A null payload
    gives a null medium; equal payloads give equal media; a column called media is replaced."""
    write = {"pgm": write_pgm, "bmp": write_bmp}[form]
    return _mapped(df, {"media": "binary"}, lambda row: (None if row[payload_col] is None else write(np.frombuffer(row[payload_col], np.uint8).reshape(-1, width)),), [payload_col])


def featurize(df: DataFrame, media_col: str = "media", tile: int = 16) -> DataFrame:
    """Adds height, width, payload (the decoded samples' bytes), tile (NPY of the area-resized image) and dhash.

    A null or unreadable medium has nulls in all of them, as has one of no or over MOST_PIXELS pixels, of a maximum outside 1 to 65535, or
    with samples over it. Tiles have 8 bits: samples are scaled so that the medium's white is
    255. Columns of those names are replaced.
    """

    def one(row):
        try:
            image = decode(row[media_col])
        except (ValueError, TypeError, struct.error, IndexError, AttributeError, ArithmeticError):
            return None, None, None, None, None
        small = np.round(np.round(resize(image, tile, tile) * (255 / peak(row[media_col])), 6)).astype(np.uint8)  # a half is a half, however it was summed
        return image.shape[0], image.shape[1], image.tobytes(), npy(small), difference_hash(image)

    return _mapped(df, {"height": "long", "width": "long", "payload": "binary", "tile": "binary", "dhash": "string"}, one, [media_col])


def _mapped(df: DataFrame, new: dict[str, str], one, needs: list[str]) -> DataFrame:
    """df with the columns `new`, computed row by row; a column of such a name is replaced."""
    kept = [c for c in df.columns if c not in new]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), *[F.col(f"`{c}`").alias(f"__in_{c}") for c in needs])
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}

    def run(batches):
        for b in slices(batches):
            ins = [column(b, f"__in_{c}").to_pylist() for c in needs]
            got = [one(dict(zip(needs, x))) for x in zip(*ins)]
            yield pa.RecordBatch.from_arrays(
                [column(b, "__row"), *(pa.array([g[i] for g in got], kinds[k]) for i, k in enumerate(new.values()))], ["__row", *(f"__new_{c}" for c in new)]
            )

    schema = rows.select("__row", *[F.lit(None).cast(k).alias(f"__new_{c}") for c, k in new.items()]).schema
    return rows.mapInArrow(run, schema).select(*[F.col("__row")[c].alias(c) for c in kept], *[F.col(f"__new_{c}").alias(c) for c in new])
