"""Media columns: Netpbm and BMP images, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, WIDTH = 576, 24


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Raw grey (H, W) or colour (H, W, 3) bytes as P5 or P6."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Bytes (H, W) as an 8-bit BMP with a grey palette or (H, W, 3) as a 24-bit one, rows bottom-up and padded to 4."""
    h, w = pixels.shape[:2]
    rows = (pixels if pixels.ndim == 2 else pixels[:, :, ::-1]).reshape(h, -1)
    line = -(-rows.shape[1] // 4) * 4
    body = np.zeros((h, line), np.uint8)
    body[:, : rows.shape[1]] = rows[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if pixels.ndim == 2 else b""
    at = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if pixels.ndim == 2 else 24, 0, body.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """P1 to P6 Netpbm or an uncompressed 8, 24 or 32-bit BMP to an array (H, W) or (H, W, 3); ValueError for other data."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm or BMP image")
    kind, at, found = int(data[1:2]), 2, []
    while len(found) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        found.append(int(data[at:end]))
        at = end
    (w, h), top, depth = found[:2], (found + [1])[2], 3 if kind in (3, 6) else 1
    n = w * h * depth
    if kind == 1:
        flat = np.array([c - 48 for c in data[at:] if c in b"01"][:n], np.uint8)
    elif kind in (2, 3):
        flat = np.array(data[at:].split()[:n], np.int64)
    elif kind == 4:
        line = -(-w // 8)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, line * h, at + 1).reshape(h, line), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if flat.size != n:
        raise ValueError("image data ends early")
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def _decode_bmp(data: bytes) -> np.ndarray:
    at, size, w, h, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only plain 8, 24 and 32-bit BMP")
    line, rows = -(-w * bits // 32) * 4, abs(h)
    body = np.frombuffer(data, np.uint8, line * rows, at).reshape(rows, line)
    body = body[::-1] if h > 0 else body
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)
        index = body[:, :w]
        grey = (palette[:, 0] == palette[:, 1]) & (palette[:, 1] == palette[:, 2])
        return palette[index, 0] if grey.all() else palette[index][:, :, 2::-1]
    return body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]


def _cells(pixels: np.ndarray, height: int, width: int) -> tuple[np.ndarray, int]:
    """(sums, divisor): whole numbers whose quotients are the means over equal areas, fractions of pixels included, from one integral image."""
    grey = pixels if pixels.ndim == 2 else pixels.sum(axis=2, dtype=np.int64)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(grey, axis=0, out=total[1:, 1:], dtype=np.int64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at_lines(m: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1, dtype=np.int64) * n  # in parts of a line
        low = np.minimum(edge // parts, n - 1)
        return m[low] * parts + (edge - low * parts)[:, None] * (m[low + 1] - m[low])

    corners = at_lines(at_lines(total, h, height).T, w, width).T
    return np.diff(np.diff(corners, axis=0), axis=1), h * w * (1 if pixels.ndim == 2 else 3)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas as float64."""
    sums, divisor = _cells(pixels, height, width)
    return sums / divisor


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 area-resized image is darker than the one to its right, row by row; compared exactly, so that flat areas give 0."""
    small, _ = _cells(pixels, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def tile(pixels: np.ndarray, side: int = 16) -> bytes:
    """An area-resized tile as the bytes of an NPY file, 8-bit."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def as_image(payload: bytes, form: str = "pgm") -> bytes:
    """A payload padded with bytes 255 to a positive multiple of 576, as an image 24 samples wide."""
    short = -len(payload) % UNIT if payload else UNIT
    pixels = np.frombuffer(payload + b"\xff" * short, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(pixels) if form == "pgm" else encode_bmp(pixels)


def _store(form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    stored = as_image(raw, form)
                    pixels = decode(stored)
                    rows.append((len(raw), stored, tile(pixels), difference_hash(pixels)))
                n, media, tiles, hashes = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary()), pa.array([f"{x:016x}" for x in hashes])], ["doc_id", "n_bytes", "media", "tile", "dhash"])

    return run


def store_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media (a PGM or BMP file), tile (an NPY file) and dhash of each whole text as an image.

    Null text: the empty payload, one unit of bytes 255. Rows that repeat are stored each; equal texts give
    equal bytes. An empty table gives no rows. Any length is taken whole; a row must fit a task's memory. Columns other than
    doc_id and text are ignored, whatever their names.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store(form), "doc_id long, n_bytes long, media binary, tile binary, dhash string")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    for batch in batches:
        rows = []
        for media, small in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            payload = decode(media).tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(small).hexdigest()))
        size, sha, crc, n, digest, tiles = zip(*rows) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), batch.column(4), pa.array(tiles, pa.string())], names)


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of what store_media() stored, read back from the stored bytes."""
    return store_media(docs).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
