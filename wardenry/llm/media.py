"""Texts as grey images: Netpbm and BMP in, area-resized tiles and difference hashes out.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit
image 64 wide, stored losslessly as PGM or BMP in a Parquet column. The stored bytes are read
back, decoded to a numpy array, and resized by areas from its integral image: the mean over a
cell with fractional edges is a difference of four interpolated corners. Both sums run over strips, so
a long text needs a few bytes a sample. The tile is kept as NPY, the hash compares neighbours in a 9 x 8 resize.

Null text counts as empty (64 zeros); texts may be of any length. Equal texts give equal values; rows that repeat stay. Cells that are equally dark count as not darker.
Columns beyond doc_id and text are ignored, whatever their names. Media that are null or can't be decoded keep their row: what the stored bytes tell (media_bytes, media_sha256; null for null) stands, the features are null.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, spread, table, written

WIDTH = 64
TILE = 32
STRIP = 4096


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey, rows bottom up and padded to 4 bytes."""
    height, width = image.shape
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = image[::-1]
    at = 54 + 1024
    return b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 256) + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, to (height, width) or (height, width, 3); comments may stand in the header."""
    kind, words, at = data[:2], [], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(words) < need:
        found = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        words.append(int(found[1]))
        at = found.end()
    width, height = words[:2]
    most = words[2] if need == 3 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: width * height] - 48
        image = 255 * (1 - flat)
    elif kind in (b"P2", b"P3"):
        image = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: width * height * depth], np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        image = 255 * (1 - np.unpackbits(packed, axis=1)[:, :width])
    else:
        image = np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * depth, at + 1)
    if need == 3 and most != 255:
        image = image.astype(np.int64) * 255 // max(1, most)
    image = np.ascontiguousarray(image, np.uint8)
    return image.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8 bits with a palette, 24 or 32 bits; grey palettes give (height, width)."""
    (at,), (head, width, height, _, bits, squeezed) = struct.unpack_from("<I", data, 10), struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or squeezed not in (0, 3) or width < 1:
        raise ValueError(f"a BMP of {bits} bits, compression {squeezed}, is not read")
    step = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), at).reshape(abs(height), step)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)
        image = palette[rows[:, :width]][:, :, 2::-1]
        return np.ascontiguousarray(image[:, :, 0] if (palette[:, :1] == palette[:, :3]).all() else image)
    return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray | None:
    """The image, or None where the bytes are no image of these forms, or one without samples."""
    try:
        image = decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, TypeError, IndexError, OverflowError, struct.error):
        return None
    return image if image.size else None


def _corners(length: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the cells + 1 edges along an axis: the whole samples before each, the next one, and the part of it."""
    edges = np.arange(cells + 1) * (length / cells)
    whole = np.minimum(edges.astype(np.int64), length)
    return whole, np.minimum(whole + 1, length), edges - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of a grey image, from its integral image at the cells' corners, as float64."""
    rows, columns = image.shape
    low, high, part = _corners(columns, width)
    top, bottom, share = _corners(rows, height)
    need = np.unique(np.concatenate([top, bottom]))
    table_ = np.zeros((len(need), width + 1))
    total, filled = np.zeros(width + 1), int(need[0] == 0)
    for start in range(0, rows, STRIP):
        strip = image[start : start + STRIP].astype(np.int64)
        across = np.concatenate([np.zeros((len(strip), 1), np.int64), np.cumsum(strip, axis=1)], axis=1)
        down = total + np.cumsum(across[:, low] + (across[:, high] - across[:, low]) * part, axis=0)
        upto = int(np.searchsorted(need, start + len(strip), "right"))
        table_[filled:upto] = down[need[filled:upto] - start - 1]
        filled, total = upto, down[-1]
    a, b = table_[np.searchsorted(need, top)], table_[np.searchsorted(need, bottom)]
    corners = a + (b - a) * share[:, None]
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (rows * columns))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: whether a cell is darker than its right neighbour, in hex. Means are rounded to 1/1024, so the order of sums can't decide."""
    cells = np.round(area_resize(image, 8, 9) * 1024)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, side, side) + 0.5).astype(np.uint8))
    return out.getvalue()


def to_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and media, the stored image of each text. form: pgm or bmp."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def images(batches):
        for batch in in_slices(batches):
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            media = [encode(np.frombuffer(x + bytes(max(1, -(-len(x) // WIDTH)) * WIDTH - len(x)), np.uint8).reshape(-1, WIDTH)) for x in texts]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(images, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, with_tiles: bool = True) -> DataFrame:
    """Features of stored images (columns doc_id, n_bytes, media): digests, difference hash as feature, and the NPY tile."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", tile binary" * with_tiles

    def features(batches):
        for batch in in_slices(batches):
            stored = batch.column(2).to_pylist()
            rows = []
            for x in stored:
                own = (None, None) if x is None else (len(x), sha(x))
                if x is None or (image := decode(x)) is None:
                    rows.append((None, None, None, *own, None, *[None] * with_tiles))
                    continue
                payload, plain = image.tobytes(), grey(image)
                rows.append((len(payload), sha(payload), zlib.crc32(payload[-64:]), *own, difference_hash(plain), *[npy_tile(plain)] * with_tiles))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 6 + with_tiles]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(features, schema)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(written(to_media(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "media"))


QUERIES = {"op10_media_columns": op10_media_columns}
ORACLE: dict[str, str] = {}
