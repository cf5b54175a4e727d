"""Media columns: Netpbm and BMP files decoded to numpy arrays, area-resized tiles in NPY form, difference hashes.

Resizing averages areas exactly, fractions of pixels included, from an integral image: the sum over a box is four
look-ups, and a fractional edge is a linear blend of them. The tile is stored as an NPY file; the difference hash
compares horizontal neighbours of a 9 x 8 tile of luminance. Files go to a table first; a second plan reads them back,
decodes them, and writes tiles and features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_chunks, table, text_bytes, written

#: Bytes that a payload is padded to a multiple of: 64 pixels of three samples, or 192 of one.
UNIT = 192


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Binary PGM (height x width) or PPM (height x width x 3) of 8-bit samples."""
    kind, (h, w) = (b"P5" if pixels.ndim == 2 else b"P6"), pixels.shape[:2]
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of height x width x 3 samples (red, green, blue); rows are stored from the bottom up."""
    h, w, _ = pixels.shape
    stride = -(-3 * w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_tokens(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """``n`` numbers of a header, comments left out, and where the one white-space byte after them ends."""
    out: list[int] = []
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in a Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain and binary, of up to 16 bits a sample; PBM gives 0 (black) and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    (w, h, *most), at = _netpbm_tokens(data, 2, 2 if kind in (b"P1", b"P4") else 3)
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1), axis=1)[:, :w]
        return (255 * (1 - bits)).astype(np.uint8)
    if kind == b"P1":
        bits = np.array([c == 49 for c in data[at - 1 :] if c in (48, 49)][: w * h], np.uint8).reshape(h, w)
        return (255 * (1 - bits)).astype(np.uint8)
    wide = most[0] > 255
    if kind in (b"P2", b"P3"):
        x = np.array(data[at:].split()[: w * h * depth], np.int64)
    else:
        x = np.frombuffer(data, ">u2" if wide else np.uint8, w * h * depth, at)
    if len(x) != w * h * depth:
        raise ValueError("samples are missing in a Netpbm file")
    x = x.astype(np.uint16 if wide else np.uint8)
    return x.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel, bottom-up or top-down, to height x width x 3."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head, w, h, _, bits, how = struct.unpack_from("<IIiiHHI", data, 10)
    if how or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {how}")
    stride, rows = -(-bits * w // 32) * 4, abs(h)
    x = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        x = colours[x[:, :w]][:, :, 2::-1]
    else:
        x = x[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    return x[::-1] if h > 0 else x


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area that each target pixel covers, as float64; grows and shrinks alike."""
    x = pixels.astype(np.float64)
    flat = x.reshape(x.shape[0], x.shape[1], -1)
    total = np.zeros((flat.shape[0] + 1, flat.shape[1] + 1, flat.shape[2]))
    np.cumsum(flat, axis=0, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    for axis, n in ((0, height), (1, width)):
        size = total.shape[axis] - 1
        edge = np.arange(n + 1) * (size / n)
        i = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - i).reshape([-1 if a == axis else 1 for a in range(3)])
        total = total.take(i, axis) * (1 - part) + total.take(i + 1, axis) * part
    box = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    return (box / (pixels.shape[0] * pixels.shape[1] / (height * width))).reshape(height, width, *x.shape[2:])


def tile(pixels: np.ndarray, size: int) -> bytes:
    """NPY file of the picture resized to size x size 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each pixel of a 9 x 8 tile of luminance is darker than its right neighbour."""
    grey = pixels @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def payload_to_media(raw: bytes) -> tuple[bytes, bytes]:
    """(padded payload, file): a PGM of 192 columns, or a BMP of 64, as the payload's checksum is even or odd."""
    payload = raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)
    x = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    if zlib.crc32(payload) % 2:
        return payload, encode_bmp(x.reshape(len(x), UNIT // 3, 3))
    return payload, encode_netpbm(x)


_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string()), ("tile", pa.binary())]
#: Bytes of files and tiles that a task gathers before it passes them on.
HELD_BYTES = 8 << 20


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for a, b in row_chunks(off, HELD_BYTES):
            files = [payload_to_media(data[off[i] : off[i + 1]].tobytes())[1] for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off[a : b + 1])), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_files(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) per row of ``docs`` (doc_id, text): the text as a Netpbm or BMP file.

    The text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples; n_bytes is their number
    without the padding. Equal texts give equal files; null and empty texts give a row of spaces.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder, "doc_id long, n_bytes long, media binary")


def _describer(tile_size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, rows, held, start = batch.column("doc_id"), batch.column("n_bytes").to_pylist(), [], 0, 0
            for i, stored in enumerate(batch.column("media")):
                stored = stored.as_py()
                pixels = decode(stored)
                back = pixels.tobytes()
                t = tile(pixels, tile_size)
                rows.append((n[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(pixels), hashlib.sha256(t).hexdigest(), t))
                held += len(t)
                if held > HELD_BYTES or i + 1 == len(ids):
                    cols = [pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *cols], names=["doc_id", *[f[0] for f in _FIELDS]])
                    rows, held, start = [], 0, i + 1

    return describe


def media_features(files: DataFrame, tile_size: int) -> DataFrame:
    """Sizes, digests, difference hash (feature) and NPY tile per row of ``files`` (doc_id, n_bytes, media), each file decoded."""
    return files.select("doc_id", "n_bytes", "media").mapInArrow(_describer(tile_size), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, tile binary")


def media_columns(docs: DataFrame, tile_size: int = 16, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): digests, sizes, difference hash and NPY tile of its media file.

    Two tables are written: ``media`` with the files, and ``tiles`` with an NPY file a row beside what was found in
    the files as they were read back. They stand under ``path`` and stay there, or in the shared folder until the
    driver ends. Null and empty texts give one row of spaces; repeated rows give a row each. One document is in
    memory at a time.
    """
    files = written(media_files(docs), "media", path and f"{path}/media", compression="zstd")
    return written(media_features(files, tile_size), "tiles", path and f"{path}/tiles", compression="zstd")


def op6(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).drop("tile")
