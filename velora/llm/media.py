"""Media columns: netpbm and BMP images decoded to numpy arrays and stored as NPY tiles.

Method. Netpbm (P1 to P6; 8 or 16 bit, samples scaled to the whole range of these) and
uncompressed BMP (1, 4, 8, 16, 24 and 32 bit, with or without channel masks; not RLE)
files are decoded to numpy arrays. Resizing averages areas: with the
integral image (double cumulative sum), the mean of any rectangle is four
look-ups, and fractional borders come from linear interpolation of the integral
image. A 9 x 8 area-resize gives the difference hash: bit k is 1 if a sample is
larger than its right neighbour. Arrays are cut into square tiles, and each tile
is written as an NPY file image (format 1.0); the last row and column of tiles
may be smaller.

A text can be stored as such an image too: its UTF-8 bytes, padded with 255 to
a positive multiple of 576, are the samples of a grey image of 24 columns, one
24 x 24 tile for each 576 bytes. Nothing is lost: the NPY tiles read back give
the payload.

All work is per row, so there is no shuffle and memory is bounded by a batch of
rows and bytes and the largest single text. Defined results: a null text is empty (one
tile of 255); a file that is no image gives null; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velora.llm.common import id_and_text, map_batches, texts_utf8, written

SIDE = 24
BLOCK = SIDE * SIDE
HASH_ROWS, HASH_COLS = 8, 9


def _scaled(samples: np.ndarray, most: int) -> np.ndarray:
    """Samples of 0 to most, as 8 bits of 0 to 255 or 16 bits of 0 to 65535."""
    full = 255 if most <= 255 else 65535
    if most != full:
        samples = (np.minimum(samples, most).astype(np.uint64) * full + most // 2) // most
    return samples.astype(np.uint8 if full == 255 else np.uint16, copy=False)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array (rows, columns[, 3])."""
    kind, at, numbers = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a netpbm file")
    bits = kind in (b"P1", b"P4")
    while len(numbers) < (2 if bits else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.index(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = (*numbers, 1)[:3]
    if not 0 < most < 65536:
        raise ValueError("bad largest sample")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    size = int(np.prod(shape))
    if kind in (b"P1", b"P2", b"P3"):
        plain = re.sub(rb"#[^\n]*", b" ", data[at:])
        found = re.findall(rb"[01]", plain) if bits else plain.split()
        if len(found) < size:
            raise ValueError("too few samples")
        samples = np.array(found[:size]).astype(np.int64).reshape(shape)
        return (1 - samples).astype(np.uint8) * np.uint8(255) if bits else _scaled(samples, most)
    at += 1  # one white space byte ends the header
    if bits:
        step = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, step * height, at).reshape(height, step)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    return _scaled(np.frombuffer(data, ">u2" if most > 255 else "u1", size, at).reshape(shape), most)


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey array as P5."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, scaled to 0 to 255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((pixels & np.uint64(mask)) >> np.uint64(low)) * np.uint64(255) // np.uint64(most)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP to an array (rows, columns, 3) in RGB order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, header = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3, 6) or bits not in (1, 4, 8, 16, 24, 32) or packing and bits not in (16, 32):
        raise ValueError("unsupported BMP kind")
    rows, step = abs(height), -(-width * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)
    body = body if height < 0 else body[::-1]
    if bits == 24:
        return np.ascontiguousarray(body[:, : 3 * width].reshape(rows, width, 3)[:, :, ::-1])
    if bits > 8:
        pixels = np.ascontiguousarray(body[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.uint64)
        usual = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        masks = struct.unpack_from("<III", data, 54) if packing else usual
        return np.stack([_channel(pixels, m) for m in masks], axis=2)
    at = body[:, :width] if bits == 8 else np.packbits(np.unpackbits(body, axis=1).reshape(rows, -1, bits)[:, :width], axis=2)[:, :, 0] >> (8 - bits)
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
    return palette[at]


def decode(data: bytes | None) -> np.ndarray | None:
    """Any file of the kinds above; null if it is none or broken."""
    try:
        return None if not data else decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, IndexError, struct.error):
        return None


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by the integral image; exact for fractional borders too."""
    grey = samples.mean(axis=2) if samples.ndim == 3 else samples
    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, 0, dtype=np.float64), 1, out=integral[1:, 1:])

    def at(axis: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * (grey.shape[axis] / parts)
        low = np.minimum(edge.astype(np.int64), grey.shape[axis] - 1)
        return low, low + 1, edge - low

    low, high, part = at(0, height)
    rows = integral[low] + (integral[high] - integral[low]) * part[:, None]
    low, high, part = at(1, width)
    sums = rows[:, low] + (rows[:, high] - rows[:, low]) * part
    area = (grey.shape[0] / height) * (grey.shape[1] / width)
    return np.diff(np.diff(sums, axis=0), axis=1) / area


def difference_hash(samples: np.ndarray) -> str:
    """16 hex digits: a bit is 1 where an area mean is larger than its right neighbour's."""
    small = np.round(area_resize(samples, HASH_ROWS, HASH_COLS), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    """A contiguous array as an NPY file, format 1.0."""
    said = b"{'descr': '%s', 'fortran_order': False, 'shape': %s, }" % (tile.dtype.str.encode(), str(tile.shape).encode())
    said += b" " * (-(10 + len(said) + 1) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(said)) + said + np.ascontiguousarray(tile).tobytes()


def read_npy(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The array of the NPY file that starts at a byte, and where it ends."""
    import ast

    if data[at : at + 6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    size = struct.unpack_from("<H", data, at + 8)[0]
    said = ast.literal_eval(data[at + 10 : at + 10 + size].decode("latin-1"))
    kind, count = np.dtype(said["descr"]), int(np.prod(said["shape"], dtype=np.int64))
    end = at + 10 + size + count * kind.itemsize
    return np.frombuffer(data, kind, count, at + 10 + size).reshape(said["shape"]), end


def tiles(samples: np.ndarray, side: int) -> bytes:
    """All tiles in row-major order, each an NPY file, one after the other."""
    out = []
    for top in range(0, samples.shape[0], side):
        for left in range(0, samples.shape[1], side):
            out.append(npy_bytes(samples[top : top + side, left : left + side]))
    return b"".join(out)


def untile(data: bytes, columns: int) -> np.ndarray:
    """Undo tiles() for an image of that many columns."""
    if columns == SIDE and len(data) > (step := len(npy_bytes(np.zeros((SIDE, SIDE), np.uint8)))) and not len(data) % step:
        head = data[: step - BLOCK]
        parts = np.frombuffer(data, np.uint8).reshape(-1, step)
        if (parts[:, : len(head)] == np.frombuffer(head, np.uint8)).all() and read_npy(head + bytes(BLOCK))[0].shape == (SIDE, SIDE):
            return parts[:, len(head) :].reshape(-1, SIDE)
    at, bands, row = 0, [], []
    while at < len(data):
        tile, at = read_npy(data, at)
        row.append(tile)
        if sum(t.shape[1] for t in row) == columns:
            bands.append(np.concatenate(row, 1))
            row = []
    return np.concatenate(bands)


_HEAD = npy_bytes(np.zeros((SIDE, SIDE), np.uint8))[:-BLOCK]


def payload_tiles(payload: bytes) -> bytes:
    """tiles() of the payload's image of 24 columns, at once."""
    body = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    out = np.empty((len(body), len(_HEAD) + BLOCK), np.uint8)
    out[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    out[:, len(_HEAD) :] = body
    return out.tobytes()


def decode_images(df: DataFrame, file_col: str, id_col: str, side: int = 64) -> DataFrame:
    """id, height, width, channels, tiles (NPY files), dhash for a column of image files."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column(1):
            image = decode(value.as_py())
            if image is None or not image.size:
                rows.append((None,) * 5)
            else:
                rows.append((image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, tiles(image, side), difference_hash(image)))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "height", "width", "channels", "tiles", "dhash"])

    return map_batches(df.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{file_col}` as binary) file"), run, "id long, height int, width int, channels int, tiles binary, dhash string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as NPY tiles and read the stored table back: doc_id, n_bytes, media.

    The text goes through a PGM file and its decoder, as any image does.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for text in texts_utf8(batch.column(1)):
            payload = text + b"\xff" * (BLOCK if not text else -len(text) % BLOCK)
            image = decode_netpbm(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, SIDE)))
            sizes.append(len(text))
            media.append(payload_tiles(image.tobytes()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary"), "media")


def features(stored: DataFrame) -> DataFrame:
    """Digests and the difference hash of each stored image, from its bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column(2):
            media = value.as_py()
            image = untile(media, SIDE)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image)))
        kinds = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *(n for n, _ in kinds)])

    return map_batches(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
