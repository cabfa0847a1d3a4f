"""Media columns: Netpbm and BMP decoding, area resizing by integral images, NPY tiles and difference hashes
(operator 2)."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the grey image that holds a payload; payload lengths are multiples of it.
WIDTH = 64


def netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, comments skipped, and where the single white space after them ends."""
    found, at = [], 2
    while len(found) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def scaled(samples: np.ndarray, most: int) -> np.ndarray:
    """Samples of 0 to `most` as uint8 of 0 to 255 or, if they need more than eight bits, uint16 of 0 to 65535."""
    top, dtype = (255, np.uint8) if most < 256 else (65535, np.uint16)
    if most == top:
        return samples.astype(dtype, copy=False)
    if samples.size and samples.max() > most:
        raise ValueError("sample above the maximum value")
    return ((samples.astype(np.uint64) * (2 * top) + most) // (2 * most)).astype(dtype)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3), uint8 or uint16, scaled to the whole range; bitmaps give 0 for
    black, 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    fields, at = netpbm_fields(data, 2 if kind in (b"P1", b"P4") else 3)
    width, height = fields[:2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    if kind == b"P1":
        bits = np.frombuffer(data[at - 1 :].translate(None, b" \t\r\n\v\f"), np.uint8)[: width * height] - 48
        if bits.size and bits.max() > 1:
            raise ValueError("not a bit")
        return ((1 - bits) * 255).astype(np.uint8).reshape(shape)
    if kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
        return (1 - np.unpackbits(packed, axis=1)[:, :width]) * np.uint8(255)
    most = fields[2]
    if not 0 < most < 65536:
        raise ValueError("bad maximum value")
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at:].split()[: width * height * depth], dtype=np.int64)
        if samples.size and samples.min() < 0:
            raise ValueError("negative sample")
        if samples.size and samples.max() > most:
            raise ValueError("sample above the maximum value")
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", width * height * depth, at)
    return scaled(samples, most).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP as (height, width, 3) RGB: 1, 4 or 8 bits a pixel by palette, 16 or 32 by bit fields (5-5-5 and
    8-8-8 where none are given), 24."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    row, lines = (width * bits + 31) // 32 * 4, abs(height)
    raw = np.frombuffer(data, np.uint8, row * lines, start).reshape(lines, row)
    raw = raw if height < 0 else raw[::-1]
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)
        parts = np.unpackbits(np.ascontiguousarray(raw), axis=1).reshape(lines, -1, bits)[:, :width] if bits < 8 else raw[:, :width]
        index = parts @ (1 << np.arange(bits)[::-1]) if bits < 8 else parts
        return palette[:, 2::-1][index]
    if bits == 24:
        return raw[:, : width * 3].reshape(lines, width, 3)[:, :, ::-1]
    pixels = np.ascontiguousarray(raw).view(f"<u{bits // 8}")[:, :width].astype(np.uint64)
    masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    channels = []
    for mask in masks:
        shift = (mask & -mask).bit_length() - 1 if mask else 0
        most = max(mask >> shift, 1)
        channels.append((((pixels & mask) >> shift) * 510 + most) // (2 * most))
    return np.stack(channels, axis=2).astype(np.uint8)


def decode_media(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_grey(payload: bytes, width: int = WIDTH) -> bytes:
    """Binary grey Netpbm file of 8-bit samples; the payload's length is a multiple of the width."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(payload: bytes, width: int = WIDTH) -> bytes:
    """BMP of 8-bit samples with a grey palette, top line first; the width is a multiple of 4, the payload's length of the width."""
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", (54 + 1024 + len(payload)) & 0xFFFFFFFF, 0, 0, 54 + 1024)
    return head + struct.pack("<IiiHHIIiiII", 40, width, -(len(payload) // width), 1, 8, 0, 0, 2835, 2835, 256, 0) + palette.tobytes() + payload


@lru_cache(maxsize=4096)
def _edges(length: int, size: int) -> tuple[np.ndarray, ...]:
    """Of `size` + 1 even edges over `length` lines: the distinct whole lines at or before them and which is whose, those lines,
    and the parts of a line beyond them."""
    edges = np.arange(size + 1) * length / size
    low = np.minimum(edges.astype(np.int64), length - 1)
    return (*np.unique(low, return_inverse=True), low, edges - low)


def _between(image: np.ndarray, size: int) -> np.ndarray:
    """Sums of the lines between `size` + 1 even, fractional edges: differences of the integral image along the first axis,
    which is only kept at the edges."""
    at, place, low, part = _edges(image.shape[0], size)
    sums = np.zeros((len(at) + 1, *image.shape[1:]))
    np.cumsum(np.add.reduceat(image, at, axis=0, dtype=np.float64), axis=0, out=sums[1:])
    integral = sums[place] + image[low] * part.reshape([-1] + [1] * (image.ndim - 1))
    return integral[1:] - integral[:-1]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output pixel covers, from integral images read at fractional edges, one axis at a time."""
    total = np.swapaxes(_between(np.swapaxes(_between(image, height), 0, 1), width), 0, 1)
    return total / (image.shape[0] / height * (image.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hexadecimal digits: whether each of 8 x 8 pixels is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    small = small if small.ndim == 2 else small @ np.array([0.299, 0.587, 0.114])
    return np.packbits(small[:, :-1] + 1e-6 < small[:, 1:]).tobytes().hex()  # equal areas may differ in their last bits


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image resized to side x side as the bytes of an NPY file of uint8 samples."""
    top = 65535 if image.dtype.itemsize == 2 else 255
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(image, side, side) * (255 / top), 6)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def read_tile(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


MEDIA_FIELDS = [("height", pa.int32(), "int"), ("width", pa.int32(), "int"), ("channels", pa.int32(), "int"), ("tile", pa.binary(), "binary"), ("difference_hash", pa.string(), "string"), ("media_error", pa.string(), "string")]


def add_tiles(df: DataFrame, media: str, side: int = 32) -> DataFrame:
    """Decode a binary column of images; add height, width, channels, an NPY tile and the difference hash.

    Null media gives nulls; bytes that are no supported image, or an image without pixels, give nulls and a
    `media_error`. Columns of these names are replaced; other columns and repeated rows pass through.
    """
    new = [n for n, _, _ in MEDIA_FIELDS]
    kept = [c for c in df.columns if c not in new]
    schema = df.select(*kept, *(F.lit(None).cast(t).alias(n) for n, _, t in MEDIA_FIELDS)).schema

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = decode_media(data)
            if not image.size:
                raise ValueError("no pixels")
            return (*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy_tile(image, side), difference_hash(image), None)
        except (ValueError, ArithmeticError, IndexError, MemoryError, struct.error) as error:
            return (None,) * 5 + (str(error) or "unreadable",)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_py()) for x in batch[media]]
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(MEDIA_FIELDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *new])

    return df.select(*kept).mapInArrow(work, schema)


def text_media(df: DataFrame, side: int = 32) -> DataFrame:
    """Store every text as a grey Netpbm image and as a BMP, read both back, write a tile of each and describe the tiles.

    Null counts as the empty text. The payload is the UTF-8 bytes with zero bytes up to a positive multiple of 64, so
    an empty text is one row of 64 black pixels; it is read back from the Netpbm file, whose bytes media_bytes and
    media_sha256 tell of. feature is the difference hash of the NPY tile of side x side pixels as it is read back, and
    tile_sha256 the tile's; bmp_bytes, bmp_sha256 and bmp_feature are the BMP's. Equal texts give equal rows but for
    doc_id; repeated rows repeat.
    """
    fields = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile_sha256": "string", "bmp_bytes": "long", "bmp_sha256": "string", "bmp_feature": "string"}

    def row(text: str | None) -> tuple:
        data = (text or "").encode()
        padded = data + b"\0" * (-len(data) % WIDTH if data else WIDTH)
        media, bmp = encode_grey(padded), encode_bmp(padded)
        image, other = decode_media(media), decode_media(bmp)
        tile = npy_tile(image, side)
        mark = difference_hash(read_tile(tile))
        other_mark = difference_hash(read_tile(npy_tile(other, side)))
        payload = image.tobytes()
        return (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), mark,
            hashlib.sha256(tile).hexdigest(), len(bmp), hashlib.sha256(bmp).hexdigest(), other_mark,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(row(x.as_py()) for x in batch["text"]), strict=True)) or [()] * len(fields)
            types = [pa.int64() if t == "long" else pa.string() for t in fields.values()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *fields])

    schema = ", ".join(f"{n} {t}" for n, t in {"doc_id": "long", **fields}.items())
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
