"""Media columns: payloads stored losslessly as PNG in a binary column, read back and hashed by their low frequencies.

``encode`` turns a text or binary column into PNG bytes: 8-bit grey samples, one
row of ``WIDTH`` samples for each ``WIDTH`` payload bytes, each row filtered by
None, Sub or Up (the smallest sum of absolute residuals), zlib-compressed and cut
into IDAT chunks. ``decode`` reads such a column back: it tests every chunk's
CRC-32 and zlib's Adler-32, undoes all five filter types with numpy and returns
the payload. ``features`` describes the image by the signs of its 8 x 8 lowest
cosine-transform terms against their median.

Defined cases: a null or empty text is one row of 255s; equal payloads give equal
bytes and features; a null media value decodes to null; a damaged image (bad
signature, checksum, header or size) raises, or decodes to null with
``strict=False``. Repeated rows stay repeated; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, table

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
POOL, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data with bytes 255 appended up to a positive multiple of width."""
    return data + b"\xff" * (-len(data) % width if data else width)


def png_encode(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """payload (a positive multiple of width) as a grey 8-bit PNG of that width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    choices = (rows, sub, up)
    cost = np.stack([np.minimum(c, -c.view(np.int8).view(np.uint8)).sum(1, dtype=np.int64) for c in choices])
    kind = cost.argmin(0)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = kind
    for i, c in enumerate(choices):
        out[kind == i, 1:] = c[kind == i]
    packed = zlib.compress(out.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, width: int) -> np.ndarray:
    """Samples of one byte from filtered lines, whose first byte is the filter type."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    above = np.zeros(width, np.uint8)
    for i in np.flatnonzero(kinds >= 2):
        above = out[i - 1] if i else np.zeros(width, np.uint8)
        if kinds[i] == 2:
            out[i] += above
            continue
        left = corner = 0
        line, up = out[i].tolist(), above.tolist()
        for x in range(width):
            if kinds[i] == 3:
                guess = (left + up[x]) >> 1
            else:
                to_left, to_up, to_corner = abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)
                guess = left if to_left <= to_up and to_left <= to_corner else up[x] if to_up <= to_corner else corner
            left, corner = (line[x] + guess) & 255, up[x]
            line[x] = left
        out[i] = line
    return out


def png_decode(data: bytes) -> np.ndarray:
    """Rows of samples of a grey 8-bit PNG without interlace; every checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("truncated PNG")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError("only grey 8-bit images without interlace")
            size = (height, width + 1)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif kind[0] & 32 == 0:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(packed), size[0] * size[1] + 1)
    if len(raw) != size[0] * size[1] or not inflate.eof:
        raise ValueError("image data of another size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(size), size[1] - 1)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(POOL)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * POOL))


COSINES = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: for each of the 8 x 8 lowest cosine terms, whether it is above their median (without the mean term)."""
    pooled = image.astype(np.float64)
    for axis in (0, 1):
        n = pooled.shape[axis]
        if n < POOL:
            pooled = np.take(pooled, np.arange(POOL) * n // POOL, axis)
        else:
            starts = np.arange(POOL) * n // POOL
            counts = np.diff(np.append(starts, n))
            pooled = np.add.reduceat(pooled, starts, axis) / (counts[:, None] if axis == 0 else counts)
    low = np.round(COSINES @ pooled @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encode(df: DataFrame, column: str, to: str = "media", width: int = WIDTH) -> DataFrame:
    """df with column ``to``: struct<png binary, n_bytes bigint> of a text (as UTF-8) or binary column."""

    @F.pandas_udf("png binary, n_bytes bigint")
    def store(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in values:
            raw = [b"" if x is None else bytes(x) for x in batch]
            yield pd.DataFrame({"png": [png_encode(padded(x, width), width) for x in raw], "n_bytes": [len(x) for x in raw]})

    return df.withColumn(to, store(F.col(column).cast("binary")))


DIGEST = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(df: DataFrame, column: str, to: str = "digest", strict: bool = True) -> DataFrame:
    """df with column ``to``: what is read back from a binary column of PNGs, as the struct DIGEST."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = png_decode(bytes(data))
        except (ValueError, zlib.error):
            if strict:
                raise
            return (None,) * 6
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

    @F.pandas_udf(DIGEST)
    def read(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in values:
            out = pd.DataFrame([one(x) for x in batch], columns=[c.split()[0] for c in DIGEST.split(", ")])
            yield out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return df.withColumn(to, read(F.col(column)))


def decode(df: DataFrame, column: str, to: str = "payload") -> DataFrame:
    """df with column ``to``: the payload bytes stored in a binary column of PNGs."""

    @F.pandas_udf("binary")
    def read(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield pd.Series([None if x is None else png_decode(bytes(x)).tobytes() for x in batch], dtype=object)

    return df.withColumn(to, read(F.col(column)))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = encode(table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return digest(docs.select("doc_id", "media"), "media.png").select("doc_id", "media.n_bytes", "digest.*")


QUERIES = {"op3_media": op3_media}
