"""Binary payloads kept as PNG images in a binary column, with low-frequency cosine hashes.

``encode``/``decode`` write and read 8-bit grey PNG (signature, IHDR, IDAT, IEND;
each chunk with its CRC-32). ``decode`` tests every checksum and undoes all five
row filters in numpy. ``store`` and ``features`` are the operators on DataFrames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewatch.llm.common import slices, texts, widened

BLOCK = 576
WIDTH = 24
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(samples: np.ndarray, level: int = 1) -> bytes:
    """A 2-D uint8 array as PNG. Each row takes the filter (none, sub, up) with the least sum of signed residues."""
    height, width = samples.shape
    sub = samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    tries = np.stack([samples, sub, up])
    cost = np.minimum(tries, 256 - tries.astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tries[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; ValueError where a checksum or the form is wrong."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(png) and not ended:
        (length,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + length], png[at + 8 + length : at + 12 + length]
        if len(crc) != 4 or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"chunk {kind!r}: wrong checksum")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
            size = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise ValueError("the PNG is cut short")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(rows) != size[0] * (size[1] + 1):
        raise ValueError("the PNG has another size than it says")
    rows = rows.reshape(size[0], size[1] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters; runs of rows of one kind that need no loop are done at once."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for low, high in zip([0, *edges], [*edges, len(rows)]):
        part, kind = rows[low:high], kinds[low]
        if kind == 0:
            out[low:high] = part
        elif kind == 1:
            out[low:high] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[low:high] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        else:
            for y in range(low, high):
                out[y] = _unfilter_row(kind, rows[y], above)
                above = out[y]
        if high > low:
            above = out[high - 1]
    return out


def _unfilter_row(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = [], 0, 0
    for x, b in zip(row.tolist(), above.tolist()):
        if kind == 3:
            guess = (left + b) >> 1
        elif kind == 4:
            p = left + b - corner
            a, c, d = abs(p - left), abs(p - b), abs(p - corner)
            guess = left if a <= c and a <= d else b if c <= d else corner
        else:
            raise ValueError(f"unknown filter {kind}")
        left, corner = (x + guess) & 255, b
        out.append(left)
    return np.array(out, np.uint8)


def _cosines(n: int, keep: int) -> np.ndarray:
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


_DCT = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: signs of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32 by area means, against their median."""
    height, width = samples.shape
    table = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    y, x = np.arange(33) * height / 32, np.arange(33) * width / 32

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:  # the running sum at places between samples
        i, j = np.minimum(y.astype(int), height - 1), np.minimum(x.astype(int), width - 1)
        fy, fx = (y - i)[:, None], (x - j)[None, :]
        top = table[np.ix_(i, j)] * (1 - fx) + table[np.ix_(i, j + 1)] * fx
        low = table[np.ix_(i + 1, j)] * (1 - fx) + table[np.ix_(i + 1, j + 1)] * fx
        return top * (1 - fy) + low * fy

    area = at(y, x)
    small = (area[1:, 1:] - area[:-1, 1:] - area[1:, :-1] + area[:-1, :-1]) * (1024 / (height * width))
    low = (_DCT @ small @ _DCT.T).ravel().round(6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """The text, filled up with bytes 255 to a positive multiple of BLOCK."""
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text + b"\xff" * (size - len(text))


def store(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (of the text, unpadded) and ``media`` (its payload as PNG of width 24).

    A null text counts as an empty one, which gives one block of bytes 255. Other
    columns are carried along; one called n_bytes or media is replaced.
    """
    df = df.drop("n_bytes", "media")
    schema = widened(df, n_bytes="long", media="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            sizes, media = [], []
            for text in texts(batch.column(column)).cast(pa.large_binary()).to_pylist():
                sizes.append(len(text))
                media.append(encode(np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def features(df: DataFrame, column: str = "media", keys: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads the stored bytes back and returns ``keys`` with digests of the payload and of its stored form.

    A row whose media is null gives nulls; a damaged one raises ValueError.
    """
    rows = df.select(*keys, column)
    schema = widened(df.select(*keys), payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for png in batch.column(column).to_pylist():
                if png is None:
                    found.append((None,) * 6)
                    continue
                samples = decode(png)
                payload = samples.tobytes()
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*found)) if found else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)
