"""Bytes as images in binary columns: PNG through zlib chunks, numpy unfiltering, cosine-transform hashes.

``encode`` pads a payload to whole image rows and writes a grey 8-bit PNG whose compressed stream is cut
into IDAT chunks, each with its CRC-32. ``decode`` tests the signature, every chunk's checksum and the size,
inflates, and undoes the five filters with numpy: runs of one filter by cumulative sums, mixed or Paeth and
average rows along anti-diagonals. ``perceptual_hash`` keeps the signs of the low frequencies of a 2-D cosine
transform of the image reduced to 32 x 32.

Edge cases: a null or empty text is one image row of zero bytes. Ties and repeated rows are worked on row by
row; equal texts give equal values. Extra columns are ignored. A damaged image raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import small_batches, text_column, utf8_texts

#: Samples in an image row; payloads are padded to a positive multiple.
WIDTH = 64
#: Bytes of compressed stream in a chunk.
CHUNK = 1 << 16
#: Bytes of text that a worker holds at once.
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}
#: Side of the reduced image, and of the block of low frequencies.
SIDE, LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter subtracts, from int16 neighbours."""
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) >> 1
    if kind == 4:
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.zeros_like(left)


def encode(payload: bytes, width: int = WIDTH, filter_name: str = "sub", chunk: int = CHUNK, level: int = 6) -> bytes:
    """A grey 8-bit PNG of ``payload``, whose length is a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is no positive multiple of the width")
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    kind = FILTERS[filter_name]
    rows = np.empty((len(image), width + 1), dtype=np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = image
    if kind == 1:
        rows[:, 2:] -= image[:, :-1]
    elif kind == 2:
        rows[1:, 1:] -= image[:-1]
    elif kind:
        wide = np.zeros((len(image) + 1, width + 1), dtype=np.int16)
        wide[1:, 1:] = image
        rows[:, 1:] -= _predicted(kind, wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]).astype(np.uint8)
    stream = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", stream[i : i + chunk]) for i in range(0, len(stream), chunk)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered rows whose first byte is the row's filter."""
    kinds, data = rows[:, 0], rows[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    if not kinds.any():
        return data.copy()
    height, n = data.shape
    if (kinds == 1).all():
        return np.cumsum(data.reshape(height, n // bpp, bpp), axis=1, dtype=np.uint8).reshape(height, n)
    if (kinds == 2).all():
        return np.cumsum(data, axis=0, dtype=np.uint8)
    pixels = n // bpp
    out = np.zeros((height + 1, pixels + 1, bpp), dtype=np.int16)
    source = data.reshape(height, pixels, bpp).astype(np.int16)
    by_kind = [np.flatnonzero(kinds == k) for k in range(5)]
    for d in range(height + pixels - 1):
        for k, of in enumerate(by_kind):
            y = of[(of <= d) & (of > d - pixels)]
            if len(y):
                x = d - y
                out[y + 1, x + 1] = (source[y, x] + _predicted(k, out[y + 1, x], out[y, x + 1], out[y, x])) & 255
    return out[1:, 1:].reshape(height, n).astype(np.uint8)


def decode(media: bytes) -> np.ndarray:
    """The samples (rows x bytes of a row) of a grey or colour 8-bit PNG, after all checksum tests."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, stream, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, *rest = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or any(rest):
        raise ValueError("only plain 8-bit images are read")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), dtype=np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("the stream has another size than the header says")
    return unfilter(raw.reshape(height, width * channels + 1), channels)


def _reduced(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n >= SIDE:
        edges = np.arange(SIDE + 1) * n // SIDE
        sums = np.add.reduceat(image, edges[:-1], axis=axis)
        counts = np.diff(edges).reshape([-1 if i == axis else 1 for i in range(2)])
        return sums / counts
    return np.take(image, np.arange(SIDE) * n // SIDE, axis=axis)


def perceptual_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: which low frequencies lie above their median."""
    small = _reduced(_reduced(image.astype(np.float64), 1), 0)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _encoder(filter_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sizes, media = [], []
            for text in utf8_texts(batch.column(1)):
                sizes.append(len(text))
                media.append(encode(text + bytes(-len(text) % WIDTH if text else WIDTH), WIDTH, filter_name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def to_media(docs: DataFrame, filter_name: str = "sub") -> DataFrame:
    """doc_id, n_bytes, media: every text as an image in a binary column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(_encoder(filter_name), "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "media", BATCH_BYTES):
        rows = []
        for media in batch.column(2).to_pylist():
            image = decode(media)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), perceptual_hash(image)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in DIGESTS.split(", ")])


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each image, with its features."""
    return media.mapInArrow(_digester, DIGESTS)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "media", BATCH_BYTES):
        texts = [decode(m).tobytes()[:n] for m, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "payload"])


def from_media(media: DataFrame) -> DataFrame:
    """doc_id, payload: the bytes without padding."""
    return media.mapInArrow(_reader, "doc_id long, payload binary")
