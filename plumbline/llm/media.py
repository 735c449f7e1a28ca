"""Media columns: payloads kept as lossless images, and features of the pixels read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import webp

#: Bytes of a row of pixels at least, and what payloads are padded to a multiple of.
UNIT = 64
#: Payload bytes of one image at most; a longer payload is kept as several files, one after the other.
IMAGE_BYTES = 1 << 22


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with zeros to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def stored(data: bytes) -> bytes:
    """The payload as lossless WebP: a sample a byte, in rows of as many units as keep the image low enough."""
    out = []
    for k in range(0, len(data), IMAGE_BYTES):
        part = np.frombuffer(data, np.uint8, min(IMAGE_BYTES, len(data) - k), k)
        units = -(-len(part) // (UNIT * webp.SIDE))
        part = np.pad(part, (0, -len(part) % (UNIT * units)))  # only the last image's
        out.append(webp.encode_samples(part.reshape(-1, UNIT * units)))
    return b"".join(out)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels of each file in some stored bytes."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at : at + size])
        at += size


def read_back(media: bytes, length: int) -> tuple[bytes, list[np.ndarray]]:
    """The payload of ``length`` bytes that stored bytes hold, and the images' samples."""
    found = [((p >> 8) & 255).astype(np.uint8) for p in images(media)]
    return b"".join(x.tobytes() for x in found)[:length], found


def feature(samples: list[np.ndarray]) -> str:
    """Sizes, mean, deviation and entropy of the samples of a payload's images."""
    n = sum(np.bincount(x.ravel(), minlength=256) for x in samples)
    p = n / n.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    sizes = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in samples)
    return f"{sizes} mean={mean:.4f} std={deviation:.4f} bits={entropy:.4f}"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """For each row: sizes and digests of its text's payload, stored as WebP and read back, and a feature of the pixels.

    ``keep_media`` adds the stored bytes (``media binary``).  Null texts count as empty: a payload
    of zeros.  Equal texts get equal values; an empty table gives none; nothing is shuffled, and
    one text is held at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
              "feature string" + ", media binary" * keep_media)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(text: str | None) -> list:
        data, n = payload(text)
        media = stored(data)
        back, samples = read_back(media, len(data))
        out = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)]
        return out + [media] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                rows = [row(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds))], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, schema)
