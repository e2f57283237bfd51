"""Texts as media: payloads stored in lossless WebP images, read back, and described.

Defined cases: null and empty texts are one row of 192 spaces; texts of any
length are cut into tiles of at most 64 x 64 pixels, each an image with a
predictor and a cross-colour transform, or a palette; equal texts give equal
values; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import buffers, spans
from .webp import ROW, from_media, to_media


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def feature(pixels: np.ndarray) -> str:
    """Height and mean red, green and blue, in hundredths."""
    mean = pixels.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (len(pixels) * pixels.shape[1])
    return f"{len(pixels)}x{pixels.shape[1]}:{mean[0]}:{mean[1]}:{mean[2]}"


def _batches(text: pa.Array) -> Iterator[list[bytes]]:
    buf, off = buffers(text)
    raw = memoryview(buf)
    for a, z in spans(off, 1 << 22):
        yield [bytes(raw[off[i] : off[i + 1]]) for i in range(a, z)]


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form of every text."""

    @F.arrow_udf("binary")
    def media(text: pa.Array) -> pa.Array:
        return pa.array([to_media(padded(t)) for part in _batches(text) for t in part], pa.binary())

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media(F.col("text")).alias("media"))


RESULT = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def described(media: DataFrame) -> DataFrame:
    """Digests and features of what is read back from the column `media`."""

    @F.arrow_udf(RESULT)
    def describe(col: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        files = col.to_pylist()
        at = 0
        while at < len(files):
            end, total = at, 0
            while end < len(files) and (end == at or total < 12 << 20):
                total += len(files[end])
                end += 1
            for m, x in zip(files[at:end], from_media(files[at:end]), strict=True):
                b = np.ascontiguousarray(x).tobytes()
                rows.append((len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(x)))
            at = end
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", describe(F.col("media")).alias("_m")).select("doc_id", "n_bytes", "_m.*")


def round_trip(docs: DataFrame) -> DataFrame:
    return described(stored_media(docs))
