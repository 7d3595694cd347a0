"""Hashed keys as sorted, compressed arrays: what travels where a row per key would be too much.

Map tasks send the distinct keys of a slice of documents, cut by the keys' first
bits into buckets; a bucket's task sees each key once per slice, however many
documents hold it.  The number of buckets follows the number of documents, so a
bucket holds about as many keys at every size.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sigtrace.session import shared_dir

#: A slice ends at so many documents or bytes of text, whichever comes first.
SLICE_DOCS, SLICE_BYTES = 8192, 16_000_000
#: Documents per bucket of keys.
BUCKET_DOCS = 1 << 12

_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, first bytes first, so that leading zeros vanish."""
    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return _ZSTD.compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(_UNZSTD.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Like squeeze, for ascending numbers: only their differences."""
    return squeeze(np.diff(keys, prepend=keys.dtype.type(0)))


def unsqueeze_sorted(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unsqueeze(data, kind), dtype=kind)


def bucket_bits(n_docs: int) -> int:
    return max(6, math.ceil(math.log2(max(1, n_docs) / BUCKET_DOCS + 1)))


def key_bits(n_docs: int) -> int:
    """Bits of a hash that travel: two of all keys, about 1024 a document, agree once in a million keys."""
    return min(64, max(40, math.ceil(math.log2(max(2, n_docs))) + 30))


def bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2^bits buckets begins in sorted 64-bit keys, and the end."""
    firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]]).astype(np.int64)


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES):
    """Runs of rows of a batch that are small enough to be worked on at once."""
    texts = batch.column(batch.schema.get_field_index(text_col))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= SLICE_DOCS or total + n > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def squeeze_words(words: list[bytes]) -> bytes:
    """Words without line feeds, in order."""
    return squeeze(np.frombuffer(b"\n".join(words), np.uint8))


def unsqueeze_words(data: bytes) -> list[bytes]:
    return unsqueeze(data, np.uint8).tobytes().split(b"\n") if data else []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: worked out once, safe from lost executors."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)
