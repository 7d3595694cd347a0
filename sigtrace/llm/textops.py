"""Small helpers that the operators on text share: words, hashes, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# bytes.lower() lowers exactly A-Z and leaves the bytes of other characters alone.
BLANKS = " \t\n\x0b\f\r"


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Runs of anything but blank, tab, \\n, \\v, \\f, \\r: what ``bytes.split`` gives."""
    return raw(text).split()


def lower_words(text: str | None) -> list[bytes]:
    return raw(text).lower().split()


class WordHashes(dict):
    """64-bit hashes by word; a bounded memo, emptied when full."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


_held: dict = {}


def held(key, make: Callable[[], object]):
    """What ``make`` gives, kept in the Python worker under ``key``; anything kept under another key goes first.

    So a worker that serves one operator after the other holds one memo at a time.
    """
    if _held.get("key") != key:
        _held.clear()
        give_back()
        _held.update(key=key, value=make())
    return _held["value"]


def word_hashes() -> WordHashes:
    return held("word hashes", WordHashes)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` neighbours, order kept."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out ^= hashes[i:i + n]
        out *= _MIX[i % 3]
        out ^= out >> np.uint64(31)
    return out


def give_back() -> None:
    """Return freed memory to the system, so that idle Python workers stay small between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``work`` to every Arrow batch; empty batches are skipped."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        batch = None
        give_back()
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def keep_rows(df: DataFrame, verdict: Callable[[list[str | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """Rows whose text passes; all columns stay as they are, whatever their names."""
    def work(batch):
        yield batch.filter(pa.array(verdict(texts(batch, text_col)), pa.bool_()))
    return map_arrow(df, work, df.schema)
