"""Quality rules: shape of the words, and bands for zstandard compression ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .textops import BLANKS, map_arrow, raw, texts, words

SYMBOLS = "#*$%&|<>"
#: (bytes below which the row holds, lowest ratio, highest ratio) for whole texts and for fixed chunks.
#: Short texts carry the frame's overhead and have little to repeat; long ones share more of their words. The lowest ratios
#: lie between random letters in words (base64 with blanks: 1.25 below 512 bytes, 1.38 below 2048, 1.41 beyond) and prose.
WHOLE_BANDS = ((128, 0.0, 2.6), (256, 0.9, 2.8), (320, 1.19, 2.8), (384, 1.22, 2.8), (512, 1.27, 2.8), (1024, 1.37, 3.2), (2048, 1.41, 3.2),
               (8192, 1.45, 3.6), (65536, 1.5, 4.0), (None, 1.5, 5.0))
CHUNK_BANDS = ((512, 0.9, 3.2), (None, 1.43, 3.6))
CHUNK_BYTES = 4096
#: The share of a text's bytes in chunks beyond their band that fails it.
CHUNK_SHARE = 0.5
LEVEL = 3


def word_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    own = words(text)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw(text).split(b"\n") if line and not line.isspace()]
    return len(own), chars, symbols, len(lines) - len(set(lines)), repeat_words(own)


def repeat_words(own: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(own) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
    if len(number) == len(own):
        return 0
    _, two = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, back, many = np.unique(two.astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = many[back] > 1
    marked = np.zeros(len(own), bool)
    for shift in range(3):
        marked[shift:len(own) - 2 + shift] |= twice
    return int(marked.sum())


def _inside(ratio: float, n: int, bands) -> bool:
    low, high = next((a, b) for most, a, b in bands if most is None or n < most)
    return low <= ratio <= high


class Compression:
    """Ratios of bytes before to bytes after compression."""

    def __init__(self, level: int = LEVEL):
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

    def ratio(self, data: bytes | memoryview) -> float:
        return len(data) / len(self.zstd.compress(data)) if len(data) else 0.0

    def verdict(self, data: bytes) -> tuple[float, float, bool]:
        """(ratio of the whole, share of bytes in chunks beyond their band, inside)."""
        if not data:
            return 0.0, 0.0, False
        ratio, view, out = self.ratio(data), memoryview(data), 0
        if len(data) <= CHUNK_BYTES:
            out = 0 if _inside(ratio, len(data), WHOLE_BANDS) else len(data)
        else:
            for at in range(0, len(data), CHUNK_BYTES):
                chunk = view[at:at + CHUNK_BYTES]
                out += 0 if _inside(self.ratio(chunk), len(chunk), CHUNK_BANDS) else len(chunk)
        share = out / len(data)
        return ratio, share, _inside(ratio, len(data), WHOLE_BANDS) and share <= CHUNK_SHARE


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def quality_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunk_share) per row.

    ``kept`` is false if the base rule fails; else it says whether the whole
    text compresses within the band of its length and at most half of its bytes
    lie in 4096-byte chunks beyond theirs.  Null and empty texts have no words
    and fail; null ids stay null; repeated rows are judged one by one; an empty
    table gives no rows; other columns are not read.
    """
    def work(batch):
        zstd = Compression()
        rows = []
        for t in texts(batch, text_col):
            f = word_figures(t)
            failed = base_failed(f[0], f[4])
            ratio, share, good = zstd.verdict(raw(t))
            rows.append((*f, failed, good and not failed, ratio, share))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(id_col)), *(pa.array(c, pa.int64()) for c in columns[:5]),
             *(pa.array(c, pa.bool_()) for c in columns[5:7]), *(pa.array(c, pa.float64()) for c in columns[7:])],
            names=[id_col, *NAMES])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), work, f"`{id_col}` {kind}, " + ", ".join(
        f"{n} {t}" for n, t in zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2, strict=True)))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_share"]


def passes(own: list[str | None]) -> list[bool]:
    """The verdict ``kept`` of each text, to filter rows with."""
    zstd = Compression()
    out = []
    for t in own:
        w = words(t)
        out.append(not base_failed(len(w), repeat_words(w)) and zstd.verdict(raw(t))[2])
    return out
