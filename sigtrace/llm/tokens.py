"""Token counts by byte-pair merging with a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .subwords import lines_of_units, separable
from .textops import held, map_arrow, raw, texts

#: How byte-level vocabularies split a text before merging (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """Counts tokens of a byte-level vocabulary without ever naming a token."""

    MEMO = 300_000

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        number = {}
        name = lambda s: number.setdefault(s, len(number))
        self.base = [name(c) for c in byte_letters()]
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[name(left) << 20 | name(right)] = rank
            self.made.append(name(left + right))
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(SPLIT)
        self.first: dict[str, int] = {}  # tokens of a line's first unit
        self.rest: dict[str, int] = {}  # of a unit with the blank before it
        self.pieces: dict[str, int] = {}

    def merges(self, piece: bytes) -> int:
        """How many merges a piece takes: pop the lowest-rank adjacent pair, leftmost first, until none is left."""
        symbol = [self.base[b] for b in piece]
        end, rank, made = len(symbol), self.rank, self.made
        heap = [r << 40 | i for i in range(end - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before, done = list(range(1, end + 1)), list(range(-1, end - 1)), 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            if symbol[i] < 0 or (j := after[i]) >= end or rank.get(symbol[i] << 20 | symbol[j]) != top >> 40:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j], done = made[top >> 40], -1, done + 1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get(symbol[i] << 20 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank.get(symbol[h] << 20 | symbol[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        return done

    def piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            data = piece.encode("utf-8", "surrogatepass")
            n = len(data) - self.merges(data)
            if len(piece) < 64:
                if len(self.pieces) >= self.MEMO:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def whole(self, text: str) -> int:
        """Tokens of any text; special strings count as one token each."""
        marks = len(self.special.findall(text)) if self.special else 0
        parts = self.special.split(text) if marks else [text]
        return marks + sum(self.piece(x) for part in parts for x in self.pattern.findall(part))

    def _learn(self, memo: dict[str, int], unit: str, lead: str) -> int:
        if len(memo) >= self.MEMO:
            memo.clear()
        n = memo[unit] = self.whole(lead + unit) if separable(unit) else -1
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text, unit by unit where it is regular; units are remembered."""
        if not text:
            return 0
        lines = lines_of_units(text)
        if lines is None:
            return self.whole(text)
        total = len(lines) - 1
        for line in lines:
            for memo, lead, units in ((self.first, "", line[:1]), (self.rest, " ", line[1:])):
                for u in units:
                    n = memo.get(u)
                    if n is None:
                        n = self._learn(memo, u, lead)
                    if n < 0:
                        return self.whole(text)
                    total += n
        return total


def merger(path: str) -> Merger:
    """One per Python worker, so that its memo lives on from batch to batch."""
    return held(("merger", path), lambda: Merger(path))


def token_counts(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    A null or empty text has 0 bytes and 0 tokens. Null ids stay null, repeated
    rows are counted one by one, an empty table gives an empty result; other
    columns are not read. Very long texts take memory in proportion to
    themselves only. ``path`` must be readable on every executor.
    """
    def work(batch):
        counter = merger(path)
        own = texts(batch, text_col)
        sizes = [len(raw(t)) for t in own]
        n = [counter.count(t) for t in own]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(id_col)), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
             pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
