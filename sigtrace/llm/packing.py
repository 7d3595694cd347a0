"""Packing of token sequences: best fit first, then exchanges between underfull bins."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .subwords import separable
from .textops import give_back, held, map_arrow
from .tokens import SPLIT, byte_letters

#: Pieces are packed in shards of about so many documents; each leaves at most about one badly filled bin.
SHARD_DOCS = 8192
#: Texts in which a blank or line feed is no clean cut between two units.
IRREGULAR = r"^[ ]|[ ]$|[ ]{2}|[ ]\n|\n[ ]|\n\n"


def by_ranks(path: str):
    """The vocabulary as ranks of byte strings, where its merges stand in the order of the ids they make; else None."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens") or []}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
    made = [vocab[a + b] for a, b in merges]
    byte = {c: i for i, c in enumerate(byte_letters())}
    own = {t: i for t, i in vocab.items() if t not in special}
    if made != sorted(set(made)) or len(made) + 256 != len(own) or any(c not in byte for t in own for c in t):
        return None
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in own.items()}, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers; units are remembered.

    A slice of texts is cut into units at blanks, and its distinct units are looked up or
    encoded once; where a unit stands in which text is Arrow's work, so the cost per
    token does not depend on Python. A unit that begins with a line feed starts a line
    and has no blank before it; the others have one. Irregular texts are encoded whole.
    """

    MEMO = 200_000
    #: Bytes of text that are cut into units at once.
    SLICE = 2_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes | None] = {}  # ids of a unit; None where it cannot be told apart from its neighbours
        self.old: dict[str, bytes | None] = {}  # the memo before, of which only what is asked for again is kept
        self.feed = self.plain(["\n"])[0]
        blank = chr(256 + 32)  # the letter that byte-level vocabularies write for a blank
        self.blank = np.array([(self.library.id_to_token(i) or "").startswith(blank) for i in range(self.library.get_vocab_size())])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = by_ranks(path)
        give_back()  # what reading the vocabulary took

    def plain(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def ordinary(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings; by ranks where the vocabulary has them, which is some five times faster."""
        if self.quick is None:
            return [np.frombuffer(x, "<u4") for x in self.plain(parts)]
        return [self.quick.encode_to_numpy(p).astype("<u4") for p in parts]

    def after_blank(self, parts: list[str]) -> list[bytes]:
        """Ids of units with a blank before each: many at once, cut where a token begins with the blank."""
        out: list[bytes] = []
        groups = [parts[i:i + 500] for i in range(0, len(parts), 500)]
        for group, ids in zip(groups, self.ordinary([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) != len(group) or starts[0]:
                out += self.plain([" " + u for u in group])
            else:
                data, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes | None]:
        found: dict[str, bytes | None] = dict.fromkeys(new)
        odd = [u for u in new if any(s in u for s in self.special)]
        found |= zip(odd, self.plain([u if u[0] == "\n" else " " + u for u in odd]), strict=True)
        skip = set(odd)
        lines = [u for u in new if u[0] == "\n" and u not in skip and (len(u) == 1 or separable(u[1:]))]
        found |= zip(lines, (self.feed + x.tobytes() for x in self.ordinary([u[1:] for u in lines])), strict=True)
        rest = [u for u in new if u[0] != "\n" and u not in skip and separable(u)]
        found |= zip(rest, self.after_blank(rest), strict=True)
        return found | {u: None for u in odd if not separable(u.removeprefix("\n"))}

    def _ids_of(self, units: list[str]) -> list[bytes | None]:
        """Ids of distinct units; a full memo becomes the old one, from which only what comes again is taken over."""
        if len(self.memo) > self.MEMO:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        new = [u for u in units if u not in memo]
        if new:
            memo |= {u: old[u] for u in new if u in old}
            memo |= self._learn([u for u in new if u not in memo])
        return list(map(memo.__getitem__, units))

    def many(self, own: pa.Array) -> Iterator[memoryview]:
        """The ids of each text, in order; a null text has none."""
        own = own.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(np.asarray(pc.binary_length(own), np.int64))
        start, done = 0, 0
        while start < len(own):
            stop = max(start + 1, int(np.searchsorted(sizes, done + self.SLICE, "right")))
            yield from self._slice(own.slice(start, stop - start))
            start, done = stop, int(sizes[stop - 1])

    def _slice(self, own: pa.Array) -> Iterator[memoryview]:
        odd = np.array(pc.match_substring_regex(own, IRREGULAR))
        regular = pc.if_else(pa.array(odd), pa.scalar("", own.type), own)
        first, none = pa.scalar("\n", own.type), pa.scalar("", own.type)
        cut = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(regular, "\n", " \n"), none), " ")
        ends = np.asarray(cut.offsets, np.int64)
        units = cut.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        ends = ends - ends[0]
        ids = self._ids_of(units.dictionary.to_pylist())
        if None in ids:
            bad = np.array([x is None for x in ids])[np.asarray(units.indices)]
            odd |= np.diff(np.concatenate([[0], np.cumsum(bad)])[ends]) > 0
        spread = pa.array([x or b"" for x in ids], pa.large_binary()).take(units.indices.cast(pa.int64()))
        at = np.frombuffer(spread.buffers()[1], np.int64, len(spread) + 1, spread.offset * 8)[ends].tolist()
        data = memoryview(spread.buffers()[2] or b"")
        whole = iter(self.plain(own.filter(pa.array(odd)).to_pylist()))
        skip = len(self.feed)  # of the line feed that every text was given in front
        for i, irregular in enumerate(odd.tolist()):
            yield memoryview(next(whole)) if irregular else data[at[i] + skip:at[i + 1]]


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def pieces(df: DataFrame, path: str, size: int = 2048, text_col: str = "text", id_col: str = "doc_id", end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and an end id, cut only where they exceed ``size``.

    All pieces of a cut document but the first have the full size. A null or
    empty text is the end id alone.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def work(batch):
        ids = batch.column(batch.schema.get_field_index(id_col))
        rows: list[list] = [[], [], [], [], []]
        for i, data in enumerate(encoder(path).many(batch.column(batch.schema.get_field_index(text_col)))):
            n, start, k = len(data) // 4 + 1, 0, 0
            stop = n - (n - 1) // size * size
            while start < n:
                check = zlib.crc32(data[4 * start:4 * stop])
                for column, x in zip(rows, (i, k, start, stop - start, zlib.crc32(end, check) if stop == n else check), strict=True):
                    column.append(x)
                start, stop, k = stop, stop + size, k + 1
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
            names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), work, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one shard; ``items[b]`` are indices into ``length``."""

    def __init__(self, length: np.ndarray, size: int):
        self.length, self.size = length, size
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest first, each into the fullest bin that still has room."""
        room: list[list[int]] = [[] for _ in range(self.size + 1)]
        some = 0  # bit r: a bin with r places left exists
        for i in np.argsort(-self.length, kind="stable").tolist():
            n = int(self.length[i])
            fits = some >> n << n
            if fits:
                left = (fits & -fits).bit_length() - 1
                b = room[left].pop()
                if not room[left]:
                    some ^= 1 << left
            else:
                left, b = self.size, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += n
            room[left - n].append(b)
            some |= 1 << left - n

    def exchange(self) -> None:
        """Empty the least filled bins into the others for as long as some exchange raises the squared fill.

        A bin gives to fuller ones: a document moves, is swapped for a shorter
        one, two are swapped for one, or one for two. Every step raises the sum
        of squared fills, so the search ends.
        """
        while True:
            open_bins = [b for b in range(len(self.items)) if 0 < self.fill[b] < self.size]
            before = len(open_bins)
            self.at = sorted(open_bins, key=lambda b: (self.fill[b], b))
            self._index(self.at)
            for donor in self.at:
                while self.fill[donor] and self._give(donor):
                    pass
            after = sum(0 < self.fill[b] < self.size for b in range(len(self.items)))
            if after >= before or not any(not f for f in self.fill):
                break
            kept = [b for b in range(len(self.items)) if self.fill[b]]
            self.items, self.fill = [self.items[b] for b in kept], [self.fill[b] for b in kept]
        kept = [b for b in range(len(self.items)) if self.fill[b]]
        self.items, self.fill = [self.items[b] for b in kept], [self.fill[b] for b in kept]

    def _index(self, bins: list[int]) -> None:
        """Per document of an underfull bin: its length and bin; per bin: its fill. Two neighbours in a bin count as one as well."""
        self.doc = np.array([i for b in bins for i in self.items[b]], np.int64)
        self.of = np.array([b for b in bins for _ in self.items[b]], np.int64)
        self.place = {int(d): k for k, d in enumerate(self.doc)}
        self.full = np.array(self.fill, np.int64)
        self.alive = np.zeros(len(self.fill), bool)
        self.alive[bins] = True

    def _give(self, donor: int) -> bool:
        """One exchange between the donor and a bin at least as full; the best for the donor's longest documents first."""
        own = sorted(self.items[donor], key=lambda i: -self.length[i])
        have = self.fill[donor]
        full = self.full[self.of]
        usable = self.alive[self.of] & (self.of != donor) & (full >= have)
        if not usable.any():
            return False
        left = np.where(usable, self.size - full, -1)
        size_of = self.length[self.doc]
        for i in own:  # one document moves, or is swapped for a shorter one
            n = int(self.length[i])
            fit = np.flatnonzero(left >= n)
            if len(fit):
                k = fit[np.argmin(left[fit])]
                return self._swap(donor, [i], int(self.of[k]), [])
            gain = n - size_of
            gain = np.where((gain > 0) & (gain <= left), gain, 0)
            k = int(np.argmax(gain))
            if gain[k]:
                return self._swap(donor, [i], int(self.of[k]), [int(self.doc[k])])
        if len(own) > 1:  # the two longest neighbours for one
            for x, y in zip(own, own[1:], strict=False):
                gain = int(self.length[x] + self.length[y]) - size_of
                gain = np.where((gain > 0) & (gain <= left), gain, 0)
                k = int(np.argmax(gain))
                if gain[k]:
                    return self._swap(donor, [x, y], int(self.of[k]), [int(self.doc[k])])
        same = np.flatnonzero((self.of[1:] == self.of[:-1]) & usable[1:])
        pair = size_of[same] + size_of[same + 1]
        for i in own:  # one for two
            gain = int(self.length[i]) - pair
            gain = np.where((gain > 0) & (gain <= left[same]), gain, 0)
            if len(gain) and gain[k := int(np.argmax(gain))]:
                return self._swap(donor, [i], int(self.of[same[k]]), [int(self.doc[same[k]]), int(self.doc[same[k] + 1])])
        return False

    def _swap(self, donor: int, give: list[int], other: int, take: list[int]) -> bool:
        for i in give:
            self.items[donor].remove(i)
            self.items[other].append(i)
            self.of[self.place[i]] = other
        for i in take:
            self.items[other].remove(i)
            self.items[donor].append(i)
            self.of[self.place[i]] = donor
        moved = int(self.length[give].sum() - self.length[take].sum())
        self.fill[donor] -= moved
        self.fill[other] += moved
        self.full[donor], self.full[other] = self.fill[donor], self.fill[other]
        for b in (donor, other):
            self.alive[b] = 0 < self.fill[b] < self.size
        return True


def pack_lengths(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and how many bins there are."""
    bins = Bins(np.asarray(length, np.int64), size)
    bins.exchange()
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for b, own in enumerate(bins.items):
        own = sorted(own)
        where[own] = b
        offset[own] = np.concatenate([[0], np.cumsum(np.asarray(length)[own])[:-1]])
    return where, offset, len(bins.items)


def pack(parts: DataFrame, n_docs: int, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds (sequence_id, offset) to pieces no longer than ``size``.

    Pieces are dealt by a hash of their own into shards of bounded size, so
    that equal or hot ids spread as well; each shard packs its share.
    """
    shards = max(1, n_docs // SHARD_DOCS)
    schema = parts.schema.simpleString()[len("struct<"):-1]

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece", "ids_crc32"], kind="stable", ignore_index=True)
        where, offset, _ = pack_lengths(pdf["length"].to_numpy(), size)
        return pdf.drop(columns="shard__").assign(sequence_id=where + (int(key[0]) << 40), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return (parts.withColumn("shard__", F.pmod(F.xxhash64(id_col, "piece", "start", "length", "ids_crc32"), F.lit(shards)))
            .groupBy("shard__").applyInPandas(work, f"{schema}, sequence_id long, offset long"))


def best_fit_packing(df: DataFrame, path: str, size: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs all documents into as few sequences of ``size`` tokens as the search finds.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset). A null or
    empty text is one end id; repeated rows are packed one by one; null ids stay
    null; an empty table gives no rows; other columns are not read. Rows that
    are equal in all of id and text go to one shard, so that a table of one
    repeated row is packed by one task: its rows hold a few numbers each.
    """
    return pack(pieces(df, path, size, text_col, id_col), df.count(), size, id_col)
