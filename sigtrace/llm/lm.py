"""Language-model scores by deleted interpolation of bigram and unigram estimates.

The texts are read once.  A map task turns a slice of documents into its
distinct words, its distinct pairs and the sequence of the words; words and
pairs go to buckets by hash, where they are counted over all slices, and the
counts come back to the slice.  Mixture weights are learned from counts from
which the event itself has been deleted; then every slice scores its documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sigtrace.session import cut

from .blobs import bounds, bucket_bits, key_bits, slices, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from .jaccard import NO_ID, _ids, _serial
from .textops import chain, lower_words, map_arrow, texts, word_hashes

PARTS, LEFT_OUT = 7, 2
#: The token that ends a text and stands before its first word; no word hashes to it but by chance.
END = 1
#: Bins of figures per doubling, and rounds of expectation-maximisation.
FINE, ROUNDS = 4, 60
WORDS, PAIRS, TEXT, TOTAL = 0, 1, 2, 3


def learned(ids: np.ndarray, parts: int = PARTS, left_out: int = LEFT_OUT) -> np.ndarray:
    """Whether a document with this id is learned from; a null id is."""
    return np.array([i == NO_ID or zlib.crc32(str(i).encode()) % parts != left_out for i in ids.tolist()], bool)


def _pairs(tokens: np.ndarray, drop: int) -> np.ndarray:
    """A key of each token and the one before; each text begins after an end."""
    before = np.concatenate([np.array([END], np.uint64), tokens])
    return chain(before, 2) >> np.uint64(drop) << np.uint64(drop)


def _ask(docs: DataFrame, bits: int, drop: int) -> DataFrame:
    """Requests by bucket, and the slices themselves on their way to their answers."""
    names = ["bucket", "kind", "slice", "keys", "counts", "ids", "lengths", "sequence"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def work(batch):
        hashes = word_hashes()
        for part in slices(batch, "text"):
            number = _serial()
            mark = (TaskContext.get().partitionId() << 32) + number
            ids = _ids(part)
            # words become hashes text by text, so that a slice's words never stand side by side as objects
            own = [np.append(hashes.of(lower_words(t)), np.uint64(END)) for t in texts(part, "text")]
            lengths = np.array(list(map(len, own)), np.int64)
            tokens = np.concatenate(own)
            del own
            counted = np.repeat(learned(ids), lengths)
            distinct, sequence = np.unique(tokens, return_inverse=True)
            sequence = sequence.astype(np.uint32)
            rows = [[(TaskContext.get().partitionId() * 31 + number) % (1 << bits), TEXT, mark, squeeze_sorted(distinct), b"", squeeze(ids), squeeze(lengths), squeeze(sequence)]]
            asked = [(WORDS, distinct, np.bincount(sequence[counted], minlength=len(distinct)), 0)]
            pairs = _pairs(tokens, drop)
            del tokens, sequence
            pair, back = np.unique(pairs, return_inverse=True)
            asked.append((PAIRS, pair, np.bincount(back[counted], minlength=len(pair)), drop))
            del pairs, back
            for kind, keys, counts, low in asked:
                cuts = bounds(keys, bits).tolist()
                rows += [[b, kind, mark, squeeze_sorted(keys[i:j] >> np.uint64(low)), squeeze(counts[i:j].astype(np.uint32)), b"", b"", b""]
                         for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs, work, "bucket long, kind int, slice long, keys binary, counts binary, ids binary, lengths binary, sequence binary")


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to a bucket's requests, in the order of their keys; of its words also how many are known and their sum."""
    out = [pdf[pdf["kind"] == TEXT]]
    for kind in (WORDS, PAIRS):
        part = pdf[pdf["kind"] == kind]
        if len(part):
            keys = [unsqueeze_sorted(k) for k in part["keys"]]
            sizes = [len(k) for k in keys]
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([unsqueeze(c, np.uint32) for c in part["counts"]])
            total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.uint64)
            answers = np.split(total[back], np.cumsum(sizes)[:-1])
            out.append(part.assign(keys=b"", counts=[squeeze(a) for a in answers]))
            if kind == WORDS:
                sums = np.array([np.count_nonzero(total), total.sum()], np.int64)
                out.append(part.iloc[:1].assign(kind=TOTAL, slice=-1, keys=b"", counts=squeeze(sums)))
    return pd.concat(out)


class Slice:
    """A slice's documents with the counts of their tokens and pairs."""

    def __init__(self, row, drop: int):
        self.ids, self.lengths = unsqueeze(row.ids, np.int64), unsqueeze(row.lengths, np.int64)
        words = unsqueeze_sorted(row.keys)
        sequence = unsqueeze(row.sequence, np.uint32)
        totals, pair_totals = unsqueeze(row.words, np.uint64).astype(np.int64), unsqueeze(row.pairs, np.uint64).astype(np.int64)
        self.pair, self.first, self.back = np.unique(_pairs(words[sequence], drop), return_index=True, return_inverse=True)
        self.word = totals[sequence]
        end = totals[np.searchsorted(words, np.uint64(END))]
        self.context = np.concatenate([[end], self.word[:-1]])
        self.both = pair_totals[self.back]

    def events(self) -> pd.DataFrame:
        """How often each bin of (context, both, word) occurs in learned texts, one occurrence deleted from each count."""
        counted = np.repeat(learned(self.ids), self.lengths)
        many = np.bincount(self.back[counted], minlength=len(self.pair))
        use = many > 0
        at = self.first[use]
        context, both, word = self.context[at] - 1, self.both[at] - 1, self.word[at] - 1
        share = np.where(both > 0, both / np.maximum(context, 1), 0)
        bins = pd.DataFrame({"context": _bin(context, 1), "share": _bin(share, FINE), "word": _bin(word, FINE), "many": many[use]})
        return bins.groupby(["context", "share", "word"], as_index=False)["many"].sum()

    def scores(self, known: int, total: int, weights: dict[int, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: (tokens known, base score, the model's score), logs to base 10."""
        table = np.array([weights[b] for b in sorted(weights)])
        place = np.searchsorted(sorted(weights), np.clip(_bin(self.context, 1), min(weights), max(weights)), "right") - 1
        low, one, two = table[place].T
        # a context never seen leaves its share to the other two
        none = self.context == 0
        two = np.where(none, 0, two)
        low, one = np.where(none, low / (low + one), low), np.where(none, one / (low + one), one)
        p = low / (known + 1) + one * self.word / max(total, 1) + two * self.both / np.maximum(self.context, 1)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        base = np.log10((self.word + 1) / (total + known + 1))
        return np.add.reduceat((self.word > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def _bin(values: np.ndarray, fine: int) -> np.ndarray:
    """Bins of a doubling's ``fine``-th part; nothing has the bin -10000."""
    return np.where(values > 0, np.floor(fine * np.log2(np.maximum(values, 1e-12))), -10_000).astype(np.int64)


def _middle(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > -10_000, 2.0 ** ((bins + 0.5) / FINE), 0.0)


def mixture_weights(events: pd.DataFrame, known: int, total: int) -> dict[int, tuple[float, float, float]]:
    """Expectation-maximisation of (uniform, unigram, bigram) weights in each bucket of context counts."""
    out = {}
    for bucket, own in events.groupby("context"):
        p = np.stack([np.full(len(own), 1 / (known + 1)), np.minimum(1, _middle(own["word"].to_numpy()) / max(total - 1, 1)),
                      np.minimum(1, _middle(own["share"].to_numpy()))])
        many, w = own["many"].to_numpy(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = w[:, None] * p
            part *= many / part.sum(0)
            w = part.sum(1) + 1e-3
            w /= w.sum()
        out[int(bucket)] = tuple(w.tolist())
    return out or {-10_000: (0.5, 0.5, 0.0)}


def interpolated_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learned from rows whose id's checksum mod 7 is not 2. ``base_score`` is the
    add-one unigram score; ``score`` mixes pair and word frequencies and the
    uniform probability of a known or the unknown word, with weights per
    doubling of the context's count. A null or empty text is its end alone; a
    null id is learned from and stays null; repeated rows are learned and scored
    one by one; an empty table gives no rows, and if no row is learned from,
    nothing is known. Other columns are not read; ids are whole numbers.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs = df.count()
    bits, drop = bucket_bits(n_docs), 64 - key_bits(n_docs)
    asked = _ask(docs, bits, drop)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    counted = asked.groupBy("bucket").applyInPandas(_count, schema)
    # the sums per bucket, as many as buckets, travel as slice -1 and are kept apart
    table = cut(_joined_with_totals(counted))
    totals = np.array([unsqueeze(r[0], np.int64) for r in table.where("slice = -1").select("words").collect()] or [[0, 0]]).reshape(-1, 2).sum(0)
    known, total = int(totals[0]), int(totals[1])
    table = table.where("slice >= 0")

    def events(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield Slice(row, drop).events()

    bins = (table.mapInPandas(events, "context long, share long, word long, many long")
            .groupBy("context", "share", "word").agg(F.sum("many").alias("many")).toPandas())  # at most some 40 x 160 x 160 bins
    weights = mixture_weights(bins, known, total)

    def score(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                own = Slice(row, drop)
                n_known, base, scores = own.scores(known, total, weights)
                yield pd.DataFrame({"id": pd.array(own.ids, "Int64").copy(), "held_out": ~learned(own.ids), "n_tokens": own.lengths,
                                    "n_known": n_known, "train_tokens": total, "base_score": base, "score": scores}).assign(
                    id=lambda f: f["id"].mask(f["id"] == NO_ID))

    out = table.mapInPandas(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def _joined_with_totals(counted: DataFrame) -> DataFrame:
    """Slices with their answers; totals (one short row per bucket) summed in a slice of their own, -1."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["slice"].iloc[0]) < 0:
            sums = np.array([unsqueeze(c, np.int64) for c in pdf["counts"]]).sum(0)
            return pd.DataFrame({"slice": [-1], "keys": [b""], "ids": [b""], "lengths": [b""], "sequence": [b""], "words": [squeeze(sums)], "pairs": [b""]})
        text = pdf[pdf["kind"] == TEXT].iloc[:1]
        answers = [squeeze(np.concatenate([unsqueeze(c, np.uint64) for c in pdf[pdf["kind"] == k].sort_values("bucket")["counts"]]))
                   for k in (WORDS, PAIRS)]
        return text[["slice", "keys", "ids", "lengths", "sequence"]].assign(words=answers[0], pairs=answers[1])
    return counted.groupBy("slice").applyInPandas(
        work, "slice long, keys binary, ids binary, lengths binary, sequence binary, words binary, pairs binary")
