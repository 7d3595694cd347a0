"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textops import held, map_arrow, texts

#: The classifier is fitted on at most so many labelled rows, chosen by a hash of the id; each with its whole text.
FIT_ROWS = 3000
BUCKETS, WIDTH, EPOCHS, SEED = 1 << 15, 16, 4, 11
#: A calibration document is wrongly rejected at most this often.
REJECT_RATE = 0.001

LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id", parts: int = 4, left_out: int = 2) -> Column:
    """Whether the checksum of an id, written as text, leaves a row out of learning; a null id is never left out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == left_out, F.lit(False))


def subwords(word: str) -> list[int]:
    """Hash buckets of a word's runs of 2 to 4 bytes, its ends marked, and of the word itself."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    n, crc = len(marked), zlib.crc32
    return [crc(marked) % BUCKETS, *[crc(marked[i:i + k]) % BUCKETS for k in (2, 3, 4) for i in range(n - k + 1)]]


class WordScores(dict):
    """Rows of scores by word: the mean of the word's projected subword embeddings; emptied when full."""

    LIMIT = 200_000

    def __init__(self, projected: np.ndarray):
        super().__init__()
        self.projected, self.rows = projected.astype(np.float32), np.zeros((self.LIMIT, projected.shape[1]), np.float32)

    def mean(self, own: list[str]) -> np.ndarray:
        new = [w for w in set(own) if w not in self]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = list(set(own))
        if len(new) > self.LIMIT:  # more different words in one text than the memo holds
            return np.array([self._score([w])[0] for w in own], float).mean(0)
        if new:
            at = len(self)
            self.rows[at:at + len(new)] = self._score(new)
            self.update(zip(new, range(at, at + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.__getitem__, own), np.int64, len(own))].mean(0, dtype=np.float64)

    def _score(self, own: list[str]) -> np.ndarray:
        parts = [subwords(w) for w in own]
        sizes = np.array(list(map(len, parts)))
        flat = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.projected[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


@dataclass
class LanguageModel:
    """Embeddings by bucket, a softmax over languages, a temperature and a threshold."""

    languages: list[str]
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scorer(self) -> WordScores:
        """The word table of this model; one lives on in a Python worker, from task to task."""
        key = hash((self.embedding.tobytes(), self.softmax.tobytes()))
        return held(("language", key), lambda: WordScores(self.embedding @ self.softmax))

    def logits(self, text: str | None, scorer: WordScores | None = None) -> np.ndarray | None:
        """Scores of a whole text, its words weighing alike; None without a letter."""
        own = LETTERS.findall(text.lower()) if text else []
        return (scorer or self.scorer()).mean(own) + self.bias if own else None

    def judge(self, text: str | None, scorer: WordScores | None = None) -> tuple[str, float, bool]:
        """(language or und, calibrated probability, rejected)."""
        z = self.logits(text, scorer)
        if z is None:
            return "und", 0.0, True
        p = _soft(z[None] / self.temperature)[0]
        k = int(np.argmax(p))
        return self.languages[k], float(min(1.0, p[k])), bool(p[k] < self.threshold)


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = SEED) -> LanguageModel:
    """Stochastic gradient descent over (text, language); every tenth row calibrates instead."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages))), np.zeros(len(languages)))
    memo: dict[str, np.ndarray] = {}
    examples = []
    for text, lang in rows:
        own = LETTERS.findall(text.lower())
        if own:
            for w in own:
                if w not in memo:
                    memo[w] = np.array(subwords(w))
            examples.append((own, languages.index(lang)))
    model.softmax = rng.normal(0, 0.1, model.softmax.shape)
    learn = [e for i, e in enumerate(examples) if i % 10 or len(examples) < 50]
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learn)):
            own, y = learn[k]
            # a random window of words, so that short texts are learned as well
            size = int(rng.integers(3, 60))
            at = int(rng.integers(0, max(1, len(own) - size + 1)))
            seen = [memo[w] for w in own[at:at + size]]
            ids = np.concatenate(seen)
            weight = np.concatenate([np.full(len(s), 1 / len(s) / len(seen)) for s in seen])
            mean = weight @ model.embedding[ids]
            p = _soft((mean @ model.softmax + model.bias)[None])[0]
            p[y] -= 1
            rate = 0.5 * (1 - done / steps)
            np.add.at(model.embedding, ids, -rate * weight[:, None] * len(seen) * (model.softmax @ p))
            model.softmax -= rate * np.outer(mean, p)
            model.bias -= 0.1 * rate * p
            done += 1
    _calibrate(model, [e for i, e in enumerate(examples) if not i % 10] or learn)
    return model


def _calibrate(model: LanguageModel, examples: list[tuple[list[str], int]]) -> None:
    """The temperature that makes probabilities most likely, then the threshold that keeps right answers."""
    if not examples:
        return
    z = np.array([model.logits(" ".join(own)) for own, _ in examples])
    y = np.array([k for _, k in examples])
    loss = lambda t: -np.log(_soft(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = min(np.geomspace(0.05, 8, 60), key=loss)
    p = _soft(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    if len(right):
        model.threshold = float(min(0.5, right[int(REJECT_RATE * len(right))]) * 0.7)


def accepted(model: LanguageModel | None, own: list[str | None]) -> list[bool]:
    """Whether each text's language is told with enough confidence."""
    scorer = model.scorer() if model else None
    return [bool(model) and not model.judge(t, scorer)[2] for t in own]


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel | None:
    """Fit on at most ``rows`` labelled rows outside the held-out quarter; None if there are none."""
    able = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    mark = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col).cast("string")), F.lit(1 << 40))
    many = able.count()
    some = able.where(mark < F.lit(int((1 << 40) * min(1.0, 1.2 * rows / max(1, many))))) if many > rows else able
    got = some.select(mark.alias("mark"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).orderBy("mark", "text", "lang").limit(rows).collect()
    return fit([(r["text"], r["lang"]) for r in got]) if got else None


def identify(df: DataFrame, model: LanguageModel | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) per row, from the whole text alone.

    Texts that are null or have no letter are ``und`` with score 0, rejected; so
    is everything if no row could be learned from.  Ties between languages go to
    the first by name; null ids stay null; repeated rows are judged one by one;
    an empty table gives no rows; other columns are not read.
    """
    def work(batch):
        scorer = model.scorer() if model else None
        judged = [model.judge(t, scorer) if model else ("und", 0.0, True) for t in texts(batch, text_col)]
        lang, score, rejected = zip(*judged, strict=True)
        at = batch.schema.get_field_index
        yield pa.RecordBatch.from_arrays(
            [batch.column(at(id_col)), batch.column(at("held_out__")), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
             pa.array(rejected, pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col, held_out(id_col).alias("held_out__")), work,
                     f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
