"""Phrases that hold together, from a weighted de Bruijn graph of each language.

1. A map task turns a slice of texts into its distinct words and the sequence of
   them; buckets of words count them over all slices. A word below the least count
   can be in no phrase: it ends a piece like a full stop. The others get numbers.
2. Each slice sends its edges, runs of four words between the overlapping nodes
   of three, once with a count; shorter runs stand at the end of a piece. A
   bucket holds all edges out of a node. An edge's weight is its sum; a node's flow is
   that of its edges and of the pieces that end in it, and a node whose whole flow goes
   into one edge is held with it in one row (a step of a unary path). Pairs flow likewise,
   slice by slice, so that no bucket holds all that follows a frequent pair.
3. Frequent phrases look up the counts of their parts, take their weakest cut, and
   go where a longer one has nearly all their occurrences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blobs import bucket_bits, slices, squeeze, squeeze_sorted, squeeze_words, stored, unsqueeze, unsqueeze_sorted, unsqueeze_words
from .textops import map_arrow, raw, texts

# pieces end at . , ; : ! ? and line ends (all become a line feed); words at blank and tab; A-Z are lowered
_PIECES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
TEXT, ASK, ANSWER, NAMES = range(4)
UNIT, SHARE = 2_000_000, 80
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
KEY = ["lang", "w1", "w2", "w3", "w4"]


def _serial(state: dict) -> int:
    """A number for every slice of a language, unique over all tasks."""
    task = TaskContext.get()
    state["n"] = state["n"] + 1 if state.get("task") == task.taskAttemptId() else 0
    state["task"] = task.taskAttemptId()
    return (task.partitionId() << 32) + state["n"]


def _read(docs: DataFrame, bits: int) -> DataFrame:
    """Per slice and language: its words as places in a list, and that list by buckets, with counts."""
    names = ["kind", "lang", "slice", "bucket", "words", "counts", "sequence"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    state: dict = {}

    def work(batch):
        for part in slices(batch, "text"):
            own, by_lang = texts(part, "text"), {}
            for i, (name, text) in enumerate(zip(texts(part, "lang"), own, strict=True)):
                if text:
                    by_lang.setdefault(name, []).append(i)
            rows = []
            for lang, members in by_lang.items():
                data = b"\n".join(raw(own[i]) for i in members).translate(_PIECES).replace(b"\n", b" . ")
                found = pa.array([w for w in data.split(b" ") if w], pa.binary()).dictionary_encode()
                words, code = found.dictionary.to_pylist(), np.asarray(found.indices, np.int64)
                bucket = np.array([xxhash.xxh3_64_intdigest(w) >> 64 - bits if w != b"." else -1 for w in words], np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words)) + (0 if b"." in words else 1)  # 0 is the end of a piece
                sequence = place[code].astype(np.uint32)
                many = np.bincount(code, minlength=len(words))[order].astype(np.uint64)
                mark = _serial(state)
                rows.append([TEXT, lang, mark, None, b"", b"", squeeze(sequence)])
                ends = np.flatnonzero(np.diff(bucket[order], prepend=-2))
                for group, at in zip(np.split(order, ends[1:]), ends.tolist(), strict=True):
                    if (b := int(bucket[group[0]])) >= 0:
                        rows.append([ASK, lang, mark, b, squeeze_words([words[k] for k in group.tolist()]), squeeze(many[at:at + len(group)]), b""])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs, work, "kind int, lang string, slice long, bucket long, words binary, counts binary, sequence binary")


def _number(least: int, bits: int):
    """Numbers for a bucket's frequent words, sent back to every slice in the order it asked; 0 for the others."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unsqueeze_words(w) for w in pdf["words"]]
        found = pa.array([w for part in asked for w in part], pa.binary()).dictionary_encode()
        words, code = found.dictionary.to_pylist(), np.asarray(found.indices, np.int64)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, code, np.concatenate([unsqueeze(c, np.uint64) for c in pdf["counts"]]).astype(np.int64))
        frequent = np.flatnonzero(total >= least)
        if len(frequent) >> 32 - bits:
            raise OverflowError("more frequent words than 32-bit numbers")
        number = np.zeros(len(words), np.uint32)
        number[frequent] = (np.arange(1, len(frequent) + 1) << bits) - (1 << bits) + int(pdf["bucket"].iloc[0]) + 1
        answers = np.split(number[code], np.cumsum([len(a) for a in asked])[:-1])
        out = pdf[["lang", "slice", "bucket"]].assign(kind=ANSWER, numbers=[squeeze(a) for a in answers], words=b"", counts=b"", total=0)
        names = pdf[["lang", "bucket"]].iloc[:1].assign(
            kind=NAMES, slice=-1, numbers=squeeze(number[frequent]), words=squeeze_words([words[k] for k in frequent.tolist()]),
            counts=squeeze(total[frequent]), total=int(total.sum()))
        return pd.concat([out, names])[["kind", "lang", "slice", "bucket", "numbers", "words", "counts", "total"]]
    return work


def _edges(bits: int):
    """A slice's distinct edges and pairs with their counts, by bucket of the node or pair they start from."""
    def work(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                number = np.concatenate([[np.uint32(0)], *(unsqueeze(a["numbers"], np.uint32) for a in r.answers)])
                if rows := _slice_edges(number[unsqueeze(r.sequence, np.uint32)], bits):
                    yield pd.DataFrame(rows, columns=["bucket", "first", "rest", "counts"]).assign(lang=r.lang)
    return work


def _slice_edges(words: np.ndarray, bits: int) -> list[tuple]:
    words = np.concatenate([words, np.zeros(4, np.uint32)]).astype(np.uint64)
    run = [words[:-4]]
    for k in (1, 2, 3):
        run.append(np.where(run[-1] > 0, words[k:len(words) - 4 + k], 0))
    use = run[1] > 0
    low = np.uint64(32)
    first, rest = (run[0][use] << low) | run[1][use], (run[2][use] << low) | run[3][use]
    out = []
    for kind, a, b in ((0, first, None), (1, first[rest > 0], rest[rest > 0])):
        node = a if b is None else a ^ ((b >> low) * _SPREAD)
        bucket = ((node * _SPREAD) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.lexsort((a, bucket) if b is None else (b, a, bucket))
        a, bucket = a[order], bucket[order]
        new = np.concatenate([[True], (a[1:] != a[:-1])]) if len(a) else np.zeros(0, bool)
        if b is not None:
            b = b[order]
            new[1:] |= b[1:] != b[:-1]
        at = np.flatnonzero(new)
        many, a, bucket = np.diff(np.append(at, len(a))).astype(np.uint32), a[at], bucket[at]
        b = None if b is None else b[at]
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                out.append((kind << bits | k, squeeze_sorted(a[i:j]), b"" if b is None else squeeze(b[i:j]), squeeze(many[i:j])))
    return out


def _sums(least: int):
    """A bucket's frequent pairs, or edges and nodes: (w1..w4, n_words, a, l3), l3 being the flow of an edge's first node.

    ``unary`` marks an edge that takes its node's whole flow; the node has no row of its own.
    """
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = np.concatenate([unsqueeze_sorted(x) for x in pdf["first"]])
        edges = bool(pdf["rest"].iloc[0])
        rest = np.concatenate([unsqueeze(x, np.uint64) for x in pdf["rest"]]) if edges else np.zeros(len(first), np.uint64)
        many = np.concatenate([unsqueeze(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
        order = np.lexsort((rest, first))
        first, rest, many = first[order], rest[order], many[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
        at = np.flatnonzero(new)
        first, rest, many = first[at], rest[at], np.add.reduceat(many, at)
        low, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
        w = [first >> low, first & mask, rest >> low, rest & mask]
        if not edges:
            use = many >= least
            return _rows(w, use, 2, many, many, False)
        node = np.concatenate([[True], (first[1:] != first[:-1]) | (w[2][1:] != w[2][:-1])])
        starts = np.flatnonzero(node)
        flow = np.add.reduceat(many, starts)  # of the node's edges, and of pieces that end in it (w4 = 0)
        of = np.cumsum(node) - 1
        edge = (w[3] > 0) & (many >= least)
        whole = edge & (many == flow[of])
        held = np.zeros(len(starts), bool)
        held[of[whole]] = True
        last = [w[0][starts], w[1][starts], w[2][starts], np.zeros(len(starts), np.uint64)]
        return pd.concat([_rows(w, edge, 4, many, flow[of], whole), _rows(last, (flow >= least) & ~held, 3, flow, flow, False)])

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        out = work(pdf)
        return out.assign(lang=pd.Series([pdf["lang"].iloc[0]] * len(out), index=out.index, dtype=object))
    return rows


def _rows(w, use, n_words, count, before, unary) -> pd.DataFrame:
    frame = {f"w{k + 1}": x[use].astype(np.int64) for k, x in enumerate(w)}
    return pd.DataFrame({**frame, "n_words": n_words, "a": count[use], "l3": before[use], "unary": unary[use] if isinstance(unary, np.ndarray) else unary})


def _key(*words: Column | int) -> Column:
    own = [F.lit(w).cast("long") if isinstance(w, int) else w for w in words]
    return F.struct(*(x.alias(f"w{k}") for k, x in enumerate([*own, *[F.lit(0).cast("long")] * (4 - len(own))], 1)))


def graph(df: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, names): frequent runs of 2 to 4 words by number with their counts, and the words of the numbers.

    phrases: lang, w1..w4 (0: none), n_words, a, l3; names: lang, number, word, f, total (words of the language).
    """
    docs = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    bits = bucket_bits(df.count())
    read = stored(_read(docs, bits), "slices")
    numbered = stored(read.where(F.col("kind") == ASK).select("lang", "slice", "bucket", "words", "counts").groupBy("lang", "bucket").applyInPandas(
        _number(least, bits), "kind int, lang string, slice long, bucket long, numbers binary, words binary, counts binary, total long"), "numbers")
    answers = (numbered.where(F.col("kind") == ANSWER).groupBy("slice")
               .agg(F.sort_array(F.collect_list(F.struct("bucket", "numbers"))).alias("answers")))  # a row per bucket
    edges = (read.where(F.col("kind") == TEXT).select("lang", "slice", "sequence").join(answers, "slice")
             .mapInPandas(_edges(bits), "bucket long, first binary, rest binary, counts binary, lang string"))
    phrases = edges.groupBy("lang", "bucket").applyInPandas(
        _sums(least), "w1 long, w2 long, w3 long, w4 long, n_words int, a long, l3 long, unary boolean, lang string")
    phrases = stored(phrases, "phrases")
    # the nodes held by their only edge
    held = phrases.where("unary").select("w1", "w2", "w3", F.lit(0).cast("long").alias("w4"), F.lit(3).alias("n_words"), "a", "l3", F.lit(False).alias("unary"), "lang")
    phrases = phrases.unionByName(held).drop("unary")

    def spell(frames):
        for pdf in frames:
            for r in pdf[pdf["numbers"].str.len() > 0].itertuples(index=False):
                yield pd.DataFrame({"lang": r.lang, "number": unsqueeze(r.numbers, np.uint32).astype(np.int64), "f": unsqueeze(r.counts, np.int64),
                                    "word": [w.decode("utf-8", "replace") for w in unsqueeze_words(r.words)]})

    named = numbered.where(F.col("kind") == NAMES)
    names = named.mapInPandas(spell, "lang string, number long, f long, word string")
    totals = named.groupBy("lang").agg(F.sum("total").alias("n"))
    return phrases, names.join(totals, "lang")


def collocations(df: DataFrame, least: int = 30, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases that hold together best.

    A phrase of 2 to 4 words within a piece occurs ``a`` >= ``least`` times; cut in
    two, its parts occur l and r times, and the cut with the lowest floor(2000000 * a / (l + r))
    counts, the first of equal ones. A phrase is dropped if a longer one that
    contains it has at least 80% of its occurrences. Ranked by score, then a, both
    descending, then the phrase by its bytes, up to ``most``.

    A null text is empty, a null language is ``und``; repeated rows count each;
    very long texts are counted whole; words below ``least`` count in n only; a language without
    frequent phrases, and an empty table, give no rows. Other columns are not read.
    """
    phrases, names = graph(df, least, text_col, lang_col)
    w1, w2, w3, w4 = (F.col(f"w{k}") for k in (1, 2, 3, 4))
    inner = F.when(F.col("n_words") == 4, F.array(_key(w1, w2, w3), _key(w2, w3, w4), _key(w1, w2), _key(w2, w3), _key(w3, w4))).when(
        F.col("n_words") == 3, F.array(_key(w1, w2), _key(w2, w3)))
    longer = phrases.select("lang", F.explode(inner).alias("s"), F.col("a").alias("longer")).select("lang", "s.*", "longer")
    none = F.lit(None)
    own = phrases.select(*KEY, "n_words", "a", "l3", none.cast("long").alias("longer"))
    own = own.unionByName(longer.select(*KEY, none.cast("int").alias("n_words"), none.cast("long").alias("a"), none.cast("long").alias("l3"), "longer"))
    own = own.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("n_words", "a", "l3", "longer")))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = stored(own.where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * SHARE)).drop("longer"), "kept")

    counts = phrases.select(*KEY, F.col("a").alias("f")).unionByName(
        names.select("lang", F.col("number").alias("w1"), *(F.lit(0).cast("long").alias(f"w{k}") for k in (2, 3, 4)), "f"))
    two, three = F.col("n_words") == 2, F.col("n_words") == 3
    part = lambda k, side, key: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), key.alias("key"))
    parts = F.when(two, F.array(part(1, "l", _key(w1)), part(1, "r", _key(w2)))).when(
        three, F.array(part(1, "l", _key(w1)), part(1, "r", _key(w2, w3)), part(2, "l", _key(w1, w2)), part(2, "r", _key(w3)))).otherwise(
        F.array(part(1, "l", _key(w1)), part(1, "r", _key(w2, w3, w4)), part(2, "l", _key(w1, w2)), part(2, "r", _key(w3, w4)), part(3, "r", _key(w4))))
    whole = F.struct("w1", "w2", "w3", "w4", "n_words", "a", "l3")
    asked = kept.select("lang", whole.alias("phrase"), F.explode(parts).alias("p")).select("lang", "phrase", "p.k", "p.side", "p.key.*")
    cuts = asked.join(counts, KEY).groupBy("lang", "phrase", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cuts = cuts.withColumn("l", F.coalesce("l", "phrase.l3")).withColumn("a", F.col("phrase.a"))
    score = F.expr(f"cast(a as decimal(20,0)) * cast({UNIT} as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase.*", "cut.score", "cut.l", "cut.r")
    # whoever can be among the first, ties included; only their words are spelled
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = best.withColumn("near", near).where(F.col("near") <= most).drop("near")
    words = best.select("lang", *KEY[1:], "a", "l", "r", "score", F.posexplode(F.array(w1, w2, w3, w4)).alias("at", "number")).where("number > 0")
    spelled = words.join(names, ["lang", "number"]).groupBy(*KEY, "a", "l", "r", "score", "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    out = spelled.withColumn("rank", ranks.cast("long")).where(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The phrases in SQL: all runs of one to four words of all pieces.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, rid, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : w[i:i + k - 1])) AS g
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k >= 2 AND f >= 30),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
           FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
cuts AS (SELECT kept.lang, kept.g, a, i, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS i FROM kept) kept
           JOIN f x ON x.lang = kept.lang AND x.g = kept.g[1:i] JOIN f y ON y.lang = kept.lang AND y.g = kept.g[i + 1:]),
best AS (SELECT lang, g, a, arg_min(struct_pack(l := l, r := r, score := score), (score, i)) AS b FROM cuts GROUP BY lang, g, a),
r AS (SELECT best.lang, array_to_string(g, ' ') AS phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM best JOIN n USING (lang)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
