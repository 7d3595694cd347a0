"""How far sources of a language drift apart: an audit of their smoothed term frequencies.

1. A map task turns a slice of documents into counts per (group, term) and into
   documents per term, cut into buckets by the terms' hashes; a bucket's task
   adds them up over all slices and keeps the terms of enough documents.
2. A bucket's counts are a matrix, groups by kept terms, held as a K-squared
   quadtree: quadrants without a count are not stored. For two groups the tree is
   walked once for both: a quadrant empty for both costs one product, and only
   where one of them has a count the leaf is opened.
3. Sums per pair of groups and the best terms per group are added up over the buckets.

All frequencies are whole numbers, so every sum is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigtrace.session import cut

from .blobs import bucket_bits, slices, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from .textops import map_arrow, raw, texts

#: Side of a leaf of the quadtree, and of the blocks of groups whose pairs one task compares.
LEAF, GROUPS = 32, 256
#: A language's groups (a name and a number each) are broadcast up to so many in all; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
UNIT, EXTRA = 1_000_000_000, 5

# terms: A-Z and a-z, of which A-Z are lowered, and all that is not ASCII
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BREAK = b" . "


def price(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + EXTRA) / total), exactly."""
    if len(count) and int(count.max()) + EXTRA > (1 << 63) // UNIT:
        return np.array([1 + UNIT * (int(c) + EXTRA) // total for c in count.ravel()], np.int64).reshape(count.shape)
    return 1 + UNIT * (count.astype(np.int64) + EXTRA) // total


class Quadtree:
    """A matrix of counts as a tree of quadrants; a quadrant without counts has no node.

    ``child[d][i, q]`` is the node of quadrant q (row half * 2 + column half) of node i at depth d, or -1.
    Nodes of the last depth are dense leaves of side LEAF.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, count: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.depth = max(0, (max(*shape, 1) - 1).bit_length() - LEAF.bit_length() + 1)
        code = _morton(row // LEAF, column // LEAF, self.depth)
        nodes = [code]
        self.child: list[np.ndarray] = []
        own, inner = np.unique(code, return_inverse=True)
        self.leaf = np.zeros((len(own), LEAF, LEAF), np.int64)
        self.leaf[inner, row % LEAF, column % LEAF] = count
        for _ in range(self.depth):
            nodes = np.unique(own >> 2)
            child = np.full((len(nodes), 4), -1, np.int64)
            child[np.searchsorted(nodes, own >> 2), own & 3] = np.arange(len(own))
            self.child.insert(0, child)
            own = nodes
        self.root = 0 if len(row) else -1

    def differences(self, total: np.ndarray) -> np.ndarray:
        """Sum over all columns of the absolute difference of the groups' frequencies, for every pair of rows."""
        rows, columns = self.shape
        self.total, self.blank = total, np.array([1 + UNIT * EXTRA // int(t) for t in total], np.int64)
        self.out = np.zeros((rows, rows), np.int64)
        self._visit(0, self.root, self.root, 0, 0, 0)
        return self.out

    def _visit(self, depth: int, one: int, two: int, top_one: int, top_two: int, left: int) -> None:
        """Two quadrants over the same columns, from row ``top_one`` and row ``top_two`` on."""
        rows, columns = self.shape
        side = LEAF << self.depth - depth
        if top_one >= rows or top_two >= rows or left >= columns or top_one > top_two:
            return
        a, b = slice(top_one, min(top_one + side, rows)), slice(top_two, min(top_two + side, rows))
        wide = min(side, columns - left)
        if one < 0 and two < 0:
            self.out[a, b] += wide * np.abs(self.blank[a, None] - self.blank[None, b])
        elif depth == self.depth:
            p, q = self._prices(one, a, wide), self._prices(two, b, wide)
            for i in range(len(p)):
                self.out[a.start + i, b] += np.abs(p[i] - q).sum(1)
        else:
            half = side // 2
            for high in (0, 1):
                for low in (0, 1):
                    for side_two in (0, 1):
                        self._visit(depth + 1, self._child(depth, one, high, side_two), self._child(depth, two, low, side_two),
                                    top_one + high * half, top_two + low * half, left + side_two * half)

    def _child(self, depth: int, node: int, row: int, column: int) -> int:
        return -1 if node < 0 else int(self.child[depth][node, 2 * row + column])

    def _prices(self, leaf: int, rows: slice, wide: int) -> np.ndarray:
        many = rows.stop - rows.start
        if leaf < 0:
            return np.repeat(self.blank[rows, None], wide, 1)
        count = self.leaf[leaf, :many, :wide]
        return np.stack([price(c, int(t)) for c, t in zip(count, self.total[rows], strict=True)])


def _morton(row: np.ndarray, column: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for k in range(bits):
        out |= (row.astype(np.int64) >> k & 1) << 2 * k + 1 | (column.astype(np.int64) >> k & 1) << 2 * k
    return out


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """Per slice, language and bucket: its terms, how many documents have each, and counts per (source, term)."""
    names = ["lang", "bucket", "terms", "docs", "sources", "cell_source", "cell_term", "cell_count"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3]

    def work(batch):
        for part in slices(batch, "text"):
            own, lang, source = texts(part, "text"), texts(part, "lang"), texts(part, "source")
            by_lang: dict[str, list[int]] = {}
            for i, (name, text) in enumerate(zip(lang, own, strict=True)):
                if text:
                    by_lang.setdefault(name, []).append(i)
            rows = []
            for name, members in by_lang.items():
                found = pa.array(_BREAK.join(raw(own[i]).translate(_TERMS) for i in members).split(), pa.binary()).dictionary_encode()
                terms, code = found.dictionary.to_pylist(), np.asarray(found.indices, np.int64)
                mark = terms.index(b".") if b"." in terms else -1
                doc = np.cumsum(code == mark)
                code, doc = code[code != mark], doc[code != mark]
                if not len(code):
                    continue
                sources = sorted({source[i] for i in members})
                place = {s: k for k, s in enumerate(sources)}
                of_doc = np.array([place[source[i]] for i in members])
                many = np.bincount(np.unique(doc * len(terms) + code) % len(terms), minlength=len(terms))
                cell, count = np.unique(of_doc[doc] * len(terms) + code, return_counts=True)
                bucket = np.array([xxhash.xxh3_64_intdigest(t) >> 64 - bits for t in terms], np.int64)
                rows += _cut(name, terms, many, sources, cell // len(terms), cell % len(terms), count, bucket, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs, work, "lang string, bucket long, terms binary, docs binary, sources array<string>, cell_source binary, cell_term binary, cell_count binary")


def _cut(lang, terms, many, sources, source, term, count, bucket, mark):
    """A slice's counts of one language, a row per bucket."""
    if mark >= 0:
        bucket[mark] = -1
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(terms), np.int64)
    ends = np.flatnonzero(np.diff(bucket[order], prepend=-2))
    starts = np.repeat(ends, np.diff(np.append(ends, len(order))))
    place[order] = np.arange(len(order)) - starts  # a term's place within its bucket
    cells = np.argsort(bucket[term], kind="stable")
    source, term, count = source[cells], term[cells], count[cells]
    for own, at in zip(np.split(order, ends[1:]), bucket[order][ends].tolist(), strict=True):
        if at >= 0:
            i, j = np.searchsorted(bucket[term], [at, at + 1])
            yield [lang, at, squeeze_words([terms[k] for k in own.tolist()]), squeeze(many[own].astype(np.uint32)), sources,
                   squeeze(source[i:j].astype(np.uint32)), squeeze(place[term[i:j]].astype(np.uint32)), squeeze(count[i:j].astype(np.uint64))]


def _merge(least: int):
    """A bucket's counts over all slices, for the terms that enough documents have."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        # slice by slice into one set of terms and cells
        own = [unsqueeze_words(t) for t in pdf["terms"]]
        found = pa.array([t for part in own for t in part], pa.binary()).dictionary_encode()
        terms, code = found.dictionary.to_pylist(), np.asarray(found.indices, np.int64)
        many = np.zeros(len(terms), np.int64)
        np.add.at(many, code, np.concatenate([unsqueeze(d, np.uint32) for d in pdf["docs"]]).astype(np.int64))
        sources = sorted({s for part in pdf["sources"] for s in part}, key=raw)
        place = {s: k for k, s in enumerate(sources)}
        at, cells, counts = 0, [], []
        for part, r in zip(own, pdf.itertuples(index=False), strict=True):
            of = np.array([place[s] for s in r.sources], np.int64)[unsqueeze(r.cell_source, np.uint32).astype(np.int64)]
            cells.append(of * len(terms) + code[at:at + len(part)][unsqueeze(r.cell_term, np.uint32).astype(np.int64)])
            counts.append(unsqueeze(r.cell_count, np.uint64).astype(np.int64))
            at += len(part)
        cell, back = np.unique(np.concatenate(cells), return_inverse=True)
        count = np.zeros(len(cell), np.int64)
        np.add.at(count, back, np.concatenate(counts))
        kept = np.flatnonzero(many >= least)
        place = np.full(len(terms), -1, np.int64)
        place[kept] = np.arange(len(kept))
        use = place[cell % len(terms)] >= 0
        source, term, count = cell[use] // len(terms), place[cell[use] % len(terms)], count[use]
        sums = np.zeros(len(sources), np.int64)
        np.add.at(sums, source, count)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "bucket": pdf["bucket"].iloc[0], "n_terms": len(kept), "terms": [squeeze_words([terms[k] for k in kept.tolist()])],
                             "sources": [sources], "sums": [sums.tolist()], "source": [squeeze(source.astype(np.uint32))],
                             "term": [squeeze(term.astype(np.uint32))], "count": [squeeze(count)]})[:1 if len(kept) else 0]
    return work


class _Block:
    """A bucket's matrix with the language's groups as rows."""

    def __init__(self, row):
        self.groups = list(row.groups)
        self.totals = [int(n) + EXTRA * int(row.v) for n in row.group_totals]
        place = {s: k for k, s in enumerate(self.groups)}
        self.terms = unsqueeze_words(row.terms)
        self.row = np.array([place[s] for s in row.sources], np.int64)[unsqueeze(row.source, np.uint32).astype(np.int64)]
        self.term = unsqueeze(row.term, np.uint32).astype(np.int64)
        self.count = unsqueeze(row.count, np.int64)

    def pairs(self, one: int, two: int) -> pd.DataFrame:
        """Sums of differences for the pairs of two blocks of groups."""
        rows = np.concatenate([np.arange(k * GROUPS, min((k + 1) * GROUPS, len(self.groups))) for k in ({one} | {two})])
        rows.sort()
        place = np.full(len(self.groups), -1, np.int64)
        place[rows] = np.arange(len(rows))
        use = place[self.row] >= 0
        tree = Quadtree(place[self.row[use]], self.term[use], self.count[use], (len(rows), len(self.terms)))
        sums = tree.differences(np.array(self.totals, np.int64)[rows])
        i, j = np.triu_indices(len(rows), 1)
        mine = (rows[i] // GROUPS == one) & (rows[j] // GROUPS == two)
        i, j = i[mine], j[mine]
        names = np.array(self.groups, object)[rows]
        return pd.DataFrame({"one": names[i], "two": names[j], "value": sums[i, j]})

    def best(self, lang_total: int, most: int) -> pd.DataFrame:
        """Per group the terms most above the language's frequency, with ties by the term's bytes."""
        every = np.zeros(len(self.terms), np.int64)
        np.add.at(every, self.term, self.count)
        level = price(every, lang_total)
        order = np.argsort(self.row, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(self.row[order])) + 1):
            if not len(own):
                continue
            group = int(self.row[own[0]])
            value = price(self.count[own], self.totals[group]) - level[self.term[own]]
            own, value = own[value > 0], value[value > 0]
            if len(own) > most:
                enough = np.partition(value, len(value) - most)[len(value) - most]
                own, value = own[value >= enough], value[value >= enough]
            first = sorted(zip((-value).tolist(), (self.terms[k] for k in self.term[own].tolist()), strict=True))[:most]
            out += [(self.groups[group], t.decode("utf-8", "replace"), -v) for v, t in first]
        return pd.DataFrame(out, columns=["one", "two", "value"])


def divergence(df: DataFrame, least: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one, and by which terms it stands out.

    Terms are runs of letters A-Z (lowered), a-z and characters beyond ASCII; a
    language keeps those of at least ``least`` of its documents. Part ``pair``: for every two
    sources of a language the sum of |p - q| over its kept terms, all ranks. Part
    ``term``: a source's terms with p above the language's, up to rank ``most``.

    Null text, language and source read as ''; a source without kept terms (or
    text) is compared all the same; repeated rows count each; an
    empty table, and a language with one source and no kept term, give no rows;
    ties go by the item's bytes. Very long texts are counted like short ones. Other columns are not read.
    Pairs are as many as sources squared, as asked for; documents never meet in pairs.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(name(text_col).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    groups = docs.select("lang", "source").distinct()
    buckets = _counted(docs, bucket_bits(df.count())).groupBy("lang", "bucket").applyInPandas(
        _merge(least), "lang string, bucket long, n_terms long, terms binary, sources array<string>, sums array<long>, source binary, term binary, count binary")
    buckets = cut(buckets)
    sums = (buckets.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s"))
            .groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n")))
    kept = buckets.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    totals = cut(groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
                 .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    langs = (totals.where("v > 0").groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
             .select("lang", "v", F.col("g.source").alias("groups"), F.col("g.n").alias("group_totals")))
    langs = F.broadcast(langs) if totals.count() <= BROADCAST_GROUPS else langs
    blocks = buckets.join(langs, "lang")
    last = F.floor((F.size("groups") - 1) / GROUPS).cast("int")
    tiles = (blocks.withColumn("tile_one", F.explode(F.sequence(F.lit(0), last)))
             .withColumn("tile_two", F.explode(F.sequence(F.col("tile_one"), last))))

    def compare(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if len(out := _Block(r).pairs(int(r.tile_one), int(r.tile_two))):
                    yield out.assign(lang=r.lang)

    def stand_out(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if len(out := _Block(r).best(sum(map(int, r.group_totals)) + EXTRA * int(r.v), most)):
                    yield out.assign(lang=r.lang)

    schema = "one string, two string, value long, lang string"
    sums = tiles.mapInPandas(compare, schema).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    bare = totals.where("v = 0").select("lang", F.col("source").alias("one"))
    bare = bare.join(bare.withColumnRenamed("one", "two"), "lang").where("one < two").select("lang", "one", "two", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(bare)
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = blocks.mapInPandas(stand_out, schema).select("lang", F.col("one").alias("source"), F.lit("term").alias("part"), F.col("two").alias("item"), "value")
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= most))


def ranked(rows: DataFrame) -> DataFrame:
    by: list[Column] = [F.desc("value"), F.asc("item")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)))


#: The audit in SQL: all terms of all texts, every pair of sources over every kept term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(s) + 5 * any_value(v)) AS q
      FROM (SELECT p.lang, term, c, v, sum(c) OVER (PARTITION BY p.lang) AS s FROM p JOIN v USING (lang)) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
            coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - l.q AS value FROM p JOIN l USING (lang, term) WHERE p.c > 0 AND p.p > l.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
