"""N-gram Jaccard join with prefix trees.

1. Every document's set of hashed shingles is cut into buckets; a bucket's task
   tells which shingles stand in another document too.  A document of which
   fewer than three quarters of the shingles do can link with nothing.
2. The others' sets are collapsed by their hash, and documents that share one
   of their rarest shared shingles are put into blocks.
3. In a block all sets are stored in a prefix tree; each set walks down it,
   sharing the overlap counted so far, and leaves a subtree as soon as what is
   left below cannot make up the overlap a link needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sigtrace.session import cut

from .blobs import bounds, bucket_bits, key_bits, slices, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from .linking import components
from .textops import chain, lower_words, map_arrow, texts, word_hashes

#: Ids of possible partners are broadcast up to so many (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A block with more sets is worked on in tiles of so many.
TILE = 1000
#: Text worked on at once; a slice's sets take several times as much.
SLICE_BYTES = 8_000_000
NO_ID = -(1 << 63)
SHARED = 0xFFFF


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a shorter text is one run, an empty one none."""
    own = lower_words(text)
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    return np.unique(chain(word_hashes().of(own), size))


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(batch.column(0).cast(pa.int64()), NO_ID), np.int64)


def _requests(docs: DataFrame, size: int, bits: int, drop: int) -> DataFrame:
    """Per slice and bucket: its shingles and which document of the slice holds each, or that several do."""
    names = ["bucket", "keys", "owner", "ids", "n", "digest", "row"]

    def work(batch):
        for k, part in enumerate(slices(batch, "text", SLICE_BYTES)):
            ids, sets = _ids(part), [shingle_set(t, size) for t in texts(part, "text")]
            n = np.array([len(s) for s in sets], np.int64)
            keys, owner = np.concatenate(sets) >> np.uint64(drop) << np.uint64(drop), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            single = first & np.concatenate([first[1:], [True]]) if len(keys) else first
            here = np.bincount(owner[~single], minlength=len(sets)).astype(np.int64)
            keys, owner = keys[first], np.where(single, owner, SHARED).astype(np.uint16)[first]
            cuts, own_ids = bounds(keys, bits), squeeze(ids)
            rows = [[b, squeeze_sorted(keys[i:j] >> np.uint64(drop)), squeeze(owner[i:j]), own_ids, b"", b"", None]
                    for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
            mark = (TaskContext.get().partitionId() << 40) + (_serial() << 16)
            digests = np.array([digest(s) for s in sets], np.int64)
            rows.append([(1 << bits) + mark % 61, b"", squeeze(here), own_ids, squeeze(n), squeeze(digests), mark])
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs, work, "bucket long, keys binary, owner binary, ids binary, n binary, digest binary, row long")


_count = {"task": None, "n": 0}


def _serial() -> int:
    """0, 1, 2, ... within a task attempt."""
    task = TaskContext.get().taskAttemptId()
    _count["n"] = _count["n"] + 1 if _count["task"] == task else 0
    _count["task"] = task
    return _count["n"]


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, n, digest, row, shared): the documents themselves, and how many shingles of a bucket they share."""
    out = []
    asked = []
    for r in pdf.itertuples(index=False):
        if r.n:
            n = unsqueeze(r.n, np.int64)
            out.append(pd.DataFrame({"id": unsqueeze(r.ids, np.int64), "n": n, "digest": unsqueeze(r.digest, np.int64),
                                     "row": int(r.row) + np.arange(len(n)), "shared": unsqueeze(r.owner, np.int64)}))
        else:
            asked.append((unsqueeze_sorted(r.keys), unsqueeze(r.owner, np.uint16), r.ids))
    if asked:
        keys = np.concatenate([a[0] for a in asked])
        _, back, many = np.unique(keys, return_inverse=True, return_counts=True)
        shared, at = many[back] > 1, 0
        for own, owner, ids in asked:
            mine = owner[shared[at:at + len(own)] & (owner != SHARED)]
            at += len(own)
            count = np.bincount(mine)
            some = np.flatnonzero(count)
            if len(some):
                out.append(pd.DataFrame({"id": unsqueeze(ids, np.int64)[some], "n": None, "digest": None, "row": None, "shared": count[some]}))
    frame = pd.concat(out) if out else pd.DataFrame(columns=["id", "n", "digest", "row", "shared"])
    return frame.astype({"id": "int64", "n": "Int64", "digest": "Int64", "row": "Int64", "shared": "int64"})


class Trie:
    """Sets as paths of ranks; a node holds a run of ranks and what is known of the sets below it."""

    __slots__ = ("run", "kids", "sets", "least", "most", "rest")

    def __init__(self, run: np.ndarray, least: int, most: int, rest: int):
        self.run, self.kids, self.sets = run, {}, []
        self.least, self.most, self.rest = least, most, rest  # sizes of sets at or below; longest way below the run

    def add(self, ranks: np.ndarray, n: int, who: int) -> None:
        node, at = self, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            at += len(node.run)
            node.rest = max(node.rest, len(ranks) - at)
            if at == len(ranks):
                node.sets.append((who, n))
                return
            kid = node.kids.get(int(ranks[at]))
            if kid is None:
                node.kids[int(ranks[at])] = leaf = Trie(ranks[at:], n, n, 0)
                leaf.sets.append((who, n))
                return
            room = min(len(kid.run), len(ranks) - at)
            differ = np.flatnonzero(kid.run[:room] != ranks[at:at + room])
            same = int(differ[0]) if len(differ) else room
            if same < len(kid.run):
                upper = Trie(kid.run[:same], kid.least, kid.most, kid.rest + len(kid.run) - same)
                upper.kids[int(kid.run[same])] = kid
                kid.run = kid.run[same:]
                node.kids[int(ranks[at])] = kid = upper
            node = kid

    def partners(self, ranks: np.ndarray, n: int, member: np.ndarray, percent: int):
        """Sets that link with (ranks, n); ``member`` marks its ranks."""
        low, high = -(-percent * n // 100), 100 * n // percent
        todo = [(self, 0)]
        while todo:
            node, overlap = todo.pop()
            if node.most < low or node.least > high:
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(member[node.run]))
            for who, m in node.sets:
                if 100 * overlap >= percent * (n + m - overlap):
                    yield who
            if node.kids:
                left = len(ranks) - int(np.searchsorted(ranks, node.run[-1], "right")) if len(node.run) else len(ranks)
                best = overlap + min(left, node.rest)
                if 100 * best >= percent * (n + max(node.least, low) - best):
                    todo += [(kid, overlap) for kid in node.kids.values()]


def trie_links(keys: list[np.ndarray], n: list[int], percent: int, probes: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect.

    ``keys`` are the sets' possibly shared shingles, ``n`` their whole sizes.
    With ``probes``, only links of those sets with any other are looked for.
    """
    flat = np.concatenate(keys)
    _, back, many = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((np.arange(len(many)), -many))  # frequent first: copies share long paths
    rank = np.empty(len(many), np.int64)
    rank[order] = np.arange(len(many))
    ranks, at = [], 0
    for k in keys:
        own = np.sort(rank[back[at:at + len(k)]])
        ranks.append(own)
        at += len(k)
    useful = int((many > 1).sum())  # ranks from here on stand in one set
    ranks = [r[:np.searchsorted(r, useful)] for r in ranks]
    root, links, member = Trie(np.zeros(0, np.int64), 1 << 62, 0, 0), [], np.zeros(useful, bool)
    parent = list(range(len(keys)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = [i for i in range(len(keys)) if probes and not probes[i]]
    for i in first + [i for i in range(len(keys)) if not probes or probes[i]]:
        if not probes or probes[i]:
            member[ranks[i]] = True
            for j in root.partners(ranks[i], n[i], member, percent):
                if (a := find(i)) != (b := find(j)):
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))
            member[ranks[i]] = False
        root.add(ranks[i], n[i], i)
    return links


def _block(percent: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(np.ascontiguousarray(k, np.int64), np.int64) for k in pdf["keys"]]
        probes = None if not pdf["probe"].notna().any() else pdf["probe"].astype(bool).tolist()
        links = trie_links(keys, pdf["n"].tolist(), percent, probes) if len(pdf) > 1 else []
        nid = pdf["nid"].to_numpy()
        return pd.DataFrame({"a": [nid[i] for i, _ in links], "b": [nid[j] for _, j in links]}, dtype="int64")
    return work


def _grouped(df: DataFrame, size: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """(id, n, digest, row, component, root) per row: its set, and of linked sets the smallest id and a common number."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs = df.count()
    bits, drop = bucket_bits(n_docs), 64 - key_bits(n_docs)
    found = (_requests(docs, size, bits, drop).groupBy("bucket")
             .applyInPandas(_answers, "id long, n long, digest long, row long, shared long"))
    found = cut(found.groupBy("id", "n", "digest", "row").agg(F.sum("shared").alias("shared")))
    rows = found.where("n IS NOT NULL")
    able = cut(found.groupBy("id").agg(F.sum("shared").alias("shared"), F.min("n").alias("least"), F.max("n").alias("most"))
               .where(f"most > 0 AND 100 * shared >= {percent} * least").select("id"))
    nodes = _nodes(docs, able, size)
    blocks, keys = _blocks(nodes, percent)
    links = _links(blocks, keys, percent)
    joined = components(links)
    low = joined.join(nodes.select("nid", "low"), F.col("node") == F.col("nid"))
    low = low.join(low.groupBy("root").agg(F.min("low").alias("component")), "root").select("nid", "component", "root")
    known = nodes.join(low, "nid", "left").select("digest", "n", F.coalesce("component", "low").alias("component"), F.coalesce("root", "nid").alias("root"))
    return rows.join(known, ["digest", "n"], "left")


def jaccard_groups(df: DataFrame, size: int = 5, percent: int = 75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) per row: the smallest id reachable by links of at least ``percent`` Jaccard.

    Exact up to equal 64-bit hashes. Null and empty texts have no shingles and
    link with nothing; the ids are whole numbers; a null id is kept and never
    the smallest, and a component of null ids only has the id null. Rows with
    one id and different texts are linked only if their texts are; repeated
    rows are returned as often as they came. An empty table gives no rows; other
    columns are not read.
    """
    out = _grouped(df, size, percent, text_col, id_col)
    none = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    kind = df.schema[id_col].dataType
    return out.select(none("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", none("id")).cast(kind).alias("component_id"))


def first_rows(df: DataFrame, size: int = 5, percent: int = 75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of linked texts, with all its columns: the one with the smallest id.

    Decided by row: a null id comes after all others, and of rows with one id
    and different texts each belongs to the group of its own text. Of rows equal in id and shingles the
    first by text stays. Rows without words link with nothing and all stay. An empty table gives no rows;
    columns of any kind and name are kept.

    Ids none of whose rows stays are dropped by a join, so that texts stay where they are; only rows
    whose id does not tell (null, or of several rows) are looked at again.
    """
    groups = _grouped(df, size, percent, text_col, id_col)
    group = [F.col("root"), F.when(F.col("root").isNull(), F.col("digest")), F.when(F.col("root").isNull(), F.col("n"))]
    order = F.struct(F.col("id") == NO_ID, "id", "digest", "n")
    sets = cut(groups.where("n > 0").groupBy(*[g.alias(f"g{k}") for k, g in enumerate(group)], "id", "digest", "n").agg(F.count("*").alias("rows")))
    best = sets.groupBy("g0", "g1", "g2").agg(F.min(order).alias("first")).select("first.id", "first.digest", "first.n", F.lit(True).alias("stays"))
    told = sets.groupBy("id", "digest", "n").agg(F.sum("rows").alias("rows")).join(best, ["id", "digest", "n"], "left")
    told = told.unionByName(groups.where("n = 0").groupBy("id", "digest", "n").agg(F.count("*").alias("rows")).withColumn("stays", F.lit(True)))
    told = cut(told.withColumn("stays", F.coalesce("stays", F.lit(False))))
    ids = cut(told.groupBy("id").agg(F.max("stays").alias("stays"), F.sum("rows").alias("rows")))
    small = lambda f: F.broadcast(f) if f.count() <= BROADCAST_IDS else f
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    marked = df.select(F.struct("*").alias("doc"), key.alias("id"))
    gone = ids.where("NOT stays").select("id")
    unclear = cut(ids.where(f"stays AND (rows > 1 OR id = {NO_ID})").select("id"))
    left = marked.join(small(gone), "id", "left_anti")
    clear = left.join(small(unclear), "id", "left_anti").select("doc.*")
    if not unclear.limit(1).count():
        return clear

    def sign(batch):
        own = [shingle_set(t, size) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(digest, own), pa.int64()), pa.array(map(len, own), pa.int64())],
                                         names=[*batch.schema.names, "digest", "n"])

    again = left.join(small(unclear), "id", "left_semi").select("doc", "id", F.col(f"doc.{text_col}").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in again.schema) + ", digest long, n long"
    again = map_arrow(again, sign, schema).join(told.where("stays").select("id", "digest", "n"), ["id", "digest", "n"])
    plain = [F.col(f"doc.`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    one = (again.where("n > 0").groupBy("id", "digest", "n").agg(F.min_by("doc", F.struct("text", F.xxhash64(*plain))).alias("doc"))
           .select("doc").unionByName(again.where("n = 0").select("doc")))
    return clear.unionByName(one.select("doc.*"))


def _nodes(docs: DataFrame, able: DataFrame, size: int) -> DataFrame:
    """The distinct sets of documents that may have a partner: (nid, digest, n, low, shingles)."""
    ids = F.broadcast(able) if able.count() <= BROADCAST_IDS else able

    def work(batch):
        for part in slices(batch, "text", SLICE_BYTES):
            seen, rows = set(), []
            for i, t in zip(part.column(0).to_pylist(), texts(part, "text"), strict=True):
                own = shingle_set(t, size)
                if len(own):
                    d = digest(own)
                    rows.append((d, len(own), None if i == NO_ID else i, None if (d, len(own)) in seen else own.view(np.int64)))
                    seen.add((d, len(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["digest", "n", "id", "shingles"])

    marked = docs.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    sets = map_arrow(marked.join(ids, "id", "left_semi"), work, "digest long, n long, id long, shingles array<long>")
    nodes = sets.groupBy("digest", "n").agg(F.min("id").alias("low"), F.first("shingles", ignorenulls=True).alias("shingles"))
    return cut(nodes.withColumn("nid", F.monotonically_increasing_id()))


def _blocks(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(nid, root) of documents that may link, and (nid, n, keys) with the shingles they share, frequent first."""
    each = nodes.select("nid", "n", F.explode("shingles").alias("s"))
    many = each.groupBy("s").agg(F.count("*").alias("many")).where("many > 1")
    need = F.ceil(F.col("n") * percent / 100)
    shared = (each.join(many, "s").groupBy("nid", "n").agg(F.sort_array(F.collect_list(F.struct(-F.col("many"), "s"))).alias("own"))
              .where(F.size("own") >= need))
    keys = cut(shared.select("nid", "n", F.col("own.s").alias("keys")))
    # a set misses at most n - need of its shingles, so the rarest (shared - need + 1) hold one of any partner
    tail = F.expr(f"slice(keys, -(size(keys) - CAST(ceil(n * {percent} / 100) AS INT) + 1), size(keys))")
    rare = cut(keys.select("nid", F.explode(tail).alias("s")))
    hub = rare.groupBy("s").agg(F.min("nid").alias("b"), F.count("*").alias("many")).where("many > 1").select("s", "b")
    return components(rare.join(hub, "s").select(F.col("nid").alias("a"), "b")), keys


def _links(blocks: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    blocks = cut(blocks)
    sizes = blocks.groupBy("root").agg(F.count("*").alias("many"))
    large = cut(sizes.where(f"many > {TILE}").withColumn("tiles", F.ceil(F.col("many") / TILE)))
    members = keys.join(blocks, F.col("nid") == F.col("node")).select("root", "nid", "n", "keys")
    small = members.join(large, "root", "left_anti").withColumn("probe", F.lit(None).cast("boolean"))
    links = small.groupBy("root").applyInPandas(_block(percent), "a long, b long")
    if large.limit(1).count():
        links = links.unionAll(_tiled(members.join(large, "root"), percent))
    return cut(links)


def _tiled(members: DataFrame, percent: int) -> DataFrame:
    """Links of large blocks: all sets against one in the middle first, then those that don't link with it against all, in tiles."""
    members = cut(members)
    each = members.select("root", F.explode("keys").alias("s")).groupBy("root", "s").agg(F.count("*").alias("many"))
    weight = (members.select("root", "nid", "n", F.explode("keys").alias("s")).join(each, ["root", "s"])
              .groupBy("root", "nid", "n").agg((F.sum("many") / F.col("n")).alias("weight")))
    middle = weight.groupBy("root").agg(F.max_by("nid", F.struct("weight", -F.col("nid"))).alias("nid"))
    middle = members.join(middle, ["root", "nid"]).select("root", F.col("nid").alias("b"), F.col("n").alias("m"), F.col("keys").alias("mid"))
    both = F.size(F.array_intersect("keys", "mid"))
    near = cut(members.join(middle, "root").withColumn("both", both)
               .select("root", "nid", "n", "keys", "tiles", "b", (100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).alias("linked")))
    tile = F.pmod(F.xxhash64("nid"), F.col("tiles"))
    rest = near.where("NOT linked").groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("rests"))
    linked = near.where("linked").select(F.col("nid").alias("a"), "b")  # also of blocks that have no unlinked set and so no row in rest
    near = near.join(rest, "root").withColumn("tile", tile).withColumn("part", F.pmod(F.xxhash64("nid", F.lit(1)), F.col("rests")))
    # a pair of tiles holds one tile of all sets and one part of the unlinked ones, which alone search
    stored = near.select("root", "nid", "n", "keys", "tile", F.explode(F.expr("sequence(0, rests - 1)")).alias("part"), F.lit(False).alias("probe"))
    search = near.where("NOT linked").select("root", "nid", "n", "keys", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), "part", F.lit(True).alias("probe"))
    pairs = stored.unionByName(search).groupBy("root", "tile", "part").applyInPandas(_block(percent), "a long, b long")
    return pairs.unionAll(linked)
