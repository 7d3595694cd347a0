"""Approximate nearest neighbours by inner product: robust-pruned graphs, one per shard, and beam search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigtrace.session import cut

#: Distinct vectors per shard; out-degree; beams for building and searching; relaxation of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX = 8192, 24, 48, 96, 1.2
#: Queries that one task searches a shard for.
BLOCK = 8192
#: Salts of a hot vector's ids on their way to the few smallest.
SALTS = 64


class Graph:
    """A directed graph over unit-free vectors: near by distance, kept sparse by robust pruning.

    Inner products become distances by one more coordinate that lifts every
    vector to the same length; queries have 0 there. With ``edges`` a graph
    that was built before, over the same vectors in the same order, is opened.
    """

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5,
                 edges: list[np.ndarray] | None = None):
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        top = norms.max() if len(norms) else 0.0
        lift = np.sqrt(np.maximum(top - norms, 0))
        self.scale = np.sqrt(top) or 1.0
        self.x = np.ascontiguousarray(np.hstack([vectors, lift[:, None]]) / self.scale, np.float32)
        self.degree, self.relax = degree, relax
        n = len(self.x)
        self.edges: list[np.ndarray] = edges or [np.zeros(0, np.int64)] * n
        self.start = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))) if n else 0
        self.seen = np.zeros(n, np.int64)
        self.stamp = 0
        if edges is None:
            for i in np.random.default_rng(seed).permutation(n).tolist():
                self._insert(i, beam)

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances less the query's constant part: all lifted vectors are equally long."""
        return -(self.x[ids] @ q)

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """Greedy beam search from the middle: the ``beam`` nearest that were met, nearest first."""
        self.stamp += 1
        first = float(-(self.x[self.start] @ q))
        self.seen[self.start] = self.stamp
        todo, best = [(first, self.start)], [(-first, self.start)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = self.edges[i]
            new = new[self.seen[new] != self.stamp]
            if not len(new):
                continue
            self.seen[new] = self.stamp
            far = self.distances(q, new)
            if len(best) >= beam:
                near = far < -best[0][0]
                new, far = new[near], far[near]
            for e, j in zip(far.tolist(), new.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def _insert(self, i: int, beam: int) -> None:
        if i == self.start and not len(self.edges[i]):
            return
        near = np.array([j for _, j in self.search(self.x[i], beam) if j != i], np.int64)
        self.edges[i] = self._prune(i, np.union1d(near, self.edges[i]))
        for j in self.edges[i].tolist():
            back = np.append(self.edges[j], i)
            self.edges[j] = self._prune(j, np.unique(back)) if len(back) > 1.3 * self.degree else back

    def _prune(self, i: int, ids: np.ndarray) -> np.ndarray:
        """Nearest first, an edge stays unless a kept one is closer to its end by the relaxed factor."""
        ids = ids[ids != i]
        if not len(ids):
            return ids
        far = ((self.x[ids] - self.x[i]) ** 2).sum(1)
        order = np.lexsort((ids, far))
        ids, far = ids[order], far[order]
        own = self.x[ids]
        among = np.maximum((own ** 2).sum(1)[:, None] + (own ** 2).sum(1)[None] - 2 * own @ own.T, 0)
        open_, kept = np.ones(len(ids), bool), []
        for k in range(len(ids)):
            if open_[k]:
                kept.append(k)
                if len(kept) == self.degree:
                    break
                open_ &= self.relax ** 2 * among[k] > far
        return ids[kept]


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): equal vectors once, with their k + 1 smallest ids, which are all that can be among k nearest."""
    salted = Window.partitionBy("vector", "salt").orderBy("id")
    few = (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else list(column), np.float64)


def _in_blocks(asking: DataFrame, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Queries with the block each belongs to, some ``most`` in each, and (length of vectors, blocks) of all lengths."""
    asking = asking.withColumn("size", F.size("vector"))
    many = [(r["size"], -(-r["n"] // most)) for r in asking.groupBy("size").agg(F.count("*").alias("n")).collect()]
    return asking.withColumn("block", F.pmod(F.xxhash64("id", "vector"), _by_size(many))), many


def _by_size(numbers: list[tuple[int, int]]) -> Column:
    """The number that goes with a row's length of vectors."""
    out = F.lit(1)
    for size, n in numbers:
        out = F.when(F.col("size") == size, n).otherwise(out)
    return out.cast("long")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1).cast("array<long>"))


def _build(left: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes in the graph's order, with their edges."""
    left = left.sort_values("first", ignore_index=True)
    return left[["size", "shard", "vector", "ids"]].assign(at=np.arange(len(left)), edges=[e.tolist() for e in Graph(_matrix(left["vector"])).edges])


def _search(k: int, beam: int):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        if left.empty or right.empty:
            return empty
        left = left.sort_values("at", ignore_index=True)
        vectors = _matrix(left["vector"])
        graph, out = Graph(vectors, edges=[np.asarray(e, np.int64) for e in left["edges"]]), []
        ids = left["ids"].tolist()
        for q, v in zip(right["id"].tolist(), right["vector"].tolist(), strict=True):
            v = np.asarray(v, np.float64)
            unit = np.append(v, 0.0).astype(np.float32)
            found = [i for _, i in graph.search(unit, max(beam, 2 * k))]
            score = (vectors[found] * v).sum(1)
            rows = [(q, int(i), s) for s, f in zip(score.tolist(), found, strict=True) for i in ids[f] if i != q]
            out += heapq.nsmallest(k, rows, key=lambda r: (-r[2], r[1]))
        return pd.DataFrame(out, columns=["query_id", "id", "score"]) if out else empty
    return work


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard: int = SHARD, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): of each row whose id is divisible by ``every``, the ``k`` nearest others found.

    Nearest is the largest inner product, in double precision, ties to the
    smaller id. Every usable vector is in the graph of one shard, dealt by a
    hash; every query searches all shards. A shard's graph is built once and
    kept as rows in the shared folder; a search task holds one shard and one
    block of some ``block`` queries, however many there are. Vectors that
    are null or zero or hold null or non-finite components take no part, nor do
    null ids; vectors of another length than most are matched only among
    themselves. Equal vectors are one node with their ids, so a common vector
    does not distort the graph. Fewer than k others give fewer rows; an empty
    table gives none. Repeated ids with equal vectors count as one row.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(vector)).distinct()
    nodes = cut(_distinct(rows, k).withColumn("size", F.size("vector")))
    counts = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row per length of vectors
    if not counts:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    shards = _by_size([(size, max(1, round(n / shard))) for size, n in counts.items()])
    asking, blocks = _in_blocks(rows.where(F.pmod("id", F.lit(every)) == 0), block)
    placed = (nodes.where(F.col("size").isin([size for size, _ in blocks])).withColumn("shard", F.pmod(F.xxhash64("vector"), shards))
              .withColumn("first", F.element_at("ids", 1)))
    graphs = cut(placed.groupBy("size", "shard").applyInPandas(_build, "size int, shard long, vector array<double>, ids array<long>, at long, edges array<int>"))
    # a shard goes to every block of queries of its length, and a query to every shard
    stored = graphs.withColumn("block", _upto(_by_size(blocks)))
    asked = asking.withColumn("shard", _upto(shards))
    keys = ["size", "shard", "block"]
    found = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(k, beam), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
