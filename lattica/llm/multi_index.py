"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised by its own
centroids; a cell is a pair of centroids.  A query visits cells by the sum of
its two distances, taken from a heap, until they hold enough entries; these are
reranked by the exact cosine of the original vectors.

Centroids and the share of entries that a query has to visit are fitted on a
bounded sample; every vector is indexed.  Equal vectors are one entry with its
smallest ids, which loses nothing, as they tie.  Entries are laid out by cell;
queries are taken in blocks of a fixed size, and a task scores the entries of a
cell for the queries that visit it, and no others.  It keeps the best entries of
each query of the block, so no pairs are shuffled.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored

SAMPLE = 20_000  # vectors that centroids are fitted on
TRIALS = 200  # of them that tell how many entries must be visited
RECALL = 0.95  # aimed at on the sample
ROUNDS = 8  # of k-means
MOST_CENTROIDS = 1024  # of a half
LEAST = 20  # entries visited at least, for each neighbour asked for
QUERIES = 2048  # in a block
SALTS = 4  # parts of a cell that lie apart
_GRID = 1 << 30


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def reach(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """Summed distance up to which cells are visited until they hold `wanted` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    sizes = counts[np.ix_(a, b)].tolist()
    heap, found, last = [(x[0] + y[0], 0, 0)], 0, 0.0
    while heap:
        last, i, j = heapq.heappop(heap)
        found += sizes[i][j]
        if found >= wanted:
            break
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):  # each cell has one way in: along its row
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return last


@dataclass(frozen=True)
class Quantiser:
    first: np.ndarray
    second: np.ndarray
    share: float  # of all entries that a query visits

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return distances(unit[:, :half], self.first), distances(unit[:, half:], self.second)


def cells_of(a: np.ndarray, b: np.ndarray):
    """(first centroid, second centroid, rows) of each stretch of rows in one cell."""
    cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(a)]
    for start, end in zip(cuts, cuts[1:]):
        yield int(a[start]), int(b[start]), slice(start, end)


def visited_share(quantiser: Quantiser, counts: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> float:
    """Mean share of all entries that lie in the cells queries visit."""
    to_a, to_b = quantiser.halves(queries / np.linalg.norm(queries, axis=1)[:, None])
    seen = [counts[x[:, None] + y <= limit + 1e-9].sum() for x, y, limit in zip(to_a, to_b, limits)]
    return float(np.mean(seen) / counts.sum())


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(column.to_pylist(), np.float64)
    return x, np.linalg.norm(x, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(`id`, `v`) of the vectors that take part, repeated rows once.

    Left out are null vectors and ids, vectors with a null or non-finite
    component, zero vectors, and vectors of another length than most have.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = usual[0].n if usual else 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") == dimension) & finite & F.exists(v, lambda x: x != 0)).dropDuplicates(["id", "v"])


def fit(entries: DataFrame, k: int, seed: int = 3) -> tuple[Quantiser | None, int]:
    """Centroids from about SAMPLE entries, and the number of entries; None without entries."""
    total = entries.count()
    if not total:
        return None, 0
    chosen = entries if total <= SAMPLE else entries.where(F.pmod(F.xxhash64("v"), F.lit(_GRID)) < ceil(_GRID * SAMPLE / total))
    x = np.array([r.v for r in chosen.select("v").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T)]  # whatever order the rows came in
    rng = np.random.default_rng(seed)
    half, size = x.shape[1] // 2, min(MOST_CENTROIDS, max(2, ceil(1.75 * total ** (1 / 3))))
    made = Quantiser(kmeans(x[:, :half], size, rng), kmeans(x[:, half:], size, rng), 1.0)
    a, b = made.halves(x)
    cell_a, cell_b = a.argmin(1), b.argmin(1)
    needed = []
    for i in rng.choice(len(x), min(TRIALS, len(x)), replace=False):
        sums = a[i][cell_a] + b[i][cell_b]
        near = x @ x[i]
        near[i] = -2
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        needed += [(sums <= s).mean() for s in sums[best]]
    return Quantiser(made.first, made.second, float(np.quantile(needed, RECALL)) if needed else 1.0), total


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query row: `query_id`, `rank`, `vec_id`, `score`.

    `is_query` is a condition on the column `id`.  Ties go to the smaller id; a
    query is no neighbour of its own id.  With few candidates all are visited and
    returned.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col))
    alike = Window.partitionBy("v").orderBy("id")
    entries = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
    entries = stored(entries.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    quantiser, total = fit(entries, k)
    id_type = rows.schema["id"].dataType.simpleString()
    if quantiser is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    shared = spark.sparkContext.broadcast(quantiser)
    index_schema = f"v {entries.schema['v'].dataType.simpleString()}, ids array<{id_type}>, a int, b int"

    def assign(batches):
        for batch in filter(len, batches):
            x, norms = _units(batch.column("v"))
            a, b = shared.value.halves(x / norms[:, None])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(1), pa.int32()), pa.array(b.argmin(1), pa.int32())], names=["v", "ids", "a", "b"])

    # Entries of a cell lie together; a cell that holds very many is dealt to SALTS tasks.
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    index = stored(entries.select("v", "ids").mapInArrow(assign, index_schema).repartition("a", "b", salt).sortWithinPartitions("a", "b"))
    counts = np.zeros((len(quantiser.first), len(quantiser.second)), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # at most MOST_CENTROIDS^2 cells
        counts[r.a, r.b] = r["count"]
    cells = spark.sparkContext.broadcast(counts)
    wanted = max(ceil(quantiser.share * total), LEAST * (k + 1))

    def bound(batches):
        for batch in filter(len, batches):
            x, norms = _units(batch.column("v"))
            limits = [reach(a, b, cells.value, wanted) for a, b in zip(*shared.value.halves(x / norms[:, None]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limits, pa.float64())], names=["id", "v", "reach"])

    asked = stored(rows.where(is_query).select("id", "v").mapInArrow(bound, f"id {id_type}, v {rows.schema['v'].dataType.simpleString()}, reach double"))
    blocks = max(1, ceil(asked.count() / QUERIES))
    found = [_nearest(index, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect(), shared, k, id_type) for b in range(blocks)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    hits = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    # Equal ids with different vectors, or a query id given twice: the best counts.
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(index: DataFrame, asked: list, shared, k: int, id_type: str) -> DataFrame:
    """The k + 1 best entries of each query among the entries of each task."""
    x = np.array([r.v for r in asked], np.float64)
    given = index.sparkSession.sparkContext.broadcast((x, np.array([r.reach for r in asked]), [r.id for r in asked]))

    def scan(batches):
        queries, limits, names = given.value
        if not len(queries):
            return
        units = queries / np.linalg.norm(queries, axis=1)[:, None]
        to_a, to_b = shared.value.halves(units)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query, cosine, number of the entry
        ids: dict[int, list] = {}
        floor, seen = np.full(len(queries), -np.inf), 0
        for batch in filter(len, batches):
            v, lengths = _units(batch.column("v"))
            v /= lengths[:, None]
            found = [best]
            for a, b, rows in cells_of(batch.column("a").to_numpy(), batch.column("b").to_numpy()):
                visitors = np.flatnonzero(to_a[:, a] + to_b[:, b] <= limits + 1e-9)
                if len(visitors):
                    scores = units[visitors] @ v[rows].T
                    q, e = np.nonzero(scores >= floor[visitors, None])
                    found.append((visitors[q], scores[q, e], e + rows.start + seen))
            best = tuple(np.concatenate(z) for z in zip(*found))
            fresh = np.unique(best[2][best[2] >= seen]).tolist()
            lists = batch.column("ids")
            ids.update({i: lists[i - seen].as_py() for i in fresh})
            seen += batch.num_rows
            smallest = [ids[i][0] for i in best[2].tolist()]
            order = np.lexsort((np.unique(np.array(smallest), return_inverse=True)[1], -best[1], best[0]))
            best = tuple(z[order] for z in best)
            starts = np.searchsorted(best[0], best[0])
            keep = np.arange(len(starts)) - starts <= k
            best = tuple(z[keep] for z in best)
            ids = {i: ids[i] for i in np.unique(best[2]).tolist()}
            full = np.bincount(best[0], minlength=len(queries)) == k + 1
            worst = np.full(len(queries), np.inf)
            np.minimum.at(worst, best[0], best[1])
            floor = np.where(full, worst, -np.inf)
        for at in range(0, len(best[0]), 4096):
            q, s, e = (z[at : at + 4096] for z in best)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()]), pa.array(s), pa.array([ids[i] for i in e.tolist()])], names=["query_id", "score", "ids"])

    return index.mapInArrow(scan, f"query_id {id_type}, score double, ids array<{id_type}>")
