"""Exact nearest neighbours: every query against every row, as SQL, as Arrow batches, or as tiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import distance as D

#: Bytes of query vectors that are sent to every task at most; larger query sets are dealt in tiles.
BROADCAST_BYTES = 64 << 20
#: Distances computed at a time in one task, and rows of one tile's side: both bound memory.
BLOCK_CELLS = 1 << 22
TILE_ROWS = 50_000


def top_k(hits: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k nearest hits of each query with their rank from 1; ties go to the smaller id.

    The rank's limit is pushed below the shuffle, so each task sends at most k hits a query.
    """
    order = Window.partitionBy(by).orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k is negative")


def query_bytes(queries: DataFrame) -> int:
    """Bytes of the vectors of a query set (qid, q): one aggregation."""
    size = queries.agg(F.count("qid").alias("n"), F.max(F.size("q")).alias("dim")).first()
    return (size.n or 0) * max(0, size.dim or 0) * 4


def all_pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query beside every row: by sending the queries to every task where ``query_bytes`` allows it, else by tiles of
    both sides, joined on their place in the grid, so that neither side is held whole anywhere."""
    if query_bytes(queries) <= BROADCAST_BYTES:
        return F.broadcast(queries).crossJoin(rows)
    across, down = (max(1, -(-d.count() // TILE_ROWS)) for d in (queries, rows))
    left = queries.withColumn("__c", F.pmod(F.xxhash64("qid"), F.lit(across))).withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    right = rows.withColumn("__r", F.pmod(F.xxhash64("id"), F.lit(down))).withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return left.join(right, ["__r", "__c"]).drop("__r", "__c")


def in_parts(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over parts of a query set that each fit ``BROADCAST_BYTES``, by hash of the query id; one part if it does."""
    parts = max(1, -(-query_bytes(queries) // BROADCAST_BYTES))
    if parts == 1:
        return search(queries)
    parts *= 2  # parts differ in size
    found = [search(queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def knn_sql(vectors: DataFrame, queries: DataFrame, k: int, metric: str, where: Column | None = None) -> DataFrame:
    """Rows (qid, rank, id, distance) as one declarative plan, for few queries and for reference.

    ``vectors`` has (id, vec), ``queries`` (qid, q). A row whose vector has another length than the query, or null, isn't
    a hit.
    """
    _check_k(k)
    rows = vectors if where is None else vectors.where(where)
    near = all_pairs(queries.select("qid", "q"), rows.select("id", "vec"))
    hits = near.select("qid", "id", D.distance(metric, F.col("q"), F.col("vec")).alias("distance")).where("distance is not null")
    return top_k(hits, k).select("qid", "rank", "id", "distance")


class _Best:
    """The k nearest rows so far of each query, with their vectors for the exact distance."""

    def __init__(self, qids: list, q: np.ndarray, k: int, metric: str, kind: type = np.float32):
        self.qids, self.q, self.k, self.metric = qids, q, k, metric
        self.kernel = D.kernel(metric)
        self.dist = np.full((len(q), 0), np.inf)
        self.ids = np.zeros((len(q), 0), np.int64)
        self.vecs = np.zeros((len(q), 0, q.shape[1]), kind)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, BLOCK_CELLS // max(1, len(self.q)))
        for s in range(0, len(ids), step):
            self._add(ids[s : s + step], x[s : s + step])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        near = self.kernel(self.q, x)
        if near.shape[1] > 4 * self.k + 16:  # more than k may tie within rounding of the product: some are kept over
            part = np.argpartition(near, 2 * self.k + 8, axis=1)[:, : 2 * self.k + 9]
        else:
            part = np.broadcast_to(np.arange(near.shape[1]), near.shape)
        vecs = x[part]
        rows, width = part.shape
        exact = D.refine(self.metric, np.repeat(self.q, width, axis=0), vecs.reshape(rows * width, -1)).reshape(rows, width)
        dist, own = np.concatenate([self.dist, exact], 1), np.concatenate([self.ids, ids[part]], 1)
        vecs = np.concatenate([self.vecs, vecs], 1)
        order = np.lexsort((own, dist), axis=1)[:, : self.k]
        if near.shape[1] > part.shape[1]:  # exact ties at the edge are settled by id over all rows
            edge = np.take_along_axis(near, part, 1).max(axis=1)
            kth = np.take_along_axis(dist, order, 1)[:, -1] if order.shape[1] else np.zeros(len(self.q))
            for i in np.flatnonzero(kth >= edge - 1e-6 * np.maximum(1, np.abs(edge))):
                full = D.refine(self.metric, np.broadcast_to(self.q[i], x.shape), x)
                d, o = np.r_[self.dist[i], full], np.r_[self.ids[i], ids]
                best = np.lexsort((o, d))[: self.k]
                dist[i, : len(best)], own[i, : len(best)], vecs[i, : len(best)] = d[best], o[best], np.concatenate([self.vecs[i], x])[best]
                order[i] = np.arange(order.shape[1])
        self.dist, self.ids = np.take_along_axis(dist, order, 1), np.take_along_axis(own, order, 1)
        self.vecs = np.take_along_axis(vecs, order[:, :, None], 1)

    def rows(self) -> pa.Table:
        width = self.dist.shape[1]
        at = np.repeat(np.arange(len(self.qids)), width)
        return pa.table({"qid": pa.array(np.asarray(self.qids, np.int64)[at]), "id": pa.array(self.ids.ravel()), "distance": pa.array(self.dist.ravel())})


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` numbers as a matrix, and which rows those are; others and null ones are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(ok)).flatten() if len(ok) < len(sizes) else column.flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(ok), dim)
    full = ~np.isnan(m).any(axis=1)
    return m[full], ok[full]


def query_matrix(queries: DataFrame) -> tuple[list[int], np.ndarray]:
    """Query ids and vectors on the driver, in order of id. All have one length; ValueError if they are more than
    ``BROADCAST_BYTES``, before any is collected."""
    if query_bytes(queries) > BROADCAST_BYTES:
        raise ValueError("too many queries to send to every task: search them in parts")
    rows = sorted((r.qid, r.q) for r in queries.select("qid", "q").where("qid is not null and q is not null").collect())
    dims = {len(q) for _, q in rows}
    if len(dims) > 1:
        raise ValueError(f"queries of several lengths: {sorted(dims)}")
    dim = dims.pop() if dims else 0
    return [i for i, _ in rows], np.array([q for _, q in rows], np.float32).reshape(len(rows), dim)


def knn_arrow(vectors: DataFrame, queries: DataFrame, k: int, metric: str, where: Column | None = None) -> DataFrame:
    """Rows (qid, rank, id, distance): each task keeps its own best k a query, then k a query and task are merged.

    Queries go to every task, so this is for sets within ``BROADCAST_BYTES``; ``knn`` checks that.
    """
    _check_k(k)
    qids, q = query_matrix(queries)
    rows = (vectors if where is None else vectors.where(where)).select(F.col("id").cast("long").alias("id"), "vec").where("id is not null")

    def run(batches):
        best = _Best(qids, q, k, metric)
        for batch in batches:
            x, ok = _matrix(batch.column(1), q.shape[1])
            if len(x) and len(qids) and k:
                best.add(batch.column(0).to_numpy(zero_copy_only=False)[ok], x)
        yield from best.rows().to_batches()

    hits = rows.mapInArrow(run, "qid long, id long, distance double")
    return top_k(hits, k).select("qid", "rank", "id", "distance")


def knn_tiles(vectors: DataFrame, queries: DataFrame, k: int, metric: str, n_rows: int, n_queries: int, tile: int = TILE_ROWS) -> DataFrame:
    """As ``knn_arrow`` for query sets of any size: both sides are dealt into blocks and each pair of blocks is a task.

    A row travels once for each block of queries and a query once for each block of rows; no task holds more than a tile
    of either. The grid has as few columns as the tile size allows.
    """
    _check_k(k)
    across, down = max(1, -(-n_queries // tile)), max(1, -(-n_rows // tile))
    left = vectors.select(F.col("id").cast("long").alias("id"), "vec").where("id is not null").withColumn("r", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int"))
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = queries.select(F.col("qid").cast("long").alias("qid"), "q").where("qid is not null and q is not null").withColumn("c", F.pmod(F.xxhash64("qid"), F.lit(across)).cast("int"))
    right = right.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not rows.num_rows or not asked.num_rows or not k:
            return empty
        dim = len(asked["q"][0].as_py())
        q, ok = _matrix(asked["q"], dim)
        x, rok = _matrix(rows["vec"], dim)
        out = []
        for s in range(0, len(ok), 1024):  # queries at a time
            best = _Best(asked["qid"].to_numpy()[ok][s : s + 1024].tolist(), q[s : s + 1024], k, metric)
            best.add(rows["id"].to_numpy()[rok], x)
            out.append(best.rows())
        return pa.concat_tables(out) if out else empty

    hits = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(meet, "qid long, id long, distance double")
    return top_k(hits, k).select("qid", "rank", "id", "distance")


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """Rows (qid, rank, id, distance): the k rows nearest to each query among those that satisfy ``where``.

    Exact, ties by id. Ids are longs; rows with a null id or vector, or one of another length, aren't hits. The query
    set's size decides how it is run: within ``BROADCAST_BYTES`` it goes to every task, beyond it both sides are tiled.
    """
    if query_bytes(queries) <= BROADCAST_BYTES:
        return knn_arrow(vectors, queries, k, metric, where)
    rows = vectors if where is None else vectors.where(where)
    return knn_tiles(rows, queries, k, metric, rows.count(), queries.count())


def knn_postfilter(vectors: DataFrame, queries: DataFrame, k: int, metric: str, where: Column, over: int = 4) -> DataFrame:
    """Candidates first, condition after: of the ``over`` * k nearest rows, the k nearest that satisfy ``where``.

    May give fewer than k though more satisfy it; ``knn`` with a condition doesn't.
    """
    found = knn(vectors, queries, over * k, metric).drop("rank")
    passing = vectors.where(where).select(F.col("id").alias("pid"))
    hits = found.join(passing, found.id == F.col("pid"), "left_semi")
    return top_k(hits, k).select("qid", "rank", "id", "distance")


def within(vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """Rows (qid, id, distance) of all rows at most ``radius`` from a query."""
    near = all_pairs(queries.select("qid", "q"), vectors.select("id", "vec"))
    return near.select("qid", "id", D.distance(metric, F.col("q"), F.col("vec")).alias("distance")).where(F.col("distance") <= radius)


def with_meta(hits: DataFrame, vectors: DataFrame, *cols: str) -> DataFrame:
    """Hits with further columns of the rows hit, fetched after the search."""
    return hits.join(vectors.select(F.col("id").alias("__id"), *cols), hits.id == F.col("__id"), "left").drop("__id")


def recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (recall): the mean over the queries of ``truth`` of the share of its k rows that are hit."""
    found = truth.select("qid", "id").join(hits.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    per = found.groupBy("qid").agg((F.count("hit") / F.lit(k)).alias("r"))
    return per.agg(F.avg("r").alias("recall"))
