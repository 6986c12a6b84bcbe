"""Scalar (8 bit) and product quantization: training, encoding, decoding, asymmetric search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions import distance as D
from quiver.operators import knn as K

#: Fixed values of the code formats: highest scalar code, least spread that counts, centroids a subspace, Lloyd rounds.
SQ8_TOP = 255
SQ8_LEAST_SPREAD = 1e-30
PQ_CENTROIDS = 256
PQ_ROUNDS = 15
#: Rows that product quantization trains on at most.
PQ_SAMPLE = 100_000


@dataclass(frozen=True)
class Sq8Codebook:
    """Least value and step of each dimension; a dimension without spread has step 0."""

    low: tuple[float, ...]
    step: tuple[float, ...]

    def column(self, name: str) -> Column:
        return F.array(*(F.lit(float(v)) for v in getattr(self, name)))


def sq8_stats(vectors: DataFrame) -> DataFrame:
    """Rows (pos, low, high): least and greatest value of each dimension over all rows."""
    each = vectors.select(F.posexplode("vec").alias("pos", "v"))
    return each.groupBy("pos").agg(F.min(F.col("v").cast("double")).alias("low"), F.max(F.col("v").cast("double")).alias("high"))


def sq8_train(vectors: DataFrame) -> Sq8Codebook:
    """Codebook over all rows: one aggregation, two numbers a dimension reach the driver. ValueError if there are none."""
    rows = sorted((r.pos, r.low, r.high) for r in sq8_stats(vectors).collect())
    if not rows:
        raise ValueError("nothing to train on")
    steps = ((h - lo) / SQ8_TOP if h - lo >= SQ8_LEAST_SPREAD else 0.0 for _, lo, h in rows)
    return Sq8Codebook(tuple(lo for _, lo, _ in rows), tuple(steps))


def sq8_encode(vec: Column, book: Sq8Codebook) -> Column:
    """Codes 0 to 255 as integers; halves round up, values outside the trained range are clamped."""
    scaled = F.zip_with(
        F.zip_with(vec, book.column("low"), lambda x, lo: x.cast("double") - lo), book.column("step"),
        lambda x, s: F.when(s == 0, F.lit(0)).otherwise(F.least(F.greatest(F.round(x / F.when(s == 0, 1.0).otherwise(s)), F.lit(0.0)), F.lit(float(SQ8_TOP))).cast("int")),
    )
    return F.when(F.size(vec) == len(book.low), scaled)


def sq8_decode(code: Column, book: Sq8Codebook) -> Column:
    """The vector that a code stands for, as doubles."""
    return F.zip_with(F.zip_with(code, book.column("step"), lambda c, s: c * s), book.column("low"), lambda v, lo: v + lo)


def knn_sq8(codes: DataFrame, queries: DataFrame, k: int, metric: str, book: Sq8Codebook) -> DataFrame:
    """Rows (qid, rank, id, distance): plain queries against decoded codes, ``codes`` being (id, code).

    Codes are decoded a batch at a time, so they are all that is read. Query sets beyond ``knn.BROADCAST_BYTES`` are
    searched in parts.
    """
    return K.in_parts(queries, lambda part: _knn_sq8(codes, part, k, metric, book))


def _knn_sq8(codes: DataFrame, queries: DataFrame, k: int, metric: str, book: Sq8Codebook) -> DataFrame:
    qids, q = K.query_matrix(queries)
    low, step = np.array(book.low), np.array(book.step)

    def run(batches):
        best = K._Best(qids, q, k, metric, np.float64)
        for b in batches:
            x, ok = K._matrix(b.column(1), len(low))
            if len(x) and len(qids) and k and q.shape[1] == len(low):
                best.add(b.column(0).to_numpy(zero_copy_only=False)[ok], x * step + low)
        yield from best.rows().to_batches()

    rows = codes.select(F.col("id").cast("long").alias("id"), "code").where("id is not null and code is not null")
    return K.top_k(rows.mapInArrow(run, "qid long, id long, distance double"), k).select("qid", "rank", "id", "distance")


def rerank(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact distances for approximate hits, and the k best of those."""
    wide = hits.select("qid", "id").join(vectors.select("id", "vec"), "id").join(queries.select("qid", "q"), "qid")
    return K.top_k(wide.select("qid", "id", D.distance(metric, F.col("q"), F.col("vec")).alias("distance")), k).select("qid", "rank", "id", "distance")


def sub_dims(dim: int, parts: int) -> list[int]:
    """Width of each subspace: as even as can be, the first ones wider; zero where there are more parts than dimensions."""
    return [dim // parts + (i < dim % parts) for i in range(parts)]


@dataclass(frozen=True)
class PqCodebook:
    """Centroids of each subspace, as matrices (centroids x width)."""

    dim: int
    centroids: tuple[np.ndarray, ...]

    @property
    def offsets(self) -> list[int]:
        return np.cumsum([0, *(c.shape[1] for c in self.centroids)]).tolist()

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid in each subspace, the first of equals: uint8 (rows x subspaces)."""
        at = self.offsets
        out = np.empty((len(x), len(self.centroids)), np.uint8)
        for s, c in enumerate(self.centroids):
            out[:, s] = _nearest(x[:, at[s] : at[s + 1]], c)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, s]] for s, c in enumerate(self.centroids)], axis=1)

    def distances(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        """Distances (queries x codes): by tables of a query's distance to each centroid where the metric adds up over
        subspaces, by decoding where it doesn't."""
        name, at = D.metric_name(metric), self.offsets
        if name in ("l1", "hamming"):
            return D.kernel(name)(q, self.decode(codes).astype(np.float32))
        parts = [q[:, at[s] : at[s + 1]].astype(np.float64) for s in range(len(self.centroids))]
        if name == "l2":
            return np.sqrt(sum(((p[:, None] - c[None]) ** 2).sum(2)[:, codes[:, s]] for s, (p, c) in enumerate(zip(parts, self.centroids, strict=True))))
        dots = sum((p @ c.T)[:, codes[:, s]] for s, (p, c) in enumerate(zip(parts, self.centroids, strict=True)))
        if name == "dot":
            return -dots
        norms = sum((c.astype(np.float64) ** 2).sum(1)[codes[:, s]] for s, c in enumerate(self.centroids))
        both = np.linalg.norm(q.astype(np.float64), axis=1)[:, None] * np.sqrt(norms)[None]
        return np.where(both == 0, 1.0, 1 - dots / np.where(both == 0, 1, both))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        part = x[s : s + 4096].astype(np.float64)
        d = np.zeros((len(part), len(c)))
        for j in range(c.shape[1]):
            d += (part[:, j, None] - c[None, :, j]) ** 2
        out[s : s + 4096] = d.argmin(1)
    return out


def lloyd(x: np.ndarray, centroids: int = PQ_CENTROIDS, rounds: int = PQ_ROUNDS) -> np.ndarray:
    """Centroids after a set number of rounds, begun at evenly spaced rows; one that loses all its rows stays."""
    k = min(centroids, len(x))
    c = x[np.arange(k) * (len(x) // k)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(own, weights=x[:, j].astype(np.float64), minlength=k)
            c[:, j] = np.where(n > 0, total / np.maximum(n, 1), c[:, j])
    return c.astype(np.float32)


def pq_train(vectors: DataFrame, parts: int, sample: int = PQ_SAMPLE) -> PqCodebook:
    """Codebook from at most ``sample`` rows, those of least id hash if there are more, in order of id.

    Subspaces train side by side, one task each, and only centroids come back. ValueError if there are no rows.
    """
    rows = vectors.select("id", "vec").where("id is not null and vec is not null")
    n = rows.count()
    if not n:
        raise ValueError("nothing to train on")
    if n > sample:
        rows = rows.orderBy(F.xxhash64("id")).limit(sample)
    dim = rows.select(F.max(F.size("vec"))).first()[0]
    widths = sub_dims(dim, parts)
    at = np.cumsum([0, *widths]).tolist()
    cut = F.array(*(F.struct(F.lit(s).alias("sub"), F.slice("vec", at[s] + 1, max(1, widths[s])).alias("v")) for s in range(parts) if widths[s]))
    each = rows.where(F.size("vec") == dim).select("id", F.explode(cut).alias("c")).select("id", "c.sub", "c.v")

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = np.array(rows["v"].to_pylist(), np.float32)
        c = lloyd(x)
        return pa.table({"sub": pa.array([rows["sub"][0].as_py()] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float32()))})

    found = each.groupBy("sub").applyInArrow(train, "sub int, code int, centroid array<float>").collect()
    by: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["sub"], r.code)):
        by.setdefault(r["sub"], []).append(r.centroid)
    k = min(PQ_CENTROIDS, min(n, sample))
    return PqCodebook(dim, tuple(np.array(by.get(s, [[]] * k), np.float32).reshape(k, widths[s]) for s in range(parts)))


def codebook_frame(book: PqCodebook, like: DataFrame) -> DataFrame:
    """Rows (sub, code, centroid) of a codebook."""
    rows = [(s, c, v.tolist()) for s, m in enumerate(book.centroids) for c, v in enumerate(m)]
    return like.sparkSession.createDataFrame(rows, "sub int, code int, centroid array<float>")


def pq_encode(vectors: DataFrame, book: PqCodebook) -> DataFrame:
    """Rows (id, code): one byte a subspace. Rows with a null vector or one of another length have no code."""

    def run(batches):
        for b in batches:
            x, ok = K._matrix(b.column(1), book.dim)
            codes = book.encode(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, code binary")


def pq_decode(codes: DataFrame, book: PqCodebook) -> DataFrame:
    """Rows (id, vec): the vectors that codes stand for."""

    def run(batches):
        for b in batches:
            c = np.array([np.frombuffer(v.as_py(), np.uint8) for v in b.column(1)], np.uint8).reshape(b.num_rows, len(book.centroids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(book.decode(c).astype(np.float32)), pa.list_(pa.float32()))], names=["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, "id long, vec array<float>")


def knn_pq(codes: DataFrame, queries: DataFrame, k: int, metric: str, book: PqCodebook) -> DataFrame:
    """Rows (qid, rank, id, distance): plain queries against codes (id, code); each task keeps its best k a query.

    Query sets beyond ``knn.BROADCAST_BYTES`` are searched in parts.
    """
    return K.in_parts(queries, lambda part: _knn_pq(codes, part, k, metric, book))


def _knn_pq(codes: DataFrame, queries: DataFrame, k: int, metric: str, book: PqCodebook) -> DataFrame:
    qids, q = K.query_matrix(queries)

    def run(batches):
        dist, ids = np.full((len(qids), 0), np.inf), np.zeros((len(qids), 0), np.int64)
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, len(book.centroids))
            own = b.column(0).to_numpy(zero_copy_only=False)
            step = max(1, K.BLOCK_CELLS // max(1, len(qids)))
            for s in range(0, len(own), step):
                near = book.distances(q, raw[s : s + step], metric)
                dist = np.concatenate([dist, near], 1)
                ids = np.concatenate([ids, np.broadcast_to(own[s : s + step], near.shape)], 1)
                order = np.lexsort((ids, dist), axis=1)[:, :k]
                dist, ids = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids, np.int64), dist.shape[1])), pa.array(ids.ravel()), pa.array(dist.ravel())], names=["qid", "id", "distance"])

    hits = codes.select("id", "code").where("id is not null and code is not null").mapInArrow(run, "qid long, id long, distance double")
    return K.top_k(hits, k).select("qid", "rank", "id", "distance")
