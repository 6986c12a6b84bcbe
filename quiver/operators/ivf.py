"""Inverted-file search: rows are filed under the nearest of some centres, and a query reads a few files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import distance as D
from quiver.operators import knn as K
from quiver.operators.quantize import _nearest, lloyd

#: Rows that centres are fitted on at most.
SAMPLE = 50_000


def train_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres from at most ``sample`` rows, those of least id hash. ValueError if there are none."""
    rows = vectors.where("vec is not null and id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    if not rows:
        raise ValueError("nothing to train on")
    return lloyd(np.array([r.vec for r in rows], np.float32), cells)


def assign_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (cell, id, vec): every row under its nearest centre. Written with ``partitionBy("cell")``, a search reads
    only the cells that it probes."""

    def run(batches):
        for b in batches:
            x, ok = K._matrix(b.column(1), centres.shape[1])
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centres).astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["cell", "id", "vec"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "cell int, id long, vec array<float>")


def knn_ivf(cells: DataFrame, queries: DataFrame, k: int, metric: str, centres: np.ndarray, probes: int) -> DataFrame:
    """Rows (qid, rank, id, distance): each query against the rows of the ``probes`` cells nearest to it.

    Probed cells are told by a literal list for pruning at the scan; tasks get the queries once, with their cells, and
    compare each cell's rows with the queries that probe it. Approximate: a row in a cell that isn't probed can't be hit;
    ``knn.knn`` is the exact way, as are all cells. Query sets beyond ``knn.BROADCAST_BYTES`` are searched in parts.
    """
    return K.in_parts(queries, lambda part: _knn_ivf(cells, part, k, metric, centres, probes))


def _knn_ivf(cells: DataFrame, queries: DataFrame, k: int, metric: str, centres: np.ndarray, probes: int) -> DataFrame:
    qids, q = K.query_matrix(queries)
    near = D.kernel("l2")(q, centres)
    chosen = np.argsort(near, axis=1, kind="stable")[:, :probes].astype(np.int32) if len(q) else np.zeros((0, 0), np.int32)
    wanted = np.unique(chosen).tolist()
    numbers = np.asarray(qids, np.int64)

    def run(batches):
        for b in batches:
            x, ok = K._matrix(b.column(2), centres.shape[1])
            cell, ids = (b.column(i).to_numpy(zero_copy_only=False)[ok] for i in (0, 1))
            for c in np.unique(cell):
                asking, there = np.flatnonzero((chosen == c).any(axis=1)), cell == c
                if len(asking) and k:
                    best = K._Best(numbers[asking], q[asking], k, metric)
                    best.add(ids[there], x[there])
                    yield from best.rows().to_batches()

    hits = cells.select("cell", "id", "vec").where(F.col("cell").isin(wanted) & F.col("id").isNotNull()).mapInArrow(run, "qid long, id long, distance double")
    return K.top_k(hits, k).select("qid", "rank", "id", "distance")
