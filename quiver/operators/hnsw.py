"""Navigable small-world graphs, one a segment, built and searched side by side."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import distance as D
from quiver.operators import knn as K

SEED = 42


class Graph:
    """One segment's graph. Vectors are rows of a matrix; neighbours are lists of row numbers a level."""

    def __init__(self, x: np.ndarray, metric: str, m: int = 16, m0: int = 0, ef_construction: int = 200):
        if m < 2:
            raise ValueError("m must be 2 or more")
        self.x, self.m, self.m0, self.ef = x.astype(np.float32), m, m0 or 2 * m, ef_construction
        self.kernel = D.kernel(metric)
        self.links: list[list[list[int]]] = []  # node, level
        self.entry = -1

    def build(self) -> Graph:
        rng = np.random.default_rng(SEED)
        for node in range(len(self.x)):
            self._insert(node, int(-math.log(1 - rng.random()) / math.log(self.m)))
        return self

    def _near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return self.kernel(q[None], self.x[nodes])[0]

    def _descend(self, q: np.ndarray, at: int, level: int) -> int:
        """From a node to the one nearest to q that a walk to ever nearer neighbours on one level reaches."""
        best = self._near(q, [at])[0]
        while level < len(self.links[at]) and (around := self.links[at][level]):
            d = self._near(q, around)
            i = int(d.argmin())
            if d[i] >= best:
                break
            at, best = around[i], d[i]
        return at

    def _beam(self, q: np.ndarray, at: int, ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on one level, nearest first."""
        d = float(self._near(q, [at])[0])
        seen, front, found = {at}, [(d, at)], [(-d, -at)]
        while front:
            d, node = heapq.heappop(front)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [n for n in self.links[node][level] if n not in seen] if level < len(self.links[node]) else []
            if not new:
                continue
            seen.update(new)
            for nd, n in zip(self._near(q, new).tolist(), new, strict=True):
                if len(found) < ef or nd < -found[0][0]:
                    heapq.heappush(front, (nd, n))
                    heapq.heappush(found, (-nd, -n))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def _insert(self, node: int, level: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        q, at, top = self.x[node], self.entry, len(self.links[self.entry]) - 1
        for lv in range(top, level, -1):
            at = self._descend(q, at, lv)
        for lv in range(min(level, top), -1, -1):
            near = self._beam(q, at, self.ef, lv)
            at = near[0][1]
            room = self.m0 if lv == 0 else self.m
            self.links[node][lv] = [n for _, n in near[: self.m]]
            for n in self.links[node][lv]:
                back = self.links[n][lv]
                back.append(node)
                if len(back) > room:
                    d = self._near(self.x[n], back)
                    self.links[n][lv] = [back[i] for i in np.argsort(d, kind="stable")[:room]]
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """The k nearest nodes found with a beam of max(ef, k), nearest first."""
        if self.entry < 0 or not k:
            return []
        at = self.entry
        for lv in range(len(self.links[at]) - 1, 0, -1):
            at = self._descend(q, at, lv)
        return self._beam(q, at, max(ef, k), 0)[:k]


_INDEX = "segment long, node int, id long, vec array<float>, entry boolean, links array<array<int>>"


def build_index(vectors: DataFrame, metric: str, segment_rows: int = 10_000, m: int = 16, m0: int = 0, ef_construction: int = 200) -> DataFrame:
    """Rows of nodes, ``segment, node, id, vec, entry, links``: a graph for each segment of about ``segment_rows`` rows.

    Rows are dealt to segments by id hash, so that segments are even and are built side by side; every row is indexed.
    The frame is the index: write it, read it back, search it.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec").where("id is not null and vec is not null")
    segments = max(1, -(-rows.count() // segment_rows))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = np.array(rows["vec"].to_pylist(), np.float32)
        g = Graph(x, metric, m, m0, ef_construction).build()
        n = len(x)
        return pa.table({
            "segment": rows["segment"], "node": pa.array(range(n), pa.int32()), "id": rows["id"], "vec": rows["vec"],
            "entry": pa.array([i == g.entry for i in range(n)]), "links": pa.array(g.links, pa.list_(pa.list_(pa.int32()))),
        })

    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)))
    return dealt.groupBy("segment").applyInArrow(build, _INDEX)


def knn_hnsw(index: DataFrame, queries: DataFrame, k: int, metric: str, ef: int = 50) -> DataFrame:
    """Rows (qid, rank, id, distance): each segment's graph is searched for each query, and the best k are merged."""
    return K.in_parts(queries, lambda part: _knn_hnsw(index, part, k, metric, ef))


def _knn_hnsw(index: DataFrame, queries: DataFrame, k: int, metric: str, ef: int) -> DataFrame:
    qids, q = K.query_matrix(queries)

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        g = Graph(np.array(rows["vec"].to_pylist(), np.float32), metric)
        g.links = rows["links"].to_pylist()
        g.entry = rows["entry"].to_pylist().index(True)
        ids = rows["id"].to_pylist()
        out = [(i, ids[n], d) for i, v in zip(qids, q, strict=True) for d, n in g.search(v, k, ef)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "id", "distance"])

    hits = index.groupBy("segment").applyInArrow(search, "qid long, id long, distance double")
    return K.top_k(hits, k).select("qid", "rank", "id", "distance")
