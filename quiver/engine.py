"""Collections of vectors with metadata: the verbs of the service, on tables under one folder.

Writes are appends to a collection's log, reads are of its live view: its last snapshot and the log after it. Everything
is read and written by Spark, so the folder may be on any store that Spark reaches. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import filters as P
from quiver.operators import hnsw, knn, lww, quantize
from quiver.plans.logs import logger
from quiver.plans.model import LOG_SCHEMA, REQUIRED, Config
from quiver.sources import wire
from quiver.sources.requests import entries_frame

_ORDER = ("seq", "pos")
_REGISTRY = "seq bigint, op string, name string, config string"
_VERSIONS = "version bigint, upto bigint, path string"
_STORED = "nr bigint, kind string, upto bigint, path string"
_MAX_ID = (1 << 63) - 1


class NotFound(LookupError):
    """There is no such collection."""


class Namespace:
    """One collection. Obtained from ``Engine.namespace``."""

    def __init__(self, engine: Engine, name: str, config: Config, path: str):
        self.engine, self.name, self.config, self.path = engine, name, config, path
        self.spark = engine.spark

    def log(self) -> DataFrame:
        return self.engine._read(f"{self.path}/log", LOG_SCHEMA)

    def _version(self) -> tuple[int, int, str | None]:
        last = self.engine._read(f"{self.path}/versions", _VERSIONS).orderBy(F.desc("version")).first()
        return (last.version, last.upto, last.path) if last else (0, -1, None)

    def entries(self) -> DataFrame:
        """The snapshot's rows and the log's later entries."""
        _, upto, path = self._version()
        tail = self.log().where(F.col("seq") > upto)
        return tail if path is None else self.engine._read(f"{self.path}/{path}", LOG_SCHEMA).select(tail.columns).unionByName(tail)

    def live(self) -> DataFrame:
        """Rows (id, vec, meta), each id once, as last written."""
        return lww.live_view(self.entries(), "id", _ORDER).select("id", "vec", "meta")

    def _next_seq(self) -> int:
        top = self.log().agg(F.max("seq")).first()[0]
        return max(self._version()[1], -1 if top is None else top) + 1

    def _append(self, rows: DataFrame) -> None:
        rows.select(*(f.split()[0] for f in LOG_SCHEMA.split(", "))).write.mode("append").parquet(f"{self.path}/log")

    def upsert_frame(self, rows: DataFrame) -> int:
        """Append rows (id, vec, meta[, pos]); the highest pos of an id within the batch wins. One atomic append.

        ValueError, and nothing written, if an id is null, a vector is null or has another dimension than the collection.
        """
        if "pos" not in rows.columns:
            rows = rows.withColumn("pos", F.lit(0).cast("bigint"))
        bad = F.col("id").isNull() | F.col("vec").isNull() | (F.size("vec") != self.config.dim)
        n = rows.agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad")).first()
        if n.bad:
            raise ValueError(f"{n.bad} rows without an id or without {self.config.dim} dimensions")
        if n.n:
            empty = F.col("meta").isNull() | (F.size("meta") == 0)
            rows = rows.withColumns({"seq": F.lit(self._next_seq()).cast("bigint"), "op": F.lit("upsert"), "meta": F.when(~empty, F.col("meta")), "vec": F.col("vec").cast("array<float>")})
            self._append(rows)
        return n.n

    def upsert(self, entries: Iterable[Mapping[str, Any]]) -> int:
        """Append entries ``{id, vector, metadata}``; of equal ids the last wins."""
        rows = [_entry(i, e) for i, e in enumerate(entries)]
        return self.upsert_frame(self.spark.createDataFrame(rows, f"id bigint, vec array<float>, meta {P.META_TYPE}, pos bigint")) if rows else 0

    def delete(self, ids: Iterable[int]) -> None:
        """Append deletes; an id that isn't there may be deleted."""
        rows = [(int(i), p) for p, i in enumerate(ids)]
        if rows:
            self.delete_frame(self.spark.createDataFrame(rows, "id bigint, pos bigint"))

    def delete_frame(self, rows: DataFrame) -> None:
        """Append deletes of rows (id, pos)."""
        if not rows.isEmpty():
            self._append(rows.withColumns({"seq": F.lit(self._next_seq()).cast("bigint"), "op": F.lit("delete"), "vec": F.lit(None).cast("array<float>"), "meta": F.lit(None).cast(P.META_TYPE)}))

    def _stored(self, kind: str) -> tuple[int, str] | None:
        """(upto, path) of the newest table of codes or graphs; it holds what was live at log position ``upto``."""
        last = self.engine._read(f"{self.path}/stored", _STORED).where(F.col("kind") == kind).orderBy(F.desc("nr")).first()
        return (last.upto, f"{self.path}/{last.path}") if last else None

    def _store(self, kind: str, rows: DataFrame, upto: int) -> None:
        """Write a table, then the row that makes it the newest of its kind."""
        nr = (self.engine._read(f"{self.path}/stored", _STORED).agg(F.max("nr")).first()[0] or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{nr}")
        self.spark.createDataFrame([(nr, kind, upto, f"{kind}/{nr}")], _STORED).write.mode("append").parquet(f"{self.path}/stored")

    def _since(self, upto: int) -> DataFrame | None:
        """The last entry of each id written after ``upto``, or None where there is none."""
        if self._next_seq() - 1 <= upto:
            return None
        return lww.last_entries(self.log().where(F.col("seq") > upto), "id", _ORDER)

    def _fresh(self, stored: DataFrame, later: DataFrame | None) -> DataFrame:
        """Rows of a stored table whose ids haven't been written since."""
        return stored if later is None else stored.join(later.select("id"), "id", "left_anti")

    def index(self) -> None:
        """Build and store a graph for each segment of the live view; searches read it until the next call."""
        c, upto = self.config, self._next_seq() - 1
        self._store("graph", hnsw.build_index(self.live(), c.metric, c.segment_max_size, c.m, c.m0, c.ef_construction), upto)

    def _search_codes(self, queries: DataFrame, k: int, test: Any) -> DataFrame:
        """Search stored codes, and codes of what was written since; full vectors are read of the latter alone."""
        book, stored = self.codebook(), self._stored("codes")
        if book is None or stored is None:
            raise ValueError("not trained")
        later = self._since(stored[0])
        codes = self._fresh(self.spark.read.parquet(stored[1]), later)
        if later is not None:
            codes = codes.unionByName(self._encoded(later.where("op = 'upsert'"), book))
        near = codes.where(test).select("id", "code")
        find = quantize.knn_sq8 if isinstance(book, quantize.Sq8Codebook) else quantize.knn_pq
        return knn.with_meta(find(near, queries, k, self.config.metric, book), codes, "meta")

    def _encoded(self, rows: DataFrame, book: Any) -> DataFrame:
        """Rows (id, meta, code)."""
        if isinstance(book, quantize.Sq8Codebook):
            return rows.select("id", "meta", quantize.sq8_encode(F.col("vec"), book).alias("code"))
        return quantize.pq_encode(rows, book).join(rows.select("id", "meta"), "id")

    def _search_graph(self, queries: DataFrame, k: int, ef: int, test: Any, narrowed: bool) -> DataFrame:
        """Search the stored graph, and what was written since exactly; a condition is applied to 4k candidates."""
        if self._stored("graph") is None:
            self.index()
        upto, path = self._stored("graph")
        later, wide = self._since(upto), 4 * k if narrowed else k
        changed = 0 if later is None else later.count()
        # Nodes written since still link others, so they are searched and their hits left out.
        hits = hnsw.knn_hnsw(self.spark.read.parquet(path), queries, wide + min(changed, wide), self.config.metric, max(ef, wide))
        hits = self._fresh(hits, later)
        if changed:
            hits = hits.unionByName(knn.knn(later.where("op = 'upsert'"), queries, wide, self.config.metric))
        if narrowed:
            hits = hits.join(self.live().where(test).select("id"), "id", "left_semi")
        return knn.top_k(hits.select("qid", "id", "distance"), k).select("qid", "rank", "id", "distance")

    def search(self, queries: DataFrame, k: int, where: P.Filter | None = None, mode: str = "exact", ef: int = 50) -> DataFrame:
        """Rows (qid, rank, id, distance, meta) for queries (qid, q).

        Modes: ``exact``; ``postfilter`` (condition after 4k candidates); ``quantized`` (the codes that ``train`` stored);
        ``graph`` (the graphs that ``index`` stored, built once if there are none; condition after 4k candidates).
        Entries written since codes or graphs were stored count in all modes. ``exact`` and ``quantized`` apply a
        condition before the search.
        """
        live, metric = self.live(), self.config.metric
        test = (where or P.All()).column(F.col("meta"))
        if mode == "quantized":
            return self._search_codes(queries, k, test)
        if mode == "postfilter":
            hits = knn.knn_postfilter(live, queries, k, metric, test)
        elif mode == "exact":
            hits = knn.knn(live, queries, k, metric, test)
        elif mode == "graph":
            hits = self._search_graph(queries, k, ef, test, where is not None and not isinstance(where, P.All))
        else:
            raise ValueError(f"unknown mode: {mode}")
        return knn.with_meta(hits, live, "meta")

    def train(self) -> None:
        """Train the codebook of the collection's quantization on the live view, and store all its codes. ValueError if
        there is nothing to train on; no-op without quantization."""
        live, kind, upto = self.live(), self.config.quant_mode, self._next_seq() - 1
        if kind == "sq8":
            b = quantize.sq8_train(live)
            rows = [(0, i, [lo, st]) for i, (lo, st) in enumerate(zip(b.low, b.step, strict=True))]
        elif kind == "pq":
            p = quantize.pq_train(live, self.config.pq_m)
            rows = [(s, c, v.astype(float).tolist()) for s, m in enumerate(p.centroids) for c, v in enumerate(m)]
        else:
            return
        self.spark.createDataFrame(rows, "sub int, code int, v array<double>").write.mode("overwrite").parquet(f"{self.path}/codebook")
        self._store("codes", self._encoded(live, self.codebook()), upto)

    def codebook(self) -> quantize.Sq8Codebook | quantize.PqCodebook | None:
        rows = sorted(self.engine._read(f"{self.path}/codebook", "sub int, code int, v array<double>").collect(), key=lambda r: (r["sub"], r.code))
        if not rows:
            return None
        if self.config.quant_mode == "sq8":
            return quantize.Sq8Codebook(tuple(r.v[0] for r in rows), tuple(r.v[1] for r in rows))
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["sub"], []).append(r.v)
        return quantize.PqCodebook(self.config.dim, tuple(np.array(by[s], np.float32).reshape(len(by[s]), -1) for s in sorted(by)))

    def checkpoint(self) -> None:
        """Write the live view as a new snapshot in sealed segments of about ``segment_max_size`` rows, by a hash of the
        id, then the row that makes it the current one."""
        version, upto, _ = self._version()
        top = self._next_seq() - 1
        if top == upto:
            return
        path = f"snapshots/{version + 1}"
        live = lww.live_view(self.entries(), "id", _ORDER)
        segments = max(1, -(-self.stats()["size"] // self.config.segment_max_size))
        dealt = live.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)))
        dealt.repartition("segment").write.mode("overwrite").partitionBy("segment").parquet(f"{self.path}/{path}")
        self.spark.createDataFrame([(version + 1, top, path)], _VERSIONS).write.mode("append").parquet(f"{self.path}/versions")

    def segments(self) -> dict[int, int]:
        """Rows of each sealed segment of the current snapshot that has any."""
        path = self._version()[2]
        if path is None:
            return {}
        rows = self.engine._read(f"{self.path}/{path}", f"{LOG_SCHEMA}, segment bigint")
        return {r.segment: r["count"] for r in rows.groupBy("segment").count().collect()}

    def compact(self) -> None:
        """Rewrite what lives in fewest segments; train again if quantized, build graphs again if there are any."""
        self.checkpoint()
        if self.config.quant_mode != "none" and not self.live().isEmpty():
            self.train()
        if self._stored("graph") is not None:
            self.index()

    def maybe_compact(self) -> bool:
        """Compact if enough entries are tombstones."""
        s = self.stats()
        due = lww.compaction_due(s["size"], s["deleted"])
        if due:
            self.compact()
        return due

    def stats(self) -> dict[str, int]:
        r = lww.counts(self.entries(), "id", _ORDER).first()
        return {"size": r["size"], "deleted": r.deleted}


def _entry(pos: int, e: Mapping[str, Any]) -> tuple:
    if "id" not in e or "vector" not in e:
        raise ValueError("an entry needs id and vector")
    if not 0 <= int(e["id"]) <= _MAX_ID:
        raise ValueError(f"id out of range: {e['id']}")
    meta = {k: P.tagged(v) for k, v in (e.get("metadata") or {}).items()}
    return int(e["id"]), [float(x) for x in e["vector"]], meta or None, pos


def _plain(hits: DataFrame) -> list[dict[str, Any]]:
    """One query's hits, nearest first, metadata as plain values."""
    rows = hits.orderBy("rank").collect()
    return [{"id": r.id, "distance": r.distance, "metadata": {k: next(v for v in t if v is not None) for k, t in (r.meta or {}).items()}} for r in rows]


_PAGE = "<!DOCTYPE html><title>Quiver</title><p>Collections are under <a href='/namespaces'>/namespaces</a>; see also <a href='/health'>/health</a> and <a href='/stats'>/stats</a>."


class Engine:
    """The registry of collections under ``root``, and the service's verbs as methods and as requests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.started, self.counters = spark, root.rstrip("/"), time.time(), Counter()
        self._flusher: tuple[threading.Thread, threading.Event] | None = None

    def flush(self) -> None:
        """Checkpoint every collection, and compact those that are due."""
        for name in self.list():
            try:
                ns = self.namespace(name)
                ns.checkpoint()
                ns.maybe_compact()
            except NotFound:  # dropped meanwhile
                continue
            except Exception as e:
                logger().error(f"upkeep of {name} failed: {e}")

    def start_flusher(self, seconds: float = 30) -> None:
        """Flush every so many seconds on a thread of its own until ``stop_flusher``. Once is enough."""
        if self._flusher:
            return
        stop = threading.Event()

        def work() -> None:
            while not stop.wait(seconds):
                self.flush()

        self._flusher = threading.Thread(target=work, daemon=True, name="flusher"), stop
        self._flusher[0].start()

    def stop_flusher(self) -> None:
        """Ends after the flush under way, if any."""
        if self._flusher:
            thread, stop = self._flusher
            stop.set()
            thread.join()
            self._flusher = None

    def _read(self, path: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _current(self) -> list[Any]:
        log = self._read(f"{self.root}/registry", _REGISTRY)
        last = log.groupBy("name").agg(F.max_by(F.struct("seq", "op", "config"), "seq").alias("e"))
        return last.where("e.op = 'create'").select("name", "e.seq", "e.config").orderBy("name").collect()

    def _record(self, op: str, name: str, config: str | None) -> None:
        seq = (self._read(f"{self.root}/registry", _REGISTRY).agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, op, name, config)], _REGISTRY).write.mode("append").parquet(f"{self.root}/registry")

    def create(self, name: str, config: Config) -> Namespace:
        """A new collection, or the one of that name as it is."""
        if not any(r.name == name for r in self._current()):
            self._record("create", name, json.dumps(config.as_dict()))
        return self.namespace(name)

    def drop(self, name: str) -> None:
        """Take a collection out; its tables are left to the store's own upkeep. No error if there is none."""
        if any(r.name == name for r in self._current()):
            self._record("drop", name, None)

    def list(self) -> list[str]:
        return [r.name for r in self._current()]

    def namespace(self, name: str) -> Namespace:
        for r in self._current():
            if r.name == name:
                return Namespace(self, name, Config(**json.loads(r.config)), f"{self.root}/ns/{r.seq}")
        raise NotFound(name)

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "uptime_s": int(time.time() - self.started)}

    def stats(self) -> dict[str, Any]:
        names = self.list()
        total = sum(self.namespace(n).stats()["size"] for n in names)
        return {"namespace_count": len(names), "total_vectors": total, **{c: self.counters[c] for c in ("upserts", "searches", "deletes", "errors")}}

    def request(self, method: str, path: str, body: Mapping[str, Any] | str | None = None) -> tuple[int, Any]:
        """Answer a request of the service's paths as (status, answer): 400 for a malformed one, 404 for no such
        collection or path. Writes answer an empty object, a search the array of its hits, ``/`` a page."""
        self.counters["total_requests"] += 1
        try:
            data = json.loads(body) if isinstance(body, str) else dict(body or {})
            return self._answer(method, [p for p in path.split("/") if p], data)
        except NotFound as e:
            status, said = 404, f"namespace not found: {e}"
        except KeyError as e:
            status, said = 400, f"JSON error: key {e} not found"
        except (ValueError, TypeError) as e:
            status, said = 400, str(e)
        self.counters["errors"] += 1
        logger().error(said, extra={"status": status})
        return status, {"error": said}

    def _answer(self, method: str, parts: list[str], data: dict[str, Any]) -> tuple[int, Any]:
        match method, parts:
            case "GET", []:
                return 200, _PAGE
            case "GET", ["health"]:
                return 200, self.health()
            case "GET", ["stats"]:
                return 200, self.stats()
            case "GET", ["namespaces"]:
                return 200, self.list()
            case "POST", ["namespaces"]:
                name, config = data["name"], data["config"]
                for key in REQUIRED:
                    config[key]
                self.create(name, Config.parse(config))
                return 200, {}
            case "DELETE", ["namespaces", name]:
                self.drop(name)
                return 200, {}
            case "GET", ["namespaces", name]:
                ns = self.namespace(name)
                return 200, {"size": ns.stats()["size"], "config": ns.config.as_answer()}
            case "POST", ["namespaces", name, "vectors"]:
                self.counters["upserts"] += self.namespace(name).upsert([data])
                return 200, {}
            case "POST", ["namespaces", name, "vectors", "batch"]:
                ns = self.namespace(name)
                self.counters["upserts"] += ns.upsert(data["entries"])
                return 200, {}
            case "DELETE", ["namespaces", name, "vectors", vid]:
                self.namespace(name).delete([int(vid)])
                self.counters["deletes"] += 1
                return 200, {}
            case "POST", ["namespaces", name, "train" | "compact" as verb]:
                getattr(self.namespace(name), verb)()
                return 200, {}
            case "POST", ["namespaces", name, "search"]:
                ns, k, ef = self.namespace(name), int(data["k"]), int(data["ef"])
                q = self.spark.createDataFrame([(0, [float(x) for x in data["query"]])], "qid bigint, q array<float>")
                if len(data["query"]) != ns.config.dim:
                    raise ValueError(f"a query needs {ns.config.dim} dimensions")
                self.counters["searches"] += 1
                return 200, _plain(ns.search(q, k, P.parse(data.get("filter")), data.get("mode", "exact"), ef))
        return 404, {"error": "no such path"}

    def search_message(self, data: bytes) -> bytes:
        """Answer a binary search request."""
        m = wire.decode("SearchRequest", data)
        q = self.spark.createDataFrame([(0, m["query"])], "qid bigint, q array<float>")
        return wire.encode("SearchResponse", {"hits": _plain(self.namespace(m["namespace"]).search(q, m["k"], wire.filter_of(m.get("filter")), ef=m["ef"]))})

    def ingest_messages(self, messages: DataFrame, col: str = "value", batch: bool = False) -> int:
        """Upsert entries from a column of binary upsert requests, each into the collection that it names."""
        rows = wire.entries_frame(messages, col, batch).persist()
        try:
            names = [r.namespace for r in rows.select("namespace").distinct().collect()]  # as many as there are collections
            found = {n: self.namespace(n) for n in names}
            return sum(ns.upsert_frame(rows.where(F.col("namespace") == n).drop("namespace")) for n, ns in found.items())
        finally:
            rows.unpersist()

    def ingest_json(self, name: str, path: str) -> int:
        """Upsert entries from files of JSON lines, one entry or one ``{"entries": [...]}`` a line."""
        return self.namespace(name).upsert_frame(entries_frame(self.spark.read.text(path)))
