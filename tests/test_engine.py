import time

import numpy as np
import pytest

from quiver.engine import Engine, NotFound
from quiver.functions import filters as P
from quiver.plans.model import Config
from quiver.sources import fvecs, synthetic
from quiver.sources.requests import entries_frame
from quiver.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def unit(i, meta=None, dim=4):
    return {"id": i, "vector": [float(j == i - 1) for j in range(dim)], "metadata": meta or {}}


def find(ns, q, k=10, **how):
    df = ns.spark.createDataFrame([(0, [float(x) for x in q])], "qid long, q array<float>")
    return [r.id for r in ns.search(df, k, **how).orderBy("rank").collect()]


def test_upsert_search_delete_and_restart(engine, spark):
    ns = engine.create("a", Config(dim=4))
    ns.upsert([unit(1, {"name": "item_a", "score": 9.5, "ok": True}), unit(2, {"name": "b"}), unit(3)])
    q = spark.createDataFrame([(0, [1.1, 0.0, 0.0, 0.0])], "qid long, q array<float>")
    hit = ns.search(q, 1).first()
    assert hit.id == 1 and hit.meta["score"].d == 9.5 and hit.meta["name"].s == "item_a" and hit.meta["ok"].b is True
    assert find(ns, (0.5, 0.5, 0, 0), 2, where=P.Eq("name", "b")) == [2]
    ns.delete([1])
    again = Engine(spark, engine.root).namespace("a")
    assert find(again, (1, 0, 0, 0)) == [2, 3] and again.stats() == {"size": 2, "deleted": 1}


def test_replacing_counts_once_and_clears_metadata(engine):
    ns = engine.create("a", Config(dim=4))
    ns.upsert([unit(1, {"k": "old"}), unit(1, {"k": "new"})])
    ns.upsert([unit(1)])
    assert ns.stats()["size"] == 1 and ns.live().first().meta is None
    ns.upsert([{"id": 1, "vector": [10, 0, 0, 0]}])
    assert find(ns, (9.5, 0, 0, 0), 1) == [1] and ns.stats()["size"] == 1


def test_compaction_survives_restart(engine, spark):
    ns = engine.create("a", Config(dim=4, segment_max_size=500))
    ns.upsert_frame(spark.range(2000).selectExpr("id", "array(cast(id as float), 0f, 0f, 0f) as vec", f"cast(null as {P.META_TYPE}) as meta"))
    ns.delete(range(1100))
    assert ns.maybe_compact() and not ns.maybe_compact()
    ns = Engine(spark, engine.root).namespace("a")
    assert ns.stats() == {"size": 900, "deleted": 0} and find(ns, (1500, 0, 0, 0), 1) == [1500]
    ns.delete([1500])  # a delete of a row that only the snapshot holds
    ns.checkpoint()
    ns.checkpoint()
    ns = Engine(spark, engine.root).namespace("a")
    assert ns.stats()["size"] == 899 and find(ns, (1500, 0, 0, 0), 1) in ([1499], [1501])
    assert find(ns, (1300, 0, 0, 0), 1, mode="graph") == [1300]


def test_registry(engine, spark):
    engine.create("a", Config(dim=2, metric="L2"))
    engine.create("b", Config(dim=4, metric="Cosine"))
    engine.create("a", Config(dim=9))
    assert engine.list() == ["a", "b"] and engine.namespace("a").config.dim == 2 and engine.namespace("b").config.metric == "cosine"
    engine.namespace("a").upsert([{"id": 1, "vector": [1, 0]}])
    engine.drop("a")
    engine.drop("a")
    with pytest.raises(NotFound):
        Engine(spark, engine.root).namespace("a")
    assert engine.create("a", Config(dim=2)).stats()["size"] == 0


def test_refused_writes(engine):
    ns = engine.create("a", Config(dim=4))
    for bad in ([{"id": 1, "vector": [1, 2]}], [{"id": -1, "vector": [1, 2, 3, 4]}], [{"vector": [1, 2, 3, 4]}], [{"id": 1, "vector": [1, 2, 3, 4], "metadata": {"a": None}}]):
        with pytest.raises(ValueError):
            ns.upsert(bad)
    assert ns.stats()["size"] == 0 and find(ns, (1, 0, 0, 0)) == []
    for spec in ({"dim": 0}, {"dim": 4, "m": 1}, {"dim": 4, "metric": "x"}, {"dim": 4, "quant_mode": "q"}, {"dim": 4, "x": 1}, {}):
        with pytest.raises(ValueError):
            Config.parse(spec)


@pytest.mark.parametrize("quant", ["SQ8", "PQ"])
def test_quantized_modes(engine, quant):
    ns = engine.create("q", Config(dim=4, quant_mode=quant, pq_m=2))
    with pytest.raises(ValueError):
        ns.train()
    ns.upsert([{"id": i, "vector": [100 * i, 0, -100 * i, 0], "metadata": {"i": i}} for i in range(300)])
    with pytest.raises(ValueError):
        find(ns, (1, 0, 0, 0), mode="quantized")
    ns.train()
    assert find(ns, (15000, 0, -15000, 0), 1, mode="quantized") == [150]
    assert find(ns, (15000, 0, -15000, 0), 1, mode="quantized", where=P.Compare("i", "lt", 100)) in ([99], [98])
    ns.compact()
    assert find(ns, (15000, 0, -15000, 0), 1, mode="postfilter", where=P.Compare("i", "lt", 152)) == [150]


BODY = {"dim": 4, "m": 8, "m0": 16, "ef_construction": 100, "metric": "l2", "max_elements": 1000}


def test_requests(engine):
    go = engine.request
    assert go("POST", "/namespaces", {"name": "ns1", "config": BODY}) == (200, {})
    assert go("POST", "/namespaces/ns1/vectors", {"id": 1, "vector": [1, 0, 0, 0], "metadata": {"info": "test_http", "p": 3}}) == (200, {})
    status, found = go("POST", "/namespaces/ns1/search", {"query": [1, 0, 0, 0], "k": 1, "ef": 10})
    assert status == 200 and [(r["id"], r["metadata"]) for r in found] == [(1, {"info": "test_http", "p": 3.0})] and found[0]["distance"] < 1e-5
    assert go("POST", "/namespaces/ns1/vectors/batch", '{"entries": [{"id": 12, "vector": [12, 0, 0, 0], "metadata": {"tag": "a"}}, {"id": 13, "vector": [13, 0, 0, 0], "metadata": {"tag": "b"}}]}') == (200, {})
    assert [r["id"] for r in go("POST", "/namespaces/ns1/search", {"query": [12, 0, 0, 0], "k": 1, "ef": 10, "filter": {"type": "eq", "key": "tag", "value": "b"}})[1]] == [13]
    assert go("DELETE", "/namespaces/ns1/vectors/12") == (200, {})
    assert [r["id"] for r in go("POST", "/namespaces/ns1/search", {"query": [12, 0, 0, 0], "k": 5, "ef": 10})[1]] == [13, 1]
    assert go("GET", "/namespaces/ns1") == (200, {"size": 2, "config": BODY | {"metric": "L2", "quant_mode": "None", "pq_m": 8}})
    assert go("GET", "/namespaces") == (200, ["ns1"]) and set(go("GET", "/health")[1]) == {"status", "uptime_s"}
    assert go("POST", "/namespaces/ns1/compact") == go("POST", "/namespaces/ns1/train") == (200, {})
    assert go("POST", "/namespaces/none/search", {"query": [1, 0], "k": 1, "ef": 10})[0] == go("GET", "/nowhere")[0] == 404
    for path, body in (("/ns1/search", {"query": [1], "k": 1, "ef": 1}), ("/ns1/search", {"query": [1, 0, 0, 0]}), ("", "{"), ("", {"name": "x", "config": {"dim": 4}}), ("", {"name": "x"}), ("/ns1/search", {"query": [1, 0, 0, 0], "k": 1, "ef": 1, "filter": {"type": "?"}})):
        assert go("POST", "/namespaces" + path, body)[0] == 400
    assert go("GET", "/stats") == (200, {"namespace_count": 1, "total_vectors": 2, "upserts": 3, "searches": 4, "deletes": 1, "errors": 7})
    assert go("GET", "/")[0] == 200 and go("DELETE", "/namespaces/ns1") == (200, {}) and go("GET", "/namespaces") == (200, [])


def test_segments_codes_and_graphs_are_stored(engine, spark):
    ns = engine.create("s", Config(dim=4, segment_max_size=3, quant_mode="sq8"))
    ns.upsert([{"id": i, "vector": [i, 0, 0, 0], "metadata": {"i": i}} for i in range(20)])
    ns.checkpoint()
    ns.train()
    ns.index()
    assert sum(ns.segments().values()) == 20 and 3 < len(ns.segments()) <= 7
    ns.delete([5])
    ns.upsert([{"id": 6, "vector": [90, 0, 0, 0]}, {"id": 50, "vector": [5.2, 0, 0, 0], "metadata": {"i": 50}}])
    again = Engine(spark, engine.root).namespace("s")
    for mode in ("exact", "quantized", "graph"):
        assert find(again, (5.2, 0, 0, 0), 3, mode=mode) == [50, 4, 7], mode
        assert find(again, (5.2, 0, 0, 0), 2, mode=mode, where=P.Compare("i", "lt", 40)) == [4, 7], mode
    ns.delete(range(14))
    ns.compact()
    assert sum(ns.segments().values()) == 7 and len(ns.segments()) <= 3
    q = spark.createDataFrame([(0, [15.0, 0.0, 0.0, 0.0])], "qid long, q array<float>")
    plan = ns.search(q, 3, mode="quantized")._jdf.queryExecution().executedPlan().toString()
    assert "code" in plan and "vec#" not in plan and find(ns, (15, 0, 0, 0), 1, mode="quantized") == [15]


def test_flusher(engine):
    ns = engine.create("f", Config(dim=4))
    ns.upsert([unit(1)])
    engine.start_flusher(0.05)
    engine.start_flusher(0.05)
    for _ in range(200):
        if ns.segments():
            break
        time.sleep(0.1)
    engine.stop_flusher()
    assert ns.segments() == {0: 1} and engine.namespace("f").stats()["size"] == 1


def test_json_files(engine, spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": 1, "vector": [1, 2.5], "metadata": {"a": 1, "b": "x", "c": true}}\n{"entries": [{"id": 2, "vector": [0, 0]}, {"id": 1, "vector": [9, 9]}]}\n')
    ns = engine.create("j", Config(dim=2))
    assert engine.ingest_json("j", str(tmp_path / "in.json")) == 3
    assert {r.id: list(r.vec) for r in ns.live().collect()} == {1: [9.0, 9.0], 2: [0.0, 0.0]}
    row = entries_frame(spark.createDataFrame([('{"id": 1, "vector": [1], "metadata": {"a": 1, "b": "1", "c": false}}',)], "value string")).first()
    assert [tuple(row.meta[k]) for k in "abc"] == [(None, 1.0, None), ("1", None, None), (None, None, False)]
    with pytest.raises(Exception, match="no metadata value"):
        entries_frame(spark.createDataFrame([('{"id": 1, "vector": [1], "metadata": {"a": null}}',)], "value string")).collect()


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 7)).astype(np.float32)
    path = str(tmp_path / "x.fvecs")
    fvecs.write_fvecs(x, path)
    with open(path, "ab") as f:
        f.write(b"\x07\x00\x00\x00cut")
    df = fvecs.read_fvecs(spark, path, 4096)
    got = sorted((r.id, r.vec) for r in df.collect())
    assert df.rdd.getNumPartitions() > 4 and np.array_equal(np.array([v for _, v in got], np.float32), x) and [i for i, _ in got] == list(range(1000))
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert fvecs.read_fvecs(spark, str(tmp_path / "e.fvecs")).count() == 0


def test_synthetic(spark):
    a = {r.id: r.vec for r in synthetic.gaussian(spark, 5000, 8, normalize=True).collect()}
    assert len(a) == 5000 and all(abs(sum(x * x for x in a[i]) - 1) < 1e-5 for i in (0, 4999))
    assert a[4500] == {r.id: r.vec for r in synthetic.gaussian(spark, 5000, 8, normalize=True).where("id = 4500").collect()}[4500]


def test_stream_into_collection(engine, spark, tmp_path):
    rows = [("upsert", 1, [1.0, 0.0], None, 0), ("upsert", 2, [0.0, 1.0], {"a": ("x", None, None)}, 1), ("delete", 1, None, None, 2), ("upsert", 3, [1.0, 1.0], None, 3), ("delete", 3, None, None, 4), ("upsert", 3, [2.0, 2.0], None, 5)]
    schema = f"op string, id bigint, vec array<float>, meta {P.META_TYPE}, pos bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    ns = engine.create("s", Config(dim=2))
    for _ in range(2):
        ingest.stream_into(ns, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
        assert {r.id: list(r.vec) for r in ns.live().collect()} == {2: [0.0, 1.0], 3: [2.0, 2.0]}
