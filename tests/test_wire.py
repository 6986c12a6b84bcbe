import json
import logging

import pytest
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

from quiver.engine import Engine
from quiver.functions import filters as P
from quiver.plans import logs
from quiver.plans.model import Config
from quiver.sources import wire

UPSERT = {"namespace": "n", "id": 7, "vector": [1.0, -2.5], "metadata": {"a": "é", "b": 2.0, "c": False}}
FILTER = {"or": {"conditions": [{"in": {"key": "a", "values": [{"string_val": "x"}, {"double_val": 1.0}], "is_not": True}}, {"not": {"condition": {"range": {"key": "b", "low": 0.0, "high": 3.0}}}}, {"compare": {"key": "b", "op": "gte", "value": {"double_val": 2.0}}}, {"and": {"conditions": []}}, {"eq": {"key": "c", "value": {"bool_val": False}}}]}}


def test_round_trip():
    assert wire.decode("UpsertRequest", wire.encode("UpsertRequest", UPSERT)) == UPSERT
    assert wire.decode("Filter", wire.encode("Filter", FILTER)) == FILTER
    assert wire.decode("SearchRequest", b"") == {"namespace": "", "query": [], "k": 0, "ef": 0}
    assert wire.decode("DeleteRequest", wire.encode("DeleteRequest", {"namespace": "", "id": 2**63}) + b"\x78\x01\x7a\x01x")["id"] == 2**63
    for bad in (b"\x08", b"\x12\x05ab", b"\x0b", b"\x0d\x00\x00\x00\x00"):
        with pytest.raises(ValueError):
            wire.decode("UpsertRequest", bad)


def test_filters():
    want = P.Or((P.In("a", ("x", 1.0), True), P.Not(P.Range("b", 0.0, 3.0)), P.Compare("b", "gte", 2.0), P.And(()), P.Eq("c", False)))
    assert wire.filter_of(wire.decode("Filter", wire.encode("Filter", FILTER))) == want
    assert wire.filter_of(None) == wire.filter_of({}) == P.All()


def test_equals_the_protobuf_library():
    f = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="R")
    for number, (name, kind, many) in {k: v for k, v in wire.MESSAGES["SearchRequest"].items() if k < 5}.items():
        m.field.add(name=name, number=number, label=3 if many else 1, type={"string": 9, "float": 2, "uint": 13}[kind])
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    made = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.R"))(namespace="n", query=[1.5, 2], k=300)
    fields = {"namespace": "n", "query": [1.5, 2.0], "k": 300, "ef": 0}
    assert made.SerializeToString() == wire.encode("SearchRequest", fields) and wire.decode("SearchRequest", made.SerializeToString()) == fields


def test_engine_takes_messages(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    ns = engine.create("n", Config(dim=2))
    batch = {"namespace": "n", "entries": [{"id": 8, "vector": [0.0, 1.0], "metadata": {}}, {"id": 8, "vector": [0.0, 2.0], "metadata": {"a": "x"}}]}
    one = spark.createDataFrame([(bytearray(wire.encode("UpsertRequest", UPSERT)),), (None,)], "value binary")
    assert engine.ingest_messages(one) == 1
    assert engine.ingest_messages(spark.createDataFrame([(bytearray(wire.encode("BatchUpsertRequest", batch)),)], "value binary"), batch=True) == 2
    assert ns.stats()["size"] == 2
    asked = {"namespace": "n", "query": [0.0, 2.0], "k": 5, "filter": {"eq": {"key": "a", "value": {"string_val": "x"}}}}
    got = wire.decode("SearchResponse", engine.search_message(wire.encode("SearchRequest", asked)))
    assert got == {"hits": [{"id": 8, "distance": 0.0, "metadata": {"a": "x"}}]}


def test_log_lines(capsys):
    handler = logs.to_stderr()
    try:
        logs.logger().info("made %s", "n", extra={"status": 200})
    finally:
        logs.logger().removeHandler(handler)
    line = json.loads(capsys.readouterr().err)
    assert line["level"] == "info" and line["msg"] == "made n" and line["status"] == 200 and line["ts"].endswith("Z")
    assert isinstance(handler, logging.Handler)
