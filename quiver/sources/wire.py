"""The service's binary messages, read and written without generated classes.

Only what the messages below use is there: variable-length integers, fixed 32 and 64 bit numbers, and length-delimited
fields. Unknown fields are skipped, as the encoding asks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import filters as P

#: Messages by name: field number to (name, type, repeated). ``map`` fields have text keys and ``Value`` values. Fixed
#: values of the wire format.
MESSAGES: dict[str, dict[int, tuple[str, str, bool]]] = {
    "Value": {1: ("string_val", "string", False), 2: ("double_val", "double", False), 3: ("bool_val", "bool", False)},
    "MapEntry": {1: ("key", "string", False), 2: ("value", "Value", False)},
    "UpsertRequest": {1: ("namespace", "string", False), 2: ("id", "uint", False), 3: ("vector", "float", True), 4: ("metadata", "map", True)},
    "UpsertEntry": {1: ("id", "uint", False), 2: ("vector", "float", True), 3: ("metadata", "map", True)},
    "BatchUpsertRequest": {1: ("namespace", "string", False), 2: ("entries", "UpsertEntry", True)},
    "DeleteRequest": {1: ("namespace", "string", False), 2: ("id", "uint", False)},
    "Eq": {1: ("key", "string", False), 2: ("value", "Value", False)},
    "Range": {1: ("key", "string", False), 2: ("low", "double", False), 3: ("high", "double", False)},
    "Many": {1: ("conditions", "Filter", True)},
    "Not": {1: ("condition", "Filter", False)},
    "Compare": {1: ("key", "string", False), 2: ("op", "string", False), 3: ("value", "Value", False)},
    "In": {1: ("key", "string", False), 2: ("values", "Value", True), 3: ("is_not", "bool", False)},
    "Filter": {1: ("eq", "Eq", False), 2: ("range", "Range", False), 3: ("and", "Many", False), 4: ("or", "Many", False), 5: ("not", "Not", False), 6: ("compare", "Compare", False), 7: ("in", "In", False)},
    "SearchRequest": {1: ("namespace", "string", False), 2: ("query", "float", True), 3: ("k", "uint", False), 4: ("ef", "uint", False), 5: ("filter", "Filter", False)},
    "SearchHit": {1: ("id", "uint", False), 2: ("distance", "float", False), 3: ("metadata", "map", True)},
    "SearchResponse": {1: ("hits", "SearchHit", True)},
}
_PLAIN = {"uint": 0, "string": "", "double": 0.0, "bool": False, "float": 0.0}
_ONE_OF = ("Value", "Filter")


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("message cut short")
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def _fields(data: memoryview) -> Iterator[tuple[int, int, Any]]:
    """(number, wire type, raw value) of each field in turn."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data):
                raise ValueError("message cut short or of an unknown kind")
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def _scalar(kind: str, wire: int, raw: Any) -> Any:
    if kind in ("uint", "bool") and wire == 0:
        return bool(raw) if kind == "bool" else raw
    if kind == "double" and wire == 1:
        return struct.unpack("<d", raw)[0]
    if kind == "float" and wire == 5:
        return struct.unpack("<f", raw)[0]
    if kind == "string" and wire == 2:
        return bytes(raw).decode()
    raise ValueError("a field of another type")


def decode(message: str, data: bytes | memoryview) -> dict[str, Any]:
    """A message as a dict. Fields left out have their plain value, messages left out are absent, maps are dicts of
    metadata values. ValueError if it is malformed."""
    spec = MESSAGES[message]
    out: dict[str, Any] = {}
    for name, kind, many in spec.values():
        if kind == "map":
            out[name] = {}
        elif many:
            out[name] = []
        elif message not in _ONE_OF and kind in _PLAIN:
            out[name] = _PLAIN[kind]
    for number, wire, raw in _fields(memoryview(data)):
        if number not in spec:
            continue
        name, kind, many = spec[number]
        if kind == "map":
            entry = decode("MapEntry", raw)
            out[name][entry["key"]] = _value(entry.get("value", {}))
        elif kind in MESSAGES:
            value = decode(kind, raw)
            if many:
                out[name].append(value)
            else:
                if message in _ONE_OF:
                    out.clear()
                out[name] = value
        elif kind == "float" and many and wire == 2:
            out[name] += struct.unpack(f"<{len(raw) // 4}f", raw)
        elif many:
            out[name].append(_scalar(kind, wire, raw))
        else:
            if message in _ONE_OF:
                out.clear()
            out[name] = _scalar(kind, wire, raw)
    return out


def _value(v: Mapping[str, Any]) -> P.Scalar:
    if len(v) != 1:
        raise ValueError("a metadata value without a type")
    return next(iter(v.values()))


def _put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(message: str, fields: Mapping[str, Any]) -> bytes:
    """The bytes of a message; the inverse of ``decode``."""
    out = bytearray()

    def chunk(number: int, body: bytes) -> None:
        out.extend(_put(number << 3 | 2) + _put(len(body)) + body)

    for number, (name, kind, many) in MESSAGES[message].items():
        if name not in fields:
            continue
        value = fields[name]
        if kind == "map":
            for k, v in value.items():
                chunk(number, encode("MapEntry", {"key": k, "value": _as_value(v)}))
        elif kind in MESSAGES:
            for v in value if many else [value]:
                chunk(number, encode(kind, v))
        elif kind == "float" and many:
            if len(value):
                chunk(number, struct.pack(f"<{len(value)}f", *value))
        elif message in _ONE_OF or value != _PLAIN[kind]:
            if kind == "string":
                chunk(number, value.encode())
            elif kind in ("uint", "bool"):
                out.extend(_put(number << 3) + _put(int(value)))
            else:
                out.extend(_put(number << 3 | (1 if kind == "double" else 5)) + struct.pack("<d" if kind == "double" else "<f", value))
    return bytes(out)


def _as_value(v: P.Scalar) -> dict[str, Any]:
    return {{"s": "string_val", "d": "double_val", "b": "bool_val"}[P.slot(v)]: v}


def filter_of(message: Mapping[str, Any] | None) -> P.Filter:
    """A filter from a decoded ``Filter`` message; none, or one without a condition, is no condition."""
    if not message:
        return P.All()
    kind, f = next(iter(message.items()))
    if kind in ("and", "or"):
        return (P.And if kind == "and" else P.Or)(tuple(filter_of(c) for c in f["conditions"]))
    if kind == "not":
        return P.Not(filter_of(f.get("condition")))
    if kind == "range":
        return P.Range(f["key"], f["low"], f["high"])
    if kind == "in":
        return P.In(f["key"], tuple(map(_value, f["values"])), f["is_not"])
    value = _value(f.get("value", {}))
    return P.Eq(f["key"], value) if kind == "eq" else P.Compare(f["key"], f["op"], value)


def entries_frame(messages: DataFrame, col: str = "value", batch: bool = False) -> DataFrame:
    """Rows (namespace, id, vec, meta, pos) from a binary column of upsert messages, single or batched.

    Null messages are left out; a malformed one fails the query. pos orders entries as they stand.
    """
    tagged = pa.struct([("s", pa.string()), ("d", pa.float64()), ("b", pa.bool_())])
    kinds = pa.schema([("namespace", pa.string()), ("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("meta", pa.map_(pa.string(), tagged))])

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column(0):
                if m.is_valid:
                    got = decode("BatchUpsertRequest" if batch else "UpsertRequest", m.as_py())
                    for e in got["entries"] if batch else [got]:
                        rows.append({"namespace": got["namespace"], "id": e["id"], "vec": e["vector"], "meta": [(k, P.tagged(v)) for k, v in e["metadata"].items()]})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    out = messages.select(F.col(col).cast("binary").alias("m")).mapInArrow(run, f"namespace string, id bigint, vec array<float>, meta {P.META_TYPE}")
    return out.withColumn("pos", F.monotonically_increasing_id())
