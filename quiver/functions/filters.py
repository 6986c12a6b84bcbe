"""Typed predicates over schemaless metadata, compiled to columns that are never null.

Metadata is a map from key to a tagged value: one of text, number, truth. A predicate on a key that a row lacks is false,
so negation of it is true; ``notin`` alone asks that the key be there. Values of different types are never equal.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_TYPE = "struct<s:string,d:double,b:boolean>"
META_TYPE = f"map<string,{VALUE_TYPE}>"
#: Spellings of the comparisons. Fixed values of the request format.
COMPARISONS = {"lt": operator.lt, "gt": operator.gt, "lte": operator.le, "gte": operator.ge}

Scalar = str | float | bool


def slot(value: Scalar) -> str:
    """Which field of a tagged value holds this one; truth is no number."""
    if isinstance(value, bool):
        return "b"
    if isinstance(value, (int, float)):
        return "d"
    if isinstance(value, str):
        return "s"
    raise ValueError(f"no metadata value: {value!r}")


def tagged(value: Scalar) -> dict[str, Any]:
    out: dict[str, Any] = {"s": None, "d": None, "b": None}
    at = slot(value)
    out[at] = float(value) if at == "d" else value
    return out


class Filter:
    """A predicate: ``column`` compiles it, ``matches`` evaluates it on one plain dict."""

    def column(self, meta: Column, promoted: Mapping[str, Column] | None = None) -> Column:
        raise NotImplementedError

    def matches(self, meta: Mapping[str, Scalar]) -> bool:
        raise NotImplementedError


def _value(meta: Column, key: str, at: str, promoted: Mapping[str, Column] | None) -> Column:
    """The value under a key if it is of this type, else null; a promoted key is a flat column of its own."""
    if promoted and key in promoted:
        return promoted[key]
    return meta[key][at]


def _is(found: Column, test: Column) -> Column:
    """The test, false where the value is missing: null and false is false. Such a conjunction reaches a scan's filters,
    which a coalesce would not."""
    return found.isNotNull() & test


def _equal(found: Column, value: Scalar) -> Column:
    if slot(value) == "d":
        return F.lit(False) if math.isnan(value) else (found == F.lit(float(value))) & ~F.isnan(found)
    return found == F.lit(value)


@dataclass(frozen=True)
class All(Filter):
    """No condition."""

    def column(self, meta, promoted=None):
        return F.lit(True)

    def matches(self, meta):
        return True


@dataclass(frozen=True)
class Eq(Filter):
    key: str
    value: Scalar

    def column(self, meta, promoted=None):
        found = _value(meta, self.key, slot(self.value), promoted)
        return _is(found, _equal(found, self.value))

    def matches(self, meta):
        return self.key in meta and slot(meta[self.key]) == slot(self.value) and meta[self.key] == self.value


@dataclass(frozen=True)
class Range(Filter):
    """A number from low to high, both included."""

    key: str
    low: float
    high: float

    def column(self, meta, promoted=None):
        if math.isnan(self.low) or math.isnan(self.high):
            return F.lit(False)
        found = _value(meta, self.key, "d", promoted)
        return _is(found, found.between(float(self.low), float(self.high)) & ~F.isnan(found))

    def matches(self, meta):
        return self.key in meta and slot(meta[self.key]) == "d" and self.low <= meta[self.key] <= self.high


@dataclass(frozen=True)
class Compare(Filter):
    """Order within one type: text by bytes, false before true."""

    key: str
    op: str
    value: Scalar

    def __post_init__(self):
        if self.op not in COMPARISONS:
            raise ValueError(f"unknown comparison: {self.op}")

    def column(self, meta, promoted=None):
        at = slot(self.value)
        found = _value(meta, self.key, at, promoted)
        if at == "d":
            if math.isnan(self.value):
                return F.lit(False)
            return _is(found, COMPARISONS[self.op](found, F.lit(float(self.value))) & ~F.isnan(found))
        return _is(found, COMPARISONS[self.op](found, F.lit(self.value)))

    def matches(self, meta):
        if self.key not in meta or slot(meta[self.key]) != slot(self.value):
            return False
        a, b = meta[self.key], self.value
        return COMPARISONS[self.op](*((a.encode(), b.encode()) if isinstance(a, str) else (a, b)))


@dataclass(frozen=True)
class In(Filter):
    """Membership in a list of any types; negated, the key must be there all the same."""

    key: str
    values: tuple[Scalar, ...]
    negated: bool = False

    def column(self, meta, promoted=None):
        own = [Eq(self.key, v).column(meta, promoted) for v in self.values]
        member = reduce(operator.or_, own, F.lit(False))
        if not self.negated:
            return member
        there = promoted[self.key].isNotNull() if promoted and self.key in promoted else reduce(operator.or_, (meta[self.key][at].isNotNull() for at in "sdb"))
        return there & ~member

    def matches(self, meta):
        if self.key not in meta:
            return False
        return any(Eq(self.key, v).matches(meta) for v in self.values) != self.negated


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]

    def column(self, meta, promoted=None):
        return reduce(operator.and_, (p.column(meta, promoted) for p in self.parts), F.lit(True))

    def matches(self, meta):
        return all(p.matches(meta) for p in self.parts)


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]

    def column(self, meta, promoted=None):
        return reduce(operator.or_, (p.column(meta, promoted) for p in self.parts), F.lit(False))

    def matches(self, meta):
        return any(p.matches(meta) for p in self.parts)


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, meta, promoted=None):
        return ~self.part.column(meta, promoted)

    def matches(self, meta):
        return not self.part.matches(meta)


def parse(spec: Mapping[str, Any] | None) -> Filter:
    """A filter from its request form; null or a form without a type is no condition. ValueError if it is malformed."""
    if spec is None or "type" not in spec:
        return All()
    try:
        kind = spec["type"]
        if kind == "eq":
            slot(spec["value"])
            return Eq(spec["key"], spec["value"])
        if kind == "range":
            return Range(spec["key"], float(spec["low"]), float(spec["high"]))
        if kind == "compare":
            slot(spec["value"])
            return Compare(spec["key"], spec["op"], spec["value"])
        if kind in ("in", "notin"):
            for v in spec["values"]:
                slot(v)
            return In(spec["key"], tuple(spec["values"]), bool(spec.get("not", kind == "notin")))
        if kind in ("and", "or"):
            return (And if kind == "and" else Or)(tuple(map(parse, spec["conditions"])))
        if kind == "not":
            return Not(parse(spec["condition"]))
    except KeyError as e:
        raise ValueError(f"filter without {e}") from None
    raise ValueError(f"unknown filter type: {kind}")
