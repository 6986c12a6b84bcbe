"""Vector distances, each as a SQL expression and as a numpy kernel. Smaller is nearer for all of them.

SQL forms compute in double precision and stay inside generated code as far as array functions allow; numpy kernels take
blocks of queries and rows and serve batch search.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the metrics. Fixed values of the request format.
NAMES = {
    "cosine": "cosine", "Cosine": "cosine",
    "l2": "l2", "L2": "l2",
    "dot_product": "dot", "DotProduct": "dot", "dot": "dot", "Dot": "dot",
    "l1": "l1", "L1": "l1",
    "hamming": "hamming", "Hamming": "hamming",
}
METRICS = ("cosine", "l2", "dot", "l1", "hamming")


def metric_name(name: str) -> str:
    try:
        return NAMES[name]
    except KeyError:
        raise ValueError(f"unknown metric: {name}") from None


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot_sum(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot_sum(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def _cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - dot_sum(a, b) / both)


def _hamming(a: Column, b: Column) -> Column:
    """Differing bits of the float32 representations."""
    bits = lambda x: F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("bigint")
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(bits(x).bitwiseXOR(bits(y)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.aggregate(differ, F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two vectors of one length as a double; null if either is null or lengths differ."""
    made = {
        "cosine": _cosine,
        "l2": lambda x, y: F.sqrt(l2_squared(x, y)),
        "dot": lambda x, y: -dot_sum(x, y),
        "l1": lambda x, y: _sum(_pairs(x, y, lambda u, v: F.abs(u - v))),
        "hamming": _hamming,
    }[metric_name(metric)]
    return F.when(F.size(a) == F.size(b), made(a, b))


def normalized(vec: Column) -> Column:
    """The vector divided by its norm, as floats; a vector with a norm of 1e-9 or less stays as it is."""
    return F.when(norm(vec) > 1e-9, F.transform(vec, lambda x: (x.cast("double") / norm(vec)).cast("float"))).otherwise(vec)


def kernel(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of every row of ``q`` to every row of ``x`` (both float32) as a double matrix.

    L2 and cosine go through one matrix product; ``refine`` gives the same values without its cancellation.
    """

    def l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        q, x = q.astype(np.float64), x.astype(np.float64)
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0))

    def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        q, x = q.astype(np.float64), x.astype(np.float64)
        both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(both == 0, 1.0, 1 - (q @ x.T) / np.where(both == 0, 1, both))

    def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return -(q.astype(np.float64) @ x.astype(np.float64).T)

    def l1(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.stack([np.abs(x - row).sum(1) for row in q.astype(np.float64)]) if len(q) else np.zeros((0, len(x)))

    def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
        own = np.ascontiguousarray(q, np.float32).view(np.uint32)
        return np.stack([np.bitwise_count(bits ^ row).sum(1, dtype=np.float64) for row in own]) if len(q) else np.zeros((0, len(x)))

    return {"l2": l2, "cosine": cosine, "dot": dot, "l1": l1, "hamming": hamming}[metric_name(metric)]


def refine(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of each row of ``q`` to the row of ``x`` beside it, straight from the definition."""
    name = metric_name(metric)
    if name == "hamming":
        return np.bitwise_count(np.ascontiguousarray(q, np.float32).view(np.uint32) ^ np.ascontiguousarray(x, np.float32).view(np.uint32)).sum(1, dtype=np.float64)
    q, x = q.astype(np.float64), x.astype(np.float64)
    if name == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    if name == "l1":
        return np.abs(q - x).sum(1)
    dots = (q * x).sum(1)
    if name == "dot":
        return -dots
    both = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1))
    return np.where(both == 0, 1.0, 1 - dots / np.where(both == 0, 1, both))
