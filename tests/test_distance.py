import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import distance as D

CASES = [
    ("l2", (1, 2, 3), (1, 2, 3), 0), ("l2", (1, 2), (4, 6), 5), ("cosine", (1, 0), (0, 1), 1), ("cosine", (2, 4), (2, 4), 0), ("cosine", (0, 0), (1, 2), 1),
    ("dot", (1, 2, 3), (4, 5, 6), -32), ("l1", (1, 5), (3, 2), 5),
]


@pytest.mark.parametrize("metric,a,b,want", CASES)
def test_known_values(spark, metric, a, b, want):
    q, x = np.array([a], np.float32), np.array([b], np.float32)
    assert abs(D.kernel(metric)(q, x)[0, 0] - want) < 1e-6 and abs(D.refine(metric, q, x)[0] - want) < 1e-6
    row = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b])], "a array<float>, b array<float>")
    assert abs(row.select(D.distance(metric, F.col("a"), F.col("b"))).first()[0] - want) < 1e-6


def test_hamming_counts_bits_of_subnormals(spark):
    a, b = (np.array([[v]], np.uint32).view(np.float32) for v in (0xAA, 0x55))
    assert D.kernel("hamming")(a, b)[0, 0] == D.refine("hamming", a, b)[0] == 8
    row = spark.createDataFrame([([float(a[0, 0])], [float(b[0, 0])])], "a array<float>, b array<float>")
    assert row.select(D.distance("hamming", F.col("a"), F.col("b"))).first()[0] == 8


@pytest.mark.parametrize("dim", [3, 4, 8, 11, 16, 31, 32, 64])
def test_forms_agree(spark, dim):
    rng = np.random.default_rng(42)
    q, x = rng.uniform(-10, 10, (3, dim)).astype(np.float32), rng.uniform(-10, 10, (5, dim)).astype(np.float32)
    rows = [(i, j, q[i].tolist(), x[j].tolist()) for i in range(3) for j in range(5)]
    df = spark.createDataFrame(rows, "i int, j int, a array<float>, b array<float>")
    got = df.select("i", "j", *(D.distance(m, F.col("a"), F.col("b")).alias(m) for m in D.METRICS)).collect()
    for m in D.METRICS:
        k = D.kernel(m)(q, x)
        for r in got:
            assert abs(k[r.i, r.j] - r[m]) < 1e-4 and abs(D.refine(m, q[r.i : r.i + 1], x[r.j : r.j + 1])[0] - r[m]) < 1e-9


def test_names_lengths_and_norms(spark):
    assert D.metric_name("DotProduct") == "dot"
    with pytest.raises(ValueError):
        D.metric_name("euclid")
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), (None, [1.0]), ([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(D.distance("l2", F.col("a"), F.col("b"))).collect()] == [None, None, 5.0]
    n = [r[0] for r in df.select(D.normalized(F.col("a"))).collect()]
    assert math.isclose(n[2][0], 0.6, rel_tol=1e-6) and df.select(D.normalized(F.col("b"))).collect()[2][0] == [0.0, 0.0]
