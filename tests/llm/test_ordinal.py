import math
import os
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quiver.llm import ordinal as O
from quiver.llm import queries
from quiver.llm.common import table


def test_likelihood_is_a_maximum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 6, 3).astype(np.uint32)) for _ in range(600)]
    s = np.array([2.0 * (0 in r) - 1.5 * (1 in r) for r in rows])
    grades = np.digitize(s + rng.logistic(size=600), [-0.5, 1.0])
    m = O.fit_arrays(rows, grades, 3, l2=0.0)
    assert m.cuts[0] < m.cuts[1]

    def nll(w, cuts):
        x = np.array([sum(w[list(m.keys).index(k)] for k in r if k in m.keys) for r in rows])
        e = np.r_[-np.inf, cuts, np.inf]
        return -np.log(O._sigmoid(e[grades + 1] - x) - O._sigmoid(e[grades] - x)).mean()

    best = nll(m.weights, m.cuts)
    for i in range(len(m.keys)):
        for d in (-0.05, 0.05):
            assert nll(m.weights + d * (np.arange(len(m.keys)) == i), m.cuts) >= best - 1e-6
    for d in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
        assert nll(m.weights, np.add(m.cuts, d)) >= best - 1e-6


def test_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = F.xxhash64("doc_id") % 3 == 0
    model = O.graded(docs, labels.where(~held))
    out = O.score(docs.join(labels.where(held), "doc_id"), model).groupBy("quality", "toxic").agg(F.avg((F.col("tail_probability") >= queries.LEAST_TAIL).cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in out}
    assert kept[1, 0] > 0.98 and kept[0, 0] < 0.05 and kept[0, 1] < 0.05 and kept[1, 1] < 0.4


def test_features_are_chosen_at_any_number_of_texts():
    rng = np.random.default_rng(3)
    for n in (100, 400, 4000):
        grades = rng.permutation(np.arange(n) % 3)
        rows = [np.unique(np.r_[rng.integers(100, 3000, 40), [k for k in (0, 1, 2) if grades[i] == k]]).astype(np.uint32) for i in range(n)]
        keys = O.fit_arrays(rows, grades, 3).keys.tolist()
        assert {0, 2} <= set(keys) and len(keys) <= max(4, n // O.TEXTS_A_FEATURE)


def test_scores_equal_plain_code(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = O.graded(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+", r.text.lower())
        have = {zlib.crc32(w.encode()) for w in words} | {zlib.crc32(("\0^" + w[:k]).encode()) for w in set(words) for k in (4, 6) if len(w) > k}
        if words:
            letters = max(1, len(r.text) - r.text.count(" "))
            repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
            shares = (f"distinct {10 * len(set(words)) // len(words)} {min(len(words).bit_length(), 8)}", f"again {10 * repeated // len(words)}", f"capitals {10 * sum('A' <= c <= 'Z' for c in r.text) // letters}")
            have |= {zlib.crc32(("\0" + x).encode()) for x in shares}
        s = sum(weight.get(h, 0.0) for h in sorted(have))
        above = [1 / (1 + math.exp(c - s)) for c in model.cuts]
        assert abs(got[r.doc_id].expected_grade - sum(above)) < 1e-9 and abs(got[r.doc_id].tail_probability - above[-1]) < 1e-9
        assert got[r.doc_id].kept == (got[r.doc_id].tail_probability >= queries.LEAST_TAIL)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "good text here", 2), (2, None, 0), (3, "", 1), (None, "bad " * 50_000, 0), (4, "x", None)], "doc_id long, text string, expected_grade int")
    one = O.fit(df.where("doc_id = 1"), F.col("expected_grade"), 3)
    out = O.score(df, one).collect()
    assert len(out) == 5 and all(r.expected_grade > 1.99 for r in out)
    own = df.withColumn("latent", F.lit("mine"))
    assert {r.latent for r in O.score(own, one).collect()} == {"mine"}
    none = O.fit(df.limit(0), F.col("expected_grade"), 3)
    assert O.score(df.limit(0), none).count() == 0 and O.score(df, none).columns == ["doc_id", "text", "expected_grade", "tail_probability"]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert O.score(df, O.graded(df, labels)).count() == 5


def test_the_fit_runs_in_a_task(spark, monkeypatch):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    here, calls = O.fit_arrays, []
    monkeypatch.setattr(O, "fit_arrays", lambda *a: calls.append(len(a[0])) or here(*a))
    model = O.graded(docs, labels)
    assert not calls  # the driver's memory holds neither the features nor the fit
    assert len(model.keys) and model.keys.dtype == np.uint32 and list(model.cuts) == sorted(model.cuts)
    assert len(O.graded(docs, labels.limit(0)).keys) == 0 and calls == [0]
