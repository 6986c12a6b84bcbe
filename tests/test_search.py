import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import distance as D
from quiver.operators import hnsw, ivf, knn, quantize

HITS = ["qid", "rank", "id", "distance"]


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(np.asarray(x, np.float32))], "id long, vec array<float>")


def queries(spark, q):
    return frame(spark, q).toDF("qid", "q")


def brute(x, q, k, metric):
    out = set()
    for i, v in enumerate(q):
        d = D.refine(metric, np.broadcast_to(v, x.shape), x)
        out |= {(i, r + 1, int(j), round(float(d[j]), 6)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k])}
    return out


def rows(df):
    return {(r.qid, r["rank"], r.id, round(r.distance, 6)) for r in df.select(*HITS).collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1337)
    x = rng.uniform(-5, 5, (500, 16)).astype(np.float32)
    x[400:420] = x[:20]  # exact ties
    return x, rng.uniform(-5, 5, (50, 16)).astype(np.float32)


@pytest.mark.parametrize("metric", D.METRICS)
def test_three_forms_equal_brute_force(spark, data, metric):
    x, q = data
    q = np.concatenate([q[:7], x[400:403]])
    v, w = frame(spark, x), queries(spark, q)
    want = brute(x, q, 12, metric)
    assert rows(knn.knn(v, w, 12, metric)) == want
    assert rows(knn.knn_sql(v, w, 12, metric)) == want
    assert rows(knn.knn_tiles(v, w, 12, metric, 500, 10, 100)) == want


def test_large_query_sets_go_in_tiles_and_parts(spark, data, monkeypatch):
    x, q = data
    v, w = frame(spark, x), queries(spark, q)
    book = quantize.pq_train(v, 4)
    codes = quantize.pq_encode(v, book)
    index = hnsw.build_index(v, "l2", 250)
    centres = ivf.train_centres(v, 8)
    cells = ivf.assign_cells(v, centres)
    ways = [lambda: quantize.knn_pq(codes, w, 5, "l2", book), lambda: hnsw.knn_hnsw(index, w, 5, "l2"), lambda: ivf.knn_ivf(cells, w, 5, "l2", centres, 4), lambda: knn.knn_sql(v, w, 5, "l1"), lambda: knn.knn(v, w, 5, "dot")]
    want = [rows(way()) for way in ways]
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(knn, "TILE_ROWS", 90)
    assert [rows(way()) for way in ways] == want
    with pytest.raises(ValueError):
        knn.query_matrix(w)


def test_many_ties_at_the_edge(spark):
    x = np.zeros((3000, 2), np.float32)
    assert [r.id for r in knn.knn(frame(spark, x).repartition(3), queries(spark, x[:1]), 5, "l2").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 0.0]), (1, [1.0, 0.0])], "id long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, q array<float>")
    assert [(r.qid, r.id) for r in knn.knn(v, q, 5).collect()] == [(0, 1), (0, 1)]
    assert knn.knn(v, q, 0).count() == knn.knn(v.limit(0), q, 5).count() == knn.knn(v, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn.knn(v, q, -1)
    assert [r.id for r in knn.within(v, q, 0.5).collect()] == [1, 1]


def test_condition_before_and_after(spark, data):
    x, q = data
    v, w = frame(spark, x), queries(spark, q[:5])
    rare = F.col("id") % 50 == 7
    assert knn.knn(v, w, 10, "l2", rare).count() == 50
    assert knn.knn_postfilter(v, w, 10, "l2", rare).count() < 50
    assert knn.with_meta(knn.knn(v, w, 2), v.withColumn("meta", F.col("id") * 2), "meta").where("meta = id * 2").count() == 10


def test_recall_of_graph_and_files(spark, data):
    x, q = data
    v, w = frame(spark, x), queries(spark, q)
    truth = knn.knn(v, w, 10)
    index = hnsw.build_index(v, "l2", 10_000, 16, 32, 100)
    assert knn.recall(hnsw.knn_hnsw(index, w, 10, "l2", 50), truth, 10).first()[0] > 0.8
    split = hnsw.knn_hnsw(hnsw.build_index(v, "cosine", 120), w, 10, "cosine", 50)
    assert knn.recall(split, knn.knn(v, w, 10, "cosine"), 10).first()[0] > 0.9
    centres = ivf.train_centres(v, 10)
    cells = ivf.assign_cells(v, centres)
    assert knn.recall(ivf.knn_ivf(cells, w, 10, "l2", centres, 8), truth, 10).first()[0] > 0.9
    assert rows(ivf.knn_ivf(cells, w, 10, "l2", centres, 10)) == rows(truth)


def test_graph_keeps_degrees_and_replaces(spark, data):
    g = hnsw.Graph(data[0][:200], "l2", 4, 8, 50).build()
    assert all(len(n) <= (8 if lv == 0 else 4) for levels in g.links for lv, n in enumerate(levels))
    assert g.search(data[0][5], 1, 10)[0][1] == 5 and hnsw.Graph(data[0][:0], "l2").build().search(data[0][0], 3, 5) == []
    with pytest.raises(ValueError):
        hnsw.Graph(data[0], "l2", 1)


def test_sq8(spark):
    v = frame(spark, [(0, 10, -5), (1, 5, 0), (2, 0, 5)])
    book = quantize.sq8_train(v)
    assert book.low == (0, 0, -5)
    codes = v.select("id", quantize.sq8_encode(F.col("vec"), book).alias("code"))
    back = codes.select(quantize.sq8_decode(F.col("code"), book).alias("v"), "id").collect()
    assert max(abs(a - b) for r, w in zip(sorted(back, key=lambda r: r.id), [(0, 10, -5), (1, 5, 0), (2, 0, 5)]) for a, b in zip(r.v, w)) < 0.1
    wide = frame(spark, [(i, 0, 0, 0) for i in range(100)])
    book = quantize.sq8_train(wide)
    late = wide.union(frame(spark, [(55.5, 0, 0, 0)], 105))
    codes = late.select("id", quantize.sq8_encode(F.col("vec"), book).alias("code"))
    top = [knn_one(quantize.knn_sq8(codes, queries(spark, [(x, 0, 0, 0)]), 1, "l2", book)) for x in (50, 55.5)]
    assert top == [50, 105] and book.step[1] == 0
    with pytest.raises(ValueError):
        quantize.sq8_train(wide.limit(0))


def knn_one(hits):
    return hits.first().id


def test_pq(spark):
    x = np.array([(100 * i, 0, -100 * i, 0) for i in range(300)], np.float32)
    v = frame(spark, x)
    book = quantize.pq_train(v, 2)
    assert len(book.centroids) == 2 and book.centroids[0].shape == (256, 2)
    codes = quantize.pq_encode(v, book)
    assert len(codes.first().code) == 2 and knn_one(quantize.knn_pq(codes, queries(spark, x[150:151]), 1, "l2", book)) == 150
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 5)).astype(np.float32)
    book = quantize.pq_train(frame(spark, y), 3)
    assert [c.shape[1] for c in book.centroids] == [2, 2, 1] and quantize.sub_dims(2, 4) == [1, 1, 0, 0]
    c = book.encode(y)
    for m in D.METRICS:
        assert np.allclose(book.distances(y[:4], c, m), D.kernel(m)(y[:4], book.decode(c)), atol=1e-4)
    assert {r.id: np.allclose(r.vec, book.decode(c)[r.id]) for r in quantize.pq_decode(quantize.pq_encode(frame(spark, y), book), book).collect()} == dict.fromkeys(range(300), True)
    narrow = quantize.pq_train(frame(spark, y[:, :2]), 4)
    assert narrow.encode(y[:3, :2]).shape == (3, 4) and narrow.decode(narrow.encode(y[:3, :2])).shape == (3, 2)


def test_lloyd_keeps_a_centroid_that_loses_its_rows():
    x = np.array([[0.0], [0.0], [0.0], [9.0]], np.float32)
    assert sorted(quantize.lloyd(x, 4).ravel().tolist())[-1] == 9.0 and len(quantize.lloyd(x, 4)) == 4
