"""Registered queries and the SQL that must give the same rows.

Searches take as queries all vectors whose id is divisible by 100 and run them against all vectors; a query finds itself.
Distances are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.engine import Engine, Namespace
from quiver.functions import distance as D
from quiver.functions import filters as P
from quiver.operators import hnsw, ivf, knn, lww, quantize
from quiver.plans.model import Config
from quiver.sources import wire
from quiver.streaming import ingest

K_NEAR = 10
PQ_PARTS = 8
META = f"cast({{}} as {P.META_TYPE})"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(vecs: DataFrame) -> DataFrame:
    return vecs.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def _shared(spark: SparkSession) -> str:
    """A new folder in that which driver and executors share. Only a local session may have none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints/quiver').rstrip('/')}/plans-{uuid.uuid4().hex}"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))  # no negative zero


def _scaled(vecs: DataFrame) -> DataFrame:
    """Vectors times one more than their label: the metrics order these differently."""
    return vecs.withColumn("vec", F.transform("vec", lambda x: (x * (F.col("label") + 1)).cast("float")))


def _metadata(vecs: DataFrame) -> DataFrame:
    """Metadata of three types from the label; rows of label 3 have none."""
    label, none = F.col("label"), F.lit(None)
    kinds = {"label": (none, label.cast("double"), none), "parity": (F.when(label % 2 == 0, "even").otherwise("odd"), none, none), "is_even": (none, none, label % 2 == 0)}
    made = F.create_map(*(x for k, (s, d, b) in kinds.items() for x in (F.lit(k), F.struct(s.cast("string").alias("s"), d.cast("double").alias("d"), b.cast("boolean").alias("b")))))
    return vecs.withColumn("meta", F.when(label != 3, made))


def _knn(metric: str, scaled: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        v = _scaled(v) if scaled else v
        return _rounded(knn.knn(v, asked(v), K_NEAR, metric))

    return run


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_SCALED = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * (label + 1))::FLOAT)::DOUBLE[] AS vec, label FROM embeddings)"
_DIST = {
    "l2": "list_distance(q.vec, v.vec)",
    "cosine": "CASE WHEN list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec) = 0 THEN 1 ELSE 1 - list_dot_product(q.vec, v.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(v.vec, v.vec))) END",
    "dot": "-list_dot_product(q.vec, v.vec)",
    "l1": "list_sum(list_transform(list_zip(q.vec, v.vec), lambda x: abs(x[1] - x[2])))",
    "hamming": "list_sum(list_transform(list_zip(q.vec, v.vec), lambda x: bit_count(xor(x[1]::FLOAT::BIT, x[2]::FLOAT::BIT))))::DOUBLE",
    "l2_sq": "list_distance(q.vec, v.vec) ** 2",
}


def _knn_sql(metric: str, base: str = _SCALED, k: int = K_NEAR, where: str = "true", pick: str = "q.id % 100 = 0") -> str:
    return f"""WITH {base}, d AS (SELECT q.id AS qid, v.id AS id, {_DIST[metric]} AS distance FROM v q, v WHERE {pick} AND ({where})),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, id, distance FROM d)
        SELECT qid, rank::INTEGER AS rank, id, round(distance, 6) + 0.0::DOUBLE AS distance FROM r WHERE rank <= {k}"""


def knn_l2_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return _rounded(knn.knn_sql(v, v.where("id = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q")), K_NEAR, "l2"))


def knn_l2_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _scaled(vectors(spark, sf_dir))
    q = asked(v)
    return _rounded(knn.knn_tiles(v, q, K_NEAR, "l2", v.count(), q.count(), 500))


def dist_l2_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    both = knn.all_pairs(asked(v), v.select("id", "vec"))
    return both.select("qid", "id", F.round(D.l2_squared(F.col("q"), F.col("vec")), 6).alias("distance"))


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return knn.within(v, asked(v), 1.2, "l2").select("qid", "id", F.round("distance", 6).alias("distance"))


#: One filter of each kind, as a request and as SQL over label, which is null where metadata is missing.
FILTERS = {
    "eq": ({"type": "eq", "key": "parity", "value": "even"}, "l % 2 = 0"),
    "eq_bool": ({"type": "eq", "key": "is_even", "value": False}, "l % 2 = 1"),
    "eq_other_type": ({"type": "eq", "key": "label", "value": "4"}, "false"),
    "range": ({"type": "range", "key": "label", "low": 2, "high": 5}, "l BETWEEN 2 AND 5"),
    "compare": ({"type": "compare", "key": "label", "op": "gt", "value": 6}, "l > 6"),
    "compare_text": ({"type": "compare", "key": "parity", "op": "lte", "value": "f"}, "l % 2 = 0"),
    "in": ({"type": "in", "key": "label", "values": [1, 7, "x", True]}, "l IN (1, 7)"),
    "notin": ({"type": "notin", "key": "label", "values": [1, 7]}, "l NOT IN (1, 7)"),
    "and": ({"type": "and", "conditions": [{"type": "eq", "key": "parity", "value": "odd"}, {"type": "range", "key": "label", "low": 4, "high": 9}]}, "l % 2 = 1 AND l BETWEEN 4 AND 9"),
    "or": ({"type": "or", "conditions": [{"type": "eq", "key": "label", "value": 0}, {"type": "compare", "key": "label", "op": "gte", "value": 8}]}, "l = 0 OR l >= 8"),
    "not": ({"type": "not", "condition": {"type": "eq", "key": "label", "value": 5}}, "l IS NULL OR l <> 5"),
}
_LABELS = "SELECT vec_id AS id, CASE WHEN label <> 3 THEN label END AS l FROM embeddings"


def _filter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _metadata(vectors(spark, sf_dir).select("id", "label"))
        return rows.where(P.parse(FILTERS[name][0]).column(F.col("meta"))).select("id")

    return run


_CONDITION = FILTERS["range"]


def knn_filtered_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _metadata(vectors(spark, sf_dir))
    return _rounded(knn.knn(v, asked(v), K_NEAR, "l2", P.parse(_CONDITION[0]).column(F.col("meta"))))


def knn_filtered_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same condition on a flat column, which reaches the scan."""
    v = vectors(spark, sf_dir)
    flat = F.when(F.col("label") != 3, F.col("label").cast("double"))
    return _rounded(knn.knn(v, asked(v), K_NEAR, "l2", P.parse(_CONDITION[0]).column(F.lit(None), {"label": flat})))


def knn_filtered_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _metadata(vectors(spark, sf_dir))
    return _rounded(knn.knn_postfilter(v, asked(v), K_NEAR, "l2", P.parse(_CONDITION[0]).column(F.col("meta"))))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "event_type", "value")


_LOG = "log AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_type, value FROM events), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
_LIVE = f"WITH {_LOG} SELECT id, seq, event_type, value FROM last WHERE op = 'upsert'"


def lww_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.live_view(event_log(spark, sf_dir)).select("id", "seq", "event_type", "value")


def lww_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.tombstones(event_log(spark, sf_dir)).select("id", "seq")


def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.counts(event_log(spark, sf_dir))


def recover_snapshot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first half of the log, and the log's later half."""
    log = event_log(spark, sf_dir)
    upto = log.agg(F.max("seq")).first()[0] // 2
    path = _shared(spark)
    lww.live_view(log.where(F.col("seq") <= upto)).write.parquet(path)
    return lww.recover(spark.read.parquet(path), log, upto).select("id", "seq", "event_type", "value")


def compact_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a compacted collection, read back, by event type."""
    path = _shared(spark)
    lww.live_view(event_log(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    source = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = source.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "event_type", "value")
    path = _shared(spark)
    ingest.run_to_table(ingest.live_stream(stream), f"{path}/state", f"{path}/checkpoint")
    return spark.read.schema(log.schema).parquet(f"{path}/state").select("id", "seq", "event_type", "value")


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _scaled(vectors(spark, sf_dir)).select("id", F.posexplode(D.normalized(F.col("vec"))).alias("pos", "x"))
    return v.select("id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


def sq8_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantize.sq8_stats(vectors(spark, sf_dir))
    return s.select("pos", F.round("low", 6).alias("low"), F.round((F.col("high") - F.col("low")) / quantize.SQ8_TOP, 8).alias("step"))


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, quantize.Sq8Codebook, DataFrame]:
    v = vectors(spark, sf_dir)
    book = quantize.sq8_train(v)
    return v.select("id", "vec", quantize.sq8_encode(F.col("vec"), book).alias("code")), book, v


def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, *_ = _codes(spark, sf_dir)
    return codes.select("id", F.posexplode("code").alias("pos", "code"))


def sq8_decode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book, _ = _codes(spark, sf_dir)
    off = F.zip_with(quantize.sq8_decode(F.col("code"), book), "vec", lambda x, y: F.abs(x - y.cast("double")))
    return codes.select("id", F.round(F.array_max(off), 6).alias("max_error"))


def _knn_sq8(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes, book, v = _codes(spark, sf_dir)
        return _rounded(quantize.knn_sq8(codes.select("id", "code"), asked(v), K_NEAR, metric, book))

    return run


_BOOK = "e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), b AS (SELECT pos, min(x) AS low, CASE WHEN max(x) - min(x) >= 1e-30 THEN (max(x) - min(x)) / 255 ELSE 0 END AS step FROM e GROUP BY pos), c AS (SELECT id, pos, x, low, step, CASE WHEN step = 0 THEN 0 ELSE least(greatest(floor((x - low) / step + 0.5), 0), 255) END::INTEGER AS code FROM e JOIN b USING (pos))"
_DECODED = f"{_BOOK}, w AS (SELECT id, list(low + code * step ORDER BY pos) AS vec FROM c GROUP BY id), p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"


def _sq8_sql(metric: str) -> str:
    dist = _DIST[metric].replace("v.vec", "w.vec")
    return f"""WITH {_DECODED}, d AS (SELECT q.id AS qid, w.id AS id, {dist} AS distance FROM p q, w WHERE q.id % 100 = 0),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, id, distance FROM d)
        SELECT qid, rank::INTEGER AS rank, id, round(distance, 6) + 0.0::DOUBLE AS distance FROM r WHERE rank <= {K_NEAR}"""


def recall_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book, v = _codes(spark, sf_dir)
    q = asked(v)
    found = quantize.knn_sq8(codes.select("id", "code"), q, K_NEAR, "l2", book)
    return knn.recall(found, knn.knn(v, q, K_NEAR, "l2"), K_NEAR).select(F.round("recall", 6).alias("recall"))


def knn_sq8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book, v = _codes(spark, sf_dir)
    q = asked(v)
    return _rounded(quantize.rerank(quantize.knn_sq8(codes.select("id", "code"), q, 4 * K_NEAR, "l2", book), v, q, K_NEAR, "l2"))


def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return quantize.codebook_frame(quantize.pq_train(v, PQ_PARTS), v)


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return quantize.pq_encode(v, quantize.pq_train(v, PQ_PARTS))


def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    book = quantize.pq_train(v, PQ_PARTS)
    return quantize.pq_decode(quantize.pq_encode(v, book), book)


def _knn_pq(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        book = quantize.pq_train(v, PQ_PARTS)
        return quantize.knn_pq(quantize.pq_encode(v, book), asked(v), K_NEAR, metric, book)

    return run


def knn_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return hnsw.knn_hnsw(hnsw.build_index(v, "l2", 2000), asked(v), K_NEAR, "l2", 100)


#: What the registered approximate searches must reach of the exact one's rows.
LEAST_RECALL = 0.9


def _enough(hits: DataFrame, v: DataFrame) -> DataFrame:
    """One row: how many queries there are, and whether the share of the exact hits found is ``LEAST_RECALL`` or more."""
    q = asked(v)
    share = knn.recall(hits, knn.knn(v, q, K_NEAR, "l2"), K_NEAR)
    return share.select((F.col("recall") >= LEAST_RECALL).alias("enough")).crossJoin(q.agg(F.count("*").alias("n_queries")))  # one row each


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enough(knn_hnsw(spark, sf_dir), vectors(spark, sf_dir))


def knn_hnsw_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as a segment reaches all of its nodes, so the hits are the exact ones."""
    v = vectors(spark, sf_dir)
    return _rounded(hnsw.knn_hnsw(hnsw.build_index(v, "l2", 250), asked(v), K_NEAR, "l2", 1000))


def _ivf(spark: SparkSession, sf_dir: str, probes: int = 12) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    centres = ivf.train_centres(v, 16)
    return ivf.knn_ivf(ivf.assign_cells(v, centres), asked(v), K_NEAR, "l2", centres, probes), v


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir)[0]


def knn_ivf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells probed: the hits are the exact ones."""
    return _rounded(_ivf(spark, sf_dir, 16)[0])


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enough(*_ivf(spark, sf_dir))


SIGN_PARTS = 32


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of plus and minus one. Few patterns fill a part, so a codebook holds them all and loses nothing."""
    v = vectors(spark, sf_dir)
    return v.withColumn("vec", F.transform("vec", lambda x: F.when(x < 0, -1.0).otherwise(1.0).cast("float")))


def pq_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _signs(spark, sf_dir)
    book = quantize.pq_train(v, SIGN_PARTS)
    back = quantize.pq_decode(quantize.pq_encode(v, book), book).select("id", F.posexplode("vec").alias("pos", "x"))
    return back.select("id", "pos", F.col("x").cast("double").alias("x"))


def _knn_pq_signs(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _signs(spark, sf_dir)
        book = quantize.pq_train(v, SIGN_PARTS)
        return _rounded(quantize.knn_pq(quantize.pq_encode(v, book), asked(v), K_NEAR, metric, book))

    return run


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, _shared(spark))


def _flat(rows: DataFrame) -> DataFrame:
    """One row for each component of a collection's vectors, with the text and the number of its metadata."""
    each = rows.select("id", F.posexplode("vec").alias("pos", "x"), F.col("meta")["parity"]["s"].alias("parity"), F.col("meta")["label"]["d"].alias("label"))
    return each.withColumn("x", F.round(F.col("x").cast("double"), 6) + F.lit(0.0))


def _written(spark: SparkSession, sf_dir: str, **config) -> Namespace:
    """A collection: all vectors, then every 7th deleted, every 11th turned round, a snapshot, every 13th deleted."""
    v = _metadata(vectors(spark, sf_dir))
    dim = v.agg(F.max(F.size("vec"))).first()[0]
    ns = _engine(spark).create("c", Config(dim=dim, segment_max_size=100, **config))
    ns.upsert_frame(v.select("id", "vec", "meta"))
    for every in (7, 13):
        ids = v.where(f"id % {every} = 0").select("id", F.lit(0).cast("bigint").alias("pos"))
        ns.delete_frame(ids)
        if every == 7:
            ns.upsert_frame(v.where("id % 11 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec"), "meta"))
            ns.checkpoint()
    return ns


def collection_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_written(spark, sf_dir).live())


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = _written(spark, sf_dir)
    sealed = ns.segments()
    s = ns.stats()
    return spark.createDataFrame([(s["size"], s["deleted"], sum(sealed.values()), len(sealed) > 1)], "size long, deleted long, sealed long, dealt boolean")


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = _written(spark, sf_dir)
    hits = ns.search(asked(vectors(spark, sf_dir)), K_NEAR, P.parse(_CONDITION[0]))
    return _rounded(hits).join(hits.select("qid", "id", F.col("meta")["parity"]["s"].alias("parity")), ["qid", "id"])


def collection_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes stored by training, before and after later writes."""
    v = vectors(spark, sf_dir)
    ns = _engine(spark).create("c", Config(dim=v.agg(F.max(F.size("vec"))).first()[0], quant_mode="sq8"))
    none = F.lit(None).cast(P.META_TYPE).alias("meta")
    ns.upsert_frame(v.select("id", "vec", none))
    ns.train()
    ns.delete_frame(v.where("id % 7 = 0").select("id", F.lit(0).cast("bigint").alias("pos")))
    ns.upsert_frame(v.where("id % 14 = 0").select("id", "vec", none))
    return _rounded(ns.search(asked(v), K_NEAR, mode="quantized"))


def collection_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs stored, then searched with later writes beside them; the beam is as wide as a segment."""
    v = vectors(spark, sf_dir)
    ns = _engine(spark).create("c", Config(dim=v.agg(F.max(F.size("vec"))).first()[0], segment_max_size=250))
    none = F.lit(None).cast(P.META_TYPE).alias("meta")
    ns.upsert_frame(v.where("id % 5 > 0").select("id", "vec", none))
    ns.index()
    ns.delete_frame(v.where("id % 7 = 0").select("id", F.lit(0).cast("bigint").alias("pos")))
    ns.upsert_frame(v.where("id % 5 = 0").select("id", "vec", none))
    return _rounded(ns.search(asked(v), K_NEAR, mode="graph", ef=1000))


def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    for name, metric in (("a", "l2"), ("b", "cosine"), ("c", "dot"), ("a", "l1")):
        e.create(name, Config(dim=8, metric=metric))
    e.drop("b")
    e.drop("c")
    e.create("c", Config(dim=9, metric="hamming"))
    again = Engine(spark, e.root)  # as after a restart
    return spark.createDataFrame([(n, again.namespace(n).config.dim, again.namespace(n).config.metric) for n in again.list()], "name string, dim int, metric string")


def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as JSON lines, every tenth in a batch of one, and upserted from there."""
    v = _metadata(vectors(spark, sf_dir))
    plain = F.struct("id", F.col("vec").alias("vector"), F.struct((F.col("meta")["parity"]["s"]).alias("parity"), (F.col("meta")["label"]["d"]).alias("label")).alias("metadata"))
    one = F.to_json(plain)
    path = _shared(spark)
    v.select(F.when(F.col("id") % 10 == 0, F.concat(F.lit('{"entries": ['), one, F.lit("]}"))).otherwise(one).alias("value")).write.text(path)
    e = _engine(spark)
    ns = e.create("c", Config(dim=v.agg(F.max(F.size("vec"))).first()[0]))
    e.ingest_json("c", path)
    return _flat(ns.live())


def binary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries sent as binary messages, and upserted from there."""
    v = _metadata(vectors(spark, sf_dir))

    def send(batches):
        for b in batches:
            made = [wire.encode("UpsertRequest", {"namespace": "c", "id": r["id"], "vector": r["vec"], "metadata": {k: x for k, x in (("parity", r["p"]), ("label", r["l"])) if x is not None}}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    messages = v.select("id", "vec", F.col("meta")["parity"]["s"].alias("p"), F.col("meta")["label"]["d"].alias("l")).mapInArrow(send, "value binary")
    e = _engine(spark)
    ns = e.create("c", Config(dim=v.agg(F.max(F.size("vec"))).first()[0]))
    e.ingest_messages(messages)
    return _flat(ns.live())


def requests_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection made, filled, searched and counted by requests alone: the nearest of id 0 among the first labels."""
    v = vectors(spark, sf_dir)
    e = _engine(spark)
    dim = v.agg(F.max(F.size("vec"))).first()[0]
    e.request("POST", "/namespaces", {"name": "c", "config": {"dim": dim, "m": 16, "m0": 32, "ef_construction": 200, "metric": "l2", "max_elements": 1000}})
    rows = v.where("label < 4").collect()  # the entries of one request, at any size those of a few labels
    e.request("POST", "/namespaces/c/vectors/batch", {"entries": [{"id": r.id, "vector": r.vec, "metadata": {"label": r.label}} for r in rows]})
    e.request("DELETE", "/namespaces/c/vectors/0")
    found = e.request("POST", "/namespaces/c/search", {"query": v.where("id = 0").first().vec, "k": K_NEAR, "ef": 50, "filter": {"type": "compare", "key": "label", "op": "gte", "value": 1}})[1]
    stats = e.request("GET", "/stats")[1]
    frame = spark.createDataFrame([(r["id"], r["distance"], r["metadata"]["label"], stats["total_vectors"], stats["upserts"]) for r in found], "id long, distance double, label double, total_vectors long, upserts long")
    return frame.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


_METRICS = ("l2", "cosine", "dot", "l1", "hamming")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_l2_single": knn_l2_single,
    **{f"knn_{m}_batch": _knn(m) for m in _METRICS},
    "knn_l2_tiles": knn_l2_tiles,
    "dist_l2_sq_matrix": dist_l2_sq,
    "range_search": range_search,
    **{f"filter_{n}": _filter(n) for n in FILTERS},
    "knn_filtered_pre": knn_filtered_pre,
    "knn_filtered_promoted": knn_filtered_promoted,
    "knn_filtered_post4k": knn_filtered_post,
    "lww_live_view": lww_live_view,
    "lww_tombstones": lww_tombstones,
    "namespace_counts": namespace_counts,
    "recover_snapshot_tail": recover_snapshot_tail,
    "compact_snapshot": compact_snapshot,
    "stream_lww": stream_lww,
    "normalize_vectors": normalize_vectors,
    "sq8_train": sq8_train,
    "sq8_encode": sq8_encode,
    "sq8_decode_error": sq8_decode_error,
    **{f"knn_sq8_{m}": _knn_sq8(m) for m in _METRICS},
    "knn_sq8_rerank": knn_sq8_rerank,
    "recall_sq8": recall_sq8,
    "pq_train": pq_train,
    "pq_encode": pq_encode,
    "pq_decode": pq_decode,
    **{f"knn_pq_{m}": _knn_pq(m) for m in ("l2", "cosine", "dot", "l1", "hamming")},
    "knn_hnsw": knn_hnsw,
    "hnsw_recall": hnsw_recall,
    "knn_ivf": knn_ivf,
    "ivf_recall": ivf_recall,
    "knn_hnsw_full": knn_hnsw_full,
    "knn_ivf_full": knn_ivf_full,
    "pq_signs": pq_signs,
    **{f"knn_pq_signs_{m}": _knn_pq_signs(m) for m in _METRICS},
    "collection_live": collection_live,
    "collection_counts": collection_counts,
    "collection_search": collection_search,
    "collection_quantized": collection_quantized,
    "collection_graph": collection_graph,
    "registry_list": registry_list,
    "json_entries": json_entries,
    "binary_entries": binary_entries,
    "requests_answered": requests_answered,
}

_RANKED = "SELECT qid, rank::INTEGER AS rank, id, round(distance, 6) + 0.0::DOUBLE AS distance"
_PASS = f"v.id IN (SELECT id FROM ({_LABELS}) WHERE {_CONDITION[1]})"

_SIGNS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END)::DOUBLE[] AS vec, label FROM embeddings)"
_ENOUGH = "SELECT true AS enough, count(*) FILTER (vec_id % 100 = 0) AS n_queries FROM embeddings"
_META = "m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN label <> 3 THEN label::DOUBLE END AS label, CASE WHEN label = 3 THEN NULL WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM embeddings)"
_COLLECTION = f"{_META}, c AS (SELECT id, CASE WHEN id % 11 = 0 THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec, label, parity FROM m WHERE (id % 7 > 0 OR id % 11 = 0) AND id % 13 > 0)"
_ENTRIES = f"WITH {_META} SELECT id, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, round(unnest(vec), 6) + 0.0::DOUBLE AS x, parity, label FROM m"

ORACLES: dict[str, str] = {
    "knn_l2_single": _knn_sql("l2", _V, pick="q.id = 0"),
    **{f"knn_{m}_batch": _knn_sql(m) for m in _METRICS},
    "knn_l2_tiles": _knn_sql("l2"),
    "dist_l2_sq_matrix": f"WITH {_V} SELECT q.id AS qid, v.id AS id, round({_DIST['l2_sq']}, 6) AS distance FROM v q, v WHERE q.id % 100 = 0",
    "range_search": f"WITH {_V} SELECT q.id AS qid, v.id AS id, round({_DIST['l2']}, 6) AS distance FROM v q, v WHERE q.id % 100 = 0 AND {_DIST['l2']} <= 1.2",
    **{f"filter_{n}": f"SELECT id FROM ({_LABELS}) WHERE {sql}" for n, (_, sql) in FILTERS.items()},
    "knn_filtered_pre": _knn_sql("l2", _V, where=_PASS),
    "knn_filtered_promoted": _knn_sql("l2", _V, where=_PASS),
    "knn_filtered_post4k": f"""WITH {_V}, d AS (SELECT q.id AS qid, v.id AS id, {_DIST["l2"]} AS distance FROM v q, v WHERE q.id % 100 = 0),
        c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {4 * K_NEAR}),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, id, distance FROM c v WHERE {_PASS})
        {_RANKED} FROM r WHERE rank <= {K_NEAR}""",
    "lww_live_view": _LIVE,
    "lww_tombstones": f"WITH {_LOG} SELECT id, seq FROM last WHERE op = 'delete'",
    "namespace_counts": f"WITH {_LOG} SELECT count(*) FILTER (op = 'upsert') AS size, count(*) FILTER (op = 'delete') AS deleted FROM last",
    "recover_snapshot_tail": _LIVE,
    "compact_snapshot": f"WITH {_LOG} SELECT event_type, count(*) AS n, max(seq) AS last_seq FROM last WHERE op = 'upsert' GROUP BY event_type",
    "stream_lww": _LIVE,
    "normalize_vectors": f"WITH {_SCALED}, n AS (SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM v) SELECT id, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, round((unnest(vec) / CASE WHEN n > 1e-9 THEN n ELSE 1 END)::FLOAT::DOUBLE, 5) AS x FROM n",
    "sq8_train": f"WITH {_BOOK} SELECT pos::INTEGER AS pos, round(low, 6) AS low, round(step, 8) AS step FROM b",
    "sq8_encode": f"WITH {_BOOK} SELECT id, pos::INTEGER AS pos, code FROM c",
    "sq8_decode_error": f"WITH {_BOOK} SELECT id, round(max(abs(low + code * step - x)), 6) AS max_error FROM c GROUP BY id",
    **{f"knn_sq8_{m}": _sq8_sql(m) for m in _METRICS},
    "knn_sq8_rerank": f"""WITH {_DECODED}, d AS (SELECT q.id AS qid, w.id AS id, {_DIST["l2"].replace("v.vec", "w.vec")} AS distance, {_DIST["l2"].replace("v.vec", "x.vec")} AS exact FROM p q, w JOIN p x ON x.id = w.id WHERE q.id % 100 = 0),
        near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {4 * K_NEAR}),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY exact, id) AS rank, id, exact AS distance FROM near)
        {_RANKED} FROM r WHERE rank <= {K_NEAR}""",
    "recall_sq8": f"""WITH {_DECODED}, d AS (SELECT q.id AS qid, w.id AS id, {_DIST["l2"].replace("v.vec", "w.vec")} AS a, {_DIST["l2"].replace("v.vec", "x.vec")} AS e FROM p q, w JOIN p x ON x.id = w.id WHERE q.id % 100 = 0),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY a, id) AS ra, row_number() OVER (PARTITION BY qid ORDER BY e, id) AS re FROM d)
        SELECT round(avg(n / {K_NEAR}), 6) AS recall FROM (SELECT qid, count(*) FILTER (ra <= {K_NEAR})::DOUBLE AS n FROM r WHERE re <= {K_NEAR} GROUP BY qid)""",
    "hnsw_recall": _ENOUGH,
    "ivf_recall": _ENOUGH,
    "knn_hnsw_full": _knn_sql("l2", _V),
    "knn_ivf_full": _knn_sql("l2", _V),
    "pq_signs": f"WITH {_SIGNS} SELECT id, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, unnest(vec) AS x FROM v",
    **{f"knn_pq_signs_{m}": _knn_sql(m, _SIGNS) for m in _METRICS},
    "collection_live": f"WITH {_COLLECTION} SELECT id, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, round(unnest(vec), 6) + 0.0::DOUBLE AS x, parity, label FROM c",
    "collection_counts": f"WITH {_COLLECTION} SELECT (SELECT count(*) FROM c) AS size, count(*) FILTER (id % 13 = 0) AS deleted, count(*) FILTER (id % 7 > 0 OR id % 11 = 0) AS sealed, count(*) > 100 AS dealt FROM m WHERE id % 13 = 0 OR id % 7 > 0 OR id % 11 = 0",
    "collection_search": f"""WITH {_COLLECTION}, d AS (SELECT q.id AS qid, v.id AS id, v.parity, {_DIST["l2"]} AS distance FROM m q, c v WHERE q.id % 100 = 0 AND v.label BETWEEN 2 AND 5)
        SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INTEGER AS rank, id, round(distance, 6) + 0.0::DOUBLE AS distance, parity FROM d QUALIFY rank <= {K_NEAR}""",
    "collection_quantized": _sq8_sql("l2").replace("WHERE q.id % 100 = 0", "WHERE q.id % 100 = 0 AND (w.id % 7 > 0 OR w.id % 14 = 0)"),
    "collection_graph": _knn_sql("l2", _V, where="v.id % 7 > 0 OR v.id % 5 = 0"),
    "registry_list": "SELECT * FROM (VALUES ('a', 8, 'l2'), ('c', 9, 'hamming')) AS r(name, dim, metric)",
    "json_entries": _ENTRIES,
    "binary_entries": _ENTRIES,
    "requests_answered": f"""WITH {_V}, r AS (SELECT v.id, {_DIST["l2"]} AS distance, v.label, count(*) OVER () AS n FROM v q, v WHERE q.id = 0 AND v.label BETWEEN 1 AND 3 AND v.id <> 0)
        SELECT id, round(distance, 6) + 0.0::DOUBLE AS distance, label::DOUBLE AS label, (SELECT count(*) FROM v WHERE label < 4 AND id <> 0) AS total_vectors, (SELECT count(*) FROM v WHERE label < 4) AS upserts FROM r ORDER BY r.distance, id LIMIT {K_NEAR}""",
}
