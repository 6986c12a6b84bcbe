"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and batch search over synthetic vectors; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quiver.operators import hnsw, ivf, knn, quantize
from quiver.plans import catalogue
from quiver.sources.synthetic import QUERY_SEED, gaussian

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "knn_l2_batch", "knn_cosine_batch", "knn_dot_batch", "knn_l1_batch", "knn_hamming_batch", "knn_l2_tiles", "knn_filtered_pre", "knn_filtered_post4k", "range_search", "lww_live_view", "recover_snapshot_tail", "stream_lww",
    "sq8_train", "sq8_encode", "knn_sq8_l2", "knn_sq8_rerank", "pq_train", "knn_pq_l2", "knn_hnsw", "knn_ivf",
]
#: Rows, queries, dimensions and k of the synthetic workloads. Fixed values of the benchmark.
WORKLOADS = {"10k": (10_000, 100, 128, 10), "100k": (100_000, 1000, 128, 10)}




def best(make, times: int = 2) -> float:
    """Least seconds of some runs, planning included."""
    out = []
    for _ in range(times):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return round(min(out), 3)


def synthetic(spark: SparkSession, rows: int, asked: int, dim: int, k: int, graphs: bool) -> dict:
    """Queries a second and recall of each way to search, as batches."""
    v = gaussian(spark, rows, dim).persist()
    q = gaussian(spark, asked, dim, QUERY_SEED).toDF("qid", "q").persist()
    v.count(), q.count()
    out = {"exact": {"sec": best(lambda: knn.knn(v, q, k)), "recall_at_k": 1.0}}
    truth = knn.knn(v, q, k).persist()  # kept only once the same plan has been timed
    truth.count()
    book = quantize.pq_train(v, 8)
    codes = quantize.pq_encode(v, book).persist()
    codes.count()
    ways = {"pq": lambda: quantize.knn_pq(codes, q, k, "l2", book), "pq_rerank": lambda: quantize.rerank(quantize.knn_pq(codes, q, 10 * k, "l2", book), v, q, k, "l2")}
    centres = ivf.train_centres(v, 64)
    cells = ivf.assign_cells(v, centres).persist()
    cells.count()
    if graphs:
        ways["ivf_16_of_64"] = lambda: ivf.knn_ivf(cells, q, k, "l2", centres, 16)
        start = time.perf_counter()
        index = hnsw.build_index(v, "l2", 1250).persist()
        index.count()
        out["hnsw_build"] = {"sec": round(time.perf_counter() - start, 3)}
        for ef in (10, 50, 100):
            ways[f"hnsw_ef{ef}"] = lambda ef=ef: hnsw.knn_hnsw(index, q, k, "l2", ef)
    for name, way in ways.items():
        out[name] = {"sec": best(way, 1), "recall_at_k": round(knn.recall(way(), truth, k).first()[0], 4)}
    for x in out.values():
        x["qps"] = round(asked / x["sec"], 1)
    out.get("hnsw_build", {}).pop("qps", None)
    spark.catalog.clearCache()
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["knn_l2_batch"](spark, SF_DIR).collect()  # starts Python workers
    seconds = {n: best(lambda n=n: catalogue.QUERIES[n](spark, SF_DIR)) for n in HEADLINE}
    work = {n: synthetic(spark, *w, graphs=n == "10k") for n, w in WORKLOADS.items()}
    rows, _, dim, k = WORKLOADS["10k"]
    graph = work["10k"]
    harness = {"config": {"dim": dim, "n_train": rows, "k": k, "metric": "l2", "quant": "none"}, "results": [{"ef": ef, "qps": graph[f"hnsw_ef{ef}"]["qps"], "recall_at_k": graph[f"hnsw_ef{ef}"]["recall_at_k"]} for ef in (10, 50, 100)]}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "cores": CPUS, "synthetic": work, "harness": harness}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
