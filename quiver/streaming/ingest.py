"""Streams of log entries into collections and live views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiver.engine import Namespace
from quiver.operators import lww


def stream_into(ns: Namespace, entries: DataFrame, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Append a stream of (op, id, vec, meta, pos) to a collection's log, a batch at a time, and keep it compacted.

    A batch that is replayed after a failure appends the same entries again, which changes nothing: the last writer is
    the same.
    """

    def append(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        up, down = batch.where("op = 'upsert'"), batch.where("op = 'delete'")
        last = lww.last_entries(up.select("id", "pos", "vec", "meta").withColumn("op", F.lit("upsert")).unionByName(down.select("id", "pos", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast(dict(batch.dtypes)["meta"]).alias("meta"), F.lit("delete").alias("op"))), "id", ("pos",)).persist()
        ns.upsert_frame(last.where("op = 'upsert'").drop("op"))
        gone = last.where("op = 'delete'")
        if not gone.isEmpty():
            ns._append(gone.withColumns({"seq": F.lit(ns._next_seq()).cast("bigint")}))
        last.unpersist()
        batch.unpersist()
        if compact:
            ns.maybe_compact()

    return entries.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_stream(entries: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """A streaming live view: state is one entry a key; late entries of lower order lose by themselves."""
    rest = [c for c in entries.columns if c != key]
    last = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return last.select(key, *(F.col("__last")[c].alias(c) for c in rest)).where(F.col(op) == "upsert")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a complete-mode stream over what there is, leaving its last state as a table at ``path``."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
