"""Shared plumbing: table access, tables kept in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may have none set; it gets one of its machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
    return (path or "/tmp/checkpoints/quiver").rstrip("/")


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiver-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_tidy, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_written: list[str] = []


def _tidy(spark: SparkSession) -> None:
    """Delete this driver's tables as it ends. Results are read from them until then; a stopped session leaves them."""
    with contextlib.suppress(Exception):
        for path in _written:
            discard(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once their plans are garbage in the JVM.

    The first round frees what Python held, the second what that held in turn.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> Callable:
    """Lift a function of one Arrow batch to ``mapInArrow``; an empty input stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run
