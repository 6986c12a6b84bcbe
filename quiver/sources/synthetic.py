"""Seeded random vectors, made where they are used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Seeds of the rows searched and of the queries. Fixed values of the benchmark.
TRAIN_SEED, QUERY_SEED = 42, 1337
_BLOCK = 4096


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = TRAIN_SEED, normalize: bool = False) -> DataFrame:
    """Rows (id, vec): ids 0 to n-1, components from N(0, 1), divided by the norm if asked.

    Each block of ids has a generator of its own, so the rows don't depend on partitions.
    """

    def make(batches):
        for b in batches:
            for block in b.column(0).to_pylist():
                x = np.random.default_rng([seed, block]).standard_normal((min(_BLOCK, n - block * _BLOCK), dim)).astype(np.float32)
                if normalize:
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.where(size > 1e-9, x / np.where(size > 1e-9, size, 1), x).astype(np.float32)
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + block * _BLOCK), vecs], names=["id", "vec"])

    blocks = -(-n // _BLOCK)
    return spark.range(0, blocks, 1, max(1, min(blocks, 4096))).mapInArrow(make, "id bigint, vec array<float>")
