"""Files of float vectors: records of a 32-bit length and so many 32-bit floats, little-endian."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one task reads.
SPLIT = 32 << 20


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(where)


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        super().__init__((first, n))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        with _open(self.path) as f:
            head = f.read(4)
            self.dim = int(np.frombuffer(head, "<u4")[0]) if len(head) == 4 else 0
            self.rows = f.size() // (4 + 4 * self.dim) if self.dim else 0  # a record cut short at the end doesn't count

    def partitions(self) -> list[InputPartition]:
        per = max(1, self.split // (4 + 4 * max(1, self.dim)))
        return [_Range(s, min(per, self.rows - s)) for s in range(0, self.rows, per)] or [_Range(0, 0)]

    def read(self, partition: InputPartition):
        first, n = partition.value
        size = 4 + 4 * self.dim
        with _open(self.path) as f:
            for s in range(first, first + n, 4096):
                m = min(4096, first + n - s)
                raw = np.frombuffer(f.read_at(m * size, s * size), "<u4").reshape(m, self.dim + 1)
                if (raw[:, 0] != self.dim).any():
                    raise ValueError("vectors of several lengths")
                flat = np.ascontiguousarray(raw[:, 1:]).view("<f4").ravel()
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * self.dim), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + m)), vecs], names=["id", "vec"])


class FvecsSource(DataSource):
    """``spark.read.format("fvecs").load(path)``: rows (id, vec), id being the record's number from 0.

    A file is read in ranges, side by side. Paths are local or URIs of a store that pyarrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "id bigint, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_fvecs(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(FvecsSource)
    return spark.read.format("fvecs").option("splitbytes", str(split)).load(path)


def write_fvecs(vectors: np.ndarray, path: str) -> None:
    """Write a matrix as one local file."""
    x = np.ascontiguousarray(vectors, "<f4")
    out = np.empty((len(x), x.shape[1] + 1), "<u4")
    out[:, 0] = x.shape[1]
    out[:, 1:] = x.view("<u4")
    out.tofile(path)
