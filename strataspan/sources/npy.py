"""Dense `.npy` matrices as a PySpark Python data source: (row_id, features), one partition for each range of rows."""

from __future__ import annotations

import ast
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, BATCH_ROWS = 32 << 20, 1024


@dataclass
class Rows(InputPartition):
    lo: int
    hi: int

    def __post_init__(self):
        super().__init__((self.lo, self.hi))


def header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the numbers begin) of an open file; only row-major arrays of two dimensions are read."""
    head = f.read(12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = head[6] >= 2
    size = int.from_bytes(head[8:12] if wide else head[8:10], "little")
    begin = (12 if wide else 10) + size
    f.seek(12 if wide else 10)
    spec = ast.literal_eval(f.read(size).decode("latin-1"))
    if spec["fortran_order"] or len(spec["shape"]) != 2:
        raise ValueError("a row-major matrix is needed")
    return spec["shape"], np.dtype(spec["descr"]), begin


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.width = options["path"], int(options.get("width", 0))

    def _open(self):
        fs, path = pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri.removeprefix("file:"))
        return fs.open_input_file(path)

    def partitions(self):
        with self._open() as f:
            (n, d), kind, _ = header(f)
        step = max(1, PART_BYTES // max(1, d * kind.itemsize))
        return [Rows(k, min(k + step, n)) for k in range(0, n, step)] or [Rows(0, 0)]

    def read(self, part: Rows):
        with self._open() as f:
            (_, d), kind, begin = header(f)
            width = min(self.width or d, d)
            for lo in range(part.lo, part.hi, BATCH_ROWS):
                hi = min(lo + BATCH_ROWS, part.hi)
                f.seek(begin + lo * d * kind.itemsize)
                x = np.frombuffer(f.read((hi - lo) * d * kind.itemsize), kind).reshape(hi - lo, d)[:, :width].astype(np.float32)
                values = pa.array(x.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), values)], names=["row_id", "features"])


class NpyDataSource(DataSource):
    """Option ``width`` keeps a prefix of the columns."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_id long, features array<float>"

    def reader(self, schema):
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
