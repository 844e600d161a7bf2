"""NumPy archives (`.npz`) as a PySpark Python data source: a table whose columns are the archive's members.

Members with the same first dimension are the columns of one table: those of one dimension hold numbers, texts or
booleans, those of two a list a row. Reading opens the headers first: the schema comes from them, members that the query
does not name are never read, and rows of stored (uncompressed) members are read by their ranges of bytes, a partition
each. Compressed members are read from their start, so an archive with one is a single partition. A folder stands for its
archives one after the other, in the order of their names.

Writing gives an archive a partition, in a staging folder beside the target, which is renamed when all are there; an
aborted write leaves nothing. With option ``single`` the parts are put together into one archive first, by the driver,
member by member: for short tables such as spectra. Rows keep their order within and across partitions. Options starting
with ``meta.`` become a JSON text in the archive's member ``metadata_json``, which :func:`metadata_of` reads.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from strataspan.sources.manifested import files_below, filesystem

PART_BYTES, BATCH_ROWS = 32 << 20, 8192
METADATA = "metadata_json"


@dataclass(frozen=True)
class Member:
    """``begin``: where a stored member's numbers are in the archive; None if it is compressed."""

    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    begin: int | None

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=int))

    def arrow_type(self) -> pa.DataType:
        one = pa.string() if self.dtype.kind == "U" else pa.from_numpy_dtype(self.dtype)
        return one if len(self.shape) == 1 else pa.list_(one)

    def to_arrow(self, rows: np.ndarray) -> pa.Array:
        if len(self.shape) == 1:
            return pa.array(rows.tolist(), pa.string()) if self.dtype.kind == "U" else pa.array(rows)
        width = rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)), pa.array(rows.reshape(-1)))


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = npy.read_magic(f)
    shape, fortran, dtype = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
    if fortran and len(shape) > 1 or dtype.hasobject:
        raise ValueError("arrays are row-major and hold no objects")
    return shape, fortran, dtype


def members_of(fs: pafs.FileSystem, path: str) -> dict[str, Member]:
    """All members of an archive, by their headers."""
    out = {}
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            with z.open(info) as m:
                shape, _, dtype = _header(m)
                head = m.tell()
            begin = None
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)  # where a local header has the lengths of name and extra field
                lengths = f.read(4)
                begin = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little") + head
            name = info.filename.removesuffix(".npy")
            out[name] = Member(name, shape, dtype, begin)
    return out


def table_members(members: dict[str, Member]) -> dict[str, Member]:
    """The members that are columns: arrays of one or two dimensions, of the same length."""
    columns = {k: m for k, m in members.items() if len(m.shape) in (1, 2) and k != METADATA}
    if len({m.shape[0] for m in columns.values()}) > 1:
        raise ValueError(f"arrays of different lengths: { {k: m.shape[0] for k, m in columns.items()} }")
    return columns


def metadata_of(uri: str) -> dict:
    """The JSON text of an archive, or of the first in a folder; empty if there is none."""
    fs, _ = filesystem(uri)
    with fs.open_input_file(files_below(uri)[0]) as f, np.load(f) as z:
        return json.loads(str(z[METADATA])) if METADATA in z.files else {}


@dataclass
class RowRange(ds.InputPartition):
    path: str
    lo: int
    hi: int

    def __post_init__(self):
        super().__init__((self.path, self.lo, self.hi))


class NpzReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.uri = to_arrow_schema(schema), options["path"]
        self.step = int(options.get("partbytes", PART_BYTES))

    def _wanted(self, fs: pafs.FileSystem, path: str) -> list[Member]:
        columns = table_members(members_of(fs, path))
        lost = set(self.schema.names) - set(columns)
        if lost:
            raise ValueError(f"{path} lacks {sorted(lost)}")
        return [columns[n] for n in self.schema.names]

    def partitions(self):
        fs, _ = filesystem(self.uri)
        out = []
        for path in files_below(self.uri):
            wanted = self._wanted(fs, path)
            n = wanted[0].shape[0] if wanted else 0
            whole = any(m.begin is None for m in wanted)
            step = n if whole else max(1, self.step // max(1, sum(m.row_bytes for m in wanted)))
            out += [RowRange(path, k, min(k + step, n)) for k in range(0, n, max(1, step))]
        return out or [RowRange("", 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.uri)
        wanted = self._wanted(fs, part.path)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            streams = {}
            for m in wanted:
                if m.begin is None:
                    streams[m.name] = z.open(f"{m.name}.npy")
                    _header(streams[m.name])
            for lo in range(part.lo, part.hi, BATCH_ROWS):
                rows = min(BATCH_ROWS, part.hi - lo)
                columns = []
                for m, field in zip(wanted, self.schema):
                    if m.begin is None:
                        data = streams[m.name].read(rows * m.row_bytes)
                    else:
                        f.seek(m.begin + lo * m.row_bytes)
                        data = f.read(rows * m.row_bytes)
                    columns.append(m.to_arrow(np.frombuffer(data, m.dtype).reshape(rows, *m.shape[1:])).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


@dataclass
class Part(ds.WriterCommitMessage):
    name: str | None


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        raise ValueError("an array holds no nulls")
    if pa.types.is_list(column.type):
        rows = column.to_pylist()
        return np.array(rows, column.type.value_type.to_pandas_dtype()).reshape(len(rows), -1)
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy()


class NpzWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.target, self.overwrite, self.names = options["path"].rstrip("/"), overwrite, schema.fieldNames()
        self.single = options.get("single", "false").lower() == "true"
        self.meta = {k.removeprefix("meta."): v for k, v in options.items() if k.startswith("meta.")}
        head, _, tail = self.target.rpartition("/")
        self.staging = f"{head}/.staging-{tail}-{uuid.uuid4().hex}"
        fs, path = filesystem(self.target)
        if not overwrite and fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise FileExistsError(self.target)

    def _save(self, fs: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray]) -> None:
        meta = {METADATA: np.array(json.dumps(self.meta, sort_keys=True))} if self.meta else {}
        data = io.BytesIO()
        np.savez(data, **arrays, **meta)
        with fs.open_output_stream(path, compression=None) as out:
            out.write(data.getbuffer())

    def write(self, iterator):
        from pyspark import TaskContext

        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Part(None)
        fs, path = filesystem(self.staging)
        fs.create_dir(path, recursive=True)
        table, context = pa.Table.from_batches(batches), TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.npz"
        self._save(fs, f"{path}/{name}", {n: _numpy(table[n]) for n in self.names})
        return Part(name)

    def commit(self, messages):
        fs, staging = filesystem(self.staging)
        _, target = filesystem(self.target)
        kept = sorted(m.name for m in messages if m and m.name)
        fs.create_dir(staging, recursive=True)
        for info in fs.get_file_info(pafs.FileSelector(staging)):
            if info.base_name not in kept:  # of an attempt that was not the one
                fs.delete_file(info.path)
        done = staging
        if self.single:
            done = f"{staging}.npz"
            joined: dict[str, list[np.ndarray]] = {n: [] for n in self.names}
            for name in kept:
                with fs.open_input_file(f"{staging}/{name}") as f, np.load(f) as z:
                    for n in self.names:
                        joined[n].append(z[n])
            self._save(fs, done, {n: np.concatenate(a) if a else np.zeros(0) for n, a in joined.items()})
            fs.delete_dir(staging)
        found = fs.get_file_info(target).type
        if found == pafs.FileType.Directory:
            fs.delete_dir(target)
        elif found == pafs.FileType.File and not self.single:
            fs.delete_file(target)
        fs.move(done, target)

    def abort(self, messages):
        fs, staging = filesystem(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class NpzSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        fs, _ = filesystem(self.options["path"])
        columns = table_members(members_of(fs, files_below(self.options["path"])[0]))
        return from_arrow_schema(pa.schema([(k, m.arrow_type()) for k, m in columns.items()]))

    def reader(self, schema):
        return NpzReader(schema, self.options)

    def writer(self, schema, overwrite):
        return NpzWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
