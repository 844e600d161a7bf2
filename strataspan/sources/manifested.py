"""Tables behind a manifest, as a PySpark Python data source.

Each row of a manifest describes a run and names the file or folder with its rows. The source gives those rows with the
run's columns beside them. Filters on the run's columns choose among the manifest's rows before any file is opened, and
of Parquet files only the wanted columns are read. A manifest is a CSV file, a Parquet file or a folder of Parquet files;
the data are CSV or Parquet files. It is read by the driver: one row a run.

Options: ``path`` (the manifest), ``pathcolumn`` (its column of paths, by default ``path``; relative ones start at
``root``, by default the manifest's own folder), ``key`` (columns that tell runs apart, comma-separated; a key that two
rows share is an error, wherever it is).
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

COMPARED = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__}
BATCH_ROWS = 1 << 16


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def files_below(uri: str) -> list[str]:
    """The data files that a path names, in order: itself, or those in the folder and below that no marker hides."""
    fs, path = filesystem(uri)
    (info,) = fs.get_file_info([path])
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))


def batches(fs: pafs.FileSystem, path: str, names: list[str] | None) -> Iterator[pa.RecordBatch]:
    """The wanted columns of a file; one that it does not have is an error."""
    with fs.open_input_file(path) as f:
        if path.endswith(".csv"):
            reader = pc.open_csv(f, convert_options=pc.ConvertOptions(include_columns=names))
            yield from reader
        else:
            source = pq.ParquetFile(f)
            lost = set(names or ()) - set(source.schema_arrow.names)
            if lost:
                raise ValueError(f"{path} lacks {sorted(lost)}")
            yield from source.iter_batches(BATCH_ROWS, columns=names)


def file_schema(uri: str) -> pa.Schema:
    fs, _ = filesystem(uri)
    first = files_below(uri)[0]
    with fs.open_input_file(first) as f:
        return pc.open_csv(f).schema if first.endswith(".csv") else pq.ParquetFile(f).schema_arrow


def holds(f: ds.Filter) -> Callable[[dict], bool | None] | None:
    """A filter as a test of a manifest row, null where a compared value is null; None if it is not understood."""
    if isinstance(f, ds.Not):
        inner = holds(f.child)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    if len(getattr(f, "attribute", ())) != 1:
        return None
    (column,) = f.attribute
    if isinstance(f, ds.IsNull):
        return lambda row: row[column] is None
    if isinstance(f, ds.IsNotNull):
        return lambda row: row[column] is not None
    if isinstance(f, ds.EqualNullSafe):
        return lambda row: row[column] == f.value
    if isinstance(f, ds.In):
        return lambda row: None if row[column] is None else row[column] in f.value
    if type(f) in COMPARED:
        compare = COMPARED[type(f)]
        return lambda row: None if row[column] is None or f.value is None else compare(row[column], f.value)
    return None


@dataclass
class RunFile(ds.InputPartition):
    uri: str
    run: dict = field(default_factory=dict)

    def __post_init__(self):
        super().__init__(self.uri)


class ManifestedReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.manifest = to_arrow_schema(schema), options["path"]
        self.column, self.key = options.get("pathcolumn", "path"), [k.strip() for k in options.get("key", "").split(",") if k.strip()]
        default = self.manifest if not self.manifest.endswith((".csv", ".parquet")) else self.manifest.rpartition("/")[0]
        self.root = options.get("root", default).rstrip("/")
        self.run_columns = set(file_schema(self.manifest).names)
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            base = f.child if isinstance(f, ds.Not) else f
            if holds(f) is None or base.attribute[0] not in self.run_columns:
                yield f
            else:
                self.filters.append(f)

    def runs(self) -> list[dict]:
        fs, _ = filesystem(self.manifest)
        rows = [row for path in files_below(self.manifest) for batch in batches(fs, path, None) for row in batch.to_pylist()]
        twice = [k for k, n in Counter(tuple(row[c] for c in self.key) for row in rows).items() if n > 1] if self.key else []
        if twice:
            raise ValueError(f"the manifest has several rows for {dict(zip(self.key, twice[0]))}")
        return rows

    def partitions(self):
        tests = [holds(f) for f in self.filters]
        chosen = [row for row in self.runs() if all(t(row) for t in tests)]
        scheme = f"{self.manifest.partition('://')[0]}://" if "://" in self.manifest else ""
        out = []
        for row in chosen:
            path = row[self.column]
            uri = path if "://" in path or path.startswith("/") else f"{self.root}/{path}"
            out += [RunFile(scheme + found, row) for found in files_below(uri)]
        return out or [RunFile("")]

    def read(self, part: RunFile):
        if not part.uri:
            return
        fs, path = filesystem(part.uri)
        names = [n for n in self.schema.names if n not in self.run_columns]
        for batch in batches(fs, path, names):
            columns = [batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.array([part.run[f.name]] * batch.num_rows, f.type) for f in self.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class ManifestedSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "manifested"

    def schema(self):
        """The manifest's columns, then those of the first run's rows."""
        reader = ManifestedReader(T.StructType(), self.options)
        manifest = file_schema(self.options["path"])
        first = reader.partitions()[0]
        data = file_schema(first.uri) if first.uri else pa.schema([])
        return from_arrow_schema(pa.schema([*manifest, *[f for f in data if f.name not in manifest.names]]))

    def reader(self, schema):
        return ManifestedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestedSource)


def read_manifested(spark: SparkSession, manifest: str, schema: T.StructType | str | None = None, **options: str):
    """Rows of the manifest's runs; see the module for options. Filter the result to read some of the runs."""
    register(spark)
    reader = spark.read.format("manifested").options(**options)
    return (reader.schema(schema) if schema else reader).load(manifest)
