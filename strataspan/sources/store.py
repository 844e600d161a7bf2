"""A folder of Parquet tables with a recorded configuration: error, resume and replace policies, schema checks."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strataspan.plans.identity import stable_hash


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it is deleted when the session's JVM
    ends. Only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/strataspan-shared"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(hadoop)  # a folder has to be there to be marked
    fs.deleteOnExit(hadoop)
    return path


def settled(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to a shared folder and read it back: what follows does not plan or run it again."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the files of some tables: names, sizes and times of their last change."""
    conf, found = spark._jsparkSession.sessionState().newHadoopConf(), []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return stable_hash({"files": sorted(found)})


@dataclass(frozen=True)
class RunPolicy:
    """What to do where a result exists: ``error``, ``resume`` (only if its configuration is the same) or ``replace``."""

    existing: str = "error"

    def __post_init__(self):
        if self.existing not in ("error", "resume", "replace"):
            raise ValueError(f"unknown policy {self.existing}")


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Names, order and types must be exactly those of ``schema``."""
    got, want = ([(f.name, f.dataType) for f in s.fields] for s in (df.schema, schema))
    if got != want:
        raise ValueError(f"columns {got} are not {want}")
    return df


class Store:
    """Tables by key below one folder. A marker file, renamed into place after the data are written, names the folder of
    the data and the hash of their configuration; replacing a table replaces its marker in one step, so a reader finds
    the old table or the new one and never a part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, key: str) -> tuple[str, str] | None:
        """(hash, folder of the data) of a finished table."""
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}/marker")
        fs = marker.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(marker):
            return None
        stream = fs.open(marker)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return tuple(text.split(" "))

    def _mark(self, key: str, config_hash: str, data: str) -> None:
        fs_ = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        new, marker = (fs_.Path(f"{self.path}/{key}/{n}") for n in (f"marker-{data}", "marker"))
        out = new.getFileSystem(conf).create(new)
        out.write(bytearray(f"{config_hash} {data}".encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(fs_.Options.Rename, 1)
        overwrite[0] = fs_.Options.Rename.OVERWRITE
        fs_.FileContext.getFileContext(new.toUri(), conf).rename(new, marker, overwrite)

    def _drop(self, key: str, data: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}/{data}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def has(self, key: str) -> bool:
        return self._marker(key) is not None

    def read(self, key: str, schema: T.StructType | None = None) -> DataFrame:
        found = self._marker(key)
        if found is None:
            raise FileNotFoundError(key)
        df = self.spark.read.parquet(f"{self.path}/{key}/{found[1]}")
        return check_schema(df, schema) if schema else df

    def write(self, key: str, df: DataFrame, config: dict, policy: RunPolicy = RunPolicy()) -> DataFrame:
        have, want = self._marker(key), stable_hash(config)
        if have and policy.existing == "error":
            raise FileExistsError(key)
        if have and policy.existing == "resume":
            if have[0] != want:
                raise ValueError(f"{key} was made with another configuration")
            return self.read(key)
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{key}/{data}")
        self._mark(key, want, data)
        if have:
            self._drop(key, have[1])
        return self.read(key)
