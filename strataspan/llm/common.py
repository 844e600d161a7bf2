"""Small things that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.sources.store import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; see :func:`shared_folder`."""
    return shared_folder(spark, "strataspan")


#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Lower the session's limit on Arrow batches to a few megabytes, for functions that hand whole texts to Python: both
    sides of a worker hold some batches at a time, and texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(key, "64m").lower().removesuffix("b")
    size = int(have.rstrip("kmgt") or 0) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(have[-1:], 0)
    if size <= 0 or size > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


class Settled:
    """Writes intermediate results as Parquet to one shared folder and reads them back.

    Unlike those of a checkpoint, the plans that follow carry nothing over from what was written, so they stay small
    however many rounds an algorithm takes; and no lost executor brings earlier rounds back.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark), 0

    def __call__(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """``narrow``: a table of ids and numbers only, a hundredth of the texts it came from, which needs fewer files."""
        self.n += 1
        df = df.coalesce(max(2, parts(self.spark) // 16)) if narrow else df
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """crc32 of the id's decimal text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
