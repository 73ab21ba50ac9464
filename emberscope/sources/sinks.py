"""Results as JSON lines, tables written once for several readers, and stored partial results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions.objects import FORMAT_VERSION
from emberscope.session import shared_folder


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, once for all that read it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class PartialStore:
    """Per-profile partial results by ``object_key`` (``functions.objects.partial_key``).

    A call of ``add`` writes a batch of its own, ``sums`` first and ``stats`` last; what ``stats`` has is complete.  A key that
    several batches hold, as after a rerun, counts once, by its least batch.  Other versions of the format stay apart.
    """

    TABLES = ("sums", "stats")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/v{FORMAT_VERSION}"

    def add(self, sums: DataFrame, stats: DataFrame, batch: str | None = None) -> None:
        batch = batch or uuid.uuid4().hex
        for name, table in zip(self.TABLES, (sums, stats)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def keys(self) -> DataFrame:
        """(object_key, batch) of what is stored."""
        if not _exists(self.spark, f"{self.folder}/stats"):
            return self.spark.createDataFrame([], "object_key string, batch string")
        found = self.spark.read.option("basePath", f"{self.folder}/stats").parquet(f"{self.folder}/stats")
        return found.groupBy("object_key").agg(F.min(F.col("batch").cast("string")).alias("batch"))

    def read(self, name: str, wanted: DataFrame) -> DataFrame:
        """A table's rows of the keys in ``wanted`` (object_key and other columns, which the rows get)."""
        own = wanted.join(self.keys(), "object_key")
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
        return rows.join(own, ["object_key", "batch"]).drop("batch", "object_key")
