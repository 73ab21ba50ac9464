"""Per-profile partial results of profiles as they arrive.

A stream of new objects is parsed and walked once; each micro-batch appends its partial tables as
Parquet, and groups are merged from those at query time.  A batch that is run again after a failure
writes to the same folder, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberscope.functions.objects import FORMAT_VERSION
from emberscope.operators import aggregate as agg
from emberscope.sources import profiles as src
from emberscope.sources import store

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, base: str) -> DataFrame:
    """A stream of (raw, size, path, content) of the objects below ``base``."""
    base = base.rstrip("/")
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cpuprofile").load(base)
    at = base.split("://")[-1]
    raw = F.substr(F.col("path"), F.instr(F.col("path"), f"{at}/") + len(at) + 1)
    return files.select(raw.alias("raw"), F.col("length").alias("size"), "path", F.col("content").cast("string").alias("content"))


def profiles_of(objects: DataFrame, root: str = "") -> DataFrame:
    """Parsed profiles of (raw, size, path, content); a member's rank is its hash, which needs no other member."""
    members = store.members_of(objects.drop("content"), root).select("group_id", F.col("raw").alias("profile_id"))
    rows = members.join(objects.select(F.col("raw").alias("_raw"), "content"), F.col("profile_id") == F.col("_raw"))
    return src.profiles(rows.select("group_id", "profile_id", F.xxhash64("profile_id").alias("member_rank"), "content"))


def writer(objects: DataFrame, folder: str, root: str = "") -> DataStreamWriter:
    """A writer that keeps ``folder``'s partial tables up to date with the stream."""

    def batch(df: DataFrame, number: int) -> None:
        profiles = profiles_of(df, root).persist()
        for name, table in agg.partials(profiles).items():
            table.write.mode("overwrite").parquet(f"{folder}/v{FORMAT_VERSION}/{name}/batch={number}")
        profiles.unpersist()

    return objects.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/_progress")


def merged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Groups' tables from all batches so far."""
    parts = {name: spark.read.parquet(f"{folder}/v{FORMAT_VERSION}/{name}") for name in (*agg.TABLES, "stats")}
    return agg.merged_tables(parts)
