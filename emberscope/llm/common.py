"""Helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Marks around matches; text that holds them gets OTHER instead, which no pattern here matches either.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local master (as in tests) gets a folder of its own; a cluster gets an error, as its
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, without a shuffle: small tables would otherwise be as many files as there are shuffle partitions.

    Two for each core, but an eighth of the shuffle partitions at least: cores may still be few where they come on demand.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame, few: bool = True) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and where; unlike a checkpoint's, its size is known to the planner.

    For loops: there the estimated sizes of checkpoints would multiply with every round.  ``few``: in few files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (few_files(df) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``rewritten`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of ``checkpointed`` that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffles of tables whose lineage is cut: it does so when the driver's JVM collects their plans, which may be long after."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches hold at most 16 MB, unless the session says another size than Spark's own.

    Rows here are whole texts and sets: a batch of Spark's 64 MB is in the JVM's buffers, in the worker's and in its arrays at once.
    """
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name) == f"{usual}b":
        spark.conf.set(name, f"{16 << 20}b")


def tidy(run):
    """``run`` over Arrow batches, giving freed memory back at its end: Python workers live on for later stages."""

    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return whole


def merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: both sides grow with the corpus, and a broadcast passes through the driver."""
    return df.hint("merge")


def looked_up(rows: DataFrame, key: str, table: DataFrame, spread: str, parts: int = 1000) -> DataFrame:
    """``rows`` left-joined by ``key`` with the other columns of ``table`` (key, rows: how many rows have the key, ...).

    Keys of more than a ``parts``-th of all rows, so ``parts`` keys at most, are broadcast; among the rest no key is hot.
    ``spread``: a column of ``rows`` that differs within a key.
    """
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") * parts > total
    names = [c for c in table.columns if c not in (key, "rows")]
    side = lambda t, mark: t.select(F.col(key).alias(f"_key{mark}"), *[F.col(c).alias(f"_{c}{mark}") for c in names])
    out = rows.join(F.broadcast(side(table.filter(hot), 0)), F.col(key) == F.col("_key0"), "left")
    # Rows that are served are dealt over keys that match nothing: they have a second part.
    none, own = F.struct(F.xxhash64(spread).alias("h"), F.lit(None).cast(table.schema[key].dataType).alias("k")), F.struct(F.lit(0).cast("long").alias("h"), F.col(key).alias("k"))
    out = out.withColumn("_at", F.when(F.col("_key0").isNotNull(), none).otherwise(own))
    cold = side(table.filter(~hot), 1).withColumn("_to", F.struct(F.lit(0).cast("long").alias("h"), F.col("_key1").alias("k")))
    out = out.join(merge(cold), F.col("_at") == F.col("_to"), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_{c}0", f"_{c}1").alias(c) for c in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def first_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: other columns, whatever they are called, can't clash later on."""
    return df.select(*[df[n] for n in names])
