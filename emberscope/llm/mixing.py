"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Main path: SQL functions alone.  A source's weight gives its share of all words, but at most
``MOST`` times its own; what a capped source can't take goes to the others by weight.  With a
target of ``e + f`` times its size, a source is taken ``e`` times as a whole (complete epochs)
and then a fraction ``f``: documents in the order of the keys ``-ln(u) / quality weight``, until
the running sum of words comes nearest to the rest of the budget.  ``u`` comes from a hash of the
row, so runs agree.

The running sums don't bring a source's rows together: each key falls into one of ``BUCKETS``
key ranges, sums by range are added up first, and only the rows of one range meet in a window.
Rows that repeat (id, source and text) have one key, so they go through the windows as one row with
a count: however many they are, none of them has to meet the others.

Null text has size 0; a null source is a source of its own, last in the order; a null doc_id is
a key like any other.  Rows that repeat are taken one by one, the first of them once more than the
others where the budget ends among them.  Sources of size 0 have target 0.  Sources are numbered and
levelled in windows of one row for each source.
Quality weights: ``WEIGHTS`` by label, 1 without one; of several labels the best counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, few_files, first_only, rewritten

CYCLE, MOST, BUCKETS = (5.0, 2.0, 1.0), 3, 4096
#: Rows that repeat more often than this are numbered in parts, and leave one task in parts.
RUN = 10_000
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = {1: 2.0, 0: 0.5}


def draw(doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1] that the row alone decides."""
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 1) / float(2**52)


def keyed(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, source, digest, size, key, bucket) of every row, without its text."""
    rows = docs.select(
        "doc_id", "source",
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    weight = F.lit(1.0)
    if labels is not None:
        best = first_only(labels, "doc_id", "quality").filter("quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
        rows = rows.join(best, rows.doc_id == best._id, "left").drop("_id")
        for quality, w in WEIGHTS.items():
            weight = F.when(F.col("_quality") == quality, w).otherwise(weight)
        weight = F.coalesce(weight, F.lit(1.0))
    rows = rows.withColumn("key", -F.log(draw(F.col("doc_id"), F.col("digest"))) / weight).drop("_quality")
    rows = rows.withColumn("bucket", F.least(F.floor(BUCKETS * (1 - F.exp(-F.col("key")))), F.lit(BUCKETS - 1)).cast("int"))
    return rows.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))


def targets(sums: DataFrame) -> DataFrame:
    """(sk, source_size, target) from sums by (sk, source, bucket): one row for each source.

    With caps in the order of cap / weight, the sources that stay at their caps come first; the
    level at which the rest share is the first that the next cap doesn't undercut.
    """
    sources = sums.groupBy("sk", "source").agg(F.sum("words").cast("double").alias("s"))
    # One row for each source: these windows see sources, not documents.
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.lit(CYCLE[-1])
    for i, w in enumerate(CYCLE[:-1]):
        weight = F.when(rank % len(CYCLE) == i, w).otherwise(weight)
    t = sources.withColumn("w", weight).withColumn("ratio", MOST * F.col("s") / F.col("w"))
    order = W.orderBy("ratio", "sk")
    t = t.withColumn("total", F.sum("s").over(W.partitionBy()))
    t = t.withColumn("before", F.coalesce(F.sum(MOST * F.col("s")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sk", "level"))).over(W.partitionBy())
    t = t.withColumn("share", first["level"])
    return t.select("sk", F.col("s").cast("long").alias("source_size"), F.least(MOST * F.col("s"), F.coalesce(F.col("share") * F.col("w"), MOST * F.col("s"))).alias("target"))


def decided(docs: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(doc_id, sk, digest, size, source_size, target, n, epochs, extra): one row for ``n`` equal rows, each taken ``epochs`` times and ``extra`` of them once more.

    Also whether some row repeats more than ``RUN`` times.
    """
    rows = keyed(docs, labels).groupBy("sk", "source", "bucket", "key", "doc_id", "digest", "size").agg(F.count("*").alias("n"))
    rows = checkpointed(few_files(rows))
    words = F.col("size") * F.col("n")
    sums = rows.groupBy("sk", "source", "bucket").agg(F.sum(words).alias("words"))
    t = targets(sums)
    ranges = sums.select("sk", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    state = ranges.join(t, "sk")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    all_rows = rows.drop("source").join(state, ["sk", "bucket"])
    inside = W.partitionBy("sk", "bucket").orderBy("key", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    # A row is taken if its middle lies within the rest of the budget; the middles of equal rows are a row's size apart.
    left = F.col("rest") - (ahead + F.col("size") * 0.5)
    fit = F.when(F.col("size") > 0, F.floor(left / F.col("size")) + 1).otherwise(F.col("n"))
    extra = F.when((F.col("rest") > 0) & (left >= 0), F.least(fit, F.col("n"))).otherwise(F.lit(0)).cast("long")
    return all_rows.select("doc_id", "sk", "digest", "size", "source_size", "target", "n", "epochs", extra.alias("extra")), not rows.filter(F.col("n") > RUN).isEmpty()


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, sk, digest, size, source_size, target, copies) for every row of ``docs``."""
    groups, often = decided(docs, labels)
    numbers = lambda lo, hi: F.explode(F.sequence(lo, hi))
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    if often:
        # Parts of RUN rows each are dealt out before they become rows.
        groups = groups.withColumn("part", numbers(zero, F.floor(last / RUN))).repartition("doc_id", "sk", "digest", "part")
        zero = F.col("part") * RUN
        last = F.least(last, zero + RUN - 1)
    rows = groups.withColumn("number", numbers(zero, last))
    copies = F.col("epochs") + (F.col("number") < F.col("extra")).cast("long")
    return rows.select("doc_id", "sk", "digest", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: every taken row of ``docs`` as often as it is taken, in the columns of ``docs``.

    Texts move once: rows meet their group's decision by a digest.  Where rows repeat often, the joined rows are
    written, so that Spark may split the join, and moved once more to be numbered.
    """
    names = docs.columns
    sk = F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit(""))
    digest = F.md5(F.coalesce(docs["text"], F.lit("")))
    key = lambda doc_id, sk, digest: F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), sk, digest)
    rows = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(names)], docs["doc_id"].alias("_id"), sk.alias("_sk"), digest.alias("_digest"), key(docs["doc_id"], sk, digest).alias("_k"))
    groups, often = decided(docs, labels)
    taken = groups.filter("epochs > 0 or extra > 0").select("doc_id", "sk", "digest", "n", "epochs", "extra", key(F.col("doc_id"), F.col("sk"), F.col("digest")).alias("k"))
    hit = rows.join(taken, (F.col("_k") == F.col("k")) & F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sk") == F.col("sk")) & (F.col("_digest") == F.col("digest")))
    same = ("_k", "_id", "_sk", "_digest")
    before = F.lit(0)
    if often:
        # Rows of one task are a part; parts' counts give where each begins.
        hit, _ = rewritten(hit.withColumn("_part", F.spark_partition_id()), few=False)
        parts = hit.groupBy(*same, "_part").agg(F.count("*").alias("_rows"))
        ahead = F.sum("_rows").over(W.partitionBy(*same).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        parts = parts.select(*[F.col(c).alias(f"{c}p") for c in same], F.col("_part").alias("_at"), F.coalesce(ahead, F.lit(0)).alias("_before"))
        at = F.col("_part") == F.col("_at")
        for c in same:
            at = at & F.col(c).eqNullSafe(F.col(f"{c}p"))
        hit, same, before = hit.join(parts, at), (*same, "_part"), F.col("_before")
    number = F.when(F.col("n") == 1, F.lit(0)).otherwise(before + F.row_number().over(W.partitionBy(*same).orderBy(F.lit(1))) - 1)
    hit = hit.withColumn("_times", F.col("epochs") + (number < F.col("extra")).cast("long")).filter("_times > 0")
    return hit.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
