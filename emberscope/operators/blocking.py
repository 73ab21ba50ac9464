"""Long tasks: runs of busy samples whose time reaches a threshold, by gaps and islands.

A sample is busy if its node is known and its category isn't idle.  The threshold is an argument of
the query, so stored results don't depend on it.  Ties go to the lesser key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.operators import tree
from emberscope.options import STACK_FRAMES, STALLS
from emberscope.sources.sinks import stored

EPISODE = ("group_id", "profile_id", "member_rank", "episode")


def samples(profiles: DataFrame) -> DataFrame:
    """One row for each sample: group_id, profile_id, member_rank, i, node_id, delta, label, fn_key, fn_display, category.

    The last three are null for a node that isn't known.
    """
    zipped = F.arrays_zip("samples", "deltas", F.coalesce("label_at", F.lit([]).cast("array<bigint>")).alias("label_at"))
    label = F.when(F.col("s.label_at") >= 0, F.get("labels", F.col("s.label_at").cast("int")))
    s = profiles.select("group_id", "profile_id", "member_rank", "labels", F.posexplode(zipped).alias("i", "s"))
    s = s.select("group_id", "profile_id", "member_rank", "i", F.col("s.samples").alias("node_id"), F.col("s.deltas").alias("delta"), label.alias("label"))
    n = profiles.select(F.col("profile_id").alias("_p"), F.explode("nodes").alias("n"))
    n = n.select("_p", F.col("n.id").alias("_n"), F.col("n.fn_key").alias("fn_key"), F.col("n.fn_display").alias("fn_display"), F.col("n.category").alias("category"))
    return s.join(n, (s.profile_id == n._p) & (s.node_id == n._n), "left").drop("_p", "_n")


def episodes(busy: DataFrame, threshold: int) -> DataFrame:
    """One row for each run that reaches the threshold: micros, samples, fn (dominant), context (dominant), leaf.

    The dominant function is the one whose running sum first reaches the largest one of all, if
    that is positive; the leaf is the first sample of the largest delta.
    """
    own = W.partitionBy(*EPISODE)
    run = F.sum("delta").over(W.partitionBy(*EPISODE, "fn_key").orderBy("i"))
    whole = busy.withColumn("micros", F.sum("delta").over(own)).filter(F.col("micros") >= threshold) if threshold > 0 else busy.withColumn("micros", F.lit(0)).filter(F.lit(False))
    rows = whole.withColumn("run", run).withColumn("by_label", F.sum("delta").over(W.partitionBy(*EPISODE, "label")))
    named = F.col("label").isNotNull() & (F.col("label") != "")
    # Largest sum, then least label: max_by over (sum, place) after a rank of labels would need a sort; min over (-sum, label) doesn't.
    best = F.min(F.when(named & (F.col("by_label") > 0), F.struct((-F.col("by_label")).alias("m"), F.col("label").alias("label"))))
    return rows.groupBy(*EPISODE).agg(
        F.sum("delta").alias("micros"), F.count("*").alias("samples"), F.bool_or(named).alias("labelled"),
        F.max_by(F.when(F.col("run") > 0, F.col("fn_key")), F.when(F.col("run") > 0, F.struct(F.col("run"), -F.col("i")))).alias("fn"),
        F.coalesce(best["label"], F.lit("")).alias("context"),
        F.max_by(F.struct(F.col("node_id").alias("leaf_node"), F.col("fn_display").alias("leaf")), F.struct(F.greatest(F.col("delta"), F.lit(-1)), -F.col("i"))).alias("l"),
    ).select(*EPISODE, "micros", "samples", "labelled", "fn", "context", "l.*")


def block_stats(busy: DataFrame, found: DataFrame, dim: str) -> DataFrame:
    """group_id, dim, key, blocked_micros, episodes, max_episode_micros of functions or contexts.

    Every key gets the time of its own samples; only the dominant one gets the episode.
    """
    key, dominant = ("fn_key", "fn") if dim == "function" else ("label", "context")
    e = found.select(*EPISODE, F.col("micros").alias("episode_micros"), F.col(dominant).alias("dominant"), "labelled")
    rows = busy.join(e, list(EPISODE))
    if dim == "context":
        rows = rows.filter((F.col("label") != "") & F.col("label").isNotNull())
    by_key = rows.groupBy(*EPISODE, F.col(key).alias("key")).agg(F.sum("delta").alias("micros"))
    shares = by_key.select("group_id", "key", "micros", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("most"))
    owners = e if dim == "function" else e.filter("labelled")
    owners = owners.filter("dominant is not null").select("group_id", F.col("dominant").alias("key"), F.lit(0).cast("bigint").alias("micros"), F.lit(1).alias("n"), F.col("episode_micros").alias("most"))
    out = shares.unionAll(owners).groupBy("group_id", "key").agg(F.sum("micros").alias("blocked_micros"), F.sum("n").alias("episodes"), F.greatest(F.max("most"), F.lit(0)).alias("max_episode_micros"))
    return out.select("group_id", F.lit(dim).alias("dim"), "key", "blocked_micros", "episodes", "max_episode_micros")


def summary(found: DataFrame, threshold: int) -> DataFrame:
    """One row for each group that has a long task."""
    return found.groupBy("group_id").agg(F.count("*").alias("episodes"), F.sum("micros").alias("blocked_micros"), F.greatest(F.max("micros"), F.lit(0)).alias("max_episode_micros")).withColumn("threshold_micros", F.lit(threshold).cast("bigint"))


def top_stalls(found: DataFrame, most: int = STALLS) -> DataFrame:
    """The longest episodes of each group with their rank; earlier ones win ties."""
    order = W.partitionBy("group_id").orderBy(F.desc("micros"), "member_rank", "profile_id", "episode")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


@dataclass
class Blocking:
    """A group's long tasks; no rows in ``summary`` means that it has none."""

    summary: DataFrame
    stats: DataFrame
    stalls: DataFrame
    profiles: DataFrame

    def of(self, group_id: str) -> Blocking:
        own = F.col("group_id") == group_id
        return Blocking(self.summary.filter(own), self.stats.filter(own), self.stalls.filter(own), self.profiles.filter(own))

    def stacks(self, most: int = STALLS) -> DataFrame:
        return tree.stacks(self.stalls.filter(F.col("rank") <= most), self.profiles, STACK_FRAMES)


def blocking(profiles: DataFrame, threshold: int) -> Blocking:
    """Long tasks of ``profiles``; their busy samples and episodes are found once and stored for the tables."""
    b = stored(tree.busy(profiles))
    found = stored(episodes(b, threshold))
    stats = block_stats(b, found, "function").unionAll(block_stats(b, found, "context"))
    return Blocking(summary(found, threshold), stats, top_stalls(found), profiles)


def view(stats: DataFrame, entity: DataFrame, dim: str, top_n: int) -> DataFrame:
    """Ranked keys of one dimension: most blocked time first, then display; 0 keeps all."""
    rows = stats.filter(F.col("dim") == dim)
    if dim == "function":
        names = entity.filter("dim = 'function'").select(F.col("group_id").alias("_g"), F.col("key").alias("_k"), "display")
        rows = rows.join(names, (rows.group_id == names._g) & (rows.key == names._k), "left").drop("_g", "_k")
        rows = rows.withColumn("display", F.coalesce("display", "key"))
    else:
        rows = rows.withColumn("display", F.col("key"))
    rows = rows.orderBy(F.desc("blocked_micros"), "display", "key")
    return rows.limit(top_n) if top_n else rows
