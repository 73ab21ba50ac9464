"""From node costs to entities, edges and contexts, per profile and merged per group.

Node costs are condensed first: one row for each combination of keys that occurs.  Each table is sums over
that, so profiles are walked once for all of them; and condensed per profile (``by`` with profile_id) it can be
stored and summed up later with the same result.  Labels of a merged entity are those of its first profile by
member_rank, within a profile of its first node; a function's file is that of its last node.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.operators import blocking as blk
from emberscope.operators import tree
from emberscope.sources import profiles as src
from emberscope.sources.sinks import stored

METRICS = ("self_samples", "total_samples", "self_micros", "total_micros")
GROUP, PROFILE = ("group_id",), ("group_id", "profile_id", "member_rank")


def totals(first: Column | None = None) -> list[Column]:
    """Own sums, and sums of the subtrees of first nodes."""
    once = lambda c: F.sum(F.when(first, F.col(c)).otherwise(0)) if first is not None else F.sum(c)
    return [
        F.sum("self_samples").alias("self_samples"), once("sub_samples").alias("total_samples"),
        F.sum("self_micros").alias("self_micros"), once("sub_micros").alias("total_micros"),
    ]


NODE = ("parent_key", "fn_key", "fn_display", "file_key", "pkg_key", "category", "fn_first", "file_first", "pkg_first", "label")


def placed(costs: DataFrame) -> DataFrame:
    """``costs`` with the places of a row's first and last node: the earlier the lesser, profiles by their rank."""
    if "first_at" in costs.columns:
        return costs
    at = lambda order: F.struct(F.col("member_rank").cast("bigint").alias("member_rank"), order.alias("node"))
    return costs.withColumns({"first_at": at(F.col("dfs_order")), "last_at": at(-F.col("dfs_order"))})


def condensed(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Node costs summed by ``by`` and all keys, which every table here can be made of; sums before the shuffle."""
    metrics = ("self_samples", "self_micros", "sub_samples", "sub_micros")
    return placed(costs).groupBy(*by, *NODE).agg(*[F.sum(c).alias(c) for c in metrics], F.min("first_at").alias("first_at"), F.min("last_at").alias("last_at"))


def entities(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by``, dim, key, display, package, category, file and the four metrics of functions, files and packages.

    One pass: a node counts as its function, its file and its package.
    """
    def as_dim(dim: str, key: str, display: str, first: str, file: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), F.col(key).alias("key"), F.col(display).alias("display"), F.col(first).alias("first"), file.alias("file"))

    none = F.lit(None).cast("string")
    dims = F.array(
        as_dim("function", "fn_key", "fn_display", "fn_first", F.col("file_key")), as_dim("file", "file_key", "file_key", "file_first", none), as_dim("package", "pkg_key", "pkg_key", "pkg_first", none)
    )
    rows = placed(costs).filter("label is null").withColumn("e", F.explode(dims))
    out = rows.groupBy(*by, F.col("e.dim").alias("dim"), F.col("e.key").alias("key")).agg(
        F.min_by(F.struct(F.col("e.display").alias("display"), F.col("pkg_key").alias("package"), F.col("category").alias("category")), "first_at").alias("_l"),
        F.min_by("e.file", "last_at").alias("file"), *totals(F.col("e.first")),
    )
    return out.select(*by, "dim", "key", "_l.*", "file", *METRICS)


def edges(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by``, caller, callee, total_samples, total_micros: the callee's subtrees below the caller; calls that cost nothing stay."""
    rows = costs.filter("label is null and parent_key is not null")
    return rows.groupBy(*by, F.col("parent_key").alias("caller"), F.col("fn_key").alias("callee")).agg(F.sum("sub_samples").alias("total_samples"), F.sum("sub_micros").alias("total_micros"))


def contexts(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by``, label and the four metrics; self and total are equal."""
    own = costs.filter("label is not null and self_samples > 0").groupBy(*by, "label").agg(F.sum("self_samples").alias("self_samples"), F.sum("self_micros").alias("self_micros"))
    return own.select(*by, "label", "self_samples", F.col("self_samples").alias("total_samples"), "self_micros", F.col("self_micros").alias("total_micros"))


def function_contexts(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by``, key, label, total_samples, total_micros: inclusive costs of a function under a label."""
    rows = costs.filter("label is not null and fn_first")
    return rows.groupBy(*by, F.col("fn_key").alias("key"), "label").agg(F.sum("sub_samples").alias("total_samples"), F.sum("sub_micros").alias("total_micros"))


def context_entities(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by``, label, dim (package or file), key and metrics of the frames that samples under a label end in."""
    dims = F.array(F.struct(F.lit("package").alias("dim"), F.col("pkg_key").alias("key")), F.struct(F.lit("file").alias("dim"), F.col("file_key").alias("key")))
    rows = costs.filter("label is not null and self_samples > 0").withColumn("e", F.explode(dims))
    own = rows.groupBy(*by, "label", F.col("e.dim").alias("dim"), F.col("e.key").alias("key")).agg(F.sum("self_samples").alias("self_samples"), F.sum("self_micros").alias("self_micros"))
    return own.select(*by, "label", "dim", "key", "self_samples", F.col("self_samples").alias("total_samples"), "self_micros", F.col("self_micros").alias("total_micros"))


def overall(costs: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by`` and the metrics of all nodes; self and total are equal."""
    own = costs.filter("label is null").groupBy(*by).agg(F.sum("self_samples").alias("self_samples"), F.sum("self_micros").alias("self_micros"))
    return own.select(*by, "self_samples", F.col("self_samples").alias("total_samples"), "self_micros", F.col("self_micros").alias("total_micros"))


def merged(partials: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per-profile sums merged by group: metrics add up, labels are the first profile's."""
    labels = [c for c in ("display", "package", "category", "file") if c in partials.columns]
    sums = [c for c in (*METRICS, "sample_count", "profile_count", "duration_us") if c in partials.columns]
    flags = [c for c in ("approximate", "has_ctx") if c in partials.columns]
    out = partials.groupBy("group_id", *keys).agg(
        *[F.min_by(c, "member_rank").alias(c) for c in labels], *[F.sum(c).alias(c) for c in sums], *[F.bool_or(c).alias(c) for c in flags]
    )
    return out.select("group_id", *keys, *labels, *sums, *flags)


TABLES = {
    "entity": (entities, ("dim", "key")), "edge": (edges, ("caller", "callee")), "context": (contexts, ("label",)),
    "fn_ctx": (function_contexts, ("key", "label")), "ctx_entity": (context_entities, ("label", "dim", "key")), "overall": (overall, ()),
}


class Aggregation:
    """What is known of groups: one table for each grain, all keyed by group_id.

    ``sums``: condensed node costs.  Long tasks need samples; they are only looked for where ``blocking`` is asked for.
    """

    def __init__(self, sums: DataFrame, stats: DataFrame, blocking: Callable[[], blk.Blocking]):
        self.sums, self.stats, self._blocking = sums, stats, blocking
        for name, (table, _) in TABLES.items():
            setattr(self, name, table(sums))

    @cached_property
    def blocking(self) -> blk.Blocking:
        return self._blocking()

    def of(self, group_id: str) -> Aggregation:
        """One group's tables."""
        own = F.col("group_id") == group_id
        return Aggregation(self.sums.filter(own), self.stats.filter(own), lambda: self.blocking.of(group_id))


def partials(profiles: DataFrame) -> dict[str, DataFrame]:
    """Every table per profile, of one walk."""
    sums = stored(condensed(tree.node_costs(profiles), PROFILE))
    return {name: table(sums, PROFILE) for name, (table, _) in TABLES.items()} | {"stats": src.stats(profiles, PROFILE)}


def merged_tables(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: merged(parts[name], keys) for name, (_, keys) in TABLES.items()} | {"stats": merged(parts["stats"], ())}


def aggregate(profiles: DataFrame, threshold: int = 50_000) -> Aggregation:
    """All tables of all groups of ``profiles`` (group_id, profile_id, member_rank and a profile's columns).

    Profiles are walked once, here; the sums of that, which are small, are stored for the tables.
    """
    return Aggregation(stored(condensed(tree.node_costs(profiles))), src.stats(profiles), lambda: blk.blocking(profiles, threshold))


def from_partials(sums: DataFrame, stats: DataFrame, blocking: Callable[[], blk.Blocking]) -> Aggregation:
    """The same from stored sums and stats per profile (PROFILE and their columns)."""
    return Aggregation(stored(condensed(sums)), merged(stats, ()), blocking)
