"""Groups side by side: one row for each entity, one cell for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.numbers import delta, delta_pct, pct, per_profile, sort_key

CELL = {
    "selfSamples": "self_samples", "totalSamples": "total_samples", "selfMicros": "self_micros", "totalMicros": "total_micros",
    "selfPct": "self_pct", "totalPct": "total_pct", "selfPctBusy": "self_pct_busy", "totalPctBusy": "total_pct_busy",
}
OVERALL_KEY, OVERALL_DISPLAY = "__overall__", "Total (all frames, per profile)"


def kept(category: Column, categories: tuple[str, ...] | None) -> Column:
    return F.lit(True) if categories is None else category.isin(*categories)


def heads(agg, categories: tuple[str, ...] | None) -> DataFrame:
    """One row for each group: whole and busy self time, profiles, and the totals of the kept categories.

    Packages part a profile, so sums over them are sums over its categories.
    """
    pkg = agg.entity.filter("dim = 'package'")
    keep = kept(F.col("category"), categories)
    by = pkg.groupBy("group_id").agg(
        F.sum(F.when(F.col("category") == "idle", F.col("self_micros")).otherwise(0)).alias("idle"),
        F.sum(F.when(keep, F.col("self_micros")).otherwise(0)).alias("kept_micros"), F.sum(F.when(keep, F.col("self_samples")).otherwise(0)).alias("kept_samples"),
    )
    whole = agg.overall.select("group_id", F.col("self_micros").alias("whole"), F.col("self_samples").alias("whole_samples"))
    out = agg.stats.join(whole, "group_id", "left").join(by, "group_id", "left").na.fill(0, ["whole", "whole_samples", "idle", "kept_micros", "kept_samples"])
    if categories is None:
        out = out.withColumn("kept_micros", F.col("whole")).withColumn("kept_samples", F.col("whole_samples"))
    return out.withColumn("busy", F.col("whole") - F.col("idle"))


def summaries(agg, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Headline numbers of each group, per profile; the idle share is of everything, whatever is kept."""
    h = heads(agg, categories)
    idle, n = pct(F.col("idle"), F.col("whole")), F.col("profile_count")
    return h.select(
        "group_id", per_profile(F.col("kept_micros"), n).alias("overall_micros"), per_profile(F.col("kept_samples"), n).alias("overall_samples"), "sample_count", "profile_count",
        per_profile(F.col("duration_us"), n).alias("duration_micros"), F.col("approximate").alias("timing_approximate"), idle.alias("idle_pct"), (100 - idle).alias("busy_pct"),
    )


def cell(h: dict[str, Column], values: dict[str, Column], busy_self: Column, busy_total: Column) -> Column:
    """The eight numbers of an entity in a group: means over profiles, and shares of sums."""
    n = h["profile_count"]
    means = [per_profile(values[c], n).alias(c) for c in ("self_samples", "total_samples", "self_micros", "total_micros")]
    return F.struct(
        *means, pct(values["self_micros"], h["whole"]).alias("self_pct"), pct(values["total_micros"], h["whole"]).alias("total_pct"),
        pct(busy_self, h["busy"]).alias("self_pct_busy"), pct(busy_total, h["busy"]).alias("total_pct_busy"),
    )


def entity_cells(agg, dim: str, categories: tuple[str, ...] | None) -> DataFrame:
    """group_id, key, display, package, cell of functions, files or packages whose category is kept in that group."""
    h = heads(agg, categories).select("group_id", "whole", "busy", "profile_count")
    rows = agg.entity.filter((F.col("dim") == dim) & kept(F.col("category"), categories)).join(h, "group_id")
    v = {c: F.col(c) for c in ("self_samples", "total_samples", "self_micros", "total_micros")}
    at = cell({c: F.col(c) for c in ("whole", "busy", "profile_count")}, v, v["self_micros"], v["total_micros"])
    return rows.select("group_id", "key", "display", "package", at.alias("cell"))


def context_cells(agg, categories: tuple[str, ...] | None) -> DataFrame:
    """The same of contexts: categories count by the packages that samples end in; busy shares leave idle ones out."""
    h = heads(agg, categories).select("group_id", "whole", "busy", "profile_count")
    pkg = agg.entity.filter("dim = 'package'").select("group_id", "key", "category")
    parts = agg.ctx_entity.filter("dim = 'package'").select("group_id", "label", "key", "self_samples", "self_micros").join(pkg, ["group_id", "key"], "left")
    category = F.coalesce("category", F.lit(""))
    keep, busy = kept(category, categories), category != "idle"
    sums = parts.groupBy("group_id", "label").agg(
        F.sum(F.when(keep, F.col("self_samples")).otherwise(0)).alias("p_samples"), F.sum(F.when(keep, F.col("self_micros")).otherwise(0)).alias("p_micros"),
        F.sum(F.when(busy, F.col("self_micros")).otherwise(0)).alias("p_busy"),
    )
    rows = agg.context.join(sums, ["group_id", "label"], "left").join(h, "group_id")
    samples, micros, net = F.coalesce("p_samples", "self_samples"), F.coalesce("p_micros", "self_micros"), F.coalesce("p_busy", "self_micros")
    if categories is not None:
        rows = rows.filter(micros != 0)
    v = {"self_samples": samples, "total_samples": samples, "self_micros": micros, "total_micros": micros}
    at = cell({c: F.col(c) for c in ("whole", "busy", "profile_count")}, v, net, net)
    return rows.select("group_id", F.col("label").alias("key"), F.col("label").alias("display"), F.lit("").alias("package"), at.alias("cell"))


def overall_cells(agg, categories: tuple[str, ...] | None) -> DataFrame:
    """One row for each group: its totals, with every share 100."""
    h = heads(agg, categories)
    n, all_of = F.col("profile_count"), [F.lit(100.0).alias(c) for c in ("self_pct", "total_pct", "self_pct_busy", "total_pct_busy")]
    s, m = per_profile(F.col("kept_samples"), n), per_profile(F.col("kept_micros"), n)
    at = F.struct(s.alias("self_samples"), s.alias("total_samples"), m.alias("self_micros"), m.alias("total_micros"), *all_of)
    return h.select("group_id", F.lit(OVERALL_KEY).alias("key"), F.lit(OVERALL_DISPLAY).alias("display"), F.lit("").alias("package"), at.alias("cell"))


def compare(agg, groups: list[str], dim: str = "function", metric: str = "selfMicros", top_n: int = 0, categories: tuple[str, ...] | None = None, sort: str = "max") -> DataFrame:
    """rank, key, display, package, cells and trend (by group, in the order of ``groups``), delta, delta_pct.

    Rows are all keys of any group, aligned by one shuffle; a group without the key has a cell of zeros.
    Labels are the first group's that has some.  0 keeps all rows.
    """
    if dim == "overall":
        long = overall_cells(agg, categories)
    elif dim == "context":
        long = context_cells(agg, categories)
    else:
        long = entity_cells(agg, dim, categories)
    places = F.broadcast(agg.stats.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], "group_id string, place int"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in CELL.values()])
    named = F.struct((F.col("display") == "").alias("empty"), "place")
    # A row has at most one cell for each asked group, so the list is as long as the request.
    rows = long.join(places, "group_id").groupBy("key").agg(F.min_by(F.struct("display", "package"), named).alias("l"), F.collect_list(F.struct("place", "cell")).alias("at"))

    def of(i: Column) -> Column:
        return F.coalesce(F.get(F.filter("at", lambda x: x["place"] == i), F.lit(0))["cell"], zero)

    rows = rows.withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(len(groups) - 1)), of))
    shown = "self_micros" if dim == "overall" else CELL[metric]
    rows = rows.withColumn("trend", F.transform("cells", lambda c: c[shown])).withColumn("_v", F.transform("cells", lambda c: c[CELL[metric]]))
    first, last = F.element_at("_v", 1), F.element_at("_v", -1)
    rows = rows.select("key", "l.*", "cells", "trend", delta(first, last).alias("delta"), delta_pct(first, last).alias("delta_pct"), sort_key(F.col("_v"), sort).alias("sort_key"))
    ranked = rows.orderBy(F.desc("sort_key"), "display", "key")
    return ranked.limit(top_n) if top_n and dim != "overall" else ranked
