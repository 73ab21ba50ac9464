"""Every operator as a query over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions import frames, objects
from emberscope.operators import aggregate as agg
from emberscope.operators import blocking as blk
from emberscope.operators import breakdown as brk
from emberscope.operators import matrix, timeline, tree
from emberscope.options import Window
from emberscope.plans import tables as t
from emberscope.sources import profiles as src
from emberscope.sources import store
from emberscope.sources.sinks import stored

GROUPS = ["g0", "g1", "g2"]
HANDLE, PURCHASE, PROGRAM = "5:10:handle", "8:3:purchase", ":1:(program)"
THRESHOLD = 100_000


def events(spark: SparkSession, d: str) -> agg.Aggregation:
    return agg.aggregate(t.event_profiles(spark, d), THRESHOLD)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return tree.node_costs(t.order_profiles(spark, d))


def _self(dim: str):
    def query(spark, d):
        return agg.entities(tree.node_costs(t.event_profiles(spark, d))).filter(F.col("dim") == dim).select("group_id", "key", "display", "package", "category", "self_samples", "self_micros")

    return query


def overall(spark, d):
    return events(spark, d).overall


def profile_stats(spark, d):
    return src.stats(t.event_profiles(spark, d)).select("group_id", "sample_count", "profile_count", "duration_us", "approximate", "has_ctx")


def inclusive_recursive(spark, d):
    return agg.entities(orders(spark, d)).select("group_id", "dim", "key", *agg.METRICS)


def merged_partials(spark, d):
    """The same per profile first, then merged."""
    parts = agg.entities(orders(spark, d), agg.PROFILE)
    return agg.merged(parts, ("dim", "key")).select("group_id", "dim", "key", *agg.METRICS)


def call_edges(spark, d):
    return agg.edges(orders(spark, d))


def contexts(spark, d):
    return events(spark, d).context


def fn_contexts(spark, d):
    return events(spark, d).fn_ctx


def ctx_entities(spark, d):
    return events(spark, d).ctx_entity.select("group_id", "label", "dim", "key", "self_samples", "self_micros")


def _episodes(spark, d):
    b = stored(tree.busy(t.event_profiles(spark, d)))
    return b, blk.episodes(b, THRESHOLD)


def episodes(spark, d):
    return _episodes(spark, d)[1].select("group_id", "profile_id", "episode", "micros", "samples", "fn", "context", "leaf")


def block_summary(spark, d):
    return blk.summary(_episodes(spark, d)[1], THRESHOLD)


def block_functions(spark, d):
    return blk.block_stats(*_episodes(spark, d), "function")


def block_contexts(spark, d):
    return blk.block_stats(*_episodes(spark, d), "context")


def top_stalls(spark, d):
    return blk.top_stalls(_episodes(spark, d)[1]).select("group_id", "rank", "profile_id", "micros", "samples", "context", "leaf")


def stall_stacks(spark, d):
    b = blk.blocking(t.event_profiles(spark, d), THRESHOLD)
    return b.stacks().select("group_id", "rank", F.array_join("stack", " > ").alias("stack"))


def flat(rows: DataFrame) -> DataFrame:
    """A matrix's rows without arrays: the trend by group."""
    return rows.select("key", "display", "package", *[F.element_at("trend", i + 1).alias(f"t{i}") for i in range(len(GROUPS))], "delta", "delta_pct", "sort_key")


def _matrix(dim: str, metric: str, sort: str = "max", categories=None, top_n: int = 0):
    def query(spark, d):
        return flat(matrix.compare(events(spark, d), GROUPS, dim, metric, top_n, categories, sort))

    return query


def summaries(spark, d):
    return matrix.summaries(events(spark, d), ("user", "node_modules"))


def derive_package(spark, d):
    u = t.urls(spark, d)
    return u.select("page_id", frames.package(u.url, u.name).alias("package"), frames.category(u.url, u.name).alias("category"), frames.function_display(u.url, F.lit(1), u.name).alias("display"))


def parse_object_key(spark, d):
    raw = t.event_listing(spark, d)
    k = objects.parse_object_key("", F.col("raw"))
    return raw.select("raw", k.alias("k")).select("raw", *[F.col(f"k.{c}").alias(c) for c in ("env", "service", "date", "build_tag", "host", "pid")], F.unix_millis("k.ts").alias("ms"))


def sample_hash(spark, d):
    return store.sampled(store.members_of(t.event_listing(spark, d)), 5).select("group_id", "raw", "total", "member_rank")


def member_signatures(spark, d):
    m = store.sampled(store.members_of(t.event_listing(spark, d)), 5)
    return m.groupBy("group_id").agg(objects.member_signature(F.collect_list(F.concat_ws(":", "raw", "size"))).alias("signature"))


def window_filter(spark, d):
    w = Window.parse("2024-01-10T00:00:00Z", "2024-01-12T12:00:00Z")
    return store.members_of(t.event_listing(spark, d)).filter(store.in_window(w)).select("raw")


def latest_build(spark, d):
    m = store.members_of(t.event_listing(spark, d))
    return store.newest(m.filter("service = 'click'")).select("group_id")


def browse_groups(spark, d):
    return store.browse(store.members_of(t.event_listing(spark, d)), "prod", "view", "2024-01-03")[1].select("group_id", "members", "size")


def browse_levels(spark, d):
    m = store.members_of(t.event_listing(spark, d))
    levels = [store.browse(m), store.browse(m, "prod"), store.browse(m, "prod", "click")]
    out = [df.select(F.lit(level).alias("level"), "name") for level, df in levels]
    return out[0].unionAll(out[1]).unionAll(out[2])


def callers(spark, d):
    return brk.callers(events(spark, d).of("g0"), HANDLE)


def callees(spark, d):
    return brk.callees(events(spark, d).of("g0"), HANDLE)


def stitched_callers(spark, d):
    """Callers of the idle frame's neighbours through a fixed set of transparent frames (see ``stitch_edges``)."""
    return brk.stitched(stitch_group(spark, d), "sink").select("key", F.round("total_micros", 3).alias("total_micros"), "hopped")


class Group:
    """The two tables that stitching reads."""

    def __init__(self, edge: DataFrame, entity: DataFrame):
        self.edge, self.entity = edge, entity


def stitch_group(spark, d) -> Group:
    """Edges from line items: suppliers call part types, part types (trampolines) call the sink."""
    li, p = t.read(spark, d, "lineitem"), t.read(spark, d, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("s"), F.concat(F.lit("t"), (F.col("p_size") % 4).cast("string")).alias("t"), F.round("l_quantity").cast("bigint").alias("q"))
    by = rows.groupBy("s", "t").agg(F.sum("q").alias("q"))
    up = by.select(F.col("s").alias("caller"), F.col("t").alias("callee"), F.col("q").alias("total_samples"), F.col("q").alias("total_micros"))
    down = by.groupBy(F.col("t").alias("caller")).agg(F.sum("q").alias("q")).select("caller", F.lit("sink").alias("callee"), F.col("q").alias("total_samples"), (F.col("q") * 2).alias("total_micros"))
    edge = up.unionAll(down).withColumn("group_id", F.lit("g"))
    names = edge.select(F.explode(F.array("caller", "callee")).alias("key")).distinct()
    display = F.when(F.col("key").isin("t0", "t1", "t2"), F.lit("runMicrotasks")).otherwise(F.col("key"))
    entity = names.select(F.lit("g").alias("group_id"), F.lit("function").alias("dim"), "key", display.alias("display"), F.lit("app:x").alias("package"), F.lit("user").alias("category"))
    return Group(edge, entity)


def _breakdown(dim: str, key: str, **options):
    def query(spark, d):
        rows = brk.entity(events(spark, d).of("g1"), dim, key, **options)
        return rows.select("section", "rank", "key", "display", "package", "total_micros", "self_micros", "via_async", "pct_of_function", "pct_of_context")

    return query


def stitched_hops(spark, d):
    """Callers of the sink through two levels of transparent frames, one of which is called back by the other level."""
    return brk.stitched(hop_group(spark, d), "sink").select("key", F.round("total_micros", 3).alias("total_micros"), "hopped")


def hop_group(spark, d) -> Group:
    """Edges from line items: suppliers call part types (t), those call trampolines (m), those the sink; m0 calls t1, a cycle."""
    li, p = t.read(spark, d, "lineitem"), t.read(spark, d, "part")
    named = lambda prefix, of, n: F.concat(F.lit(prefix), (F.col(of) % n).cast("string"))
    rows = li.join(p, li.l_partkey == p.p_partkey).select(named("s", "l_suppkey", 10).alias("s"), named("t", "p_size", 4).alias("t"), named("m", "l_linenumber", 2).alias("m"), F.round("l_quantity").cast("bigint").alias("q"))
    by = rows.groupBy("s", "t", "m").agg(F.sum("q").alias("q"))
    edge = lambda caller, callee, where="true": by.filter(where).select(F.col(caller).alias("caller"), callee.alias("callee"), F.col("q").alias("total_samples"), F.col("q").alias("total_micros"))
    edges = edge("s", F.col("t")).unionAll(edge("t", F.col("m"))).unionAll(edge("m", F.lit("sink"))).unionAll(edge("m", F.lit("t1"), "m = 'm0' AND t = 't1'"))
    edges = edges.groupBy("caller", "callee").agg(F.sum("total_samples").alias("total_samples"), F.sum("total_micros").alias("total_micros")).withColumn("group_id", F.lit("g"))
    names = edges.select(F.explode(F.array("caller", "callee")).alias("key")).distinct()
    display = F.when(F.col("key").isin("t0", "t1", "t2", "m0", "m1"), F.lit("runMicrotasks")).otherwise(F.col("key"))
    return Group(edges, names.select(F.lit("g").alias("group_id"), F.lit("function").alias("dim"), "key", display.alias("display"), F.lit("app:x").alias("package"), F.lit("user").alias("category")))


def hit_counts(spark, d):
    """Own costs of profiles without samples: hits, and their share of the profile's time."""
    p = t.order_profiles(spark, d)
    hits = F.transform("nodes", lambda n: n.withField("hits", F.size(F.filter("samples", lambda s: s == n["id"])).cast("bigint")))
    none = F.lit([]).cast("array<bigint>")
    p = p.withColumn("nodes", hits).withColumns({"samples": none, "deltas": none, "end_us": F.lit(10_000_000).cast("bigint")})
    return agg.entities(tree.node_costs(p)).filter("dim = 'function'").select("group_id", "key", "self_samples", "self_micros")


def unknown_nodes(spark, d):
    """Samples of a node that the tree doesn't have count for nothing and end a long task."""
    p = t.event_profiles(spark, d).withColumn("samples", F.transform("samples", lambda s: F.when(s == t.NODE_OF["signup"], 99).otherwise(s)))
    own = agg.entities(tree.node_costs(p)).filter("dim = 'function'").select("group_id", "key", "self_samples", "self_micros")
    return own.unionAll(tree.busy(p).groupBy("group_id").agg(F.count("*").alias("self_samples"), F.sum("delta").alias("self_micros")).select("group_id", F.lit("busy").alias("key"), "self_samples", "self_micros"))


def merged_labels(spark, d):
    """Names that entities keep when profiles' partial results are merged."""
    parts = agg.entities(tree.node_costs(t.event_profiles(spark, d)), agg.PROFILE)
    return agg.merged(parts, ("dim", "key")).select("group_id", "dim", "key", "display", "package", "category", "file")


def ranked_blocking(dim: str, top_n: int):
    def query(spark, d):
        a = events(spark, d).of("g0")
        return blk.view(a.blocking.stats, a.entity, dim, top_n).select("key", "display", "blocked_micros", "episodes", "max_episode_micros")

    return query


def asof_label(spark, d):
    e = t.read(spark, d, "events")
    s = e.select("user_id", "event_id", t.micros(e.ts).alias("at"))
    return timeline.asof(s, t.first_change(spark, d), "context", by=("user_id",)).select("event_id", "context")


def sample_clock(spark, d):
    s = blk.samples(t.event_profiles(spark, d)).withColumn("start_us", F.lit(1000).cast("bigint"))
    return timeline.clocked(s).select("profile_id", "i", F.col("at").alias("clock"))


QUERIES = {
    "self_by_function": _self("function"), "self_by_package": _self("package"), "self_by_file": _self("file"), "overall": overall, "profile_stats": profile_stats,
    "inclusive_recursive": inclusive_recursive, "merged_partials": merged_partials, "call_edges": call_edges, "contexts": contexts, "fn_contexts": fn_contexts, "ctx_entities": ctx_entities,
    "episodes": episodes, "block_summary": block_summary, "block_functions": block_functions, "block_contexts": block_contexts, "top_stalls": top_stalls, "stall_stacks": stall_stacks,
    "matrix_max": _matrix("function", "selfMicros"), "matrix_total": _matrix("function", "totalMicros"), "matrix_delta": _matrix("function", "selfMicros", "delta"),
    "matrix_delta_pct": _matrix("package", "selfPct", "deltaPct"), "matrix_busy": _matrix("function", "selfPctBusy"), "matrix_filtered": _matrix("function", "selfMicros", categories=("user",)),
    "matrix_context": _matrix("context", "selfMicros"), "matrix_context_filtered": _matrix("context", "selfPctBusy", categories=("user", "native")), "matrix_overall": _matrix("overall", "selfMicros"),
    "matrix_top": _matrix("function", "totalMicros", top_n=3), "summaries": summaries, "derive_package": derive_package, "parse_object_key": parse_object_key, "sample_hash": sample_hash,
    "member_signatures": member_signatures, "window_filter": window_filter, "latest_build": latest_build, "browse_levels": browse_levels, "browse_groups": browse_groups, "callers": callers, "callees": callees,
    "stitched_callers": stitched_callers, "function_breakdown": _breakdown("function", PURCHASE, stitch=False), "function_contexts_by_share": _breakdown("function", HANDLE, context_sort="pctOfContext", top_n=3),
    "package_breakdown": _breakdown("package", "app:src/services"), "file_breakdown": _breakdown("file", "(native)"), "context_breakdown": _breakdown("context", "GET /1"),
    "context_breakdown_filtered": _breakdown("context", "GET /1", categories=("user", "node_modules")), "asof_label": asof_label, "sample_clock": sample_clock,
    "function_breakdown_filtered": _breakdown("function", HANDLE, stitch=False, categories=("user",)), "package_breakdown_filtered": _breakdown("package", "app:src/services", categories=("native",)),
    "file_breakdown_filtered": _breakdown("file", "(native)", categories=("native",)), "stitched_hops": stitched_hops, "hit_counts": hit_counts, "unknown_nodes": unknown_nodes, "merged_labels": merged_labels,
    "blocking_functions_ranked": ranked_blocking("function", 2), "blocking_contexts_ranked": ranked_blocking("context", 3),
}
