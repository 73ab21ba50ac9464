"""Drill-downs: who calls a function, what it calls, and what an entity consists of.

All return long tables: section, key, display, package, the metrics per profile, via_async,
pct_of_function, pct_of_context, rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.functions.frames import transparent
from emberscope.functions.numbers import pct, per_profile
from emberscope.operators.matrix import kept
from emberscope.options import STITCH_DEPTH, NotFound

COLUMNS = ("section", "key", "display", "package", "total_micros", "total_samples", "self_micros", "self_samples", "via_async", "pct_of_function", "pct_of_context")


def shaped(rows: DataFrame, section: str, profiles: Column, **columns: Column) -> DataFrame:
    """One section; metrics are sums that become means, what isn't given is zero."""
    zero = F.lit(0.0)
    metric = lambda c: per_profile(F.col(c), profiles) if c in rows.columns else zero
    given = {
        "section": F.lit(section), "key": F.col("key"), "display": F.col("display"), "package": F.coalesce(F.col("package"), F.lit("")),
        **{c: metric(c) for c in ("total_micros", "total_samples", "self_micros", "self_samples")}, "via_async": F.lit(False), "pct_of_function": zero, "pct_of_context": zero,
    }
    return rows.select(*[(columns.get(c, given[c])).alias(c) for c in COLUMNS])


def functions(agg) -> DataFrame:
    f = agg.entity.filter("dim = 'function'")
    return f.select(F.col("key").alias("_k"), F.col("display").alias("_display"), F.col("package").alias("_package"), F.col("category").alias("_category"))


def named(rows: DataFrame, agg) -> DataFrame:
    """``rows`` (key, ...) with display, package and _category of functions; an unknown key is its own display."""
    f = functions(agg)
    out = rows.join(f, rows.key == f._k, "left")
    return out.withColumn("display", F.coalesce("_display", "key")).withColumn("package", F.coalesce("_package", F.lit(""))).drop("_k", "_display", "_package")


def in_categories(rows: DataFrame, categories: tuple[str, ...] | None) -> DataFrame:
    return rows if categories is None else rows.filter(kept(F.col("_category"), categories))


def callees(agg, key: str) -> DataFrame:
    return agg.edge.filter(F.col("caller") == key).select(F.col("callee").alias("key"), "total_samples", "total_micros")


def callers(agg, key: str) -> DataFrame:
    return agg.edge.filter(F.col("callee") == key).select(F.col("caller").alias("key"), "total_samples", "total_micros")


def stitched(agg, key: str, depth: int = STITCH_DEPTH) -> DataFrame:
    """Callers of ``key`` with transparent frames replaced by their own callers, in proportion to time.

    Cost climbs from a frame while it is transparent, has inbound time, isn't on the climb already and the climb is
    shorter than ``depth``; elsewhere it settles.  Samples are split by the ratio of times.
    """
    f = functions(agg)
    edge = agg.edge.select("caller", "callee", F.col("total_samples").cast("double").alias("samples"), F.col("total_micros").cast("double").alias("micros"))
    inbound = edge.groupBy(F.col("callee").alias("node")).agg(F.sum("micros").alias("inbound"))
    opens = f.select(F.col("_k").alias("node"), transparent(F.col("_display"), F.col("_package")).alias("open")).filter("open")
    opens = opens.join(inbound, "node").filter("inbound > 0")
    up = edge.join(opens.select(F.col("node").alias("callee"), "inbound"), "callee").select("callee", F.col("caller"), (F.col("micros") / F.col("inbound")).alias("ratio"))
    # A climb is bounded by its depth and its paths, not by a number of rows.
    agg.edge.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return agg.edge.sparkSession.sql(
        f"""
        WITH RECURSIVE climb (node, micros, samples, hopped, path, depth) MAX RECURSION LEVEL {depth + 4} AS (
          SELECT caller, micros, samples, false, CAST(array() AS array<string>), 0 FROM {{edge}} WHERE callee = :key
          UNION ALL
          SELECT u.caller, c.micros * u.ratio, c.samples * u.ratio, true, array_append(c.path, c.node), c.depth + 1
          FROM climb c JOIN {{up}} u ON u.callee = c.node
          WHERE c.depth < {depth} AND NOT array_contains(c.path, c.node))
        SELECT c.node AS key, sum(c.micros) AS total_micros, sum(c.samples) AS total_samples, bool_or(c.hopped) AS hopped
        FROM climb c LEFT JOIN {{opens}} o ON o.node = c.node
        WHERE o.node IS NULL OR c.depth >= {depth} OR array_contains(c.path, c.node) GROUP BY c.node""",
        args={"key": key}, edge=edge, up=up, opens=opens,
    )


def ranked(rows: DataFrame, by: str, top_n: int) -> DataFrame:
    """``rows`` of one or more sections, each ranked downwards by ``by``, then display; 0 keeps all."""
    if by == "pct_of_context":
        order = [F.desc("pct_of_context"), F.desc("total_micros")]
    else:
        order = [F.desc(by)]
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy(*order, "display", "key")))
    return out.filter(F.col("rank") <= top_n) if top_n else out


def _profiles(agg) -> Column:
    """How many profiles the one group has."""
    row = agg.stats.select("profile_count").first()
    return F.lit(row.profile_count if row else 1)


def _entity(agg, dim: str, key: str):
    rows = agg.context.withColumn("key", F.col("label")) if dim == "context" else agg.entity.filter(F.col("dim") == dim)
    row = rows.filter(F.col("key") == key).first()
    if row is None:
        raise NotFound(f"{dim} {key!r} not found")
    return row


def function(agg, key: str, top_n: int = 25, stitch: bool = True, context_sort: str = "micros", categories: tuple[str, ...] | None = None) -> DataFrame:
    """Callers, callees and contexts of a function of one group."""
    own, n = _entity(agg, "function", key), _profiles(agg)
    down = shaped(in_categories(named(callees(agg, key), agg), categories), "callees", n)
    if stitch:
        up = in_categories(named(stitched(agg, key), agg), categories)
        up = shaped(up, "callers", n, via_async=F.col("hopped"))
    else:
        up = shaped(in_categories(named(callers(agg, key), agg), categories), "callers", n)
    total = agg.context.select(F.col("label").alias("_label"), F.col("total_micros").alias("_total"))
    ctx = agg.fn_ctx.filter(F.col("key") == key).select(F.col("label").alias("key"), "total_samples", "total_micros")
    ctx = ctx.join(total, ctx.key == total._label, "left").withColumn("display", F.col("key")).withColumn("package", F.lit(""))
    ctx = shaped(ctx, "contexts", n, pct_of_function=pct(F.col("total_micros"), F.lit(own.total_micros)), pct_of_context=F.coalesce(pct(F.col("total_micros"), F.col("_total")), F.lit(0.0)))
    edges = ranked(up.unionAll(down), "total_micros", top_n)
    return edges.unionAll(ranked(ctx, "pct_of_context" if context_sort == "pctOfContext" else "total_micros", top_n))


def members(agg, dim: str, where: Column, categories: tuple[str, ...] | None) -> DataFrame:
    return agg.entity.filter((F.col("dim") == dim) & where & kept(F.col("category"), categories))


def contexts_of(agg, dim: str, key: str, n: Column) -> DataFrame:
    """Contexts under which samples end in an entity, with the share of each that it takes."""
    total = agg.context.select(F.col("label").alias("_label"), F.col("total_micros").alias("_total"))
    rows = agg.ctx_entity.filter((F.col("dim") == dim) & (F.col("key") == key)).drop("key").withColumn("key", F.col("label"))
    rows = rows.join(total, rows.label == total._label, "left").withColumn("display", F.col("label")).withColumn("package", F.lit(""))
    return shaped(rows, "contexts", n, pct_of_context=F.coalesce(pct(F.col("self_micros"), F.col("_total")), F.lit(0.0)))


def package(agg, key: str, top_n: int = 25, categories: tuple[str, ...] | None = None) -> DataFrame:
    """A package's functions, files and contexts."""
    _entity(agg, "package", key)
    n, own = _profiles(agg), F.col("package") == key
    parts = shaped(members(agg, "function", own, categories), "functions", n).unionAll(shaped(members(agg, "file", own, categories), "files", n))
    return ranked(parts.unionAll(contexts_of(agg, "package", key, n)), "self_micros", top_n)


def file(agg, key: str, top_n: int = 25, categories: tuple[str, ...] | None = None) -> DataFrame:
    """A file's functions and contexts."""
    _entity(agg, "file", key)
    n = _profiles(agg)
    return ranked(shaped(members(agg, "function", F.col("file") == key, categories), "functions", n).unionAll(contexts_of(agg, "file", key, n)), "self_micros", top_n)


def context(agg, key: str, top_n: int = 25, categories: tuple[str, ...] | None = None) -> DataFrame:
    """A context's functions (inclusive, never filtered), packages and files (own time).

    With categories, shares of packages and of files are of what is kept, if that has any time.
    """
    own, n = _entity(agg, "context", key), _profiles(agg)
    fns = named(agg.fn_ctx.filter(F.col("label") == key).select("key", "total_samples", "total_micros"), agg)
    fns = shaped(fns, "functions", n, pct_of_context=pct(F.col("total_micros"), F.lit(own.total_micros)))
    parts = agg.ctx_entity.filter(F.col("label") == key)
    known = agg.entity.select(F.col("dim").alias("_dim"), F.col("key").alias("_key"), F.col("package").alias("_package"), F.col("category").alias("_category"))
    parts = parts.join(known, (parts.dim == known._dim) & (parts.key == known._key), "left").withColumn("display", parts.key)
    parts = parts.withColumn("package", F.when(F.col("dim") == "file", F.col("_package")).otherwise(""))
    share = pct(F.col("self_micros"), F.lit(own.total_micros))
    if categories is not None:
        parts = parts.filter(kept(F.coalesce("_category", F.lit("")), categories))
        whole = F.sum("self_micros").over(W.partitionBy("dim"))
        parts = parts.withColumn("_share", F.when(whole > 0, F.col("self_micros") / whole * 100).otherwise(share))
        share = F.col("_share")
    of = lambda dim, section: shaped(parts.filter(F.col("dim") == dim), section, n, pct_of_context=share)
    return ranked(fns, "total_micros", top_n).unionAll(ranked(of("package", "packages").unionAll(of("file", "files")), "self_micros", top_n))


def entity(agg, dim: str, key: str, top_n: int = 25, stitch: bool = True, context_sort: str = "micros", categories: tuple[str, ...] | None = None) -> DataFrame:
    """The drill-down of one entity; an unknown dimension means function."""
    if dim in ("package", "file", "context"):
        return {"package": package, "file": file, "context": context}[dim](agg, key, top_n, categories)
    return function(agg, key, top_n, stitch, context_sort, categories)
