"""Profile-shaped views of plain tables, so that every operator can run on them.

``event_profiles``: a profile for each user and third of a month, a sample for each event.  ``order_profiles``: a
call tree region > nation > customer for each nation and run of customers, a sample for each
order.  Both bound the size of a profile, as real ones are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.sources.profiles import keyed_node

#: id, name, url, script, zero-based line, children of the tree that events are samples of.
TREE = (
    (1, "(root)", "", "", 0, (2, 6, 7)),
    (2, "handle", "/usr/src/app/src/services/handle.js", "5", 9, (3, 4)),
    (3, "click", "file:///app/node_modules/express/lib/click.js", "", 4, ()),
    (4, "view", "/usr/src/app/dist/controllers/view.js", "7", 0, (8,)),
    (8, "handle", "/usr/src/app/src/services/handle.js", "5", 9, (5,)),
    (5, "purchase", "node:internal/purchase", "8", 2, ()),
    (6, "(program)", "", "", 0, ()),
    (7, "(idle)", "", "", 0, ()),
)
NODE_OF = {"click": 3, "view": 4, "purchase": 5, "signup": 6, "error": 7}
LABELS = tuple(f"GET /{i}" for i in range(7))
CUSTOMERS = 250


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(i: Column, name: Column, url: Column, script: Column, line: Column, children: Column) -> Column:
    frame = F.struct(name.alias("functionName"), script.alias("scriptId"), url.alias("url"), line.cast("bigint").alias("lineNumber"), F.lit(0).cast("bigint").alias("columnNumber"))
    return F.struct(i.cast("bigint").alias("id"), frame.alias("callFrame"), F.lit(0).cast("bigint").alias("hitCount"), children.cast("array<bigint>").alias("children"))


def fixed_nodes() -> Column:
    nodes = [node(F.lit(i), F.lit(name), F.lit(url), F.lit(script), F.lit(line), F.array(*map(F.lit, below)) if below else F.lit([])) for i, name, url, script, line, below in TREE]
    return F.transform(F.array(*nodes), keyed_node)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def third(ts: Column) -> Column:
    return F.concat(F.lit("g"), F.least(F.floor((F.dayofmonth(ts) - 1) / 10), F.lit(2)).cast("string"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, profile_id, node, delta, label_at, ts, event_id of every event; label 7 is none."""
    e = read(spark, sf_dir, "events")
    node_of = F.create_map(*[F.lit(x) for kv in NODE_OF.items() for x in kv])
    k = F.regexp_extract(F.coalesce("props", F.lit("")), '"k": *([0-9]+)', 1).try_cast("bigint") % 8
    group = third(e.ts)
    return e.select(
        group.alias("group_id"), F.concat_ws("-", group, e.user_id.cast("string")).alias("profile_id"), "user_id", "event_id", "ts",
        F.coalesce(node_of[e.event_type], F.lit(0)).cast("bigint").alias("node"), F.round(e.value * 1000).cast("bigint").alias("delta"),
        F.when(k < 7, k).otherwise(-1).cast("bigint").alias("label_at"),
    )


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    rows = s.groupBy("group_id", "profile_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "node", "delta", "label_at"))).alias("s"))
    return rows.select(
        "group_id", "profile_id", F.col("user_id").alias("member_rank"), fixed_nodes().alias("nodes"), F.col("s.node").alias("samples"), F.col("s.delta").alias("deltas"),
        F.array(*map(F.lit, LABELS)).alias("labels"), F.col("s.label_at").alias("label_at"), F.lit(True).alias("has_ctx"),
        F.lit(0).cast("bigint").alias("start_us"), F.aggregate("s.delta", F.lit(0).cast("bigint"), lambda a, d: a + d).alias("end_us"),
    )


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys repeat along paths: a node's name is ``k`` and its id modulo three."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("delta"))
    run = F.floor(F.col("c_custkey") / CUSTOMERS).cast("bigint")
    # Orders meet their customer first, so one customer's orders are one list before lists are joined by run.
    by_customer = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "delta"))).alias("o"))
    c = c.join(by_customer, "c_custkey", "left").withColumn("run", run)
    url = F.concat(F.lit("file:///app/node_modules/"), F.lower("c_mktsegment"), F.lit("/index.js"))
    name = F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string"))
    one = F.struct("c_custkey", node(F.col("c_custkey") + 1000, name, url, F.lit("1"), F.lit(0), F.lit([])).alias("node"), F.coalesce("o", F.lit([]).cast("array<struct<o_orderkey:bigint,delta:bigint>>")).alias("o"))
    runs = c.groupBy("c_nationkey", "run").agg(F.array_sort(F.collect_list(one)).alias("c"))
    # Nations and regions are a fixed 25 and 5 rows.
    runs = runs.join(F.broadcast(n), runs.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = F.lit("/usr/src/app/src/geo/n.js")
    top = node(F.lit(1), F.concat(F.lit("k"), (F.col("r_regionkey") % 3).cast("string")), geo, F.lit("1"), F.lit(0), F.array(F.lit(2)))
    mid = node(F.lit(2), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string")), geo, F.lit("1"), F.lit(0), F.transform("c", lambda x: x["node"]["id"]))
    nodes = F.transform(F.concat(F.array(top, mid), F.transform("c", lambda x: x["node"])), keyed_node)
    flat = F.flatten(F.transform("c", lambda x: F.transform(x["o"], lambda o: F.struct(x["node"]["id"].alias("node"), o["delta"].alias("delta")))))
    rows = runs.select(F.col("r_name").alias("group_id"), F.concat_ws("-", "n_name", "run").alias("profile_id"), (F.col("n_nationkey") * 1000000 + F.col("run")).alias("member_rank"), nodes.alias("nodes"), flat.alias("s"))
    none = F.lit(None)
    return rows.select(
        "group_id", "profile_id", "member_rank", "nodes", F.col("s.node").alias("samples"), F.col("s.delta").alias("deltas"), none.cast("array<string>").alias("labels"),
        none.cast("array<bigint>").alias("label_at"), F.lit(False).alias("has_ctx"), F.lit(0).cast("bigint").alias("start_us"), F.lit(0).cast("bigint").alias("end_us"),
    )


def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, size, path): an object name for each event, some of which aren't profiles."""
    e = read(spark, sf_dir, "events")
    ms = F.floor(micros(e.ts) / 1000).cast("string")
    tail = F.when(F.col("event_id") % 11 == 0, ".txt").otherwise(".cpuprofile")
    raw = F.concat(
        F.lit("profiles/prod/"), "event_type", F.lit("/"), F.date_format(e.ts.cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit("/b"), (F.col("user_id") % 3).cast("string"), F.lit("/"),
        ms, F.lit("_host_"), (F.col("user_id") % 5).cast("string"), F.lit("_"), F.col("event_id").cast("string"), tail,
    )
    return e.select(raw.alias("raw"), (F.col("event_id") % 1000).alias("size"), raw.alias("path"))


def first_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline for each user: purchases as changes of context."""
    e = read(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.groupBy("user_id", micros(e.ts).alias("at")).agg(F.max("event_id").alias("context"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made of page URLs: (page_id, url, name) in several shapes."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("u"))
    i, path = F.col("page_id") % 8, F.regexp_replace("u", "^[a-z]+://", "")
    url = (
        F.when(i == 0, "").when(i == 1, F.concat(F.lit("node:"), path)).when(i == 2, F.concat(F.lit("file:///app/node_modules/@"), path))
        .when(i == 3, F.concat(F.lit("C:\\app\\node_modules\\"), path)).when(i == 4, F.concat(F.lit("/usr/src/app/src/"), path))
        .when(i == 5, F.concat(F.lit("/srv/dist/"), F.lit("main.js"))).when(i == 6, F.concat(F.lit("webpack://"), path)).otherwise(F.concat(F.lit("file:///"), path))
    )
    name = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "(idle)").otherwise("fn")
    return p.select("page_id", url.alias("url"), name.alias("name"))
