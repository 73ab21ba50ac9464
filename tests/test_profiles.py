"""Parsing, tree walk, aggregation and blocking on small profiles with known numbers."""

import json

import fixtures as fx
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberscope.functions import frames
from emberscope.operators import aggregate as agg
from emberscope.operators import blocking as blk
from emberscope.operators import tree
from emberscope.sources import profiles as src


def load(spark, *texts, group="g"):
    rows = [(group, f"p{i}", i, t) for i, t in enumerate(texts)]
    return src.profiles(spark.createDataFrame(rows, "group_id string, profile_id string, member_rank int, content string"))


def entity(spark, *texts, dim="function"):
    rows = agg.entities(tree.node_costs(load(spark, *texts))).filter(F.col("dim") == dim).collect()
    return {r.key: r for r in rows}


def test_packages(spark):
    cases = [
        # installed packages: plain, scoped, the innermost of nested ones, with backslashes, cut short
        ("/opt/shop/node_modules/pg/lib/client.js", "query", "pg", "node_modules"),
        ("file:///opt/shop/node_modules/@acme/log/dist/out.js", "", "@acme/log", "node_modules"),
        ("/opt/node_modules/a/node_modules/@b/c/node_modules/d/e.js", "f", "d", "node_modules"),
        ("D:\\shop\\node_modules\\tar\\pack.js", "pack", "tar", "node_modules"),
        ("/opt/shop/node_modules/", "f", "(unknown)", "node_modules"),
        # the runtime's own
        ("node:fs/promises", "open", "node:builtin", "native"),
        ("internal/timers.js", "listOnTimeout", "node:builtin", "native"),
        # no script: by name
        ("", "", "(program)", "native"),
        ("", "(idle)", "(idle)", "idle"),
        ("", "(root)", "(root)", "native"),
        ("", "Array.map", "(native)", "native"),
        # own code: by the folder after the last anchor, the anchor itself for a file in it
        ("webpack://shop/./lib/cart.js", "add", "(eval)", "user"),
        ("/opt/shop/src/cart/add.js", "add", "app:src/cart", "user"),
        ("/opt/src/old/src/new/x.js", "x", "app:src/new", "user"),
        ("/opt/shop/dist/jobs/mail.js", "send", "app:jobs", "user"),
        ("/opt/shop/dist/boot.js", "boot", "app:dist", "user"),
        ("/opt/shop/src/boot.js", "boot", "app:src", "user"),
        ("file:///data/tools/run.js", "run", "app:data", "user"),
        ("/", "x", "app:(app)", "user"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, name string, package string, category string")
    got = df.select("i", frames.package(df.url, df.name).alias("p"), frames.category(df.url, df.name).alias("c")).collect()
    assert {r.i: (r.p, r.c) for r in got} == {i: c[2:] for i, c in enumerate(cases)}


def test_chain(spark):
    e = entity(spark, fx.chain())
    assert (e["1:30:parse"].self_micros, e["1:30:parse"].total_micros) == (14, 21)
    assert (e["1:4:load"].self_micros, e["1:4:load"].total_micros) == (0, 21)
    edges = {(r.caller, r.callee): r.total_micros for r in agg.edges(tree.node_costs(load(spark, fx.chain(), fx.chain((3, 4))))).collect()}
    assert edges[("1:4:load", "1:30:parse")] == 35


def test_recursion_counts_once(spark):
    e = entity(spark, fx.recursion())
    assert (e["1:7:descend"].self_micros, e["1:7:descend"].total_micros) == (6, 15)
    rows = agg.edges(tree.node_costs(load(spark, fx.recursion()))).collect()
    assert {(r.caller, r.callee): r.total_micros for r in rows} == {(":1:(root)", "1:7:descend"): 15, ("1:7:descend", "1:7:descend"): 11, ("1:7:descend", "1:18:bottom"): 9}
    ctx = agg.function_contexts(tree.node_costs(load(spark, fx.recursion(["A"])))).filter("key = '1:7:descend'").first()
    assert (ctx.label, ctx.total_micros) == ("A", 15)


def test_contexts(spark):
    costs = tree.node_costs(load(spark, fx.handler()))
    assert {r.label: r.self_micros for r in agg.contexts(costs).collect()} == {"A": 8, "B": 3}
    by_fn = {(r.key, r.label): r.total_micros for r in agg.function_contexts(costs).collect()}
    assert (by_fn[("1:12:serve", "A")], by_fn[("1:12:serve", "B")]) == (8, 3)
    assert (by_fn[("1:53:fill", "A")], by_fn[("1:53:fill", "B")]) == (5, 3)
    files = {(r.label, r.key): r.self_micros for r in agg.context_entities(costs).filter("dim = 'file'").collect()}
    assert files == {("A", "/srv/app/web.js"): 8, ("B", "/srv/app/web.js"): 3}


def test_merge_equals_direct(spark):
    p = load(spark, fx.chain(), fx.chain((3, 4)), fx.recursion(), fx.handler())
    parts = agg.merged_tables(agg.partials(p))
    costs = tree.node_costs(p)
    for name, (table, _) in agg.TABLES.items():
        a, b = table(costs), parts[name]
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect())), name
    assert parts["stats"].first().profile_count == 4


def test_lengths_and_missing_fields(spark):
    cut = load(spark, fx.profile(fx.CHAIN, [3, 3, 4], [1, 1])).first()
    assert cut.samples == [3, 3] and cut.deltas == [1, 1]
    short = load(spark, fx.profile(fx.CHAIN, [3, 3], [1, 1], ["A"], [0])).first()
    long = load(spark, fx.profile(fx.CHAIN, [3, 3], [1, 1], ["A"], [0, 0, 0])).first()
    assert not short.has_ctx and long.has_ctx and long.label_at == [0, 0]
    bare = load(spark, json.dumps({"nodes": [{"id": 1, "callFrame": {}}], "samples": [1, 99], "timeDeltas": [5, 5]}))
    row = agg.entities(tree.node_costs(bare)).filter("dim = 'function'").first()
    assert (row.key, row.display, row.package, row.self_micros) == (":1:", "(anonymous)", "(program)", 5)
    assert src.stats(bare).first().sample_count == 2


def test_hit_counts_without_samples(spark):
    head = {"head": {"functionName": "(root)", "children": [{"callFrame": fx.frame("w"), "hitCount": 3}, {"functionName": "x", "url": "/a/src/b/c.js", "hitCount": 1}]}, "startTime": 0, "endTime": 10}
    p = load(spark, json.dumps(head))
    e = {r.key: (r.self_samples, r.self_micros) for r in agg.entities(tree.node_costs(p)).filter("dim = 'function'").collect()}
    assert e == {":1:(root)": (0, 0), "1:1:w": (3, 7), "/a/src/b/c.js:1:x": (1, 2)}
    s = src.stats(p).first()
    assert s.approximate and s.sample_count == 4 and s.duration_us == 10


@pytest.mark.parametrize("text", ['{"nodes": []}', '{"nodes": [{"id": 1, "children": [2]}, {"id": 2, "children": [1]}]}', '{"nodes": [{"id": 1}, {"id": 1}]}', "not json"])
def test_bad_profiles_fail(spark, text):
    with pytest.raises(Exception):
        agg.entities(tree.node_costs(load(spark, fx.chain(), text))).collect()


def test_blocking(spark):
    b = blk.blocking(load(spark, fx.blocked()), 50_000)
    assert b.summary.first()[1:] == (2, 161000, 91000, 50000)
    s = {(r.dim, r.key): (r.blocked_micros, r.episodes, r.max_episode_micros) for r in b.stats.collect()}
    assert s == {("function", "s1:21:crunch"): (91000, 1, 91000), ("function", "s2:3:pack"): (70000, 1, 70000), ("context", "GET /a"): (91000, 1, 91000), ("context", "GET /b"): (70000, 1, 70000)}
    worst = b.stacks().orderBy("rank").first()
    assert worst.stack == ["(root)", "crunch (/srv/src/jobs/crunch.js:21)"] and worst.context == "GET /a" and worst.samples == 1
    assert blk.blocking(load(spark, fx.blocked()), 200_000).summary.count() == 0
    assert blk.blocking(load(spark, fx.blocked()), 0).summary.count() == 0
    twice = blk.blocking(load(spark, fx.blocked(), fx.blocked()), 50_000)
    assert twice.summary.first()[1:] == (4, 322000, 91000, 50000)
    assert [r.micros for r in twice.stalls.orderBy("rank").collect()] == [91000, 91000, 70000, 70000]


# Random trees against the plain definition: walk every path.
@st.composite
def random_profile(draw):
    n = draw(st.integers(1, 12))
    parents = [None] + [draw(st.integers(0, i - 1)) for i in range(1, n)]
    names = [draw(st.sampled_from(["a", "b", "c", "(idle)"])) for _ in range(n)]
    children = [[j + 1 for j in range(n) if parents[j] == i] for i in range(n)]
    samples = draw(st.lists(st.integers(1, n + 1), max_size=20))
    deltas = [draw(st.integers(-5, 90)) for _ in samples]
    nodes = [fx.node(i + 1, names[i], children[i], hits=i, script="" if names[i] == "(idle)" else "1") for i in range(n)]
    return fx.profile(nodes, samples, deltas, ["A"], [i % 2 - 1 for i in range(len(samples))], endTime=100), parents, names, samples, deltas


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(random_profile())
def test_random_trees(spark, case):
    text, parents, names, samples, deltas = case
    n = len(parents)
    own = [[0, 0] for _ in range(n)]
    if samples:
        for s, d in zip(samples, deltas):
            if s <= n:
                own[s - 1][0] += 1
                own[s - 1][1] += d
    else:
        hits = sum(range(n))
        own = [[i, i * 100 // hits if hits else 0] for i in range(n)]
    total, edge = {}, {}
    for i in range(n):
        path, j = [], i
        while j is not None:
            path.append(names[j])
            if parents[j] is not None:
                e = edge.setdefault((names[parents[j]], names[j]), [0, 0])
                e[0] += own[i][0]
                e[1] += own[i][1]
            j = parents[j]
        for name in set(path):
            t = total.setdefault(name, [0, 0])
            t[0] += own[i][0]
            t[1] += own[i][1]
    name = lambda key: key.split(":")[-1]
    costs = tree.node_costs(load(spark, text))
    got = {name(r.key): [r.total_samples, r.total_micros] for r in agg.entities(costs).filter("dim = 'function'").collect()}
    assert got == total
    assert {(name(r.caller), name(r.callee)): [r.total_samples, r.total_micros] for r in agg.edges(costs).collect()} == edge
    # Episodes by a plain loop.
    runs, run = [], 0
    for s, d in [*zip(samples, deltas), (n + 1, 0)]:
        if s <= n and names[s - 1] != "(idle)":
            run += d
        else:
            runs += [run] if run >= 50 else []
            run = 0
    found = blk.blocking(load(spark, text), 50).summary.first()
    assert (found.episodes, found.blocked_micros) == (len(runs), sum(runs)) if runs else found is None
