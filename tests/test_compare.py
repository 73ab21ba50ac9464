"""Matrix and breakdowns on ready-made aggregations."""

import pytest
from pyspark.sql import functions as F

from emberscope.functions import numbers
from emberscope.operators import breakdown as brk
from emberscope.operators import matrix
from emberscope.options import NotFound

METRIC = "self_samples bigint, total_samples bigint, self_micros bigint, total_micros bigint"


class Agg:
    """Tables from short tuples."""

    def __init__(self, spark, entity=(), edge=(), context=(), fn_ctx=(), ctx_entity=(), stats=(("g", 1),)):
        def make(rows, schema):
            return spark.createDataFrame(list(rows), schema)

        # entity: group, dim, key, package, category, self, total [, display [, file]]
        full = [(g, d, k, x[0] if x else k, p, c, x[1] if len(x) > 1 else None, 0, 0, s, t) for g, d, k, p, c, s, t, *x in entity]
        self.entity = make(full, f"group_id string, dim string, key string, display string, package string, category string, file string, {METRIC}")
        self.edge = make([("g", a, b, 1, m) for a, b, m in edge], "group_id string, caller string, callee string, total_samples bigint, total_micros bigint")
        self.context = make([("g", c, 0, 0, m, m) for c, m in context], f"group_id string, label string, {METRIC}")
        self.fn_ctx = make([("g", k, c, 0, m) for k, c, m in fn_ctx], "group_id string, key string, label string, total_samples bigint, total_micros bigint")
        self.ctx_entity = make([("g", c, d, k, 0, 0, m, m) for c, d, k, m in ctx_entity], f"group_id string, label string, dim string, key string, {METRIC}")
        own = self.entity.filter("dim = 'package'").groupBy("group_id").agg(F.sum("self_micros").alias("m"))
        self.overall = own.select("group_id", F.lit(0).cast("bigint").alias("self_samples"), F.lit(0).cast("bigint").alias("total_samples"), F.col("m").alias("self_micros"), F.col("m").alias("total_micros"))
        self.stats = make([(g, 0, n, 0, False, True) for g, n in stats], "group_id string, sample_count bigint, profile_count bigint, duration_us bigint, approximate boolean, has_ctx boolean")


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_averages_and_busy_share(spark):
    a = Agg(spark, [("a", "function", "f", "app", "user", 100, 100), ("b", "function", "f", "app", "user", 30, 30)], stats=(("a", 10), ("b", 3)))
    assert rows(matrix.compare(a, ["a", "b"]))[0]["trend"] == [10, 10]
    pk = [("g", "package", "app", "app", "user", 10, 10), ("g", "package", "x", "x", "native", 30, 30), ("g", "package", "(idle)", "(idle)", "idle", 60, 60)]
    a = Agg(spark, pk)
    cell = {r["key"]: r["cells"][0] for r in rows(matrix.compare(a, ["g"], "package", "selfPctBusy"))}["app"]
    assert (cell["self_pct"], cell["self_pct_busy"]) == (10, 25)
    s = rows(matrix.summaries(a))[0]
    assert (s["idle_pct"], s["busy_pct"]) == (60, 40)
    assert rows(matrix.summaries(a, ("user",)))[0]["overall_micros"] == 10
    assert [r["key"] for r in rows(matrix.compare(a, ["g"], "package", categories=("user",)))] == ["app"]


def test_delta_sorts(spark):
    """Largest cell, largest gain and largest relative gain put other keys first; what is new has no relative gain to compare."""
    costs = {"big": (900, 860), "grown": (300, 420), "doubled": (40, 90), "new": (0, 55), "gone": (25, 0)}
    e = [(g, "function", k, "", "user", v, 0) for k, of in costs.items() for g, v in zip(("1", "2"), of) if v]
    a = Agg(spark, e, stats=(("1", 1), ("2", 1)))
    order = lambda sort: [r["key"] for r in rows(matrix.compare(a, ["1", "2"], sort=sort))]
    assert order("max") == ["big", "grown", "doubled", "new", "gone"]
    assert order("delta") == ["grown", "new", "doubled", "gone", "big"]
    assert order("deltaPct") == ["new", "doubled", "grown", "big", "gone"]
    got = {r["key"]: r for r in rows(matrix.compare(a, ["1", "2"]))}
    assert [(got[k]["delta"], got[k]["delta_pct"]) for k in ("new", "doubled", "gone")] == [(55, 0), (50, 125), (-25, -100)]
    assert got["new"]["cells"][0]["self_micros"] == 0 and len(rows(matrix.compare(a, ["1", "2"], top_n=2))) == 2


def test_context_rows_and_filter(spark):
    pk = [("g", "package", "app", "app", "user", 30, 30), ("g", "package", "n", "n", "native", 50, 50), ("g", "package", "(idle)", "(idle)", "idle", 120, 120)]
    ctx = [("/x", "package", "app", 30), ("/x", "package", "(idle)", 70), ("/idle", "package", "(idle)", 50)]
    a = Agg(spark, pk, context=[("/x", 100), ("/idle", 50)], ctx_entity=ctx)
    plain = {r["key"]: r["cells"][0] for r in rows(matrix.compare(a, ["g"], "context"))}
    assert (plain["/x"]["self_micros"], plain["/x"]["self_pct_busy"]) == (100, 37.5)
    kept = {r["key"]: r["cells"][0] for r in rows(matrix.compare(a, ["g"], "context", categories=("user", "native")))}
    assert set(kept) == {"/x"} and (kept["/x"]["self_micros"], kept["/x"]["self_pct"], kept["/x"]["self_pct_busy"]) == (30, 15, 37.5)
    one = rows(matrix.compare(a, ["g"], "overall"))[0]
    assert (one["key"], one["trend"], one["cells"][0]["self_pct"]) == ("__overall__", [200], 100)


def fns(*names):
    return [("g", "function", k, "app", "user", 0, 100, d) for k, d in names]


def callers(a, key, **options):
    return {r["key"]: (r["total_micros"], r["via_async"]) for r in rows(brk.function(a, key, **options)) if r["section"] == "callers"}


def test_stitching(spark):
    a = Agg(spark, fns(("h", "handler"), ("t", "runMicrotasks"), ("f", "target")), edge=[("h", "t", 100), ("t", "f", 100)])
    assert callers(a, "f", stitch=False) == {"t": (100, False)} and callers(a, "f") == {"h": (100, True)}
    a = Agg(spark, fns(("a", "a"), ("b", "b"), ("t", "runMicrotasks"), ("f", "f")), edge=[("a", "t", 30), ("b", "t", 10), ("t", "f", 100)])
    assert callers(a, "f") == {"a": (75, True), "b": (25, True)}
    a = Agg(spark, fns(("t", "runMicrotasks"), ("f", "f")), edge=[("t", "f", 50)])
    assert callers(a, "f") == {"t": (50, False)}
    # A climb that comes back to itself settles there.
    a = Agg(spark, fns(("t", "runMicrotasks"), ("u", "(program)"), ("f", "f")), edge=[("t", "u", 10), ("u", "t", 10), ("t", "f", 8)])
    assert callers(a, "f") == {"t": (8, True)}
    kareem = [("g", "function", "w", "kareem", "user", 0, 9, "wrap (x.js:1)"), *fns(("h", "h"), ("f", "f"))]
    assert callers(Agg(spark, kareem, edge=[("h", "w", 4), ("w", "f", 4)]), "f") == {"h": (4, True)}


def test_function_contexts(spark):
    a = Agg(spark, [("g", "function", "f", "app", "user", 0, 200)], context=[("/a", 300), ("/b", 62)], fn_ctx=[("f", "/a", 150), ("f", "/b", 50)])
    own = rows(brk.function(a, "f"))
    assert [(r["key"], r["pct_of_function"], round(r["pct_of_context"])) for r in own] == [("/a", 75, 50), ("/b", 25, 81)]
    assert [r["key"] for r in rows(brk.function(a, "f", context_sort="pctOfContext")) if r["rank"] == 1] == ["/b"]
    with pytest.raises(NotFound):
        brk.function(a, "missing")


def test_entity_breakdowns(spark):
    e = [
        ("g", "function", "f1", "app", "user", 60, 90, "f1", "a.js"), ("g", "function", "f2", "app", "user", 20, 20, "f2", "b.js"), ("g", "file", "a.js", "app", "user", 60, 90),
        ("g", "file", "b.js", "app", "user", 20, 20), ("g", "package", "app", "app", "user", 80, 100), ("g", "package", "(idle)", "(idle)", "idle", 20, 20), ("g", "file", "(native)", "(root)", "native", 20, 20),
    ]
    ctx = [("GET /x", "package", "app", 80), ("GET /x", "package", "(idle)", 20), ("GET /x", "file", "a.js", 60), ("GET /x", "file", "(native)", 20)]
    a = Agg(spark, e, context=[("GET /x", 100)], fn_ctx=[("f1", "GET /x", 90)], ctx_entity=ctx)
    got = lambda df: {(r["section"], r["key"]): (r["self_micros"], r["total_micros"], r["pct_of_context"]) for r in rows(df)}
    p = got(brk.entity(a, "package", "app"))
    assert p[("functions", "f1")] == (60, 90, 0) and p[("files", "b.js")] == (20, 20, 0) and p[("contexts", "GET /x")] == (80, 80, 80)
    assert set(got(brk.entity(a, "file", "a.js"))) == {("functions", "f1"), ("contexts", "GET /x")}
    c = got(brk.entity(a, "context", "GET /x"))
    assert c[("functions", "f1")][2] == 90 and c[("packages", "app")][2] == 80 and c[("packages", "(idle)")][2] == 20
    busy = got(brk.entity(a, "context", "GET /x", categories=("user",)))
    assert busy[("packages", "app")][2] == 100 and ("packages", "(idle)") not in busy and busy[("functions", "f1")][2] == 90


def test_rounding_is_of_the_shifted_value(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (-2.5,), (2.345,)], "v double")
    want = [round_half(v * 100) / 100 for v in (1.005, 0.285, -2.5, 2.345)]
    assert [r[0] for r in df.select(numbers.rounded(df.v, 2)).collect()] == want


def round_half(v):
    import math

    return math.copysign(math.floor(abs(v) + 0.5), v)
