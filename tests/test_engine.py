"""Stored and uploaded profiles end to end."""

import datetime
import shutil
from collections import Counter

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from emberscope.functions import objects
from emberscope.operators import aggregate as agg
from emberscope.operators import tree
from emberscope.options import BadRequest, CompareOptions, Config, GroupId, NotFound, Window, clamped, parsed_top_n
from emberscope.plans.engine import Engine
from emberscope.sources import sinks, store
from emberscope.streaming import ingest


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bucket")

    def put(name, text):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("profiles/prod/api/2026-06-19/v1/1000_host_1.cpuprofile", fx.handler())
    put("profiles/prod/api/2026-06-19/v1/2000_host_a_2.cpuprofile", fx.blocked())
    put("profiles/prod/api/2026-06-20/v2/3000_host_3.cpuprofile", fx.chain())
    put("profiles/prod/api/2026-06-20/v2/notes.txt", "no profile")
    put("profiles/prod/api/2026-06-20/v2/bad.cpuprofile", "skipped by its name")
    put("profiles/prod/web/2026-06-20/v2/4000_host_4.cpuprofile", fx.chain())
    return str(folder)


V1, V2 = GroupId("prod", "api", "2026-06-19", "v1"), GroupId("prod", "api", "2026-06-20", "v2")


def names(df):
    return [r.name for r in df.collect()]


def test_browse(spark, base):
    e = Engine(spark, base)
    assert (e.browse()[0], names(e.browse()[1])) == ("env", ["prod"])
    assert names(e.browse("prod")[1]) == ["api", "web"]
    assert names(e.browse("prod", "api")[1]) == ["2026-06-19", "2026-06-20"]
    level, groups = e.browse("prod", "api", "2026-06-19")
    assert level == "build_tag" and groups.first().members == 2
    assert e.members(V2).count() == 1
    e.uploads.add([("x.cpuprofile", fx.chain())])
    assert names(e.browse()[1]) == ["prod", "upload"] and e.browse("upload")[1].first().service == "manual"


def test_group_and_compare(spark, base):
    e = Engine(spark, base)
    g = e.group(V2).first()
    assert (g.self_micros, g.profile_count, g.total_profiles) == (21, 1, 1)
    c = e.compare([V1, GroupId("prod", "api", "", "latest")], CompareOptions(sort="delta"))
    assert c.groups == [str(V1), str(V2)] and c.rows.first().key == "1:30:parse"
    s, r = c.rounded()
    assert {x.group_id: x.first_ts for x in s.collect()} == {str(V1): "1970-01-01T00:00:01Z", str(V2): "1970-01-01T00:00:03Z"} and "trend" not in r.columns
    early = Window(end=datetime.datetime(1970, 1, 1, 0, 0, 1, tzinfo=datetime.timezone.utc))
    assert e.compare([V1], CompareOptions(window=early)).summaries.first().profile_count == 1
    with pytest.raises(NotFound):
        e.compare([GroupId("prod", "api", "2026-06-19", "v9")])
    with pytest.raises(NotFound):
        e.resolve(GroupId("prod", "none", "", "latest"))


def test_breakdown_and_blocking(spark, base):
    e = Engine(spark, base)
    rows = e.breakdown(V1, "function", "1:53:fill", focus="contexts").collect()
    assert {(r.key, r.total_micros) for r in rows} == {("A", 2.5), ("B", 1.5)}
    b = e.blocking(V1)
    head = b["summary"].first()
    assert (head.episodes, head.episodes_per_profile, head.blocked_micros_per_profile) == (2, 1.0, 80500.0)
    assert [r.display for r in b["functions"].collect()] == ["crunch (/srv/src/jobs/crunch.js:21)", "pack (/srv/src/jobs/pack.js:3)"]
    assert b["stalls"].first().stack[-1] == "crunch (/srv/src/jobs/crunch.js:21)"
    none = Engine(spark, base, config=Config(block_threshold_micros=10**9)).blocking(V1)["summary"].first()
    assert (none.episodes, none.threshold_micros) == (0, 0)


def test_uploads(spark):
    e = Engine(spark)
    gid = e.uploads.add([("a.cpuprofile", fx.handler()), ("a.cpuprofile", fx.handler())], service="")
    assert e.uploads.has(gid) and e.group(gid).first().profile_count == 2
    with pytest.raises(ValueError):
        e.uploads.add([])


def test_names(spark):
    cases = {
        ("", "profiles/live/cart/2031-03-09/r77/1930000000123_box-7_311.cpuprofile"): ("box-7", 311, 1930000000123),
        ("team/", "team/profiles/live/mail/2030-11-30/nightly/1900000000000_m_1_2_8.cpuprofile"): ("m_1_2", 8, 1900000000000),
        ("t", "tprofiles/qa/cart/2031-01-31/r1/77_h_5.cpuprofile"): ("h", 5, 77),
        ("", "profiles/qa/cart/2031-01-31/r1/12__4.cpuprofile"): ("", 4, 12),
        ("", "profiles/qa/cart/2031-1-31/r1/12_h_4.cpuprofile"): None,
        ("", "profiles/qa/cart/2031-02-29/r1/12_h_4.cpuprofile"): None,
        ("", "profiles/qa/cart/2031-01-31/r1/plain.cpuprofile"): None,
        ("", "profiles/qa/cart/2031-01-31/r1/12_4.cpuprofile"): None,
        ("", "other/qa/cart/2031-01-31/r1/12_h_4.cpuprofile"): None,
        ("", "profiles/qa/cart/2031-01-31/r1/12_h_4.json"): None,
        ("", "profiles/qa/cart/2031-01-31/r1/soon_h_4.cpuprofile"): None,
        ("", "profiles/qa/cart/2031-01-31/12_h_4.cpuprofile"): None,
    }
    for (root, name), want in cases.items():
        df = spark.createDataFrame([(name,)], "raw string")
        k = df.select(objects.parse_object_key(root, df.raw).alias("k"), F.unix_millis(objects.parse_object_key(root, df.raw)["ts"]).alias("ms")).first()
        assert (k.k and (k.k.host, k.k.pid, k.ms)) == want, name
    assert objects.filter_prefix("r/", "prod", "", "2024") == "r/profiles/prod/"


def test_sampling(spark):
    m = spark.range(100).select(F.lit("g").alias("group_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("raw"))
    at = lambda n: {r.raw for r in store.sampled(m, n).collect()}
    assert len(at(0)) == len(at(100)) == 100 and len(at(30)) == 30 and at(30) < at(60) and at(30) == at(30)


def test_window(spark):
    day = lambda h: datetime.datetime(2026, 6, 1, h, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([(day(12),), (day(14),), (None,)], "ts timestamp")
    count = lambda *w: df.filter(store.in_window(Window(*w))).count()
    assert (count(None, None), count(day(13), day(15)), count(day(13), None), count(None, day(13)), count(day(14), day(14))) == (3, 1, 1, 2, 1)


def test_newest_breaks_ties_by_date_and_build(spark):
    rows = [("a/1", "e", "s", "2026-06-20", "aaa", 5), ("a/2", "e", "s", "2026-06-20", "zzz", 5), ("a/3", "e", "s", "2026-06-19", "zzzz", 5)]
    m = spark.createDataFrame(rows, "group_id string, env string, service string, date string, build_tag string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert store.newest(m).first().build_tag == "zzz"


def test_options():
    assert (clamped(0), clamped(500), clamped(7), parsed_top_n("x"), parsed_top_n("0"), parsed_top_n("-1")) == (25, 100, 7, 25, 0, 25)
    assert CompareOptions.for_tools().metric == "selfPctBusy"
    for bad in (lambda: CompareOptions(metric="x"), lambda: CompareOptions(categories=("x",)), lambda: Window.parse("2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"), lambda: Window.parse("yesterday")):
        with pytest.raises(BadRequest):
            bad()


def test_partials_are_read_instead_of_objects(spark, base, tmp_path, monkeypatch):
    plain, cached = Engine(spark, base), Engine(spark, base, partials=str(tmp_path / "kept"))
    tables = lambda e: {n: Counter(map(str, getattr(e.aggregation([V1, V2])[0], n).collect())) for n in (*agg.TABLES, "stats")}
    want = tables(plain)
    assert tables(cached) == want
    seen = []
    walk = tree.node_costs
    monkeypatch.setattr(tree, "node_costs", lambda *a: seen.append(a) or walk(*a))
    assert tables(cached) == want and not seen  # nothing is walked again
    keys = cached.partials.keys().collect()
    assert len(keys) == 3
    # A batch that is there twice, as after a rerun, counts once.
    for name in ("sums", "stats"):
        folder = tmp_path / "kept" / "v1" / name
        batch = next(folder.glob("batch=*"))
        shutil.copytree(batch, folder / "batch=zz-again")
    assert tables(cached) == want and cached.compare([V1, V2]).rows.count() == plain.compare([V1, V2]).rows.count()


def test_partial_names_depend_on_the_object(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "raw string, size long")
    key = lambda threshold: [r[0] for r in df.select(objects.partial_key(df.raw, df.size, threshold)).collect()]
    assert len({*key(50), *key(60)}) == 6 and key(50) == key(50)
    assert objects.group_prefix("r/", "live", "cart", "2031-01-31", "r1") == "r/profiles/live/cart/2031-01-31/r1/"


def test_sinks_and_stream(spark, base, tmp_path):
    e = Engine(spark, base)
    sinks.write_json(e.compare([V1]).rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() > 0
    out = str(tmp_path / "partials")
    for _ in range(2):  # a second run finds nothing new
        q = ingest.writer(ingest.arriving(spark, base), out).trigger(availableNow=True).start()
        q.awaitTermination()
    m = ingest.merged(spark, out)
    assert {r.group_id: r.profile_count for r in m["stats"].collect()} == {str(V1): 2, str(V2): 1, "prod/web/2026-06-20/v2": 1}
    assert m["entity"].filter(F.col("group_id") == str(V2)).filter("key = '1:30:parse'").first().total_micros == 21
