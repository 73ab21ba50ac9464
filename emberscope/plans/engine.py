"""Questions about stored and uploaded profiles.

``browse`` and ``members`` list; ``group``, ``compare``, ``breakdown`` and ``blocking`` answer the four kinds
of questions, as DataFrames.  Members are filtered by window, then sampled, then read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions.numbers import iso_time, rounded
from emberscope.functions.objects import partial_key
from emberscope.operators import aggregate as agg
from emberscope.operators import blocking as blk
from emberscope.operators import breakdown as brk
from emberscope.operators import matrix, tree
from emberscope.options import UPLOAD_ENV, CompareOptions, Config, GroupId, NotFound, Window
from emberscope.sources import profiles as src
from emberscope.sources import store
from emberscope.sources.sinks import PartialStore, stored


@dataclass
class Comparison:
    """Groups in the order asked for, their headline numbers, and the ranked rows."""

    groups: list[str]
    summaries: DataFrame
    rows: DataFrame

    def rounded(self) -> tuple[DataFrame, DataFrame]:
        """The tools' form: cells to two digits without trends, times as text."""
        s = self.summaries.withColumns({c: rounded(F.col(c), 1) for c in ("overall_micros", "overall_samples", "duration_micros")})
        s = s.withColumns({c: rounded(F.col(c), 2) for c in ("idle_pct", "busy_pct")}).withColumns({c: iso_time(F.col(c)) for c in ("first_ts", "last_ts")})
        two = lambda c: F.struct(*[rounded(c[n], 2).alias(n) for n in matrix.CELL.values()])
        r = self.rows.withColumn("cells", F.transform("cells", two)).withColumn("delta", rounded(F.col("delta"), 2)).withColumn("delta_pct", rounded(F.col("delta_pct"), 2))
        return s, r.drop("trend")


class Engine:
    """``base`` and ``root`` say where objects are; without ``base`` there are only uploads.

    With ``partials``, a folder, an object is parsed and walked the first time that it is asked for, and its sums come from there later.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, root: str = "", config: Config | None = None, partials: str | None = None):
        self.spark, self.config = spark, config or Config()
        self.partials = PartialStore(spark, partials) if partials else None
        self.objects = store.ObjectStore(spark, base, root) if base else None
        self.uploads = store.UploadStore(spark)

    def store_of(self, env: str):
        if env == UPLOAD_ENV:
            return self.uploads
        if self.objects is None:
            raise NotFound("no object store is set up")
        return self.objects

    def browse(self, env: str = "", service: str = "", date: str = "", uploads: bool = True) -> tuple[str, DataFrame]:
        """The next level below the given fields; ``upload`` is an environment once something is uploaded."""
        if env == UPLOAD_ENV:
            return "build_tag", store.groups(self.uploads.members("", service, date))
        level = store.level_below(env, service, date)
        if self.objects is None:
            level, found = "env", self.spark.createDataFrame([], "name string")
        elif level != "build_tag":
            names = self.objects.children(env, service, date)
            found = self.spark.createDataFrame([(n,) for n in names], "name string").orderBy("name")
        else:
            level, found = store.browse(self.objects.members(env, service, date), env, service, date)
        if not env and uploads and self.uploads.rows:
            found = found.unionByName(self.spark.createDataFrame([(UPLOAD_ENV,)], "name string")).distinct().orderBy("name")
        return level, found

    def members(self, gid: GroupId) -> DataFrame:
        return self.store_of(gid.env).members(gid.env, gid.service, gid.date, gid.build_tag).orderBy("raw")

    def resolve(self, gid: GroupId) -> GroupId:
        """The newest build where ``latest`` is asked for."""
        own = self.store_of(gid.env)
        return store.resolve(own.members(gid.env, gid.service), gid)

    def planned(self, gid: GroupId, window: Window | None = None) -> DataFrame:
        """The members to read: those in the window, sampled, with their number before sampling."""
        all_of = self.store_of(gid.env).members(gid.env, gid.service, gid.date, gid.build_tag)
        if all_of.isEmpty():
            raise NotFound(f"group {str(gid)!r} has no profiles")
        inside = all_of.filter(store.in_window(window or Window()))
        if inside.isEmpty():
            raise NotFound(f"group {str(gid)!r} has no profiles in the requested time window")
        return store.sampled(inside, self.config.sample_size)

    def members_of(self, gids: list[GroupId], window: Window | None = None) -> tuple[list[DataFrame], DataFrame]:
        """The members to read of each group, and of all of them."""
        plans = [self.planned(gid, window).drop("content") for gid in dict.fromkeys(gids)]
        out = plans[0]
        for m in plans[1:]:
            out = out.unionByName(m)
        return plans, out

    def profiles(self, gids: list[GroupId], plans: list[DataFrame], but: DataFrame | None = None) -> DataFrame:
        """Profiles of the planned members of several groups, read from their stores; without those in ``but`` (raw)."""
        objects = None
        for gid, m in zip(dict.fromkeys(gids), plans):
            m = m if but is None else m.join(but, "raw", "left_anti")
            part = self.store_of(gid.env).contents(m).select("group_id", F.col("raw").alias("profile_id"), "member_rank", F.col("size").alias("size"), "content")
            objects = part if objects is None else objects.unionByName(part)
        return src.profiles(objects)

    def aggregation(self, gids: list[GroupId], window: Window | None = None) -> tuple[agg.Aggregation, DataFrame]:
        plans, members = self.members_of(gids, window)
        threshold = self.config.block_threshold_micros
        blocking = lambda: blk.blocking(self.profiles(gids, plans), threshold)
        if self.partials is None:
            found = self.profiles(gids, plans)
            return agg.Aggregation(stored(agg.condensed(tree.node_costs(found))), src.stats(found), blocking), members
        key = lambda raw: partial_key(F.col(raw), F.col("size"), threshold)
        wanted = members.select("group_id", "member_rank", F.col("raw").alias("profile_id"), key("raw").alias("object_key"))
        known = wanted.join(self.partials.keys(), "object_key").select(F.col("profile_id").alias("raw"))
        new = self.profiles(gids, plans, stored(known)).withColumn("object_key", key("profile_id"))
        if not new.isEmpty():
            own = ("object_key", "member_rank")
            self.partials.add(agg.condensed(tree.node_costs(new, own), ("object_key",)), src.stats(new, ("object_key",)))
        # A member's rank is its place among what was asked for now, not when it was stored.
        rank = F.col("member_rank").cast("bigint")
        sums = self.partials.read("sums", wanted).withColumns({c: F.struct(rank.alias("member_rank"), F.col(f"{c}.node").alias("node")) for c in ("first_at", "last_at")})
        return agg.from_partials(sums, self.partials.read("stats", wanted), blocking), members

    def group(self, gid: GroupId) -> DataFrame:
        """A group's sums over its sampled profiles, not means."""
        a, members = self.aggregation([gid])
        total = members.groupBy("group_id").agg(F.max("total").alias("total_profiles"))
        return a.stats.join(a.overall, "group_id").join(total, "group_id")

    def compare(self, gids: list[GroupId], options: CompareOptions | None = None) -> Comparison:
        if not gids:
            raise ValueError("at least one group is required")
        o = options or CompareOptions()
        gids = [self.resolve(g) for g in gids]
        a, members = self.aggregation(gids, o.window)
        names = [str(g) for g in gids]
        span = members.groupBy("group_id").agg(F.max("total").alias("total_profiles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        summaries = matrix.summaries(a, o.categories).join(span, "group_id")
        return Comparison(names, summaries, matrix.compare(a, names, o.dimension, o.metric, o.top_n, o.categories, o.sort))

    def breakdown(self, gid: GroupId, dim: str, key: str, top_n: int = 25, stitch: bool = True, context_sort: str = "micros", categories=None, focus: str = "all") -> DataFrame:
        """One entity's drill-down; ``focus`` keeps one section of a function's."""
        a, _ = self.aggregation([self.resolve(gid)])
        rows = brk.entity(a, dim, key, top_n, stitch, context_sort, categories)
        return rows if focus == "all" else rows.filter(F.col("section") == focus)

    def blocking(self, gid: GroupId, top_n: int = 25) -> dict[str, DataFrame]:
        """Headline, ranked functions and contexts, and the worst stalls with their stacks."""
        a, members = self.aggregation([self.resolve(gid)])
        b, n = a.blocking, F.col("profile_count")
        total = members.groupBy("group_id").agg(F.max("total").alias("total_profiles"))
        head = a.stats.select("group_id", "profile_count").join(b.summary, "group_id", "left").join(total, "group_id")
        head = head.na.fill(0, ["episodes", "blocked_micros", "max_episode_micros", "threshold_micros"])
        head = head.withColumn("episodes_per_profile", F.col("episodes") / n).withColumn("blocked_micros_per_profile", F.col("blocked_micros") / n)
        stalls = b.stacks(top_n or blk.STALLS).orderBy("rank")
        return {"summary": head, "functions": blk.view(b.stats, a.entity, "function", top_n), "contexts": blk.view(b.stats, a.entity, "context", top_n), "stalls": stalls}
