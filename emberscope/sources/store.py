"""Listing, filtering, sampling and reading of stored profiles.

Objects are named ``{root}profiles/{env}/{service}/{date}/{build}/{ms}_{host}_{pid}.cpuprofile`` below any
folder that Spark reads.  Listings read names and sizes only; a query reads the contents of its
sampled members alone, whose paths (at most sample size * groups) are collected first, as no file
scan can be pruned by a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.functions import objects
from emberscope.options import LATEST, UPLOAD_DATE, UPLOAD_BUILD, UPLOAD_ENV, UPLOAD_SERVICE, GroupId, NotFound, Window

MEMBERS = "group_id string, env string, service string, date string, build_tag string, ts timestamp, host string, pid bigint, raw string, size bigint, path string, content string"
LEVELS = ("env", "service", "date", "build_tag")


def members_of(listing: DataFrame, root: str = "") -> DataFrame:
    """Members from (raw, size, path); names that aren't profiles are skipped."""
    k = objects.parse_object_key(root, F.col("raw"))
    m = listing.withColumn("_k", k).filter("_k is not null")
    gid = objects.group_id(*[F.col(f"_k.{c}") for c in LEVELS])
    return m.select(gid.alias("group_id"), "_k.*", "raw", "size", "path")


def matching(members: DataFrame, env: str = "", service: str = "", date: str = "", build_tag: str = "") -> DataFrame:
    """Members whose fields equal the given ones; an empty field is open."""
    for c, v in zip(LEVELS, (env, service, date, build_tag)):
        if v:
            members = members.filter(F.col(c) == v)
    return members


class ObjectStore:
    """Read-only profiles below ``base``, a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str, root: str = ""):
        self.spark, self.base, self.root = spark, base.rstrip("/"), root

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + objects.SUFFIX).load(list(paths))

    def members(self, env: str = "", service: str = "", date: str = "", build_tag: str = "") -> DataFrame:
        """Members that match; leading fields prune folders before anything is listed."""
        from pyspark.errors import AnalysisException

        prefix = objects.filter_prefix(self.root, env, service, date, build_tag)
        try:
            files = self._read(f"{self.base}/{prefix}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MEMBERS).drop("content")
        name = F.substr(F.col("path"), F.instr(F.col("path"), f"{self.base.split('://')[-1]}/") + len(self.base.split("://")[-1]) + 1)
        listing = files.select(name.alias("raw"), F.col("length").alias("size"), "path")
        return matching(members_of(listing, self.root), env, service, date, build_tag)

    def children(self, *fields: str) -> list[str]:
        """Names of the folders right below the given leading fields; nothing deeper is listed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{objects.filter_prefix(self.root, *fields)}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()) if system.exists(path) else []

    def contents(self, members: DataFrame) -> DataFrame:
        """``members`` with their content, reading their objects only."""
        rows = members.collect()
        if not rows:
            return members.withColumn("content", F.lit(None).cast("string"))
        files = self._read(*[r.path for r in rows]).select(F.col("path").alias("_path"), F.col("content").cast("string").alias("content"))
        few = F.broadcast(self.spark.createDataFrame(rows, members.schema))
        return few.join(files, few.path == files._path).drop("_path")


class UploadStore:
    """Profiles given as (name, content) pairs; they have no time and the virtual environment ``upload``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def add(self, files: list[tuple[str, str]], service: str = UPLOAD_SERVICE, date: str = UPLOAD_DATE, build_tag: str = UPLOAD_BUILD) -> GroupId:
        if not files:
            raise ValueError("upload: no files provided")
        gid = GroupId(UPLOAD_ENV, service or UPLOAD_SERVICE, date, build_tag)
        for name, content in files:
            raw = f"{gid}/{len(self.rows)}_{name}"
            self.rows.append((str(gid), gid.env, gid.service, gid.date, gid.build_tag, None, name, None, raw, len(content.encode()), None, content))
        return gid

    def members(self, env: str = "", service: str = "", date: str = "", build_tag: str = "") -> DataFrame:
        """Members that match; the environment is not looked at."""
        return matching(self.spark.createDataFrame(self.rows, MEMBERS).drop("content"), "", service, date, build_tag)

    def contents(self, members: DataFrame) -> DataFrame:
        own = self.spark.createDataFrame(self.rows, MEMBERS).select("raw", "content")
        return members.join(own, "raw")

    def has(self, gid: GroupId) -> bool:
        return any(r[0] == str(gid) for r in self.rows)


def level_below(env: str = "", service: str = "", date: str = "") -> str:
    """The first field that isn't given."""
    return next((c for c, v in zip(LEVELS, (env, service, date)) if not v), "build_tag")


def browse(members: DataFrame, env: str = "", service: str = "", date: str = "") -> tuple[str, DataFrame]:
    """The next level's name and its values; at the last level groups with counts, sizes and times."""
    level = level_below(env, service, date)
    here = matching(members, env, service, date)
    if level != "build_tag":
        return level, here.select(F.col(level).alias("name")).distinct().orderBy("name")
    return level, groups(here)


def groups(members: DataFrame) -> DataFrame:
    """One row for each group, in the order of date, build, environment, service."""
    g = members.groupBy("group_id", *LEVELS).agg(F.count("*").alias("members"), F.sum("size").alias("size"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.orderBy("date", "build_tag", "env", "service")


def in_window(window: Window, ts: Column | None = None) -> Column:
    """Whether a time lies in the window; one that is unknown counts as before all others."""
    ts = F.col("ts") if ts is None else ts
    ok = F.lit(True)
    if window.start:
        ok = ok & F.coalesce(ts >= F.lit(window.start), F.lit(False))
    if window.end:
        ok = ok & F.coalesce(ts <= F.lit(window.end), F.lit(True))
    return ok


def sampled(members: DataFrame, n: int) -> DataFrame:
    """The ``n`` members of each group with the least hashes, with member_rank and total.

    Groups of at most ``n``, and all with n <= 0, are whole and keep the order of their names.
    """
    totals = members.groupBy(F.col("group_id").alias("_g")).agg(F.count("*").alias("total"))
    m = members
    own = W.partitionBy("group_id")
    if n > 0:
        # A limit by rank alone: every task drops all but its n least before anything is shuffled.
        m = m.withColumn("_h", F.row_number().over(own.orderBy(objects.member_hash(F.col("raw")), "raw"))).filter(F.col("_h") <= n)
    m = m.join(totals, F.col("group_id") == F.col("_g")).drop("_g")
    by_name = F.row_number().over(own.orderBy("raw"))
    rank = F.when(F.col("total") <= n, by_name).otherwise(F.col("_h")) if n > 0 else by_name
    return m.withColumn("member_rank", rank).drop("_h")


def newest(members: DataFrame) -> DataFrame:
    """The group whose newest member is the newest; ties go to the later date, then build."""
    g = members.groupBy("group_id", *LEVELS).agg(F.max("ts").alias("ts"))
    at = F.struct(F.coalesce(F.col("ts").cast("double"), F.lit(float("-inf"))), "date", "build_tag")
    return g.agg(F.max_by(F.struct("group_id", *LEVELS), at).alias("g")).select("g.*")


def resolve(members: DataFrame, gid: GroupId) -> GroupId:
    """``latest`` as build is the newest group of the service, of one date if that is given."""
    if gid.build_tag != LATEST:
        return gid
    date = "" if gid.date == LATEST else gid.date
    row = newest(matching(members, gid.env, gid.service, date)).first()
    if row is None or row.env is None:
        raise NotFound(f"no builds for {gid.env}/{gid.service}")
    return GroupId(row.env, row.service, row.date, row.build_tag)
