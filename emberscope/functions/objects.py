"""Names of stored profiles: building, parsing, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT, SUFFIX = "profiles/", ".cpuprofile"
#: Results in stored partials of another version are not read.
FORMAT_VERSION = 1


def profile_prefix(root: str) -> str:
    return root + SEGMENT


def group_prefix(root: str, env: str, service: str, date: str, build_tag: str) -> str:
    return profile_prefix(root) + "/".join((env, service, date, build_tag)) + "/"


def filter_prefix(root: str, *fields: str) -> str:
    """The prefix that leading fields fix; it ends at the first empty one."""
    out = profile_prefix(root)
    for f in fields:
        if not f:
            break
        out += f + "/"
    return out


def parse_object_key(root: str, name: Column) -> Column:
    """Struct (env, service, date, build_tag, ts, host, pid) of an object's name, null if it isn't one."""
    prefix = profile_prefix(root)
    parts = F.split(F.substr(name, F.lit(len(prefix) + 1)), "/")
    file = F.get(parts, F.lit(4))
    shape = r"(?s)^([^_]*)_(.*)_([^_]*)\.cpuprofile$"
    ms, host, pid = (F.regexp_extract(file, shape, i) for i in (1, 2, 3))
    whole = "^[+-]?[0-9]+$"
    date = F.get(parts, F.lit(2))
    good = (
        name.startswith(prefix) & (F.size(parts) == 5) & file.rlike(shape) & ms.rlike(whole) & pid.rlike(whole)
        & date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()
        & ms.try_cast("bigint").isNotNull() & pid.try_cast("bigint").isNotNull()
    )
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(0)).alias("env"), F.get(parts, F.lit(1)).alias("service"), date.alias("date"), F.get(parts, F.lit(3)).alias("build_tag"),
            F.timestamp_millis(ms.try_cast("bigint")).alias("ts"), host.alias("host"), pid.try_cast("bigint").alias("pid"),
        ),
    )


def group_id(env: Column, service: Column, date: Column, build_tag: Column) -> Column:
    return F.concat_ws("/", env, service, date, build_tag)


def member_hash(raw: Column) -> Column:
    """The first eight bytes of the name's SHA-256 as hex, which sorts as the unsigned number does."""
    return F.substring(F.sha2(raw, 256), 1, 16)


def member_signature(raws_and_sizes: Column) -> Column:
    """SHA-256 over sorted ``raw:size`` strings, each ended by a zero byte."""
    return F.sha2(F.concat(F.array_join(F.array_sort(raws_and_sizes), "\x00"), F.lit("\x00")), 256)


def partial_key(raw: Column, size: Column, threshold: int) -> Column:
    """The name under which one object's partial results are kept."""
    return F.sha2(F.concat_ws(":", F.lit(FORMAT_VERSION), raw, size, F.lit(threshold)), 256)
