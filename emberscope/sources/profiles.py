"""Parsing of stored CPU profiles (V8 JSON) into one row each."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions import frames

FRAME = "functionName string, scriptId string, url string, lineNumber bigint, columnNumber bigint"
NODE = f"struct<id:bigint,callFrame:struct<{FRAME.replace(' ', ':').replace(',:', ',')}>,hitCount:bigint,children:array<bigint>>"
NODES = f"array<{NODE}>"
#: What is read of a profile; ``head``, the legacy nested tree, stays text.
JSON = (
    f"nodes {NODES}, samples array<bigint>, timeDeltas array<bigint>, startTime bigint, endTime bigint, title string, "
    "_async struct<version:bigint,labels:array<string>,samples:array<bigint>>, head string"
)


FIELDS = ("functionName", "scriptId", "url", "lineNumber", "columnNumber")


def preorder(tree: dict) -> list[tuple[dict, int]]:
    """A nested tree's nodes, parents before children, with each one's parent's place (-1 for the root)."""
    out, todo = [], [(tree, -1)]
    while todo:
        node, parent = todo.pop()
        todo += [(child, len(out)) for child in reversed(node.get("children") or [])]
        out.append((node, parent))
    return out


def flat_head(text: str | None) -> list | None:
    """The nodes of a legacy nested tree, parents before children, with ids where the tree gives none: the next after the largest so far."""
    if text is None:
        return None
    nodes = preorder(json.loads(text))
    flat, largest = [], 0
    for node, _ in nodes:
        frame = node.get("callFrame") or {}
        frame = frame if frame.get("functionName") or frame.get("url") else node
        number = node.get("id") or largest + 1
        largest = max(largest, number)
        flat.append({"id": number, "callFrame": {f: frame.get(f) for f in FIELDS}, "hitCount": node.get("hitCount") or 0, "children": []})
    for own, (_, parent) in zip(flat, nodes):
        if parent >= 0:
            flat[parent]["children"].append(own["id"])
    return flat


def head_nodes(head: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(flat_head)

    return F.pandas_udf(run, NODES)(head)


def parsed(content: Column) -> Column:
    """The profile struct of JSON text; malformed text fails the query."""
    return F.from_json(content, JSON, {"mode": "FAILFAST"})


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def keyed_node(n: Column) -> Column:
    """A node with its frame's keys; nulls of the JSON are its zero values."""
    f = n["callFrame"]
    name, script, url, line = _or(f["functionName"], ""), _or(f["scriptId"], ""), _or(f["url"], ""), _or(f["lineNumber"], 0)
    children = F.coalesce(n["children"], F.lit([]).cast("array<bigint>"))
    return F.struct(_or(n["id"], 0).alias("id"), children.alias("children"), _or(n["hitCount"], 0).alias("hits"), *frames.keys(script, url, line, name))


def profiles(objects: DataFrame, content: str = "content", legacy: bool = True) -> DataFrame:
    """One row for each profile: the other columns of ``objects`` and nodes, samples, deltas, labels, label_at, has_ctx, start_us, end_us.

    Samples and deltas are cut to the shorter of both.  A context block that is too short is dropped, one
    that is too long is cut.  A profile without nodes fails the query.  ``legacy=False`` leaves out
    the stage for nested trees, where none are stored.
    """
    keep = [c for c in objects.columns if c != content]
    p = objects.select(*keep, parsed(objects[content].cast("string")).alias("_p"))
    flat = F.coalesce("_p.nodes", F.lit([]).cast(NODES))
    if legacy:
        p = p.withColumn("_head", head_nodes(F.when(F.size(flat) == 0, F.col("_p.head"))))
        nodes = F.when(F.size(flat) == 0, F.coalesce("_head", flat)).otherwise(flat)
        from_head = F.col("_head").isNotNull()
    else:
        nodes, from_head = flat, F.lit(False)
    none = F.lit([]).cast("array<bigint>")
    samples, deltas = F.coalesce("_p.samples", none), F.coalesce("_p.timeDeltas", none)
    n = F.when(from_head, 0).otherwise(F.least(F.size(samples), F.size(deltas)))
    p = p.select(*keep, "_p", nodes.alias("_nodes"), F.slice(samples, F.lit(1), n).alias("samples"), F.slice(deltas, F.lit(1), n).alias("deltas"))
    at = F.coalesce("_p._async.samples", none)
    has_ctx = F.col("_p._async").isNotNull() & (F.size(at) >= F.size("samples"))
    checked = F.when(F.size("_nodes") == 0, F.raise_error(F.lit("profile has no nodes")).cast(NODES)).otherwise(F.col("_nodes"))
    return p.select(
        *keep, F.transform(checked, keyed_node).alias("nodes"), "samples", "deltas",
        F.when(has_ctx, F.coalesce("_p._async.labels", F.lit([]).cast("array<string>"))).alias("labels"),
        F.when(has_ctx, F.slice(at, F.lit(1), F.size("samples"))).alias("label_at"), has_ctx.alias("has_ctx"),
        F.coalesce("_p.startTime", F.lit(0)).alias("start_us"), F.coalesce("_p.endTime", F.lit(0)).alias("end_us"),
    )


def stats(profiles: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``by``, sample_count, profile_count, duration_us, approximate, has_ctx."""
    hits = F.aggregate("nodes", F.lit(0).cast("bigint"), lambda a, n: a + n["hits"])
    count = F.when(F.size("samples") > 0, F.size("samples").cast("bigint")).otherwise(hits)
    return profiles.groupBy(*by).agg(
        F.sum(count).alias("sample_count"), F.count("*").alias("profile_count"),
        F.sum(F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))).alias("duration_us"),
        F.bool_or(F.size("samples") == 0).alias("approximate"), F.bool_or("has_ctx").alias("has_ctx"),
    )
