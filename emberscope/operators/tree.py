"""The call tree of every profile, walked once where the profile lies.

A profile is one row, so this stage is narrow.  It gives each node its place, its own cost and its
subtree's, and for each dimension whether the node is the first of its key on its path from the root.
That flag makes inclusive totals plain sums: a key's total is the sum of the subtrees of the nodes
that are first of it, which counts every cost below a recursion once.  Work is linear in nodes and
samples, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("fn_key", "fn_display", "file_key", "pkg_key", "category")
FIRST = ("fn_key", "file_key", "pkg_key")
OUT = (
    "node_id bigint, dfs_order bigint, parent_key string, fn_key string, fn_display string, file_key string, pkg_key string, category string, "
    "fn_first boolean, file_first boolean, pkg_first boolean, label string, self_samples bigint, self_micros bigint, sub_samples bigint, sub_micros bigint"
)


class MalformedTree(ValueError):
    """Ids that repeat, a node with two parents, or a cycle."""


def walked(nodes: list[dict]) -> tuple[list[int], list[int]]:
    """Places of the nodes in depth-first order, and each place's parent (-1 for a root)."""
    at = {n["id"]: i for i, n in enumerate(nodes)}
    if len(at) < len(nodes):
        raise MalformedTree("node ids repeat")
    parent = [-1] * len(nodes)
    below = [[at[c] for c in n["children"] if c in at] for n in nodes]
    for i, children in enumerate(below):
        for c in children:
            if parent[c] >= 0:
                raise MalformedTree(f"node {nodes[c]['id']} has two parents")
            parent[c] = i
    order, todo = [], [i for i in reversed(range(len(nodes))) if parent[i] < 0]
    while todo:
        i = todo.pop()
        order.append(i)
        todo.extend(reversed(below[i]))
    if len(order) < len(nodes):
        raise MalformedTree("nodes form a cycle")
    return order, parent


def own_costs(p: dict) -> tuple[list[list[int]], list[dict]]:
    """Samples and microseconds of each node, and of each node by label."""
    nodes = p["nodes"]
    costs, labelled = [[0, 0] for _ in nodes], [{} for _ in nodes]
    if not p["samples"]:
        hits, duration = sum(n["hits"] for n in nodes), p["end_us"] - p["start_us"]
        for cost, n in zip(costs, nodes):
            cost[0] = n["hits"]
            if hits > 0 and duration > 0:
                whole = abs(n["hits"] * duration) // hits
                cost[1] = whole if n["hits"] >= 0 else -whole
        return costs, labelled
    at, labels, label_at = {n["id"]: i for i, n in enumerate(nodes)}, p["labels"] or [], p["label_at"]
    for k, (node, delta) in enumerate(zip(p["samples"], p["deltas"])):
        i = at.get(node)
        if i is None:
            continue
        costs[i][0] += 1
        costs[i][1] += delta
        if p["has_ctx"] and 0 <= label_at[k] < len(labels):
            own = labelled[i].setdefault(labels[label_at[k]], [0, 0])
            own[0] += 1
            own[1] += delta
    return costs, labelled


def rows_of(p: dict):
    """The output rows of one profile: one for each node (label null), one for each node and label below it."""
    nodes = p["nodes"]
    order, parent = walked(nodes)
    costs, labelled = own_costs(p)
    below, below_by = [list(c) for c in costs], [{k: list(v) for k, v in m.items()} for m in labelled]
    for i in reversed(order):
        if (up := parent[i]) >= 0:
            below[up][0] += below[i][0]
            below[up][1] += below[i][1]
            for label, (s, m) in below_by[i].items():
                own = below_by[up].setdefault(label, [0, 0])
                own[0] += s
                own[1] += m
    active, path = [{}, {}, {}], []
    for place, i in enumerate(order):
        while path and path[-1] != parent[i]:
            gone = nodes[path.pop()]
            for seen, k in zip(active, FIRST):
                seen[gone[k]] -= 1
        first = [not seen.get(nodes[i][k]) for seen, k in zip(active, FIRST)]
        for seen, k in zip(active, FIRST):
            seen[nodes[i][k]] = seen.get(nodes[i][k], 0) + 1
        path.append(i)
        head = (nodes[i]["id"], place, nodes[parent[i]]["fn_key"] if parent[i] >= 0 else None, *[nodes[i][k] for k in KEYS], *first)
        yield (*head, None, *costs[i], *below[i])
        for label, total in below_by[i].items():
            yield (*head, label, *labelled[i].get(label, (0, 0)), *total)


def node_costs(profiles: DataFrame, keep: tuple[str, ...] = ("group_id", "profile_id", "member_rank")) -> DataFrame:
    """``keep`` and a row for each node, and each node and label, of every profile."""
    needed = ("nodes", "samples", "deltas", "labels", "label_at", "has_ctx", "start_us", "end_us")
    rows = profiles.select(*keep, *needed)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    n = len(keep)

    def run(batches):
        import pyarrow as pa

        schema = None
        for batch in batches:
            for p in batch.to_pylist():
                if schema is None:
                    whole, text, flag = pa.int64(), pa.string(), pa.bool_()
                    schema = pa.schema([*[batch.schema.field(i) for i in range(n)], *[pa.field(x.split()[0], {"bigint": whole, "string": text, "boolean": flag}[x.split()[1]]) for x in OUT.split(", ")]])
                columns = list(zip(*rows_of(p)))
                own = [pa.array([p[c]] * len(columns[0]), schema.field(i).type) for i, c in enumerate(keep)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, schema.field(n + i).type) for i, c in enumerate(columns)]], schema=schema)

    return rows.mapInArrow(run, f"{kinds}, {OUT}")


BUSY = "i bigint, node_id bigint, delta bigint, label string, fn_key string, fn_display string, episode bigint"


def busy_of(p: dict):
    """The busy samples of one profile, numbered, with the number of the run that each is in.

    A sample is busy if its node is known and isn't idle; any other ends a run.
    """
    nodes, labels, label_at = {n["id"]: n for n in p["nodes"]}, p["labels"] or [], p["label_at"] or []
    episode = 0
    for i, (node, delta) in enumerate(zip(p["samples"], p["deltas"])):
        n = nodes.get(node)
        if n is None or n["category"] == "idle":
            episode += 1
            continue
        at = label_at[i] if i < len(label_at) else -1
        yield i, node, delta, labels[at] if 0 <= at < len(labels) else None, n["fn_key"], n["fn_display"], episode


def busy(profiles: DataFrame, keep: tuple[str, ...] = ("group_id", "profile_id", "member_rank")) -> DataFrame:
    """``keep`` and a row for each busy sample of every profile; samples and nodes lie in one row, so nothing is shuffled."""
    rows = profiles.select(*keep, "nodes", "samples", "deltas", "labels", "label_at")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])

    def run(batches):
        import pyarrow as pa

        types = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in BUSY.split(", ")]
        for batch in batches:
            for p in batch.to_pylist():
                columns = list(zip(*busy_of(p)))
                if columns:
                    own = [pa.array([p[c]] * len(columns[0]), batch.schema.field(i).type) for i, c in enumerate(keep)]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, types)], [*keep, *[x.split()[0] for x in BUSY.split(", ")]])

    return rows.mapInArrow(run, f"{kinds}, {BUSY}")


def stacks(stalls: DataFrame, profiles: DataFrame, frames: int) -> DataFrame:
    """``stalls`` (profile_id, leaf_node, ...) with ``stack``: displays from the root, the innermost ``frames``.

    Meant for the few stalls that are kept: each brings its profile's nodes to one row.
    """
    slim = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["children"].alias("children"), n["fn_display"].alias("fn_display")))
    rows = stalls.join(profiles.select(F.col("profile_id").alias("_p"), slim.alias("_nodes")), F.col("profile_id") == F.col("_p")).drop("_p")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_nodes")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for p in batch.select(["_nodes", "leaf_node"]).to_pylist():
                by_id = {n["id"]: n for n in p["_nodes"]}
                up = {c: n["id"] for n in p["_nodes"] for c in n["children"]}
                stack, node = [], p["leaf_node"]
                while node in by_id and len(stack) < frames:
                    stack.append(by_id[node]["fn_display"])
                    node = up.get(node)
                out.append(stack[::-1])
            rest = batch.drop_columns(["_nodes"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.list_(pa.string()))], [*rest.schema.names, "stack"])

    return rows.mapInArrow(run, f"{fields}, stack array<string>")
