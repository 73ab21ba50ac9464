"""Shards of nearly equal bytes by a k-d tree over document metadata.

Rows become units: equal texts are one unit, unless the group holds more than a shard's bytes, in
which case each of its rows is a unit (rows that repeat, id included, stay one).  A unit has a
coordinate in every metadata dimension.  The tree splits a node along the dimension in which its
units spread widest, at the weighted quantile that gives each side its share of the leaves
(20 : 20, ... 2 : 3), until every leaf is one shard of the target bytes.

Quantiles are exact and distributed: a coordinate is a 36-bit integer, ``GRID`` bits of the
dimension and the rest a hash of the unit, so ties have an order but for one unit in 65,536.  All nodes of a level are
searched at once by histograms of ``FAN`` bins, each step narrowing every node's interval by that
factor; what reaches the driver is at most shards * FAN sums, whatever the input.  The tree itself has
shards - 1 cuts and becomes one CASE expression.

A unit of over ``WHOLE`` of a shard would make a cut miss its quantile.  There are at most
shards / WHOLE such units in any input; they are dealt largest first to the emptiest shard, and
the tree's quantiles leave room for them.

Null texts are a group of equal texts of size 0 (plus the row's own bytes).  Null metadata counts as 0
or the empty string.  Rows that repeat are separate rows of one group.  With fewer units than shards
some shards stay empty.  Shards and slots depend on the rows alone, not on their order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, few_files

ROW_BYTES, GRID, TIES, FAN = 16, 20, 16, 4096
#: Units over this part of a shard's bytes are dealt out before the tree grows.
WHOLE = 0.02
#: Groups that hold more than this many shards' bytes are taken apart: they fit in none.
APART = 1.0
#: Rows that number their slots together.
RUN = 50_000


@dataclass
class Node:
    """Leaves ``first`` to ``first + n - 1``; a cut sends units with a coordinate under ``cut`` to the left."""

    first: int
    n: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    lo: int = 0
    hi: int = 0
    base: float = 0.0
    last: float = 0.0
    want: float = 0.0


def coordinate(value: Column, low: float, high: float, unit: Column) -> Column:
    scaled = F.when(F.lit(high > low), (value - low) / ((high - low) or 1.0)).otherwise(0.0)
    grid = F.least(F.greatest(F.floor(scaled * (1 << GRID)), F.lit(0)), F.lit((1 << GRID) - 1))
    return F.shiftleft(grid.cast("long"), TIES) + F.pmod(unit, F.lit(1 << TIES))


def ordinal(name: Column) -> Column:
    """A string's first four bytes as a number: close names are close."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "utf-8"), 1, 4)), 8, "0"), 16, 10).cast("double")


def placed(nodes: list[Node], value) -> Column:
    """CASE expression over the tree: ``value(node)`` of the node where a unit now is."""

    def at(node: Node) -> Column:
        if node.left is None:
            return value(node)
        return F.when(F.col(f"c{node.dim}") < node.cut, at(node.left)).otherwise(at(node.right))

    return at(nodes[0])


def dealt(sizes: list[tuple[str, int]], shards: int, total: int) -> tuple[dict[str, int], list[float]]:
    """The shard of each large unit, and the bytes that every shard has left for the tree."""
    loads, place = [(0, i) for i in range(shards)], {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, i = heapq.heappop(loads)
        place[name] = i
        heapq.heappush(loads, (load + n, i))
    by = {i: load for load, i in loads}
    rest, open_ = total - sum(by.values()), sorted(by.values())
    for k in range(shards, 0, -1):  # shards above the level get nothing more
        level = (rest + sum(open_[:k])) / k
        if level >= open_[k - 1]:
            break
    return place, [max(0.0, level - by[i]) for i in range(shards)]


def grow(units: DataFrame, dims: int, room: list[float]) -> Node:
    """The tree over ``units`` (c0, c1, ..., bytes), level by level; ``room``: the bytes for each leaf."""
    root = Node(0, len(room))
    level = [root]
    while level := [n for n in level if n.n > 1]:
        here = placed([root], lambda n: F.lit(n.first)).alias("node")
        stats = units.groupBy(here).agg(F.sum("bytes").alias("bytes"), *[f(f"c{d}").alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))])
        stats = {r.node: r for r in stats.collect()}
        for n in level:
            if r := stats.get(n.first):
                n.dim = max(range(dims), key=lambda d: r[f"hi{d}"] - r[f"lo{d}"])
                n.lo, n.hi = r[f"lo{n.dim}"], r[f"hi{n.dim}"] + 1
                all_room, half = sum(room[n.first : n.first + n.n]), sum(room[n.first : n.first + n.n // 2])
                n.want, n.last = r.bytes * (half / all_room if all_room else 0.5), r.bytes
        asked = [n for n in level if n.dim >= 0]
        while open_ := [n for n in asked if n.hi - n.lo > 1]:
            by = {n.first: (n.dim, n.lo, n.hi, -(-(n.hi - n.lo) // FAN)) for n in open_}

            def bins(n: Node, by=by) -> Column:
                if n.first not in by:
                    return F.lit(None).cast("long")
                dim, lo, hi, step = by[n.first]
                c = F.col(f"c{dim}")
                return F.when((c >= lo) & (c < hi), F.lit(n.first) * FAN + F.floor((c - lo) / step))

            sums: dict[int, dict[int, int]] = {}
            counted = units.groupBy(placed([root], bins).alias("bin")).agg(F.sum("bytes").alias("bytes")).filter("bin is not null")
            for r in counted.collect():
                sums.setdefault(r.bin // FAN, {})[r.bin % FAN] = r.bytes
            for n in open_:
                step, lo, ahead = by[n.first][3], n.lo, n.base
                for b in sorted(sums.get(n.first, {})):
                    n.base, n.lo = ahead, lo + b * step
                    n.last = ahead = ahead + sums[n.first][b]
                    if ahead >= n.want:
                        break
                n.hi = min(n.hi, n.lo + step)
        for n in asked:  # the unit at lo straddles the quantile: it goes where the miss is smaller
            n.cut = n.lo + 1 if abs(n.last - n.want) <= abs(n.base - n.want) else n.lo
        for n in level:
            half = n.n // 2
            n.dim = max(n.dim, 0)
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.n - half)
        level = [x for n in level for x in (n.left, n.right)]
    return root


def kd_shards(docs: DataFrame, shards: int = 40, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, size, text_crc32, shard and slot (gapless from 0 in its shard) for every row."""
    raw = F.encode(docs[text], "utf-8")
    rows = docs.select(
        *[docs[c] for c in keep],
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.sha2(raw, 256), F.lit("")).alias("_text"),
        F.coalesce(docs["doc_id"].cast("double"), F.lit(0.0)).alias("_id"),
        ordinal(docs["source"]).alias("_source"),
        ordinal(docs["lang"]).alias("_lang"),
        F.xxhash64(docs["doc_id"], docs[text]).alias("_row"),
    )
    rows = checkpointed(rows)
    t = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(c).alias(f"{k}{c}") for c in ("_id", "_source", "_lang") for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not t.n:
        empty = F.lit(None)
        return rows.select(*keep, "size", "text_crc32", empty.cast("int").alias("shard"), empty.cast("long").alias("slot"))

    def coordinates(unit: Column) -> list[Column]:
        log = F.log2(F.col("size").cast("double"))
        values = [(log, 4.0, 40.0), *[(F.col(c), t[f"lo{c}"], t[f"hi{c}"]) for c in ("_id", "_source", "_lang")]]
        return [coordinate(v, lo, hi, unit).alias(f"c{i}") for i, (v, lo, hi) in enumerate(values)]

    target = t.bytes / shards
    # At most shards / APART groups are over this limit.
    apart = rows.groupBy("_text").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > APART * target) & (F.col("n") > 1))
    apart = sorted(r._text for r in apart.select("_text").collect())
    unit = F.when(F.col("_text").isin(apart), F.concat_ws(":", "_text", "_row")).otherwise(F.col("_text"))
    rows = rows.withColumn("_unit", unit)
    units = rows.groupBy("_unit").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("size"), F.min(F.struct("_id", "_source", "_lang")).alias("m"))
    units = units.select("_unit", "n", "bytes", "size", "m.*")
    # At most shards / WHOLE units are over the first limit and as many over the second.
    big = units.filter((F.col("bytes") > WHOLE * target) | (F.col("n") > max(WHOLE * t.n / shards, 100))).select("_unit", "bytes").collect()
    place, room = dealt([(r._unit, r.bytes) for r in big], shards, t.bytes)
    known = F.broadcast(docs.sparkSession.createDataFrame(sorted(place.items()), "_big string, _place int"))
    small = units.join(known, F.col("_unit") == F.col("_big"), "left_anti")
    small = checkpointed(few_files(small.select(F.col("_unit").alias("_small"), "bytes", *coordinates(F.xxhash64("_unit")))))
    root = grow(small, 4, room)
    leaves = small.select("_small", placed([root], lambda n: F.lit(n.first)).alias("shard"))
    rows = rows.join(known, F.col("_unit") == F.col("_big"), "left")
    grouped = rows.filter("_big is null").join(leaves, F.col("_unit") == F.col("_small"))
    dealt_out = rows.filter("_big is not null").withColumn("shard", F.col("_place"))
    names = [*keep, "size", "text_crc32", "_row", "shard"]
    return slotted(grouped.select(*names).unionAll(dealt_out.select(*names)), t.n, shards).select(*keep, "size", "text_crc32", "shard", "slot")


def slotted(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` with slots: numbers run within (shard, run), and the runs' counts are summed up."""
    runs = max(1, -(-n // (shards * RUN)))
    rows = rows.withColumn("_run", F.pmod(F.col("_row"), F.lit(runs)).cast("int"))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("n"))
    order = W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select("shard", "_run", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    own = F.row_number().over(W.partitionBy("shard", "_run").orderBy("_row", "size")) - 1
    return rows.join(ahead, ["shard", "_run"]).withColumn("slot", (own + F.col("ahead")).cast("long"))
