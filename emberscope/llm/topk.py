"""Exact top-k by integer inner product: ball trees, branch and bound, shared k-th scores.

Vectors become integers ``floor(scale * x)``.  Candidates are dealt into shards of about ``SHARD``
vectors of one length.  A ball tree is built for each shard once, written to the shared folder and read
by every pass.  Each of its nodes, inner ones too, has a ball (centre and radius).  A query keeps the
open nodes it has met, ordered by the upper bound ``q . centre + |q| * radius`` of their inner products.
It takes the best one: an inner node gives way to its two children, a leaf is scored.  Where the best
bound is under the query's current k-th score all that is open is dropped, and whole subtrees
are never entered.  All queries of a block go through a tree together, so that those at the same node share one
matrix product.

The k-th score is shared: a first pass scores only the best leaf of each shard; the k-th best of what it
finds over all shards is where the full pass begins; and a task hands on what it has reached from one
of its shards to the next.

Queries are a stated set.  They are handled in blocks of at most ``BLOCK`` vectors, written by block, so
that what is broadcast (a block and its k-th scores) has a fixed bound.  A task holds one tree at a time
and gives k rows for each query, however many shards it has.  Nothing is skipped unless its bound proves
it useless, so results are exact; bounds get a margin for rounding, and a k-th score that a float can't
hold is lowered.  Scores are computed in float64 when ``dims * max|a| * max|b|`` is under 2**53 (then they are
exact), otherwise with Python integers.

A score beyond 64 bits is returned as null.  Vectors that are null, empty, or hold null or non-finite components take no part.  Ties go to the
smaller id.  Rows with a null id take no part.  Vectors of different lengths are only compared
with their like.  Rows that repeat an id are separate candidates, but none of them is a candidate
for a query with that id, and a query id that repeats is asked once, with the least of its vectors.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, rewritten, shared_folder, tidy

SHARD, BLOCK, LEAF, K = 8192, 8192, 64, 20
HITS = "query_id long, vec_id long, score decimal(38,0)"
PARTS = "dims int, ids binary, vectors binary, nodes binary, balls binary"


def integers(vector: Column, scale: float = 64.0) -> Column:
    """Array of doubles with whole values, null where the vector takes no part."""
    as_double = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable & (F.size(vector) > 0), as_double)


class BallTree:
    """Vectors (rows of ``v``) under nodes.

    A node is (left, right, start, end): its children's places, or -1 twice in a leaf, and its rows.
    Node 0 is the root.  A ball is a node's centre and, as the last number, its radius.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, nodes: np.ndarray, balls: np.ndarray):
        self.ids, self.v, self.nodes, self.balls = ids, v, nodes, balls

    @classmethod
    def built(cls, ids: np.ndarray, v: np.ndarray, leaf: int | None = None) -> BallTree:
        """Halves along the line between two far vectors, down to at most ``leaf`` rows."""
        leaf = leaf or LEAF
        order, nodes, balls = np.arange(len(v)), [[-1, -1, 0, len(v)]], [None]
        todo = [0]
        while todo:
            here = todo.pop()
            _, _, start, end = nodes[here]
            p = v[order[start:end]]
            centre = p.mean(axis=0)
            gaps = ((p - centre) ** 2).sum(axis=1)
            balls[here] = [*centre, math.sqrt(gaps.max())]
            if end - start > leaf:
                far = p[gaps.argmax()]
                other = p[((p - far) ** 2).sum(axis=1).argmax()]
                cut = np.argsort(p @ (other - far), kind="stable")
                order[start:end] = order[start:end][cut]
                middle = (start + end) // 2
                nodes[here][:2] = [len(nodes), len(nodes) + 1]
                todo += [len(nodes) + 1, len(nodes)]
                nodes += [[-1, -1, start, middle], [-1, -1, middle, end]]
                balls += [None, None]
        return cls(ids[order], v[order], np.array(nodes, dtype=np.int32), np.array(balls, dtype=float))

    def packed(self) -> tuple:
        return (self.v.shape[1], self.ids.astype("<i8").tobytes(), self.v.astype("<f8").tobytes(), self.nodes.astype("<i4").tobytes(), self.balls.astype("<f8").tobytes())

    @classmethod
    def unpacked(cls, dims: int, ids, v, nodes, balls) -> BallTree:
        whole = lambda b, kind, width: np.frombuffer(b, dtype=kind).reshape(-1, width)
        return cls(np.frombuffer(ids, dtype="<i8"), whole(v, "<f8", dims), whole(nodes, "<i4", 4), whole(balls, "<f8", dims + 1))

    def upper(self, q: np.ndarray, norms: np.ndarray, node: int) -> np.ndarray:
        """Upper bounds of the queries' inner products under a node."""
        at, reach = q @ self.balls[node, :-1], norms * self.balls[node, -1]
        return at + reach + 1e-9 * (np.abs(at) + reach + norms) + 1.0


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) < 2**53:
        return q @ v.T
    whole = lambda a: np.array([[int(x) for x in row] for row in a], dtype=object)
    return whole(q).dot(whole(v).T)


def lowered(score: int) -> float:
    """The score as a float that isn't above it."""
    f = float(score)
    return f if int(f) <= score else float(np.nextafter(f, -np.inf))


def search(tree: BallTree, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, found: list[list[tuple[int, int]]], k: int, first_leaf: bool) -> int:
    """Puts what this tree adds to each query's best (score, id) into ``found`` and raises ``kth``; how many nodes were entered.

    ``first_leaf``: every query ends at the first leaf that it scores.
    """
    norms = np.sqrt((q**2).sum(axis=1))
    open_ = np.full((len(q), len(tree.nodes)), -np.inf)
    open_[:, 0] = tree.upper(q, norms, 0)
    live, entered, width, turn, depth = np.arange(len(q)), 0, 1, 0, len(tree.nodes).bit_length()
    while len(live):
        bounds = open_[live]
        best = bounds.argmax(axis=1)[:, None] if width == 1 else np.argpartition(bounds, bounds.shape[1] - width, axis=1)[:, -width:]
        bound = np.take_along_axis(bounds, best, axis=1)
        going = (bound >= kth[live][:, None]) & (bound > -np.inf)
        who, best = np.repeat(live, going.sum(axis=1)), best[going]
        live = live[going.any(axis=1)]
        open_[who, best] = -np.inf
        entered += len(who)
        for node in np.unique(best):
            asked = who[best == node]
            left, right, a, b = tree.nodes[node]
            if left >= 0:
                for child in (left, right):
                    open_[asked, child] = tree.upper(q[asked], norms[asked], child)
                continue
            scores = products(q[asked], tree.v[a:b])
            reach = scores >= kth[asked][:, None]
            for one in np.flatnonzero(reach.any(axis=1)):
                i = asked[one]
                good = np.flatnonzero(reach[one])
                merged = found[i] + [(int(scores[one, g]), int(tree.ids[a + g])) for g in good if tree.ids[a + g] != query_ids[i]]
                merged.sort(key=lambda t: (-t[0], t[1]))
                found[i] = merged[:k]
                if len(found[i]) == k:
                    kth[i] = max(kth[i], lowered(found[i][-1][0]))
            if first_leaf:
                live = live[~np.isin(live, asked)]
        # What is still open after some leaves is in a tree that bounds hardly part: then more nodes are taken at once.
        turn += 1
        width = min(1 << max(0, turn - 4 * depth) // 4, len(tree.nodes))
    return entered


def planted(batches):
    """Over the Arrow batches of one shard (vec_id, v): its tree, one for each length of vector."""
    import pyarrow as pa

    by_dim: dict[int, tuple[list, list]] = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        values, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
        offsets = offsets - offsets[0]
        for n in np.unique(np.diff(offsets)):
            rows = np.flatnonzero(np.diff(offsets) == n)
            own = by_dim.setdefault(int(n), ([], []))
            own[0].append(ids[rows])
            own[1].append(values[offsets[rows][:, None] + np.arange(n)[None, :]])
    for ids, v in by_dim.values():
        dims, *rest = BallTree.built(np.concatenate(ids), np.concatenate(v)).packed()
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *[pa.array([x], pa.binary()) for x in rest]], ["dims", "ids", "vectors", "nodes", "balls"])


def shard_search(query_ids, q, floor, k: int, first_leaf: bool):
    """A function over Arrow batches of trees: each query's best of all of them."""

    def run(batches):
        import decimal

        import pyarrow as pa

        kth, found = floor.value.copy(), [[] for _ in query_ids.value]
        places: dict[int, list[int]] = {}
        for i, v in enumerate(q.value):
            places.setdefault(len(v), []).append(i)
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column("dims")[row].as_py()
                if at := places.get(dims):
                    tree = BallTree.unpacked(dims, *[batch.column(c)[row].as_buffer() for c in ("ids", "vectors", "nodes", "balls")])
                    own_kth, own = kth[at], [found[i] for i in at]
                    search(tree, query_ids.value[at], np.array([q.value[i] for i in at]), own_kth, own, k, first_leaf)
                    kth[at] = own_kth
                    for i, hits in zip(at, own):
                        found[i] = hits
        rows = [(int(query_ids.value[i]), vec, decimal.Decimal(score)) for i, hits in enumerate(found) for score, vec in hits]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product for each query row.

    Results of every block are written to the shared folder before the next one begins.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), integers(vectors[vector], scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = checkpointed(rows.filter("vec_id is not null and v is not null"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-n // SHARD))
    trees, _ = rewritten(rows.select("vec_id", "v").repartition(shards, F.xxhash64("vec_id", "v")).mapInArrow(tidy(planted), PARTS), few=False)
    blocks = max(1, -(-asked // BLOCK))
    folder = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    queries = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    # A hash deals the ids evenly: no block is much over BLOCK.
    queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(f"{folder}/queries")
    all_queries = spark.read.schema("vec_id long, v array<double>, block int").parquet(f"{folder}/queries")
    for b in range(blocks):
        mine = all_queries.filter(F.col("block") == b).orderBy("vec_id").collect()
        if not mine:
            continue
        ids = spark.sparkContext.broadcast(np.array([r.vec_id for r in mine], dtype=np.int64))
        q = spark.sparkContext.broadcast([np.array(r.v, dtype=float) for r in mine])
        zero = spark.sparkContext.broadcast(np.full(len(mine), -np.inf))
        seen = trees.mapInArrow(tidy(shard_search(ids, q, zero, k, True)), HITS)
        ranked = seen.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), k, 1).alias("s"))
        kth = {r.query_id: lowered(int(r.s[0])) for r in ranked.filter(F.size("s") > 0).collect()}
        floor = spark.sparkContext.broadcast(np.array([kth.get(i, -np.inf) for i in ids.value.tolist()]))
        hits = trees.mapInArrow(tidy(shard_search(ids, q, floor, k, False)), HITS)
        order = F.struct((-F.col("score")).alias("s"), "vec_id")
        top = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
        top = top.select("query_id", F.posexplode("top").alias("rank", "hit"))
        top.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).try_cast("long").alias("score")).write.parquet(f"{folder}/top/part={b}")
        for old in (ids, q, zero, floor):
            old.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long, part int").parquet(f"{folder}/top").drop("part")
