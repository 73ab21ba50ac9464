"""Ball trees: balls hold their rows, subtrees are dropped, scores near 2**53 and above keep their ties."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from emberscope.llm import topk


def clustered(n, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 400, (12, dims))
    return np.floor(centres[rng.integers(0, 12, n)] + rng.normal(0, 15, (n, dims)))


def test_balls_hold_their_rows():
    v = clustered(1500)
    tree = topk.BallTree.built(np.arange(1500), v)
    tree = topk.BallTree.unpacked(*tree.packed())
    assert sorted(tree.ids.tolist()) == list(range(1500)) and (tree.v == v[tree.ids]).all()
    leaves = []
    for (left, right, a, b), ball in zip(tree.nodes, tree.balls):
        assert (np.sqrt(((tree.v[a:b] - ball[:-1]) ** 2).sum(axis=1)) <= ball[-1] * (1 + 1e-9) + 1e-9).all()
        if left < 0:
            leaves.append((a, b))
            assert b - a <= topk.LEAF
        else:
            assert (tree.nodes[left][2], tree.nodes[left][3], tree.nodes[right][3]) == (a, tree.nodes[right][2], b)
    assert sorted(leaves)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(leaves), sorted(leaves)[1:]))


def test_subtrees_are_dropped():
    v = clustered(6000)
    tree, q = topk.BallTree.built(np.arange(6000), v), v[:40]
    kth, found = np.full(40, -np.inf), [[] for _ in range(40)]
    entered = topk.search(tree, np.arange(40), q, kth, found, 20, False)
    assert entered < 0.25 * 40 * len(tree.nodes)  # of all pairs of a query and a node
    scores = q @ v.T
    for i in range(40):
        best = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:20]
        assert found[i] == [(-s, j) for s, j in best] and kth[i] == -best[-1][0]
    # The k-th scores reached here keep a shard of lesser vectors shut.
    lesser = topk.BallTree.built(np.arange(6000, 12000), np.floor(v / 20))
    alone = topk.search(lesser, np.arange(40), q, np.full(40, -np.inf), [[] for _ in range(40)], 20, False)
    assert topk.search(lesser, np.arange(40), q, kth.copy(), [[] for _ in range(40)], 20, False) < alone / 4


def test_ties_beyond_exact_floats(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    rng = random.Random(3)
    vectors = [(i, [float(rng.choice([1, 2, 3]) * 2**21 + rng.randrange(2)) for _ in range(8)]) for i in range(160)]
    vectors += [(200 + i, list(vectors[i % 3][1])) for i in range(120)]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute.top_k(vectors)
