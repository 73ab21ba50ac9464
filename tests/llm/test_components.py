"""Components of long and shuffled graphs against a plain search."""

import random

from emberscope.llm.components import components


def plain(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_no_order_of_ids_takes_many_rounds(spark):
    rng = random.Random(3)
    edges, base = [], 0
    for n, links in ((400, 1), (600, 3)):  # each linked to the next ones, ids shuffled
        ids = [base + i for i in range(n)]
        rng.shuffle(ids)
        edges += [(ids[i], ids[j]) for i in range(n) for j in range(i + 1, min(i + links, n - 1) + 1)]
        base += n
    ids = [base + i for i in [*range(200), *range(399, 199, -1)]]  # ids rise and then fall back
    edges += list(zip(ids, ids[1:]))
    edges += [(5_000, 4_000 + i) for i in range(50)]  # a hub that is greater than all others
    edges += [(rng.randrange(6_000, 6_300), rng.randrange(6_000, 6_300)) for _ in range(200)] + [edges[0], edges[0][::-1]]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = plain(edges)
    assert len(got) == len(want) and {r.node: r.label for r in got} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
