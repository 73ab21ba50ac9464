"""The parts of the Jaccard join: hashing, salted regions, Voronoi homes and windows, leaves."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from emberscope.llm import jaccard_join as jj


def test_shingles_are_those_of_the_plain_version(monkeypatch):
    monkeypatch.setattr(jj, "PORTION", 40)
    monkeypatch.setattr(jj, "RUNS", 20)
    rng = random.Random(1)
    texts = [None, "", " \t\n", "A", " a ", "a b", "a b c", "É x Y\x1cz ſ K\x85", "x\x0by\x0cz\rw", "A b c a B c a b", "w " * 300, "long" * 40 + " " + "long" * 39 + "lonh", "anagram margana " * 3]
    texts += [" ".join(rng.choice("abcDE") for _ in range(rng.randrange(12))) for _ in range(60)]
    for words in (3, 5):
        found = list(jj.shingles(pa.array(texts), words))
        plain = [brute.shingles(t, words) for t in texts]
        assert [len(s) for s in found] == [len(s) for s in plain]
        for i, x in enumerate(found):
            for j in range(i):
                assert len(np.intersect1d(x, found[j])) == len(plain[i] & plain[j])


def rows_of(kinds, rows):
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def test_frequent_shingles_are_salted_and_lose_no_member(monkeypatch):
    monkeypatch.setattr(jj, "LEAF", 4)
    sets = [(i, 100, [7, 1000 + i]) for i in range(60)] + [(100 + i, 100, [9, 2000 + i // 2]) for i in range(4)]
    kinds = {"node": pa.int64(), "n": pa.int64(), "prefix": pa.list_(pa.int64())}
    out = [r for at in range(0, 64, 8) for r in next(jj.placed(iter([rows_of(kinds, sets[at : at + 8])]))).to_pylist()]
    assert {(r["key"], r["node"]) for r in out if r["node"] >= 0} == {(k, s[0]) for s in sets for k in s[2]}
    assert any(r["salt"] for r in out if r["key"] == 7) and not any(r["salt"] for r in out if r["key"] != 7)
    out.sort(key=lambda r: (r["key"], r["salt"], r["node"]))
    kinds = dict(key=pa.int64(), salt=pa.int32(), node=pa.int64(), n=pa.int64(), pos=pa.int64())
    for size in (1, 5, 1000):
        batches = [rows_of(kinds, [tuple(r.values()) for r in out[a : a + size]]) for a in range(0, len(out), size)]
        got = [r for b in jj.regions(90)(iter(batches)) for r in b.to_pylist()]
        assert {r["a"] for r in got if r["b"] is None and r["key"] == 7} == set(range(60)) and not [r for r in got if r["b"] is None and r["key"] != 7]
        pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
        assert pairs >= {(100 + i, 100 + j) for i in range(4) for j in range(i + 1, 4)} and all(a < b for a, b in pairs)


def members(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = [rng.choice(5000, 120, replace=False) for _ in range(6)]
    sets = []
    for i in range(n):
        s = set(centres[i % 6].tolist())
        for _ in range(int(rng.integers(0, 14))):
            s.discard(int(rng.choice(centres[i % 6])))
            s.add(int(rng.integers(5000, 9000)))
        sets.append(jj.mixed(np.array(sorted(s), dtype=np.uint64)))
    return sets


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_documents_share_the_home_of_one(percent):
    sets = members(90)
    sketches = [jj.sketched(s) for s in sets]
    pivots = [{"node": i, "n": len(sets[i]), "sketch": sketches[i]} for i in (0, 6, 12, 1, 7, 2, 3)]
    kinds = dict(root=pa.int64(), region=pa.int64(), own=pa.bool_(), node=pa.int64(), n=pa.int64(), pos=pa.int64(), label=pa.int64(), sketch=pa.binary(), pivots=pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])))
    out = [r for b in jj.homes(percent)(iter([rows_of(kinds, [(1, 1, True, i, len(s), 0, i, sketches[i], pivots) for i, s in enumerate(sets)])])) for r in b.to_pylist()]
    cells = {r["node"]: r["cells"] for r in out}
    linked, apart = 0, 0
    for i in range(90):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                apart += cells[i][0] != cells[j][0]
                assert cells[i][0] in cells[j] and cells[j][0] in cells[i]
    assert linked > 50 and apart > 0 and np.mean([len(c) for c in cells.values()]) < 6


def joined(pairs):
    """Labels (pairs of documents), as far as pairs connect them."""
    up = {i: i for i in range(20)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[root(a // 2)] = root(b // 2)
    return {frozenset(j for j in up if root(j) == root(i)) for i in up}


def test_leaves_give_every_pair_that_counts_allow():
    sets = members(40)
    kinds = dict(root=pa.int64(), region=pa.int64(), held=pa.bool_(), own=pa.bool_(), node=pa.int64(), n=pa.int64(), pos=pa.int64(), label=pa.int64(), sketch=pa.binary())
    rows = [(8, 1, i < 25, i % 5 > 0, i, len(s), 0, i // 2, jj.sketched(s)) for i, s in enumerate(sets)]
    want = {(j, i) for i in range(40) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - both)}
    want = {(a, b) for a, b in want if a // 2 != b // 2 and (a % 5 or b % 5) and a < 25}
    for size in (1, 7, 100):
        batches = [rows_of(kinds, rows[a : a + size]) for a in range(0, 40, size)]
        got = [(r["a"], r["b"]) for b in jj.leaves(90, False)(iter(batches)) for r in b.to_pylist()]
        tree = [(r["a"], r["b"], r["n_a"], r["n_b"]) for b in jj.leaves(90, True)(iter(batches)) for r in b.to_pylist() if r["a"] >= 0]
        assert [tuple(r.values()) for b in jj.leaves(90, True)(iter(batches)) for r in b.to_pylist() if r["a"] < 0] == [(8, -1, -1, 0, 0)]
        assert {t[:2] for t in tree} <= set(got) and len(tree) < 20 and all((n, m) == (len(sets[a]), len(sets[b])) for a, b, n, m in tree)
        assert joined([t[:2] for t in tree]) == joined(got)
        assert len(got) == len(set(got)) and set(got) >= want and all(a // 2 != b // 2 and a < 25 for a, b in got)


def test_counts_of_any_size():
    small, large = np.arange(500, dtype=np.uint64), np.full(70_000, 3, dtype=np.uint64)
    assert [len(jj.sketched(s)) // jj.SKETCH for s in (small, small[:0], np.full(300, 1, dtype=np.uint64), large)] == [1, 1, 2, 4]
    assert jj.unsketched([jj.sketched(small), jj.sketched(large)]).sum(axis=1).tolist() == [500, 70_000]
