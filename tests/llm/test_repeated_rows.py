"""Mixing rows that repeat: as one row with a count, numbered in parts."""

import random
from collections import Counter

import brute
import pytest

from emberscope.llm import mixing


def plain(rows):
    """Copies of every row, one by one in the order of the keys, repeats next to each other."""
    size = {r: len((r[1] or "").split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r]
    want = brute.targets(sizes)
    return sizes, want, size


@pytest.mark.parametrize("run", [mixing.RUN, 3])
def test_repeats(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), "en", rng.choice(["a", "b", None])) for i in range(120)]
    rows += [rows[5]] * 70 + [rows[9]] * 7 + [(None, None, None, None)] * 9 + [(None, "two words", "en", "a")] * 11 + [(7, "", "en", "b")] * 8
    # Equal in id, source and text alone: other columns may differ.
    rows += [(*rows[5][:2], "de", rows[5][3])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    sizes, want, size = plain(rows)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.sk) for r in got) == Counter((d, "s" + s if s is not None else "") for d, _, _, s in rows)
    for s in sizes:
        own = [r for r in got if r.sk == ("" if s is None else "s" + s)]
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert {r.copies for r in own if r.size} <= {want[s] // sizes[s], want[s] // sizes[s] + 1}
    again = mixing.mix(spark.createDataFrame(rows[::-1], docs.schema).repartition(2)).collect()
    assert Counter(got) == Counter(again)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id, r.sk, r.size] += r.copies
    assert Counter((r.doc_id, "" if r.source is None else "s" + r.source, len((r.text or "").split())) for r in out.collect()) == +copies
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_where_a_budget_ends_among_repeats(spark):
    """The only document of a source, repeated: the budget decides how many of the equal rows are taken once more."""
    rows = [(1, "w " * 3, "en", "a")] * 50 + [(2, "w " * 2, "en", "b")] * 100
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = brute.targets(Counter({"a": 150, "b": 200}))
    for s, size in (("a", 3), ("b", 2)):
        taken = sum(r.copies for r in got if r.sk == "s" + s)
        assert abs(taken * size - want[s]) <= size / 2
