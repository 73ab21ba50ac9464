"""The pipeline's stages and whole queries on small tables."""

import functools
import math
import os
import re
from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline
from emberscope.llm import queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def test_stages_against_plain_versions(spark, tmp_path, monkeypatch):
    read = lambda name: spark.read.parquet(f"{TABLES}/{name}.parquet")
    docs, items = read("documents"), [(r.item_id, r.text) for r in read("benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, TABLES).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert {r for r in before if re.search(r"[^\W\d_]", r.text or "")} >= set(after) and len(after) >= 0.98 * len(before)
        elif name == "jaccard_join":
            monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, n=5))
            want = brute.jaccard_components([(r.doc_id, r.text) for r in before], 80)
            assert {r.doc_id for r in after} == {v[1] for v in want.values()} and len(after) == len({v[1] for v in want.values()})
        elif name == "decontamination":
            want = brute.contamination([(r.doc_id, r.text) for r in before], items)
            assert Counter(r.doc_id for r in after) == Counter(w[0] for w in want if not w[-1])
        elif name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken, largest = Counter(), Counter(), Counter()
            for r in before:
                sizes[r.source] += size(r.text)
                largest[r.source] = max(largest[r.source], size(r.text))
            for r in after:
                taken[r.source] += size(r.text)
            assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in brute.targets(sizes).items())
            assert max(Counter(r.doc_id for r in after).values()) <= 3
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            slots = {}
            for r in after:
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, TABLES)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def plain(rows):
    one = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else format(v, ".9g") if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    df = queries.QUERIES[name](spark, TABLES)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{TABLES}/{t}'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want)


def test_there_is_one_query_for_each_operator():
    assert [len([n for n in queries.QUERIES if n.startswith(f"op{i}_")]) for i in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_returns_its_whole_table(spark, name):
    df = queries.QUERIES[name](spark, TABLES)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = df.collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        text = docs[r.doc_id].text
        if name == "op4_secret_scan":
            want = brute.spans(text, brute.SECRETS, True)
            assert r.base_sha256 == brute.sha(want) and [r.n_assign, r.n_access, r.n_hex] == [want.count(f"{k}:") for k in ("assign", "access", "hex")]
        if name == "op9_pii":
            want = brute.spans(text, brute.PII, False)
            assert r.base_sha256 == brute.sha(want) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
