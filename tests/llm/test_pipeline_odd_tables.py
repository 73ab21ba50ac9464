"""The pipeline's stages, one after the other, on tables with nulls, repeats, odd texts, clashing names, and without rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHING = ("_c0", "_k", "_key", "n", "node", "size", "key", "bucket", "shard", "slot", "label", "score", "lang_pred", "copies", "epochs", "extra", "part", "_t")
VOICE = {"en": ["the", "and", "thing", "with", "that", "ing"], "de": ["der", "und", "schön", "nicht", "ein", "keit"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, item


def documents(spark, rows):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def through(spark, docs, folder, out):
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if name != "sharding":
            assert docs.columns == before.columns
        kept.append(docs)
    return kept


def test_odd_rows(spark, tables, tmp_path):
    folder, item = tables
    rng = random.Random(3)
    clean = [(i, " ".join(rng.choice(VOICE[lang]) + rng.choice(["", "s", "en", str(rng.randrange(99))]) for _ in range(rng.randrange(20, 60))), lang, None if i % 9 == 0 else rng.choice("ab")) for i in range(200) for lang in [rng.choice(list(VOICE))]]
    long = " ".join(rng.choice(VOICE["en"]) + str(rng.randrange(9999)) for _ in range(30_000))
    odd = [(None, None, None, None), (1000, None, "en", "a"), (1001, "", None, "a"), (1002, " \n\t", "de", None), (1003, "12 !?", "en", "b"), (1004, long, "en", "hot"), (None, clean[0][1] + " und", "de", "a")]
    copies = [clean[3]] * 5 + [(1005, clean[4][1], *clean[4][2:]), (1006, re.sub("[a-z]", lambda m: m[0].upper(), clean[6][1]), *clean[6][2:])]
    contaminated = [(1007, " ".join([clean[7][1], item]), *clean[7][2:])]
    first, second, third, fourth, last = (x.collect() for x in through(spark, documents(spark, clean + odd + copies + contaminated), folder, str(tmp_path)))
    letters = [r for r in clean + odd + copies + contaminated if re.search(r"[^\W\d_]", r[1] or "")]
    assert {r.doc_id for r in first} <= {r[0] for r in letters} and len(first) >= 0.95 * len(letters)
    assert max(Counter(r.doc_id for r in second).values()) == 1 and {1005, 1006} & {r.doc_id for r in second} == set()
    assert {r.doc_id for r in second} - {r.doc_id for r in third} == {1007} & {r.doc_id for r in second}
    assert {r.doc_id for r in fourth} <= {r.doc_id for r in third} and max(Counter(r.doc_id for r in fourth).values()) <= 3
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in fourth) and all(0 <= r.shard < 40 for r in last)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "text", None, None)] * 3])
def test_hardly_any_rows(spark, tables, tmp_path, rows):
    kept = through(spark, documents(spark, rows), tables[0], str(tmp_path))
    assert all(k.count() <= 3 * len(rows) for k in kept)
