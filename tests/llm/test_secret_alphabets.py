"""Random keys of every alphabet and length stay candidates and are found."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from emberscope.llm import secret_scan

TABLES = "/root/testdata/sf0.001"
UP, LOW, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": DIGIT + "ABCDEF", "lower hex": DIGIT + "abcdef", "base32": UP + "234567", "lower base32": LOW + "234567", "base36": UP + DIGIT, "lower base36": LOW + DIGIT,
    "base62": UP + LOW + DIGIT, "base64": UP + LOW + DIGIT + "+/", "base64url": UP + LOW + DIGIT + "-_",
}


def key(rng, letters, n):
    while True:
        k = "".join(rng.choice(letters) for _ in range(n))
        if re.search("[0-9]", k) and re.search("[A-Za-z]", k) and not secret_scan.base_spans(k):
            return k


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_keys_stay_candidates(name):
    rng = random.Random(name)
    for n in (20, 22) if name == "lower hex" else (20, 26, 32, 40, 52, 64, 100):  # longer lower hex is a base kind
        keys = [key(rng, ALPHABETS[name], n) for _ in range(200)]
        assert sum(any(odd < 20 for *_, odd, _ in secret_scan.candidates(f"here {k} there", [])) for k in keys) >= 186, n


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_uuids_stay_candidates(case):
    rng = random.Random(8)
    keys = [case(str(uuid.UUID(int=rng.getrandbits(1 << 7), version=4))) for _ in range(200)]
    assert sum([(a, b) for a, b, _, odd, _ in secret_scan.candidates(f"here {k} there", []) if odd < 20] == [(5, 41)] for k in keys) >= 186


def test_keys_of_all_alphabets_are_found_and_words_are_not(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(LOW) for _ in range(rng.randrange(2, 9)))
    plain = [" ".join(word() for _ in range(60)) + f" {word()}-{word()}-{word()}-name-v{rng.randrange(9)} some/{word()}/{word()}/{rng.randrange(10**6)} in {rng.randrange(3000)}" for _ in range(300)]
    keys = [key(rng, letters, n) for name, letters in ALPHABETS.items() for n in ((22,) if name == "lower hex" else (32, 40, 64)) for _ in range(10)]
    keys += [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(10)]
    rows = [*enumerate(plain), *((1000 + i, f"here {k} there") for i, k in enumerate(keys))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in secret_scan.find(docs).filter(F.exists("found", lambda s: s["kind"] == secret_scan.BASE)).collect()}
    assert len([d for d in got if d >= 1000]) >= 0.9 * len(keys) and len([d for d in got if d < 1000]) <= 6


def test_levels_by_length_class():
    """What isn't random is rejected by class; a class of random keys alone loses none."""
    random_bins = [(0, b, n) for b, n in ((0, 400), (3, 300), (10, 90), (20, 9), (30, 1))]
    odd_bins = [(1, 0, 40), (1, 22, 3), (1, 60, 200), (1, 300, 500)]
    assert secret_scan.thresholds(random_bins + odd_bins, 0.01) == {1: 22}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_keys_in_the_documents_are_found(spark):
    """Keys put into every tenth document are found; the other documents get no span, whole texts as they are."""
    rng = random.Random(9)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect())
    keyed, rows = {}, []
    for i, (doc, text) in enumerate(docs):
        if i % 10 == 0:
            k = key(rng, ALPHABETS[rng.choice(["base32", "base62", "base64", "lower base36"])], rng.choice([32, 40, 64]))
            at = text.find(" ", len(text) // 2) + 1
            text, keyed[doc] = f"{text[:at]} {k} {text[at:]}", (at + 1, at + 1 + len(k))
        rows.append((doc, text))
    found = secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.found if s["kind"] == secret_scan.BASE] for r in found}
    assert sum(got[d] == [place] for d, place in keyed.items()) >= 0.9 * len(keyed)
    assert sum(bool(v) for d, v in got.items() if d not in keyed) <= 1
