"""Spans beyond the base kinds: printed IBANs, context after a span, redaction of odd tables."""

import pytest
from pyspark.sql import functions as F

from emberscope.llm import pii


def compact_ok(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = F.filter("pii", lambda s: s["kind"] >= len(pii.BASE))
    found = pii.detect(rows).select("doc_id", F.transform(more, lambda s: s["value"]).alias("v")).collect()
    return {r.doc_id: r.v for r in found}


def test_printed_ibans(spark):
    codes = ["GB82 WEST 1234 5698 7654 32", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"]
    assert all(compact_ok(c.replace(" ", "")) for c in codes)
    texts = [f"to {c} TEST 1234 please" for c in codes] + [c.replace(" ", "") for c in codes] + [c[:-1] + str((int(c[-1]) + 1) % 10) for c in codes] + [codes[0].replace(" ", "  "), "x" + codes[1], codes[2] + "7"]
    got = spans(spark, texts)
    want = [[c] for c in codes] + [[c.replace(" ", "")] for c in codes] + [[]] * 7
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("text, kept", [("123-45-6789 (SSN)", True), ("ssn 123-45-6789", True), ("123-45-6789", False), ("123-45-6789" + " x" * 40 + " ssn", False)])
def test_context_on_both_sides(spark, text, kept):
    assert spans(spark, [text])[0] == (["123-45-6789"] if kept else [])


def test_redacted_tables(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "x@y.zz and 123-45-6789 ssn", "c"), (3, "x@y.zz and 123-45-6789 ssn", "c")], "doc_id long, text string, pii string")
    out = pii.redacted(rows)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "[PII] and [PII] ssn", "c"), (3, "[PII] and [PII] ssn", "c")], key=str)
    assert pii.redacted(rows.limit(0)).count() == 0
