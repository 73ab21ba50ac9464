"""The pipeline's near-duplicate stage against all pairs at five words and 0.8."""

import functools
import random
from collections import Counter

import brute

import corpus_pipeline


def test_stage_links_at_five_words_and_eight_tenths(spark, monkeypatch):
    rng = random.Random(21)
    base = [[f"w{c}x{rng.randrange(500)}" for _ in range(100)] for c in range(6)]
    texts = [None, "", "one two", "one TWO", "a b c d", "a b c d e", "a b c d e f"]
    for c, words in enumerate(base):
        texts.append(" ".join(words))
        for n in range(1, 5):  # edits apart from each other: 2 are about 0.81 of five-word shingles, and 0.89 of three-word ones
            w = list(words)
            for j in range(n):
                w[10 + 20 * j] = f"edit{c}x{n}x{j}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    three = brute.jaccard_components([r[:2] for r in rows])
    monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, n=5))
    want = brute.jaccard_components([r[:2] for r in rows], 80)
    assert len({v[1] for v in want.values()}) < len({v[1] for v in three.values()})
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({v[1] for v in want.values()})
