"""Operators against plain versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscope.llm import decontaminate, jaccard_join, language_id, mixing, pii, secret_scan, sharding, token_count, topk, url_filter

CLASHING = ("_row", "_text", "n", "copies", "key", "size", "shard", "_k", "_id", "found", "label", "token", "host", "bound", "h", "_scan", "w", "node", "bucket", "sk")


def documents(spark, rows):
    """(doc_id, text, lang, source) rows with further columns of awkward names."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def words(rng, n, top=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(top)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Null, empty, blank and very long texts, copies, near copies, a hot source, repeated rows."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t", "one", "One  TWO", "!!!", "12 34", words(rng, 6_000), "É ß ÿ Ωmega 日本 ſ K", "\ue000mark\ue001 a@b.co \ue000"]
    base = words(rng, 200)
    for i in range(12):
        w = base.split()
        w[i * 7] = f"edit{i}"
        texts.append(" ".join(w))
    for i in range(12):
        w = base.split()
        for j in range(i + 1):
            w[j * 9 + 3] = f"far{i}"
        texts.append(" ".join(w))
    texts += [base] * 40 + [words(rng, rng.randrange(1, 100)) for _ in range(60)]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 7}") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, base, "en", "hot"), (None, None, None, None)]


def test_contamination(spark, corpus):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(12)] + [(50, "One two"), (51, None), (52, "..."), (53, " ".join((corpus[7][1]).split()[500:540])), (53, " ".join((corpus[7][1]).split()[500:540])), (None, "lonely words")]
    docs = list(corpus)
    for i in range(10):
        w = words(rng, 40 * (i + 1)).split()
        docs.append((10_000 + i, " ".join(w[:20] + items[i][1].upper().split()[: 13 + i] + w[20:]), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(documents(spark, docs), bench)
    got = found.select("doc_id", "n_words", F.size("hit_at").alias("h"), F.size("items").alias("i"), F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated(F.size("hit_at"), F.col("n_words"))).collect()
    named = [(i, t) for i, t in items if i is not None]
    assert Counter(map(tuple, got)) == Counter(brute.contamination([(d, t) for d, t, *_ in docs], named))
    clean = Counter((r.doc_id, r.text) for r in decontaminate.clean_documents(documents(spark, docs), bench).collect())
    want = brute.contamination([(d, t) for d, t, *_ in docs], [*named, (None, "lonely words")])
    assert clean == Counter((d, t) for (d, t, *_), r in zip(docs, want) if not r[-1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(documents(spark, docs), none).filter("size(hit_at) > 0").count() == 0
    assert decontaminate.clean_documents(documents(spark, docs[:3]), none).count() == 3
    assert decontaminate.scan(documents(spark, docs).limit(0), bench).count() == 0


def test_contamination_by_a_join(spark, corpus, monkeypatch):
    """More grams than may be broadcast."""
    monkeypatch.setattr(decontaminate, "SET_MAX", 3)
    text = words(random.Random(1), 60)
    rows = [(1, text, "en", "s"), (2, "nothing here", "en", "s"), (3, text + " " + words(random.Random(2), 2000), "en", "s"), (4, "lone", "en", "s"), *corpus[:12], *corpus[-4:]]
    items = [(7, " ".join(text.split()[10:40])), (8, "lone"), (9, " ".join(text.split()[12:30]))]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs, bench).select("doc_id", "n_words", F.size("hit_at").alias("h"), F.size("items").alias("i"), F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated(F.size("hit_at"), F.col("n_words")))
    want = brute.contamination([(d, t) for d, t, *_ in rows], items)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[-1])
    assert next(r.text for r in decontaminate.without_spans(docs, bench).collect() if r.doc_id == 1) == " ".join(text.split()[:10] + text.split()[40:])


def test_cutting_hit_words(spark):
    item = " ".join(f"b{i}" for i in range(13))
    docs = documents(spark, [(1, f"Keep, {item.upper()}! and this.", "en", "s"), (2, None, "en", "s"), (3, "...", "en", "s")])
    out = {r.doc_id: r.text for r in decontaminate.without_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: "Keep, and this.", 2: None, 3: "..."}


def test_mix(spark, corpus):
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(0, 200, 2)] + [(3, 1), (3, 0), (None, 1), (6, 7)], "doc_id long, quality int")
    docs = documents(spark, corpus)
    got = mixing.mix(docs, labels).select("doc_id", "sk", "size", "source_size", "target", "copies").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += count(t)
    want = brute.targets(sizes)
    by = {}
    for r in got:
        s = r.sk[1:] if r.sk else None
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 3
        by.setdefault(s, []).append(r)
    assert len(got) == len(corpus) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, rows in by.items():
        largest = max(r.size for r in rows)
        assert abs(sum(r.copies * r.size for r in rows) - want[s]) <= largest / 2 + 1e-6
        assert {r.copies for r in rows if r.size} <= {int(want[s] // max(sizes[s], 1)), int(want[s] // max(sizes[s], 1)) + 1}
    again = mixing.mix(documents(spark, corpus[::-1]).repartition(3), labels).select("doc_id", "sk", "size", "source_size", "target", "copies").collect()
    assert Counter(got) == Counter(again)
    rows = mixing.mixed(docs, labels)
    assert rows.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in rows.select("doc_id").collect()) == +copies
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_better_labels_are_taken_more_often(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(400)] + [(1000 + i, "w " * 10, "en", "b") for i in range(1600)]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(1600)], "doc_id long, quality int")
    got = mixing.mix(documents(spark, rows), labels).filter("sk = 'sb'").collect()
    good, bad = (sum(r.copies for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("shards", [1, 7])
def test_shards(spark, corpus, shards):
    docs = documents(spark, corpus)
    got = sharding.kd_shards(docs, shards, keep=("doc_id", "source")).collect()
    assert len(got) == len(corpus) and all(0 <= r.shard < shards for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, *_ in corpus)
    import zlib

    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32(t.encode()) if t is not None else None for _, t, *_ in corpus)
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in sharding.kd_shards(documents(spark, corpus[::-1]).repartition(3), shards).collect())
    assert sharding.kd_shards(docs.limit(0), shards).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, int(rng.paretovariate(1.2) * 8) % 900 + 1), rng.choice(["en", "de"]), "hot" if i % 3 == 0 else f"s{i % 9}") for i in range(2000)]
    rows += [(10_000 + i, rows[0][1], "en", "hot") for i in range(1000)]
    got = sharding.kd_shards(documents(spark, rows), 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 40 and max(sizes) <= 1.05 * sum(sizes) / 40 and min(sizes) >= 0.95 * sum(sizes) / 40
    groups = {}
    for r in sharding.kd_shards(documents(spark, rows[:2000]), 40).collect():
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_secrets(spark, corpus):
    rng = random.Random(4)
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = [
        "PassWord : 'abc123' token=abc api-key=123456 API_KEY==x.y/z+q secret='ab' passwd:xxxxxx", "AKIA" + "Z" * 16 + " AKIAAKIA" + "Q" * 12 + " AKIA12", "a" * 24 + "g" + "f" * 23 + " " + "0" * 5000,
        "paſſword=abcdef toKen=abcdef", "é token=日本 token = ÿtoken=abcdefg", '"secret": "' + key("abcdef0123456789", 40) + '"', "token=token=token=aaaaaa secret:secret:bbbbbbb",
    ]
    rows = [(100_000 + i, t, "en", "s") for i, t in enumerate(texts)] + corpus
    found = secret_scan.find(documents(spark, rows))
    base = F.filter("found", lambda s: s["kind"] < secret_scan.BASE)
    got = Counter((r[0], r[1]) for r in found.select("doc_id", secret_scan.listed(base)).collect())
    assert got == Counter((d, brute.spans(t, brute.SECRETS, True)) for d, t, *_ in rows)
    assert secret_scan.find(documents(spark, rows).limit(0)).count() == 0


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(7)
    b64 = secret_scan.ENCODINGS["base64"]
    plain = [" ".join(f"{w}{rng.randrange(9)}" for w in words(rng, 30).split()) + " some-long-hyphenated-name-v2 path/to/file/number/12345678" for _ in range(300)]
    keys = ["".join(rng.choice(b64[:62]) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)] + [(1000 + i, f"here {k} there", "en", "s") for i, k in enumerate(keys)]
    got = {r.doc_id for r in secret_scan.find(documents(spark, rows)).filter(F.exists("found", lambda s: s["kind"] == secret_scan.BASE)).collect()}
    assert len([d for d in got if d >= 1000]) >= 36 and len([d for d in got if d < 1000]) <= 6


def test_urls(spark):
    urls = [
        "http://a.net/x", "http://a.net", "https://m.example.net/en/7?q#f", "http://example.net/EN/7", "HTTP://WWW.Example.COM/de/1?x", "x://example.com/de", "http://notexample.com/de/1", "http://a.org/fr/2",
        "http://org/fr/", "http://xorg/fr/", "ftp://h.example.org?/fr/", "no scheme", "", None, "a://b://c/d", "http://É.NET/x#/y", "http://h/p?a://b", "http://a.net/x",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", F.lit(None).cast("string").alias("html"), *[F.lit("x").alias(c) for c in ("host", "bound", "_at", "_key0", "rule", "rows", "verdict", "n", "bad")])
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for i, u in enumerate(urls):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = brute.lower(host)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2]), u
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def components_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_jaccard_components(spark, corpus):
    want = brute.jaccard_components([(d, t) for d, t, *_ in corpus])
    assert components_of(jaccard_join.join(documents(spark, corpus))) == Counter((corpus[i][0], *v) for i, v in want.items())
    assert jaccard_join.join(documents(spark, corpus).limit(0)).count() == 0
    kept = jaccard_join.one_of_each(documents(spark, corpus))
    assert kept.columns == documents(spark, corpus).columns
    alone = Counter((corpus[i][0], corpus[i][1]) for i, v in want.items() if not v[0])
    groups = {v[1] for v in want.values() if v[0]}
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == sum(alone.values()) + len(groups) and {d for d, t in got - alone} == groups


@pytest.mark.parametrize("limits", [dict(LEAF=2, STARS=1, WIDE=6, PIVOTS=3), dict(LEAF=3, STARS=2, WIDE=20, PIVOTS=8), {}])
def test_jaccard_in_large_regions(spark, monkeypatch, limits):
    """Chains and balls of near copies around several centres, with regions that must be split."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng, docs = random.Random(11), []
    for c in range(3):
        base = words(rng, 90, 60).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(12)}"
            docs.append(" ".join(w))
        base = list(base)
        for i in range(10):  # a chain: each links to the next
            base[i * 3] = f"chain{i}"
            docs.append(" ".join(base))
    rng.shuffle(docs)
    rows = [(i, t, "en", "s") for i, t in enumerate(docs)]
    want = brute.jaccard_components(list(enumerate(docs)))
    assert components_of(jaccard_join.join(documents(spark, rows))) == Counter((i, *v) for i, v in want.items())


TOKENIZER = "word_bpe_49k.json"


def test_tokens(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(TOKENIZER))
    texts = ["don't <|endoftext|>X <|startoftext|", "a<|startoftext|><|endoftext|>b", "İstanbul ＡＢ ½ ²", "a\u0301e\u0301 é", "\x85\u00a0x\u2003y\x1cz", "1234 !!?? '''s 'LL", "x" * 5000]
    rows = [(900 + i, t, "en", "s") for i, t in enumerate(texts)] + corpus
    tokenizer = Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    for common in (token_count.COMMON, 5):
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.token_counts(documents(spark, rows), path, common=common).collect()) == want
    assert token_count.token_counts(documents(spark, rows).limit(0), path).count() == 0


VOICE = {"en": ["the", "and", "thing", "with", "that", "ing"], "de": ["der", "und", "schön", "nicht", "ein", "keit"], "fr": ["le", "être", "avec", "çela", "eau", "tion"]}


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(VOICE[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(2, 60))), lang, "s") for i in range(300) for lang in [rng.choice(list(VOICE))]]
    odd = [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 !?", "fr", "s"), (1003, "the thing " * 5_000, None, "s"), (None, "der und nicht", "de", "s"), rows[0]]
    got = language_id.identify(documents(spark, rows + odd)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert all(r.held_out == brute.held_out(r.doc_id) for r in got) and len(got) == len(rows) + len(odd)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"en"}
    kept = language_id.accepted(documents(spark, rows + odd))
    assert kept.columns == documents(spark, rows).columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in rows} - {1000}
    none = documents(spark, [(1, "text", None, "s"), (2, "more", None, "s")])
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}
    assert language_id.identify(none.limit(0)).count() == 0


def test_predictions_use_the_text_alone(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(VOICE[lang]) for _ in range(20)), lang, "s") for i in range(200) for lang in ["en", "de"]]
    swapped = [(d, t, ("de" if lang == "en" else "en") if brute.held_out(d) else lang, "other") for d, t, lang, _ in rows]
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())
    assert key(language_id.identify(documents(spark, rows))) == key(language_id.identify(documents(spark, swapped)))


def test_pii(spark, corpus):
    texts = [
        "x@y.com_foo@z.org a.b@c. @d.e a@b-c.d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 12--34",
        "+1 (743) 555-3824 +49(0)30.123456 + 12 +1 2 +123456789012345678", "9" * 5000, "1 2 " * 8000, "mail: é" + "a" * 3000 + "@" + "b.c" * 500, "1 -2 4111111111111111-", "call +1 743 555 3824 ssn 123-45-6789",
        "IBAN GB82WEST12345698765432 GB82WEST12345698765433", "123-45-6789", "",
    ]
    rows = [(900 + i, t, "en", "s") for i, t in enumerate(texts)] + corpus
    df = pii.detect(documents(spark, rows), out="spans")
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))
    got = Counter((r[0], r[1]) for r in df.select("doc_id", pii.listed(base)).collect())
    assert got == Counter((d, brute.spans(t, brute.PII, False)) for d, t, *_ in rows)
    more = {r.doc_id: r[1] for r in df.filter("doc_id in (908, 909, 910)").select("doc_id", pii.listed(F.filter("spans", lambda s: s["kind"] >= len(pii.BASE)))).collect()}
    assert more == {908: "ssn:25:36", 909: "iban:5:27", 910: ""}
    cut = {r.doc_id: r.text for r in pii.redacted(documents(spark, rows)).filter("doc_id in (900, 908, 911)").collect()}
    assert cut == {900: "[PII][PII] a.b@c. @d.e [PII]", 908: "call [PII] ssn [PII]", 911: ""}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    vectors += [(500 + i, list(vectors[20][1])) for i in range(60)] + [(20, list(vectors[20][1])), (600, None), (620, []), (640, [1.0, None]), (660, [float("nan")] * 8), (680, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors += [(700, [0.0] * 8), (720, [1.0, 2.0]), (721, [3.0, 4.0]), (740, [1e9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("q"), F.lit(2).alias("v"))
    want = brute.top_k(vectors)
    for shard, block in ((8192, 8192), (60, 9)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "BLOCK", block)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
