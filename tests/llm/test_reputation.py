"""Host reputation against a plain version, and its parts against known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscope.llm import url_filter


def plain(hosts, limit=0.5):
    """{host: share of the posterior up to the limit}, from {host: (n, bad)} of plain two-label suffix rules."""
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    sums = {}
    for h, (n, bad) in hosts.items():
        for key in {h, domain(h), suffix(h), ""} if domain(h) != h else {h, suffix(h), ""}:
            a, b = sums.get(key, (0, 0))
            sums[key] = (a + n, b + bad)

    def fitted(rows):
        extra = sum((bad - n * r) ** 2 - n * r * (1 - r) for n, bad, r in rows)
        room = sum((n - 1) * n * r * (1 - r) for n, bad, r in rows)
        return min(1000, max(1, room / extra - 1)) if extra > 0 and room > 0 else 1000

    left = lambda whole, own, k, r: (sums[whole][1] - sums[own][1] + k * r) / (sums[whole][0] - sums[own][0] + k)
    rate0 = {s: (sums[""][1] - sums[s][1] + 1) / (sums[""][0] - sums[s][0] + 2) for s in map(suffix, hosts)}
    ks = fitted([(*sums[s], r) for s, r in rate0.items()])
    rate_s = {d: left(suffix(d), d, ks, rate0[suffix(d)]) for d in map(domain, hosts)}
    kd = fitted([(*sums[d], r) for d, r in rate_s.items()])
    rate_d = {h: (sums[domain(h)][1] - hosts[h][1] + kd * rate_s[domain(h)]) / (sums[domain(h)][0] - hosts[h][0] + kd) for h in hosts}
    kh = fitted([(*hosts[h], r) for h, r in rate_d.items()])
    out = {}
    for h, (n, bad) in hosts.items():
        a, b = bad + kh * rate_d[h], n - bad + kh * (1 - rate_d[h])
        t = (np.arange(400_000) + 0.5) / 400_000
        f = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - max((a - 1) * math.log(max((a - 1) / max(a + b - 2, 1e-9), 1e-9)) if a > 1 and b > 1 else 0, -1e9))
        out[h] = f[t <= limit].sum() / f.sum()
    return out


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for d in range(12):
        bad_domain = d % 4 == 0
        for h in range(rng.randrange(1, 6)):
            rate = rng.betavariate(16, 4) if bad_domain else rng.betavariate(2, 18)
            for _ in range(rng.choice([1, 3, 12, 90])):
                rows.append((f"http://h{h}.d{d}.{'com' if d % 3 else 'org'}/x", rng.random() < rate))
    rows += [("http://h0.d0.org/new", None), ("nothing", None), (None, None)]
    hosts = {}
    for url, bad in rows:
        host = url.split("/")[2] if url and "//" in url else ""
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), b + bool(bad))
    want = plain({h: v for h, v in hosts.items() if h})
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = {r.host: r for r in url_filter.judge(df, outcome=df.bad, rules=()).collect()}
    sure = [h for h, under in want.items() if abs(under - 0.05) > 0.005]
    assert len(sure) >= 20 and {got[h].verdict for h in sure} == {"allow", "block"}
    for h in sure:
        assert (got[h].verdict == "block") == (want[h] < 0.05), (h, want[h], got[h].bound)


@pytest.mark.parametrize("hot", [1, 1000])
def test_no_host_is_judged_by_rules(spark, monkeypatch, hot):
    """A rule for a path says nothing of its host's other pages; a hot host and the rest agree."""
    monkeypatch.setattr(url_filter, "PARTS", hot)
    body = "<p>" + "word " * 80 + "</p>"
    rows = [(f"http://a.example.com/de/{i}", body) for i in range(60)] + [(f"http://a.example.com/en/{i}", body) for i in range(60)]
    rows += [(f"http://cheap-pills.example.com/en/{i}", body) for i in range(60)] + [(f"http://thin.example.com/{i}", "<head>" + body + "</head>few words<!-- " + body + " -->") for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(rows, "url string, html string")).groupBy("host", F.substring("path", 1, 3).alias("p"), "rule", "verdict").count().collect()
    by = {(r.host, r.p if r.host == "a.example.com" else ""): r.verdict for r in got}
    assert by == {("a.example.com", "/de"): "block", ("a.example.com", "/en"): "allow", ("cheap-pills.example.com", ""): "block", ("thin.example.com", ""): "block"}


def test_domains_and_suffixes(spark):
    want = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com:8080": ("example.com", "com"), "me@x.example.org": ("example.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "com": ("com", "com"), "": ("", ""), "a.com.br": ("a.com.br", "com.br"), "foo.uk": ("foo.uk", "uk"), "[::1]:80": ("[::1]", "[::1]")}
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", url_filter.domain_of(F.col("host")), url_filter.suffix_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want


def test_quantiles():
    a, b = np.array([1.0, 2.0, 50.0, 20_000.0, 0.05]), np.array([1.0, 1.0, 50.0, 20_000.0, 0.95])
    got = url_filter.beta_quantiles(a, b, 0.05)
    assert got[:2] == pytest.approx([0.05, math.sqrt(0.05)], rel=2e-3)
    assert got[2] == pytest.approx(0.5 - 1.645 * 0.5 / math.sqrt(101), abs=1e-3) and got[3] == pytest.approx(0.5 - 1.645 * 0.5 / math.sqrt(40_001), abs=1e-5)
    assert 0 <= got[4] < 1e-9
