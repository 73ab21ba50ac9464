"""One query for each operator, over its whole table, in the columns that its contract fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.llm import decontaminate, jaccard_join, language_id, mixing, pii, secret_scan, sharding, token_count, topk, url_filter
from emberscope.llm.common import UPPER, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of nearly equal bytes, by the k-d tree."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and benchmark items of every document, and whether it is contaminated."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_words, n_hit = F.col("n_words").cast("long"), F.size("hit_at").cast("long")
    return found.select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, n_words).alias("contaminated"),
    )


OP2_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {OP2_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {OP2_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN g USING (n, gram)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY 1),
k AS (SELECT d.doc_id, source, md5(coalesce(text, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
e AS (SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0::DOUBLE) / w AS key FROM k),
s AS (SELECT source, sum(size)::DOUBLE AS s FROM k GROUP BY 1),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * s / w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, s, least(3 * s, coalesce(first_value(CASE WHEN level <= 3 * s / w THEN level END IGNORE NULLS)
    OVER (ORDER BY 3 * s / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, 3 * s)) AS target FROM l),
c AS (SELECT e.*, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN target - epochs * s > 0 AND ahead + size * 0.5::DOUBLE <= target - epochs * s THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, all spans."""
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < secret_scan.BASE)

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[: secret_scan.BASE])],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _fitted(level: str, rows: str, n: str, bad: str, rate: str) -> str:
    """A level's concentration, by moments."""
    return f"""{level} AS (SELECT CASE WHEN e > 0 AND v > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, v / e - 1)) ELSE 1000.0::DOUBLE END AS k FROM (
    SELECT sum(({bad} - {n} * {rate}) * ({bad} - {n} * {rate}) - {n} * {rate} * (1 - {rate})) AS e, sum(({n} - 1) * {n} * {rate} * (1 - {rate})) AS v FROM {rows}))"""


# The verdict asks whether at most 5 % of the host's posterior lie up to 0.5; the integral is over the logit of the rate.
OP5_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    len(regexp_extract_all(regexp_replace(html, '{url_filter.MARKUP}', ' ', 'g'), '[^\x20\x09-\x0D]+')) < 50 AS thin FROM pages),
r AS (SELECT *, CASE WHEN len(list_intersect(regexp_split_to_array(host, '[^a-z0-9]+'), {list(url_filter.NAMES)})) > 0 THEN true ELSE thin END AS outcome, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
n AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(outcome)::DOUBLE AS n, count(*) FILTER (outcome)::DOUBLE AS bad FROM r GROUP BY 1),
h AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '^(\[.*|[0-9]+(\.[0-9]+){{3}})$') THEN name
    WHEN regexp_matches(name, '(^|\.)({'|'.join(url_filter.SECOND)})\.[a-z][a-z]$') THEN regexp_extract(name, '([^.]*\.)?[^.]*\.[^.]*$') ELSE regexp_extract(name, '([^.]*\.)?[^.]*$') END AS domain,
    CASE WHEN regexp_matches(name, '^(\[.*|[0-9]+(\.[0-9]+){{3}})$') THEN name
    WHEN regexp_matches(name, '(^|\.)({'|'.join(url_filter.SECOND)})\.[a-z][a-z]$') THEN regexp_extract(name, '[^.]*\.[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM n),
d AS (SELECT domain, suffix, sum(n) AS n_d, sum(bad) AS bad_d FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n_d) AS n_s, sum(bad_d) AS bad_s FROM d GROUP BY 1),
s1 AS (SELECT *, (sum(bad_s) OVER () - bad_s + 1) / (sum(n_s) OVER () - n_s + 2) AS r0 FROM s),
{_fitted("ks", "s1", "n_s", "bad_s", "r0")},
d1 AS (SELECT domain, n_d, bad_d, (bad_s - bad_d + k * r0) / (n_s - n_d + k) AS rs FROM d JOIN s1 USING (suffix), ks),
{_fitted("kd", "d1", "n_d", "bad_d", "rs")},
h1 AS (SELECT host, n, bad, (bad_d - bad + k * rs) / (n_d - n + k) AS rd FROM h JOIN d1 USING (domain), kd),
{_fitted("kh", "h1", "n", "bad", "rd")},
b AS (SELECT host, bad + k * rd AS a, n - bad + k * (1 - rd) AS b FROM h1, kh),
g AS (SELECT host, a, b, ln(a / b) - greatest(12 * sqrt(1 / a + 1 / b), 40 / a) AS lo, ln(a / b) + greatest(12 * sqrt(1 / a + 1 / b), 40 / b) AS hi FROM b),
u AS (SELECT host, a, b, ln(a / b) AS m, unnest(list_transform(range(0, 8000), lambda i: lo + (hi - lo) * (i + 0.5) / 8000)) AS u FROM g),
w AS (SELECT host, u, exp(a * (u - m) - (a + b) * ((CASE WHEN u > 0 THEN u + ln(1 + exp(-u)) ELSE ln(1 + exp(u)) END) - (CASE WHEN m > 0 THEN m + ln(1 + exp(-m)) ELSE ln(1 + exp(m)) END))) AS f FROM u),
v AS (SELECT host, coalesce(sum(f) FILTER (u <= 0), 0) / sum(f) AS under FROM w GROUP BY 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN under < 0.05 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN v USING (host)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, m) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)
"""


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the public word-level tokenizer."""
    import public_tokenizers

    out = token_count.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_count.LIMIT).alias("over_limit"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and its probability for every document."""
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digest of the base spans, all spans."""
    docs = pii.detect(table(spark, sf_dir, "documents"), out="found")
    base = F.filter("found", lambda s: s["kind"] < len(pii.BASE))

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return docs.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.BASE)],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("found")).alias("spans"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 candidates of largest inner product for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_count": op7_token_count,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
}

SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op10_topk": OP10_SQL,
}
