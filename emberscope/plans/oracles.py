"""The queries' results as SQL for DuckDB, written from the tables and the meaning of each operator."""

from __future__ import annotations

EVENTS = """
e AS (SELECT event_id, user_id, ts, event_type, CAST(round(value * 1000) AS BIGINT) AS d, 'g' || least((day(ts) - 1) // 10, 2) AS group_id,
    TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 8 AS k FROM events),
s AS (SELECT *, group_id || '-' || user_id AS profile_id, row_number() OVER (PARTITION BY group_id, user_id ORDER BY ts, event_id) - 1 AS i,
    CASE WHEN k < 7 THEN 'GET /' || k END AS label FROM e),
f(name, key, display, file, package, category) AS (VALUES
    ('root', ':1:(root)', '(root)', '(native)', '(root)', 'native'),
    ('handle', '5:10:handle', 'handle (/usr/src/app/src/services/handle.js:10)', '/usr/src/app/src/services/handle.js', 'app:src/services', 'user'),
    ('click', 'file:///app/node_modules/express/lib/click.js:5:click', 'click (file:///app/node_modules/express/lib/click.js:5)', 'file:///app/node_modules/express/lib/click.js', 'express', 'node_modules'),
    ('view', '7:1:view', 'view (/usr/src/app/dist/controllers/view.js:1)', '/usr/src/app/dist/controllers/view.js', 'app:controllers', 'user'),
    ('purchase', '8:3:purchase', 'purchase (node:internal/purchase:3)', 'node:internal/purchase', 'node:builtin', 'native'),
    ('signup', ':1:(program)', '(program)', '(native)', '(program)', 'native'),
    ('error', ':1:(idle)', '(idle)', '(native)', '(idle)', 'idle')),
hop(event_type, pos, name) AS (VALUES ('click', 1, 'root'), ('click', 2, 'handle'), ('click', 3, 'click'), ('view', 1, 'root'), ('view', 2, 'handle'), ('view', 3, 'view'),
    ('purchase', 1, 'root'), ('purchase', 2, 'handle'), ('purchase', 3, 'view'), ('purchase', 4, 'handle'), ('purchase', 5, 'purchase'),
    ('signup', 1, 'root'), ('signup', 2, 'signup'), ('error', 1, 'root'), ('error', 2, 'error')),
g AS (SELECT group_id, count(DISTINCT profile_id) AS n, sum(d) AS whole, sum(d) FILTER (event_type <> 'error') AS busy, count(*) AS samples FROM s GROUP BY 1),
dims AS (SELECT 'function' AS dim, key, display, package, category, name, file FROM f UNION ALL SELECT 'package', package, package, package, category, name, file FROM f
    UNION ALL SELECT 'file', file, file, CASE WHEN file = '(native)' THEN '(root)' ELSE package END, CASE WHEN file = '(native)' THEN 'native' ELSE category END, name, file FROM f),
ent AS (SELECT DISTINCT dim, key, display, package, category, CASE WHEN dim = 'function' THEN file END AS file FROM dims),
own AS (SELECT group_id, dim, key, count(*) AS ss, sum(d) AS sm FROM s JOIN dims ON dims.name = s.event_type GROUP BY ALL),
tot AS (SELECT group_id, dim, key, count(*) AS ts, sum(d) AS tm FROM s JOIN (SELECT DISTINCT event_type, dim, key FROM hop JOIN dims USING (name)) USING (event_type) GROUP BY ALL),
x AS (SELECT g.group_id, ent.*, coalesce(ss, 0) AS ss, coalesce(sm, 0) AS sm, coalesce(ts, 0) AS ts, coalesce(tm, 0) AS tm, g.n, g.whole, g.busy
    FROM g CROSS JOIN ent LEFT JOIN own USING (group_id, dim, key) LEFT JOIN tot USING (group_id, dim, key)),
ctx AS (SELECT group_id, label, count(*) AS ss, sum(d) AS sm FROM s WHERE label IS NOT NULL GROUP BY ALL)"""

EPISODES = f"""{EVENTS},
w AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY i) AS episode FROM s),
b AS (SELECT w.*, f.key, f.display FROM w JOIN f ON f.name = w.event_type WHERE event_type <> 'error'),
ep AS (SELECT group_id, profile_id, user_id, episode, sum(d) AS micros, count(*) AS samples, count(label) > 0 AS labelled FROM b GROUP BY ALL HAVING sum(d) >= 100000),
run AS (SELECT profile_id, episode, i, key, sum(d) OVER (PARTITION BY profile_id, episode, key ORDER BY i) AS r FROM b),
dom AS (SELECT profile_id, episode, key AS fn FROM run WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY profile_id, episode ORDER BY r DESC, i) = 1),
lab AS (SELECT profile_id, episode, label, sum(d) AS m FROM b WHERE label IS NOT NULL GROUP BY ALL),
dl AS (SELECT profile_id, episode, label AS context FROM lab WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY profile_id, episode ORDER BY m DESC, label) = 1),
lf AS (SELECT profile_id, episode, display AS leaf, event_type AS leaf_type FROM b QUALIFY row_number() OVER (PARTITION BY profile_id, episode ORDER BY greatest(d, -1) DESC, i) = 1),
found AS (SELECT ep.*, fn, coalesce(context, '') AS context, leaf, leaf_type FROM ep LEFT JOIN dom USING (profile_id, episode) LEFT JOIN dl USING (profile_id, episode) JOIN lf USING (profile_id, episode)),
stall AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY micros DESC, user_id, profile_id, episode) AS rank FROM found)"""

ORDERS = """
c AS (SELECT r_name AS g, r_regionkey % 3 AS rk, n_nationkey % 3 AS nk, c_custkey % 3 AS ck, lower(c_mktsegment) AS seg, c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT c.*, o_orderkey, coalesce(CAST(round(o_totalprice * 100) AS BIGINT), 0) AS d FROM c LEFT JOIN orders ON o_custkey = c_custkey),
keyed AS (
    SELECT g, 'function' AS dim, '1:1:k' || unnest(list_distinct([rk, nk, ck])) AS key, '1:1:k' || ck AS own, o_orderkey, d FROM o
    UNION ALL SELECT g, 'file', unnest(['/usr/src/app/src/geo/n.js', 'file:///app/node_modules/' || seg || '/index.js']), 'file:///app/node_modules/' || seg || '/index.js', o_orderkey, d FROM o
    UNION ALL SELECT g, 'package', unnest(['app:src/geo', seg]), seg, o_orderkey, d FROM o)"""
INCLUSIVE = f"""WITH {ORDERS} SELECT g AS group_id, dim, key, count(o_orderkey) FILTER (key = own) AS self_samples, count(o_orderkey) AS total_samples,
  CAST(coalesce(sum(d) FILTER (key = own), 0) AS BIGINT) AS self_micros, CAST(sum(d) AS BIGINT) AS total_micros FROM keyed GROUP BY ALL"""

LISTING = """
l AS (SELECT 'profiles/prod/' || event_type || '/' || strftime(ts, '%Y-%m-%d') || '/b' || (user_id % 3) || '/' || (epoch_us(ts) // 1000) || '_host_' || (user_id % 5) || '_' || event_id
    || CASE WHEN event_id % 11 = 0 THEN '.txt' ELSE '.cpuprofile' END AS raw, event_id % 11 <> 0 AS good, event_type AS service, strftime(ts, '%Y-%m-%d') AS date, 'b' || (user_id % 3) AS build_tag,
    (epoch_us(ts) // 1000) AS ms, 'host_' || (user_id % 5) AS host, event_id AS pid, event_id % 1000 AS size, ts FROM events),
m AS (SELECT *, 'prod/' || service || '/' || date || '/' || build_tag AS group_id FROM l WHERE good),
ranked AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS total, row_number() OVER (PARTITION BY group_id ORDER BY substr(sha256(raw), 1, 16), raw) AS h, row_number() OVER (PARTITION BY group_id ORDER BY raw) AS n FROM m),
few AS (SELECT *, CASE WHEN total <= 5 THEN n ELSE h END AS member_rank FROM ranked WHERE total <= 5 OR h <= 5)"""


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0 END"


def mean(total: str) -> str:
    return f"CAST({total} AS DOUBLE) / CAST(n AS DOUBLE)"


def self_of(dim: str) -> str:
    return f"WITH {EVENTS} SELECT group_id, key, display, package, category, ss AS self_samples, CAST(sm AS BIGINT) AS self_micros FROM x WHERE dim = '{dim}'"


def pivoted(cells: str, sort: str = "max", tail: str = "") -> str:
    """A matrix from (group_id, key, display, package, v)."""
    keys = {"max": "greatest(t0, t1, t2, 0)", "delta": "t2 - t0", "deltaPct": "CASE WHEN t0 = 0 AND t2 > 0 THEN 1.7976931348623157e308 WHEN t0 <> 0 THEN (t2 - t0) / abs(t0) * 100 ELSE 0 END"}
    at = lambda i: f"coalesce(max(v) FILTER (group_id = 'g{i}'), 0) AS t{i}"
    return f"""WITH {EVENTS}, v AS ({cells}), p AS (SELECT key, display, package, {at(0)}, {at(1)}, {at(2)} FROM v GROUP BY ALL)
SELECT *, t2 - t0 AS delta, CASE WHEN t0 <> 0 THEN (t2 - t0) / abs(t0) * 100 ELSE 0 END AS delta_pct, CAST({keys[sort]} AS DOUBLE) AS sort_key FROM p {tail}"""


def entity_matrix(dim: str, value: str, sort: str = "max", where: str = "true", tail: str = "") -> str:
    return pivoted(f"SELECT group_id, key, display, package, {value} AS v FROM x WHERE dim = '{dim}' AND {where}", sort, tail)


def block_stats(dim: str) -> str:
    key, owner, only = ("key", "fn", "fn IS NOT NULL") if dim == "function" else ("label", "context", "labelled")
    return f"""WITH {EPISODES}, u AS (SELECT group_id, {key} AS key, sum(d) AS m, 0 AS n, 0 AS mx FROM b JOIN (SELECT profile_id, episode FROM found) USING (profile_id, episode) WHERE {key} IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT group_id, {owner}, 0, 1, micros FROM found WHERE {only})
SELECT group_id, '{dim}' AS dim, key, CAST(sum(m) AS BIGINT) AS blocked_micros, CAST(sum(n) AS BIGINT) AS episodes, CAST(max(mx) AS BIGINT) AS max_episode_micros FROM u GROUP BY 1, 3"""


def breakdown(sections: str, top: int = 25) -> str:
    """Ranked sections from (section, key, display, package, total, self, of_function, of_context, r1, r2)."""
    return f"""WITH {EVENTS}, g1 AS (SELECT * FROM s WHERE group_id = 'g1'), n1 AS (SELECT n FROM g WHERE group_id = 'g1'), c1 AS (SELECT label, sm FROM ctx WHERE group_id = 'g1'),
rows AS ({sections}), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY r1 DESC, r2 DESC, display, key) AS rank FROM rows)
SELECT section, CAST(rank AS INTEGER) AS rank, key, display, package, CAST(total AS DOUBLE) / (SELECT n FROM n1) AS total_micros, CAST(self AS DOUBLE) / (SELECT n FROM n1) AS self_micros, false AS via_async,
  CAST(of_function AS DOUBLE) AS pct_of_function, CAST(of_context AS DOUBLE) AS pct_of_context FROM r WHERE rank <= {top}"""


def function_contexts(name: str, by_share: bool) -> str:
    order = "of_context, total" if by_share else "total, 0"
    return f"""SELECT *, {order} FROM (SELECT 'contexts' AS section, t.label AS key, t.label AS display, '' AS package, t.m AS total, 0 AS self,
  {pct("t.m", "(SELECT tm FROM x WHERE group_id = 'g1' AND dim = 'function' AND key = (SELECT key FROM f WHERE name = '" + name + "'))")} AS of_function, {pct("t.m", "c1.sm")} AS of_context
  FROM (SELECT label, sum(d) AS m FROM g1 WHERE label IS NOT NULL AND event_type IN (SELECT event_type FROM hop WHERE name = '{name}') GROUP BY 1) t JOIN c1 USING (label))"""


def ends_in(dim: str, key: str) -> str:
    return f"""SELECT 'contexts', label, label, '', m, m, 0, {pct("m", "c1.sm")}, m, 0 FROM (SELECT label, sum(d) AS m FROM g1 JOIN dims ON dims.name = g1.event_type
  WHERE label IS NOT NULL AND dim = '{dim}' AND dims.key = '{key}' GROUP BY 1) t JOIN c1 USING (label)"""


def members(section: str, dim: str, where: str) -> str:
    return f"SELECT '{section}' AS section, key, display, package, tm AS total, sm AS self, 0 AS of_function, 0 AS of_context, sm AS r1, 0 AS r2 FROM x WHERE group_id = 'g1' AND dim = '{dim}' AND {where}"


def context_breakdown(where: str = "true", rebased: bool = False) -> str:
    share = "CASE WHEN sum(m) OVER (PARTITION BY dim) > 0 THEN CAST(m AS DOUBLE) / sum(m) OVER (PARTITION BY dim) * 100 ELSE 0 END" if rebased else pct("m", "(SELECT sm FROM c1 WHERE label = 'GET /1')")
    return breakdown(f"""SELECT 'functions' AS section, key, display, package, m AS total, 0 AS self, 0 AS of_function, {pct("m", "(SELECT sm FROM c1 WHERE label = 'GET /1')")} AS of_context, m AS r1, 0 AS r2
  FROM (SELECT f.key, f.display, f.package, sum(d) AS m FROM g1 JOIN (SELECT DISTINCT event_type, name FROM hop) h USING (event_type) JOIN f USING (name) WHERE label = 'GET /1' GROUP BY ALL)
UNION ALL SELECT dim || 's', key, key, CASE WHEN dim = 'file' THEN package ELSE '' END, m, m, 0, {share}, m, 0 FROM (SELECT dim, dims.key, any_value(package) AS package, any_value(category) AS category, sum(d) AS m
  FROM g1 JOIN dims ON dims.name = g1.event_type WHERE label = 'GET /1' AND dim <> 'function' GROUP BY dim, dims.key) WHERE {where}""")


def neighbours(category: str = "true") -> str:
    """Callers and callees of handle in g1."""
    hops = "FROM g1 JOIN hop c USING (event_type) JOIN hop h ON h.event_type = c.event_type AND h.pos = c.pos + 1"
    return f"""SELECT 'callers' AS section, f.key, f.display, f.package, m AS total, 0 AS self, 0 AS of_function, 0 AS of_context, m AS r1, 0 AS r2 FROM (SELECT c.name, sum(d) AS m
  {hops} WHERE h.name = 'handle' GROUP BY 1) JOIN f USING (name) WHERE {category}
UNION ALL SELECT 'callees', f.key, f.display, f.package, m, 0, 0, 0, m, 0 FROM (SELECT h.name, sum(d) AS m {hops} WHERE c.name = 'handle' GROUP BY 1) JOIN f USING (name) WHERE {category}"""


def top_blocked(dim: str, top: int) -> str:
    names = "LEFT JOIN f USING (key)" if dim == "function" else ""
    display = "coalesce(display, key)" if dim == "function" else "key"
    return f"""WITH {EVENTS}, bs AS ({block_stats(dim)}) SELECT key, {display} AS display, blocked_micros, episodes, max_episode_micros FROM bs {names} WHERE group_id = 'g0'
ORDER BY blocked_micros DESC, {display}, key LIMIT {top}"""


HOST, PATH = "split_part(p, '/', 1)", "regexp_replace(url, '^[a-z]+://', '')"
SQL = {
    "self_by_function": self_of("function"), "self_by_package": self_of("package"), "self_by_file": self_of("file"),
    "overall": f"WITH {EVENTS} SELECT group_id, samples AS self_samples, samples AS total_samples, CAST(whole AS BIGINT) AS self_micros, CAST(whole AS BIGINT) AS total_micros FROM g",
    "profile_stats": f"WITH {EVENTS} SELECT group_id, samples AS sample_count, n AS profile_count, CAST(whole AS BIGINT) AS duration_us, false AS approximate, true AS has_ctx FROM g",
    "inclusive_recursive": INCLUSIVE, "merged_partials": INCLUSIVE,
    "call_edges": f"""WITH {ORDERS}, u AS (SELECT g, rk AS a, nk AS b, o_orderkey, d FROM o UNION ALL SELECT g, nk, ck, o_orderkey, d FROM o)
SELECT g AS group_id, '1:1:k' || a AS caller, '1:1:k' || b AS callee, count(o_orderkey) AS total_samples, CAST(sum(d) AS BIGINT) AS total_micros FROM u GROUP BY ALL""",
    "contexts": f"WITH {EVENTS} SELECT group_id, label, ss AS self_samples, ss AS total_samples, CAST(sm AS BIGINT) AS self_micros, CAST(sm AS BIGINT) AS total_micros FROM ctx",
    "fn_contexts": f"""WITH {EVENTS} SELECT group_id, f.key, label, count(*) AS total_samples, CAST(sum(d) AS BIGINT) AS total_micros
FROM s JOIN (SELECT DISTINCT event_type, name FROM hop) h USING (event_type) JOIN f USING (name) WHERE label IS NOT NULL GROUP BY ALL""",
    "ctx_entities": f"WITH {EVENTS} SELECT group_id, label, dim, dims.key, count(*) AS self_samples, CAST(sum(d) AS BIGINT) AS self_micros FROM s JOIN dims ON dims.name = s.event_type WHERE label IS NOT NULL AND dim <> 'function' GROUP BY ALL",
    "episodes": f"WITH {EPISODES} SELECT group_id, profile_id, CAST(episode AS BIGINT) AS episode, CAST(micros AS BIGINT) AS micros, samples, fn, context, leaf FROM found",
    "block_summary": f"WITH {EPISODES} SELECT group_id, count(*) AS episodes, CAST(sum(micros) AS BIGINT) AS blocked_micros, CAST(max(micros) AS BIGINT) AS max_episode_micros, CAST(100000 AS BIGINT) AS threshold_micros FROM found GROUP BY 1",
    "block_functions": block_stats("function"), "block_contexts": block_stats("context"),
    "top_stalls": f"WITH {EPISODES} SELECT group_id, CAST(rank AS INTEGER) AS rank, profile_id, CAST(micros AS BIGINT) AS micros, samples, context, leaf FROM stall WHERE rank <= 64",
    "stall_stacks": f"""WITH {EPISODES}, st AS (SELECT event_type AS leaf_type, string_agg(display, ' > ' ORDER BY pos) AS stack FROM hop JOIN f USING (name) GROUP BY 1)
SELECT group_id, CAST(rank AS INTEGER) AS rank, stack FROM stall JOIN st USING (leaf_type) WHERE rank <= 64""",
    "matrix_max": entity_matrix("function", mean("sm")), "matrix_total": entity_matrix("function", mean("tm")), "matrix_delta": entity_matrix("function", mean("sm"), "delta"),
    "matrix_delta_pct": entity_matrix("package", pct("sm", "whole"), "deltaPct"), "matrix_busy": entity_matrix("function", pct("sm", "busy")),
    "matrix_filtered": entity_matrix("function", mean("sm"), where="category = 'user'"), "matrix_top": entity_matrix("function", mean("tm"), tail="ORDER BY sort_key DESC, display, key LIMIT 3"),
    "matrix_context": pivoted(f"SELECT group_id, label AS key, label AS display, '' AS package, {mean('sm')} AS v FROM ctx JOIN g USING (group_id)"),
    "matrix_context_filtered": pivoted(f"""SELECT group_id, label AS key, label AS display, '' AS package, {pct("m", "busy")} AS v FROM (SELECT group_id, label, sum(d) FILTER (category <> 'idle') AS m,
  sum(d) FILTER (category IN ('user', 'native')) AS k FROM s JOIN f ON f.name = s.event_type WHERE label IS NOT NULL GROUP BY ALL) JOIN g USING (group_id) WHERE k <> 0"""),
    "matrix_overall": pivoted(f"SELECT group_id, '__overall__' AS key, 'Total (all frames, per profile)' AS display, '' AS package, {mean('whole')} AS v FROM g"),
    "summaries": f"""WITH {EVENTS}, k AS (SELECT group_id, sum(d) AS m, count(*) AS c FROM s WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT group_id, CAST(m AS DOUBLE) / n AS overall_micros, CAST(c AS DOUBLE) / n AS overall_samples, samples AS sample_count, n AS profile_count, CAST(whole AS DOUBLE) / n AS duration_micros,
  false AS timing_approximate, {pct("(whole - busy)", "whole")} AS idle_pct, 100 - {pct("(whole - busy)", "whole")} AS busy_pct FROM g JOIN k USING (group_id)""",
    "derive_package": f"""WITH u AS (SELECT page_id, page_id % 8 AS i, {PATH} AS p, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '(idle)' ELSE 'fn' END AS name FROM pages),
v AS (SELECT *, CASE i WHEN 0 THEN '' WHEN 1 THEN 'node:' || p WHEN 2 THEN 'file:///app/node_modules/@' || p WHEN 3 THEN 'C:\\app\\node_modules\\' || p WHEN 4 THEN '/usr/src/app/src/' || p
  WHEN 5 THEN '/srv/dist/main.js' WHEN 6 THEN 'webpack://' || p ELSE 'file:///' || p END AS url FROM u)
SELECT page_id, CASE i WHEN 0 THEN CASE name WHEN '' THEN '(program)' WHEN '(idle)' THEN '(idle)' ELSE '(native)' END WHEN 1 THEN 'node:builtin'
  WHEN 2 THEN '@' || {HOST} || CASE WHEN split_part(p, '/', 2) <> '' THEN '/' || split_part(p, '/', 2) ELSE '' END WHEN 3 THEN {HOST} WHEN 4 THEN 'app:src/' || {HOST} WHEN 5 THEN 'app:dist'
  WHEN 6 THEN '(eval)' ELSE 'app:' || {HOST} END AS package,
  CASE i WHEN 0 THEN CASE name WHEN '(idle)' THEN 'idle' ELSE 'native' END WHEN 1 THEN 'native' WHEN 2 THEN 'node_modules' WHEN 3 THEN 'node_modules' ELSE 'user' END AS category,
  CASE name WHEN '' THEN '(anonymous)' ELSE name END || CASE WHEN url = '' THEN '' ELSE ' (' || url || ':2)' END AS display FROM v""",
    "parse_object_key": f"""WITH {LISTING} SELECT raw, CASE WHEN good THEN 'prod' END AS env, CASE WHEN good THEN service END AS service, CASE WHEN good THEN date END AS date, CASE WHEN good THEN build_tag END AS build_tag,
  CASE WHEN good THEN host END AS host, CASE WHEN good THEN pid END AS pid, CASE WHEN good THEN ms END AS ms FROM l""",
    "sample_hash": f"WITH {LISTING} SELECT group_id, raw, total, CAST(member_rank AS INTEGER) AS member_rank FROM few",
    "member_signatures": f"WITH {LISTING} SELECT group_id, sha256(string_agg(raw || ':' || size || chr(0), '' ORDER BY raw || ':' || size)) AS signature FROM few GROUP BY 1",
    "window_filter": f"WITH {LISTING} SELECT raw FROM m WHERE (epoch_us(ts) // 1000) BETWEEN epoch_ms(TIMESTAMP '2024-01-10 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-12 12:00:00')",
    "latest_build": f"WITH {LISTING} SELECT group_id FROM m WHERE service = 'click' GROUP BY group_id, date, build_tag ORDER BY max(ms) DESC, date DESC, build_tag DESC LIMIT 1",
    "browse_levels": f"""WITH {LISTING} SELECT DISTINCT 'env' AS level, 'prod' AS name FROM m UNION ALL SELECT DISTINCT 'service', service FROM m
UNION ALL SELECT DISTINCT 'date', date FROM m WHERE service = 'click'""",
    "browse_groups": f"WITH {LISTING} SELECT group_id, count(*) AS members, CAST(sum(size) AS BIGINT) AS size FROM m WHERE service = 'view' AND date = '2024-01-03' GROUP BY 1",
    "callers": f"""WITH {EVENTS} SELECT f.key, count(*) AS total_samples, CAST(sum(d) AS BIGINT) AS total_micros FROM s JOIN hop c USING (event_type) JOIN hop h ON h.event_type = c.event_type AND h.pos = c.pos + 1
JOIN f ON f.name = c.name WHERE h.name = 'handle' AND group_id = 'g0' GROUP BY 1""",
    "callees": f"""WITH {EVENTS} SELECT f.key, count(*) AS total_samples, CAST(sum(d) AS BIGINT) AS total_micros FROM s JOIN hop c USING (event_type) JOIN hop h ON h.event_type = c.event_type AND h.pos = c.pos + 1
JOIN f ON f.name = h.name WHERE c.name = 'handle' AND group_id = 'g0' GROUP BY 1""",
    "stitched_callers": """WITH q AS (SELECT 's' || (l_suppkey % 10) AS s, 't' || (p_size % 4) AS t, sum(CAST(round(l_quantity) AS BIGINT)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT s AS key, round(CAST(sum(2 * q) AS DOUBLE), 3) AS total_micros, true AS hopped FROM q WHERE t <> 't3' GROUP BY 1 UNION ALL SELECT 't3', CAST(sum(2 * q) AS DOUBLE), false FROM q WHERE t = 't3' HAVING count(*) > 0""",
    "function_breakdown": breakdown(f"""SELECT 'callers' AS section, f.key, f.display, f.package, m AS total, 0 AS self, 0 AS of_function, 0 AS of_context, m AS r1, 0 AS r2
  FROM (SELECT sum(d) AS m FROM g1 WHERE event_type = 'purchase') JOIN f ON f.name = 'handle' UNION ALL {function_contexts("purchase", False)}"""),
    "function_contexts_by_share": breakdown(f"{neighbours()} UNION ALL {function_contexts('handle', True)}", 3),
    "function_breakdown_filtered": breakdown(f"{neighbours("category = 'user'")} UNION ALL {function_contexts('handle', False)}"),
    "package_breakdown_filtered": breakdown(members("functions", "function", "package = 'app:src/services' AND category = 'native'") + " UNION ALL " + ends_in("package", "app:src/services")),
    "file_breakdown_filtered": breakdown(members("functions", "function", "file = '(native)' AND category = 'native'") + " UNION ALL " + ends_in("file", "(native)")),
    "blocking_functions_ranked": top_blocked("function", 2), "blocking_contexts_ranked": top_blocked("context", 3),
    "hit_counts": """WITH h AS (SELECT r_name AS g, n_name, c_custkey // 250 AS run, c_custkey, count(o_orderkey) AS h FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), p AS (SELECT *, sum(h) OVER (PARTITION BY n_name, run) AS whole FROM h)
SELECT g AS group_id, '1:1:k' || (c_custkey % 3) AS key, CAST(sum(h) AS BIGINT) AS self_samples, CAST(sum(CASE WHEN whole > 0 THEN h * 10000000 // whole ELSE 0 END) AS BIGINT) AS self_micros FROM p GROUP BY 1, 2""",
    "unknown_nodes": f"""WITH {EVENTS}, k AS (SELECT * FROM s WHERE event_type <> 'signup')
SELECT g.group_id, f.key, count(k.d) AS self_samples, CAST(coalesce(sum(k.d), 0) AS BIGINT) AS self_micros FROM g CROSS JOIN f LEFT JOIN k ON k.group_id = g.group_id AND k.event_type = f.name GROUP BY 1, 2
UNION ALL SELECT group_id, 'busy', count(*), CAST(sum(d) AS BIGINT) FROM k WHERE event_type <> 'error' GROUP BY 1""",
    "merged_labels": f"WITH {EVENTS} SELECT group_id, dim, key, display, package, category, file FROM x",
    "stitched_hops": """WITH RECURSIVE q AS (SELECT 's' || (l_suppkey % 10) AS s, 't' || (p_size % 4) AS t, 'm' || (l_linenumber % 2) AS m, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
edge AS (SELECT caller, callee, CAST(sum(q) AS DOUBLE) AS micros FROM (SELECT s AS caller, t AS callee, q FROM q UNION ALL SELECT t, m, q FROM q UNION ALL SELECT m, 'sink', q FROM q
  UNION ALL SELECT m, 't1', q FROM q WHERE m = 'm0' AND t = 't1') GROUP BY 1, 2),
up AS (SELECT caller, callee, micros / sum(micros) OVER (PARTITION BY callee) AS ratio FROM edge WHERE callee IN ('t0', 't1', 't2', 'm0', 'm1')),
climb(node, micros, hopped, path, depth) AS (SELECT caller, micros, false, CAST([] AS VARCHAR[]), 0 FROM edge WHERE callee = 'sink'
  UNION ALL SELECT u.caller, c.micros * u.ratio, true, list_append(c.path, c.node), c.depth + 1 FROM climb c JOIN up u ON u.callee = c.node WHERE NOT list_contains(c.path, c.node) AND c.depth < 16)
SELECT node AS key, round(sum(micros), 3) AS total_micros, bool_or(hopped) AS hopped FROM climb WHERE node NOT IN (SELECT callee FROM up) OR list_contains(path, node) OR depth >= 16 GROUP BY 1""",
    "package_breakdown": breakdown(members("functions", "function", "package = 'app:src/services'") + " UNION ALL " + members("files", "file", "package = 'app:src/services'") + " UNION ALL " + ends_in("package", "app:src/services")),
    "file_breakdown": breakdown(members("functions", "function", "file = '(native)'") + " UNION ALL " + ends_in("file", "(native)")),
    "context_breakdown": context_breakdown(), "context_breakdown_filtered": context_breakdown("category IN ('user', 'node_modules')", True),
    "asof_label": """WITH p AS (SELECT user_id, ts, max(event_id) AS context FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.context FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "sample_clock": f"WITH {EVENTS} SELECT profile_id, CAST(i AS INTEGER) AS i, CAST(1000 + sum(d) OVER (PARTITION BY profile_id ORDER BY i) AS BIGINT) AS clock FROM s",
}
