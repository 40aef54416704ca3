"""SQL of the price, capture, link and claim queries, for a second engine."""
from __future__ import annotations

from attesta import constants as K
from attesta.operators.claims import ANCHORED_FIELDS, QUOTED_FIELDS
from attesta.plans import views as W
from attesta.plans.queries_evidence import FIELD_ORDER
from attesta.plans.sqltext import (PRICE, bare, clean_lines, domain, engine_rank, has, host, ins, is_custom, is_free,
                                   last_seg, lit, norm, path, period, pick, price_key, quality, query, rep, segs, strs,
                                   sufficient, url_type)

AS_OF = f"TIMESTAMP '{W.AS_OF}'"
O: dict[str, str] = {}

# ------------------------------------------------------------------ prices
O["price_votes"] = query(["votes"], "SELECT p_partkey, price_key, votes, independent_votes, engines, token FROM votes")
O["price_verified"] = query(["votes"], """
SELECT p_partkey, max(votes) AS votes, max(independent_votes) AS independent_votes, max(votes) >= 2 AS cross_validated,
  max(independent_votes) >= 2 AS verified,
  CASE WHEN max(independent_votes) >= 2 THEN 'ok' WHEN max(votes) >= 2 THEN 'same content captured twice' ELSE 'no agreement' END AS reason
FROM votes GROUP BY p_partkey""")
_PP = """SELECT p_partkey, p_brand AS vendor, (p_partkey % 3 = 0 AND p_brand <> 'Brand#1') AS is_price FROM part"""
_TOK = f"""
  SELECT vendor, engine, CASE WHEN any_price THEN sum(CASE WHEN is_price THEN n ELSE 0 END) ELSE sum(n) END::BIGINT AS tokens FROM (
    SELECT p.vendor, engine, is_price, len(regexp_extract_all(text, {lit(PRICE)})) AS n,
      bool_or(is_price) OVER (PARTITION BY p.vendor) AS any_price FROM ptext JOIN pp p USING (p_partkey))
  GROUP BY vendor, engine, any_price"""
O["tokens_per_engine"] = query(["ptext"], "SELECT * FROM tok", {"pp": _PP, "tok": _TOK})
O["price_forms"] = query(["tier"], f"""
SELECT ord, {period('period')} AS channel, {is_free('plan', 'price')} AS is_free, {is_custom('plan', 'price')} AS is_custom,
  {has('price', K.PRICE_STATEMENT)} AS is_statement, {rep('price', '[^0-9.]', '')} AS digits,
  (trim(period) <> '' AND NOT {has('period', K.AUDIT_ANNUAL)} AND {has('trim(period)', K.AUDIT_MONTHLY)}) AS is_monthly,
  {has('period', K.AUDIT_ANNUAL)} AS is_annual FROM tier""")
_NP = f"({is_free('plan', 'price')} OR {is_custom('plan', 'price')})"
_PROB = f"""
  SELECT *, {_NP} AS no_period, NOT {_NP} AND price <> '' AND {has('price', PRICE)} AS paid,
    CASE WHEN {_NP} AND trim(period) NOT IN ('—', '', '/user', '/seat') THEN 'free or custom plan with a period'
      WHEN NOT {_NP} AND {has('price', PRICE)} THEN CASE WHEN trim(period) = '' THEN 'paid plan without a period' END
      WHEN NOT {_NP} AND price <> '' AND price <> '—' AND NOT contains(price, '未能提取') THEN 'price without currency' END AS problem
  FROM tier"""
O["tier_problems"] = query(["tier"], "SELECT ord, vendor, problem FROM prob WHERE problem IS NOT NULL", {"prob": _PROB})
O["price_sufficiency"] = query(["tier", "ptext"], """
SELECT vendor, tiers, paid, unpriced, bad_lines, engines, problems, problems = '' AS sufficient FROM (
  SELECT vendor, tiers, paid, unpriced, bad_lines, engines, concat_ws('; ',
    CASE WHEN bad_lines > 0 THEN 'faulty price lines' END, CASE WHEN tiers = 0 THEN 'no plans' END,
    CASE WHEN tiers > 0 AND paid = 0 AND unpriced = 0 THEN 'neither paid nor free plan' END,
    CASE WHEN paid > 0 AND engines < 2 THEN 'fewer than two engines' END) AS problems
  FROM (SELECT p.vendor, count(*) AS tiers, count(*) FILTER (paid) AS paid, count(*) FILTER (no_period) AS unpriced, count(problem) AS bad_lines,
          coalesce((SELECT count(*) FROM tok WHERE tok.vendor = p.vendor AND tokens > 0), 0) AS engines FROM prob p GROUP BY p.vendor))""",
                                {"pp": _PP, "tok": _TOK, "prob": _PROB})
_AMT = lambda c: f"CAST(nullif(replace(regexp_extract({c}, '([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', ''), '') AS DECIMAL(18,4))::DOUBLE"
O["plan_savings"] = query(["tier"], f"""
SELECT vendor, plan, monthly, billed, annual, fr IS NOT NULL AND (pd IS NULL OR fr < pd) AS is_free,
  cu IS NOT NULL AND (pd IS NULL OR cu < pd) AS is_custom,
  CAST(CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN CASE WHEN a > 0 AND round_even((1 - a / (m * 12)) * 100, 0) > 0 THEN round_even((1 - a / (m * 12)) * 100, 0) END
    WHEN m IS NOT NULL AND b IS NOT NULL AND b > 0 AND b < m AND round_even((1 - b / m) * 100, 0) > 0 THEN round_even((1 - b / m) * 100, 0) END AS INT) AS save_pct,
  CASE WHEN m IS NOT NULL AND a > 0 THEN round_even(a / 12, 1) END AS monthly_equivalent
FROM (SELECT *, {_AMT('monthly')} AS m, {_AMT('billed')} AS b, {_AMT('annual')} AS a FROM (
  SELECT vendor, plan, arg_min(price, ord) FILTER (per = '/mo') AS monthly, arg_min(price, ord) FILTER (per = 'billed') AS billed,
    arg_min(price, ord) FILTER (per = '/yr') AS annual, min(ord) FILTER (per IN ('/mo', '/yr')) AS pd,
    min(ord) FILTER (per IN ('', '—') AND lower(price) IN {ins(K.PLAN_FREE_PRICES)}) AS fr,
    min(ord) FILTER (per IN ('', '—') AND lower(price) NOT IN {ins(K.PLAN_FREE_PRICES)} AND price NOT IN ('', '—')) AS cu
  FROM (SELECT vendor, plan, ord, price, {period('period')} AS per FROM tier) GROUP BY vendor, plan))""")
_BLOB = "lower(concat_ws(' ', plan, price, period))"
O["commercial_model"] = query(["tier"], f"""
SELECT vendor, CASE WHEN f IS NULL THEN '未公开' WHEN f AND (m OR y) THEN '免费增值(Freemium + 订阅)' WHEN c AND NOT m AND NOT y THEN '企业定制(Enterprise Only)'
  WHEN m OR y THEN 'SaaS 订阅(月付/年付)' ELSE '订阅制(细节见定价)' END AS model FROM (
  SELECT vendor, bool_or(regexp_matches({_BLOB}, '/月|/mo|month')) AS m, bool_or(regexp_matches({_BLOB}, '/年|/yr|year|annual')) AS y,
    bool_or(regexp_matches({_BLOB}, '免费|free|trial')) AS f, bool_or(regexp_matches({_BLOB}, '联系销售|contact sales|enterprise|custom')) AS c
  FROM tier GROUP BY vendor) RIGHT JOIN (SELECT DISTINCT p_brand AS vendor FROM part UNION SELECT n_name FROM nation) USING (vendor)""")
O["vendor_price_display"] = query(["tier"], """
SELECT vendor, coalesce(segments, 0) AS segments, coalesce(price, '未公开') AS price FROM (
  SELECT vendor, count(*) AS segments, string_agg(seg, ' / ' ORDER BY ord) AS price FROM (
    SELECT vendor, CASE WHEN price <> '—' THEN price || CASE WHEN period NOT IN ('—', '') THEN '·' || period ELSE '' END ELSE plan END AS seg, min(ord) AS ord
    FROM tier GROUP BY 1, 2) GROUP BY vendor)
RIGHT JOIN (SELECT DISTINCT p_brand AS vendor FROM part UNION SELECT n_name FROM nation) USING (vendor)""")
O["price_display"] = query(["tier"], """
SELECT vendor, plan, string_agg(seg, '|' ORDER BY ord) AS segments FROM (
  SELECT vendor, plan, seg, min(ord) AS ord FROM (
    SELECT *, CASE WHEN price <> '—' THEN price || CASE WHEN period NOT IN ('—', '') THEN '·' || period ELSE '' END ELSE plan END AS seg FROM tier)
  GROUP BY vendor, plan, seg) GROUP BY vendor, plan""")
O["price_lines"] = """
SELECT p_partkey AS vendor, 0 AS ord, p_type || ' plan' AS plan, '$' || printf('%.2f', p_retailprice) AS price, 'annually' AS period FROM part
UNION ALL SELECT p_partkey, 1, '—', 'Free', '—' FROM part UNION ALL SELECT p_partkey, 2, p_name, '—', '—' FROM part UNION ALL SELECT p_partkey, 3, '—', '—', '—' FROM part"""
O["cached_price"] = """
SELECT id, domain, cached_url, true AS from_cache FROM (
  SELECT w.event_id AS id, 'd' || w.user_id || '.test' AS domain, 'https://cache.test/' || c.event_id AS cached_url,
    row_number() OVER (PARTITION BY w.event_id ORDER BY c.ts DESC, 'https://cache.test/' || c.event_id DESC) AS rn
  FROM events w JOIN events c ON w.user_id = c.user_id AND c.event_type = 'purchase' AND c.event_id % 4 >= 2 AND c.ts <= w.ts
    AND epoch(w.ts) - epoch(c.ts) <= 14 * 86400
  WHERE w.event_type = 'error') WHERE rn = 1"""

# ------------------------------------------------------------------ captures
O["capture_meta"] = query(["hashed"], f"SELECT page_id, engine, chars, content_hash, {domain(host('url'))} AS domain FROM hashed")
O["capture_quality"] = query(["cap"], f"""SELECT page_id, engine, round({quality('text')}, 6) AS quality,
  {sufficient('text', 200)} AS sufficient, {sufficient('text', 300)} AS sufficient_300 FROM cap""")
_SCORED = f"SELECT page_id, url, engine, text, {quality('text')} AS q, length(text) AS chars, ({url_type('url')} <> 'pricing' OR {has('text', PRICE)}) AS priced FROM cap"
O["capture_primary"] = query(["cap"], f"""
SELECT page_id, engine, round(q, 6) AS quality, chars FROM (SELECT *, row_number() OVER (PARTITION BY page_id
  ORDER BY priced DESC, q >= 0.5 DESC, {engine_rank('engine')}, q DESC, chars DESC) AS rn FROM scored) WHERE rn = 1""", {"scored": _SCORED})
_CODEFREE = (f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {has('l', K.SCRIPT_LINE)} AND NOT {has('l', K.STYLE_LINE)}), chr(10))")
O["capture_lines"] = query(["cap"], f"""
SELECT page_id, engine, len(ls)::INT AS lines, md5(array_to_string(ls, '|')) AS digest, code_free FROM (
  SELECT page_id, engine, {clean_lines('text')} AS ls, md5({_CODEFREE}) AS code_free FROM cap)""")
_ENG = "string_agg(engine || ':' || chars || ':' || content_hash, ' ' ORDER BY engine)"
O["ledger_build"] = query(["led", "hashed"], f"""
SELECT l.url, l.status, array_to_string(list_sort(l.kinds), '/') AS kinds, l.fetched_at, (l.status = 'ok' AND l.page_id % 7 = 0) AS from_cache,
  coalesce(CASE WHEN l.status = 'ok' THEN (SELECT {_ENG} FROM hashed h WHERE h.page_id = l.page_id) END, '') AS engines FROM led l""")
O["failure_rows"] = query(["led"], "SELECT vendor, url, unnest(kinds) AS kind, 'timeout' AS error FROM led WHERE status = 'failed'")
O["ledger_merge"] = query(["led", "hashed"], f"""
SELECT l.url, l.status, array_to_string(list_sort(list_distinct(list_append(l.kinds, 'changelog'))), '/') AS kinds, '2024-03-01 08:30 UTC' AS fetched_at,
  (l.status = 'ok' AND l.page_id % 7 = 0) AS from_cache,
  coalesce(CASE WHEN l.status = 'ok' THEN (SELECT {_ENG} FROM hashed h WHERE h.page_id = l.page_id) END, '') AS engines FROM led l""")
O["merged_text"] = query(["cap", "led"], f"""
SELECT url, length(s) AS chars, md5(s) AS digest FROM (
  SELECT b.url, '# Kind: ' || array_to_string(l.kinds, '/') || chr(10) || '# Source: ' || b.url || chr(10) || '# Scrapers: jina,playwright,trafilatura'
    || chr(10) || '# Time: ' || l.fetched_at || chr(10) || chr(10) || b.text AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priced DESC, q >= 0.5 DESC, {engine_rank('engine')}, q DESC, chars DESC) AS rn FROM scored) b
  JOIN led l USING (url) WHERE rn = 1 AND l.status = 'ok')""", {"scored": _SCORED})
_QUOTABLE = (f"length(s) BETWEEN 35 AND 130 AND NOT contains(s, 'http') AND NOT contains(s, '](') AND len(regexp_extract_all(s, {lit(K.SCRIPT_SWITCH)})) < 2 "
             f"AND NOT {has('s', PRICE)} AND len(regexp_extract_all(s, '[一-鿿 a-zA-Z0-9]')) >= length(s) * 0.7::DOUBLE AND ({has('s', K.SENTENCE_END)} OR starts_with(s, '#'))")
O["safe_quotes"] = query(["cap"], f"""
SELECT page_id, quote, CAST(nth AS INT) AS nth FROM (
  SELECT page_id, quote, row_number() OVER (PARTITION BY page_id ORDER BY r, pos) AS nth FROM (
    SELECT page_id, s AS quote, min(rk * 1000000 + pos) // 1000000 AS r, min(rk * 1000000 + pos) % 1000000 AS pos FROM (
      SELECT page_id, {engine_rank('engine')} AS rk, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos, flat, bare FROM (
        SELECT page_id, engine, {clean_lines('text')} AS ls, {norm('text')} AS flat, {bare('text')} AS bare FROM cap))
    WHERE {_QUOTABLE} AND (contains(flat, s) OR contains(bare, s)) GROUP BY page_id, s)) WHERE nth <= 3""")
_FOUND = " UNION ALL ".join(f"SELECT {k} AS pid, url, engine, s, rk, pos FROM line WHERE {cond}" for k, cond in enumerate([
    "regexp_matches(s, '[0-9]{2,}')", "regexp_matches(lower(s), 'price|plan')", "regexp_matches(lower(s), '\\bthe\\b.*[.]$')", "regexp_matches(lower(s), 'er.+and')"]))
O["line_search"] = query(["cap"], """
SELECT pid, url, row_number() OVER (PARTITION BY pid, url ORDER BY rk, engine, pos) AS nth, engine, md5(s) AS line FROM (
  SELECT pid, url, s, min(rk) AS rk, arg_min(engine, rk * 1000000 + pos) AS engine, min(rk * 1000000 + pos) AS pos FROM (
    SELECT * FROM f WHERE EXISTS (SELECT 1 FROM form WHERE form.url = f.url AND (contains(flat, f.s) OR contains(bare, f.s)))) GROUP BY pid, url, s)""", {
    "form": f"SELECT url, {norm('text')} AS flat, {bare('text')} AS bare FROM cap",
    "line": f"""SELECT url, engine, {engine_rank('engine')} AS rk, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos FROM (
        SELECT url, engine, {clean_lines('text')} AS ls FROM cap)""", "f": _FOUND})
O["number_windows"] = """
WITH p AS (SELECT doc_id, length(text) AS n, string_split_regex(text, '[0-9]+') AS gap, regexp_extract_all(text, '[0-9]+') AS tok FROM documents),
m AS (SELECT doc_id, n, unnest(list_transform(tok, lambda t: length(t))) AS size, unnest(list_transform(gap[:-2], lambda g: length(g))) AS gap,
  generate_subscripts(tok, 1) AS pos FROM p WHERE len(tok) > 0),
a AS (SELECT doc_id, n, size, gap + coalesce(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM m),
w AS (SELECT doc_id, greatest(0, p0 - 120) AS s, least(n, p0 + size + 120) AS e FROM a),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 64 THEN 0 ELSE 1 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS window_no FROM f)
SELECT doc_id, window_no::BIGINT AS window_no, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*) AS matches FROM g GROUP BY doc_id, window_no"""
O["window_texts"] = """
WITH p AS (SELECT doc_id, text, length(text) AS n, string_split_regex(text, '[0-9]+') AS gap, regexp_extract_all(text, '[0-9]+') AS tok FROM documents),
m AS (SELECT doc_id, text, n, unnest(list_transform(tok, lambda t: length(t))) AS size, unnest(list_transform(gap[:-2], lambda g: length(g))) AS gap,
  generate_subscripts(tok, 1) AS pos FROM p WHERE len(tok) > 0),
a AS (SELECT doc_id, text, n, size, gap + coalesce(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM m),
w AS (SELECT doc_id, text, greatest(0, p0 - 120) AS s, least(n, p0 + size + 120) AS e FROM a),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 64 THEN 0 ELSE 1 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS window_no FROM f)
SELECT doc_id, window_no::BIGINT AS window_no, md5(substring(any_value(text), min(s)::BIGINT + 1, (max(e) - min(s))::BIGINT)) AS digest FROM g GROUP BY doc_id, window_no"""
# the budget is a fold over the matches of a text, then a few rounds that give the head what is left
O["focused_texts"] = """
WITH RECURSIVE p AS (SELECT doc_id, text, length(text) AS n, string_split_regex(text, '[0-9]+|,[^,.\n]{90,}') AS gap,
    regexp_extract_all(text, '[0-9]+|,[^,.\n]{90,}') AS tok FROM documents),
m AS (SELECT doc_id, unnest(list_transform(tok, lambda t: length(t))) AS size, unnest(list_transform(gap[:-2], lambda g: length(g))) AS gap,
  generate_subscripts(tok, 1) AS pos FROM p WHERE len(tok) > 0 AND n > 2000),
a AS (SELECT doc_id, pos, size, gap + coalesce(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM m),
b AS (SELECT doc_id, n, k, budget, greatest(120, (budget - matched) // (2 * k)) AS ctx FROM (
  SELECT a.doc_id, any_value(p.n) AS n, count(*) AS k, greatest(1200, count(*) * 260) AS budget, sum(size) AS matched FROM a JOIN p ON a.doc_id = p.doc_id GROUP BY a.doc_id)),
fold(doc_id, pos, spans, dropped) AS (
  SELECT doc_id, 0::BIGINT, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), 0 FROM b
  UNION ALL
  SELECT doc_id, pos,
    CASE WHEN over THEN spans
      WHEN len(spans) > 0 AND s <= spans[-1].e + 64 THEN list_append(spans[:-2], {'s': spans[-1].s, 'e': greatest(spans[-1].e, e)})
      ELSE list_append(spans, {'s': s, 'e': e}) END,
    dropped + CASE WHEN over THEN 1 ELSE 0 END FROM (
    SELECT f.doc_id, a.pos, f.spans, f.dropped, greatest(0, p0 - ctx)::BIGINT AS s, least(b.n, p0 + size + ctx)::BIGINT AS e,
      coalesce(list_sum(list_transform(f.spans, lambda x: x.e - x.s)), 0) + size + 2 * ctx > budget + 64 * len(f.spans) AS over
    FROM fold f JOIN a ON a.doc_id = f.doc_id AND a.pos = f.pos + 1 JOIN b ON b.doc_id = f.doc_id)),
whole AS (SELECT f.doc_id, f.spans, f.dropped FROM fold f JOIN b ON b.doc_id = f.doc_id AND b.k = f.pos),
grow(doc_id, round, head, spans) AS (
  SELECT doc_id, 0, 300::BIGINT, spans FROM whole
  UNION ALL
  SELECT doc_id, round + 1, greatest(head, greatest(300, least(1500 - coalesce(list_sum(list_transform(list_filter(spans, lambda x: x.e > head),
      lambda x: x.e - greatest(x.s, head))), 0) - 128 * greatest(len(list_filter(spans, lambda x: x.e > head)), 1), 1500)))::BIGINT, spans
  FROM grow WHERE round < 4),
h AS (SELECT g.doc_id, g.head, w.dropped, list_transform(list_filter(g.spans, lambda x: x.e > g.head), lambda x: {'s': greatest(x.s, g.head), 'e': x.e}) AS spans
  FROM grow g JOIN whole w ON w.doc_id = g.doc_id WHERE g.round = 4),
t AS (
  SELECT p.doc_id, CASE WHEN p.n <= 2000 THEN p.n WHEN h.doc_id IS NULL THEN 1500 ELSE h.head END AS head,
    coalesce(len(h.spans), 0) AS kept, coalesce(h.dropped, 0) AS dropped,
    CASE WHEN p.n <= 2000 THEN text
      WHEN h.doc_id IS NULL THEN left(text, 1500) || mid || right(text, 500)
      ELSE left(text, h.head) || chr(10) || chr(10) || '[... 截断:以下为关键内容保窗 ...]' || chr(10) || chr(10)
        || coalesce(array_to_string(list_transform(h.spans, lambda x: substring(text, x.s + 1, x.e - x.s)), E'\\n\\n[... 中间内容已截断 ...]\\n\\n'), '') || mid
        || CASE WHEN h.dropped > 0 THEN '[... 另有 ' || h.dropped || ' 个关键 token 窗口超出保留预算被丢弃 ...]' || chr(10) || chr(10) ELSE '' END || right(text, 500) END AS c
  FROM (SELECT *, chr(10) || chr(10) || '[... 中间内容已截断 ...]' || chr(10) || chr(10) AS mid FROM p) p LEFT JOIN h ON h.doc_id = p.doc_id)
SELECT doc_id, head::INT AS head, kept::INT AS kept, dropped::INT AS dropped, length(c) AS chars, md5(c) AS digest FROM t"""
O["keep_ends"] = """
SELECT doc_id, length(c) AS chars, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 5000
  THEN left(text, 4000) || chr(10) || chr(10) || '[... 中间内容已截断 ...]' || chr(10) || chr(10) || right(text, 1000) ELSE text END AS c FROM documents)"""
O["variant_lines"] = """
SELECT p_partkey AS key, 'Pro plan $' || printf('%.2f', p_retailprice * 10) || ' per year' || chr(10) || 'Save with the annual plan' AS variant, 1 AS new_prices
FROM part WHERE p_partkey % 4 <> 0"""
_STATS = f"""
  SELECT engine, url_type, count(*) AS n, count(*) FILTER (success) AS ok, sum(quality)::DOUBLE AS q_sum,
    count(*) FILTER (success) / count(*)::DOUBLE * 0.6::DOUBLE + sum(quality)::DOUBLE / count(*) * 0.4::DOUBLE AS score
  FROM flog GROUP BY engine, url_type HAVING max(ts) >= {AS_OF} - INTERVAL 90 DAY"""
O["extractor_stats"] = query(["flog"], "SELECT engine, url_type, n, ok, q_sum, round(score, 6) AS score FROM st", {"st": _STATS})
_ROUTES = " UNION ALL ".join(f"SELECT {lit(t)} AS url_type, {lit(e)} AS engine, {i} AS place" for t, es in K.ROUTES.items() for i, e in enumerate(es))
O["extractor_order"] = query(["flog"], """
SELECT url_type, engine, CAST(row_number() OVER (PARTITION BY url_type ORDER BY w DESC, place DESC) AS INT) AS position FROM (
  SELECT r.url_type, r.engine, place, coalesce(score, 0.5::DOUBLE) * 0.7::DOUBLE + (1 - place * 0.15::DOUBLE) * 0.3::DOUBLE AS w
  FROM routes r LEFT JOIN st ON st.engine = r.engine AND st.url_type = r.url_type)""", {"st": _STATS, "routes": _ROUTES})
_LADDER = " UNION ALL ".join(f"SELECT {lit(t)} AS url_type, {strs(es)} AS ladder" for t, es in K.LADDER.items() if es)
O["next_engines"] = query(["flog"], """
SELECT url_type, day, CAST(generate_subscripts(rest, 1) - 1 AS INT) AS step, unnest(rest) AS next_engine FROM (
  SELECT u.url_type, u.day, list_filter(ladder, lambda e: NOT list_contains(used, e)) AS rest FROM (
    SELECT url_type, ts::DATE AS day, coalesce(list(engine) FILTER (success AND quality >= 1), []) AS used FROM flog GROUP BY 1, 2) u
  JOIN ladder USING (url_type))""", {"ladder": _LADDER})

# ------------------------------------------------------------------ urls and links
_SECTIONS = ["/docs", "/docs/start", "/pricing/", "/en/pricing", "/plans?x=1", "/prices#top", "/about-us", "/blog/a/b", "/integrations",
             "/features/inbox", "/customer-stories/x", "/changelog", "", "/a/page/2", "/marketplace/app", "/lp/our-pricing-news"]
_LABEL = "CASE WHEN lower(u) = '' THEN '来源' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(u), {lit(p)})" for p in ps) + f" THEN {lit(n)}" for ps, n in K.SOURCE_LABELS) + " ELSE '官网页面' END"
O["url_types"] = query([], f"""WITH s AS (SELECT page_id, url AS u FROM pages UNION ALL
  SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || {pick('page_id', _SECTIONS)} FROM pages)
SELECT page_id, u, {url_type('u')} AS url_type,
  len(list_filter({segs(path('u'))}, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND lower(x) NOT IN ('page', 'pages')))::INT AS depth,
  ({last_seg('u')} = '' OR {last_seg('u')} IN {ins(K.PRICE_PAGE_SEGMENTS)}) AS price_page,
  ({last_seg('u')} = '' OR {last_seg('u')} IN {ins(K.AUDIT_PRICE_PAGE_SEGMENTS)}) AS audit_price_page,
  CASE WHEN {last_seg('u')} = 'pricing' THEN 'pricing' WHEN {last_seg('u')} = '' THEN 'root' ELSE '' END AS anchor,
  {domain(host('u'))} AS domain, {_LABEL} AS label, left(md5(u), 8) AS tag FROM s""")
O["safe_urls"] = """
SELECT page_id, form, safe, web, target FROM (
  SELECT page_id, 0 AS form, url AS safe, true AS web, url AS target FROM pages UNION ALL
  SELECT page_id, 1, '', false, 'javascript:' || url FROM pages UNION ALL
  SELECT page_id, 2, '#p' || page_id, false, '#p' || page_id FROM pages UNION ALL
  SELECT page_id, 3, '', false, url FROM pages)"""
_LINK = r"(?:^|[^!])\[([^\]\[]{2,40})\]\(([^)#\s]+)\)"
_FOLDER = r"CASE WHEN regexp_matches(rtrim(url, '/'), '[?#]') THEN regexp_replace({p}, '[^/]*$', '') ELSE {p} || '/' END".replace("{p}", path("rtrim(url, '/')"))
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_RAW = f"""
  SELECT page_id, engine, url, pos, trim(label) AS label, CASE WHEN regexp_matches(href, '^https?:') THEN href
      ELSE {_ORIGIN} || replace(CASE WHEN starts_with(href, '/') THEN href ELSE {_FOLDER} || href END, '/x/../', '/') END AS full_url
  FROM (SELECT page_id, engine, url, unnest(regexp_extract_all(text, {lit(_LINK)}, 1)) AS label, unnest(regexp_extract_all(text, {lit(_LINK)}, 2)) AS href,
          generate_subscripts(regexp_extract_all(text, {lit(_LINK)}, 1), 1) AS pos FROM cap)
  WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:)')"""
_GOOD = f"""
  SELECT *, regexp_replace(full_url, '[?#].*$', '') AS link, regexp_replace(replace(full_url, rtrim(url, '/'), ''), '[?].*$', '') AS place FROM raw
  WHERE {domain(host('full_url'))} = {domain(host('url'))} AND NOT {has("regexp_replace(full_url, '[?#].*$', '')", K.RESOURCE_SUFFIX)}"""
_SHALLOW = f"len(list_filter({segs(path('link'))}, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND lower(x) NOT IN ('page', 'pages'))) <= 2"
_HITS = " UNION ALL ".join(
    f"SELECT *, {lit(k)} AS kind FROM good WHERE ({has('label', rx)} OR {has('place', rx)})" + (f" AND {_SHALLOW}" if k in K.SHALLOW_KINDS else "")
    for k, rx in K.LINK_KINDS)
_DISC = "SELECT page_id, engine, url, kind, arg_min(link, pos) AS link, min(pos) AS pos FROM hits GROUP BY page_id, engine, url, kind"
_L = {"raw": _RAW, "good": _GOOD, "hits": _HITS, "disc": _DISC}
O["page_links"] = query(["cap"], "SELECT page_id, engine, kind, link FROM disc", _L)
_GENUINE = lambda u: f"({last_seg(u)} = '' OR {last_seg(u)} IN {ins(K.PRICE_PAGE_SEGMENTS)})"
O["link_targets"] = query(["cap"], f"""
SELECT host, kind, target FROM (
  SELECT coalesce(g.host, f.host) AS host, coalesce(g.kind, f.kind) AS kind, base,
    CASE WHEN coalesce(g.kind, f.kind) = 'pricing' AND guess IS NOT NULL AND link IS NOT NULL AND {_GENUINE('guess')} AND NOT {_GENUINE('link')}
      THEN guess ELSE coalesce(link, guess) END AS target
  FROM (SELECT DISTINCT 'https://' || h AS base, h AS host, kind, 'https://' || h || p AS guess
        FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages), (VALUES ('pricing', '/pricing'), ('features', '/features'), ('docs', '/docs')) v(kind, p)) g
  FULL JOIN (SELECT host, kind, link FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, kind, link,
      row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1), kind ORDER BY {engine_rank('engine')}, url, pos) AS rn FROM disc) WHERE rn = 1) f
  ON g.host = f.host AND g.kind = f.kind)
WHERE target <> coalesce(base, '')""", _L)
O["robots_allowed"] = f"""
SELECT page_id FROM (SELECT page_id, coalesce(nullif({path('url')}, ''), '/') AS p, length(regexp_extract(url, '^https?://([^/]+)', 1)) % 3 AS k FROM pages)
WHERE NOT (k = 0 OR (k = 1 AND starts_with(p, '/en/')) OR (k = 2 AND starts_with(p, '/fr/')))"""
O["extra_urls"] = "SELECT 'V' AS vendor, 'docs' AS kind, url || '/more' AS url FROM pages WHERE page_id % 4 = 1 AND url || '/more' NOT IN (SELECT url FROM pages)"

# ------------------------------------------------------------------ claims and gates
O["claims_flat"] = query(["claims"], "SELECT vendor, field, CAST(idx AS INT) AS idx, source_url, md5(quote || '|' || statement) AS digest FROM claims")
_POS = f"list_position({strs(FIELD_ORDER)}, field)"
O["evidence_urls"] = query(["cited"], f"""
SELECT vendor, source_url, CAST(k.p AS INT) AS ord, CAST(k.i AS INT) AS idx FROM (
  SELECT vendor, source_url, min({{'p': {_POS}, 'i': idx}}) AS k FROM cited GROUP BY vendor, source_url)""")
_VC = "vendor, field, CAST(idx AS INT) AS idx, source_url"
_G1 = f"""
  SELECT 'G1' AS gate, 'hard' AS severity, {_VC}, CASE WHEN l.url IS NULL THEN 'not captured' ELSE 'capture failed' END AS detail
  FROM cited LEFT JOIN (SELECT url, status FROM led) l ON l.url = source_url WHERE l.url IS NULL OR l.status <> 'ok'"""
_CN = f"SELECT url, {norm('text')} AS flat, {bare('text')} AS bare FROM cap"
_G2 = f"""
  SELECT 'G2' AS gate, 'hard' AS severity, {_VC}, 'quote not found' AS detail FROM claims c
  WHERE source_url <> '' AND quote <> '' AND field IN {ins(QUOTED_FIELDS)} AND {norm('quote')} <> ''
    AND NOT EXISTS (SELECT 1 FROM cn WHERE cn.url = c.source_url AND (contains(flat, {norm('c.quote')}) OR contains(bare, {norm('c.quote')})))"""
_WEB = "regexp_matches(source_url, '(?i)^https?://[^/?#]+')"
_G6 = f"""
  SELECT 'G6' AS gate, CASE WHEN {_WEB} THEN 'warning' ELSE 'hard' END AS severity, {_VC},
    CASE WHEN {_WEB} THEN 'other domain' ELSE 'malformed url' END AS detail
  FROM cited WHERE NOT {_WEB} OR {domain(host('source_url'))} <> {domain(host('vendor_url'))}"""
_G7 = f"""
  SELECT 'G7' AS gate, CASE WHEN field = 'user_feedback' THEN 'warning' ELSE 'hard' END AS severity, {_VC}, 'weak anchor' AS detail
  FROM cited WHERE field IN {ins(ANCHORED_FIELDS)} AND NOT {has('statement', K.PRICE_STATEMENT)}
    AND ({last_seg('source_url')} = 'pricing' OR ({last_seg('source_url')} = '' AND regexp_extract(source_url, '^[a-zA-Z]+://([^/?#]*)', 1) <> ''))"""
O["claims_traceable"] = query(["cited", "led"], _G1)
O["quotes_found"] = query(["claims", "cap"], _G2, {"cn": _CN})
O["quotes_anywhere"] = f"""
SELECT item_id, doc_id FROM (SELECT item_id, {norm('text')} AS q FROM benchmark), (SELECT doc_id, {norm('text')} AS t FROM documents) WHERE contains(t, q)"""
_ENGINES = "CASE WHEN page_id % 8 = 0 THEN ['playwright'] ELSE ['playwright', 'trafilatura'] END"
_VER = f"""
  SELECT vendor, url AS source_url, unnest(list_filter([
      CASE WHEN NOT EXISTS (SELECT 1 FROM pt WHERE pt.page_id = pg.page_id) THEN 'no tiers' END,
      CASE WHEN (SELECT count(DISTINCT content_hash) FROM hashed h WHERE h.page_id = pg.page_id AND chars > 0 AND list_contains({_ENGINES.replace('page_id', 'pg.page_id')}, engine)) < 2 THEN 'not independent' END,
      CASE WHEN page_id % 17 = 0 OR epoch({AS_OF}) - epoch(TIMESTAMP '2024-01-01 08:30:00' + to_days(CAST(page_id % 40 AS INT))) > 14 * 86400 THEN 'stale' END], lambda x: x IS NOT NULL)) AS detail
  FROM pg WHERE page_id % 2 = 0 AND page_id % 9 <> 0"""
O["verified_prices"] = query(["pg", "pt", "hashed"], _VER)
O["silent_failures"] = query(["led", "fail"], "SELECT url FROM led WHERE status = 'failed' AND url NOT IN (SELECT url FROM fail)")
_G4 = """
  SELECT 'G4' AS gate, 'hard' AS severity, '' AS vendor, 'failures' AS field, 0 AS idx, url AS source_url, 'silent failure' AS detail
  FROM led WHERE status = 'failed' AND url NOT IN (SELECT url FROM fail)
  UNION ALL SELECT 'G4', 'hard', vendor, 'founded', 0, url, 'missing value with a source' FROM pg WHERE page_id % 4 = 0 AND page_id % 3 = 0
  UNION ALL SELECT 'G4', 'hard', vendor, 'headquarters', 0, url, 'missing value with a source' FROM pg WHERE page_id % 5 = 0 AND page_id % 7 = 0
  UNION ALL SELECT 'G4', 'hard', vendor, 'team_size', 0, '/about', 'missing value with a source' FROM pg WHERE page_id % 19 = 0
  UNION ALL SELECT 'G4', 'hard', vendor, 'tagline', 0, url, 'missing value with a source' FROM pg WHERE page_id % 6 = 0 OR h1 IN ('', '—')"""
O["honest_gaps"] = query(["led", "fail", "pg"], _G4)


def _strings(best: str, hq: str) -> str:
    one = lambda path_, val, src="pg": f"SELECT vendor, {lit(path_)} AS field, {val} AS v FROM {src}"
    doc = lambda k: f"pg JOIN dl USING (page_id) WHERE slot = {k}"
    return " UNION ALL ".join([
        one("tagline", "CASE WHEN page_id % 6 = 0 THEN '' ELSE h1 END"), one("headquarters", hq), one("feature_best_for", best),
        one("strengths[].evidence", "'官网原文: \"' || h1 || '\"'"), one("strengths[].evidence", "line", doc(0)), one("strengths[].point", "line", doc(0)),
        one("weaknesses[].point", "CASE WHEN doc_id % 8 = 1 THEN '' ELSE line END", doc(1)), one("weaknesses[].evidence", "line", doc(1)),
        one("differentiators[].quote", "line", doc(2)), one("tech_signals[].quote", "line", doc(3)),
        one("gtm_evidence[].quote", "b.text", "pg JOIN benchmark b ON b.item_id = page_id"), one("moat_evidence[].quote", "h1", "pg WHERE page_id % 4 = 0"),
        one("user_feedback[].text", "opening", "pg JOIN talk USING (page_id)"), one("user_feedback[].quote", "opening", "pg JOIN talk USING (page_id)"),
        one("feature_catalog[].quote", "CASE WHEN p_partkey % 3 = 0 THEN h1 ELSE '' END", "pg JOIN pt USING (page_id)"),
        one("product_momentum[].title", "h1", "pg WHERE page_id % 3 = 0"), one("feature_conclusion_points[].text", "h1", "pg WHERE page_id % 2 = 1"),
        one("pricing_vote_detail[].line", "h1", "pg WHERE page_id % 5 = 0"), one("pricing_vote_detail[].raw_line", "h1", "pg WHERE page_id % 5 = 0")])


_LEAK = r"""\['|\{"|"&#39;|\{'name':"""
_G5 = f"""SELECT 'G5' AS gate, vendor, field, CASE WHEN {has('v', K.FABRICATED)} THEN 'fabricated quote' ELSE 'program text' END AS detail
FROM strs WHERE {has('v', K.FABRICATED)} OR {has('v', _LEAK)}"""
_S5 = ["pg", "dl", "pt", "talk"]
_HQ = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Shanghai, China' WHEN 2 THEN 'Hong Kong' ELSE 'Berlin' END"
O["fabrication"] = query(_S5, _G5, {"strs": _strings(
    "CASE WHEN page_id % 7 = 5 THEN 'They say pricing gets EXPENSIVE at scale' ELSE 'teams' END",
    "CASE WHEN page_id % 6 = 3 THEN '{''name'': ''x''}' ELSE 'Berlin' END")})
O["placeholders"] = query(["pg", "dl"], f"""
SELECT DISTINCT 'G5' AS gate, vendor, 'weaknesses' AS field, 'placeholder' AS detail FROM pg JOIN dl USING (page_id)
WHERE slot = 1 AND (doc_id % 8 = 1 OR contains(line, {lit(K.PLACEHOLDER)}))""")
O["url_violations"] = query(["cited"], _G6 + " UNION ALL " + _G7)
_G8 = f"""
  SELECT vendor, idx, url AS source_url, 'illegal period' AS detail FROM ptier WHERE {period('trim(period)')} NOT IN {ins(K.VALID_PERIODS)}"""
O["structure_contract"] = query(["ptier"], _G8)
_N1 = f"""
  SELECT source_url, CASE WHEN p.url IS NULL OR http_status BETWEEN 200 AND 299 THEN 'warning' ELSE 'hard' END AS severity,
    CASE WHEN p.url IS NULL THEN 'not probed' WHEN http_status BETWEEN 200 AND 299 THEN 'redirected to another domain' ELSE 'unreachable' END AS detail
  FROM (SELECT DISTINCT source_url FROM cited)
  LEFT JOIN (SELECT url, arg_max(http_status, probed_at) AS http_status, arg_max(final_url, probed_at) AS final_url FROM probe GROUP BY url) p ON p.url = source_url
  WHERE p.url IS NULL OR NOT http_status BETWEEN 200 AND 299 OR {domain(host('source_url'))} <> {domain(host('final_url'))}"""
O["loose_structure"] = """
SELECT doc_id::VARCHAR AS vendor, 'hard' AS severity, 'target_users' AS field, 'not a list' AS detail FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id::VARCHAR, 'hard', 'differentiation', 'singular key' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id::VARCHAR, 'warning', 'pitch', 'missing' FROM documents WHERE doc_id % 2 <> 0
UNION ALL SELECT doc_id::VARCHAR, 'warning', 'evidence_urls', 'missing' FROM documents WHERE doc_id % 4 = 0"""
O["untyped_documents"] = """
WITH j AS (SELECT * FROM documents WHERE doc_id % 13 <> 0), v AS (SELECT * FROM j WHERE doc_id % 11 <> 0)
SELECT doc_id AS id, 'hard' AS severity, '' AS path, 'no JSON' AS detail FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'hard', 'competitors', 'must be a list, is string' FROM j WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'hard', 'competitors[0].pricing_tiers[0].billing_period', 'illegal period' FROM v WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'hard', 'competitors[0].feature_catalog.X[0]', 'must be an object, is string' FROM v WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'hard', 'opportunities[0].target_users', 'must be a list, is string' FROM j WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'warning', 'opportunities[0].moat', 'missing' FROM j WHERE coalesce(text, '') = ''
UNION ALL SELECT doc_id, 'warning', 'gaps[0]', 'old form' FROM j WHERE lang = 'en'
UNION ALL SELECT doc_id, 'warning', 'comparison_matrix', 'missing' FROM j WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'warning', 'feature_catalog', 'unified names: 0 of 1' FROM v WHERE doc_id % 7 <> 0 AND doc_id % 2 <> 0"""
O["loose_gaps"] = "SELECT doc_id::VARCHAR AS vendor, 'warning' AS severity, 'gap' AS field, 'old form' AS detail FROM documents WHERE lang = 'en'"
_UNESC = "regexp_replace(h, '<[^>]+>', ' ', 'g')"
for _e, _c in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
    _UNESC = f"replace({_UNESC}, {lit(_e)}, {lit(_c)})"
_SNAP = f"""
  SELECT url, {norm(_UNESC)} AS flat FROM (SELECT url, CASE WHEN page_id % 8 = 4 THEN regexp_replace(html, '<h1>[^<]*</h1>', '<h1>moved</h1>', 'g') ELSE html END AS h FROM pages)"""
_N2 = f"""
SELECT vendor, field, CAST(idx AS INT) AS idx, source_url FROM claims JOIN snap ON url = source_url
WHERE field IN ('gtm_evidence', 'moat_evidence') AND quote <> '' AND NOT contains(flat, {norm('quote')})"""
_ALL = {"cn": _CN, "strs": _strings("'teams'", _HQ), "g5": _G5, "g3": _VER, "g8": _G8,
        "rep": f"""SELECT gate, severity FROM ({_G1}) UNION ALL SELECT gate, severity FROM ({_G2}) UNION ALL SELECT gate, severity FROM ({_G6})
  UNION ALL SELECT gate, severity FROM ({_G7}) UNION ALL SELECT gate, severity FROM ({_G4}) UNION ALL SELECT gate, 'hard' FROM g5
  UNION ALL SELECT 'G3', 'hard' FROM g3 UNION ALL SELECT 'G8', 'hard' FROM g8 UNION ALL SELECT 'G5', 'hard' FROM plc
  UNION ALL SELECT 'G8', severity FROM loo UNION ALL SELECT 'G8', severity FROM gap UNION ALL SELECT 'N1', severity FROM n1 UNION ALL SELECT 'N2', 'warning' FROM n2""",
        "plc": O["placeholders"], "loo": O["loose_structure"], "gap": O["loose_gaps"], "n1": _N1, "snap": _SNAP, "n2": _N2}
_ALL = {k: v for k, v in _ALL.items() if k != "rep"} | {"rep": _ALL["rep"]}
_NA = ["claims", "cited", "led", "cap", "fail", "pg", "dl", "pt", "talk", "hashed", "ptier", "probe"]
O["gate_report"] = query(_NA, "SELECT gate, severity, count(*) AS n FROM rep GROUP BY gate, severity", _ALL)
O["gate_verdict"] = query(_NA, """SELECT count(*) FILTER (severity = 'hard') = 0 AS passed, count(*) FILTER (severity = 'hard') AS hard_failed,
  count(*) FILTER (severity = 'warning') AS warnings FROM rep""", _ALL)
O["link_probes"] = query(["cited", "probe"], """
SELECT source_url, 'N1' AS gate, severity, detail FROM n1""", {"n1": _N1})
O["quote_drift"] = query(["claims"], _N2, {"snap": _SNAP})
ORACLE = O
