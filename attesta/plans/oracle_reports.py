"""SQL of the feature, audit and report queries, for a second engine."""
from __future__ import annotations

from attesta import constants as K
from attesta.plans import views as W
from attesta.plans.oracle_evidence import _QUOTABLE
from attesta.plans.queries_evidence import FIELD_ORDER
from attesta.plans.sqltext import (PRICE, bare, clean_lines, domain, engine_rank, feature_name, has, host, ins, is_custom, is_free,
                                   last_seg, lit, norm, pick, price_key, query, rep, strs, sufficient)

O: dict[str, str] = {}


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({cols})"


def _flat_aliases(families):
    out, n = [], 0
    for canonical, exact, phrases in families:
        for a, p in [(canonical, 0)] + [(a, 0) for a in exact] + [(p, 1) for p in phrases]:
            out.append((canonical, a, p, n))
            n += 1
    return out


def _alias_cte(families) -> dict[str, str]:
    return {"al": values(_flat_aliases(families), "canonical, alias, phrase, ord"),
            "ex": "SELECT lower(trim(alias)) AS key, arg_max(canonical, ord) AS canonical FROM al WHERE phrase = 0 GROUP BY 1",
            "ph": "SELECT lower(trim(alias)) AS key, arg_min(canonical, ord) AS canonical FROM al WHERE phrase = 1 GROUP BY 1"}


_BODY = "CASE WHEN p.key LIKE '%*' THEN left(p.key, length(p.key) - 1) ELSE p.key END"
_RX = "'(^|.*?[^a-z0-9])' || {b} || CASE WHEN p.key LIKE '%*' THEN '[a-z]*' ELSE '{plural}($|[^a-z0-9])' END"


def _hits(names: str, phrases: str, plural: str = "s?") -> str:
    """(name, canonical, pos, size) by trying every phrase on every name."""
    rx = "'^' || " + _RX.format(b=_BODY, plural=plural)
    return f"""SELECT n.name, p.canonical, CASE WHEN regexp_matches(p.key, '[一-鿿]') THEN strpos(n.name, p.key)
      ELSE length(regexp_extract(n.name, {rx}, 1)) + 1 END AS pos, length({_BODY}) AS size
    FROM {names} n, {phrases} p WHERE CASE WHEN regexp_matches(p.key, '[一-鿿]') THEN contains(n.name, p.key) ELSE regexp_matches(n.name, {rx}) END"""


def _named(cat: str, families) -> dict[str, str]:
    return {**_alias_cte(families),
            "nm": f"SELECT DISTINCT name AS orig, lower(trim(name)) AS name FROM {cat}",
            "ht": _hits("(SELECT DISTINCT name FROM nm)", "ph"),
            "bp": "SELECT name, canonical FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos, size DESC, canonical) AS rn FROM ht) WHERE rn = 1",
            "mp": "SELECT nm.orig AS name, coalesce(ex.canonical, bp.canonical, nm.orig) AS canonical FROM nm LEFT JOIN ex ON ex.key = nm.name LEFT JOIN bp ON bp.name = nm.name",
            "nd": f"SELECT c.*, m.canonical FROM {cat} c JOIN mp m USING (name)"}


_STD = _named("cat", K.DEFAULT_ALIASES)
O["canonical_names"] = query(["cat"], "SELECT name, canonical FROM mp", _STD)
_MARKS = """SELECT canonical, vendor, arg_min(name, ord) AS display, min(category) AS category, count(*) AS entries,
  coalesce(arg_min(source, ord) FILTER (source <> ''), '') AS source FROM nd GROUP BY canonical, vendor"""
_M = {**_STD, "marks": _MARKS}
O["feature_marks"] = query(["cat"], "SELECT * FROM marks", _M)
O["feature_matrix"] = query(["cat"], "SELECT canonical, min(category) AS category, count(*) AS holders, count(*) = 1 AS exclusive FROM marks GROUP BY canonical", _M)
O["category_totals"] = query(["cat"], "SELECT category, vendor, count(*) AS features FROM marks GROUP BY ROLLUP (category, vendor)", _M)
O["exclusive_features"] = query(["cat"], """
SELECT vendor, canonical AS feature, name AS display, category, source FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(canonical) ORDER BY ord) AS rn FROM nd
  WHERE lower(canonical) IN (SELECT lower(canonical) FROM nd GROUP BY 1 HAVING count(DISTINCT vendor) = 1)) WHERE rn = 1 AND source <> ''""", _STD)
_GAPFAM = [("red inbox", ["hot inbox"], []), ("cold rest api", ["new rest api", "old rest api"], [])]
O["common_gaps"] = query(["pcat"], """
SELECT v.vendor, c.canonical AS feature FROM (SELECT DISTINCT vendor FROM pcat) v,
  (SELECT canonical FROM nd2 GROUP BY canonical HAVING count(DISTINCT vendor) / (SELECT count(DISTINCT vendor) FROM pcat)::DOUBLE >= 0.75) c
WHERE NOT EXISTS (SELECT 1 FROM nd2 WHERE nd2.vendor = v.vendor AND nd2.canonical = c.canonical) AND (SELECT count(DISTINCT vendor) FROM pcat) >= 3""",
                         {"al": values(_flat_aliases(_GAPFAM), "canonical, alias, phrase, ord"),
                          "nd2": "SELECT p.vendor, coalesce((SELECT arg_max(canonical, ord) FROM al WHERE lower(alias) = lower(p.name)), p.name) AS canonical FROM pcat p"})

# ------------------------------------------------------------------ holders by words
_TOKS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9一-鿿]+'), lambda x: length(x) >= 4))"


def _holder_cte(cat: str, text: str, share: str = "0.6") -> dict[str, str]:
    return {"ks": f"SELECT lower(trim(name)) AS key, arg_min(name, ord) AS feature, min(ord) AS ord, {_TOKS('lower(trim(any_value(name)))')} AS toks FROM {cat} WHERE length(lower(trim(name))) >= 4 GROUP BY 1",
            "vw": f"SELECT vendor, list_distinct(flatten(list({_TOKS(text)}))) AS words FROM {cat} GROUP BY vendor",
            "hd": "SELECT key, vendor FROM ks, vw WHERE len(toks) > 0 AND list_has_all(words, toks)",
            "hc": "SELECT key, count(*) AS holders, min(vendor) AS sole FROM hd GROUP BY key",
            "nv": f"SELECT count(DISTINCT vendor) AS n, greatest(2, round_even(count(DISTINCT vendor) * {share}, 0)) AS least FROM {cat}",
            "cm": "SELECT ks.key, ks.feature, ks.ord, holders FROM ks JOIN hc USING (key) WHERE holders >= (SELECT least FROM nv)"}


_H = _holder_cte("cat", "name || ' ' || descr")
O["feature_holders"] = query(["cat"], "SELECT key, holders FROM hc", _H)
O["feature_conclusions"] = query(["cat"], """
SELECT vendor, held::INT AS held, total::INT AS total, CAST(round_even(100 * held / greatest(total, 1)::DOUBLE, 0) AS INT) AS ratio, exclusives, first_exclusive, missing,
  CASE WHEN total = 0 THEN '功能信息不足' WHEN held / total::DOUBLE >= 0.99 AND exclusives > 0 THEN '覆盖最全 · 有独家能力' WHEN held / total::DOUBLE >= 0.99 THEN '覆盖最全'
    WHEN held / total::DOUBLE >= 0.6 AND exclusives > 0 THEN '覆盖均衡 · 有独家能力' WHEN held / total::DOUBLE >= 0.6 THEN '覆盖均衡' ELSE '公开功能信息有限' END AS verdict
FROM (SELECT v.vendor, (SELECT count(*) FROM hd JOIN cm USING (key) WHERE hd.vendor = v.vendor) AS held, (SELECT count(*) FROM cm) AS total,
    (SELECT count(*) FROM hc WHERE holders = 1 AND sole = v.vendor) AS exclusives,
    coalesce((SELECT arg_min(feature, ks.ord) FROM hc JOIN ks USING (key) WHERE holders = 1 AND sole = v.vendor), '') AS first_exclusive,
    coalesce((SELECT array_to_string(list(feature ORDER BY holders DESC, ord)[1:3], ', ') FROM cm WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.key = cm.key AND hd.vendor = v.vendor)), '') AS missing
  FROM (SELECT DISTINCT vendor FROM cat) v)""", _H)
O["feature_points"] = query(["cat"], """
SELECT vendor, kind, CAST(row_number() OVER (PARTITION BY vendor, kind ORDER BY h DESC, ord) AS INT) AS nth, feature FROM (
  SELECT sole AS vendor, 'exclusive' AS kind, 1 AS h, ks.ord, feature FROM hc JOIN ks USING (key) WHERE holders = 1
  UNION ALL SELECT v.vendor, 'missing', holders, cm.ord, feature FROM (SELECT DISTINCT vendor FROM cat) v, cm
  WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.key = cm.key AND hd.vendor = v.vendor))""", _H)
O["feature_points_mixed"] = query(["pcat"], """
SELECT vendor, kind, CAST(row_number() OVER (PARTITION BY vendor, kind ORDER BY h DESC, ord) AS INT) AS nth, feature FROM (
  SELECT sole AS vendor, 'exclusive' AS kind, 1 AS h, ks.ord, feature FROM hc JOIN ks USING (key) WHERE holders = 1
  UNION ALL SELECT v.vendor, 'missing', holders, cm.ord, feature FROM (SELECT DISTINCT vendor FROM mcat) v, cm
  WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.key = cm.key AND hd.vendor = v.vendor))""", {
    "mcat": "SELECT vendor, ord, CASE WHEN ord % 40 = 0 THEN name || ' only ' || vendor || 'x' || ord ELSE name END AS name FROM pcat", **_holder_cte("mcat", "name")})
_H2 = _holder_cte("pcat", "name")
O["unmentioned_features"] = query(["pcat"], """
SELECT vendor, CAST(nth AS INT) AS nth, feature, others FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY holders DESC, ord) AS nth FROM (
  SELECT v.vendor, cm.feature, cm.ord, holders, holders - (SELECT count(*) FROM hd WHERE hd.key = cm.key AND hd.vendor = v.vendor) AS others
  FROM (SELECT DISTINCT vendor FROM pcat) v, cm
  WHERE NOT EXISTS (SELECT 1 FROM pcat p WHERE p.vendor = v.vendor AND contains(lower(p.name), cm.key))) WHERE others >= (SELECT least FROM nv))""", _H2)

# ------------------------------------------------------------------ capabilities
_CAPROWS = [(cid, cat, a, i) for cid, cn, en, cat, al in K.DEFAULT_CAPABILITIES for i, a in enumerate(dict.fromkeys(x.strip().lower() for x in [*al, en, cn]))]
_RXC = "'^' || " + _RX.format(b="p.key", plural="(?:s|es)?").replace("p.key LIKE '%*'", "false")
_CAPS = {
    "ca": values(_CAPROWS, "id, category, key, pos"),
    "lw": "SELECT vendor, lower(trim(name)) AS key, min(ord) AS ord, arg_max(name, ord) AS name FROM cat GROUP BY 1, 2",
    "cand": f"""SELECT lw.vendor, p.id, 0 AS kind, p.pos AS k1, 0 AS k2, lw.name, p.key AS alias FROM lw JOIN ca p ON p.key = lw.key
      UNION ALL SELECT lw.vendor, p.id, 1, lw.ord, p.pos, lw.name, p.key FROM lw, ca p
      WHERE length(p.key) >= CASE WHEN regexp_matches(p.key, '[一-鿿]') THEN 2 ELSE 4 END
        AND CASE WHEN regexp_matches(p.key, '[一-鿿]') THEN contains(lw.key, p.key) ELSE regexp_matches(lw.key, {_RXC}) END""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor, id ORDER BY kind, k1, k2, name, alias) AS rn FROM cand) WHERE rn = 1",
    "cmk": """SELECT v.vendor, i.id, i.category, CASE WHEN b.id IS NULL THEN 'unknown' ELSE 'supports' END AS status,
      CASE WHEN b.id IS NULL THEN 'low' WHEN kind = 0 THEN 'high' ELSE 'medium' END AS confidence, coalesce(b.name, '') AS evidence, coalesce(b.alias, '') AS matched
      FROM (SELECT DISTINCT vendor FROM cat) v CROSS JOIN (SELECT DISTINCT id, category FROM ca) i LEFT JOIN best b ON b.vendor = v.vendor AND b.id = i.id""",
    "note": "SELECT p_brand AS vendor, CASE WHEN count(*) % 2 = 0 THEN 'supports' ELSE 'unknown' END AS status, count(*) % 5 <> 0 AS noted FROM part GROUP BY p_brand",
    "ovr": """SELECT c.vendor, c.id, c.category, CASE WHEN c.id = 'data_export' THEN n.status ELSE c.status END AS status,
      CASE WHEN c.id = 'data_export' AND n.noted THEN CASE WHEN n.status = 'supports' THEN 'high' ELSE 'medium' END ELSE c.confidence END AS confidence
      FROM cmk c JOIN note n USING (vendor)"""}
O["capability_marks"] = query(["cat"], "SELECT * FROM cmk", _CAPS)
O["capability_overrides"] = query(["cat"], """
SELECT vendor, id, o.category, o.status, o.confidence, CASE WHEN id = 'data_export' AND m % 3 = 0 THEN 'csv dump' ELSE c.evidence END AS evidence,
  CASE WHEN id = 'data_export' AND m % 5 <> 0 THEN 'checked by hand' ELSE '' END AS note
FROM ovr o JOIN cmk c USING (vendor, id) JOIN (SELECT p_brand AS vendor, count(*) AS m FROM part GROUP BY p_brand) USING (vendor)""", _CAPS)
O["capability_support"] = query(["cat"], "SELECT id, category, count(*) FILTER (status = 'supports') AS supported, count(*) AS vendors FROM ovr GROUP BY id, category", _CAPS)
O["capability_confidence"] = query(["cat"], """SELECT vendor, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium,
  count(*) FILTER (confidence = 'low') AS low FROM ovr GROUP BY vendor""", _CAPS)

# ------------------------------------------------------------------ catalog repair, stems, variants
O["repair_catalog"] = """
WITH c AS (SELECT p_brand AS vendor, p_partkey AS ord, p_type AS category, CASE p_partkey % 7
    WHEN 0 THEN upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)
    WHEN 4 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_partkey % 7 IN (0, 1, 4, 6))
SELECT vendor, arg_max(name, caps * 1000000000 - ord) AS name, min(ord) AS ord, arg_min(category, ord) AS category
FROM (SELECT *, len(regexp_extract_all(name, '[A-Z]')) AS caps FROM c) GROUP BY vendor, lower(name)"""
O["fill_catalog"] = query(["cat"], "SELECT vendor, ord, CASE WHEN vendor LIKE '%3' THEN descr ELSE name END AS name, CASE WHEN vendor LIKE '%3' THEN '' ELSE source END AS source FROM cat")


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def stems(x: str) -> str:
    w = "w"
    for suf in K.STEM_SUFFIXES:
        w = f"regexp_replace({w}, '^(.{{3,}}){suf}$', '\\1')"
    w = f"coalesce(nullif(regexp_replace({w}, '[oae]+$', ''), ''), {w})"
    w = f"regexp_replace({w}, '^(.{{4,}})s$', '\\1')"
    stop = strs(K.STEM_STOP)
    first = f"list_filter(regexp_extract_all({_fold(x)}, '[a-z]{{3,}}'), lambda w: NOT list_contains({stop}, w))"
    return f"list_sort(list_distinct(list_filter(list_transform({first}, lambda w: {w}), lambda s: NOT list_contains({stop}, s))))"


O["stem_signatures"] = f"""SELECT doc_id, CAST(nth AS INT) AS nth, array_to_string({stems('line')}, ' ') AS stems
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)"""
_STOP = """SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(regexp_extract_all(lower(name), '[a-z]{3,}'), regexp_extract_all(lower(name), '[一-鿿]{2,}')))) AS token FROM pcat)
  GROUP BY token HAVING count(*) > greatest(3, 0.35 * (SELECT count(*) FROM pcat))"""
O["stop_tokens"] = query(["pcat"], "SELECT * FROM stp", {"stp": _STOP})
O["stop_tokens_texts"] = """SELECT token, count(*) AS n FROM (
  SELECT unnest(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z]{3,}'), regexp_extract_all(lower(text), '[一-鿿]{2,}')))) AS token FROM documents WHERE coalesce(text, '') <> '')
  GROUP BY token HAVING count(*) > greatest(3, 0.35 * (SELECT count(*) FROM documents WHERE coalesce(text, '') <> ''))"""
_STRONG = f"length(s) >= 6 AND NOT list_contains({strs(K.WEAK_STEMS)}, s)"
_VAR = {
    "stp": _STOP, "sl": "SELECT coalesce(list(token), []) AS l FROM stp",
    "nm": f"SELECT trim(name) AS name, min(ord) AS ord, {stems('any_value(trim(name))')} AS fs FROM pcat GROUP BY trim(name)",
    "sg": """SELECT name, ord, CASE WHEN len(list_filter(fs, lambda s: NOT list_contains(l, s))) > 0 THEN list_filter(fs, lambda s: NOT list_contains(l, s)) ELSE fs END AS sig
      FROM nm, sl WHERE len(fs) > 0""",
    "nodes": "SELECT sig, min(ord) AS node FROM sg GROUP BY sig",
    "pairs": f"""SELECT a.node AS a, b.node AS b FROM nodes a, nodes b WHERE len(list_intersect(a.sig, b.sig)) > 0
      AND (len(list_intersect(a.sig, b.sig)) * 2 >= len(list_distinct(list_concat(a.sig, b.sig))) OR len(list_filter(list_intersect(a.sig, b.sig), lambda s: {_STRONG})) > 0)""",
    "reach": "SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b",
    "comp": "SELECT a AS node, min(b) AS c FROM reach GROUP BY a",
    "grp": "SELECT sg.name, sg.ord, c FROM sg JOIN nodes USING (sig) JOIN comp USING (node)",
    "rp": "SELECT g.name, r.rep FROM grp g JOIN (SELECT c, arg_min(name, ord) AS rep FROM grp GROUP BY c) r USING (c)"}
O["variant_groups"] = query(["pcat"], "SELECT name, rep FROM rp", _VAR).replace("WITH ", "WITH RECURSIVE ", 1)
O["auto_aliases"] = query(["pcat"], """
SELECT DISTINCT rep AS canonical, name AS alias, vendors FROM nr JOIN (SELECT rep, count(DISTINCT vendor) AS vendors FROM nr GROUP BY rep) USING (rep) WHERE vendors >= 2""",
                          {**_VAR, "nr": "SELECT DISTINCT vendor, trim(p.name) AS name, coalesce(rep, trim(p.name)) AS rep FROM pcat p LEFT JOIN rp ON rp.name = trim(p.name)"}).replace("WITH ", "WITH RECURSIVE ", 1)
_FZ = [("Security Scanning", ["Security Scanning"], []), ("Email Campaigns", ["Campaigns by email"], [])]
O["canonical_names_fuzzy"] = query(["pcat"], f"""
SELECT n.name, coalesce((SELECT arg_max(canonical, ord) FROM al WHERE lower(trim(alias)) = lower(trim(n.name))),
    (SELECT arg_min(canonical, ord) FROM az WHERE len(list_intersect(n.sig, az.asig)) > 0 AND (len(list_intersect(n.sig, az.asig)) / len(list_distinct(list_concat(n.sig, az.fs)))::DOUBLE >= 0.5
       OR len(list_filter(list_intersect(n.sig, az.asig), lambda s: {_STRONG})) > 0)), n.name) AS canonical FROM nn n""",
                                   {"stp": _STOP, "sl": _VAR["sl"], "al": values(_flat_aliases(_FZ), "canonical, alias, phrase, ord"),
                                    "az": f"SELECT canonical, ord, fs, list_filter(fs, lambda s: NOT list_contains(l, s)) AS asig FROM (SELECT canonical, ord, {stems('alias')} AS fs FROM al), sl",
                                    "nn": f"SELECT name, list_filter(fs, lambda s: NOT list_contains(l, s)) AS sig FROM (SELECT DISTINCT name, {stems('lower(trim(name))')} AS fs FROM pcat), sl"})
O["alias_layers"] = query(["pcat"], """
SELECT canonical, key, arg_max(alias, rank) AS alias, arg_max(layer, rank) AS layer FROM (
  SELECT canonical, alias, lower(trim(alias)) AS key, 0 AS rank, 'default' AS layer FROM al WHERE phrase = 0
  UNION ALL SELECT canonical, alias, lower(trim(alias)), 1, 'auto' FROM au WHERE NOT EXISTS (SELECT 1 FROM al WHERE phrase = 0 AND lower(trim(al.alias)) = lower(trim(au.canonical)) AND al.canonical <> au.canonical)
  UNION ALL SELECT DISTINCT p_type, p_type || ' ' || p_size, lower(p_type || ' ' || p_size), 2, 'user' FROM part) GROUP BY canonical, key""",
                          {"al": values(_flat_aliases(K.DEFAULT_ALIASES), "canonical, alias, phrase, ord"),
                           "au": "SELECT CASE WHEN name LIKE '%inbox' THEN 'Inbox' ELSE name END AS canonical, name AS alias FROM pcat GROUP BY name HAVING count(DISTINCT vendor) >= 2"})
O["unified_share"] = query(["pcat"], """
SELECT count(*) AS names, CAST(count(*) FILTER (hit) AS BIGINT) AS unified, count(*) > 0 AND count(*) FILTER (hit) * 2 < count(*) AS warn FROM (
  SELECT ord % 3 = 0 OR ord % 7 = 0 AS hit FROM pcat)""")
_LAB = "CASE WHEN regexp_matches(name, '[一-鿿]') THEN '' " + " ".join(
    (f"WHEN contains(lower(name), {lit(k)}) THEN {lit(v)}" if " " in k or "-" in k else f"WHEN regexp_matches(lower(name), {lit(chr(92) + 'b' + k + 's?' + chr(92) + 'b')}) THEN {lit(v)}")
    for k, v in sorted(K.FEATURE_LABELS, key=lambda kv: -len(kv[0].split()))) + " ELSE '' END"
O["feature_labels"] = query(["cat"], f"SELECT ord, {_LAB} AS label FROM cat")

# ------------------------------------------------------------------ audits
_EXP = strs(K.EXPECTED_KINDS)
_COV = f"""
  SELECT vendor, array_to_string(list_filter({_EXP}, lambda k: NOT list_contains(got, k)), ',') AS missing,
    CASE len(list_filter({_EXP}, lambda k: NOT list_contains(got, k))) WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' ELSE 'gap' END AS status
  FROM (SELECT vendor, flatten(list(CASE WHEN status = 'ok' THEN kinds ELSE [] END)) AS got FROM led GROUP BY vendor)"""
O["page_coverage"] = query(["led"], _COV)
# a stretch of a host's name equals a label if the label is found inside it
_THIRD = f"""SELECT DISTINCT v.vendor, l.url, unnest(l.kinds) AS kind FROM (SELECT DISTINCT vendor FROM led) v JOIN led l
  ON l.status = 'ok' AND contains({host('l.url')}, split_part(replace(v.vendor, 'www.', ''), '.', 1)) AND NOT contains(replace({host('l.url')}, 'www.', ''), replace(v.vendor, 'www.', ''))"""
O["third_party_pages"] = query(["led"], "SELECT 'of ' || vendor AS vendor, url, kind FROM third", {"third": _THIRD})
O["coverage_elsewhere"] = query(["led"], f"""
SELECT vendor, array_to_string(list_sort(list_filter({_EXP}, lambda k: NOT list_contains(got, k))), ',') AS missing,
  CASE len(list_filter({_EXP}, lambda k: NOT list_contains(got, k))) WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' ELSE 'gap' END AS status
FROM (SELECT vendor, list(kind) AS got FROM (SELECT vendor, unnest(CASE WHEN status = 'ok' THEN kinds ELSE [''] END) AS kind FROM led UNION ALL SELECT vendor, kind FROM third) GROUP BY vendor)""", {"third": _THIRD})
_DEPTH = {
    "tk": """SELECT 'V' || (p_partkey // 8) AS vendor, engine, sum(CASE WHEN (p_partkey // 8) % 5 <> 0 AND ((p_partkey // 8) % 5 <> 1 OR engine = 'jina')
      THEN len(regexp_extract_all(text, '[$]|USD')) ELSE 0 END) AS tokens FROM ptext GROUP BY 1, 2""",
    "pl": f"""SELECT page_id, url AS site, CASE WHEN page_id % 10 = 0 THEN 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/pricing' ELSE url END AS url,
      {pick('page_id', ['pricing', 'docs', 'pricing', 'homepage', 'blog'])} AS kind FROM pages""",
    "tt": f"""SELECT 'V' || (ord // 8) AS vendor, count(*) AS tiers, bool_or(trim(period) <> '' AND NOT {has('period', K.AUDIT_ANNUAL)} AND {has('trim(period)', K.AUDIT_MONTHLY)}) AS monthly,
      bool_or({has('period', K.AUDIT_ANNUAL)}) AS annual, bool_or({is_free('plan', 'price')}) AS free, bool_or({is_custom('plan', 'price')}) AS custom,
      count(*) FILTER ({has('price', PRICE)}) AS priced FROM tier WHERE (ord // 8) % 7 <> 3 GROUP BY 1""",
    "vj": f"""SELECT v.vendor, v.site, v.verified, coalesce(e.engines, 0) AS engines, coalesce(t.tiers, 0) AS tiers, coalesce(t.monthly, false) AS monthly, coalesce(t.annual, false) AS annual,
      coalesce(t.free, false) AS free, coalesce(t.custom, false) AS custom, coalesce(t.priced, 0) AS priced,
      coalesce(pl.kind = 'pricing' AND ({last_seg('pl.url')} = '' OR {last_seg('pl.url')} IN {ins(K.AUDIT_PRICE_PAGE_SEGMENTS)}), false) AS genuine,
      (SELECT count(*) FROM pl q WHERE q.page_id // 4 = pl.page_id // 4 AND q.kind IN ('pricing', 'docs', 'about')) - CASE WHEN pl.kind IN ('pricing', 'docs', 'about') THEN 1 ELSE 0 END AS others, (SELECT count(*) FROM pl q WHERE q.page_id // 4 = pl.page_id // 4) AS n
      FROM (SELECT page_id, 'V' || page_id AS vendor, url AS site, page_id % 2 = 0 AS verified FROM pages) v JOIN pl ON pl.page_id = v.page_id
      LEFT JOIN (SELECT vendor, count(*) FILTER (tokens > 0) AS engines FROM tk GROUP BY vendor) e ON e.vendor = v.vendor LEFT JOIN tt t ON t.vendor = v.vendor""",
    "dep": """SELECT vendor, site, engines, monthly, annual, free, custom, priced,
      CASE WHEN engines = 0 AND genuine AND (others > 0 OR n > 2) THEN 'not-published' WHEN engines = 0 THEN 'gap' WHEN tiers = 0 THEN CASE WHEN engines = 1 THEN 'partial' ELSE 'ok' END
        WHEN monthly AND annual AND priced > 0 AND engines >= 2 THEN 'ok' ELSE 'partial' END AS status,
      concat_ws('; ', CASE WHEN engines = 0 AND NOT genuine THEN 'no genuine price page' END, CASE WHEN engines > 0 AND tiers > 0 AND annual AND NOT monthly THEN 'annual only' END,
        CASE WHEN engines > 0 AND tiers > 0 AND monthly AND NOT annual THEN 'monthly only' END, CASE WHEN engines > 0 AND tiers > 0 AND NOT free AND NOT custom THEN 'neither free nor custom plan' END,
        CASE WHEN engines = 1 AND (priced > 0 OR tiers = 0) THEN 'single engine' END, CASE WHEN engines > 0 AND priced > 0 AND NOT verified THEN 'priced but not verified' END) AS findings FROM vj"""}
O["price_depth"] = query(["ptext", "tier"], "SELECT vendor, status, engines, monthly, annual, free, custom, priced, findings FROM dep", _DEPTH)
_FC = """
  SELECT pg.vendor, concat_ws(',', CASE WHEN np < 12 THEN 'core_features' END, CASE WHEN 1 + d0 < 3 THEN 'strengths' END, CASE WHEN d1 < 1 THEN 'weaknesses' END,
      CASE WHEN d2 < 1 THEN 'differentiators' END, CASE WHEN d3 < 1 THEN 'tech_signals' END, CASE WHEN np < 4 THEN 'feature_catalog' END,
      CASE WHEN page_id % 2 = 0 THEN 'feature_conclusion_points' END, CASE WHEN page_id % 6 = 0 OR trim(h1) = '' THEN 'tagline' END, CASE WHEN page_id % 7 = 3 THEN 'feature_best_for' END) AS missing,
    concat_ws(',', CASE WHEN fb = 0 THEN 'user_feedback' END, CASE WHEN page_id % 3 <> 0 THEN 'product_momentum' END) AS collect,
    np < 4 OR page_id % 2 = 0 AS blocked
  FROM (SELECT *, (SELECT count(*) FROM pt WHERE pt.page_id = pg.page_id) AS np, (SELECT count(*) FROM dl WHERE dl.page_id = pg.page_id AND slot = 0) AS d0,
    (SELECT count(*) FROM dl WHERE dl.page_id = pg.page_id AND slot = 1) AS d1, (SELECT count(*) FROM dl WHERE dl.page_id = pg.page_id AND slot = 2) AS d2,
    (SELECT count(*) FROM dl WHERE dl.page_id = pg.page_id AND slot = 3) AS d3, (SELECT count(*) FROM talk WHERE talk.page_id = pg.page_id) AS fb FROM pg) pg"""
_FCS = "SELECT vendor, missing, collect, CASE WHEN missing = '' THEN 'ok' WHEN blocked THEN 'gap' ELSE 'partial' END AS status FROM fc"
_FN = ["pg", "pt", "dl", "talk"]
O["field_completeness"] = query(_FN, _FCS, {"fc": _FC})
_CPV = {
    "tok": f"SELECT page_id, engine, {price_key('token')} AS k, {rep('token', '[^0-9.]', '')} AS d FROM (SELECT p_partkey // 8 AS page_id, engine, unnest(regexp_extract_all({norm('text')}, {lit(PRICE)})) AS token FROM ptext)",
    "cpv": f"""SELECT vendor, idx, price, (SELECT count(DISTINCT engine) FROM tok WHERE tok.page_id = p.page_id AND k = {price_key('p.price')}) AS engines_seen,
      (SELECT count(DISTINCT engine) FROM tok WHERE tok.page_id = p.page_id AND d = {rep('p.price', '[^0-9.]', '')}) AS engines_by_digits FROM ptier p""",
    "pvs": """SELECT g.vendor, coalesce(prices, 0) AS prices, coalesce(weak, 0) AS weak, CASE WHEN coalesce(prices, 0) = 0 THEN 'n-a' WHEN weak = 0 THEN 'ok' ELSE 'partial' END AS status
      FROM pg g LEFT JOIN (SELECT vendor, count(*) AS prices, count(*) FILTER (engines_seen < 2) AS weak FROM cpv GROUP BY vendor) c ON c.vendor = g.vendor"""}
O["claimed_price_votes"] = query(["ptier", "ptext"], "SELECT vendor, idx, price, engines_seen, engines_by_digits, engines_seen >= 2 AS agree FROM cpv", _CPV)
O["price_vote_status"] = query(["ptier", "ptext"], "SELECT * FROM pvs", _CPV)


def _acc(limit: str) -> dict[str, str]:
    return {
        "cn": f"SELECT url, {norm('text')} AS flat, {bare('text')} AS bare FROM cap",
        "aq": """SELECT vendor, url AS source_url, h1 AS quote, 0 AS o, 0 AS idx FROM pg WHERE h1 <> ''
          UNION ALL SELECT vendor, root, line, 0, 1 + pos FROM pg JOIN dl USING (page_id) WHERE slot = 0 AND line <> ''
          UNION ALL SELECT vendor, root || '/en/pricing/', line, 1, pos FROM pg JOIN dl USING (page_id) WHERE slot = 1 AND line <> ''
          UNION ALL SELECT vendor, url, line, 2, pos FROM pg JOIN dl USING (page_id) WHERE slot = 2 AND line <> ''
          UNION ALL SELECT vendor, url, line, 3, pos FROM pg JOIN dl USING (page_id) WHERE slot = 3
          UNION ALL SELECT vendor, CASE WHEN page_id % 6 = 1 THEN 'https://www.g2.com/reviews' ELSE root END, opening, 4, pos FROM pg JOIN talk USING (page_id) WHERE opening <> ''""",
        "qa": f"""SELECT g.vendor, coalesce(checked, 0) AS checked, coalesce(missed, 0) AS missed, CASE WHEN coalesce(missed, 0) > 0 THEN 'gap' ELSE 'ok' END AS status
          FROM pg g LEFT JOIN (SELECT vendor, count(*) AS checked, count(*) FILTER (NOT found) AS missed FROM (
            SELECT vendor, {norm('quote')} = '' OR EXISTS (SELECT 1 FROM cn WHERE cn.url = q.source_url AND (contains(flat, {norm('q.quote')}) OR contains(bare, {norm('q.quote')}))) AS found
            FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY o, idx) AS rn FROM aq) q {limit}) GROUP BY vendor) c ON c.vendor = g.vendor"""}


_QN = ["pg", "dl", "talk", "cap"]
O["quote_accuracy"] = query(_QN, "SELECT * FROM qa", _acc(""))
O["signal_problems"] = query(["pg", "dl"], """
SELECT vendor, CAST(pos AS INT) AS idx, source AS signal, CASE page_id % 5 WHEN 0 THEN 'no source' WHEN 1 THEN 'section front page' ELSE 'bare host' END AS problem
FROM pg JOIN dl USING (page_id) WHERE slot = 3 AND page_id % 5 < 3""")
O["feedback_problems"] = query(["pg", "talk"], "SELECT vendor, CAST(pos AS INT) AS idx, 'no source' AS problem FROM pg JOIN talk USING (page_id) WHERE page_id % 4 = 1")
_AUD = {**_DEPTH, "fc": _FC, "fcs": _FCS, **_CPV, **_acc(""), "cov": _COV,
        "au": """SELECT vendor, 'page_coverage' AS dimension, status FROM cov UNION ALL SELECT vendor, 'price_depth', status FROM dep UNION ALL SELECT vendor, 'field_completeness', status FROM fcs
          UNION ALL SELECT vendor, 'price_votes', status FROM pvs UNION ALL SELECT vendor, 'quote_accuracy', status FROM qa"""}
_CG = O["common_gaps"]
O["gap_actions"] = f"SELECT vendor, 'common_gaps' AS dimension, 'check in the captures: ' || feature AS action FROM ({_CG})"
O["common_gap_status"] = query(["pcat"], f"""SELECT v.vendor, count(g.feature) AS missing, CASE WHEN count(g.feature) = 0 THEN 'ok' ELSE 'partial' END AS status
FROM (SELECT DISTINCT vendor FROM pcat) v LEFT JOIN ({_CG}) g ON g.vendor = v.vendor GROUP BY v.vendor""")
O["audit_lists"] = query(["led", "ptext", "tier", "ptier", *_FN, *_QN], """
SELECT CASE WHEN status = 'gap' THEN 'unresolved' ELSE 'not_published' END AS list, vendor, dimension FROM au
WHERE status = 'gap' OR (status = 'not-published' AND dimension = 'price_depth')""", _AUD)
O["audit_summary"] = query(["led", "ptext", "tier", "ptier", *_FN, *_QN], """
SELECT dimension, status, count(*) AS n, status = 'gap' AS unresolved FROM au GROUP BY ROLLUP (dimension, status)""", _AUD)
O["next_actions"] = query(["led", "ptext", "tier", "ptier", *_FN, *_QN], """
SELECT vendor, dimension, CASE dimension WHEN 'page_coverage' THEN 'capture the missing page kinds' WHEN 'price_depth' THEN 'capture the price page again'
  WHEN 'field_completeness' THEN 'complete the fields from the captures' WHEN 'price_votes' THEN 'capture with another engine' ELSE 'correct the quote or its anchor' END AS action
FROM au WHERE status IN ('gap', 'partial')""", _AUD)
O["audit_lessons"] = query(["ptext", "tier"], f"""
SELECT replace({host('site')}, 'www.', '') AS domain, vendor, CASE WHEN status = 'not-published' THEN 'pricing_not_published' ELSE 'pricing_single_period_or_engine' END AS issue,
  CASE WHEN status = 'not-published' THEN 'confirmed_not_published' ELSE 'engines=' || coalesce((SELECT string_agg(engine, '/' ORDER BY engine) FROM tk WHERE tk.vendor = dep.vendor), 'none') END AS resolution,
  CASE WHEN status = 'not-published' THEN '官方定价页全引擎 0 价格 token | 替代路径已探测(help center/app市场/集团官网)'
    ELSE '月付:' || CASE WHEN monthly THEN 'True' ELSE 'False' END || ' 年付:' || CASE WHEN annual THEN 'True' ELSE 'False' END || '  priced_tiers:' || priced END AS evidence,
  CASE WHEN status = 'not-published' THEN coalesce((SELECT string_agg(DISTINCT pl.url, ' ' ORDER BY pl.url) FROM pl WHERE pl.site = dep.site AND kind = 'pricing' AND page_id % 8 <> 4), '') ELSE '' END AS alt_sources,
  CASE WHEN status = 'not-published' THEN '下次运行直接采信「询价制」结论,跳过定价补爬,把预算让给功能/口碑深挖' ELSE '定价深挖抓手:月/年 toggle、JS 套餐卡片、help center 定价页、第三方比价页' END AS hint
FROM dep WHERE status <> 'ok'""", _DEPTH)
O["page_digest"] = query(["cap", "led"], f"""
SELECT l.url, array_to_string(l.kinds, '/') AS kinds, CASE WHEN {last_seg('l.url')} = 'pricing' THEN 'price statements only' WHEN {last_seg('l.url')} = '' THEN 'root' ELSE 'ok' END AS anchor,
  b.engine, CAST(b.lines AS INT) AS lines, (SELECT count(DISTINCT s) FROM sq WHERE sq.url = l.url AND rn <= 3) AS quotes, (SELECT count(*) FROM pv WHERE pv.url = l.url) AS agreed_prices
FROM led l LEFT JOIN (SELECT url, arg_min(engine, k) AS engine, arg_min(len(ls), k) AS lines FROM (
    SELECT url, engine, ls, CASE engine WHEN 'trafilatura' THEN 0 WHEN 'playwright' THEN 1 ELSE 2 END AS k FROM cl WHERE text <> '') GROUP BY url) b USING (url)""",
                         {"pv": f"""SELECT url, k FROM (SELECT url, engine, {price_key('t')} AS k FROM (SELECT url, engine, unnest(regexp_extract_all(
                            text || CASE WHEN page_id % 3 = 0 THEN chr(10) || 'from $' || page_id || ' USD' ELSE '' END, {lit(PRICE)})) AS t FROM cap)) GROUP BY url, k HAVING count(DISTINCT engine) >= 2""",
                          "cl": f"SELECT url, engine, text, {clean_lines('text')} AS ls, {norm('text')} AS flat, {bare('text')} AS bare FROM cap",
                          "sq": f"""SELECT url, s, row_number() OVER (PARTITION BY url ORDER BY k) AS rn FROM (SELECT url, s, min(rk * 1000000 + pos) AS k FROM (
                            SELECT url, {engine_rank('engine')} AS rk, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos, flat, bare FROM cl)
                            WHERE {_QUOTABLE} AND (contains(flat, s) OR contains(bare, s)) GROUP BY url, s)"""})

# ------------------------------------------------------------------ report tables
_SC = """
  SELECT 'S' || l_suppkey AS vendor, l_suppkey AS ord, """ + ", ".join(f"least(floor(x{i} * 100 + 0.5) / 100, 10)::DECIMAL(6,2) AS {n}" for i, n in enumerate(K.SCORE_DIMENSIONS)) + """
  FROM (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE / count(*) / 5 AS x0, sum(CAST(l_discount AS DECIMAL(18,2)))::DOUBLE * 100 / count(*) AS x1,
    sum(CAST(l_tax AS DECIMAL(18,2)))::DOUBLE * 100 / count(*) AS x2, count(*) FILTER (l_returnflag = 'N')::DOUBLE * 10 / count(*) AS x3,
    count(*) FILTER (l_linestatus = 'O')::DOUBLE * 10 / count(*) AS x4, sum(l_linenumber)::DOUBLE / count(*) AS x5 FROM lineitem GROUP BY l_suppkey)"""
_RK = {"sc": _SC,
       "av": "SELECT vendor, ord, round_even((" + " + ".join(K.SCORE_DIMENSIONS) + ")::DOUBLE / 6, 1) AS avg, feature_richness = ux AND ux = pricing_value AND pricing_value = integration AND integration = ai_capability AND ai_capability = momentum AS uncalibrated FROM sc",
       "rk": """SELECT vendor, avg, CASE WHEN avg::DECIMAL(6,2) >= (SELECT max(avg) FROM av)::DECIMAL(6,2) * 0.9 THEN '领先' WHEN avg::DECIMAL(6,2) >= (SELECT max(avg) FROM av)::DECIMAL(6,2) * 0.7 THEN '中坚' ELSE '跟随' END AS tier,
         row_number() OVER (ORDER BY avg DESC, ord) AS rank, uncalibrated FROM av"""}
O["score_rank"] = query([], "SELECT * FROM rk", _RK)
O["dimension_rank"] = query([], """SELECT vendor, dimension, score::DOUBLE AS score, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, ord) AS rank
FROM (UNPIVOT sc ON """ + ", ".join(K.SCORE_DIMENSIONS) + " INTO NAME dimension VALUE score)", {"sc": _SC})
O["score_summary"] = query([], "SELECT arg_min(vendor, rank) AS leader, arg_max(vendor, rank) AS last, count(*) AS vendors, round_even(avg(avg), 1) AS mean, count(*) FILTER (uncalibrated) AS uncalibrated FROM rk", _RK)
O["target_overlap"] = """SELECT target, count(DISTINCT vendor) AS vendors FROM (SELECT n_name AS vendor, c_mktsegment || ' ' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS target
  FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY target HAVING count(DISTINCT vendor) >= 2"""
O["signal_clusters"] = query(["pg", "dl"], "SELECT source AS signal, count(DISTINCT vendor) AS adopters FROM pg JOIN dl USING (page_id) WHERE slot = 3 GROUP BY source")
_POS = f"list_position({strs(FIELD_ORDER)}, field)"
_REG = f"""
  SELECT url, kind, claims, CASE WHEN contains(url, 'g2.com') OR contains(url, 'reddit.com') OR contains(url, 'crunchbase.com') THEN 'user' ELSE 'bot' END AS verified,
    row_number() OVER (ORDER BY o) AS idx, claim FROM (
    SELECT source_url AS url, min(k) AS o, arg_min(field, k) AS kind, arg_min(whole, k) AS claim, count(DISTINCT nullif(whole, '')) AS claims FROM (
      SELECT *, row_number() OVER (ORDER BY page_id, {_POS}, idx) AS k, trim(statement) AS whole FROM cited WHERE regexp_matches(source_url, '(?i)^https?://') OR source_url LIKE '#%') GROUP BY source_url)"""
O["source_register"] = query(["cited"], "SELECT url, kind, claims, verified, idx, md5(claim) AS claim FROM reg", {"reg": _REG})
O["sources_by_kind"] = query(["cited"], "SELECT kind, count(*) AS n, count(*) FILTER (verified = 'user') AS user_verified FROM reg GROUP BY kind", {"reg": _REG})
O["evidence_warnings"] = query(["cited", "pg"], """
SELECT (SELECT count(*) FROM reg) = 0 AS no_sources, count(*) FILTER (NOT (page_id % 2 = 0 AND page_id % 9 <> 0) AND page_id % 6 <> 5) AS unverified_prices, 0 AS placeholder_only,
  (SELECT count(*) FILTER (uncalibrated) FROM rk) AS uncalibrated FROM pg""", {"reg": _REG, **_RK})
_ANG = "CASE " + " ".join(
    "WHEN {n} > 0 AND ".format(n="({})".format(" + ".join(f"contains(good, {lit(w)})::INT" for w in ws))) +
    " AND ".join(["({}) {} ({})".format(" + ".join(f"contains(good, {lit(w)})::INT" for w in ws), ">" if j < i else ">=", " + ".join(f"contains(good, {lit(w)})::INT" for w in ws2))
                  for j, (_a2, ws2) in enumerate(K.ANGLES) if j != i]) + f" THEN {lit(a)}"
    for i, (a, ws) in enumerate(K.ANGLES)) + " ELSE '产品' END"
_HINT = "CASE " + " ".join(f"WHEN {has('good', rx)} THEN {lit(h)}" for rx, h in K.ACTION_RULES) + " END"
O["inspiration_points"] = query(["pg", "dl"], f"""
SELECT vendor, CAST(idx AS INT) AS idx, {_ANG} AS angle, {_HINT} AS inspiration, source, md5(good) AS good FROM (
  SELECT vendor, 0 AS idx, {pick('page_id', W.POINTS)} AS good, url AS source FROM pg
  UNION ALL SELECT vendor, 1 + pos, line, root FROM pg JOIN dl USING (page_id) WHERE slot = 0 AND trim(line) <> '')
WHERE {_HINT} IS NOT NULL AND NOT ({has('good', K.FACTUAL_POINT)} AND NOT {has('good', K.FACTUAL_EXEMPT)})""")
O["weakness_points"] = query(["pg", "dl"], f"""
SELECT vendor, CAST(pos AS INT) AS idx, {_ANG} AS angle, root || '/en/pricing/' AS source, md5(good) AS weakness FROM (SELECT *, line AS good FROM pg JOIN dl USING (page_id) WHERE slot = 1 AND doc_id % 8 <> 1)
WHERE {norm('good')} <> ''""")
O["feedback_summary"] = query(["pg", "dl", "talk"], f"""
SELECT vendor, side, CAST(row_number() OVER (PARTITION BY vendor, side ORDER BY o, pos) AS INT) AS nth, label, md5(t) AS text FROM (
  SELECT vendor, 'positive' AS side, 0 AS o, pos, CASE WHEN page_id % 6 = 1 THEN 'G2 评测' ELSE '官网页面' END || ' · 客户引语' AS label, trim(opening) || ' —— user' AS t FROM pg JOIN talk USING (page_id)
  UNION ALL SELECT vendor, 'positive', 1, 0, '官网页面 · 官网自述', {pick('page_id', W.POINTS)} FROM pg
  UNION ALL SELECT vendor, 'positive', 2, pos, '官网页面 · 官网自述', line FROM pg JOIN dl USING (page_id) WHERE slot = 0 AND {norm('line')} <> ''
  UNION ALL SELECT vendor, 'negative', 0, pos, '官网页面', line FROM pg JOIN dl USING (page_id) WHERE slot = 1 AND doc_id % 8 <> 1 AND {norm('line')} <> '')""")
O["release_timeline"] = """SELECT 'U' || user_id AS vendor, event_id AS ord, props AS title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS nth
  FROM events WHERE event_type = 'purchase'"""
O["release_density"] = query(["pg"], "SELECT vendor, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS releases FROM pg")
_STAGE = pick("page_id", W.STAGES)
O["positioning"] = query(["pg"], f"""
SELECT vendor, {pick('page_id', W.SEGMENTS)} || '、' || {pick('page_id + 2', W.SEGMENTS)} AS target_segment, CASE WHEN {_STAGE} IN ('早期', '成长期') THEN '中小企业' WHEN {_STAGE} IN ('成熟期', '巨头') THEN '中大型企业' ELSE '—' END AS scale,
  {_STAGE} AS key_market, CASE WHEN page_id % 4 = 0 THEN '—' ELSE (page_id % 30 + 1990)::VARCHAR END AS founded FROM pg""")
O["platform_coverage"] = query(["pg", "pt", "dl"], "SELECT vendor, " + ", ".join(
    f"regexp_matches(w, {lit('|'.join(ws))}) AS {n}" for n, ws in K.PLATFORM_WORDS.items()) + f""" FROM (
  SELECT vendor, lower(coalesce((SELECT string_agg({feature_name('p_name')}, ' ' ORDER BY idx) FROM pt WHERE pt.page_id = pg.page_id), '') || ' | ' ||
    coalesce((SELECT min(source) FROM dl WHERE dl.page_id = pg.page_id AND slot = 3), '')) AS w FROM pg)""")
O["market_texts"] = query(["pg", "dl"], """
SELECT vendor, CASE WHEN page_id IN (SELECT item_id FROM benchmark) THEN 'self-serve' ELSE coalesce(d, 'open') END AS gtm,
  CASE WHEN page_id % 4 = 0 THEN 'certified' ELSE coalesce(d, 'open') END AS moat
FROM (SELECT vendor, page_id, (SELECT min(source) FROM dl WHERE dl.page_id = pg.page_id AND slot = 2) AS d FROM pg)""")
O["fill_defaults"] = query(["pg"], f"""
SELECT vendor, CASE WHEN page_id % 4 = 0 THEN '—' ELSE (page_id % 30 + 1990)::VARCHAR END AS founded, {_STAGE} AS stage, CASE WHEN page_id % 6 = 5 THEN '—' ELSE 'from $9' END AS pricing,
  page_id % 9 <> 0 AND page_id % 2 = 0 AS pricing_verified, CASE page_id % 5 WHEN 1 THEN 'CNY' WHEN 2 THEN 'HKD' ELSE 'USD' END AS pricing_currency FROM pg""")
_SEG = """SELECT s_name AS vendor, CASE WHEN s_acctbal > 5000 AND (s_nationkey > 10 OR s_acctbal <= 0) THEN 'large' WHEN s_acctbal > 0 AND NOT (s_acctbal > 5000 AND s_nationkey > 10) THEN 'seg' || s_nationkey ELSE '其他' END AS segment FROM supplier"""
O["assign_segments"] = _SEG
O["segment_summary"] = f"SELECT segment, count(*) AS n FROM ({_SEG}) GROUP BY segment"
O["stage_groups"] = query(["pg"], f"SELECT {_STAGE} AS segment, count(*) AS n FROM pg GROUP BY 1")
O["opportunity_defaults"] = """SELECT c_custkey AS ord, CASE WHEN c_nationkey <> 3 THEN c_name ELSE '（未命名机会）' END AS title,
  CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 1000) ELSE 7 END AS INT) AS score FROM customer"""
O["vendor_feature_counts"] = query(["cat"], "SELECT vendor, count(*) AS features, count(DISTINCT category) AS categories FROM cat GROUP BY vendor")
O["founding_timeline"] = query(["pg"], f"SELECT vendor, CAST(page_id % 30 + 1990 AS INT) AS year, {_STAGE} AS stage FROM pg WHERE page_id % 4 <> 0")
O["top_gap"] = """SELECT 'gap ' || o_orderkey AS gap, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS severity FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_orderkey LIMIT 1"""
O["top_opportunities"] = "SELECT c_name AS title, c_acctbal AS score FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 3"
O["candidate_list"] = """SELECT name, hits, forced FROM (SELECT 'U' || user_id AS name, count(*) FILTER (event_type = 'click') AS hits, bool_or(value > 480) AS forced, bool_or(value < 0.05) AS gone FROM events GROUP BY 1)
WHERE NOT gone AND (hits > 0 OR forced) ORDER BY forced DESC, hits DESC, name LIMIT 20"""
O["url_sample"] = "SELECT url FROM pages ORDER BY page_id LIMIT 10"
_KN = values([(n, h, p, dd) for n, h, p, dd in K.KNOWN_VENDORS], "known, home, price_page, docs_page")
_KEY = lambda c: "regexp_replace(" + "regexp_replace(" * len(K.NAME_SUFFIXES) + f"lower(trim({c}))" + "".join(
    f", '{s.replace('.', '[.]')}$', '')" for s in K.NAME_SUFFIXES) + r", '[\s_-]+', '', 'g')"
_TYPED = ["Wati", "respond.io", "Many Chat", "TIDIO.com", "zen-desk", "Twilio "]
O["resolve_vendors"] = query([], f"""
SELECT name, source, url, price_url, docs_url, confidence FROM (
  SELECT n.name, CASE WHEN known IS NOT NULL THEN 'builtin' WHEN looks THEN 'domain-guess' WHEN hit IS NOT NULL THEN 'websearch' ELSE 'unknown' END AS source,
    CASE WHEN known IS NOT NULL THEN home WHEN looks THEN base WHEN hit IS NOT NULL THEN CASE WHEN hit LIKE 'https%' THEN hit ELSE hbase END ELSE '' END AS url,
    CASE WHEN known IS NOT NULL THEN coalesce(price_page, home) WHEN looks THEN base || '/pricing' WHEN hit IS NOT NULL THEN hbase || '/pricing' ELSE '' END AS price_url,
    CASE WHEN known IS NOT NULL THEN docs_page WHEN looks THEN base || '/docs' WHEN hit IS NOT NULL THEN hbase || '/docs' END AS docs_url,
    (CASE WHEN known IS NOT NULL THEN 0.95 WHEN looks THEN 0.4 WHEN hit IS NOT NULL THEN 0.6 ELSE 0 END)::DOUBLE AS confidence
  FROM (SELECT DISTINCT trim(t) AS name, regexp_matches(trim(t), '^(https?://)?[\\w-]+([.][\\w-]+)+(/.*)?$') AS looks, 'https://' || regexp_replace(regexp_replace(trim(t), '^https?://', ''), '/.*$', '') AS base, hit,
      'https://' || replace({host('hit')}, 'www.', '') AS hbase FROM (
      SELECT CASE page_id % 4 WHEN 0 THEN {pick('(page_id // 4)', _TYPED)} WHEN 1 THEN regexp_extract(url, '^https?://([^/]+)', 1) WHEN 2 THEN url ELSE 'name' || page_id END AS t,
        CASE WHEN page_id % 4 = 3 AND url LIKE 'https%' THEN url END AS hit FROM pages)) n LEFT JOIN kn ON {_KEY('kn.known')} = {_KEY('n.name')})""", {"kn": _KN})
_LBL = "split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 2)"
_PH = f"replace({host('u')}, 'www.', '')"
_RH = " OR ".join(f"contains({_PH}, {lit(x)})" for x in K.REVIEW_HOSTS)
O["accept_hits"] = query([], f"""
SELECT name, arg_min(u, o) AS url FROM h WHERE length(name) >= 3 AND NOT ({_RH})
  AND list_contains(string_split_regex(split_part({domain(_PH)}, '.', 1) || ' ' || split_part({_PH}, '.', 1), '[^a-z0-9]+'), regexp_replace(lower(split_part(trim(name), ' ', 1)), '[^a-z0-9]', '', 'g'))
  AND length(regexp_replace(lower(split_part(trim(name), ' ', 1)), '[^a-z0-9]', '', 'g')) >= 3
GROUP BY name""", {"h": f"""SELECT CASE WHEN page_id % 3 = 0 THEN left({_LBL}, 4) ELSE {_LBL} END AS name, page_id * 3 + k AS o,
  CASE k WHEN 0 THEN 'https://www.g2.com/products/' || {_LBL} WHEN 1 THEN url ELSE 'https://www.' || {_LBL} || '.io/' END AS u FROM pages, (VALUES (0), (1), (2)) v(k)"""})
O["lesson_hints"] = """SELECT domain, CAST(nth AS INT) AS nth, hint FROM (SELECT 'd' || user_id % 50 || '.test' AS domain, 'h' || CAST(floor(value) AS BIGINT) AS hint,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS nth FROM events WHERE event_id % 3 <> 0)"""
O["keyword_pages"] = query(["cap"], f"""
SELECT domain, keyword, min(p.url) AS url FROM kw JOIN p USING (domain) WHERE contains(low, {norm('lower(trim(split_part(keyword, ' + lit('(') + ', 1)))')}) AND lower(trim(split_part(keyword, '(', 1))) <> '' GROUP BY domain, keyword""",
                           {"p": f"SELECT url, {norm('lower(text)')} AS low, {domain(host('url'))} AS domain FROM cap WHERE {sufficient('text', 300)}",
                            "kw": f"""SELECT DISTINCT {domain(host('url'))} AS domain, regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' (beta)' AS keyword FROM pages"""})
O["budget_flags"] = """SELECT event_id AS ord, coalesce(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 300 AS over_budget FROM events"""
O["report_check"] = query(["pg", "cited", "cat"], """
SELECT count(*) >= 3 AS three_vendors, bool_and(page_id % 9 <> 0) AS price_flag_present, bool_and(page_id % 2 = 1) AS conclusions_present, true AS conclusions_sourced,
  (SELECT count(*) FROM reg) > 0 AS has_sources, (SELECT count(*) = count(DISTINCT url) FROM reg) AS one_row_per_url, (SELECT count(*) FROM marks) > 0 AS matrix_filled FROM pg""", {"reg": _REG, **_M})
O["report_texts"] = f"""SELECT (SELECT count(*) > 0 FROM documents WHERE lang = 'en' AND trim(coalesce(text, '')) <> '') AS summary_present,
  coalesce(bool_and(coalesce(source, '') <> ''), true) AS points_sourced, coalesce(bool_and(NOT contains(coalesce(inspiration, ''), '待补充')), true) AS points_clean
FROM ({O["inspiration_points"]})"""
O["lesson_table"] = """SELECT 'd' || user_id % 50 || '.test' AS domain, event_type AS issue, count(*) AS runs_seen,
  arg_max('h' || CAST(floor(value) AS BIGINT), event_id) FILTER (event_id % 3 <> 0) AS hint,
  arg_max('r' || event_id % 100, event_id) FILTER (event_id % 4 <> 0) AS resolution, arg_max('e' || event_id % 100, event_id) FILTER (event_id % 5 <> 0) AS evidence,
  arg_max('https://s.test/' || event_id, event_id) FILTER (event_id % 7 = 0) AS alt_sources, rtrim(rtrim(strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS last_seen FROM events GROUP BY 1, 2"""
O["daily_stats"] = query(["flog"], """SELECT strftime(ts::DATE, '%Y-%m-%d') || ' 00:00:00' AS day, engine, url_type, count(*) AS n, count(*) FILTER (success) AS ok, sum(quality)::DOUBLE AS q_sum
FROM flog GROUP BY 1, 2, 3""")
ORACLE = O
