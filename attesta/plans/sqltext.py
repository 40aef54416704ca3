"""SQL text pieces for checking the queries with a second engine."""
from __future__ import annotations

from attesta import constants as K
from attesta.plans import views as W

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
PRICE = (r"(?i)(?:\bUS\$|\bS\$|[$€£¥₹]|\b(?:USD|EUR|GBP|INR|CNY|CAD|AUD)\b|\bRs\.?)\s?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"
         r"|\d[\d,]*(?:\.\d+)?\s?(?:[$€£¥₹]|\b(?:USD|EUR|GBP|INR|CNY|CAD|AUD)\b|元)")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def ins(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rep(x: str, rx: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(rx)}, {lit(to)}, 'g')"


def norm(x: str) -> str:
    return f"trim({rep(f'coalesce({x}, {lit(str())})', WS + '+', ' ')})"


def bare(x: str) -> str:
    """Link labels instead of links, then normalised."""
    return norm(rep(rep(x, K.MD_IMAGE, r"\1"), K.MD_LINK, r"\1"))


def has(x: str, rx: str) -> str:
    return f"regexp_matches({x}, {lit(rx)})"


def visible(x: str) -> str:
    a = f"regexp_replace({x}, '<h1[^>]*>', chr(10) || '# ', 'g')"
    b = f"regexp_replace({a}, '</?(p|br|li|div|nav|ul|footer|article|h1|title)[^>]*>', chr(10), 'g')"
    return f"regexp_replace({b}, '<[^>]+>', ' ', 'g')"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def segs(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda x: x <> '')"


def last_seg(u: str) -> str:
    return f"coalesce(lower(list_extract({segs(path(u))}, -1)), '')"


def domain(h: str) -> str:
    return (f"(CASE WHEN contains({h}, '.') THEN array_to_string(list_slice(string_split(lower({h}), '.'), -2, -1), '.') "
            f"ELSE lower({h}) END)")


def host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower({netloc(u)}), '^.*@', ''), ':[0-9]*$', '')"


def pick(n: str, values) -> str:
    return f"list_extract({strs(values)}, CAST(({n}) % {len(values)} AS INT) + 1)"


def stamp(n: str) -> str:
    return f"strftime(DATE '2024-01-01' + CAST(({n}) % 40 AS INT), '%Y-%m-%d') || ' 08:30 UTC'"


def price_key(tok: str) -> str:
    low = f"lower({tok})"
    cur = "CASE " + " ".join(f"WHEN contains({low}, {lit(k)}) THEN {lit(v)}" for k, v in K.CURRENCY_OF)
    cur += f" ELSE regexp_extract({low}, '[$€£¥₹]') END"
    dig = f"replace(regexp_extract({tok}, '\\d[\\d,]*(?:\\.\\d+)?|\\.\\d+'), ',', '')"
    return f"({cur}) || '|' || {dig}"


def engine_rank(e: str) -> str:
    return f"(CASE {e} " + " ".join(f"WHEN {lit(n)} THEN {i}" for i, n in enumerate(K.ENGINE_ORDER)) + " ELSE 99 END)"


def url_type(u: str) -> str:
    clean = f"regexp_replace(regexp_replace(lower({u}), '[?#].*$', ''), '/+$', '')"
    return "CASE " + " ".join(f"WHEN {has(clean, rx)} THEN {lit(k)}" for k, rx in K.URL_TYPE_RULES) + " ELSE 'homepage' END"


def quality(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda l: {has('l', NOT_WS)})"
    junk = f"coalesce(list_sum(list_transform(list_filter({lines}, lambda l: {has('l', K.CODE_JUNK)}), lambda l: length(l))), 0)"
    head = f"len(list_filter({lines}, lambda l: {has('l', '^' + WS + '*(#|- |[*] )')}))"
    link = f"(length({x}) - length({rep(x, K.MD_LINK_ANY_LABEL, '')}))"
    return (f"(CASE WHEN {has(x, NOT_WS)} THEN (greatest(0.0::DOUBLE, 1 - least({junk} / length({x})::DOUBLE, 1) * 1.5::DOUBLE) * 0.5::DOUBLE"
            f" + {head} / len({lines})::DOUBLE * 0.3::DOUBLE + least(log10(greatest(length({x}), 10)::DOUBLE) / 5, 1) * 0.2::DOUBLE)"
            f" * greatest(0.05::DOUBLE, 1 - {link} / length({x})::DOUBLE * 1.2::DOUBLE) ELSE 0 END)")


def sufficient(x: str, n: int) -> str:
    inner = rep(x, f"^{WS}+|{WS}+$", "")
    return (f"(length({inner}) >= {n} AND len(regexp_extract_all(lower({x}), '<script')) <= 5 "
            f"AND NOT contains(lower({x}), 'enable javascript'))")


def clean_lines(x: str) -> str:
    l1 = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {norm('l')}), lambda l: l <> '' AND NOT {has('l', K.FRONT_MATTER)})"
    body = rep(rep("l", r"!\[[^\]]*\]\([^)]+\)", ""), K.MD_LINK, r"\1")
    return f"list_filter(list_transform({l1}, lambda l: trim({rep(body, '^[#> ]+', '')})), lambda l: l <> '')"


def period(x: str) -> str:
    p = f"trim({rep(f'coalesce({x}, {lit(str())})', r'(?i)' + chr(92) + r's*(?:/' + chr(92) + r's*|per' + chr(92) + r's+)(?:users?|seats?|人|席位|坐席)', '')})"
    m, y = has(p, K.PERIOD_MONTH), has(p, K.PERIOD_YEAR.replace("(?iU)", "(?i)"))
    return (f"(CASE WHEN {m} AND {y} THEN 'billed' WHEN {m} THEN '/mo' WHEN {has(p, K.PERIOD_BILLED)} THEN 'billed' "
            f"WHEN {y} THEN '/yr' ELSE {p} END)")


def is_free(n: str, p: str) -> str:
    return f"({has(f'trim({n})', K.FREE_NAME)} OR lower(trim({p})) IN {ins(K.FREE_PRICES)})"


def is_custom(n: str, p: str) -> str:
    return (f"(NOT {is_free(n, p)} AND NOT {has(p, '[0-9]')} AND ({has(n, K.CUSTOM_WORDS)} OR {has(p, K.CUSTOM_WORDS)}))")


def money(x: str) -> str:
    return f"'$' || printf('%.2f', ({x})::DOUBLE)"


def feature_name(x: str) -> str:
    noun = "CASE split_part({0}, ' ', 2) ".format(x) + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in W.NOUNS.items())
    return f"(split_part({x}, ' ', 1) || ' ' || {noun} ELSE split_part({x}, ' ', 2) END)"


# ------------------------------------------------------------------ common table expressions
NAV = """
  CASE WHEN page_id % 3 <> 0 THEN '[Pricing](/pricing?p=' || page_id || ') ' ELSE '[Why our pricing changed](/lp/pricing-update-' || page_id || ') ' END
  || CASE WHEN page_id % 4 = 0 THEN '[Docs](https://docs.' || regexp_extract(url, '^https?://[^/]*?([^./]+[.][^./]+)(?:/|$)', 1) || '/start) '
          WHEN page_id % 4 = 1 THEN '[Developers](https://elsewhere.test/docs) ' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '[Customers](/customers) ' WHEN page_id % 5 = 1 THEN '[Customer stories](/a/b/c/customers) ' ELSE '' END
  || CASE WHEN page_id % 7 = 0 THEN '[Blog](/x/../blog/page/2) ' ELSE '' END
  || CASE WHEN page_id % 2 = 0 THEN '[Product tour](features/tour) ' ELSE '' END
  || '[Platform logo](/static/logo.png) [Reviews](mailto:a@b.test) ![team](/team.png)'"""

_NO_CODE = r"regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
_LINKED = f"regexp_replace({_NO_CODE}, '<a href=\"([^\"]*)\">([^<]*)</a>', '[\\2](\\1)', 'g')"

CTE = {
    "cap": f"""
  SELECT page_id, url, 'playwright' AS engine, {visible('html')} AS text FROM pages
  UNION ALL SELECT page_id, url, 'trafilatura', {visible("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} FROM pages
  UNION ALL SELECT page_id, url, 'jina', {NAV} || chr(10) || {visible(_LINKED)} FROM pages""",
    "led": f"""
  SELECT url, page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS vendor,
    CASE WHEN contains(url, 'utm_source=') THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN page_id % 5 = 0 AND {pick('page_id', W.KINDS)} <> 'pricing' THEN [{pick('page_id', W.KINDS)}, 'pricing'] ELSE [{pick('page_id', W.KINDS)}] END AS kinds,
    {stamp('page_id')} AS fetched_at
  FROM pages""",
    "fail": "SELECT url FROM pages WHERE contains(url, 'utm_source=') AND NOT regexp_matches(url, '^https?://blog[.]')",
    "probe": """
  SELECT url, 503 AS http_status, url AS final_url, '2024-01-10' AS probed_at FROM pages WHERE page_id % 11 <> 7
  UNION ALL SELECT url, CASE WHEN page_id % 9 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END,
    CASE WHEN page_id % 10 = 3 THEN 'https://parked.other.test/' ELSE url END, '2024-01-20' FROM pages WHERE page_id % 11 <> 7""",
    "pg": """
  SELECT page_id, 'V' || page_id AS vendor, url, h1, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) AS root FROM (
    SELECT page_id, coalesce(url, 'https://unlisted.test/' || page_id) AS url, coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1
    FROM (SELECT page_id FROM pages UNION SELECT doc_id // 4 FROM documents UNION SELECT p_partkey // 8 FROM part
          UNION SELECT conv_id FROM conversations WHERE role = 'user' UNION SELECT item_id FROM benchmark) LEFT JOIN pages USING (page_id) WHERE page_id IS NOT NULL)""",
    "dl": """
  SELECT doc_id, doc_id // 4 AS page_id, doc_id % 4 AS slot, line, source, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
  WHERE trim(line) <> ''""",
    "pt": """
  SELECT p_partkey // 8 AS page_id, CAST(row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS INT) AS idx,
    p_partkey, p_name, p_type, p_size, p_retailprice FROM part""",
    "talk": "SELECT conv_id AS page_id, text AS opening, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'user'",
    "ptier": f"SELECT vendor, url, idx, {pick('p_size', W.PERIODS)} AS period, {money('p_retailprice')} AS price, p_type AS plan, page_id FROM pg JOIN pt USING (page_id)",
    "ptext": f"""
  SELECT p_partkey, 'playwright' AS engine, 'Plan' || chr(10) || 'from ' || {money('p_retailprice')} || ' per seat' AS text FROM part
  UNION ALL SELECT p_partkey, 'trafilatura', CASE WHEN p_partkey % 9 = 0 THEN 'Plan' || chr(10) || 'from ' || {money('p_retailprice')} || ' per seat'
    ELSE 'Price: US' || {money('p_retailprice')} END FROM part
  UNION ALL SELECT p_partkey, 'jina', CASE WHEN p_partkey % 7 = 0 THEN printf('%.2f', p_retailprice + 10) ELSE printf('%.2f', p_retailprice) END || ' USD' FROM part""",
    "tier": f"""
  SELECT p_brand AS vendor, p_type || ' ' || (p_partkey % 10) AS plan, p_partkey AS ord,
    CASE WHEN p_size % 7 = 0 THEN 'Free' WHEN p_size % 7 = 1 THEN 'Contact us' WHEN p_size % 7 = 2 THEN '49'
      WHEN p_size % 6 = 0 THEN {money('floor(p_retailprice * 100 / 10) / 100')} WHEN p_size % 6 = 1 THEN {money('floor(p_retailprice * 100 / 12) / 100')}
      ELSE {money('p_retailprice')} END AS price,
    {pick('p_size', W.PERIODS)} AS period FROM part""",
    "cat": f"""
  SELECT p_brand AS vendor, p_partkey AS ord, lower(p_type) || ' ' || {feature_name('p_name')} AS name, p_type AS category, p_name AS descr,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://' || lower(replace(p_brand, '#', '-')) || '.test/f/' || p_partkey END AS source FROM part""",
    "pcat": f"SELECT p_brand AS vendor, p_partkey AS ord, {feature_name('p_name')} AS name, p_type AS category FROM part",
    "flog": """
  SELECT event_id, list_extract(['firecrawl', 'playwright', 'trafilatura', 'jina', 'newspaper3k'], CAST(user_id % 5 AS INT) + 1) AS engine,
    CASE event_type WHEN 'signup' THEN 'pricing' WHEN 'error' THEN 'homepage' WHEN 'click' THEN 'docs' WHEN 'view' THEN 'feature' WHEN 'purchase' THEN 'blog' END AS url_type,
    value >= 10 AS success, CAST(least(value / 100, 1.0) AS DECIMAL(10,4)) AS quality, ts FROM events""",
    "hashed": f"SELECT page_id, url, engine, length(text) AS chars, left(sha256({norm('text')}), 16) AS content_hash FROM cap",
    "votes": f"""
  SELECT p_partkey, price_key, count(DISTINCT engine) AS votes, count(DISTINCT left(sha256({norm('text')}), 16)) AS independent_votes,
    string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, arg_min(token, {engine_rank('engine')}) AS token
  FROM (SELECT p_partkey, engine, text, token, {price_key('token')} AS price_key
        FROM (SELECT *, unnest(regexp_extract_all(text, {lit(PRICE)})) AS token FROM ptext))
  GROUP BY p_partkey, price_key""",
    "claims": "",
}

CTE["claims"] = f"""
  SELECT vendor, url AS vendor_url, field, idx, trim(coalesce(source_url, '')) AS source_url, coalesce(quote, '') AS quote, coalesce(statement, '') AS statement, page_id FROM (
    SELECT page_id, vendor, url, 'pricing_source' AS field, 0 AS idx, url AS source_url, '' AS quote, '' AS statement FROM pg
    UNION ALL SELECT page_id, vendor, url, 'tagline_source', 0, url, '', '' FROM pg
    UNION ALL SELECT page_id, vendor, url, 'founded_source', 0, CASE WHEN page_id % 3 = 0 THEN url END, '', '' FROM pg
    UNION ALL SELECT page_id, vendor, url, 'headquarters_source', 0, CASE WHEN page_id % 7 = 0 THEN url END, '', '' FROM pg
    UNION ALL SELECT page_id, vendor, url, 'team_size_source', 0, CASE WHEN page_id % 19 = 0 THEN '/about' END, '', '' FROM pg
    UNION ALL SELECT page_id, vendor, url, 'pricing_tiers', idx, url, '', '' FROM ptier
    UNION ALL SELECT page_id, vendor, url, 'strengths', 0, url, h1, {pick('page_id', W.POINTS)} || ' ' || '官网原文: "' || h1 || '"' FROM pg
    UNION ALL SELECT page_id, vendor, url, 'strengths', 1 + pos, root, regexp_extract(line, {lit(K.WRAPPED_QUOTE)}, 1), concat_ws(' ', nullif(line, ''), nullif(line, '')) FROM pg JOIN dl USING (page_id) WHERE slot = 0
    UNION ALL SELECT page_id, vendor, url, 'weaknesses', pos, root || '/en/pricing/', '', concat_ws(' ', CASE WHEN doc_id % 8 = 1 THEN '待补充:暂无' ELSE nullif(line, '') END, nullif(line, '')) FROM pg JOIN dl USING (page_id) WHERE slot = 1
    UNION ALL SELECT page_id, vendor, url, 'feature_conclusion_points', 0, CASE WHEN page_id % 3 = 1 THEN root ELSE url END, '', h1 FROM pg WHERE page_id % 2 = 1
    UNION ALL SELECT page_id, vendor, url, 'gtm_evidence', 0, url, b.text, 'self-serve' FROM pg JOIN benchmark b ON b.item_id = page_id
    UNION ALL SELECT page_id, vendor, url, 'moat_evidence', 0, url, h1, 'certified' FROM pg WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, vendor, url, 'tech_signals', pos, url, line, line FROM pg JOIN dl USING (page_id) WHERE slot = 3
    UNION ALL SELECT page_id, vendor, url, 'differentiators', pos, url, line, line FROM pg JOIN dl USING (page_id) WHERE slot = 2
    UNION ALL SELECT page_id, vendor, url, 'user_feedback', pos, CASE WHEN page_id % 6 = 1 THEN 'https://www.g2.com/reviews' ELSE root END, '', opening FROM pg JOIN talk USING (page_id)
    UNION ALL SELECT page_id, vendor, url, 'feature_catalog', idx, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN root || '/pricing' ELSE url END,
      CASE WHEN p_partkey % 3 = 0 THEN h1 ELSE '' END, CASE WHEN p_partkey % 3 = 0 AND h1 <> '' THEN h1 ELSE p_name END FROM pg JOIN pt USING (page_id)
    UNION ALL SELECT page_id, vendor, url, 'product_momentum', 0, url, h1, h1 FROM pg WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, vendor, url, 'pricing_vote_detail', 0, url, h1, '' FROM pg WHERE page_id % 5 = 0 AND page_id % 10 <> 0
  ) WHERE trim(coalesce(source_url, '')) <> '' OR coalesce(quote, '') <> ''"""
CTE["cited"] = "SELECT * FROM claims WHERE source_url <> '' AND field <> 'pricing_vote_detail'"

NEEDS = {"hashed": ["cap"], "votes": ["ptext"], "ptier": ["pg", "pt"],
         "claims": ["pg", "pt", "ptier", "dl", "talk"], "cited": ["claims"]}


def query(needs: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named views, in dependency order, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)
    for n in needs:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({b})" for n, b in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
