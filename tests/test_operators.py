"""Operators on small tables, against brute force where the rule allows it."""
import itertools
import random

import pytest

from pyspark.sql import functions as F

from attesta.operators import audit as A, captures as C, claims as Q, components, features as X, gates as G, links as L, marts as M, spread as S, votes as V


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_votes_and_independence(spark):
    caps = spark.createDataFrame([
        ("u", "jina", "from $39 a month"), ("u", "trafilatura", "from  $39 a month"), ("u", "playwright", "US$39 and $89"),
        ("v", "jina", "Hours 39")], "url string, engine string, text string")
    got = {r["price_key"]: (r["votes"], r["independent_votes"], r["engines"]) for r in V.price_votes(caps, ["url"]).collect()}
    assert got == {"$|39": (3, 2, "jina,playwright,trafilatura"), "$|89": (1, 1, "playwright")}
    c = V.cross_validated(V.price_votes(caps, ["url"]), ["url"]).first()
    assert c["cross_validated"] and c["verified"]


def test_dense_index_and_stable_rank(spark):
    rnd = random.Random(2)
    data = [(g, rnd.choice([1, 2, 3]), i) for i, g in enumerate(rnd.choices("ab", k=200))]
    df = spark.createDataFrame(data, "g string, v int, o bigint")
    idx = S.dense_index(df, ["o"], parts=7)
    assert [r["idx"] for r in idx.orderBy("o").collect()] == list(range(1, 201))
    rank = {(r["g"], r["o"]): r["rank"] for r in S.stable_rank(df, ["g"], "v", "o", bucket_rows=13).collect()}
    for g in "ab":
        want = sorted([d for d in data if d[0] == g], key=lambda d: (-d[1], d[2]))
        assert [rank[(g, d[2])] for d in want] == list(range(1, len(want) + 1))


def test_quotes_are_found_on_their_own_page_only(spark):
    caps = spark.createDataFrame([("u", "jina", "one  [two](http://x) three"), ("u", "other", "four"), ("v", "jina", "five"), ("w", "jina", None)],
                                 "url string, engine string, text string")
    cases = [("u", "one two three", True), ("u", "two three four", False), ("u", "four", True), ("v", "four", False), ("none", "one", False), ("u", " ", True),
             ("w", "x", False), ("u", "four", True)]
    df = spark.createDataFrame([(i, u, q) for i, (u, q, _) in enumerate(cases)], "i int, source_url string, quote string")
    assert {r["i"]: r["found"] for r in Q.find_quotes(df, caps).collect()} == {i: c[2] for i, c in enumerate(cases)}


def test_sellers_without_plans(spark):
    v = spark.createDataFrame([("a",), ("b",)], "vendor string")
    t = spark.createDataFrame([("a", "Pro", 1, "$9", "/mo"), ("a", "Max", 2, "$9", "/mo"), ("a", "Big", 3, "$90", "/yr")],
                              "vendor string, plan string, ord int, price string, period string")
    assert dict(rows(V.commercial_model(v, t)))["b"] == "未公开"
    assert {r["vendor"]: (r["segments"], r["price"]) for r in V.vendor_price_display(v, t).collect()} == {"a": (2, "$9·/mo / $90·/yr"), "b": (0, "未公开")}


def test_price_depth_counts_its_own_run(spark):
    v = spark.createDataFrame([("a", "https://a.io/pricing", False), ("b", "https://b.io/pricing", False)], "vendor string, site string, verified boolean")
    led = spark.createDataFrame([(1, "https://a.io/pricing", "https://a.io/pricing", ["pricing"]), (2, "https://b.io/pricing", "https://b.io/pricing", ["pricing"]),
                                 (2, "https://b.io/docs", "https://b.io/docs", ["docs"])], "run int, site string, url string, kinds array<string>")
    none = spark.createDataFrame([], "vendor string, engine string, tokens long, plan string, price string, period string")
    got = {r["vendor"]: r["status"] for r in A.price_depth(v, none.select("vendor", "engine", "tokens"), led, none.select("vendor", "plan", "price", "period")).collect()}
    assert got == {"a": "gap", "b": "not-published"}


def test_feature_points_list_all_exclusives_and_all_missing(spark):
    names = {"a": ["inbox shared", "webhook engine", "campaign email", "mobile widget", "import wizard"],
             "b": ["inbox shared", "campaign email", "report builder", "export wizard"],
             "c": ["inbox shared", "report builder", "sandbox mode", "theme editor"], "d": ["search index"]}
    data = [(v, i * 10 + k, n, "c", "") for i, (v, ns) in enumerate(names.items()) for k, n in enumerate(ns)]
    cat = spark.createDataFrame(data, "vendor string, ord int, name string, category string, desc string")
    got = sorted(map(tuple, X.feature_points(cat, cat.select("vendor"), 0.5).collect()))
    common = ["inbox shared", "campaign email", "report builder"]  # three holders, then two, in input order
    held = {v: [n for n in common if n in ns] for v, ns in names.items()}
    want = [(v, "missing", k + 1, n) for v in names for k, n in enumerate(x for x in common if x not in held[v])]
    single = [n for ns in names.values() for n in ns if sum(n in m for m in names.values()) == 1]
    want += [(v, "exclusive", k + 1, n) for v, ns in names.items() for k, n in enumerate(x for x in ns if x in single)]
    assert got == sorted(want)
    row = {r["vendor"]: r for r in X.feature_conclusions(cat, cat.select("vendor"), 0.5).collect()}
    assert (row["d"]["held"], row["d"]["total"], row["d"]["missing"]) == (0, 3, ", ".join(common)) and row["a"]["exclusives"] == 3


def test_register_numbers_long_catalogs(spark):
    data = [(v, f, i) for v in range(3) for f in range(2) for i in range(150)]
    df = spark.createDataFrame([((v, f, i), f"https://x.test/{v}/{f}/{i}", "k", "same start " * 9 + str(i % 2)) for v, f, i in data],
                               "ord struct<v: int, f: int, i: int>, url string, kind string, claim string")
    got = {r["url"]: r["idx"] for r in M.source_register(df).collect()}
    assert [got[f"https://x.test/{v}/{f}/{i}"] for v, f, i in data] == list(range(1, 901))
    one = M.source_register(df.withColumn("url", F.lit("https://x.test/"))).first()
    assert one["claims"] == 2


def test_find_passages_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gam", "delta", "eps", "zeta", "a", "an", "ant", "x"]
    docs = [(i, "  ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(60)]
    quotes = []
    for i in range(80):
        text = " ".join(docs[rnd.randrange(60)][1].split())
        if not text:
            continue
        a = rnd.randrange(len(text))
        quotes.append((i, text[a:a + rnd.choice([1, 2, 3, 5, 9, 20, 60, 90])]))
    quotes += [(900, "never there"), (901, "")]
    got = set(rows(Q.find_passages(spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string"))))
    flat = {i: " ".join(t.split()) for i, t in docs}
    want = {(q, d) for q, s in quotes for d, t in flat.items() if s.strip() and " ".join(s.split()) in t}
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 6), (20, 21)]
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}
    df = spark.createDataFrame(edges, "a int, b int")
    assert dict(rows(components.connected(df))) == want


def test_variant_groups_equal_pairwise(spark):
    from attesta import constants as K
    rnd = random.Random(4)
    stems = ["inbox", "team", "shared", "campaign", "report", "bot", "flow", "contact", "sync", "webhook"]
    names = sorted({" ".join(rnd.sample(stems, rnd.randint(1, 4))) for _ in range(40)})
    names.append(" ".join("ab cdx efg hij klm nop qrs tuv wxy zab bcd cde def".split()))
    names.append(" ".join("cdx efg hij klm nop qrs tuv wxy".split()))
    cat = spark.createDataFrame([("v", i, n) for i, n in enumerate(names)], "vendor string, ord int, name string")
    stops = spark.createDataFrame([], "token string, n bigint")
    got = dict(rows(X.variant_groups(cat, stops)))
    from attesta.functions import text as T
    sig = {r["name"]: set(r["s"]) for r in cat.select("name", T.stem_signature(F.col("name")).alias("s")).collect()}
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in itertools.combinations(names, 2):
        inter = sig[a] & sig[b]
        if inter and (len(inter) * 2 >= len(sig[a] | sig[b]) or any(len(w) >= 6 and w not in K.WEAK_STEMS for w in inter)):
            x, y = sorted([root(a), root(b)], key=names.index)
            parent[y] = x
    assert got == {n: root(n) for n in names}


def test_aliases_cascade(spark):
    al = X.default_aliases(spark, [("Inbox*", ["Team Inbox"], ["inbox", "vulnerab*", "收件箱"]), ("Hooks", ["Webhook"], ["chat bot"])])
    names = ["team inbox", "Shared Inboxs view", "inboxed", "Vulnerabilities found", "新收件箱功能", "chat bots and inbox", "WEBHOOK", "other"]
    got = dict(rows(X.canonical_names(spark.createDataFrame([(n,) for n in names], "name string"), al)))
    assert got == {"team inbox": "Inbox*", "Shared Inboxs view": "Inbox*", "inboxed": "inboxed", "Vulnerabilities found": "Inbox*",
                   "新收件箱功能": "Inbox*", "chat bots and inbox": "Hooks", "WEBHOOK": "Hooks", "other": "other"}


def test_common_gaps_need_three_vendors(spark):
    named = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "vendor string, canonical string")
    assert rows(X.common_gaps(named, named.select("vendor"))) == [("d", "x")]
    two = named.where("vendor in ('a', 'd')")
    assert rows(X.common_gaps(two, two.select("vendor"), 0.5)) == []


def test_holders_by_all_words(spark):
    cat = spark.createDataFrame([("a", 1, "Team Inbox", ""), ("b", 2, "Shared Team Inbox", ""), ("c", 3, "Inbox", "for one team"), ("d", 4, "Campaign", "")],
                                "vendor string, ord int, name string, desc string")
    got = set(rows(X.holders(X.feature_keys(cat), X.vendor_words(cat))))
    assert {v for k, v in got if k == "team inbox"} == {"a", "b", "c"}
    assert {v for k, v in got if k == "inbox"} == {"a", "b", "c"}


def test_capabilities_confidence(spark):
    caps = X.default_capabilities(spark, [("inbox", "收件", "Inbox", "c", ["team inbox", "打标"]), ("api", "接口", "API", "c", ["rest api"])])
    names = spark.createDataFrame([("a", "Team Inbox", 1), ("b", "All inboxes", 2), ("b", "自动打标", 3), ("c", "REST APIs", 4)], "vendor string, name string, ord int")
    m = {(r["vendor"], r["id"]): r["confidence"] for r in X.capability_marks(names, names.select("vendor"), caps).collect()}
    assert m == {("a", "inbox"): "high", ("a", "api"): "low", ("b", "inbox"): "medium", ("b", "api"): "low", ("c", "inbox"): "low", ("c", "api"): "medium"}


def test_links(spark):
    md = ("[Pricing](/pricing?x=1) ![Docs](/docs.png) [Docs](https://docs.x.io/start) [Logo features](/f.png) [Features](https://other.io/features) "
          "[Mail news](mailto:a@x.io) [Stories](/a/b/c/customer-stories) [Blog](/blog/page/2)")
    caps = spark.createDataFrame([("https://www.x.io", "jina", md)], "url string, engine string, text string")
    got = {r["kind"]: r["link"] for r in L.discover_links(caps, ["url", "engine"]).collect()}
    assert got == {"pricing": "https://www.x.io/pricing", "docs": "https://docs.x.io/start", "blog": "https://www.x.io/blog/page/2"}


def test_robots(spark):
    bodies = spark.createDataFrame([("x.io", "User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow:\nDisallow: /private"), ("y.io", "User-agent: *\nDisallow: /")],
                                   "host string, body string")
    pages = spark.createDataFrame([("https://x.io/",), ("https://x.io/private/a",), ("https://y.io/a",), ("https://z.io",)], "url string")
    assert {r[0] for r in rows(L.robots_allowed(pages, L.robots_rules(bodies)))} == {"https://x.io/", "https://z.io"}


def test_primary_prefers_priced_page(spark):
    clean = "# Pricing\n- plans for every team\n- talk to us about volume\n" * 20
    priced = "Plans\nPro $59 monthly and more words\n" * 20
    caps = spark.createDataFrame([("https://x.io/pricing", "playwright", clean), ("https://x.io/pricing", "jina", priced),
                                  ("https://x.io/about", "playwright", clean), ("https://x.io/about", "jina", priced)], "url string, engine string, text string")
    got = {r["url"]: r["engine"] for r in C.primary_capture(caps, ["url"]).collect()}
    assert got == {"https://x.io/pricing": "jina", "https://x.io/about": "playwright"}


def test_evidence_windows_brute_force(spark):
    import re
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("ab 12") if rnd.random() < .1 else "x" for _ in range(600))) for i in range(20)]
    got = sorted(rows(C.evidence_windows(spark.createDataFrame(texts, "id int, t string"), ["id"], "t", "[0-9]+", 10, 5).select("id", "start", "end", "matches")))
    want = []
    for i, t in texts:
        spans = []
        for m in re.finditer("[0-9]+", t):
            s, e = max(0, m.start() - 10), min(len(t), m.end() + 10)
            if spans and s <= spans[-1][1] + 5:
                spans[-1] = [spans[-1][0], max(spans[-1][1], e), spans[-1][2] + 1]
            else:
                spans.append([s, e, 1])
        want += [(i, *sp) for sp in spans]
    assert got == sorted(want)


def test_ledger_rules(spark):
    schema = "vendor string, url string, kind string, engine string, success boolean, text string, fetched_at string, from_cache boolean, error string"
    r = spark.createDataFrame([
        ("v", "u", "homepage", "jina", True, "text one", "2024-01-01 00:00 UTC", False, None), ("v", "u", "pricing", "playwright", False, None, "2024-01-02 00:00 UTC", False, "boom"),
        ("v", "w", "docs", "jina", True, "", "2024-01-01 00:00 UTC", False, "x" * 300)], schema)
    led = {x["url"]: x for x in C.build_ledger(r).collect()}
    assert led["u"]["status"] == "ok" and led["u"]["kinds"] == ["homepage", "pricing"] and list(led["u"]["engines"]) == ["jina"]
    assert led["w"]["status"] == "failed" and led["w"]["engines"] == {}
    fails = {(x["url"], x["kind"]): len(x["error"]) for x in C.failure_rows(r).collect()}
    assert fails == {("u", "pricing"): 4, ("w", "docs"): 300}
    merged = C.merge_ledgers(C.build_ledger(r.where("url = 'w'")), C.build_ledger(r.where("url = 'u'").withColumn("url", F.lit("w")))).first()
    assert merged["status"] == "ok" and merged["kinds"] == ["docs", "homepage", "pricing"]


def test_plan_pairing(spark):
    t = spark.createDataFrame([("v", "Pro", 1, "$69", "/month"), ("v", "Pro", 2, "$59", "billed annually"), ("v", "Team", 3, "$10", "monthly"), ("v", "Team", 4, "$96", "/yr"),
                               ("v", "Free", 5, "$0", "/user"), ("v", "Big", 6, "Contact us", "")], "vendor string, plan string, ord int, price string, period string")
    got = {r["plan"]: (r["save_pct"], r["is_free"], r["is_custom"]) for r in V.pair_plans(t).collect()}
    assert got == {"Pro": (14, False, False), "Team": (20, False, False), "Free": (None, True, False), "Big": (None, False, True)}


def test_cached_fallback_brute_force(spark):
    import datetime as dt
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 40))
    cache = [(f"d{rnd.randint(0, 2)}", f"u{i}", rnd.randint(1, 3), at()) for i in range(60)]
    want_rows = [(i, f"d{rnd.randint(0, 3)}", at()) for i in range(80)]
    got = {r["id"]: r["cached_url"] for r in V.cached_fallback(
        spark.createDataFrame(want_rows, "id int, domain string, at timestamp"),
        spark.createDataFrame(cache, "domain string, url string, engines int, cached_at timestamp")).collect()}
    want = {}
    for i, d, a in want_rows:
        ok = [c for c in cache if c[0] == d and c[2] >= 2 and c[3] <= a and (a - c[3]) <= dt.timedelta(days=14)]
        if ok:
            want[i] = max(ok, key=lambda c: (c[3], c[1]))[1]
    assert got == want


def test_page_coverage_third_party(spark):
    v = spark.createDataFrame([("a", "x.io"), ("b", "y.io")], "vendor string, site string")
    led = spark.createDataFrame([("x.io", "ok", ["homepage", "pricing", "features"]), ("x.io", "failed", ["docs"]), ("y.io", "ok", ["homepage"])],
                                "site string, status string, kinds array<string>")
    third = spark.createDataFrame([("a", "testimonials"), ("a", "docs")], "vendor string, kind string")
    plain = {r["vendor"]: r["status"] for r in A.page_coverage(v, led).collect()}
    assert plain == {"a": "partial", "b": "gap"}
    assert A.page_coverage(v, led, third).where("vendor = 'a'").first()["status"] == "ok"


def test_top_lists(spark):
    none = spark.createDataFrame([("x", None, 2), ("y", None, 1)], "title string, score double, ord int")
    assert [r["title"] for r in M.top_opportunities(none, 1).collect()] == ["y"]
    some = spark.createDataFrame([("x", 3.0, 2), ("y", None, 1), ("z", 9.0, 3)], "title string, score double, ord int")
    assert [r["title"] for r in M.top_opportunities(some).collect()] == ["z", "x"]


def test_accept_hits_whole_label(spark):
    h = spark.createDataFrame([("hub", 1, "https://www.hubspot.com"), ("hub", 2, "https://hub.io/x"), ("zone", 1, "https://timezone.io"), ("hub", 0, "https://www.g2.com/hub")],
                              "name string, ord int, url string")
    assert rows(M.accept_hits(h)) == [("hub", "https://hub.io/x")]


def test_zero_prices_and_empty_texts(spark):
    t = spark.createDataFrame([("v", "P", 1, "$0.00", "/month"), ("v", "P", 2, "$90", "/yr"), ("v", "Q", 3, "$0", "monthly"), ("v", "Q", 4, "$5", "billed annually")],
                              "vendor string, plan string, ord int, price string, period string")
    assert {r["save_pct"] for r in V.pair_plans(t).collect()} == {None}
    caps = spark.createDataFrame([("u", "jina", ""), ("u", "playwright", " \n"), ("u", "trafilatura", None)], "url string, engine string, text string")
    assert C.primary_capture(caps, ["url"]).first()["engine"] == "playwright"
    assert rows(V.price_votes(caps, ["url"])) == []


def test_tiers_from_text(spark):
    v = spark.createDataFrame([("a", "Growth · $59 (month billed annually) / Enterprise Contact Sales / …"), ("b", "Use the ₹999 credits for sending many more messages、Lite $5/mo"), ("c", None)],
                              "vendor string, t string")
    got = sorted((r["vendor"], r["plan"], r["price"], r["period"]) for r in V.tiers_from_text(v, "t").collect())
    assert got == [("a", "Enterprise", "Contact Sales", "—"), ("a", "Growth", "$59", "annually"), ("b", "Lite /mo", "$5", "/mo"), ("b", "—", "₹999", "—")]


def test_find_quotes_with_hot_url_and_copies(spark):
    caps = spark.createDataFrame([("u", "jina", "alpha  beta")] * 5 + [("w", "jina", "see [gamma](x) delta")], "url string, engine string, text string")
    cl = spark.createDataFrame([(i, "u", "alpha beta" if i % 2 else "beta alpha") for i in range(20)] + [(90, "w", "gamma delta"), (91, "z", "any"), (92, "w", " ")],
                               "id int, source_url string, quote string")
    got = {r["id"]: r["found"] for r in Q.find_quotes(cl, caps).collect()}
    assert got == {**{i: bool(i % 2) for i in range(20)}, 90: True, 91: False, 92: True}
    assert Q.find_quotes(cl, caps).count() == 23


def test_newest_run_decides_price_depth(spark):
    """A site of two runs: the older one captured a real price page and a probe elsewhere, the newest only a blog."""
    none = spark.createDataFrame([], "vendor string, engine string, tokens long, plan string, price string, period string")
    v = spark.createDataFrame([("a", "a.io", True), ("b", "b.io", True)], "vendor string, site string, verified boolean")
    led = spark.createDataFrame([(1, "a.io", "https://a.io/pricing", ["pricing"]), (1, "x.io", "https://x.io/docs", ["docs"]), (2, "a.io", "https://a.io/blog", ["blog"]),
                                 (1, "b.io", "https://b.io/blog", ["blog"]), (3, "b.io", "https://b.io/pricing", ["pricing"]), (3, "y.io", "https://y.io/docs", ["docs"])],
                                "run int, site string, url string, kinds array<string>")
    got = {r["vendor"]: r["status"] for r in A.price_depth(v, none.select("vendor", "engine", "tokens"), led, none.select("vendor", "plan", "price", "period")).collect()}
    assert got == {"a": "gap", "b": "not-published"}


def test_third_party_pages_by_label(spark):
    v = spark.createDataFrame([("wati", "https://www.wati.io"), ("x", "https://x.com"), ("bare", "bare.io")], "vendor string, site string")
    urls = ["https://www.wati.io/pricing", "https://support.wati.io/a", "https://help.watihelp.com/b", "https://apps.example.com/c", "https://bare.net/q", "https://x.com/d"]
    led = spark.createDataFrame([(u, "ok", ["docs", "blog"]) for u in urls] + [("https://wati.failed.com", "failed", ["docs"])], "url string, status string, kinds array<string>")
    got = {(r["vendor"], r["url"]) for r in A.third_party_pages(v, led).collect()}
    # x is a letter of help.example and the like, as the rule is a plain search
    assert got == {("wati", urls[2]), ("x", urls[3]), ("bare", urls[4])}


def test_lessons_name_all_counted_engines_and_ok_pages(spark):
    v = spark.createDataFrame([("a", "a.io", True), ("b", "b.io", True)], "vendor string, site string, verified boolean")
    tokens = spark.createDataFrame([("a", "jina", 0), ("a", "playwright", 0), ("b", "jina", 3), ("b", "playwright", 0)], "vendor string, engine string, tokens long")
    led = spark.createDataFrame([(1, "a.io", "https://a.io/pricing", "ok", ["pricing"]), (1, "a.io", "https://a.io/plans", "failed", ["pricing"]), (1, "x.io", "https://x.io/docs", "ok", ["docs"])],
                                "run int, site string, url string, status string, kinds array<string>")
    depth = A.price_depth(v, tokens, led, spark.createDataFrame([], "vendor string, plan string, price string, period string"))
    got = {r["vendor"]: (r["resolution"], r["alt_sources"]) for r in A.lessons(depth, v, led).collect()}
    assert got == {"a": ("confirmed_not_published", ["https://a.io/pricing"]), "b": ("engines=jina/playwright", [])}


def test_audit_lists_and_common_gaps(spark):
    table = spark.createDataFrame([("a", "price_depth", "not-published"), ("a", "page_coverage", "gap"), ("b", "common_gaps", "partial"), ("b", "price_depth", "ok")],
                                  "vendor string, dimension string, status string")
    assert sorted(map(tuple, A.audit_lists(table).collect())) == [("not_published", "a", "price_depth"), ("unresolved", "a", "page_coverage")]
    gaps = spark.createDataFrame([("b", "SSO"), ("b", "API")], "vendor string, feature string")
    assert sorted(map(tuple, A.common_gap_status(table.select("vendor"), gaps).collect())) == [("a", 0, "ok"), ("b", 2, "partial")]
    assert [r["action"] for r in A.gap_actions(gaps).orderBy("action").collect()] == ["check in the captures: API", "check in the captures: SSO"]


def test_quotes_and_brackets_in_feature_names(one):
    from attesta.functions import text as T
    for name, junk in {"Inbox [beta]": False, "“Smart” inbox": False, '"[broken': True, "accept all cookies": True}.items():
        assert one(T.is_junk_name, name) is junk


def test_a_page_with_very_many_quotes(spark):
    """10,000 quotes of one url against its 1,000 captures: it ends, and every second quote is found."""
    claims = spark.range(10_000).select(F.col("id").cast("int").alias("idx"), F.lit("https://a.io/x").alias("source_url"), F.concat(F.lit("quote number "), F.col("id"), F.lit(" ends")).alias("quote"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("a [quote](http://u) number "), (F.col("id") * 5 + k) * 2, F.lit(" ends  here")))
    caps = spark.range(1000).select(F.lit("https://a.io/x").alias("url"), F.concat(F.lit("e"), F.col("id")).alias("engine"), F.array_join(lines, "\n").alias("text"))
    found = Q.find_quotes(claims, caps)
    assert sorted(found.columns) == sorted([*claims.columns, "found"])
    assert found.groupBy(F.col("idx") % 2 == 0, "found").count().collect().__len__() == 2 and found.where("found").count() == 5000
    assert found.where("found AND idx % 2 = 1").isEmpty()


def test_report_texts(spark):
    points = spark.createDataFrame([("do it", "u"), ("待补充", "u")], "inspiration string, source string")
    text = spark.createDataFrame([(" ",), (None,)], "text string")
    assert tuple(G.report_texts(text, points).first()) == (False, True, False)
    assert tuple(G.report_texts(text.union(spark.createDataFrame([("x",)], "text string")), points.limit(0)).first()) == (True, True, True)


def test_sparse_marks_count_like_the_table(spark):
    """Corrections of marked and unmarked pairs, of unknown vendors and capabilities, and a vendor without any name."""
    caps = X.default_capabilities(spark)
    ids = sorted(r["id"] for r in caps.select("id").distinct().collect())
    names = spark.createDataFrame([(f"v{k % 4}", n, k) for k, n in enumerate([a["alias"] for a in caps.collect()][::5] + ["nothing", "team inbox", " "])], "vendor string, name string, ord int")
    vendors = names.select("vendor").unionByName(spark.createDataFrame([("none",)], "vendor string"))
    notes = spark.createDataFrame([("v0", ids[0], "supports", "e", "n"), ("v0", ids[1], "unknown", None, None), ("none", ids[2], "supports", None, "n"), ("v1", ids[3], "unknown", "e", "n"),
                                   ("stranger", ids[0], "supports", "e", "n"), ("v2", "no such", "supports", "e", "n")], "vendor string, id string, status string, evidence string, note string")
    dense = X.override_marks(X.capability_marks(names, vendors, caps), notes)
    sparse = X.override_supported(X.supported_marks(names, caps), notes, vendors, caps)
    plain = lambda df: sorted(map(str, df.collect()))
    kept = dense.where("status = 'supports' OR note <> '' OR confidence <> 'low'")
    assert plain(sparse.where("status = 'supports' OR note <> '' OR confidence <> 'low'")) == plain(kept.select(*sparse.columns))
    assert plain(X.support_counts(sparse, vendors, caps)) == plain(X.capability_support(dense))
    assert plain(X.vendor_confidence(sparse, vendors, caps)) == plain(X.confidence_counts(dense))


@pytest.mark.parametrize("size", [1, 5, 10, 11, 20])
def test_variant_edges_connect_what_all_pairs_do(spark, size):
    """Sets of about `size` weak stems, many of them half alike or just below: the same components as all pairs."""
    rnd = random.Random(size)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ab", "cd", "ef", "gh")]
    sets = {tuple(sorted(rnd.sample(words, max(1, size + rnd.randint(-2, 2))))) for _ in range(12)}
    for base in sorted(sets):
        for share in (.9, .7, .6, .5):
            kept = rnd.sample(base, max(1, int(len(base) * share)))
            sets.add(tuple(sorted(set(kept + rnd.sample(words, rnd.randint(0, 2 + size // 3))))))
    rows = list(enumerate(sorted(sets)))
    nodes = spark.createDataFrame([(k, list(s)) for k, s in rows], "node long, sig array<string>")
    near = lambda a, b: 2 * len(set(a) & set(b)) >= len(set(a) | set(b))
    want = {k: k for k, _ in rows}
    for _ in rows:
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            if near(a, b):
                want[i] = want[j] = min(want[i], want[j])
    got = {k: k for k, _ in rows} | {r["node"]: r["component"] for r in components.connected(X.variant_edges(nodes)).collect()}
    assert got == want
