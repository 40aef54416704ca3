"""Files in, gates on clean and on planted evidence, report out."""
import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import captures as C, claims as Q, gates as G
from attesta.sources import files as S

U1 = "https://e.io/features/inbox"
U2 = "https://e.io/pricing"


def analysis(**change):
    v = {"name": "E", "url": "https://e.io", "tagline": "One inbox", "tagline_source": U1, "founded": "2019", "founded_source": U1,
         "pricing": "$59", "pricing_verified": True, "pricing_source": U2, "pricing_engines": ["jina", "trafilatura"],
         "pricing_scraped_at": "2024-01-25 10:00 UTC",
         "pricing_tiers": [{"name": "Pro", "price": "$59", "billing_period": "/user/mo", "source_url": U2}],
         "pricing_vote_detail": [{"line": "Pro · $59", "raw_line": "Pro is $59"}],
         "strengths": [{"point": "Inbox", "evidence": '官网原文: "One inbox for every team"', "score": 8, "source": U1}],
         "weaknesses": [], "differentiators": ["plain text", {"point": "p", "quote": "every team", "source_url": U1}],
         "tech_signals": [{"name": "API", "source": U1, "quote": "REST API"}, "SDK|https://e.io/docs/sdk)."],
         "gtm_evidence": [{"name": "trial", "quote": "Start free", "source": U1}],
         "feature_catalog": {"E": [{"name": "Inbox", "category": "c", "source": U1, "quote": "One inbox"}]},
         "user_feedback": [{"kind": "quote", "text": "great", "source": U1}],
         "feature_conclusion_points": [{"text": "t", "source": U1}]}
    v.update(change)
    return {"competitors": [v]}


CAPTURES = {U1: {"jina": "One  inbox for [every team](/t). Start free. REST API", "trafilatura": "One inbox"},
            U2: {"jina": "Pro is $59", "trafilatura": "Pro $59 monthly"}, "https://e.io/docs/sdk": {"jina": "sdk"}}


def store(tmp_path, a, captures=CAPTURES, failures=(), failed=()):
    (tmp_path / "raw").mkdir(exist_ok=True)
    (tmp_path / "raw" / "a.engines.json").write_text(json.dumps({U1: {"jina": "old text"}}), encoding="utf-8")
    (tmp_path / "raw" / "e.engines.json").write_text(json.dumps(captures), encoding="utf-8")
    (tmp_path / "raw" / "f.engines.json").write_text("{broken", encoding="utf-8")
    fetched = {u: {"status": "ok", "kind": "docs", "engines": {}, "fetched_at": "2024-01-25 10:00 UTC"} for u in captures}
    fetched.update({u: {"status": "failed", "kinds": ["docs"], "engines": {}} for u in failed})
    (tmp_path / "ledger.json").write_text(json.dumps({"fetched": fetched, "failures": [{"competitor": "E", "url": u, "kind": "docs", "error": "x"} for u in failures]}), encoding="utf-8")
    (tmp_path / "analysis.json").write_text(json.dumps(a, ensure_ascii=False), encoding="utf-8")


def gates(spark, tmp_path):
    caps, led = S.read_captures(spark, str(tmp_path / "raw")), S.read_ledger(spark, str(tmp_path / "ledger.json"))
    v, fails = S.read_vendors(spark, str(tmp_path / "analysis.json")), S.read_failures(spark, str(tmp_path / "ledger.json"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    claims = Q.flatten_claims(v)
    parts = [G.claim_gates(claims, led, caps), G.verified_prices(v, C.capture_meta(caps), now), G.honest_gaps(v, led, fails),
             G.no_fabrication(v), G.no_placeholders(v, "name", "weaknesses"), G.structure_contract(v)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return sorted({(r["gate"], r["severity"], r["field"]) for r in every.collect()})


def test_gates_one_by_one_equal_one_pass(spark, tmp_path):
    store(tmp_path, analysis(founded_source="https://e.io/never", gtm_evidence=[{"name": "t", "quote": "invented", "source": U2}], url="https://other.io",
                             strengths=[{"point": "Inbox", "evidence": "text", "source": U2}]))
    caps, led = S.read_captures(spark, str(tmp_path / "raw")), S.read_ledger(spark, str(tmp_path / "ledger.json"))
    claims = Q.flatten_claims(S.read_vendors(spark, str(tmp_path / "analysis.json")))
    whole = G.claim_gates(claims, led, caps)
    split = [G.trace_sources(claims, led), G.verbatim_quotes(claims, caps), G.url_hygiene(claims), G.source_authority(claims)]
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for df in split for r in df.collect())
    assert not G.verdict(G.gate_report(whole)).first()["passed"]
    assert G.verdict(G.gate_report(whole.where("gate = 'G9'"))).first()["passed"]


def test_clean_evidence_passes(spark, tmp_path):
    store(tmp_path, analysis())
    assert gates(spark, tmp_path) == []


@pytest.mark.parametrize("change,expected", [
    ({"founded_source": "https://e.io/never"}, ("G1", "hard", "founded_source")),
    ({"gtm_evidence": [{"name": "t", "quote": "Start paid", "source": U1}]}, ("G2", "hard", "gtm_evidence")),
    ({"strengths": [{"point": "x", "evidence": '官网原文: "invented"', "source": U1}]}, ("G2", "hard", "strengths")),
    ({"pricing_vote_detail": [{"line": "Pro $60"}]}, ("G2", "hard", "pricing_vote_detail")),
    ({"pricing_engines": ["jina"]}, ("G3", "hard", "pricing")),
    ({"pricing_tiers": []}, ("G3", "hard", "pricing")),
    ({"pricing_scraped_at": "2024-01-01 10:00 UTC"}, ("G3", "hard", "pricing")),
    ({"pricing_scraped_at": "yesterday"}, ("G3", "hard", "pricing")),
    ({"founded": "—"}, ("G4", "hard", "founded")),
    ({"headquarters": "Pricing gets expensive at scale"}, ("G5", "hard", "headquarters")),
    ({"feature_best_for": "['teams']"}, ("G5", "hard", "feature_best_for")),
    ({"weaknesses": [{"point": "待补充:暂无", "evidence": "x", "source": U1}]}, ("G5", "hard", "weaknesses")),
    ({"founded_source": "www.e.io/x"}, ("G6", "hard", "founded_source")),
    ({"url": "https://other.io"}, ("G6", "warning", "strengths")),
    ({"strengths": [{"point": "Inbox", "evidence": "text", "source": U2}]}, ("G7", "hard", "strengths")),
    ({"user_feedback": [{"quote": "great", "source": U2}]}, ("G7", "warning", "user_feedback")),
    ({"pricing_tiers": [{"name": "Pro", "price": "$59", "billing_period": "一次性", "source_url": U2}]}, ("G8", "hard", "billing_period"))])
def test_planted_defect_fires(spark, tmp_path, change, expected):
    store(tmp_path, analysis(**change))
    assert expected in gates(spark, tmp_path)


def test_price_statement_may_rest_on_price_page(spark, tmp_path):
    store(tmp_path, analysis(strengths=[{"point": "from $59", "evidence": "x", "source": U2}]))
    assert not [g for g in gates(spark, tmp_path) if g[0] == "G7"]


def test_cached_price_skips_vote_lines_only(spark, tmp_path):
    store(tmp_path, analysis(pricing_from_cache=True, pricing_vote_detail=[{"line": "gone"}], gtm_evidence=[{"name": "t", "quote": "invented", "source": U1}]))
    assert [g for g in gates(spark, tmp_path) if g[0] == "G2"] == [("G2", "hard", "gtm_evidence")]


def test_probes_and_snapshots_newest_counts(spark):
    claims = spark.createDataFrame([("v", "gtm_evidence", 0, u, "text here", "") for u in ("https://a.io/x", "https://b.io/x", "https://c.io/x")],
                                   "vendor string, field string, idx int, source_url string, quote string, statement string")
    probes = spark.createDataFrame([("https://a.io/x", 500, "https://a.io/x", "1"), ("https://a.io/x", 200, "https://a.io/x", "2"),
                                    ("https://c.io/x", 200, "https://c.io/x", "1"), ("https://c.io/x", 404, "https://c.io/x", "2")],
                                   "url string, http_status int, final_url string, probed_at string")
    got = {r["source_url"]: (r["severity"], r["detail"]) for r in G.link_probes(claims, probes).collect()}
    assert got == {"https://b.io/x": ("warning", "not probed"), "https://c.io/x": ("hard", "unreachable")}
    snaps = spark.createDataFrame([("https://a.io/x", "", "1"), ("https://a.io/x", "<p>text <b>here</b>", "2"), ("https://c.io/x", "<p>text here", "1"),
                                   ("https://c.io/x", "<p>gone", "2")], "url string, html string, taken_at string")
    assert [r["source_url"] for r in G.quote_drift(claims, snaps).collect()] == ["https://c.io/x"]


def test_silent_failure(spark, tmp_path):
    store(tmp_path, analysis(), failures=["https://e.io/b"], failed=["https://e.io/b", "https://e.io/c"])
    assert ("G4", "hard", "failures") in gates(spark, tmp_path)
    led, f = S.read_ledger(spark, str(tmp_path / "ledger.json")), S.read_failures(spark, str(tmp_path / "ledger.json"))
    assert [r["url"] for r in G.silent_failures(led, f).collect()] == ["https://e.io/c"]


def test_missing_and_broken_files(spark, tmp_path):
    with pytest.raises(Exception):
        S.read_vendors(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    with pytest.raises(Exception):
        S.read_ledger(spark, str(tmp_path / "bad.json")).collect()
    assert S.read_aliases(spark, str(tmp_path / "none.json")).count() == 0


def test_alias_file_and_report(spark, tmp_path):
    (tmp_path / "al.json").write_text(json.dumps({"aliases": {"Inbox": {"aliases": ["Team Inbox"], "substr": ["shared inbox"]}}}), encoding="utf-8")
    al = S.read_aliases(spark, str(tmp_path / "al.json"))
    assert sorted((r["alias"], r["phrase"]) for r in al.collect()) == [("Inbox", False), ("Team Inbox", False), ("shared inbox", True)]
    S.write_report(al, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_segment_spellings(spark, tmp_path):
    from attesta.operators.marts import assign_segments
    (tmp_path / "a.json").write_text(json.dumps({"market_segments": [{"label": "one", "players": ["a", "b"]}, {"name": "two", "competitors": ["b", "c"]}]}), encoding="utf-8")
    seg = S.read_segments(spark, str(tmp_path / "a.json"))
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "vendor string")
    assert dict(map(tuple, assign_segments(v, seg).collect())) == {"a": "one", "b": "one", "c": "two", "d": "其他"}


def test_loose_opportunities(spark):
    docs = [(1, '{"target_users":"x","pitch":"p","moat":"m","evidence_urls":["u"]}'), (2, '{"differentiation":"x","pitch":"p","moat":"m","evidence_urls":["u"]}'),
            (3, '{"target_users":["x"],"differentiators":[],"validation":null,"pitch":"p","moat":"m","evidence_urls":["u"]}'), (4, "{}")]
    got = {(r["vendor"], r["severity"], r["field"]) for r in G.loose_structure(spark.createDataFrame(docs, "id int, d string"), "id", "d").collect()}
    assert got == {("1", "hard", "target_users"), ("2", "hard", "differentiation"), ("4", "warning", "pitch"), ("4", "warning", "moat"), ("4", "warning", "evidence_urls")}


def test_known_vendors_from_a_file(spark, tmp_path):
    from attesta.operators.marts import resolve_vendors
    (tmp_path / "v.json").write_text(json.dumps({"vendors": {"respond.io": {"name": "Respond.io", "url": "https://respond.io", "pricing": "https://respond.io/pricing", "docs": ""},
                                                             "wati": {"name": "WATI", "url": "https://www.wati.io", "docs": "https://docs.wati.io"}, "gone": {"name": "Gone"}}}), encoding="utf-8")
    known = S.read_known_vendors(spark, str(tmp_path / "v.json"))
    assert sorted(r["known"] for r in known.collect()) == ["Respond.io", "WATI", "respond.io", "wati"]
    names = spark.createDataFrame([("Wati",), (" RESPOND.IO",), ("gone",), ("other.com",)], "name string")
    got = {r["name"]: (r["source"], r["price_url"], r["docs_url"]) for r in resolve_vendors(names, known).collect()}
    assert got["Wati"] == ("builtin", "https://www.wati.io", "https://docs.wati.io") and got["RESPOND.IO"] == ("builtin", "https://respond.io/pricing", None)
    assert got["gone"][0] == "unknown" and got["other.com"][0] == "domain-guess"
    assert S.read_known_vendors(spark, str(tmp_path / "none.json")).count() == 0
