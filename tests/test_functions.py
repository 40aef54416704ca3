"""Literal cases of the text, url and price expressions."""
import hashlib

import pytest

from attesta.functions import prices as P, text as T, urls as U


@pytest.mark.parametrize("text,hit", [
    ("$59", True), ("US$59", True), ("₹999", True), ("Rs. 999", True), ("€39", True), ("39 €", True), ("USD 39", True),
    ("$1,068", True), ("$0.012", True), ("¥299", True), ("299元", True), ("Hours 39", False), ("version 1.2", False),
    ("Pay $.012 per conversation", True), ("starts at $.99", True)])
def test_price_tokens(one, text, hit):
    assert bool(one(P.price_tokens, text)) is hit


def test_price_token_is_whole(one):
    assert one(P.price_tokens, "US$59 or 1.5$ and 1,068 EUR") == ["US$59", "1.5$", "1,068 EUR"]


def test_price_keys(one):
    key = lambda s: one(P.price_key, s)
    assert key("$39") == key("US$39") == key("39 USD") == "$|39"
    assert key("₹999") == key("Rs. 999") == key("Rs.999") == "₹|999"
    assert key("€39") == key("39 €")
    assert key("$39") != key("$89")
    assert key("$1,068") == "$|1068"
    assert key("free") == ""
    assert key("$.012") == "$|.012"
    assert one(lambda c: P.price_key(c, keep_leading_dot=False), "$.012") == "$|012"


@pytest.mark.parametrize("raw,want", [
    ("/user", ""), ("/seat", ""), ("per user", ""), ("/users", ""), ("/user/mo", "/mo"), ("/seats/yr", "/yr"), ("按月", "/mo"),
    ("月付", "/mo"), ("每月", "/mo"), ("包月", "/mo"), ("按年", "/yr"), ("年付", "/yr"), ("包年", "/yr"), ("年度", "/yr"),
    ("monthly billed annually", "billed"), ("monthly (annual discount)", "billed"), ("billed annually", "billed"), ("per year", "/yr"),
    ("一次性", "一次性"), ("—", "—"), ("", "")])
def test_periods(one, raw, want):
    assert one(P.normal_period, raw) == want


def test_plan_classes(one):
    assert one(P.is_free_plan, "Free forever", "") and one(P.is_free_plan, "Basic", "$0")
    assert one(P.is_custom_plan, "Enterprise", "Contact us")
    assert not one(P.is_custom_plan, "Custom", "$99")
    assert one(P.is_monthly, "/mo") and not one(P.is_monthly, "monthly billed annually")
    assert one(P.is_annual, "billed annually") and not one(P.is_annual, "")


def test_white_space_normal_form(one):
    s = "　a \t\n b\x1c\x1dc  d  e "
    assert one(T.norm_ws, s) == " ".join(s.split()) == "a b c d e"
    assert one(T.norm_ws, None) == ""


def test_links_and_hash(one):
    assert one(T.norm_stripped, "see ![x](u)  [Team  Inbox](/t)") == "see x Team Inbox"
    assert one(T.content_hash, "a  b\n") == hashlib.sha256(b"a b").hexdigest()[:16]


def test_quality_of_one_line_of_style(one):
    css = ".css-1ab{color:red}" * 400
    good = "# Plans\n\n- Pro costs 59 a month and covers five people.\n- Business adds reports and support.\n" * 5
    assert one(T.quality_score, css) < 0.3 < one(T.quality_score, good)
    assert one(T.quality_score, "") == 0.0


def test_quality_formula(one):
    import math
    text = "# Head\nplain words here\nvar x = 1;\n[a](b) tail"
    junk = len("var x = 1;") / len(text)
    want = (max(0, 1 - 1.5 * junk) * .5 + .25 * .3 + min(math.log10(len(text)) / 5, 1) * .2) * max(.05, 1 - 1.2 * len("[a](b)") / len(text))
    assert abs(one(T.quality_score, text) - want) < 1e-12


def test_sufficient_body(one):
    assert one(T.body_sufficient, "x" * 200) and not one(T.body_sufficient, " " + "x" * 199 + " ")
    assert not one(T.body_sufficient, "please Enable JavaScript " + "x" * 300)
    assert not one(T.body_sufficient, "<script " * 6 + "x" * 300)


def test_clean_lines(one):
    assert one(T.clean_lines, "title: x\n## Head [a](b)\n\n![i](j)\n>  quote") == ["Head a", "quote"]


def test_code_lines_dropped(one):
    assert one(T.drop_code_lines, "ok\nself.__next_f.push([1])\n@media (x)\nfine") == "ok\nfine"


def test_feature_names(one):
    assert one(T.clean_feature_name, "**Team** [Inbox](https://x.y)  `v2`") == "Team Inbox v2"
    for junk in ["x", "Respond vs Manychat", "Accept all cookies", "Explorar más", "\"[quoted", "It is great.", "Descubre todo", "éàüöèé"]:
        assert one(T.is_junk_feature, junk), junk
    for fine in ["Team Inbox", "REST API", "自动化营销"]:
        assert not one(T.is_junk_feature, fine), fine


def test_stems(one):
    assert one(T.stem_signature, "Automações e Integración de contactos") == one(T.stem_signature, "automacoes integracion contactos")
    assert one(T.stem_signature, "Chatbots") == ["chatbot"]
    assert one(T.stem_signature, "with the for") == []


def test_angle_and_label(one):
    assert one(T.classify_angle, "no keyword") == "产品"
    assert one(T.classify_angle, "市场增长和API") == "市场"
    assert one(T.feature_label, "Broadcasts") == "批量群发"
    assert one(T.feature_label, "Shared Team Inbox") == "团队收件箱"
    assert one(T.feature_label, "中文名") == "" and one(T.feature_label, "nothing") == ""


@pytest.mark.parametrize("url,kind", [
    ("https://docs.x.io/a", "docs"), ("https://x.io/docs", "docs"), ("https://x.io/api-reference", "docs"), ("https://app.x.io", "dashboard"),
    ("https://x.io/pricing/?a=1", "pricing"), ("https://x.io/plans#top", "pricing"), ("https://x.io/about-us", "about"),
    ("https://x.io/integrations/", "integration"), ("https://x.io/case-studies/a", "customer"), ("https://x.io/blog/a", "blog"),
    ("https://x.io/release-notes", "blog"), ("https://x.io/product", "feature"), ("https://x.io/changelog", "changelog"), ("https://x.io/", "homepage")])
def test_url_types(one, url, kind):
    assert one(U.url_type, url) == kind


def test_url_parts(one):
    assert one(lambda c: U.registrable_domain(U.host_of(c)), "https://u@Docs.Wati.IO:8080/a") == "wati.io"
    assert one(lambda c: U.effective_depth(U.path_of(c)), "https://x.io/docs/cat/page/12?q") == 2
    assert one(U.weak_anchor, "https://x.io/en/Pricing/") == "pricing"
    assert one(U.weak_anchor, "https://x.io/?a=1") == "root" and one(U.weak_anchor, "https://x.io/a") == ""
    assert one(U.is_price_page, "https://x.io/plans") and not one(U.is_price_page, "https://x.io/lp/new-pricing-news")
    assert one(U.safe_url, "javascript:alert(1)") == "" and one(U.safe_url, " https://x.io ") == "https://x.io" and one(U.safe_url, "#src-1") == "#src-1"
    assert one(U.redirect_target, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.io%2Fa%3Fb&rut=1") == "https://x.io/a?b"
    assert one(U.source_label, "https://www.g2.com/p") == "G2 评测" and one(U.source_label, "") == "来源"


@pytest.mark.parametrize("base,href", [
    ("https://x.io", "/pricing"), ("https://x.io/a/b", "c"), ("https://x.io/a/b/", "../c?d=1"), ("https://x.io/a", "//y.io/z"),
    ("https://x.io/a", "https://z.io"), ("https://x.io/a?p=2", "c/d"), ("https://x.io/a", "./c/../e/"), ("https://x.io", "c#f")])
def test_resolve_href(one, base, href):
    from urllib.parse import urljoin
    assert one(U.resolve_href, base, href) == urljoin(base.rstrip("/") + "/", href)
