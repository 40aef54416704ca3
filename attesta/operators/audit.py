"""Audits: is the evidence of each vendor complete, and what to do next."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import constants as K
from attesta.functions import prices as P, text as T, urls as U
from attesta.operators.claims import find_quotes
from attesta.operators.spread import first_per_key


def page_coverage(vendors: DataFrame, ledger: DataFrame, third_party: DataFrame | None = None) -> DataFrame:
    """Expected page kinds each vendor has no ok page for: ok, partial (up to two missing) or gap.

    vendors(vendor, site), ledger(site, status, kinds); a page counts for the vendor of its site.
    third_party(vendor, kind) adds accepted evidence from elsewhere.
    """
    kinds = ledger.where(F.col("status") == "ok").select("site", F.explode("kinds").alias("kind")).where(
        F.col("kind").isin(K.EXPECTED_KINDS)).groupBy("site").agg(F.collect_set("kind").alias("got"))
    expected = F.array(*[F.lit(k) for k in K.EXPECTED_KINDS])
    none = F.array().cast("array<string>")
    j = vendors.join(kinds, "site", "left")
    got = F.coalesce("got", none)
    if third_party is not None:
        extra = third_party.where(F.col("kind").isin(K.EXPECTED_KINDS)).groupBy("vendor").agg(F.collect_set("kind").alias("extra"))
        j = j.join(extra, "vendor", "left")
        got = F.array_union(got, F.coalesce("extra", none))
    missing = F.array_except(expected, got)
    return j.select("vendor", missing.alias("missing_kinds"), F.when(F.size(missing) == 0, F.lit("ok"))
                    .when(F.size(missing) <= 2, F.lit("partial")).otherwise(F.lit("gap")).alias("status"))


def third_party_pages(vendors: DataFrame, ledger: DataFrame) -> DataFrame:
    """(vendor, url, kind): ok pages of other hosts whose name holds the first label of the vendor's domain.

    vendors(vendor, site), ledger(url, status, kinds): help centers, app markets and sites of the group.  Every
    stretch of a host's name is a key, so labels and hosts meet by equality and not pair by pair.
    """
    bare = lambda c: F.replace(c, F.lit("www."), F.lit(""))
    home = vendors.select("vendor", bare(F.coalesce(F.nullif(U.host_of(F.col("site")), F.lit("")), F.col("site"))).alias("domain")).where("domain <> ''").distinct()
    home = home.withColumn("part", F.split_part("domain", F.lit("."), F.lit(1))).where("part <> ''")
    pages = ledger.where(F.col("status") == "ok").select("url", F.explode("kinds").alias("kind"), U.host_of(F.col("url")).alias("host"))
    hosts = pages.select("host").distinct()
    longest = home.agg(F.coalesce(F.max(F.length("part")), F.lit(0))).scalar()
    starts = hosts.withColumn("longest", longest).select("host", "longest", F.explode(F.sequence(F.lit(1), F.greatest(F.length("host"), F.lit(1)))).alias("at"))
    sizes = F.sequence(F.lit(1), F.greatest(F.least(F.length("host") - F.col("at") + 1, F.col("longest")), F.lit(1)))
    keys = starts.select("host", F.explode(F.transform(sizes, lambda n: F.substring("host", F.col("at"), n))).alias("part")).distinct()
    met = keys.join(home, "part").where(~F.contains(bare(F.col("host")), F.col("domain"))).select("vendor", "host").distinct()
    return met.join(pages, "host").select("vendor", "url", "kind").distinct()


def price_depth(vendors: DataFrame, tokens: DataFrame, ledger: DataFrame, tiers: DataFrame) -> DataFrame:
    """Status of each vendor's price evidence: ok, partial, gap or not-published.

    vendors(vendor, site, verified), tokens(vendor, engine, tokens), ledger(run, site, url, kinds),
    tiers(vendor, plan, price, period).  A site is judged by its newest run.  No price token anywhere: a
    real price page plus another probe or enough pages in that run means the vendor does not publish, else
    the capture failed.
    """
    shown = F.col("tokens") > 0
    eng = tokens.groupBy("vendor").agg(F.count_if(shown).alias("engines"), F.array_join(
        F.array_sort(F.collect_set("engine")), "/").alias("engine_names"))
    own = ledger.groupBy("site", "run").agg(F.bool_or(
        F.array_contains("kinds", "pricing") & U.is_price_page(F.col("url"), K.AUDIT_PRICE_PAGE_SEGMENTS)).alias("genuine"),
        F.count_if(F.arrays_overlap("kinds", F.array(F.lit("pricing"), F.lit("docs"), F.lit("about")))).alias("own_probes"))
    own = own.groupBy("site").agg(F.max_by(F.struct("run", "genuine", "own_probes"), "run").alias("o")).select("site", "o.*")
    runs = ledger.groupBy("run").agg(F.count("*").alias("pages"), F.count_if(F.arrays_overlap(
        "kinds", F.array(F.lit("pricing"), F.lit("docs"), F.lit("about")))).alias("probes"))
    free, custom = P.is_free_plan(F.col("plan"), F.col("price")), P.is_custom_plan(F.col("plan"), F.col("price"))
    t = tiers.groupBy("vendor").agg(
        F.count("*").alias("tiers"), F.bool_or(P.is_monthly(F.col("period"))).alias("monthly"),
        F.bool_or(P.is_annual(F.col("period"))).alias("annual"), F.bool_or(free).alias("free"), F.bool_or(custom).alias("custom"),
        F.count_if(P.has_price(F.col("price"))).alias("priced"))
    j = (vendors.join(eng, "vendor", "left").join(own, "site", "left").join(runs, "run", "left").join(t, "vendor", "left")
         .na.fill(0, ["engines", "own_probes", "tiers", "priced", "pages", "probes"]).na.fill(False, ["genuine", "monthly", "annual", "free", "custom"]))
    other_probe = (F.col("probes") - F.col("own_probes")) > 0
    n = F.col("engines")
    status = (F.when((n == 0) & F.col("genuine") & (other_probe | (F.col("pages") > 2)), F.lit("not-published"))
              .when(n == 0, F.lit("gap"))
              .when(F.col("tiers") == 0, F.when(n == 1, F.lit("partial")).otherwise(F.lit("ok")))
              .when(F.col("monthly") & F.col("annual") & (F.col("priced") > 0) & (n >= 2), F.lit("ok"))
              .otherwise(F.lit("partial")))
    told = F.array_compact(F.array(
        F.when((n == 0) & ~F.col("genuine"), F.lit("no genuine price page")),
        F.when((n > 0) & (F.col("tiers") > 0) & F.col("annual") & ~F.col("monthly"), F.lit("annual only")),
        F.when((n > 0) & (F.col("tiers") > 0) & F.col("monthly") & ~F.col("annual"), F.lit("monthly only")),
        F.when((n > 0) & (F.col("tiers") > 0) & ~F.col("free") & ~F.col("custom"), F.lit("neither free nor custom plan")),
        F.when((n == 1) & ((F.col("priced") > 0) | (F.col("tiers") == 0)), F.lit("single engine")),
        F.when((n > 0) & (F.col("priced") > 0) & (F.col("verified") == False), F.lit("priced but not verified"))))  # noqa: E712
    return j.select("vendor", status.alias("status"), "engines", "monthly", "annual", "free", "custom", "priced",
                    F.array_join(told, "; ").alias("findings"), "engine_names")


def field_completeness(vendors: DataFrame) -> DataFrame:
    """Fields of vendor documents below their minimum; losing a whole report section is a gap."""
    counts = [F.when(F.coalesce(F.size(f), F.lit(0)) < least, F.lit(f)) for f, least in K.FIELD_MINIMUM.items()]
    texts = [F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in K.REQUIRED_TEXTS]
    missing = F.array_compact(F.array(*counts, *texts))
    blocked = F.arrays_overlap(missing, F.array(*[F.lit(f) for f in K.BLOCKING_FIELDS]))
    asks = F.array_compact(F.array(F.when(F.coalesce(F.size("user_feedback"), F.lit(0)) == 0, F.lit("user_feedback")),
                                   F.when(F.coalesce(F.size("product_momentum"), F.lit(0)) == 0, F.lit("product_momentum"))))
    return vendors.select(F.col("name").alias("vendor"), F.array_join(missing, ",").alias("missing"),
                          F.array_join(asks, ",").alias("collect"),
                          F.when(F.size(missing) == 0, F.lit("ok")).when(blocked, F.lit("gap")).otherwise(F.lit("partial")).alias("status"))


def claimed_price_votes(tiers: DataFrame, captures: DataFrame) -> DataFrame:
    """Per claimed price: extractors that show it on the cited page, by full key and by digits only.

    tiers(vendor, idx, price, source_url), captures(url, engine, text).
    """
    seen = captures.select(F.col("url").alias("source_url"), "engine", F.explode(P.price_tokens(T.norm_ws(F.col("text")))).alias("token"))
    seen = seen.select("source_url", "engine", P.price_key(F.col("token")).alias("k"), P.digits_only(F.col("token")).alias("d")).distinct()
    per_url = seen.groupBy("source_url").agg(F.collect_set(F.struct("engine", "k", "d")).alias("seen"))
    asked = tiers.where(P.has_price(F.col("price"))).withColumns({
        "k": P.price_key(F.regexp_extract("price", f"({K.PRICE_TOKEN})", 1)), "d": P.digits_only(F.col("price"))})
    j = asked.join(per_url, "source_url", "left")
    engines = lambda ok: F.size(F.array_distinct(F.transform(F.filter("seen", ok), lambda s: s["engine"])))
    by_key = F.greatest(engines(lambda s: s["k"] == F.col("k")), F.lit(0))
    by_digits = F.greatest(engines(lambda s: s["d"] == F.col("d")), F.lit(0))
    return j.select("vendor", "idx", "price", F.coalesce(by_key, F.lit(0)).alias("engines_seen"),
                    F.coalesce(by_digits, F.lit(0)).alias("engines_by_digits")).withColumn("agree", F.col("engines_seen") >= 2)


def price_vote_status(votes: DataFrame, vendors: DataFrame) -> DataFrame:
    g = votes.groupBy("vendor").agg(F.count("*").alias("prices"), F.count_if(~F.col("agree")).alias("weak"))
    return vendors.select("vendor").join(g, "vendor", "left").na.fill(0).withColumn("status", F.when(F.col("prices") == 0, F.lit("n-a"))
                                                               .when(F.col("weak") == 0, F.lit("ok")).otherwise(F.lit("partial")))


AUDITED_FIELDS = ["strengths", "weaknesses", "differentiators", "tech_signals", "user_feedback"]


def audit_quotes(vendors: DataFrame) -> DataFrame:
    """(vendor, field, idx, source_url, quote) of five field groups, wrapped quotes opened."""
    blank = F.lit("")

    def rows(field: str, quote, url) -> Column:
        return F.transform(F.coalesce(F.col(field), F.array().cast(vendors.schema[field].dataType)), lambda x, i: F.struct(
            F.lit(field).alias("field"), i.cast("int").alias("idx"), F.trim(F.coalesce(url(x), blank)).alias("source_url"),
            F.coalesce(quote(x), blank).alias("raw")))
    src = lambda x: x["source"]
    parts = [rows("strengths", lambda x: x["evidence"], src), rows("weaknesses", lambda x: x["evidence"], src),
             rows("differentiators", lambda x: x["quote"], lambda x: x["source_url"]),
             rows("tech_signals", lambda x: x["quote"], src), rows("user_feedback", lambda x: x["quote"], src)]
    flat = vendors.select(F.col("name").alias("vendor"), F.inline(F.concat(*parts)))
    opened = T.unwrap_quote(F.col("raw"))
    return flat.select("vendor", "field", "idx", "source_url", F.when(opened != "", opened).otherwise(F.col("raw")).alias("quote")).where(
        (F.col("source_url") != "") & (F.col("quote") != ""))


def quote_accuracy(vendors: DataFrame, captures: DataFrame, sample: int | None = None) -> DataFrame:
    """Per vendor: quotes checked and missed, over the first `sample` quotes (all when None)."""
    q = audit_quotes(vendors)
    order = F.array_position(F.array(*[F.lit(f) for f in AUDITED_FIELDS]), F.col("field"))
    if sample is not None:
        q = first_per_key(q.withColumn("__o", order), ["vendor"], ["__o", "idx"], sample).drop("__o")
    # find_quotes keeps what it is given
    found = find_quotes(q.select("vendor", "source_url", "quote"), captures)
    g = found.groupBy("vendor").agg(F.count("*").alias("checked"), F.count_if(~F.col("found")).alias("missed"))
    return vendors.select(F.col("name").alias("vendor")).join(g, "vendor", "left").na.fill(0).withColumn(
        "status", F.when(F.col("missed") > 0, F.lit("gap")).otherwise(F.lit("ok")))


def signal_problems(vendors: DataFrame) -> DataFrame:
    """Tech signals without source, on a bare host or on a section front page."""
    s = vendors.select(F.col("name").alias("vendor"), F.posexplode("tech_signals").alias("idx", "t"))
    url = F.coalesce("t.source", F.lit(""))
    last = U.last_segment(url)
    problem = (F.when(url == "", F.lit("no source")).when(last == "", F.lit("bare host"))
               .when(last.isin(K.SECTION_FRONT_SEGMENTS), F.lit("section front page")))
    return s.select("vendor", "idx", F.col("t.name").alias("signal"), problem.alias("problem")).where(F.col("problem").isNotNull())


def feedback_problems(vendors: DataFrame) -> DataFrame:
    s = vendors.select(F.col("name").alias("vendor"), F.posexplode("user_feedback").alias("idx", "t"))
    return s.where(F.coalesce("t.source", F.lit("")) == "").select("vendor", "idx", F.lit("no source").alias("problem"))


def common_gap_status(vendors: DataFrame, gaps: DataFrame) -> DataFrame:
    """ok, or partial for vendors that lack features most others list: gaps(vendor, feature)."""
    g = gaps.groupBy("vendor").agg(F.count("*").alias("missing"))
    return vendors.select("vendor").distinct().join(g, "vendor", "left").select(
        "vendor", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.coalesce("missing", F.lit(0)) == 0, F.lit("ok")).otherwise(F.lit("partial")).alias("status"))


def audit_lists(table: DataFrame) -> DataFrame:
    """(list, vendor, dimension): every unresolved gap, and every vendor that does not publish its prices."""
    open_, silent = F.col("status") == "gap", (F.col("status") == "not-published") & (F.col("dimension") == "price_depth")
    return table.where(open_ | silent).select(F.when(open_, F.lit("unresolved")).otherwise(F.lit("not_published")).alias("list"), "vendor", "dimension")


def gap_actions(gaps: DataFrame) -> DataFrame:
    """One action for each feature a vendor should be checked for: (vendor, dimension, action)."""
    return gaps.select("vendor", F.lit("common_gaps").alias("dimension"), F.concat(F.lit("check in the captures: "), F.col("feature")).alias("action"))


def audit_table(*dimensions: tuple[str, DataFrame]) -> DataFrame:
    """(vendor, dimension, status) of all audits."""
    out = None
    for name, df in dimensions:
        part = df.select("vendor", F.lit(name).alias("dimension"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def audit_summary(table: DataFrame) -> DataFrame:
    """Vendors per dimension and status with totals; any gap is unresolved, not-published is not."""
    return (table.rollup("dimension", "status").agg(F.count("*").alias("n"))
            .withColumn("unresolved", (F.col("status") == "gap") & (F.col("n") > 0)))


def next_actions(table: DataFrame) -> DataFrame:
    """What to do about every audit row that is not settled."""
    todo = F.create_map(*[F.lit(x) for kv in {
        "page_coverage": "capture the missing page kinds", "price_depth": "capture the price page again",
        "field_completeness": "complete the fields from the captures", "price_votes": "capture with another engine",
        "quote_accuracy": "correct the quote or its anchor", "common_gaps": "check the feature in the captures",
    }.items() for x in kv])
    return table.where(F.col("status").isin("gap", "partial")).select("vendor", "dimension", todo[F.col("dimension")].alias("action"))


def lessons(depth: DataFrame, vendors: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the audit teaches about a domain: prices not published, or seen only in part.

    depth is price_depth's result, vendors(vendor, site), ledger(site, url, status, kinds).  Each lesson has its
    resolution (the extractors that were counted), evidence, other sources (the price pages captured for the site
    with status ok) and a hint.
    """
    pages = (ledger.where(F.array_contains("kinds", "pricing") & (F.col("status") == "ok")).groupBy("site")
             .agg(F.array_sort(F.collect_set("url")).alias("sources")))
    j = depth.join(vendors.select("vendor", "site"), "vendor").join(pages, "site", "left")
    absent = F.col("status") == "not-published"
    none = F.array().cast("array<string>")
    seen = F.concat(F.lit("月付:"), F.initcap(F.col("monthly").cast("string")), F.lit(" 年付:"), F.initcap(F.col("annual").cast("string")),
                    F.lit("  priced_tiers:"), F.col("priced"))
    bare = F.replace(U.host_of(F.col("site")), F.lit("www."), F.lit(""))
    return j.where(F.col("status").isin("not-published", "partial", "gap")).select(
        F.coalesce(F.nullif(bare, F.lit("")), F.col("vendor")).alias("domain"), "vendor",
        F.when(absent, F.lit("pricing_not_published")).otherwise(F.lit("pricing_single_period_or_engine")).alias("issue"),
        F.when(absent, F.lit("confirmed_not_published")).otherwise(
            F.concat(F.lit("engines="), F.coalesce(F.nullif("engine_names", F.lit("")), F.lit("none")))).alias("resolution"),
        F.when(absent, F.array(*[F.lit(x) for x in K.NOT_PUBLISHED_EVIDENCE])).otherwise(F.array(seen)).alias("evidence"),
        F.when(absent, F.coalesce("sources", none)).otherwise(none).alias("alt_sources"),
        F.when(absent, F.lit(K.NOT_PUBLISHED_HINT)).otherwise(F.lit(K.PARTIAL_PRICE_HINT)).alias("hint"))


def page_digest(captures: DataFrame, ledger: DataFrame, quotes: DataFrame, votes: DataFrame) -> DataFrame:
    """What an author needs per page: kinds, anchor grade, body size, quotable lines, agreed prices.

    quotes(url, quote), votes(url, independent or plain votes): already computed per page.
    """
    order = F.when(F.col("engine") == "trafilatura", 0).when(F.col("engine") == "playwright", 1).when(F.col("engine") == "jina", 2)
    body = (captures.where((F.col("text") != "") & order.isNotNull())
            .withColumns({"lines": F.size(T.clean_lines(F.col("text"))), "rank": order})
            .groupBy("url").agg(F.min(F.struct("rank", "engine", "lines")).alias("b")))
    q = quotes.groupBy("url").agg(F.count("*").alias("quotes"))
    v = votes.where(F.col("votes") >= 2).groupBy("url").agg(F.count("*").alias("agreed_prices"))
    weak = U.weak_anchor(F.col("url"))
    grade = F.when(weak == "root", F.lit("root")).when(weak == "pricing", F.lit("price statements only")).otherwise(F.lit("ok"))
    return (ledger.select("url", F.array_join("kinds", "/").alias("kinds")).join(body, "url", "left").join(q, "url", "left").join(v, "url", "left")
            .select("url", "kinds", grade.alias("anchor"), F.col("b.engine").alias("engine"), F.coalesce("b.lines", F.lit(0)).alias("lines"),
                    F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("agreed_prices", F.lit(0)).alias("agreed_prices")))


