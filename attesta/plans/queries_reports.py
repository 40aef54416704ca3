"""Registered queries on features, audits and report tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.functions import text as T, urls as U
from attesta.operators import audit as A, captures as C, claims as Q, features as X, gates as G, marts as M, votes as V
from attesta.plans import queries_evidence as E, views as W


# ------------------------------------------------------------------ features
def _named(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    return X.with_canonical(cat, X.canonical_names(cat, X.default_aliases(s)))


def canonical_names(s, d) -> DataFrame:
    return X.canonical_names(W.catalog(s, d), X.default_aliases(s))


def canonical_names_fuzzy(s, d) -> DataFrame:
    """With word stems: names of the plain catalog without the phrase families."""
    cat = W.plain_catalog(s, d)
    families = [("Security Scanning", ["Security Scanning"], []), ("Email Campaigns", ["Campaigns by email"], [])]
    return X.canonical_names(cat, X.default_aliases(s, families), fuzzy=True, stops=X.stop_tokens(cat))


def feature_marks(s, d) -> DataFrame:
    return X.feature_marks(_named(s, d)).select("canonical", "vendor", "display", "category", "entries", F.coalesce("source", F.lit("")).alias("source"))


def feature_matrix(s, d) -> DataFrame:
    return X.matrix_order(X.feature_rows(X.feature_marks(_named(s, d))))


def category_totals(s, d) -> DataFrame:
    return X.category_totals(X.feature_marks(_named(s, d)))


def exclusive_features(s, d) -> DataFrame:
    return X.exclusive_features(_named(s, d))


def common_gaps(s, d) -> DataFrame:
    cat = W.plain_catalog(s, d)
    families = [("red inbox", ["hot inbox"], []), ("cold rest api", ["new rest api", "old rest api"], [])]
    named = X.with_canonical(cat, X.canonical_names(cat, X.default_aliases(s, families)))
    return X.common_gaps(named, cat.select("vendor"))


def feature_holders(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    return X.holders(X.feature_keys(cat), X.vendor_words(cat)).groupBy("key").agg(F.count("*").alias("holders"))


def feature_conclusions(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    return X.feature_conclusions(cat, cat.select("vendor"), 0.6)


def feature_points(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    return X.feature_points(cat, cat.select("vendor"), 0.6)


def feature_points_mixed(s, d) -> DataFrame:
    """Exclusive and missing features of a catalog in which every 40th name is one vendor's own."""
    own = F.concat(F.col("name"), F.lit(" only "), F.col("vendor"), F.lit("x"), F.col("ord"))
    cat = W.plain_catalog(s, d).withColumn("desc", F.lit("")).withColumn("name", F.when(F.col("ord") % 40 == 0, own).otherwise(F.col("name")))
    return X.feature_points(cat, cat.select("vendor"), 0.6)


def unmentioned_features(s, d) -> DataFrame:
    cat = W.plain_catalog(s, d).withColumn("desc", F.lit(""))
    return X.unmentioned_features(cat, cat.select("vendor"))


def capability_marks(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    return X.capability_marks(cat, cat.select("vendor"), X.default_capabilities(s))


def _notes(s, d) -> DataFrame:
    """A manual correction for every brand's data export."""
    v = W.table(s, d, "part").groupBy(F.col("p_brand").alias("vendor")).agg(F.count("*").alias("n"))
    return v.select("vendor", F.lit("data_export").alias("id"), F.when(F.col("n") % 2 == 0, F.lit("supports")).otherwise(F.lit("unknown")).alias("status"),
                    F.when(F.col("n") % 3 == 0, F.lit("csv dump")).alias("evidence"), F.when(F.col("n") % 5 != 0, F.lit("checked by hand")).alias("note"))


def _sparse_marks(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    cat, caps = W.catalog(s, d), X.default_capabilities(s)
    vendors = cat.select("vendor")
    return X.override_supported(X.supported_marks(cat, caps), _notes(s, d), vendors, caps), vendors, caps


def capability_support(s, d) -> DataFrame:
    return X.support_counts(*_sparse_marks(s, d))


def capability_confidence(s, d) -> DataFrame:
    return X.vendor_confidence(*_sparse_marks(s, d))


def capability_overrides(s, d) -> DataFrame:
    """Every (vendor, capability) with its manual correction."""
    return X.override_marks(capability_marks(s, d), _notes(s, d))


def _raw_catalog(s, d) -> DataFrame:
    """Catalog entries as sloppy pages write them."""
    k, n = F.col("p_partkey"), F.col("p_name")
    name = (F.when(k % 7 == 0, F.concat(F.lit("**"), F.initcap(n), F.lit("**"))).when(k % 7 == 1, F.concat(F.lit("["), n, F.lit("](https://x.test/f)")))
            .when(k % 7 == 2, F.concat(F.lit("Discover "), n)).when(k % 7 == 3, F.concat(n, F.lit(" is great."))).when(k % 7 == 4, F.upper(n))
            .when(k % 7 == 5, F.concat(F.lit("Accept all "), n)).otherwise(n))
    return W.table(s, d, "part").select(F.col("p_brand").alias("vendor"), k.alias("ord"), name.alias("name"), F.col("p_type").alias("category"))


def repair_catalog(s, d) -> DataFrame:
    return X.repair_catalog(_raw_catalog(s, d))


def fill_catalog(s, d) -> DataFrame:
    cat = W.catalog(s, d)
    some = cat.where(~F.col("vendor").endswith("3"))
    return X.fill_catalog(some, cat.select("vendor", "ord", F.col("desc").alias("name"))).select("vendor", "ord", "name", "source")


def stop_tokens(s, d) -> DataFrame:
    return X.stop_tokens(W.plain_catalog(s, d))


def stop_tokens_texts(s, d) -> DataFrame:
    """Tokens that say nothing when every document is taken for a name."""
    return X.stop_tokens(W.table(s, d, "documents").select(F.col("text").alias("name")))


def stem_signatures(s, d) -> DataFrame:
    """Word stems of every line of every document."""
    lines = W.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return lines.select("doc_id", (F.col("nth") + 1).alias("nth"), F.array_join(T.stem_signature(F.col("line")), " ").alias("stems"))


def variant_groups(s, d) -> DataFrame:
    cat = W.plain_catalog(s, d)
    return X.variant_groups(cat, X.stop_tokens(cat))


def auto_aliases(s, d) -> DataFrame:
    cat = W.plain_catalog(s, d)
    return X.auto_aliases(cat, X.stop_tokens(cat))


def alias_layers(s, d) -> DataFrame:
    """Default layer, automatic layer from shared names, user layer from part types."""
    shared = (W.plain_catalog(s, d).groupBy("name").agg(F.count_distinct("vendor").alias("n")).where(F.col("n") >= 2))
    auto = shared.select(F.when(F.col("name").endswith("inbox"), F.lit("Inbox")).otherwise(F.col("name")).alias("canonical"), F.col("name").alias("alias"))
    user = W.table(s, d, "part").select(F.col("p_type").alias("canonical"), F.concat_ws(" ", "p_type", "p_size").alias("alias")).distinct()
    return X.layer_aliases(X.default_aliases(s).where(~F.col("phrase")), auto, user)


def unified_share(s, d) -> DataFrame:
    k = F.col("ord")
    cat = W.plain_catalog(s, d).withColumn("name", F.when(k % 3 == 0, F.lit("Inbox")).when(k % 7 == 0, F.concat(F.lit("新版收件箱 "), F.col("name"))).otherwise(F.col("name")))
    families = [("团队收件箱 (Team Inbox)", ["Inbox", "收件箱"], [])]
    return X.unified_share(cat, X.default_aliases(s, families))


def feature_labels(s, d) -> DataFrame:
    return W.catalog(s, d).select("ord", T.feature_label(F.col("name")).alias("label"))


# ------------------------------------------------------------------ audits
def _vendors(s, d) -> DataFrame:
    return W.table(s, d, "pages").select(W.host(F.col("url")).alias("vendor"), W.host(F.col("url")).alias("site")).distinct()


def _site_ledger(s, d) -> DataFrame:
    return W.ledger_pages(s, d).withColumn("site", F.col("vendor"))


def page_coverage(s, d) -> DataFrame:
    return A.page_coverage(_vendors(s, d), _site_ledger(s, d)).select("vendor", F.array_join("missing_kinds", ",").alias("missing"), "status")


def third_party_pages(s, d) -> DataFrame:
    """Pages of other hosts that name a vendor: one vendor for each first label of a host, which other hosts hold too."""
    return A.third_party_pages(_vendors(s, d).withColumn("vendor", F.concat(F.lit("of "), F.col("vendor"))), _site_ledger(s, d))


def coverage_elsewhere(s, d) -> DataFrame:
    """Page coverage when third-party pages count."""
    led, vendors = _site_ledger(s, d), _vendors(s, d)
    return A.page_coverage(vendors, led, A.third_party_pages(vendors, led)).select("vendor", F.array_join(F.array_sort("missing_kinds"), ",").alias("missing"), "status")


def _page_vendors(s, d) -> DataFrame:
    """One vendor per page with price tokens seen by extractors and part tiers."""
    return W.table(s, d, "pages").select("page_id", F.concat(F.lit("V"), F.col("page_id")).alias("vendor"), F.col("url").alias("site"),
                                         (F.col("page_id") % 2 == 0).alias("verified"))


def _page_tokens(s, d) -> DataFrame:
    """Price tokens per vendor page and extractor, from the prices of its parts.

    Every fifth vendor sells on request, and one more in five shows its price to one extractor only.
    """
    p = F.expr("p_partkey div 8")
    shown = F.when(p % 5 == 0, F.lit("on request")).when((p % 5 == 1) & (F.col("engine") != "jina"), F.lit("see site")).otherwise(F.col("text"))
    return (W.price_texts(s, d).select(F.concat(F.lit("V"), p).alias("vendor"), "engine", F.size(F.regexp_extract_all(shown, F.lit(r"\$|USD"), 0)).alias("n"))
            .groupBy("vendor", "engine").agg(F.sum("n").alias("tokens")))


def _run_ledger(s, d) -> DataFrame:
    pid = F.col("page_id")
    return W.table(s, d, "pages").select("page_id", F.expr("page_id div 4").alias("run"), F.col("url").alias("site"),
                                        F.when(pid % 10 == 0, F.concat(F.lit("https://"), W.host(F.col("url")), F.lit("/pricing"))).otherwise(F.col("url")).alias("url"),
                                        F.when(pid % 8 == 4, "failed").otherwise("ok").alias("status"),
                                        F.array(W.pick(pid, ["pricing", "docs", "pricing", "homepage", "blog"])).alias("kinds"))


def _depth(s, d) -> DataFrame:
    v = F.expr("ord div 8")
    tiers = W.tiers(s, d).withColumn("vendor", F.when(v % 7 == 3, F.lit("unassigned")).otherwise(F.concat(F.lit("V"), v)))
    return A.price_depth(_page_vendors(s, d), _page_tokens(s, d), _run_ledger(s, d), tiers)


def price_depth(s, d) -> DataFrame:
    return _depth(s, d).drop("engine_names")


def field_completeness(s, d) -> DataFrame:
    return A.field_completeness(W.vendor_documents(s, d))


def _claimed_tiers(s, d, vendors: DataFrame | None = None):
    docs = (vendors or W.vendor_documents(s, d)).select(F.col("name").alias("vendor"), F.posexplode("pricing_tiers").alias("idx", "t"))
    tiers = docs.select("vendor", "idx", F.col("t.price").alias("price"), F.col("t.source_url").alias("source_url"))
    texts = W.price_texts(s, d).withColumn("page_id", F.expr("p_partkey div 8"))
    pages = W.table(s, d, "pages").select("page_id", "url")
    per = texts.groupBy("page_id", "engine").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return tiers, per.join(pages, "page_id")


def claimed_price_votes(s, d) -> DataFrame:
    return A.claimed_price_votes(*_claimed_tiers(s, d))


def price_vote_status(s, d, vendors: DataFrame | None = None) -> DataFrame:
    docs = vendors or W.vendor_documents(s, d)
    return A.price_vote_status(A.claimed_price_votes(*_claimed_tiers(s, d, docs)), docs.select(F.col("name").alias("vendor")))


def quote_accuracy(s, d) -> DataFrame:
    return A.quote_accuracy(W.vendor_documents(s, d), W.captures(s, d))


def signal_problems(s, d) -> DataFrame:
    docs = W.vendor_documents(s, d)
    moved = F.transform("tech_signals", lambda t: t.withField("source", F.when(F.col("page_id") % 5 == 0, F.lit("")).when(
        F.col("page_id") % 5 == 1, F.lit("https://x.test/docs/")).when(F.col("page_id") % 5 == 2, F.lit("https://x.test")).otherwise(t["source"])))
    return A.signal_problems(docs.withColumn("tech_signals", moved))


def feedback_problems(s, d) -> DataFrame:
    docs = W.vendor_documents(s, d)
    bare = F.transform("user_feedback", lambda t: t.withField("source", F.when(F.col("page_id") % 4 == 1, F.lit("")).otherwise(t["source"])))
    return A.feedback_problems(docs.withColumn("user_feedback", bare))


def _audit(s, d) -> DataFrame:
    docs = W.vendor_documents(s, d, kept=True)
    return A.audit_table(("page_coverage", page_coverage(s, d)), ("price_depth", price_depth(s, d)),
                         ("field_completeness", A.field_completeness(docs)), ("price_votes", price_vote_status(s, d, docs)),
                         ("quote_accuracy", A.quote_accuracy(docs, W.captures(s, d))))


def _gap_vendors(s, d) -> tuple[DataFrame, DataFrame]:
    return W.plain_catalog(s, d).select("vendor").distinct(), common_gaps(s, d)


def common_gap_status(s, d) -> DataFrame:
    """The audit dimension of features that most other vendors list."""
    return A.common_gap_status(*_gap_vendors(s, d))


def audit_lists(s, d) -> DataFrame:
    """Unresolved gaps and vendors without published prices, over six dimensions."""
    vendors, gaps = _gap_vendors(s, d)
    return A.audit_lists(_audit(s, d).unionByName(A.audit_table(("common_gaps", A.common_gap_status(vendors, gaps)))))


def gap_actions(s, d) -> DataFrame:
    return A.gap_actions(common_gaps(s, d))


def audit_summary(s, d) -> DataFrame:
    return A.audit_summary(_audit(s, d))


def next_actions(s, d) -> DataFrame:
    return A.next_actions(_audit(s, d))


def audit_lessons(s, d) -> DataFrame:
    found = A.lessons(_depth(s, d), _page_vendors(s, d), _run_ledger(s, d))
    return found.select("domain", "vendor", "issue", "resolution", F.array_join("evidence", " | ").alias("evidence"),
                        F.array_join("alt_sources", " ").alias("alt_sources"), "hint")


def page_digest(s, d) -> DataFrame:
    caps, led = W.captures(s, d), W.ledger_pages(s, d)
    priced = caps.withColumn("text", F.concat(F.col("text"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\nfrom $"), F.col("page_id"), F.lit(" USD"))).otherwise(F.lit(""))))
    return A.page_digest(caps, led, C.safe_quotes(caps, ["url"]), V.price_votes(priced, ["url"]))


# ------------------------------------------------------------------ report tables
def score_rank(s, d) -> DataFrame:
    return M.score_rank(W.scores(s, d)).select("vendor", F.col("avg").cast("double").alias("avg"), "tier", "rank", "uncalibrated")


def dimension_rank(s, d) -> DataFrame:
    return M.dimension_rank(W.scores(s, d)).select("vendor", "dimension", F.col("score").cast("double").alias("score"), "rank")


def score_summary(s, d) -> DataFrame:
    return M.score_summary(M.score_rank(W.scores(s, d))).withColumn("mean", F.col("mean").cast("double"))


def target_overlap(s, d) -> DataFrame:
    return M.target_overlap(W.target_users(s, d))


def signal_clusters(s, d) -> DataFrame:
    sig = W.vendor_documents(s, d).select(F.col("name").alias("vendor"), F.col("page_id").alias("ord"), F.inline("tech_signals")).select(
        "vendor", "ord", F.col("name").alias("signal"))
    return M.signal_clusters(sig).select("signal", "adopters")


def _register_claims(s, d) -> DataFrame:
    """Citations in report order: vendors in input order, fields in document order."""
    pos = F.array_position(F.array(*[F.lit(x) for x in E.FIELD_ORDER]), F.col("field"))
    pid = F.substring("vendor", 2, 20).cast("bigint")
    return Q.cited(Q.flatten_claims(W.vendor_documents(s, d))).select(
        F.struct(pid.alias("vendor"), pos.alias("field"), F.col("idx")).alias("ord"), F.col("source_url").alias("url"), F.col("field").alias("kind"), F.col("statement").alias("claim"))


def source_register(s, d) -> DataFrame:
    return M.source_register(_register_claims(s, d)).select("url", "kind", "claims", "verified", "idx", F.md5("claim").alias("claim"))


def sources_by_kind(s, d) -> DataFrame:
    return M.sources_by_kind(M.source_register(_register_claims(s, d)))


def evidence_warnings(s, d) -> DataFrame:
    return M.evidence_warnings(W.vendor_documents(s, d), W.scores(s, d))


def inspiration_points(s, d) -> DataFrame:
    return M.inspiration_points(W.vendor_documents(s, d)).select("vendor", "idx", "angle", "inspiration", "source", F.md5("good").alias("good"))


def weakness_points(s, d) -> DataFrame:
    return M.weakness_points(W.vendor_documents(s, d)).select("vendor", "idx", "angle", "source", F.md5("weakness").alias("weakness"))


def feedback_summary(s, d) -> DataFrame:
    return M.feedback_summary(W.vendor_documents(s, d)).select("vendor", "side", "nth", "label", F.md5("text").alias("text"))


def release_timeline(s, d) -> DataFrame:
    """Purchases as product releases of a user's product."""
    rel = W.table(s, d, "events").where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("vendor"), F.col("user_id").alias("vendor_ord"), F.col("event_id").alias("ord"), F.col("props").alias("title"))
    return M.release_timeline(rel).select("vendor", "ord", "title", "nth")


def release_density(s, d) -> DataFrame:
    return M.release_density(W.vendor_documents(s, d))


def positioning(s, d) -> DataFrame:
    return M.positioning(W.vendor_documents(s, d))


def platform_coverage(s, d) -> DataFrame:
    return M.platform_coverage(W.vendor_documents(s, d))


def market_texts(s, d) -> DataFrame:
    return M.market_texts(W.vendor_documents(s, d))


def fill_defaults(s, d) -> DataFrame:
    return M.fill_defaults(W.vendor_documents(s, d)).select(F.col("name").alias("vendor"), "founded", "stage", "pricing", "pricing_verified", "pricing_currency")


def assign_segments(s, d) -> DataFrame:
    """Suppliers to the first nation-sized segment list that names them, by account balance."""
    sup = W.table(s, d, "supplier")
    seg = (sup.where(F.col("s_acctbal") > 0).select(F.concat(F.lit("seg"), F.col("s_nationkey")).alias("label"), (F.col("s_nationkey") * 2).alias("ord"), F.col("s_name").alias("player"))
           .unionByName(sup.where(F.col("s_acctbal") > 5000).select(F.lit("large").alias("label"), F.lit(21).alias("ord"), F.col("s_name").alias("player"))))
    return M.assign_segments(sup.select(F.col("s_name").alias("vendor")), seg)


def segment_summary(s, d) -> DataFrame:
    return assign_segments(s, d).groupBy("segment").agg(F.count("*").alias("n"))


def stage_groups(s, d) -> DataFrame:
    return M.group_by_stage(W.vendor_documents(s, d)).groupBy("segment").agg(F.count("*").alias("n"))


def opportunity_defaults(s, d) -> DataFrame:
    return M.fill_opportunities(W.table(s, d, "customer").select(
        F.col("c_custkey").alias("ord"), F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("title"),
        F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 1000).cast("int")).alias("score")))


def vendor_feature_counts(s, d) -> DataFrame:
    return M.vendor_feature_counts(W.catalog(s, d))


def founding_timeline(s, d) -> DataFrame:
    return M.founding_timeline(W.vendor_documents(s, d))


def top_gap(s, d) -> DataFrame:
    gaps = W.table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat_ws(" ", F.lit("gap"), "o_orderkey").alias("gap"),
                                          F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("high")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("medium")).otherwise(F.lit("low")).alias("severity"))
    return M.top_gap(gaps).select("gap", "severity")


def top_opportunities(s, d) -> DataFrame:
    return M.top_opportunities(W.table(s, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"),
                                                                F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))).select("title", "score")


def candidate_list(s, d) -> DataFrame:
    e = W.table(s, d, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("name"), "event_type", "value")
    return M.candidate_list(e.where(F.col("event_type") == "click").select("name"), e.where(F.col("value") > 480).select("name"),
                            e.where(F.col("value") < 0.05).select("name"), 20)


def url_sample(s, d) -> DataFrame:
    return M.url_sample(W.table(s, d, "pages").select(F.col("page_id").alias("ord"), "url"), 10).select("url")


def resolve_vendors(s, d) -> DataFrame:
    """Vendor names as users type them: known names, hosts and plain words."""
    pid, url = F.col("page_id"), F.col("url")
    typed = (F.when(pid % 4 == 0, W.pick(pid / 4, ["Wati", "respond.io", "Many Chat", "TIDIO.com", "zen-desk", "Twilio "]))
             .when(pid % 4 == 1, W.host(url)).when(pid % 4 == 2, url).otherwise(F.concat(F.lit("name"), pid)))
    pages = W.table(s, d, "pages")
    found = pages.where(url.startswith("https")).select(F.concat(F.lit("name"), pid).alias("name"), url.alias("url"))
    return M.resolve_vendors(pages.select(typed.alias("name")), M.known_vendors(s), found)


def accept_hits(s, d) -> DataFrame:
    """Search hits: each page host's own first label, a longer name and a review site."""
    pid, url = F.col("page_id"), F.col("url")
    label = F.split_part(W.host(url), F.lit("."), F.lit(2))
    name = F.when(pid % 3 == 0, F.substring(label, 1, 4)).otherwise(label)
    hits = W.table(s, d, "pages").select(name.alias("name"), (pid * 3).alias("ord"), F.inline(F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("https://www.g2.com/products/"), label).alias("url")),
        F.struct(F.lit(1).alias("k"), url.alias("url")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("https://www."), label, F.lit(".io/")).alias("url")))))
    return M.accept_hits(hits.select("name", (F.col("ord") + F.col("k")).alias("ord"), "url"))


def lesson_hints(s, d) -> DataFrame:
    return M.lesson_hints(W.lesson_log(s, d).withColumn("ord", F.col("seq")))


def keyword_pages(s, d) -> DataFrame:
    """For each heading of a site: the first page of the site that holds it, in any reading."""
    caps = W.captures(s, d).select("url", "text")
    dom = W.table(s, d, "pages").select(U.registrable_domain(W.host(F.col("url"))).alias("domain"), F.concat(
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(" (beta)")).alias("keyword")).distinct()
    return M.keyword_pages(caps, dom)


def budget_flags(s, d) -> DataFrame:
    """Event values as fetch seconds of a user's daily run."""
    e = W.table(s, d, "events").select(F.col("user_id").alias("vendor"), F.to_date("ts").alias("run"), F.col("event_id").alias("ord"),
                                       F.col("value").cast("decimal(12,2)").alias("seconds"))
    return M.budget_flags(e, 300.0).select("ord", "over_budget")


def report_check(s, d) -> DataFrame:
    return G.report_check(W.vendor_documents(s, d), M.source_register(_register_claims(s, d)), X.feature_rows(X.feature_marks(_named(s, d))))


def report_texts(s, d) -> DataFrame:
    """Checks on the summary (here the English documents) and on the points derived for every vendor."""
    return G.report_texts(W.table(s, d, "documents").where("lang = 'en'").select("text"), M.inspiration_points(W.vendor_documents(s, d)))


def lesson_table(s, d) -> DataFrame:
    """Lessons after all sightings: runs seen, last sight, latest hint, resolution, evidence and sources that were not empty."""
    from attesta.streaming.jobs import merge_lessons
    return merge_lessons(W.lesson_log(s, d)).select("domain", "issue", "runs_seen", "hint", "resolution", F.array_join("evidence", " | ").alias("evidence"),
                                               F.array_join("alt_sources", " ").alias("alt_sources"), F.col("last_seen").cast("string").alias("last_seen"))


def daily_stats(s, d) -> DataFrame:
    """Extraction attempts per day, extractor and url type: the batch form of the stream job."""
    from attesta.streaming.jobs import windowed_stats
    return windowed_stats(W.fetch_log(s, d), "1 day").select(
        F.col("window.start").cast("string").alias("day"), "engine", "url_type", "n", "ok", F.col("q_sum").cast("double").alias("q_sum"))


QUERIES = {f.__name__: f for f in [
    canonical_names, canonical_names_fuzzy, feature_marks, feature_matrix, category_totals, exclusive_features, common_gaps, feature_holders,
    feature_conclusions, feature_points, unmentioned_features, capability_marks, capability_overrides, capability_support, capability_confidence, repair_catalog, fill_catalog,
    feature_points_mixed, stop_tokens, stop_tokens_texts, stem_signatures, variant_groups, auto_aliases, alias_layers, unified_share, feature_labels, page_coverage, third_party_pages, coverage_elsewhere, price_depth,
    field_completeness, claimed_price_votes, price_vote_status, quote_accuracy, signal_problems, feedback_problems, common_gap_status, audit_lists, gap_actions, audit_summary, next_actions, audit_lessons,
    page_digest, score_rank, dimension_rank, score_summary, target_overlap, signal_clusters, source_register, sources_by_kind, evidence_warnings,
    inspiration_points, weakness_points, feedback_summary, release_timeline, release_density, positioning, platform_coverage, market_texts,
    fill_defaults, assign_segments, segment_summary, stage_groups, opportunity_defaults, vendor_feature_counts, founding_timeline, top_gap, top_opportunities, candidate_list, url_sample, resolve_vendors,
    accept_hits, lesson_hints, keyword_pages, budget_flags, report_check, report_texts, lesson_table, daily_stats]}
