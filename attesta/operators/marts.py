"""Report tables: rankings, overlaps, clusters, registers, derived points, vendor resolution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta import constants as K
from attesta.functions import text as T, urls as U
from attesta.operators.claims import asserts_source, claim_rows, find_phrases
from attesta.operators.components import settle
from attesta.operators.spread import dense_index, stable_rank


# ------------------------------------------------------------------ scores
def uncalibrated() -> Column:
    """All dimensions have one score."""
    return F.size(F.array_distinct(F.array(*K.SCORE_DIMENSIONS))) == 1


def score_rank(scores: DataFrame) -> DataFrame:
    """Mean score, rank and tier of every vendor: top from 90 % of the best, middle from 70 %."""
    dims = [F.col(d) for d in K.SCORE_DIMENSIONS]
    n = sum((d.isNotNull().cast("int") for d in dims), F.lit(0))
    total = sum((F.coalesce(d, F.lit(0).cast("decimal(6,2)")) for d in dims), F.lit(0).cast("decimal(8,2)"))
    avg = F.bround((total / F.greatest(n, F.lit(1))).cast("decimal(18,8)"), 1).cast("decimal(4,1)")
    # read by the best mean and three times by the rank
    base = settle(scores.select("vendor", "ord", avg.alias("avg"),
                                uncalibrated().alias("uncalibrated")))
    top = base.agg(F.max("avg").alias("m")).scalar()
    tier = F.when(F.col("avg") >= top * F.lit("0.9").cast("decimal(2,1)"), F.lit(K.TIERS[0])).when(
        F.col("avg") >= top * F.lit("0.7").cast("decimal(2,1)"), F.lit(K.TIERS[1])).otherwise(F.lit(K.TIERS[2]))
    return stable_rank(base.withColumn("tier", tier), [], "avg", "ord")


def dimension_rank(scores: DataFrame) -> DataFrame:
    """Rank of every vendor in every score dimension, input order breaking ties."""
    long_ = scores.unpivot(["vendor", "ord"], K.SCORE_DIMENSIONS, "dimension", "score")
    return stable_rank(settle(long_.withColumn("score", F.coalesce("score", F.lit(0).cast("decimal(6,2)")))), ["dimension"], "score", "ord")


def score_summary(ranked: DataFrame) -> DataFrame:
    """Leader, last vendor, overall mean and number of vendors with default scores."""
    return ranked.agg(
        F.min_by("vendor", "rank").alias("leader"), F.max_by("vendor", "rank").alias("last"),
        F.count("*").alias("vendors"), F.bround(F.avg("avg").cast("decimal(18,8)"), 1).alias("mean"),
        F.count_if("uncalibrated").alias("uncalibrated"))


# ------------------------------------------------------------------ overlaps and clusters
def target_overlap(targets: DataFrame) -> DataFrame:
    """Targets that at least two vendors go after, with the number of vendors."""
    return targets.groupBy("target").agg(F.count_distinct("vendor").alias("vendors")).where(F.col("vendors") >= 2)


def signal_clusters(signals: DataFrame, k: int | None = None) -> DataFrame:
    """Technology signals with the number of vendors that show them, the k most shown when given; blank names do not count."""
    name = F.trim("signal")
    shown = (signals.where(F.coalesce(name, F.lit("")) != "").groupBy(name.alias("signal"))
             .agg(F.count_distinct("vendor").alias("adopters"), F.min("ord").alias("ord")))
    return shown if k is None else shown.orderBy(F.col("adopters").desc(), "ord").limit(k)


# ------------------------------------------------------------------ source register
def source_register(claims: DataFrame) -> DataFrame:
    """One row per cited url, numbered by first citation, with its first kind and claim count.

    claims(ord, url, kind, claim) with unique, comparable ord (a number or a struct); unsafe urls are
    dropped; each claim text counts once, by its whole text.
    """
    c = claims.withColumn("url", U.safe_url(F.col("url"))).where(F.col("url") != "")
    c = c.withColumn("claim", F.trim(F.coalesce("claim", F.lit(""))))
    g = c.groupBy("url").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"),
                             F.min_by("claim", "ord").alias("claim"),
                             F.count_distinct(F.nullif("claim", F.lit(""))).alias("claims"))
    verified = F.when(U.names_any(F.col("url"), K.USER_SOURCES), F.lit("user")).otherwise(F.lit("bot"))
    return dense_index(g.withColumn("verified", verified), ["ord"]).drop("ord")


def sources_by_kind(register: DataFrame) -> DataFrame:
    return register.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("verified") == "user").alias("user_verified"))


def evidence_warnings(vendors: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts behind the report's warnings, one row; one pass over the documents and one over the scores.

    Without sources is a report whose vendors cite no url that a source register would take.
    """
    priced = (F.trim(F.coalesce("pricing", F.lit(""))) != "") & (F.col("pricing") != "—")
    all_placeholder = (F.size("strengths") > 0) & F.forall("strengths", lambda s: T.is_placeholder(s["point"], s["evidence"], s["score"]))
    sourced = F.exists(claim_rows(vendors), lambda c: asserts_source(c["source_url"], c["field"]) & (U.safe_url(c["source_url"]) != ""))
    v = vendors.agg((F.count_if(sourced) == 0).alias("no_sources"), F.count_if(~F.coalesce("pricing_verified", F.lit(False)) & priced).alias("unverified_prices"),
                    F.count_if(all_placeholder).alias("placeholder_only"))
    return v.select("*", scores.agg(F.count_if(uncalibrated()).alias("n")).scalar().alias("uncalibrated"))


# ------------------------------------------------------------------ derived points
def inspiration_points(vendors: DataFrame) -> DataFrame:
    """Strengths worth copying: sourced, real, not mere size, matching an action rule."""
    s = vendors.select(F.col("name").alias("vendor"), F.posexplode("strengths").alias("idx", "s"))
    point = F.col("s.point")
    real = ~T.is_placeholder(point, F.col("s.evidence"), F.col("s.score")) & (F.coalesce("s.source", F.lit("")) != "")
    mere_size = point.rlike(K.FACTUAL_POINT) & ~point.rlike(K.FACTUAL_EXEMPT)
    hint = None
    for rx, advice in K.ACTION_RULES:
        hit = point.rlike(rx)
        hint = F.when(hit, F.lit(advice)) if hint is None else hint.when(hit, F.lit(advice))
    return (s.where(real & ~mere_size).select("vendor", "idx", T.classify_angle(point).alias("angle"), point.alias("good"),
                                              hint.alias("inspiration"), F.col("s.source").alias("source"))
            .where(F.col("inspiration").isNotNull()))


def weakness_points(vendors: DataFrame) -> DataFrame:
    """Sourced, real weaknesses by angle."""
    s = vendors.select(F.col("name").alias("vendor"), F.posexplode("weaknesses").alias("idx", "s"))
    point = F.coalesce("s.point", F.lit(""))
    keep = ~T.is_placeholder(point, F.col("s.evidence"), F.col("s.score")) & (point != "") & (F.coalesce("s.source", F.lit("")) != "")
    return s.where(keep).select("vendor", "idx", T.classify_angle(point).alias("angle"), point.alias("weakness"), F.col("s.source").alias("source"))


def feedback_summary(vendors: DataFrame) -> DataFrame:
    """Customer voices per vendor, numbered: quotes, own strengths, then weaknesses; a report takes the first few."""
    fb = F.filter(F.transform("user_feedback", lambda x: F.struct(
        F.trim(F.coalesce(F.nullif(x["text"], F.lit("")), x["quote"], F.lit(""))).alias("text"),
        F.concat(U.source_label(x["source"]), F.when(F.coalesce(x["kind"], F.lit("quote")) == "quote", F.lit(K.VOICE_QUOTE))
                 .otherwise(F.lit(K.VOICE_EFFECT))).alias("label"), F.trim(F.coalesce(x["who"], F.lit(""))).alias("who"))),
        lambda x: (x["text"] != "") | (x["who"] != ""))
    voices = F.transform(fb, lambda x: F.struct(
        F.when(x["who"] == "", x["text"]).when(x["text"] == "", x["who"]).otherwise(F.concat(x["text"], F.lit(" —— "), x["who"])).alias("text"),
        x["label"].alias("label")))
    real = lambda col: F.filter(F.col(col), lambda s: ~T.is_placeholder(s["point"], s["evidence"], s["score"]))
    own = F.transform(real("strengths"), lambda s: F.struct(
        F.coalesce(s["point"], F.lit("")).alias("text"), F.concat(U.source_label(s["source"]), F.lit(K.VOICE_OWN)).alias("label")))
    pos = F.concat(voices, own)
    neg = F.transform(real("weaknesses"), lambda s: F.struct(F.coalesce(s["point"], F.lit("")).alias("text"), U.source_label(s["source"]).alias("label")))
    rows = F.concat(F.transform(pos, lambda x, i: F.struct(F.lit("positive").alias("side"), (i + 1).alias("nth"), x["text"].alias("text"), x["label"].alias("label"))),
                    F.transform(neg, lambda x, i: F.struct(F.lit("negative").alias("side"), (i + 1).alias("nth"), x["text"].alias("text"), x["label"].alias("label"))))
    return vendors.select(F.col("name").alias("vendor"), F.inline(rows))


def release_density(vendors: DataFrame) -> DataFrame:
    return vendors.select(F.col("name").alias("vendor"), F.coalesce(F.size("product_momentum"), F.lit(0)).alias("releases"))


def release_timeline(releases: DataFrame, per_vendor: int | None = None) -> DataFrame:
    """Releases of each vendor, numbered; the first per_vendor of each when given.  releases(vendor, vendor_ord, ord, title)."""
    nth = releases.withColumn("nth", F.row_number().over(Window.partitionBy("vendor").orderBy("ord")))
    return nth if per_vendor is None else nth.where(F.col("nth") <= per_vendor)


def positioning(vendors: DataFrame) -> DataFrame:
    """Target segment, company scale and market of each vendor; unknown stays unknown."""
    stage = F.col("stage")
    scale = F.when(stage.isin(K.SMALL_STAGES), F.lit(K.SMALL_SCALE)).when(stage.isin(K.LARGE_STAGES), F.lit(K.LARGE_SCALE)).otherwise(F.lit("—"))
    return vendors.select(F.col("name").alias("vendor"),
                          F.when(F.size("target_users") > 0, F.array_join("target_users", "、")).otherwise(F.lit("—")).alias("target_segment"),
                          scale.alias("scale"), F.coalesce(F.nullif(stage, F.lit("")), F.lit("—")).alias("key_market"), "founded")


def platform_coverage(vendors: DataFrame) -> DataFrame:
    """Web, desktop, mobile and API support, claimed only where a keyword names it."""
    words = F.lower(F.concat(F.array_join(F.transform("feature_catalog", lambda f: F.coalesce(f["name"], F.lit(""))), " "), F.lit(" | "),
                             F.array_join(F.transform("tech_signals", lambda t: F.coalesce(t["name"], F.lit(""))), " ")))
    cols = []
    for name, keys in K.PLATFORM_WORDS.items():
        cols.append(words.rlike("|".join(keys)).alias(name))
    return vendors.select(F.col("name").alias("vendor"), *cols)


def market_texts(vendors: DataFrame) -> DataFrame:
    """Go-to-market and moat lines: the evidence, else a differentiator, else open."""
    names = lambda c: F.array_join(F.transform(c, lambda e: e["name"]), "；")
    diff = lambda i: F.try_element_at(F.col("differentiators"), F.lit(i))["point"]
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    gtm = F.when(~none("gtm_evidence"), names("gtm_evidence")).otherwise(F.coalesce(diff(1), F.lit(K.OPEN_TEXT)))
    moat = F.when(~none("moat_evidence"), names("moat_evidence")).otherwise(F.coalesce(diff(2), diff(1), F.lit(K.OPEN_TEXT)))
    return vendors.select(F.col("name").alias("vendor"), gtm.alias("gtm"), moat.alias("moat"))


def fill_defaults(vendors: DataFrame) -> DataFrame:
    """Missing basics filled with neutral values; a missing price flag means not verified."""
    hq = F.lower(F.coalesce("headquarters", F.lit("")))
    currency = F.when(hq.rlike("中国|china|大陆|beijing|shanghai|shenzhen"), F.lit("CNY")).when(hq.rlike("hong kong|hk"), F.lit("HKD")).otherwise(F.lit("USD"))
    given = F.col("pricing_currency") if "pricing_currency" in vendors.columns else F.lit(None).cast("string")
    return vendors.withColumns({
        "founded": F.coalesce("founded", F.lit("—")), "stage": F.coalesce("stage", F.lit("未知")), "tagline": F.coalesce("tagline", F.lit("")),
        "pricing": F.coalesce("pricing", F.lit("—")), "pricing_verified": F.coalesce("pricing_verified", F.lit(False)),
        "pricing_currency": F.coalesce(F.nullif(given, F.lit("")), currency)})


# ------------------------------------------------------------------ segments
def assign_segments(vendors: DataFrame, segments: DataFrame) -> DataFrame:
    """Each vendor goes to the first listed segment naming it, else to 'other'.

    segments(ord, label, player): one row per listed player.
    """
    first = segments.groupBy(F.col("player").alias("vendor")).agg(F.min_by("label", "ord").alias("segment"))
    return vendors.select("vendor").distinct().join(first, "vendor", "left").select("vendor", F.coalesce("segment", F.lit("其他")).alias("segment"))


def group_by_stage(vendors: DataFrame) -> DataFrame:
    """Without segments, vendors are grouped by stage."""
    return vendors.select(F.col("name").alias("vendor"), F.coalesce("stage", F.lit("未知")).alias("segment"))


def fill_opportunities(items: DataFrame, default_score: int = 7) -> DataFrame:
    return items.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), F.lit("（未命名机会）")),
                              "score": F.coalesce("score", F.lit(default_score))})


def vendor_feature_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("vendor").agg(F.count("*").alias("features"), F.count_distinct("category").alias("categories"))


def founding_timeline(vendors: DataFrame) -> DataFrame:
    year = F.try_to_number(F.trim("founded"), F.lit("9999")).cast("int")
    return vendors.select(F.col("name").alias("vendor"), year.alias("year"), "stage").where(F.col("year") > 0)


# ------------------------------------------------------------------ top lists
def top_gap(gaps: DataFrame) -> DataFrame:
    """The most severe gap, first listed among equals."""
    sev = F.coalesce(*[F.when(F.col("severity") == s, F.lit(r)) for s, r in K.SEVERITY_RANK.items()], F.lit(0))
    return gaps.orderBy(sev.desc(), "ord").limit(1)


def top_opportunities(items: DataFrame, k: int = 3) -> DataFrame:
    """The k highest scored; when nothing is scored, the first k as listed."""
    any_scored = items.agg(F.coalesce(F.bool_or(F.col("score").isNotNull()), F.lit(False)).alias("s")).scalar()
    return items.where(F.col("score").isNotNull() | ~any_scored).orderBy(F.col("score").desc_nulls_last(), "ord").limit(k)


def candidate_list(hits: DataFrame, include: DataFrame, exclude: DataFrame, k: int) -> DataFrame:
    """Vendors by number of search hits, forced ones first, excluded ones out, top k."""
    counts = hits.groupBy("name").agg(F.count("*").alias("hits"))
    forced = include.select("name", F.lit(True).alias("forced")).distinct()
    return (counts.join(forced, "name", "full").join(exclude.select("name"), "name", "left_anti")
            .select("name", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("forced", F.lit(False)).alias("forced"))
            .orderBy(F.col("forced").desc(), F.col("hits").desc(), "name").limit(k))


def url_sample(urls: DataFrame, n: int) -> DataFrame:
    return urls.orderBy("ord").limit(n)


# ------------------------------------------------------------------ vendor resolution
def name_key(c: Column) -> Column:
    n = F.lower(F.trim(c))
    for suffix in K.NAME_SUFFIXES:
        n = F.regexp_replace(n, suffix.replace(".", r"\.") + "$", "")
    return F.regexp_replace(n, r"[\s\-_]+", "")


def known_vendors(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or K.KNOWN_VENDORS, "known string, home string, price_page string, docs_page string")


def resolve_vendors(names: DataFrame, known: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Home, price and documentation page of each name with a confidence.

    Known vendor .95, domain-shaped input .4, accepted search hit .6, otherwise 0.
    """
    n = names.select(F.trim("name").alias("name")).where(F.col("name") != "").distinct().withColumn("k", name_key(F.col("name")))
    dim = known.withColumn("k", name_key(F.col("known"))).dropDuplicates(["k"])
    j = n.join(dim, "k", "left")
    looks = F.col("name").rlike(r"(?U)^(https?://)?[\w-]+(\.[\w-]+)+(/.*)?$")
    base = F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace("name", "^https?://", ""), "/.*$", ""))
    if found is not None:
        j = j.join(found.select("name", F.col("url").alias("hit_url")), "name", "left")
    else:
        j = j.withColumn("hit_url", F.lit(None).cast("string"))
    hit_base = F.when(F.col("hit_url").isNotNull(), F.concat(F.lit("https://"), U.plain_host(F.col("hit_url"))))
    source = (F.when(F.col("known").isNotNull(), F.lit("builtin")).when(looks, F.lit("domain-guess"))
              .when(F.col("hit_url").isNotNull(), F.lit("websearch")).otherwise(F.lit("unknown")))
    guess = F.when(looks, base).otherwise(hit_base)
    return j.select("name", source.alias("source"),
                    F.coalesce("home", F.when(looks, base), F.when(F.col("hit_url").startswith("https"), F.col("hit_url")), hit_base, F.lit("")).alias("url"),
                    F.coalesce(F.when(F.col("known").isNotNull(), F.coalesce("price_page", "home")), F.concat(guess, F.lit("/pricing")), F.lit("")).alias("price_url"),
                    F.when(F.col("known").isNotNull(), F.col("docs_page")).otherwise(F.concat(guess, F.lit("/docs"))).alias("docs_url"),
                    F.when(source == "builtin", F.lit(0.95)).when(source == "domain-guess", F.lit(0.4)).when(source == "websearch", F.lit(0.6)).otherwise(F.lit(0.0)).alias("confidence"))


def accept_hits(hits: DataFrame) -> DataFrame:
    """First search hit per name whose host carries the name as a whole label part.

    hits(name, ord, url): review and media hosts are refused, so is a name inside a longer word.
    """
    token = F.regexp_replace(F.lower(F.split_part(F.trim("name"), F.lit(" "), F.lit(1))), "[^a-z0-9]", "")
    h = U.plain_host(F.col("url"))
    label = F.split_part(U.registrable_domain(h), F.lit("."), F.lit(1))
    parts = F.split(F.concat(label, F.lit(" "), F.split_part(h, F.lit("."), F.lit(1))), "[^a-z0-9]+")
    ok = hits.where((F.length(token) >= 3) & F.col("url").startswith("http") & (h != "") & F.array_contains(parts, token)
                    & ~U.names_any(h, K.REVIEW_HOSTS))
    return ok.groupBy("name").agg(F.min_by("url", "ord").alias("url"))


# ------------------------------------------------------------------ lessons and other groupings
def lesson_hints(lessons: DataFrame, k: int | None = None) -> DataFrame:
    """Non-empty hints per domain, numbered from the oldest lesson; the first k when given."""
    told = lessons.where(F.coalesce("hint", F.lit("")) != "")
    nth = told.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy("ord")))
    return (nth if k is None else nth.where(F.col("nth") <= k)).select("domain", "nth", "hint")


def keyword_pages(pages: DataFrame, domains: DataFrame, min_chars: int = 300) -> DataFrame:
    """Own-domain page that names a technology: pages(url, text), domains(domain, keyword).

    The keyword up to '(' must occur in a sufficient page of the registrable domain; first url wins.  Keywords are
    searched by words they hold, on pages of their domain only: a domain's keywords never meet all its pages.
    """
    p = pages.where(T.body_sufficient(F.col("text"), min_chars)).select(
        F.struct("url", U.registrable_domain(U.host_of(F.col("url"))).alias("domain")).alias("doc_id"), F.lower("text").alias("text"))
    asked = domains.withColumn("kw", F.lower(F.trim(F.split_part("keyword", F.lit("("), F.lit(1)))))
    words = settle(asked.where(F.col("kw") != "").select("domain", "kw").distinct())
    held = find_phrases(words.select(F.struct("domain", "kw").alias("item_id"), F.col("kw").alias("quote"), "domain"), p.withColumn("domain", F.col("doc_id.domain")), "domain")
    hit = held.where(F.col("item_id.domain") == F.col("doc_id.domain")).select("item_id.domain", "item_id.kw", "doc_id.url")
    blank = words.where(T.norm_ws(F.col("kw")) == "")
    if not blank.isEmpty():
        hit = hit.unionByName(blank.join(p.select("doc_id.domain", "doc_id.url"), "domain").select("domain", "kw", "url"))
    first = hit.groupBy("domain", "kw").agg(F.min("url").alias("url"))
    return asked.join(first, ["domain", "kw"]).select("domain", "keyword", "url")


def budget_flags(fetches: DataFrame, budget_s: float) -> DataFrame:
    """Pages that start after their vendor's time budget is spent: kept, and marked failed.

    fetches(vendor, run, ord, seconds): the running sum is over one run of one vendor.
    """
    before = Window.partitionBy("vendor", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("seconds").over(before), F.lit(0))
    return fetches.withColumn("over_budget", spent > budget_s)
