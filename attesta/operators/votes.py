"""Price votes, plan tables and the price cache."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta import constants as K
from attesta.functions import prices as P, text as T
from attesta.operators.captures import engine_rank


def price_votes(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Per page and price: extractors that saw it and distinct contents among them.

    `votes` counts extractors, `independent_votes` counts content hashes: two extractors that read
    the same bytes are one witness.
    """
    tokens = captures.select(*keys, "engine", T.content_hash(F.col("text")).alias("content_hash"),
                             P.price_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    keyed = tokens.withColumn("price_keys", F.transform("tokens", lambda t: P.price_key(t)))
    # each text counts a price once, with its first spelling: settled before the shuffle
    first = F.filter(
        F.transform("price_keys", lambda k, i: F.struct(k.alias("price_key"), i.alias("pos"), F.get("tokens", i).alias("token"))),
        lambda x: (x["price_key"] != "") & (F.array_position(F.col("price_keys"), x["price_key"]) == x["pos"] + 1))
    seen = keyed.select(*keys, "engine", "content_hash", F.inline(first))
    # a page has few extractors, so both sets are short
    return seen.groupBy(*keys, "price_key").agg(
        F.collect_set("engine").alias("seen_by"), F.collect_set("content_hash").alias("contents"),
        F.min_by("token", F.struct(engine_rank(F.col("engine")), F.col("pos"))).alias("token")).select(
        *keys, "price_key", F.size("seen_by").cast("bigint").alias("votes"), F.size("contents").cast("bigint").alias("independent_votes"),
        F.array_join(F.array_sort("seen_by"), ",").alias("engines"), "token")


def cross_validated(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Whether some price of the page was seen by two extractors, and by two contents."""
    return votes.groupBy(*keys).agg(
        F.max("votes").alias("votes"), F.max("independent_votes").alias("independent_votes"),
        (F.max("votes") >= 2).alias("cross_validated"), (F.max("independent_votes") >= 2).alias("verified"))


def tokens_per_engine(captures: DataFrame, ledger: DataFrame) -> DataFrame:
    """Price tokens per (vendor, engine): on price pages where the vendor has one, else on all."""
    # counted where the texts lie, so numbers meet the ledger and no texts
    counted = captures.select("url", "engine", F.size(P.price_tokens(F.col("text"))).alias("n"))
    marked = counted.join(ledger.select("url", "vendor", F.array_contains("kinds", "pricing").alias("is_price")), "url")
    per = marked.groupBy("vendor", "engine").agg(
        F.sum("n").alias("all_tokens"), F.sum(F.when(F.col("is_price"), F.col("n"))).alias("price_page_tokens"))
    has_page = (ledger.groupBy("vendor")
                .agg(F.bool_or(F.array_contains("kinds", "pricing")).alias("has_price_page")))
    return per.join(has_page, "vendor").select(
        "vendor", "engine",
        F.when(F.col("has_price_page"), F.coalesce("price_page_tokens", F.lit(0))).otherwise(F.col("all_tokens")).alias("tokens"))


def tier_problems(tiers: DataFrame) -> DataFrame:
    """One row per faulty price line of tiers(vendor, plan, price, period)."""
    name, price = F.trim(F.coalesce("plan", F.lit(""))), F.trim(F.coalesce("price", F.lit("")))
    period = F.trim(F.coalesce("period", F.lit("")))
    free = P.is_no_period_plan(name, price)
    paid = ~free & (price != "") & P.has_price(price)
    problem = (F.when(free & ~period.isin("—", "", "/user", "/seat"), F.lit("free or custom plan with a period"))
               .when(paid & (period == ""), F.lit("paid plan without a period"))
               .when(~free & ~paid & (price != "") & (price != "—") & ~F.contains(price, F.lit("未能提取")),
                     F.lit("price without currency")))
    return tiers.withColumns({"no_period": free, "paid": paid, "problem": problem})


def price_sufficiency(vendors: DataFrame, tiers: DataFrame, engine_counts: DataFrame) -> DataFrame:
    """Counts of each problem per vendor; sufficient when there is none.

    vendors(vendor), tiers(vendor, plan, price, period), engine_counts(vendor, engines).
    """
    t = tier_problems(tiers).groupBy("vendor").agg(
        F.count("*").alias("tiers"), F.count_if("paid").alias("paid"), F.count_if("no_period").alias("unpriced"),
        F.count(F.col("problem")).alias("bad_lines"))
    j = vendors.select("vendor").join(t, "vendor", "left").join(engine_counts, "vendor", "left").na.fill(
        0, ["tiers", "paid", "unpriced", "bad_lines", "engines"])
    problems = F.array_compact(F.array(
        F.when(F.col("bad_lines") > 0, F.lit("faulty price lines")),
        F.when(F.col("tiers") == 0, F.lit("no plans")),
        F.when((F.col("tiers") > 0) & (F.col("paid") == 0) & (F.col("unpriced") == 0), F.lit("neither paid nor free plan")),
        F.when((F.col("paid") > 0) & (F.col("engines") < 2), F.lit("fewer than two engines"))))
    return j.withColumn("problems", F.array_join(problems, "; ")).withColumn("sufficient", F.col("problems") == "")


def pair_plans(tiers: DataFrame) -> DataFrame:
    """Monthly, billed and annual price of each plan, first line of each kind, with the saving.

    tiers(vendor, plan, ord, price, period).  Saving percent: 1 - annual / (12 monthly), or
    1 - billed / monthly when there is no annual price; only positive savings count.
    """
    per = P.normal_period(F.col("period"))
    name, price = F.trim(F.coalesce("plan", F.lit(""))), F.trim(F.coalesce("price", F.lit("")))
    rows = tiers.where((name != "") & (name != "—")).select(
        "vendor", name.alias("plan"), "ord", price.alias("price"), per.alias("per"))
    at = lambda p: F.min_by("price", F.when((F.col("per") == p) & (F.col("price") != ""), F.col("ord")))
    first_paid = F.min(F.when(F.col("per").isin("/mo", "/yr") & (F.col("price") != ""), F.col("ord")))
    loose = F.col("per").isin("", "—")
    is_free = F.lower("price").isin(K.PLAN_FREE_PRICES)
    g = rows.groupBy("vendor", "plan").agg(
        F.min("ord").alias("ord"), at("/mo").alias("monthly"), at("billed").alias("billed"), at("/yr").alias("annual"),
        first_paid.alias("__paid"), F.min(F.when(loose & is_free, F.col("ord"))).alias("__free"),
        F.min(F.when(loose & ~is_free & (F.col("price") != "") & (F.col("price") != "—"), F.col("ord"))).alias("__custom"))
    before_paid = lambda c: F.col(c).isNotNull() & (F.col("__paid").isNull() | (F.col(c) < F.col("__paid")))
    m, b, a = P.amount(F.col("monthly")), P.amount(F.col("billed")), P.amount(F.col("annual"))
    by_year = F.bround((F.lit(1) - F.try_divide(a, m * 12)) * 100)
    by_bill = F.bround((F.lit(1) - F.try_divide(b, m)) * 100)
    save = (F.when(m.isNotNull() & a.isNotNull(), F.when((a > 0) & (m > 0) & (by_year > 0), by_year))
            .when(m.isNotNull() & b.isNotNull() & (b > 0) & (b < m) & (by_bill > 0), by_bill))
    equiv = F.when(m.isNotNull() & (a > 0), F.bround(a / 12, 1))
    return g.select("vendor", "plan", "ord", "monthly", "billed", "annual",
                    before_paid("__free").alias("is_free"), before_paid("__custom").alias("is_custom"),
                    save.cast("int").alias("save_pct"),
                    equiv.cast("decimal(18,1)").alias("monthly_equivalent"),
                    F.regexp_extract(F.coalesce("annual", F.lit("")), r"^[^\d]+", 0).alias("equivalent_sign"))


def commercial_model(vendors: DataFrame, tiers: DataFrame) -> DataFrame:
    """How each vendor sells: freemium, enterprise only, subscription or unclear; without plans: not published."""
    blob = F.lower(F.concat_ws(" ", "plan", "price", "period"))
    some = lambda ws: F.bool_or(blob.rlike("|".join(ws)))
    g = tiers.groupBy("vendor").agg(
        some(["/月", "/mo", "month"]).alias("m"), some(["/年", "/yr", "year", "annual"]).alias("y"),
        some(["免费", "free", "trial"]).alias("f"),
        some(["联系销售", "contact sales", "enterprise", "custom"]).alias("c"))
    model = (F.when(F.col("f").isNull(), F.lit(K.UNPUBLISHED))
             .when(F.col("f") & (F.col("m") | F.col("y")), F.lit(K.FREEMIUM))
             .when(F.col("c") & ~F.col("m") & ~F.col("y"), F.lit(K.ENTERPRISE_ONLY))
             .when(F.col("m") | F.col("y"), F.lit(K.SUBSCRIPTION))
             .otherwise(F.lit(K.MODEL_UNCLEAR)))
    return vendors.select("vendor").distinct().join(g, "vendor", "left").select("vendor", model.alias("model"))


def tiers_from_text(vendors: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Price lines read from one free text per vendor: (vendor, ord, plan, price, period).

    Used when a vendor has no structured plans.  A line without a plan word keeps its text as plan
    name only when it is short; `most` keeps the first lines only.
    """
    cut = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), K.PRICE_LINE_SPLIT),
                      lambda s: F.trim(F.regexp_replace(F.trim(s), "[….。]+$", "")))
    lines = F.filter(cut, lambda s: (s != "") & ~s.startswith("…") & ~s.rlike("^[…(见官网)]+$"))
    lines = lines if most is None else F.slice(lines, 1, most)
    rows = vendors.select("vendor", F.posexplode(lines).alias("ord", "line"))
    price = F.regexp_extract("line", f"({K.PRICE_LINE_PRICE})", 1)
    word = F.regexp_extract("line", K.PRICE_LINE_PERIOD, 1)
    period = F.when(word != "", word).otherwise(F.regexp_extract("line", K.PRICE_LINE_PERIOD, 0))
    plain = F.regexp_replace("line", r"\s*\([^)]{0,60}\)\s*$", "")
    name = F.when(price != "", F.regexp_replace(F.replace(plain, price, F.lit("")), "^[ ·\\-—]+|[ ·\\-—]+$", "")).otherwise(plain)
    short = (F.length(name) > 0) & (F.length(name) <= 25) & (F.size(F.split(F.trim(name), r"\s+")) <= 4)
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    return rows.select("vendor", "ord", F.when(name.rlike(K.PRICE_LINE_PLAN) | short, name).otherwise(F.lit("—")).alias("plan"),
                       dash(price).alias("price"), dash(period).alias("period"))


def vendor_price_display(vendors: DataFrame, tiers: DataFrame) -> DataFrame:
    """One price text per vendor: its plans' segments in input order, each once; without plans: not published.

    tiers(vendor, plan, ord, price, period).
    """
    seg = F.when(F.col("price") != "—", F.concat(F.col("price"), F.when(
        ~F.col("period").isin("—", ""), F.concat(F.lit("·"), F.col("period"))).otherwise(F.lit("")))).otherwise(F.col("plan"))
    once = tiers.withColumn("seg", seg).groupBy("vendor", "seg").agg(F.min("ord").alias("ord"))
    g = once.groupBy("vendor").agg(F.count("*").alias("segments"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "seg"))), lambda x: x["seg"]), " / ").alias("price"))
    return (vendors.select("vendor").distinct().join(g, "vendor", "left")
            .select("vendor", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"), F.coalesce("price", F.lit(K.UNPUBLISHED)).alias("price")))


def price_display(tiers: DataFrame) -> DataFrame:
    """Price segments per (vendor, plan) in input order: 'plan $9·/mo|$90·/yr'.

    Equal segments of a plan show once; a plan has few distinct segments, so they are joined per
    plan and not per vendor.
    """
    seg = F.when(F.col("price") != "—", F.concat(F.col("price"), F.when(
        ~F.col("period").isin("—", ""), F.concat(F.lit("·"), F.col("period"))).otherwise(F.lit("")))).otherwise(F.col("plan"))
    once = tiers.withColumn("seg", seg).groupBy("vendor", "plan", "seg").agg(F.min("ord").alias("ord"))
    return once.groupBy("vendor", "plan").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "seg"))), lambda x: x["seg"]), "|").alias("segments"))


def cached_fallback(wanted: DataFrame, cache: DataFrame, ttl_days: int = K.TTL_DAYS,
                    bucket_seconds: int = 3600) -> DataFrame:
    """As-of lookup: the latest cached entry of the domain before a failed capture, if young enough.

    wanted(id, domain, at), cache(domain, url, engines, cached_at); entries with fewer than two
    engines do not count.  Time is cut into buckets: inside a bucket a window finds the latest
    entry, before it the latest entry of an earlier bucket is carried forward, so no task sorts all
    rows of a domain.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    entry = F.struct("cached_at", "url")
    usable = cache.where(F.col("engines") >= 2).select(
        "domain", slot(F.col("cached_at")).alias("slot"), "cached_at", "url")
    asked = wanted.select("id", "domain", slot(F.col("at")).alias("slot"), "at")
    last_of = usable.groupBy("domain", "slot").agg(F.max(entry).alias("last"))
    by_slot = Window.partitionBy("domain").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (asked.select("domain", "slot").distinct().join(last_of, ["domain", "slot"], "full")
               .withColumn("earlier", F.last("last", ignorenulls=True).over(by_slot)).drop("last"))
    line = (asked.select("id", "domain", "slot", F.col("at").alias("t"), F.lit(1).alias("side"),
                         F.lit(None).cast(last_of.schema["last"].dataType).alias("e"))
            .unionByName(usable.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "domain", "slot",
                                       F.col("cached_at").alias("t"), F.lit(0).alias("side"), entry.alias("e"))))
    in_slot = (Window.partitionBy("domain", "slot").orderBy("t", "side", "e")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = line.withColumn("e", F.last("e", ignorenulls=True).over(in_slot)).where(F.col("side") == 1)
    hit = near.join(carried, ["domain", "slot"]).withColumn("hit", F.coalesce("e", "earlier"))
    young = F.unix_timestamp("t") - F.unix_timestamp("hit.cached_at") <= ttl_days * 86400
    return hit.where(F.col("hit").isNotNull() & young).select(
        "id", "domain", F.col("t").alias("at"), F.col("hit.url").alias("cached_url"),
        F.col("hit.cached_at").alias("cached_at"), F.lit(True).alias("from_cache"))


def price_integrity(verified: DataFrame, captures_meta: DataFrame, as_of: Column, ttl_days: int = K.TTL_DAYS) -> DataFrame:
    """Verified prices that lack tiers, independent witnesses or freshness: one row per defect.

    Independent are two extractors with different contents; one extractor that read a url twice is one witness.
    verified(vendor, url, engines ARRAY, tiers INT, scraped_at TEXT), meta(url, engine, content_hash).
    """
    named = verified.select("vendor", "url", F.explode_outer("engines").alias("engine"))
    hashes = (named.join(captures_meta.select("url", "engine", "content_hash"), ["url", "engine"], "left")
              .groupBy("vendor", "url").agg(F.least(F.count_distinct("content_hash"), F.count_distinct(
                  F.when(F.col("content_hash").isNotNull(), F.col("engine")))).alias("hashes")))
    age = T.age_days(F.col("scraped_at"), as_of)
    defects = F.array_compact(F.array(
        F.when(F.col("tiers") == 0, F.lit("no tiers")),
        F.when(F.col("hashes") < 2, F.lit("not independent")),
        F.when(age.isNull() | (age > ttl_days), F.lit("stale"))))
    return verified.join(hashes, ["vendor", "url"]).select("vendor", "url", F.explode(defects).alias("defect"))
