"""Input views: evidence tables derived from the shared test tables, row by row or by key."""
from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.operators.components import settle

AS_OF = "2024-02-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# tables of long texts and their keys
TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table as it lies.

    A session that reads text tables of one split (a test, a bench on one machine) may name a number in
    attesta.input.partitions to deal them out by key; unset, no table is shuffled before it is used.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("attesta.input.partitions", None)
    return df.repartition(int(parts), TEXT_KEYS[name]) if parts and name in TEXT_KEYS else df


def pick(n: Column, values: list) -> Column:
    """values[n mod len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


# ------------------------------------------------------------------ page captures
BLOCK_TAG = r"</?(p|br|li|div|nav|ul|footer|article|h1|title)[^>]*>"


def _visible(html: Column) -> Column:
    headed = F.regexp_replace(html, "<h1[^>]*>", "\n# ")
    return F.regexp_replace(F.regexp_replace(headed, BLOCK_TAG, "\n"), "<[^>]+>", " ")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/]+)", 1)


def nav_line(page_id: Column, url: Column) -> Column:
    """Navigation links every captured page carries, varied by page."""
    site = F.regexp_extract(url, r"^https?://[^/]*?([^./]+\.[^./]+)(?:/|$)", 1)
    none = F.lit("")
    return F.concat(
        F.when(page_id % 3 != 0, F.concat(F.lit("[Pricing](/pricing?p="), page_id, F.lit(") ")))
        .otherwise(F.concat(F.lit("[Why our pricing changed](/lp/pricing-update-"), page_id, F.lit(") "))),
        F.when(page_id % 4 == 0, F.concat(F.lit("[Docs](https://docs."), site, F.lit("/start) ")))
        .when(page_id % 4 == 1, F.lit("[Developers](https://elsewhere.test/docs) ")).otherwise(none),
        F.when(page_id % 5 == 0, F.lit("[Customers](/customers) "))
        .when(page_id % 5 == 1, F.lit("[Customer stories](/a/b/c/customers) ")).otherwise(none),
        F.when(page_id % 7 == 0, F.lit("[Blog](/x/../blog/page/2) ")).otherwise(none),
        F.when(page_id % 2 == 0, F.lit("[Product tour](features/tour) ")).otherwise(none),
        F.lit("[Platform logo](/static/logo.png) [Reviews](mailto:a@b.test) ![team](/team.png)"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, engine, text: three extractors' readings of every page."""
    html, pid, url = F.col("html"), F.col("page_id"), F.col("url")
    no_code = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    linked = F.regexp_replace(no_code, r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    readings = F.array(
        F.struct(F.lit("playwright").alias("engine"), _visible(html).alias("text")),
        F.struct(F.lit("trafilatura").alias("engine"),
                 _visible(F.regexp_extract(html, "(?s)<article>(.*)</article>", 1)).alias("text")),
        F.struct(F.lit("jina").alias("engine"),
                 F.concat(nav_line(pid, url), F.lit("\n"), _visible(linked)).alias("text")))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.inline(readings))


KINDS = ["homepage", "pricing", "features", "docs", "testimonials", "blog"]


def stamp(n: Column, spread: int = 40) -> Column:
    """Capture time text, up to `spread` days after the first of January 2024."""
    return F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(n, F.lit(spread)).cast("int")),
                                  "yyyy-MM-dd"), F.lit(" 08:30 UTC"))


def is_failed(url: Column) -> Column:
    """Pages behind campaign links could not be captured."""
    return F.contains(url, F.lit("utm_source="))


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, page_id, vendor (host), status, kinds, fetched_at: one row per page, no texts."""
    pid = F.col("page_id")
    first = pick(pid, KINDS)
    kinds = F.when(pid % 5 == 0, F.array_distinct(F.array(first, F.lit("pricing")))).otherwise(F.array(first))
    return table(spark, sf_dir, "pages").select(
        "url", "page_id", host(F.col("url")).alias("vendor"),
        F.when(is_failed(F.col("url")), F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        kinds.alias("kinds"), stamp(pid).alias("fetched_at"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, error: recorded failures; failures of blog hosts were swallowed silently."""
    u = F.col("url")
    return (table(spark, sf_dir, "pages").where(is_failed(u) & ~u.rlike("^https?://blog[.]"))
            .select("url", F.lit("all engines empty").alias("error")))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, http_status, final_url, probed_at: two probes of most pages, the older one failing; none of every eleventh."""
    pid, url = F.col("page_id"), F.col("url")
    runs = F.array(
        F.struct(F.lit(503).alias("http_status"), url.alias("final_url"), F.lit("2024-01-10").alias("probed_at")),
        F.struct(F.when(pid % 9 == 0, F.lit(404)).when(pid % 13 == 0, F.lit(500)).otherwise(F.lit(200)).alias("http_status"),
                 F.when(pid % 10 == 3, F.lit("https://parked.other.test/")).otherwise(url).alias("final_url"), F.lit("2024-01-20").alias("probed_at")))
    return table(spark, sf_dir, "pages").where(pid % 11 != 7).select("url", F.inline(runs))


# ------------------------------------------------------------------ vendor documents
STAGES = ["早期", "成长期", "成熟期", "巨头", "—"]
POINTS = ["国际合规认证", "API 优先的开发者体验", "客户规模增长", "免费试用入口",
          "渠道合作伙伴体系", "AI Agent 全链路", "语音通话摘要", "团队协作编辑器"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PERIODS = ["/month", "billed annually", "per year", "/user", "", "per fortnight"]
NOUNS = {"ring": "inbox", "plate": "webhooks", "widget": "chat bot", "rod": "workflow",
         "bolt": "email campaign", "gizmo": "analytics report", "gear": "rest api",
         "anvil": "security scan"}


def feature_name(p_name: Column) -> Column:
    """Product word of a part name replaced by a software capability."""
    adjective, noun = F.split_part(p_name, F.lit(" "), F.lit(1)), F.split_part(p_name, F.lit(" "), F.lit(2))
    out = None
    for word, cap in NOUNS.items():
        hit = noun == word
        out = F.when(hit, F.lit(cap)) if out is None else out.when(hit, F.lit(cap))
    return F.concat(adjective, F.lit(" "), out.otherwise(noun))


def price_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", amount))


def vendor_documents(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """One nested vendor document per key of any of the tables, with all that belongs to it.

    A vendor has its page, the documents, parts, user turns and passages whose keys lead to it, every
    non-blank line of the documents and every user turn being evidence of its own.  A key without a page
    is a vendor too, on an address made from the key.  Rows without a key belong to no vendor.

    kept: what the documents are made of is joined once and kept, for several readers; a line stands there once,
    in a document twice.
    """
    pid, url = F.col("page_id"), F.col("url")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def gathered(rows: DataFrame, key: str, out: str, *fields: Column | str) -> DataFrame:
        """All rows of a key as one sorted array"""
        keyed = rows.select(F.expr(key).alias("page_id"), F.struct(*fields).alias("x")).where("page_id is not null")
        return keyed.groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias(out))

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))
    docs = gathered(table(spark, sf_dir, "documents"), "doc_id div 4", "docs", "doc_id", "source", lines.alias("lines"))
    parts = gathered(table(spark, sf_dir, "part"), "p_partkey div 8", "parts", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    talk = gathered(table(spark, sf_dir, "conversations").where(F.col("role") == "user"), "conv_id", "turns", "turn", "text")
    items = gathered(table(spark, sf_dir, "benchmark"), "item_id", "passages", "text")
    # left joins keep the rows where their key has put them; after each full join all texts would be dealt out anew
    keys = reduce(DataFrame.unionByName, [rows.select("page_id") for rows in (docs, parts, talk, items)]).distinct()
    base = pages.unionByName(keys.join(pages, "page_id", "left_anti"), allowMissingColumns=True)
    for rows in (docs, parts, talk, items):
        base = base.join(rows, "page_id", "left")
    base = settle(base) if kept else base
    base = base.withColumns({"url": F.coalesce("url", F.concat(F.lit("https://unlisted.test/"), pid)), "h1": F.coalesce("h1", F.lit(""))})
    base = base.withColumn("host", host(url))
    root = F.concat(F.lit("https://"), F.col("host"))
    empty = F.lit("")

    def lines_of(slot: int, build) -> Column:
        """build(document, line) for the lines of every fourth document, from the given one on"""
        mine = F.filter("docs", lambda d: d["doc_id"] % 4 == slot)
        return F.coalesce(F.flatten(F.transform(mine, lambda d: F.transform(d["lines"], lambda x: build(d, x)))), F.array())

    def only(cond: Column, *structs: Column) -> Column:
        """array(structs) when cond holds, else the empty array"""
        return F.filter(F.array(*[F.when(cond, s) for s in structs]), lambda x: x.isNotNull())

    wrapped = F.concat(F.lit('官网原文: "'), F.col("h1"), F.lit('"'))
    strengths = F.concat(
        F.array(F.struct(pick(pid, POINTS).alias("point"), wrapped.alias("evidence"),
                         (pid % 5 + 5).cast("int").alias("score"), url.alias("source"))),
        lines_of(0, lambda d, x: F.struct(x.alias("point"), x.alias("evidence"), F.lit(6).alias("score"), root.alias("source"))))
    weaknesses = lines_of(1, lambda d, x: F.struct(
        F.when(d["doc_id"] % 8 == 1, F.lit("待补充:暂无")).otherwise(x).alias("point"), x.alias("evidence"), F.lit(4).alias("score"),
        F.concat(root, F.lit("/en/pricing/")).alias("source")))
    tier = lambda p: F.struct(
        p["p_type"].alias("name"), price_text(p["p_retailprice"]).alias("price"),
        pick(p["p_size"], PERIODS).alias("billing_period"), url.alias("source_url"))
    entry = lambda p: F.struct(
        p["p_type"].alias("category"), feature_name(p["p_name"]).alias("name"), p["p_name"].alias("desc"),
        F.when(p["p_partkey"] % 5 == 0, empty).when(p["p_partkey"] % 5 == 1, F.concat(root, F.lit("/pricing")))
        .otherwise(url).alias("source"),
        F.when(p["p_partkey"] % 3 == 0, F.col("h1")).otherwise(empty).alias("quote"),
        p["p_name"].alias("text_orig"))
    parts_col = F.coalesce(F.col("parts"), F.array().cast(
        "array<struct<p_partkey:bigint,p_name:string,p_type:string,p_size:int,p_retailprice:double>>"))
    return base.select(
        "page_id", F.concat(F.lit("V"), pid).alias("name"), "url",
        F.when(pid % 6 == 0, empty).otherwise(F.col("h1")).alias("tagline"), url.alias("tagline_source"),
        F.when(pid % 4 == 0, F.lit("—")).otherwise((pid % 30 + 1990).cast("string")).alias("founded"),
        F.when(pid % 3 == 0, url).otherwise(empty).alias("founded_source"),
        F.when(pid % 5 == 0, empty).when(pid % 5 == 1, F.lit("Shanghai, China"))
        .when(pid % 5 == 2, F.lit("Hong Kong")).otherwise(F.lit("Berlin")).alias("headquarters"),
        F.when(pid % 7 == 0, url).otherwise(empty).alias("headquarters_source"),
        F.lit(None).cast("string").alias("team_size"),
        F.when(pid % 19 == 0, F.lit("/about")).otherwise(empty).alias("team_size_source"),
        pick(pid, STAGES).alias("stage"),
        F.when(pid % 6 == 5, F.lit("—")).otherwise(F.lit("from $9")).alias("pricing"),
        F.when(pid % 9 == 0, F.lit(None)).otherwise(pid % 2 == 0).alias("pricing_verified"),
        (pid % 10 == 0).alias("pricing_from_cache"), url.alias("pricing_source"),
        F.when(pid % 17 == 0, empty).otherwise(stamp(pid)).alias("pricing_scraped_at"),
        F.when(pid % 8 == 0, F.array(F.lit("playwright"))).otherwise(
            F.array(F.lit("playwright"), F.lit("trafilatura"))).alias("pricing_engines"),
        F.transform(parts_col, tier).alias("pricing_tiers"),
        only(pid % 5 == 0, F.struct(F.col("h1").alias("line"), F.col("h1").alias("raw_line"))).alias("pricing_vote_detail"),
        F.array(pick(pid, SEGMENTS), pick(pid + 2, SEGMENTS)).alias("target_users"),
        F.transform(parts_col, lambda p: feature_name(p["p_name"])).alias("core_features"),
        F.transform(parts_col, entry).alias("feature_catalog"),
        strengths.alias("strengths"), weaknesses.alias("weaknesses"),
        lines_of(2, lambda d, x: F.struct(d["source"].alias("point"), x.alias("quote"), url.alias("source_url"))).alias("differentiators"),
        lines_of(3, lambda d, x: F.struct(d["source"].alias("name"), url.alias("source"), x.alias("quote"), F.lit("jina").alias("engine"))
                 ).alias("tech_signals"),
        F.coalesce(F.transform("passages", lambda x: F.struct(
            F.lit("self-serve").alias("name"), x["text"].alias("quote"), url.alias("source"))), F.array()).alias("gtm_evidence"),
        only(pid % 4 == 0, F.struct(
            F.lit("certified").alias("name"), F.col("h1").alias("quote"), url.alias("source"))).alias("moat_evidence"),
        F.coalesce(F.transform("turns", lambda x: F.struct(
            F.lit("quote").alias("kind"), x["text"].alias("text"), x["text"].alias("quote"), F.lit("user").alias("who"),
            F.when(pid % 6 == 1, F.lit("https://www.g2.com/reviews")).otherwise(root).alias("source"))), F.array()).alias("user_feedback"),
        only(pid % 3 == 0, F.struct(
            F.col("h1").alias("title"), F.lit("2024-01").alias("when"), url.alias("source"))).alias("product_momentum"),
        only(pid % 2 == 1, F.struct(
            F.col("h1").alias("text"), F.when(pid % 3 == 1, root).otherwise(url).alias("source"),
            F.lit(False).alias("matrix_derived"))).alias("feature_conclusion_points"),
        F.when(pid % 7 == 3, empty).otherwise(F.lit("teams")).alias("feature_best_for"))


# ------------------------------------------------------------------ prices and plans
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, engine, text: three spellings of a product's price.

    Engine 3 reads another price for every seventh product; engine 2 repeats engine 1's text for
    every ninth, so the two are one independent capture.
    """
    k, v = F.col("p_partkey"), F.format_string("%.2f", F.col("p_retailprice"))
    other = F.format_string("%.2f", F.col("p_retailprice") + 10)
    first = F.concat(F.lit("Plan\nfrom $"), v, F.lit(" per seat"))
    rows = F.array(
        F.struct(F.lit("playwright").alias("engine"), first.alias("text")),
        F.struct(F.lit("trafilatura").alias("engine"),
                 F.when(k % 9 == 0, first).otherwise(F.concat(F.lit("Price: US$"), v)).alias("text")),
        F.struct(F.lit("jina").alias("engine"),
                 F.when(k % 7 == 0, F.concat(other, F.lit(" USD"))).otherwise(F.concat(v, F.lit(" USD"))).alias("text")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(rows))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor (brand), plan (type), ord, price, period: published price lines."""
    size, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("vendor"), F.concat_ws(" ", "p_type", (k % 10).cast("string")).alias("plan"),
        k.alias("ord"),
        F.when(size % 7 == 0, F.lit("Free")).when(size % 7 == 1, F.lit("Contact us")).when(size % 7 == 2, F.lit("49"))
        .when(size % 6 == 0, price_text(F.floor(F.col("p_retailprice") * 100 / 10) / 100))
        .when(size % 6 == 1, price_text(F.floor(F.col("p_retailprice") * 100 / 12) / 100))
        .otherwise(price_text(F.col("p_retailprice"))).alias("price"),
        pick(size, PERIODS).alias("period"))


# ------------------------------------------------------------------ features
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor (brand), ord, name, category, desc: capability names as vendors spell them."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("vendor"), k.alias("ord"),
        F.concat(F.lower("p_type"), F.lit(" "), feature_name(F.col("p_name"))).alias("name"),
        F.col("p_type").alias("category"), F.col("p_name").alias("desc"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))),
                                                         F.lit(".test/f/"), k)).alias("source"))


def plain_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with bare capability names, shared by many vendors."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("vendor"), F.col("p_partkey").alias("ord"),
        feature_name(F.col("p_name")).alias("name"), F.col("p_type").alias("category"))


# ------------------------------------------------------------------ logs, scores, segments
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine, url_type, success, quality, ts: one row per extraction attempt."""
    engines = ["firecrawl", "playwright", "trafilatura", "jina", "newspaper3k"]
    types = F.create_map(*[F.lit(x) for kv in {
        "signup": "pricing", "error": "homepage", "click": "docs", "view": "feature",
        "purchase": "blog"}.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        "event_id", pick(F.col("user_id"), engines).alias("engine"),
        types[F.col("event_type")].alias("url_type"),
        (F.col("value") >= 10).alias("success"),
        F.least(F.col("value") / 100, F.lit(1.0)).cast("decimal(10,4)").alias("quality"),
        F.col("ts").cast("timestamp").alias("ts"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor (supplier), ord, six score dimensions on 0..10 with two decimals."""
    li = table(spark, sf_dir, "lineitem")
    dec = lambda c: F.least(c, F.lit(10)).cast("decimal(6,2)")
    return (li.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"),
        F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("disc"),
        F.sum(F.col("l_tax").cast("decimal(18,2)")).alias("tax"),
        F.count_if(F.col("l_returnflag") == "N").alias("kept"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_"),
        F.sum(F.col("l_linenumber")).alias("lines"))
        .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("vendor"), F.col("l_suppkey").alias("ord"),
                dec(F.col("qty") / F.col("n") / 5).alias("feature_richness"),
                dec(F.col("disc") * 100 / F.col("n")).alias("ux"),
                dec(F.col("tax") * 100 / F.col("n")).alias("pricing_value"),
                dec(F.col("kept") * 10 / F.col("n")).alias("integration"),
                dec(F.col("open_") * 10 / F.col("n")).alias("ai_capability"),
                dec(F.col("lines") / F.col("n")).alias("momentum")))


def target_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor (nation), ord, target: whom a vendor sells to."""
    return (table(spark, sf_dir, "customer")
            .select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("ord"),
                    F.concat_ws(" ", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000)).alias("target"))
            .join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("vendor")), "n_nationkey")
            .select("vendor", "ord", "target"))


def lesson_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, issue, hint, resolution, evidence, alt_sources, seen_at, seq: problems seen while capturing."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.col("user_id") % 50, F.lit(".test")).alias("domain"),
        F.col("event_type").alias("issue"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), F.floor("value"))).alias("hint"),
        F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), F.col("event_id") % 100)).alias("resolution"),
        F.filter(F.array(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("e"), F.col("event_id") % 100))), lambda x: x.isNotNull()).alias("evidence"),
        F.filter(F.array(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("https://s.test/"), F.col("event_id")))), lambda x: x.isNotNull()).alias("alt_sources"),
        F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("seq"))
