"""JSON and Parquet input and output.

Tolerated spellings of a field are settled here, so operators see one form.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from attesta.operators.captures import latest_texts

META = "struct<ok:boolean,chars:int,content_hash:string>"
LEDGER = (f"fetched map<string,struct<status:string,kind:string,kinds:array<string>,engines:map<string,{META}>,"
          "fetched_at:string,final_url:string,from_cache:boolean>>, "
          "failures array<struct<competitor:string,url:string,kind:string,error:string>>, "
          "claims array<struct<field:string,value:string,source_url:string,quote:string,engine:string,"
          "verified_by:array<string>,from_cache:boolean,scraped_at:string>>")


def read_captures(spark: SparkSession, path: str, names: str = "*.engines.json") -> DataFrame:
    """url, engine, text from files ({url: {engine: text}}) whose names match.

    A broken file is skipped; the file later in name order wins per (url, engine).
    """
    files = (spark.read.option("wholetext", True).option("pathGlobFilter", names).text(path)
             .select(F.input_file_name().alias("file"), F.from_json("value", "map<string,map<string,string>>").alias("pages")))
    rows = (files.where(F.col("pages").isNotNull()).select("file", F.explode("pages").alias("url", "texts"))
            .where(F.col("texts").isNotNull()).select("file", "url", F.explode("texts").alias("engine", "text")))
    return latest_texts(rows, "file")


def _strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file fails when the query is built, a broken one when it runs."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """url, status, kinds, engines, fetched_at, from_cache; single `kind` and `kinds` are both read."""
    rows = _strict_json(spark, path, LEDGER).select(F.explode("fetched").alias("url", "e"))
    one = F.when(F.col("e.kind").isNotNull(), F.array("e.kind")).otherwise(F.array().cast("array<string>"))
    return rows.select("url", "e.status", F.coalesce("e.kinds", one).alias("kinds"), "e.engines", "e.fetched_at",
                       F.coalesce("e.from_cache", F.lit(False)).alias("from_cache"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return _strict_json(spark, path, LEDGER).select(F.inline("failures")).withColumnRenamed("competitor", "vendor")


_PLAIN = ["name", "url", "tagline", "founded", "stage", "headquarters", "team_size", "pricing", "tagline_source", "founded_source",
          "headquarters_source", "team_size_source", "pricing_currency", "pricing_source", "pricing_scraped_at", "feature_best_for"]
_ITEM = "point:string,evidence:string,quote:string,score:int,source:string,source_url:string"
_EVID = "name:string,quote:string,source:string,source_url:string"
VENDOR = (", ".join(f"{c} string" for c in _PLAIN) + ", pricing_verified boolean, pricing_from_cache boolean, pricing_engines array<string>, "
          "pricing_tiers array<struct<name:string,price:string,billing_period:string,source_url:string>>, "
          "pricing_vote_detail array<struct<line:string,raw_line:string>>, target_users array<string>, core_features array<string>, "
          "feature_catalog map<string,array<struct<category:string,name:string,desc:string,source:string,source_url:string,quote:string,text_orig:string>>>, "
          f"strengths array<struct<{_ITEM}>>, weaknesses array<struct<{_ITEM}>>, differentiators array<string>, tech_signals array<string>, "
          f"gtm_evidence array<struct<{_EVID}>>, moat_evidence array<struct<{_EVID}>>, "
          "user_feedback array<struct<kind:string,text:string,quote:string,who:string,author:string,source:string,source_url:string>>, "
          "product_momentum array<struct<title:string,`when`:string,source:string,source_url:string>>, "
          "feature_conclusion_points array<struct<text:string,source:string,matrix_derived:boolean>>")
ANALYSIS = "competitors array<struct<" + VENDOR.replace(" array<", ":array<").replace(" map<", ":map<").replace(" string", ":string").replace(" boolean", ":boolean") + ">>"


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """One row per vendor of an analysis file, in the form the operators take."""
    raw = _strict_json(spark, path, ANALYSIS).select(F.inline("competitors"))
    none = F.lit(None).cast("string")

    def src(x):
        return F.coalesce(F.nullif(x["source"], F.lit("")), x["source_url"])

    def each(col, make):
        return F.coalesce(F.transform(col, make), F.array())

    def diff(x):
        obj = F.from_json(x, "point string, quote string, source_url string, source string")
        return F.when(x.startswith("{"), F.struct(obj["point"].alias("point"), obj["quote"].alias("quote"),
                                                  F.coalesce(obj["source_url"], obj["source"]).alias("source_url"))).otherwise(
            F.struct(x.alias("point"), none.alias("quote"), none.alias("source_url")))

    def signal(x):
        obj = F.from_json(x, "name string, quote string, source string, source_url string, engine string")
        link = F.regexp_replace(F.regexp_extract(x, r"(https?://\S+)", 1), r"[).,\]]+$", "")
        return F.when(x.startswith("{"), F.struct(
            obj["name"].alias("name"), src(obj).alias("source"), obj["quote"].alias("quote"), obj["engine"].alias("engine"))).otherwise(
            F.struct(F.split_part(x, F.lit("|"), F.lit(1)).alias("name"), link.alias("source"), none.alias("quote"), none.alias("engine")))

    def item(x):
        return F.struct(x["point"].alias("point"), F.coalesce(x["evidence"], x["quote"]).alias("evidence"), x["score"].alias("score"), src(x).alias("source"))

    def evid(x):
        return F.struct(x["name"].alias("name"), x["quote"].alias("quote"), src(x).alias("source"))

    own = F.coalesce(F.flatten(F.map_values("feature_catalog")), F.array())
    return raw.select(
        *_PLAIN, "pricing_verified", F.coalesce("pricing_from_cache", F.lit(False)).alias("pricing_from_cache"), "pricing_engines",
        F.coalesce("pricing_tiers", F.array()).alias("pricing_tiers"), F.coalesce("pricing_vote_detail", F.array()).alias("pricing_vote_detail"),
        F.coalesce("target_users", F.array()).alias("target_users"), F.coalesce("core_features", F.array()).alias("core_features"),
        F.transform(own, lambda x: F.struct(x["category"].alias("category"), x["name"].alias("name"), x["desc"].alias("desc"),
                                            src(x).alias("source"), x["quote"].alias("quote"), x["text_orig"].alias("text_orig"))).alias("feature_catalog"),
        each("strengths", item).alias("strengths"), each("weaknesses", item).alias("weaknesses"), each("differentiators", diff).alias("differentiators"),
        each("tech_signals", signal).alias("tech_signals"), each("gtm_evidence", evid).alias("gtm_evidence"), each("moat_evidence", evid).alias("moat_evidence"),
        each("user_feedback", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), F.coalesce(x["quote"], x["text"]).alias("quote"),
                                                 F.coalesce(x["who"], x["author"]).alias("who"), src(x).alias("source"))).alias("user_feedback"),
        each("product_momentum", lambda x: F.struct(x["title"].alias("title"), x["when"].alias("when"), src(x).alias("source"))).alias("product_momentum"),
        F.coalesce("feature_conclusion_points", F.array()).alias("feature_conclusion_points"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """ord, label, player: segments spelled {label, players} or {name, competitors}."""
    doc = _strict_json(spark, path, "market_segments array<struct<label:string,name:string,players:array<string>,competitors:array<string>>>")
    seg = doc.select(F.posexplode("market_segments").alias("ord", "s"))
    return seg.select("ord", F.coalesce("s.label", "s.name").alias("label"), F.explode(F.coalesce("s.players", "s.competitors")).alias("player"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """canonical, alias, phrase, ord from {aliases: {canonical: {aliases, substr}}}; empty when unreadable."""
    schema = "canonical string, alias string, phrase boolean, ord int"
    try:
        doc = spark.read.option("wholetext", True).text(path).select(
            F.from_json("value", "aliases map<string,struct<aliases:array<string>,substr:array<string>>>").alias("d"))
        fam = doc.select(F.posexplode(F.map_entries("d.aliases")).alias("fam", "e"))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    none = F.array().cast("array<string>")
    rows = F.concat(F.array(F.struct(F.col("e.key").alias("alias"), F.lit(False).alias("phrase"))),
                    F.transform(F.coalesce("e.value.aliases", none), lambda a: F.struct(a.alias("alias"), F.lit(False).alias("phrase"))),
                    F.transform(F.coalesce("e.value.substr", none), lambda a: F.struct(a.alias("alias"), F.lit(True).alias("phrase"))))
    return fam.select("fam", F.col("e.key").alias("canonical"), F.posexplode(rows).alias("i", "r")).select(
        "canonical", "r.alias", "r.phrase", (F.col("fam") * 1000 + F.col("i")).cast("int").alias("ord"))


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """id, category, alias, ord from {features: [{id, name_cn, name_en, category, aliases}]}; empty when unreadable."""
    try:
        doc = spark.read.option("wholetext", True).text(path).select(F.from_json(
            "value", "features array<struct<id:string,name_cn:string,name_en:string,category:string,aliases:array<string>>>").alias("d"))
        rows = doc.select(F.inline("d.features"))
    except AnalysisException:
        return spark.createDataFrame([], "id string, category string, alias string, ord int")
    names = F.array_distinct(F.transform(F.array_compact(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name_en", "name_cn"))),
                                         lambda a: F.lower(F.trim(a))))
    return rows.select("id", "category", F.posexplode(F.filter(names, lambda a: a != "")).alias("ord", "alias")).select("id", "category", "alias", "ord")


def read_known_vendors(spark: SparkSession, path: str) -> DataFrame:
    """known, home, price_page, docs_page from {vendors: {key: {name, url, pricing, docs}}}; empty when unreadable.

    A vendor is known by its key and by its name.  The table resolve_vendors looks names up in.
    """
    try:
        doc = spark.read.option("wholetext", True).text(path).select(
            F.from_json("value", "vendors map<string,struct<name:string,url:string,pricing:string,docs:string>>").alias("d"))
        rows = doc.select(F.explode(F.map_entries("d.vendors")).alias("e"))
    except AnalysisException:
        return spark.createDataFrame([], "known string, home string, price_page string, docs_page string")
    names = F.array_distinct(F.array_compact(F.array("e.key", F.nullif(F.trim("e.value.name"), F.lit("")))))
    blank = lambda f: F.nullif(F.trim(F.col(f"e.value.{f}")), F.lit(""))
    return rows.where(blank("url").isNotNull()).select(F.explode(names).alias("known"), blank("url").alias("home"),
                                                       blank("pricing").alias("price_page"), blank("docs").alias("docs_page"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Violations, audits or any report table; files are complete before readers see them."""
    df.write.mode("overwrite").format(fmt).save(path)
