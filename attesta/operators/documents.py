"""Untyped analysis documents: every value is a row with its path, so a broken shape is a finding and no read error."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import constants as K
from attesta.functions import prices as P
from attesta.operators.components import settle
from attesta.operators.features import CJK, phrase_hits

DEPTH = 5
NODE = ["id", "path", "shape", "vendor", "kind", "value"]
# keys of these objects are names the author gives, not fields
NAMED = ["feature_catalog"]
# what has to stand where: a list or an object; an absent or null value is none of either
SHAPES = [
    ("", "object"), ("competitors", "array"), ("competitors[]", "object"), ("opportunities", "array"), ("opportunities[]", "object"),
    ("gaps", "array"), ("gaps[]", "object"), ("competitors[].pricing_tiers", "array"), ("competitors[].pricing_tiers[]", "object"),
    ("competitors[].feature_catalog", "object"), ("competitors[].feature_catalog.*", "array"), ("competitors[].feature_catalog.*[]", "object"),
    ("competitors[].strengths", "array"), ("competitors[].strengths[]", "object"), ("competitors[].weaknesses", "array"),
    ("competitors[].weaknesses[]", "object"), ("competitors[].differentiators", "array"), ("competitors[].user_feedback", "array"),
    ("competitors[].user_feedback[]", "object"), ("competitors[].gtm_evidence", "array"), ("competitors[].gtm_evidence[]", "object"),
    ("competitors[].moat_evidence", "array"), ("competitors[].moat_evidence[]", "object"), ("competitors[].tech_signals", "array"),
    ("competitors[].product_momentum", "array"), ("competitors[].product_momentum[]", "object"),
    ("opportunities[].target_users", "array"), ("opportunities[].differentiators", "array"), ("opportunities[].validation", "array"),
]
WANTED = ["pitch", "moat", "evidence_urls"]
TOP_TABLES = ["comparison_matrix", "feature_overlap"]


def kind_of(value: Column) -> Column:
    """array, object, void (JSON null), string, boolean or number."""
    told = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))
    return F.when(told.isin("array", "object", "void", "string", "boolean"), told).when(told != "", "number")


def is_empty(value: Column) -> Column:
    """Absent, null, false, zero, or without content; neither a text nor what a list or object holds is written out for it."""
    told = F.schema_of_variant(value)
    return (F.when(value.isNull() | told.isin("VOID", "OBJECT<>"), True).when(told.startswith("OBJECT<"), False)
            .when(told.startswith("ARRAY<"), F.try_variant_get(value, "$[0]", "variant").isNull())
            .when(told == "STRING", F.try_variant_get(value, "$", "string") == "")
            .otherwise(F.to_json(value).rlike(r'^(false|-?0(\.0*)?)$')))


def walk(docs: DataFrame, id_col: str, json_col: str, depth: int = DEPTH) -> DataFrame:
    """(id, path, shape, vendor, kind, value) for every value of the documents down to `depth`.

    path has list positions and names, as in competitors[2].feature_catalog.Inbox[0]; shape has [] and * in their
    places.  vendor is the name of the competitor a value belongs to.  A text that is no JSON has one row of kind null.
    The documents are read and parsed once: a level adds the rows of what its lists and objects hold to those found.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("value"), F.lit("").alias("path"),
                        F.lit("").alias("shape"), F.lit("").alias("vendor"))
    found = found.withColumn("kind", kind_of(F.col("value"))).select(*NODE, F.lit(True).alias("fresh"))
    for _ in range(depth):
        # a value's own row stays; a list or object found last stands a second time, to be opened
        twice = F.col("fresh") & F.col("kind").isin("array", "object")
        found = found.withColumn("inside", F.explode(F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        found = found.withColumn("opened", F.when(F.col("inside"), F.col("value")))
        inner = spark.tvf.variant_explode_outer(F.col("opened").outer()).toDF("pos", "key", "child")
        named = F.lit(False)
        for n in NAMED:
            named |= F.col("shape").endswith(n)
        dot = F.when(F.col("path") == "", "").otherwise(".")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(dot, F.col("key")))
        plain = F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(dot, F.when(named, F.lit("*")).otherwise(F.col("key"))))
        name = F.when(F.concat("shape", plain) == "competitors[]", F.coalesce(F.try_variant_get("child", "$.name", "string"), F.lit("?"))).otherwise(F.col("vendor"))
        child = {"path": F.concat("path", step), "shape": F.concat("shape", plain), "vendor": name, "kind": kind_of(F.col("child")), "value": F.col("child")}
        found = found.lateralJoin(inner).where(~F.col("inside") | F.col("pos").isNotNull()).select(
            "id", *[F.when(F.col("inside"), child[c]).otherwise(F.col(c)).alias(c) for c in NODE[1:]], F.col("inside").alias("fresh"))
    return found.select(*NODE)


def _mark(severity: str, detail: Column | str, field: Column | None = None) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(severity).alias("severity"), F.col("path").alias("path") if field is None else field.alias("path"), detail.alias("detail"))


def untyped_contract(docs: DataFrame, id_col: str, json_col: str, aliases: DataFrame | None = None) -> DataFrame:
    """G8 on whole untyped documents: (id, gate, severity, vendor, path, detail), a row for each defect.

    Hard: no JSON, a list or object that is something else, an illegal billing period, the key differentiation in place of
    differentiators.  Warnings: opportunities without pitch, moat or evidence_urls, gaps in their old form, no
    comparison_matrix or feature_overlap, and, given alias rows, catalogs of which under half the names are unified ones.
    """
    nodes = walk(docs, id_col, json_col)
    wanted = F.create_map(*[F.lit(x) for s in SHAPES for x in s])[F.col("shape")]
    # a list of a document or vendor that is empty in any form is as good as absent; an opportunity's lists are lists or null
    strict = F.col("shape").startswith("opportunities[].") | F.col("shape").endswith("[]")
    absent = (F.col("kind") == "void") & ~F.col("shape").endswith("[]") | ~strict & is_empty(F.col("value"))
    at = lambda key: F.try_variant_get("value", f"$.{key}", "variant")
    is_object = F.col("kind") == "object"
    below = lambda key: F.concat(F.col("path"), F.when(F.col("path") == "", "").otherwise("."), F.lit(key))
    period = F.try_variant_get("value", "$", "string")
    checks = [
        F.when(F.col("kind").isNull(), _mark("hard", "no JSON")),
        F.when(wanted.isNotNull() & F.col("kind").isNotNull() & (F.col("kind") != wanted) & ~absent,
               _mark("hard", F.concat(F.lit("must be "), F.when(wanted == "array", "a list").otherwise("an object"), F.lit(", is "), F.col("kind")))),
        F.when((F.col("shape") == "competitors[].pricing_tiers[].billing_period") & ~is_empty(F.col("value")),
               F.when(F.col("kind") != "string", _mark("hard", "period is no text"))
               .when(~P.normal_period(F.trim(period)).isin(K.VALID_PERIODS), _mark("hard", "illegal period"))),
        F.when((F.col("shape") == "opportunities[]") & is_object & at("differentiation").isNotNull() & at("differentiators").isNull(),
               _mark("hard", "singular key", below("differentiation"))),
        *[F.when((F.col("shape") == "opportunities[]") & is_object & is_empty(at(f)), _mark("warning", "missing", below(f))) for f in WANTED],
        F.when((F.col("shape") == "gaps[]") & is_object & at("gap").isNull(), _mark("warning", "old form")),
        *[F.when((F.col("shape") == "") & is_object & is_empty(at(f)), _mark("warning", "missing", F.lit(f))) for f in TOP_TABLES],
    ]
    named = F.when((F.col("shape") == "competitors[].feature_catalog.*[]") & is_object,
                   _mark("name", F.coalesce(F.try_variant_get("value", "$.name", "string"), F.lit(""))))
    marks = nodes.select("id", "vendor", F.inline(F.array_compact(F.array(*checks, *([named] if aliases is not None else [])))))
    if aliases is not None:
        marks = settle(marks)  # defects and names, without the documents
    out = marks.where(F.col("severity") != "name").select("id", F.lit("G8").alias("gate"), "severity", "vendor", "path", "detail")
    if aliases is None:
        return out
    named = marks.where(F.col("severity") == "name").select("id", F.col("detail").alias("name"))
    low = unified_names(named, aliases).where(F.col("unified") * 2 < F.col("names"))
    return out.unionByName(low.select(
        "id", F.lit("G8").alias("gate"), F.lit("warning").alias("severity"), F.lit("").alias("vendor"), F.lit("feature_catalog").alias("path"),
        F.concat(F.lit("unified names: "), F.col("unified").cast("string"), F.lit(" of "), F.col("names").cast("string")).alias("detail")))


def unified_names(named: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, names, unified): how many catalog names of a document are unified names or hold a CJK alias."""
    pool = aliases.where(~F.col("phrase")).select("alias").distinct()
    cjk = pool.where((F.length("alias") >= 2) & F.col("alias").rlike(CJK))
    counted = named.groupBy("id", "name").agg(F.count("*").alias("n"))
    names = counted.select("name").distinct()
    exact = names.join(pool.withColumnRenamed("alias", "name"), "name", "left_semi")
    inside = phrase_hits(names.where(F.col("name").rlike(CJK)), cjk.select(F.col("alias").alias("pid"), F.col("alias").alias("key"))).select("name")
    hit = exact.unionByName(inside).distinct().withColumn("hit", F.lit(True))
    return counted.join(hit, "name", "left").groupBy("id").agg(
        F.sum("n").alias("names"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("unified"))
