"""Registered queries that go through files: tables written in the input formats, read back by the readers."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.operators import claims as Q, gates as G, marts as M
from attesta.operators.components import ensure_checkpoint_dir
from attesta.plans import views as W
from attesta.plans.queries_evidence import url_violations
from attesta.plans.sqltext import query
from attesta.plans.oracle_evidence import ORACLE as EVIDENCE
from attesta.sources import files as S


def _folder(s: SparkSession) -> str:
    """A new folder under the one the session names for shared files."""
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _written(s: SparkSession, rows: DataFrame) -> str:
    """The folder of rows(json): a file for each row."""
    path = _folder(s)
    rows.select("json").write.option("maxRecordsPerFile", 1).text(path)
    return path


FILE_KEYS = 8192              # keys of a block: a site's entries go to a file for each block, so no file grows with the site


def _block(key: str):
    return F.expr(f"{key} div {FILE_KEYS}").alias("block")


def file_captures(s, d) -> DataFrame:
    """Capture texts of a site as JSON files, one for each block of its pages."""
    texts = F.map_from_entries(F.collect_list(F.struct("engine", "text")))
    one = W.captures(s, d).groupBy("url", "engine").agg(F.max_by("text", "page_id").alias("text"), F.max("page_id").alias("page_id"))
    pages = one.groupBy("url").agg(texts.alias("texts"), F.max("page_id").alias("page_id")).groupBy(W.host(F.col("url")).alias("host"), _block("page_id"))
    path = _written(s, pages.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("url", "texts")))).alias("json")))
    return S.read_captures(s, path, "part-*").select("url", "engine", F.md5("text").alias("digest"))


def file_ledger(s, d) -> DataFrame:
    """The ledger of a site as JSON files, one for each block of its pages."""
    entry = F.struct("status", "kinds", "fetched_at")
    led = W.ledger_pages(s, d).groupBy("url", "vendor").agg(F.max_by(entry, "page_id").alias("e"), F.max("page_id").alias("page_id"))
    doc = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("url", "e"))).alias("fetched")))
    return S.read_ledger(s, _written(s, led.groupBy("vendor", _block("page_id")).agg(doc.alias("json")))).select(
        "url", "status", F.array_join("kinds", "/").alias("kinds"), "fetched_at", "from_cache")


def file_claims(s, d) -> DataFrame:
    """Vendor documents of a site as analysis files, one for each block of vendors, read and flattened."""
    v = W.vendor_documents(s, d)
    v = v.withColumn("feature_catalog", F.create_map("name", "feature_catalog")).withColumn("host", W.host(F.col("url")))
    row = F.struct(*[c for c in v.columns if c not in ("page_id", "host")])
    docs = v.groupBy("host", _block("page_id")).agg(F.to_json(F.struct(F.collect_list(row).alias("competitors"))).alias("json"))
    claims = Q.flatten_claims(S.read_vendors(s, _written(s, docs)))
    return claims.select("vendor", "field", "idx", "source_url", F.md5(F.concat_ws("|", "quote", "statement")).alias("digest"))


def file_report(s, d) -> DataFrame:
    """Violations written as JSON and read again."""
    path = _folder(s)
    S.write_report(url_violations(s, d), path, "json")
    return s.read.schema("gate string, severity string, vendor string, field string, idx int, source_url string, detail string").json(path).select(*G.COLUMNS)


def file_aliases(s, d) -> DataFrame:
    """Alias families, a file for each part type, with its parts' names and its own name as a phrase."""
    part = W.table(s, d, "part")
    family = F.struct(F.array_sort(F.collect_set("p_name")).alias("aliases"), F.array(F.lower("p_type")).alias("substr"))
    docs = part.groupBy("p_type").agg(family.alias("f")).select(
        F.to_json(F.struct(F.create_map("p_type", "f").alias("aliases"))).alias("json"))
    return S.read_aliases(s, _written(s, docs)).select("canonical", "alias", "phrase")


def file_capabilities(s, d) -> DataFrame:
    """Capability entries, a file for each brand and block of parts."""
    part = W.table(s, d, "part")
    entry = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("name_cn"), F.col("p_name").alias("name_en"),
                     F.col("p_brand").alias("category"),
                     F.array(F.upper("p_name"), F.lit(" Extra ")).alias("aliases"))
    docs = part.groupBy("p_brand", _block("p_partkey")).agg(F.to_json(F.struct(F.collect_list(entry).alias("features"))).alias("json"))
    return S.read_capabilities(s, _written(s, docs)).select("id", "category", "alias")


def file_vendors(s, d) -> DataFrame:
    """Known vendors, a file for each host, then names typed by users looked up in them."""
    host, pid = W.host(F.col("url")), F.col("page_id")
    pages = W.table(s, d, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("page_id"))
    entry = F.struct(F.concat(F.lit("Vendor "), F.col("page_id")).alias("name"), F.concat(F.lit("https://"), F.col("host")).alias("url"),
                     F.when(pid % 2 == 0, F.concat(F.lit("https://"), F.col("host"), F.lit("/plans"))).alias("pricing"), F.lit("").alias("docs"))
    docs = pages.select(F.to_json(F.struct(F.create_map("host", entry).alias("vendors"))).alias("json"))
    known = S.read_known_vendors(s, _written(s, docs))
    typed = pages.select(F.when(pid % 3 == 0, F.concat(F.lit(" vendor-"), F.col("page_id"))).when(pid % 3 == 1, F.upper("host")).otherwise(F.concat(F.lit("nobody"), F.col("page_id"))).alias("name"))
    return M.resolve_vendors(typed, known).select("name", "source", "url", "price_url", "confidence")


QUERIES = {f.__name__: f for f in [file_captures, file_ledger, file_claims, file_report, file_aliases, file_capabilities, file_vendors]}
ORACLE = {
    "file_captures": query(["cap"], "SELECT url, engine, md5(arg_max(text, page_id)) AS digest FROM cap GROUP BY url, engine"),
    "file_ledger": query(["led"], """SELECT url, arg_max(status, page_id) AS status, arg_max(array_to_string(kinds, '/'), page_id) AS kinds,
  arg_max(fetched_at, page_id) AS fetched_at, false AS from_cache FROM led GROUP BY url"""),
    "file_claims": EVIDENCE["claims_flat"],
    "file_report": EVIDENCE["url_violations"],
    "file_aliases": """SELECT p_type AS canonical, p_type AS alias, false AS phrase FROM part GROUP BY p_type UNION ALL SELECT DISTINCT p_type, p_name, false FROM part
  UNION ALL SELECT DISTINCT p_type, lower(p_type), true FROM part""",
    "file_capabilities": """SELECT DISTINCT p_partkey::VARCHAR AS id, p_brand AS category, unnest([lower(trim(p_name)), 'extra', lower(trim(p_type))]) AS alias FROM part""",
    "file_vendors": """SELECT CASE page_id % 3 WHEN 0 THEN 'vendor-' || page_id WHEN 1 THEN upper(host) ELSE 'nobody' || page_id END AS name,
  CASE WHEN page_id % 3 < 2 THEN 'builtin' ELSE 'unknown' END AS source, CASE WHEN page_id % 3 < 2 THEN 'https://' || host ELSE '' END AS url,
  CASE WHEN page_id % 3 = 2 THEN '' WHEN page_id % 2 = 0 THEN 'https://' || host || '/plans' ELSE 'https://' || host END AS price_url,
  CASE WHEN page_id % 3 < 2 THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence
FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1)""",
}
