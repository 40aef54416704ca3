"""Jobs over growing logs: extractor statistics, price cache, ledger and lessons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta import constants as K
from attesta.streaming.tables import KeyedTable, upsert_stream


# ------------------------------------------------------------------ extractor statistics
def windowed_stats(log: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Attempts, successes and quality per (time window, extractor, url type); batch or stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.groupBy(w.alias("window"), "engine", "url_type").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.sum("quality").alias("q_sum"))


def stream_stats(log: DataFrame, out: str, checkpoint: str, width: str = "1 day", slide: str | None = None,
                 late: str = "1 hour") -> StreamingQuery:
    """The same statistics as a stream: a window is written once no event of it can come any more.

    Events later than `late` are not counted; Spark reports them per batch in the query progress
    (numRowsDroppedByWatermark).
    """
    stats = windowed_stats(log.withWatermark("ts", late), width, slide)
    flat = stats.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "engine", "url_type", "n", "ok", "q_sum")
    return (flat.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ------------------------------------------------------------------ lessons
TOLD = ("hint", "resolution", "evidence", "alt_sources")


def merge_lessons(log: DataFrame) -> DataFrame:
    """One row per (domain, issue): sightings, first and last sight, and the latest of what was told.

    hint and resolution are texts, evidence and alt_sources lists; each is taken from the last sighting
    that tells it.  Columns the log lacks are left out.
    """
    latest = []
    for name in (n for n in TOLD if n in log.columns):
        empty = F.lit("") if log.schema[name].dataType.typeName() == "string" else F.array().cast("array<string>")
        at = F.when(F.coalesce(F.col(name) != empty, F.lit(False)), F.struct("seen_at", "seq"))
        latest += [F.max_by(name, at).alias(name), F.max(at).alias(f"{name}_at")]
    return log.groupBy("domain", "issue").agg(
        F.count("*").alias("runs_seen"), F.min("seen_at").alias("learned_at"), F.max("seen_at").alias("last_seen"), *latest)


def combine_lessons(old: DataFrame, new: DataFrame) -> DataFrame:
    latest = [c for n in TOLD if n in old.columns for c in (F.max_by(n, f"{n}_at").alias(n), F.max(f"{n}_at").alias(f"{n}_at"))]
    return old.unionByName(new).groupBy("domain", "issue").agg(
        F.sum("runs_seen").alias("runs_seen"), F.min("learned_at").alias("learned_at"), F.max("last_seen").alias("last_seen"), *latest)


def stream_lessons(log: DataFrame, table: KeyedTable, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    return upsert_stream(log, table, ["domain", "issue"], merge_lessons, combine_lessons, checkpoint, "seen_at", late)


# ------------------------------------------------------------------ ledger
def stream_ledger(results: DataFrame, table: KeyedTable, checkpoint: str, late: str = "1 hour", once_within: str | None = None) -> StreamingQuery:
    """Ledger rows from extraction attempts as they arrive; times are texts such as 2024-01-31 00:00 UTC.

    With `once_within`, an attempt that is delivered again (equal in url, kind, engine and content) within
    that span of time is dropped, and so are attempts later than that.
    """
    from attesta.functions.text import content_hash
    from attesta.operators.captures import build_ledger, merge_ledgers
    timed = results.withColumn("tried_at", F.try_to_timestamp(F.substring("fetched_at", 1, 16), F.lit("yyyy-MM-dd HH:mm")))
    if once_within:
        timed = (timed.withColumn("content", content_hash(F.coalesce("text", F.lit("")))).withWatermark("tried_at", once_within)
                 .dropDuplicatesWithinWatermark(["url", "kind", "engine", "success", "content"]).drop("content"))
    return upsert_stream(timed, table, ["url"], build_ledger, merge_ledgers, checkpoint, "tried_at", late)


# ------------------------------------------------------------------ price cache
def latest_cache(entries: DataFrame) -> DataFrame:
    """Newest usable entry per domain: at least two engines."""
    return entries.where(F.col("engines") >= 2).groupBy("domain").agg(
        F.max("cached_at").alias("cached_at"), F.max_by("url", F.struct("cached_at", "url")).alias("url"),
        F.max_by("engines", F.struct("cached_at", "url")).alias("engines"))


def stream_cache(entries: DataFrame, table: KeyedTable, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """The newest entry of every domain as a table; `read_cache` leaves out what is too old.

    For answers with a lifetime while the stream runs see streaming.cache.
    """
    return upsert_stream(entries, table, ["domain"], latest_cache,
                         lambda old, new: latest_cache(old.unionByName(new.select(*old.columns))), checkpoint, "cached_at", late)


def read_cache(table: KeyedTable, ttl_days: int = K.TTL_DAYS) -> DataFrame:
    """Entries at most ttl_days older than the newest one."""
    rows = table.read()
    return rows.where(F.col("cached_at") >= rows.agg(F.max("cached_at")).scalar() - F.make_dt_interval(F.lit(ttl_days)))


# ------------------------------------------------------------------ fetch budget
def stream_run_time(fetches: DataFrame, out: str, checkpoint: str, budget_s: float, gap: str = "30 minutes",
                    late: str = "1 hour") -> StreamingQuery:
    """Fetch seconds per vendor run, a run ending after `gap` without a fetch; flags spent budgets."""
    runs = (fetches.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("run"), "vendor")
            .agg(F.count("*").alias("pages"), F.sum("seconds").alias("seconds")))
    flat = runs.select("vendor", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "pages", "seconds",
                       (F.col("seconds") > budget_s).alias("over_budget"))
    return (flat.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
