"""Captured page texts and their ledger."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta import constants as K
from attesta.functions import prices as P, text as T, urls as U, windows as V
from attesta.operators.spread import first_per_key


def engine_rank(engine: Column) -> Column:
    """Trust position of an extractor, 0 first; unknown extractors come last."""
    pos = F.array_position(F.array(*[F.lit(e) for e in K.ENGINE_ORDER]), engine)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(99))


def latest_texts(df: DataFrame, order: str) -> DataFrame:
    """One text per (url, engine): the one read last."""
    return df.groupBy("url", "engine").agg(F.max_by("text", order).alias("text"))


def capture_meta(captures: DataFrame) -> DataFrame:
    """Every non-empty text with its length and content hash; the text itself is dropped."""
    return (captures.where(F.coalesce(F.col("text"), F.lit("")) != "")
            .withColumns({"chars": F.length("text"), "content_hash": T.content_hash(F.col("text"))})
            .drop("text"))


def build_ledger(results: DataFrame) -> DataFrame:
    """One row per url from results(url, kind, engine, success, text, fetched_at, from_cache).

    A url is ok when any attempt gave text; kinds are united; each engine keeps its last meta.
    """
    ok = F.col("success") & (F.coalesce(F.col("text"), F.lit("")) != "")
    per_engine = (results.withColumn("ok", F.coalesce(ok, F.lit(False)))
                  .withColumn("meta", F.when(F.col("ok"), F.struct(
                      F.lit(True).alias("ok"), F.length("text").alias("chars"),
                      T.content_hash(F.col("text")).alias("content_hash"))))
                  .groupBy("url", "engine").agg(
                      F.collect_set("kind").alias("kinds"), F.bool_or("ok").alias("ok"),
                      F.max_by("meta", F.when(F.col("ok"), F.col("fetched_at"))).alias("meta"),
                      F.max(F.when(F.col("ok"), F.col("fetched_at"))).alias("ok_at"),
                      F.max("fetched_at").alias("any_at"),
                      F.bool_or(F.col("ok") & F.coalesce(F.col("from_cache"), F.lit(False))).alias("from_cache")))
    return per_engine.groupBy("url").agg(
        F.when(F.bool_or("ok"), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("meta").isNotNull(), F.struct(F.col("engine"), F.col("meta")))))).alias("engines"),
        F.coalesce(F.max("ok_at"), F.max("any_at")).alias("fetched_at"),
        F.bool_or("from_cache").alias("from_cache"))


def failure_rows(results: DataFrame) -> DataFrame:
    """A (vendor, url, kind) without any text is a failure, with its whole error."""
    ok = F.col("success") & (F.coalesce(F.col("text"), F.lit("")) != "")
    return (results.groupBy("vendor", "url", "kind").agg(
        F.bool_or(F.coalesce(ok, F.lit(False))).alias("ok"), F.min("error").alias("error"))
        .where(~F.col("ok")).select(
            "vendor", "url", "kind",
            F.coalesce("error", F.lit("all engines empty")).alias("error")))


def merge_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental merge: kinds united, ok wins, newer engine meta wins, newest time kept."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    head = both.groupBy("url").agg(
        F.when(F.max(F.col("status") == "ok"), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.max_by("kinds", F.when(F.col("__gen") == 0, F.lit(1))).alias("k0"),
        F.max_by("kinds", F.when(F.col("__gen") == 1, F.lit(1))).alias("k1"),
        F.max_by("engines", F.when(F.col("__gen") == 0, F.lit(1))).alias("e0"),
        F.max_by("engines", F.when(F.col("__gen") == 1, F.lit(1))).alias("e1"),
        F.max("fetched_at").alias("fetched_at"), F.bool_or("from_cache").alias("from_cache"))
    none = F.array().cast("array<string>")
    keep_old = F.map_filter(F.col("e0"), lambda k, _: ~F.coalesce(F.map_contains_key(F.col("e1"), k), F.lit(False)))
    return head.select(
        "url", "status",
        F.array_sort(F.array_union(F.coalesce("k0", none), F.coalesce("k1", none))).alias("kinds"),
        F.when(F.col("e0").isNull(), F.col("e1")).when(F.col("e1").isNull(), F.col("e0"))
        .otherwise(F.map_concat(keep_old, F.col("e1"))).alias("engines"),
        "fetched_at", "from_cache")


def merge_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).dropDuplicates(["vendor", "url", "kind"])


def score_captures(captures: DataFrame) -> DataFrame:
    """Each capture with quality, length and whether it can stand for its page; texts stay behind.

    Only price pages are searched for prices.
    """
    is_price_page = U.url_type(F.col("url")) == "pricing"
    return captures.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumns({
        "quality": T.quality_score(F.col("text")), "chars": F.length("text"),
        "priced": F.when(is_price_page, P.has_price(F.col("text"))).otherwise(F.lit(True))}).drop("text")


def primary_capture(captures: DataFrame, keys: list[str]) -> DataFrame:
    """The capture to read first: priced if a price page, clean, trusted engine, quality, length."""
    scored = score_captures(captures)
    best = F.max(F.struct(
        "priced", (F.col("quality") >= 0.5).alias("clean"),
        (-engine_rank(F.col("engine"))).alias("trust"), "quality", "chars", "engine")).alias("best")
    return scored.groupBy(*keys).agg(best).select(
        *keys, F.col("best.engine").alias("engine"), F.col("best.quality").alias("quality"),
        F.col("best.chars").alias("chars"))


def merged_text(captures: DataFrame, ledger: DataFrame) -> DataFrame:
    """Readable section of every ok page: kinds, source, engines, time, then the best text."""
    # the best text of a url is one text, also when the url was read more than once
    priced = F.when(U.url_type(F.col("url")) == "pricing", P.has_price(F.col("text"))).otherwise(F.lit(True))
    scored = captures.where(F.coalesce(F.col("text"), F.lit("")) != "").select("url", "engine", "text", priced.alias("priced"), T.quality_score(F.col("text")).alias("quality"))
    place = F.struct("priced", (F.col("quality") >= 0.5).alias("clean"), (-engine_rank(F.col("engine"))).alias("trust"), "quality", F.length("text").alias("chars"), "engine", "text")
    best = scored.groupBy("url").agg(F.max(place).alias("best"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    head = F.concat_ws("\n", F.concat(F.lit("# Kind: "), F.array_join("kinds", "/")),
                       F.concat(F.lit("# Source: "), F.col("url")),
                       F.concat(F.lit("# Scrapers: "), F.col("engines")),
                       F.concat(F.lit("# Time: "), F.col("fetched_at")))
    return (best.join(ledger.where(F.col("status") == "ok").select("url", "kinds", "fetched_at"), "url")
            .select("url", F.concat(head, F.lit("\n\n"), F.col("best.text")).alias("section")))


# ------------------------------------------------------------------ extractor statistics
def extractor_stats(log: DataFrame, as_of: Column, window_days: int = K.STATS_WINDOW_DAYS) -> DataFrame:
    """Attempts, successes and quality per (engine, url type); groups silent too long are dropped."""
    s = log.groupBy("engine", "url_type").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.sum("quality").alias("q_sum"),
        F.max("ts").alias("last"))
    fresh = s.where(F.col("last") >= as_of - F.make_dt_interval(F.lit(window_days)))
    return fresh.withColumn("score", F.col("ok") / F.col("n") * 0.6
                            + F.col("q_sum").cast("double") / F.col("n") * 0.4)


def route_order(stats: DataFrame) -> DataFrame:
    """Extractors of each url type, best expected first: history weighs .7, list position .3."""
    spark = stats.sparkSession
    routes = spark.createDataFrame(
        [(t, e, i) for t, engines in K.ROUTES.items() for i, e in enumerate(engines)],
        "url_type string, engine string, place int")
    joined = routes.join(stats.select("url_type", "engine", "score"), ["url_type", "engine"], "left")
    weight = F.coalesce("score", F.lit(0.5)) * 0.7 + (F.lit(1.0) - F.col("place") * 0.15) * 0.3
    order = Window.partitionBy("url_type").orderBy(F.col("weight").desc(), F.col("place").desc())
    return joined.withColumn("weight", weight).withColumn("position", F.row_number().over(order))


def next_engines(pages: DataFrame) -> DataFrame:
    """Unused extractors of the ladder for pages(url_type, used): engine and step, in order."""
    ladder = F.create_map(*[x for t, es in K.LADDER.items() for x in (
        F.lit(t), F.array(*[F.lit(e) for e in es]).cast("array<string>"))])
    left = F.array_except(F.coalesce(ladder[F.col("url_type")], F.array().cast("array<string>")), F.col("used"))
    return pages.select("*", F.posexplode(left).alias("step", "next_engine"))


# ------------------------------------------------------------------ quotes and windows
QUOTE_CHARS = (35, 130)


def quotable(line: Column, lo: int = QUOTE_CHARS[0], hi: int = QUOTE_CHARS[1]) -> Column:
    """A clean prose line that can be cited verbatim."""
    letters = F.regexp_count(line, F.lit("[一-鿿 a-zA-Z0-9]"))
    # cheap and selective tests first
    return (F.length(line).between(lo, hi) & (line.rlike(K.SENTENCE_END) | line.startswith("#"))
            & ~F.contains(line, F.lit("http")) & ~F.contains(line, F.lit("]("))
            & (letters >= F.length(line) * 0.7) & (F.regexp_count(line, F.lit(K.SCRIPT_SWITCH)) < 2) & ~P.has_price(line))


def safe_quotes(captures: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The first n distinct quotable lines per page that occur verbatim in the page."""
    clean = F.filter(T.clean_lines(F.col("text"), QUOTE_CHARS[0]), lambda s: quotable(s))

    def shown(lines: Column) -> Column:
        # the form without links is made only for texts whose plain form lacks a line
        marks = V.bound(T.norm_ws(F.col("text")), lambda f: F.transform(lines, lambda s: F.struct(s.alias("s"), F.contains(f, s).alias("hit"))))
        return V.bound(marks, lambda m: F.when(F.forall(m, lambda x: x["hit"]), lines).otherwise(V.bound(
            T.norm_stripped(F.col("text")), lambda b: F.transform(F.filter(m, lambda x: x["hit"] | F.contains(b, x["s"])), lambda x: x["s"]))))

    found = V.bound(clean, lambda lines: F.when(F.size(lines) > 0, shown(lines)).otherwise(lines))
    lines = captures.select(*keys, engine_rank(F.col("engine")).alias("rank"), F.posexplode(found).alias("pos", "quote"))
    once = lines.groupBy(*keys, "quote").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first_per_key(once, keys, [F.col("at.rank"), F.col("at.pos")], n, out="nth").drop("at")


def search_lines(captures: DataFrame, patterns: DataFrame, k: int | None = None, ignore_case: bool = True) -> DataFrame:
    """(pid, url, line, nth, engine, pos): every distinct clean line of a page that matches and can be quoted verbatim.

    patterns(pid, url, pattern), captures(url, engine, text).  A page's patterns travel to its texts as one list, texts
    stay as they are; a pattern that needs a certain stretch of letters is tried only on texts and lines that have
    it.  A line counts when some capture of the page shows it in one of the normal forms; lines that their own text
    does not show (an image was cut out of them) are looked up in the page's other captures.  nth orders by trust in
    the extractor, then by place; `k` keeps the first k for each pattern.
    """
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    asked = patterns.select("pid", "url", "pattern").distinct().withColumn("part", low(literal_part(F.col("pattern"))))
    asked = asked.groupBy("url").agg(F.collect_list(F.struct("pid", "pattern", "part")).alias("asked"))
    held = captures.where(F.coalesce(F.col("text"), F.lit("")) != "").join(asked, "url")
    held = held.withColumn("asked", F.filter("asked", lambda p: F.contains(low(F.col("text")), p["part"]))).where(F.size("asked") > 0)
    flag = F.lit("(?i)" if ignore_case else "")
    forms = F.struct(T.norm_ws(F.col("text")).alias("flat"), T.norm_stripped(F.col("text")).alias("bare"), T.clean_lines(F.col("text")).alias("lines"))

    def hits(f: Column) -> Column:
        places = F.transform(f["lines"], lambda s, i: F.struct(i.alias("pos"), s.alias("line"), low(s).alias("low")))
        return V.bound(places, lambda ls: F.flatten(F.transform("asked", lambda p: F.transform(
            F.filter(ls, lambda s: F.contains(s["low"], p["part"]) & F.regexp_like(s["line"], F.concat(flag, p["pattern"]))),
            lambda s: F.struct(p["pid"].alias("pid"), s["pos"].alias("pos"), s["line"].alias("line"),
                               (F.contains(f["flat"], s["line"]) | F.contains(f["bare"], s["line"])).alias("own"))))))

    found = held.select("url", "engine", F.inline(V.bound(forms, hits)))
    shown = found.where("own").drop("own")
    # the rest is few: only their pages' texts are searched again
    cut = found.where(~F.col("own")).drop("own")
    texts = captures.join(cut.select("url").distinct(), "url", "left_semi")
    shapes = F.array_distinct(F.array(T.norm_ws(F.col("text")), T.norm_stripped(F.col("text"))))
    elsewhere = (cut.select("url", "line").distinct().join(texts.select("url", F.explode(shapes).alias("form")), "url")
                 .where(F.contains("form", F.col("line"))).select("url", "line").distinct())
    every = shown.unionByName(cut.join(elsewhere, ["url", "line"]).select(*shown.columns))
    at = F.struct(engine_rank(F.col("engine")).alias("rank"), "engine", "pos")
    once = every.groupBy("pid", "url", "line").agg(F.min(at).alias("at"))
    # two readings of a url may have a line each at one place
    order = Window.partitionBy("pid", "url").orderBy("at", "line")
    ranked = once.withColumn("nth", F.row_number().over(order))
    ranked = ranked if k is None else ranked.where(F.col("nth") <= k)
    return ranked.select("pid", "url", "line", "nth", F.col("at.engine").alias("engine"), F.col("at.pos").alias("pos"))


def literal_part(pattern: Column) -> Column:
    """The longest run of letters and digits every match of a regular expression has to hold; empty when there is no certain one.

    Expressions with groups or alternatives have none; classes, escapes and what a quantifier may leave out go first.
    """
    open_ = F.regexp_replace(F.regexp_replace(pattern, r"\\Q|\\E", "("), r"\\[pPxu]\{?\w*\}?|\\.", " ")
    plain = F.regexp_replace(F.regexp_replace(open_, r"\[[^\]]*\]", " "), r".(?:[*?]|\{[^}]*\}?)", " ")
    parts = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))
    return F.when(F.contains(open_, F.lit("(")) | F.contains(open_, F.lit("|")), F.lit("")).otherwise(longest)


def evidence_windows(df: DataFrame, keys: list[str], text: str, pattern: str, context: int = 120,
                     join_gap: int = 64) -> DataFrame:
    """Stretches of a text around pattern matches, with their text; stretches that touch or nearly touch are one.

    Matches and their union are folds inside the row, so nothing is shuffled.
    """
    wins = df.select(*keys, F.col(text).alias("__t"), V.evidence(F.col(text), pattern, context, join_gap).alias("__w"))
    return wins.select(*keys, F.explode(F.transform("__w", lambda w, k: F.struct(
        (k + 1).cast("long").alias("window_no"), w["start"].alias("start"), w["stop"].alias("end"), w["n"].cast("long").alias("matches"),
        F.substring("__t", w["start"] + 1, w["stop"] - w["start"]).alias("text")))).alias("__x")).select(*keys, "__x.*")


def focused_texts(df: DataFrame, keys: list[str], text: str, pattern: str, **limits: int) -> DataFrame:
    """(keys, text, head, windows, dropped): long texts as head, windows around the matches and tail.  Limits as in windows.focused."""
    return df.select(*keys, V.focused(F.col(text), pattern, **limits).alias("__f")).select(*keys, "__f.*")


def variant_lines(states: DataFrame) -> DataFrame:
    """Lines the second state of a page adds, from states(key, first, second).

    Kept only when the two states show different prices; bare price lines are left out.
    """
    a, b = F.array_distinct(P.price_tokens(F.col("first"))), F.array_distinct(P.price_tokens(F.col("second")))
    differs = (F.size(b) > 0) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))
    bare = lambda s: (F.replace(s, F.lit(" "), F.lit("")).rlike(f"^(?:{K.PRICE_TOKEN})$")
                      | ((F.length(s) < 14) & P.has_price(s) & ~s.rlike(K.BARE_VARIANT_WORDS)))
    lines = F.filter(F.transform(F.split("second", "\n"), lambda x: F.trim(x)), lambda s: (s != "") & ~bare(s))
    return states.where(differs).select("key", F.array_join(lines, "\n").alias("variant"),
                                        F.size(F.array_except(b, a)).alias("new_prices"))
