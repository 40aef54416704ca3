"""Links found on captured pages and what to fetch next."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta import constants as K
from attesta.functions import urls as U
from attesta.operators.captures import engine_rank


def page_links(captures: DataFrame, keys: list[str], base: str = "url") -> DataFrame:
    """Every usable link of a page text: keys, pos, label, full (absolute address)."""
    found = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(K.LINK_IN_TEXT), 1).alias("label"),
        F.regexp_extract_all("text", F.lit(K.LINK_IN_TEXT), 2).alias("href"))
    base_col = base if base in keys else None
    rows = captures.select(*keys, *([] if base_col else [base]), F.posexplode(found).alias("pos", "link"))
    href = F.trim(F.col("link.href"))
    rows = (rows.where(~href.rlike("^(mailto:|tel:|javascript:)"))
            .withColumns({"label": F.trim(F.col("link.label")), "full": U.resolve_href(F.col(base), href)}))
    return rows.where(
        F.col("full").startswith("http") & U.same_site(F.col("full"), F.col(base))
        & ~U.bare_url(F.col("full")).rlike(K.RESOURCE_SUFFIX)).drop("link")


def discover_links(captures: DataFrame, keys: list[str], base: str = "url") -> DataFrame:
    """First matching link per page and kind: pricing, features, about, docs, testimonials, blog."""
    links = page_links(captures, keys, base)
    root = F.regexp_replace(F.col(base), "/+$", "")
    place = F.regexp_replace(F.replace(F.col("full"), root, F.lit("")), r"\?.*$", "")
    clean = U.bare_url(F.col("full"))
    shallow = U.effective_depth(U.path_of(clean)) <= 2
    hits = []
    for kind, rx in K.LINK_KINDS:
        ok = F.col("label").rlike(rx) | place.rlike(rx)
        hits.append(F.when(ok & shallow if kind in K.SHALLOW_KINDS else ok, F.lit(kind)))
    matched = links.select(*keys, "pos", clean.alias("link"), F.explode(F.array_compact(F.array(*hits))).alias("kind"))
    return matched.groupBy(*keys, "kind").agg(F.min_by("link", "pos").alias("link"), F.min("pos").alias("pos"))


def discover_union(captures: DataFrame, site_keys: list[str], base: str = "url") -> DataFrame:
    """Links per site over all extractors: the most trusted extractor with a hit wins per kind."""
    keys = list(dict.fromkeys([*site_keys, "engine", base]))
    found = discover_links(captures, keys, base)
    order = F.struct(engine_rank(F.col("engine")), F.col(base), F.col("pos"))
    return found.groupBy(*site_keys, "kind").agg(F.min_by("link", order).alias("link"))


def choose_targets(found: DataFrame, guesses: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Found links beat guesses, but a genuine guessed price page beats a long marketing address."""
    both = guesses.join(found, [*keys, "kind"], "full")
    take_guess = ((F.col("kind") == "pricing") & F.col("guess").isNotNull() & F.col("link").isNotNull()
                  & U.is_price_page(F.col("guess")) & ~U.is_price_page(F.col("link")))
    target = F.when(take_guess, F.col("guess")).otherwise(F.coalesce("link", "guess"))
    return (both.select(*keys, "kind", base, target.alias("target"))
            .where(F.col("target").isNotNull() & (F.col("target") != F.coalesce(F.col(base), F.lit("")))))


def robots_rules(bodies: DataFrame) -> DataFrame:
    """host, rule: non-empty Disallow rules that follow a `User-agent: *` line, from (host, body)."""
    lines = F.transform(F.split("body", "\r?\n"), lambda x: F.lower(F.trim(x)))
    state = F.struct(F.lit(False).alias("star"), F.array().cast("array<string>").alias("rules"))

    def step(acc, line):
        agent = line.startswith("user-agent:")
        rule = F.trim(F.regexp_replace(line, "^disallow:", ""))
        keep = acc["star"] & line.startswith("disallow:") & (rule != "")
        star = F.when(agent, F.trim(F.regexp_replace(line, "^user-agent:", "")) == "*").otherwise(acc["star"])
        return F.struct(star.alias("star"),
                        F.when(keep, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]).alias("rules"))
    return bodies.select("host", F.explode(F.array_distinct(
        F.aggregate(lines, state, step, lambda acc: acc["rules"]))).alias("rule"))


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages no rule of their host forbids: '/' forbids all, other rules are path prefixes."""
    path = F.coalesce(F.nullif(U.path_of(F.col(url)), F.lit("")), F.lit("/"))
    p = pages.withColumns({"__host": U.netloc(F.col(url)), "__path": path})
    # the rules of a host come from one file
    per_host = rules.groupBy(F.col("host").alias("__host")).agg(F.collect_set("rule").alias("__rules"))
    j = p.join(per_host, "__host", "left")
    banned = F.exists("__rules", lambda r: (r == "/") | F.col("__path").startswith(r))
    return j.where(~F.coalesce(banned, F.lit(False))).select(*pages.columns)


def extra_urls(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(vendor, kind, url) from 'NAME,KIND,URL' texts, without malformed, blank or known ones."""
    parts = F.split("spec", ",", 3)
    rows = specs.where(F.size(parts) == 3).select(
        F.trim(parts[0]).alias("vendor"), F.trim(parts[1]).alias("kind"), F.trim(parts[2]).alias("url"))
    return rows.where((F.col("vendor") != "") & (F.col("url") != "")).join(known.select("url"), "url", "left_anti")
