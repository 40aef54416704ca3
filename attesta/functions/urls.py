"""URL expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from attesta import constants as K

_NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def netloc(u: Column) -> Column:
    return F.regexp_extract(F.coalesce(u, F.lit("")), _NETLOC, 1)


def host_of(u: Column) -> Column:
    """Lower-case host name without user part and port."""
    return F.regexp_replace(F.lower(netloc(u)), r"^.*@|:\d*$", "")


def plain_host(u: Column) -> Column:
    return F.regexp_replace(host_of(u), r"www\.", "")


def path_of(u: Column) -> Column:
    return F.regexp_extract(F.coalesce(u, F.lit("")), _PATH, 1)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def last_segment(u: Column) -> Column:
    """Lower-case last path segment, '' without one."""
    segs = path_segments(path_of(u))
    return F.coalesce(F.lower(F.try_element_at(segs, F.lit(-1))), F.lit(""))


def bare_url(u: Column) -> Column:
    return F.regexp_replace(u, r"[?#].*$", "")


def registrable_domain(host: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(host, F.lit(""))), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(
        F.lower(F.coalesce(host, F.lit(""))))


def same_site(a: Column, b: Column) -> Column:
    return registrable_domain(netloc(a)) == registrable_domain(netloc(b))


def effective_depth(path: Column) -> Column:
    """Path segments, not counting page numbers and 'page' / 'pages'."""
    return F.size(F.filter(
        path_segments(path),
        lambda s: ~s.rlike(r"(?U)^\d+$") & ~F.lower(s).isin("page", "pages")))


def url_type(u: Column) -> Column:
    clean = F.regexp_replace(bare_url(F.lower(u)), "/+$", "")
    out = None
    for kind, rx in K.URL_TYPE_RULES:
        hit = clean.rlike(rx)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit(K.DEFAULT_URL_TYPE))


def is_web_url(u: Column) -> Column:
    """Absolute http(s) address with a host."""
    return F.coalesce(u, F.lit("")).rlike(r"(?i)^https?://[^/?#]+")


def safe_url(u: Column) -> Column:
    """http(s) addresses and page anchors pass, everything else becomes ''."""
    s = F.trim(F.coalesce(u, F.lit("")))
    return F.when(s.rlike(r"(?i)^https?://") | s.startswith("#"), s).otherwise(F.lit(""))


def is_price_page(u: Column, segments: list[str] | None = None) -> Column:
    """No path at all, or a last segment that names a price page."""
    last = last_segment(u)
    return (last == "") | last.isin(segments or K.PRICE_PAGE_SEGMENTS)


def weak_anchor(u: Column) -> Column:
    """'pricing' for a price page, 'root' for a bare host, '' for a proper sub-page."""
    last = last_segment(u)
    return (F.when(last == "pricing", F.lit("pricing"))
            .when((netloc(u) != "") & (last == ""), F.lit("root"))
            .otherwise(F.lit("")))


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page; the page counts as a directory."""
    root = F.regexp_replace(base, "/+$", "")
    scheme = F.regexp_extract(root, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    origin = F.concat(scheme, F.lit("://"), netloc(root))
    plain = path_of(root)
    # a query or fragment swallows the trailing slash, so only a plain base is a directory
    folder = F.when(root.rlike(r"[?#]"), F.regexp_replace(plain, "[^/]*$", "")).otherwise(
        F.concat(plain, F.lit("/")))
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    rel = F.regexp_replace(href, r"[?#].*$", "")
    joined = F.when(rel.startswith("/"), rel).otherwise(F.concat(folder, rel))
    stack = F.aggregate(
        F.split(joined, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    dotted = joined.rlike(r"(^|/)\.{1,2}(/|$)")
    ends_dir = joined.rlike(r"(^|/)\.{1,2}$")
    clean = F.when(dotted, F.concat(F.array_join(stack, "/"), F.when(ends_dir, F.lit("/")).otherwise(F.lit("")))
                   ).otherwise(joined)
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .otherwise(F.concat(origin, clean, tail)))


def redirect_target(href: Column) -> Column:
    """Real address behind a search redirect; other addresses pass unchanged."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    raw = F.regexp_extract(full, r"[?&]uddg=([^&#]+)", 1)
    hit = (F.contains(full, F.lit("duckduckgo.com/l/")) | F.contains(full, F.lit("uddg="))) & (raw != "")
    return F.when(hit, F.coalesce(F.try_url_decode(raw), raw)).otherwise(full)


def source_label(u: Column) -> Column:
    low = F.lower(F.coalesce(u, F.lit("")))
    out = F.when(low == "", F.lit("来源"))
    for parts, label in K.SOURCE_LABELS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit("官网页面"))


def names_any(u: Column, fragments: list[str]) -> Column:
    hit = F.lit(False)
    for p in fragments:
        hit = hit | F.contains(u, F.lit(p))
    return hit
