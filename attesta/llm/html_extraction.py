"""Main texts of web pages: page structure, and a host's repeated runs from a suffix array."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.common import bit_map, keep, plain, small_side, table

# Elements by what they hold.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NEVER = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "title", "nav", "footer",
         "aside", "form", "button", "select", "option", "textarea", "input", "dialog", "menu"}
BODY = {"article", "main"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
NEVER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
               "banner", "sidebar", "comment", "comments", "commentlist", "disqus", "respond", "replies", "cookie", "cookies", "consent",
               "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
               "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "footer", "masthead",
               "related", "recommended", "pagination", "pager", "login", "skip", "toolbar"}
# what a name of several words may add to one of those and still name the same
PLAIN_WORDS = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "links",
               "list", "panel", "post", "posts", "section", "slot", "unit", "widget", "wrap", "wrapper"}
BODY_WORDS = {"article-body", "articlebody", "article-content", "post-content", "post-body", "entry-content", "main-content", "story-body"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CUT_TAG = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?$")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

RUN = 8          # words of the shortest repeated run
PAGES = 3        # distinct pages a run has to stand on
GROUP = 4096     # pages of a suffix array
BITS = 1 << 25   # of the map of runs that slots ask for


class Blocks(HTMLParser):
    """Blocks of text with their region: chrome, body (a marked article) or open (neither)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []  # tag, region inside
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []

    def region(self) -> str:
        return self.stack[-1][1] if self.stack else "open"

    def block_region(self) -> str:
        """The region of the block that inline elements stand in."""
        return next((r for tag, r in reversed(self.stack) if tag not in INLINE), "open")

    def cut(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            self.out.append((words, self.block_region()))
        self.text = []

    @staticmethod
    def kind(tag: str, attrs: list[tuple[str, str | None]], above: str) -> str:
        if above == "chrome" or tag in NEVER or (tag == "header" and above != "body"):
            return "chrome"
        a = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")) or a.get("role") in NEVER_ROLES:
            return "chrome"
        names = set(a.get("class", "").split()) | {a.get("id", "")}
        # outside a marked article one word of a name tells, inside it all of them have to
        tells = all if above == "body" else any
        if tag not in ("html", "body") and above != "body" and "header" in names:
            return "chrome"
        for parts in ([w for w in _SPLIT.split(n) if w] for n in names):
            if tag not in ("html", "body") and any(w in NEVER_WORDS for w in parts) and tells(w in NEVER_WORDS | PLAIN_WORDS or w.isdigit() for w in parts):
                return "chrome"
        if tag in BODY or names & BODY_WORDS or a.get("itemprop") == "articlebody" or a.get("role") in ("main", "article"):
            return "body"
        return above

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.cut()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.stack and any(t == "p" for t, _ in self.stack):
            # an open paragraph ends here, with the inline elements left open in it
            at = max(k for k, s in enumerate(self.stack) if s[0] == "p")
            if all(s[0] in INLINE for s in self.stack[at + 1:]):
                del self.stack[at:]
        self.stack.append((tag, self.kind(tag, attrs, self.region())))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.cut()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack and (self.stack[-1][0] in ("script", "style") or self.region() == "chrome" and self.block_region() != "chrome"):
            return  # an inline element that is hidden or an advert leaves its block as it is
        self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(text, region) of every block of a page, in page order; white space in a block is one space.

    A tag or comment that the page breaks off in is left out.
    """
    parser = Blocks()
    parser.feed(_CUT_TAG.sub("", html or ""))
    parser.close()
    parser.cut()
    return parser.out


def repeated(words: np.ndarray, page: np.ndarray, content: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Which words lie on a run of `run` words that stands on `pages` distinct pages of one host.

    words: ids that differ between hosts; page: of each word, ascending; content: of each page, equal for
    equal pages.  A suffix array by prefix doubling: after log2(run) rounds suffixes with the same rank
    share their first `run` words.  A suffix ends with its page.
    """
    n = len(words)
    covered = np.zeros(n + 1, np.int64)
    if n < run:
        return covered[:n] > 0
    end = np.r_[np.searchsorted(page, page, side="right")]
    rank, h = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    alive = np.arange(n)
    while h < run:
        step = min(h, run - h)  # the last round may overlap
        alive = alive[alive + h + step <= end[alive]]
        if not len(alive):
            return covered[:n] > 0
        pair = rank[alive] * np.int64(n + 1) + rank[alive + step]
        new = np.full(n, -1, np.int64)
        new[alive] = np.unique(pair, return_inverse=True)[1]
        rank, h = new, h + step
    order = alive[np.lexsort((content[page[alive]], rank[alive]))]
    r, c = rank[order], content[page[order]]
    first = np.r_[True, r[1:] != r[:-1]]
    fresh = first | np.r_[True, c[1:] != c[:-1]]
    group = np.cumsum(first) - 1
    many = np.bincount(group, weights=fresh)[group] >= pages
    at = order[many]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + run, -1)
    return np.cumsum(covered)[:n] > 0


def whole_runs(gone: np.ndarray, run: int = RUN) -> np.ndarray:
    """The marked runs of a block that are `run` words long inside it, or the whole block.

    A shorter one is the tail of a run of the blocks beside it, and the block's own words.
    """
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    out = np.zeros(len(gone), bool)
    for a, z in edges.reshape(-1, 2):
        if z - a >= min(run, len(gone)):
            out[a:z] = True
    return out


def packed(html: str | None) -> bytes:
    """The blocks of a page, compressed: a line for each, its region's first letter before it."""
    return zlib.compress("\n".join(region[0] + text for text, region in blocks_of(html)).encode("utf-8", "surrogatepass"))


def unpacked(blocks: bytes) -> list[tuple[str, str]]:
    """(text, first letter of the region) of every block."""
    lines = zlib.decompress(blocks).decode("utf-8", "surrogatepass")
    return [(line[1:], line[0]) for line in lines.split("\n")] if lines else []


def word_stream(parsed: list[list[tuple[str, str]]]) -> tuple[list[str], np.ndarray, list[tuple[int, int, int, int]]]:
    """All words of some pages, the page of each, and (page, block, start, past end) of every block."""
    stream, owner, spans = [], [], []
    for p, blocks in enumerate(parsed):
        for k, (text, _) in enumerate(blocks):
            words = text.split(" ")
            spans.append((p, k, len(stream), len(stream) + len(words)))
            stream += words
            owner += [p] * len(words)
    return stream, np.array(owner, np.int64), spans


def has_article(parsed: list[list[tuple[str, str]]]) -> list[bool]:
    return [any(r == "b" for _, r in blocks) for blocks in parsed]


def run_starts(page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Places at which `run` words of one page begin."""
    n = max(len(page) - run + 1, 0)
    return np.flatnonzero(page[:n] == page[run - 1:run - 1 + n])


def open_starts(parsed: list[list[tuple[str, str]]], page: np.ndarray, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Places of runs with a word that goes if the run repeats: all but those inside a marked article."""
    marked, open_ = has_article(parsed), np.zeros(len(page) + 1, np.int64)
    for p, k, a, z in spans:
        open_[a + 1:z + 1] = not (marked[p] and parsed[p][k][1] == "b")
    upto, at = np.cumsum(open_), run_starts(page)
    return at[upto[at + RUN] > upto[at]]


def run_names(stream: list[str], page: np.ndarray, hosts: np.ndarray, at: np.ndarray, run: int = RUN) -> Iterator[np.ndarray]:
    """64 bits, then 64 others, that name the words of the runs at some places and their host; hosts: one for each page."""
    used = np.zeros(len(stream) + 1, np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + run, -1)
    used = np.flatnonzero(np.cumsum(used)[:-1])
    code, words = pd.factorize(np.array(stream, object)[used])
    place = np.zeros(len(stream), np.int64)
    place[used] = np.arange(len(used))
    first = place[at]
    for salt in ("attesta.runs.one", "attesta.runs.two"):
        value = pd.util.hash_array(np.asarray(words, object), hash_key=salt, categorize=False)[code] if len(code) else np.zeros(0, np.uint64)
        h = pd.util.hash_array(np.asarray(hosts, object), hash_key=salt, categorize=True)[page[at]]
        for k in range(run):
            h = (h ^ value[first + k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        yield h.view(np.int64)


def asked_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, high, low), each once a batch: the runs with a word that goes if the run stands on enough pages."""
    for batch in batches:
        parsed = [unpacked(b) for b in batch["blocks"]]
        stream, page, spans = word_stream(parsed)
        at = open_starts(parsed, page, spans)
        low, high = run_names(stream, page, batch["host"].to_numpy(), at)
        yield pd.DataFrame({"part": batch["part"].to_numpy()[page[at]], "high": high, "low": low}).drop_duplicates()


def held_runs(batches: Iterator[pd.DataFrame], asked: np.ndarray) -> Iterator[pd.DataFrame]:
    """(high, low, content): which pages hold a run that may be asked for; PAGES distinct ones of a batch tell as much as all."""
    for batch in batches:
        stream, page, _ = word_stream([unpacked(b) for b in batch["blocks"]])
        at, hosts = run_starts(page), batch["host"].to_numpy()
        spot = next(run_names(stream, page, hosts, at)) & np.int64(BITS - 1)
        at = at[(asked[spot >> 3] >> (spot & 7) & 1).astype(bool)]
        low, high = run_names(stream, page, hosts, at)
        content = pd.util.hash_array(batch["blocks"].to_numpy(object), categorize=True).view(np.int64)
        rows = pd.DataFrame({"high": high, "low": low, "content": content[page[at]]}).drop_duplicates()
        yield rows[rows.groupby(["high", "low"]).cumcount() < PAGES]


def extract_group(pages: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
    """Main texts of some pages, whole hosts as a rule; known(high, low): runs that repeat on the host, if this is a part of one."""
    parsed = [unpacked(b) for b in pages["blocks"]]
    hosts = pd.factorize(pages["host"])[0]
    stream, page, spans = word_stream(parsed)
    ids = pd.factorize(np.array(stream, object))[0].astype(np.int64) * (len(parsed) + 1) + hosts[page]
    gone = repeated(ids, page, pd.factorize(pages["blocks"])[0])
    if known is not None and len(known):
        at = open_starts(parsed, page, spans)
        low, high = run_names(stream, page, pages["host"].to_numpy(), at)
        told = known.sort_values("high")
        where = np.minimum(np.searchsorted(told["high"], high), len(told) - 1)
        at = at[(told["high"].to_numpy()[where] == high) & (told["low"].to_numpy()[where] == low)]
        edge = np.zeros(len(stream) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + RUN, -1)
        gone |= np.cumsum(edge)[:-1] > 0
    texts: list[list[str]] = [[] for _ in parsed]
    removed = np.zeros(len(parsed), np.int64)
    marked = has_article(parsed)
    for p, k, a, z in spans:
        text, region = parsed[p][k]
        if region == "c" or (marked[p] and region != "b"):
            removed[p] += int(gone[a:z].sum())
        elif marked[p] or not gone[a:z].any():
            texts[p].append(text)
        else:
            cover = whole_runs(gone[a:z])
            rest = [w for w, g in zip(text.split(" "), cover) if not g]
            removed[p] += int(cover.sum())
            if rest:
                texts[p].append(" ".join(rest))
    out = pages[[c for c in pages.columns if c not in ("blocks", "host", "slot", "place", "part")]].copy()
    out["text"] = [" ".join(t) for t in texts]
    out["n_repeated_words"] = removed
    return out


def grouped(batches: Iterator[pd.DataFrame], size: int = GROUP) -> Iterator[pd.DataFrame]:
    """Sorted pages in groups of some `size`, every (host, slot) whole; what stands in a group beside it changes nothing."""
    held: list[pd.DataFrame] = []
    n, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(batch["host"], batch["slot"]))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and keys[start] != last and n >= size // 4:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
            held.append(batch.iloc[start:stop])
            n, last = n + stop - start, keys[start]
    if held:
        yield pd.concat(held, ignore_index=True)


def main_texts(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(id_cols..., text, n_repeated_words) for every row of pages.

    A host's pages meet in one slot; a host that weighs more than `group` pages (a page counts once for every 8,192
    characters begun) is dealt to as many slots of about that weight by a hash of its pages.  A task concatenates the
    word streams of a slot's pages, builds their suffix array and marks runs of RUN words or more that stand on PAGES distinct
    pages.  For hosts of several slots runs are counted over all of them besides: a slot asks for the runs that would
    go, all slots tell which of their pages hold one, and what stands on PAGES distinct pages of the host is
    told to the slots that asked.  So the result depends neither on slots nor on partitions or the order of rows.  Of a page
    without a marked article, marked runs are removed and the unique runs stay.  Of a page with one (article or
    main element, or the like) the article stays whole: articles quote and copy each other, so a repeat there
    is no boilerplate.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by
    their markup on all pages, inline elements included; inside an article only by names that say nothing else.
    n_repeated_words counts the removed words that were on repeated runs.

    Null or empty html, or nothing left: empty text.  Null url: one host.  Repeated rows, null ids: rows
    like any other; equal pages count as one for the runs.  Cut-off markup: read as far as it goes.  Empty
    table: no rows.  Only the named columns are read; they may have any names.
    """
    rows, names = plain(pages.select(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate((*id_cols, url_col, html_col))]), *[f"k{k}" for k in range(len(id_cols) + 2)])
    *ids, url, html = names
    # no host function is needed: what stands between the scheme and the next slash
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    weight = F.floor(F.coalesce(F.char_length(html), F.lit(0)) / 8192) + 1
    rows = rows.select(*ids, host.alias("host"), F.xxhash64(html, *ids).alias("place"), F.col(html).alias("html"), weight.alias("weight"))
    # hosts beyond one slot: few, as each weighs more than `group` pages
    large = rows.groupBy("host").agg(F.ceil(F.sum("weight") / group).alias("slots")).where("slots > 1")
    large = small_side(keep(large))
    n = max(2, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in ids)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="html").assign(blocks=[packed(h) for h in batch["html"]])

    def parsed(some: DataFrame) -> DataFrame:
        return some.select(*ids, "host", "slot", "place", "html").mapInPandas(parse, f"{fields}host string, slot long, place long, blocks binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(batches, group):
            yield extract_group(part)

    answer = f"{fields}text string, n_repeated_words bigint"
    rows = rows.drop("weight")
    whole = parsed(rows.join(large, "host", "left_anti").withColumn("slot", F.lit(0).cast("long")))
    texts = whole.repartition(n, "host", "slot").sortWithinPartitions("host", "slot", "place").mapInPandas(run, answer)
    if not large.isEmpty():
        parts = keep(parsed(rows.join(large, "host").withColumn("slot", F.pmod("place", F.col("slots")).cast("long"))))
        parts = parts.withColumn("part", F.xxhash64("host", "slot"))
        asked = keep(parts.select("host", "part", "blocks").mapInPandas(asked_runs, "part long, high long, low long"))
        bits = pages.sparkSession.sparkContext.broadcast(bit_map(asked, F.pmod("low", F.lit(BITS)), BITS))
        held = parts.select("host", "blocks").mapInPandas(lambda batches: held_runs(batches, bits.value), "high long, low long, content long")
        many = held.repartition("high", "low").distinct().groupBy("high", "low").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
        many = small_side(keep(many.select("high", "low")))
        told = asked.join(many, ["high", "low"], "left_semi").distinct()
        texts = texts.unionByName(parts.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(extract_group, answer))
    return texts.select(*[F.col(c).alias(o) for c, o in zip(ids, id_cols)], "text", "n_repeated_words")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    t = main_texts(table(spark, sf_dir, "pages"))
    return t.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated_words")
