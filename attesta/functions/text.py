"""Text expressions: normal forms, hashes, quality, cleaning, word stems."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from attesta import constants as K

WS_RUN = K.WS + "+"
NOT_WS = "[^" + K.WS[1:]
# runs that are not one plain space: far fewer replacements than touching every gap
WS_UNEVEN = f" *{K.WS_NOT_SPACE}{K.WS}*| {{2,}}"


def norm_ws(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS_UNEVEN, " "))


def strip_links(c: Column) -> Column:
    """Markdown images and links reduced to their label."""
    return F.regexp_replace(F.regexp_replace(c, K.MD_IMAGE, "$1"), K.MD_LINK, "$1")


def norm_stripped(c: Column) -> Column:
    return norm_ws(strip_links(F.coalesce(c, F.lit(""))))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(norm_ws(c), 256), 1, 16)


def url_tag(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


def stripped_length(c: Column) -> Column:
    return F.length(F.btrim(c, F.lit(K.WS_CHARS)))


def body_sufficient(c: Column, min_chars: int = 200) -> Column:
    """Enough visible text, not a script shell."""
    low = F.lower(F.coalesce(c, F.lit("")))
    shell = (F.regexp_count(low, F.lit("<script")) > 5) | F.contains(low, F.lit("enable javascript"))
    return (stripped_length(F.coalesce(c, F.lit(""))) >= min_chars) & ~shell


def _visible_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x.rlike(NOT_WS))


def _total_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def quality_score(c: Column) -> Column:
    """0..1: little code, few link characters, some structure, some length."""
    c = F.coalesce(c, F.lit(""))
    lines = _visible_lines(c)
    n = F.nullif(F.length(c), F.lit(0)).cast("double")
    junk = F.least(_total_length(F.filter(lines, lambda x: x.rlike(K.CODE_JUNK))) / n, F.lit(1.0))
    headed = F.size(F.filter(lines, lambda x: x.rlike(f"^{K.WS}*(#|- |\\* )"))) / F.nullif(F.size(lines), F.lit(0))
    links = (n - F.length(F.regexp_replace(c, K.MD_LINK_ANY_LABEL, ""))) / n
    size = F.least(F.log10(F.greatest(n, F.lit(10.0))) / 5, F.lit(1.0))
    base = F.greatest(F.lit(0.0), 1 - junk * 1.5) * 0.5 + headed * 0.3 + size * 0.2
    score = base * F.greatest(F.lit(0.05), 1 - links * 1.2)
    return F.when(c.rlike(NOT_WS), score).otherwise(F.lit(0.0))


def keep_ends(c: Column, max_chars: int = 50_000, tail_chars: int = 10_000) -> Column:
    """Texts over the limit keep their head and tail with a mark between."""
    cut = F.concat(
        F.substring(c, 1, max_chars - tail_chars),
        F.lit(K.CUT_MIDDLE),
        F.substring(c, -tail_chars, tail_chars),
    )
    return F.when(F.length(c) > max_chars, cut).otherwise(c)


def age_days(c: Column, as_of: Column) -> Column:
    """Age of a 'YYYY-MM-DD HH:MM UTC' text in days; null when it cannot be read.

    Callers treat null as infinitely old.
    """
    ts = F.try_to_timestamp(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}) UTC$", 1),
                            F.lit("yyyy-MM-dd HH:mm"))
    return (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400.0


def clean_lines(c: Column, least: int = 0) -> Column:
    """Array of readable lines: front matter, images and link targets gone.

    Cleaning never makes a line longer, so lines under `least` characters may go first.
    """
    raw = F.split(F.coalesce(c, F.lit("")), "\n")
    flat = F.transform(F.filter(raw, lambda x: F.length(x) >= least) if least else raw, norm_ws)
    kept = F.filter(flat, lambda x: (x != "") & ~x.rlike(K.FRONT_MATTER))
    plain = F.transform(kept, lambda x: F.regexp_replace(
        F.regexp_replace(x, r"!\[[^\]]*\]\([^)]+\)", ""), K.MD_LINK, "$1"))
    bare = F.transform(plain, lambda x: F.trim(F.regexp_replace(x, "^[#> ]+", "")))
    return F.filter(bare, lambda x: x != "")


def drop_code_lines(c: Column) -> Column:
    """Text without script payload lines and style lines."""
    kept = F.filter(F.split(c, "\n"),
                    lambda x: ~x.rlike(K.SCRIPT_LINE) & ~x.rlike(K.STYLE_LINE))
    return F.array_join(kept, "\n")


def is_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin(K.MISSING_MARKS)


def is_fabricated(c: Column) -> Column:
    return F.coalesce(c.rlike(K.FABRICATED), F.lit(False))


def leaks_repr(c: Column) -> Column:
    return F.coalesce(c.rlike(K.REPR_LEAK), F.lit(False))


def unwrap_quote(c: Column) -> Column:
    """The quoted body of a wrapped evidence text, '' when it is not wrapped."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), K.WRAPPED_QUOTE, 1)


def is_placeholder(point: Column, evidence: Column, score: Column) -> Column:
    text = norm_ws(point)
    prefixed = F.lit(False)
    for p in K.PLACEHOLDER_PREFIXES:
        prefixed = prefixed | text.startswith(p)
    unproven = (F.coalesce(score.cast("double"), F.lit(0.0)) == 0) & (
        F.coalesce(evidence, F.lit("")) == "")
    return (text == "") | prefixed | unproven


def plain_from_html(c: Column) -> Column:
    """Tags become spaces, the common entities their characters."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&#x27;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                         ("&middot;", "·"), ("&amp;", "&")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# ---------------------------------------------------------------- feature names
def clean_feature_name(c: Column) -> Column:
    no_links = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\[([^\]]*)\]\(https?://[^)]*\)", "$1")
    return norm_ws(F.regexp_replace(no_links, r"[*_`]+", ""))


def is_junk_name(s: Column) -> Column:
    """Marketing lines, banners, menu words, foreign fragments and sentences are not features.

    Expects a name already cleaned.
    """
    nav = F.lower(s).rlike("^(" + "|".join(K.NAME_NAV_WORDS) + ")( |$)")
    accents = F.regexp_count(s, F.lit(K.ACCENTED))
    return ((F.length(s) < 2) | s.rlike(K.NAME_MARKETING) | s.rlike(K.NAME_BANNER) | nav
            | (accents > F.length(s) * 0.22) | s.rlike(r"[.!?]$|\. "))


def is_junk_feature(c: Column) -> Column:
    return is_junk_name(clean_feature_name(c))


def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII letter once marks are dropped."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp))
                       if not unicodedata.combining(ch)).lower()
        if len(base) == 1 and base.isascii() and base.isalpha():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()
_MARKS = r"\p{M}+"


def fold_accents(c: Column) -> Column:
    """Lower-case text with accents removed."""
    folded = F.regexp_replace(F.lower(F.translate(c, _ACCENT_SRC, _ACCENT_DST)), _MARKS, "")
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(folded)


def _stems(words: Column) -> Column:
    """The stem of every word, by plain string functions; a pass for each ending, so a word is named, not repeated."""
    def without(words: Column, ending: str, least: int) -> Column:
        return F.transform(words, lambda w: F.when(w.endswith(ending) & (F.length(w) >= least + len(ending)), F.substring(
            w, F.lit(1), F.length(w) - len(ending))).otherwise(w))

    for suffix in K.STEM_SUFFIXES:
        words = without(words, suffix, 3)
    words = F.transform(words, lambda w: F.coalesce(F.nullif(F.rtrim(w, F.lit("oae")), F.lit("")), w))
    return without(words, "s", 4)


def stem_signature(c: Column) -> Column:
    """Distinct word stems of a name, for matching translated or inflected variants."""
    words = F.regexp_extract_all(fold_accents(c), F.lit("([a-z]{3,})"), 1)
    stop = F.array(*[F.lit(w) for w in K.STEM_STOP])
    return F.array_sort(F.array_except(_stems(F.array_except(words, stop)), stop))


def name_tokens(c: Column, min_len: int = 4) -> Column:
    """Distinct lower-case word tokens (Latin letters, digits, CJK) of at least min_len."""
    parts = F.split(F.lower(c), r"[^a-z0-9一-鿿]+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= min_len))


def classify_angle(c: Column) -> Column:
    """The angle with most keyword hits; first listed wins ties; first angle without hits."""
    text = F.coalesce(c, F.lit(""))
    hits = []
    for i, (angle, words) in enumerate(K.ANGLES):
        n = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        hits.append(F.struct(n.alias("n"), F.lit(-i).alias("p"), F.lit(angle).alias("angle")))
    return F.array_max(F.array(*hits))["angle"]


def feature_label(c: Column) -> Column:
    """Dictionary label of an English feature name; '' for CJK names and misses."""
    low = F.lower(F.coalesce(c, F.lit("")))
    order = sorted(K.FEATURE_LABELS, key=lambda kv: -len(kv[0].split()))
    out = F.when(low.rlike(r"[一-鿿]"), F.lit(""))
    for key, label in order:
        if " " in key or "-" in key:
            hit = F.contains(low, F.lit(key))
        else:
            hit = low.rlike(rf"(?U)\b{key}s?\b")
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(""))
