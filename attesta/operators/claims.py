"""Claims: flattening vendor documents, citing captures, finding quotes."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.functions import text as T, windows as V
from attesta.operators.components import settle

SINGLES = ["pricing_source", "tagline_source", "founded_source", "headquarters_source", "team_size_source"]
# fields whose quote must occur verbatim on the cited page
QUOTED_FIELDS = ["strengths", "gtm_evidence", "moat_evidence", "differentiators", "tech_signals",
                 "feature_catalog", "product_momentum", "pricing_vote_detail"]
# fields that need a proper page behind them; user feedback only warns
ANCHORED_FIELDS = ["strengths", "weaknesses", "differentiators", "tech_signals", "feature_catalog",
                   "feature_conclusion_points", "user_feedback"]


def claim_rows(vendors: DataFrame) -> Column:
    """Every evidence field of a nested vendor document as one array: field, idx, source_url, quote, statement."""
    blank = F.lit("")
    nz = lambda c: F.coalesce(c, blank)

    def claim(field: str, idx: Column, url: Column, quote: Column = blank, statement: Column = blank) -> Column:
        return F.struct(F.lit(field).alias("field"), idx.cast("int").alias("idx"),
                        F.trim(nz(url)).alias("source_url"), nz(quote).alias("quote"), nz(statement).alias("statement"))

    def each(field: str, url, quote=lambda x: blank, statement=lambda x: blank) -> Column:
        return F.transform(F.coalesce(F.col(field), F.array().cast(vendors.schema[field].dataType)),
                           lambda x, i: claim(field, i, url(x), quote(x), statement(x)))

    point_text = lambda x: F.concat_ws(" ", F.nullif(x["point"], blank), F.nullif(x["evidence"], blank))
    singles = F.array(*[claim(k, F.lit(0), F.col(k)) for k in SINGLES])
    votes = F.when(F.coalesce(F.col("pricing_from_cache"), F.lit(False)), F.array().cast(
        "array<struct<field:string,idx:int,source_url:string,quote:string,statement:string>>")).otherwise(
        each("pricing_vote_detail", lambda x: F.col("pricing_source"), lambda x: F.coalesce(x["raw_line"], x["line"])))
    parts = [
        singles,
        each("pricing_tiers", lambda x: x["source_url"]),
        each("strengths", lambda x: x["source"], lambda x: T.unwrap_quote(x["evidence"]), point_text),
        each("weaknesses", lambda x: x["source"], statement=point_text),
        each("feature_conclusion_points", lambda x: x["source"], statement=lambda x: x["text"]),
        each("gtm_evidence", lambda x: x["source"], lambda x: x["quote"], lambda x: x["name"]),
        each("moat_evidence", lambda x: x["source"], lambda x: x["quote"], lambda x: x["name"]),
        each("tech_signals", lambda x: x["source"], lambda x: x["quote"], lambda x: x["quote"]),
        each("differentiators", lambda x: x["source_url"], lambda x: x["quote"], lambda x: x["quote"]),
        each("user_feedback", lambda x: x["source"], statement=lambda x: x["quote"]),
        each("feature_catalog", lambda x: x["source"], lambda x: x["quote"],
             lambda x: F.coalesce(F.nullif(x["quote"], blank), x["text_orig"])),
        each("product_momentum", lambda x: x["source"], lambda x: x["title"], lambda x: x["title"]),
        votes]
    return F.concat(*parts)


def flatten_claims(vendors: DataFrame) -> DataFrame:
    """Long table of every evidence field of nested vendor documents.

    vendor, vendor_url, field, idx, source_url ('' when none), quote (to be found verbatim, '' when
    none), statement (what the claim says).  One pass: an array of claim structs per document.
    """
    return vendors.select(F.col("name").alias("vendor"), F.col("url").alias("vendor_url"), F.inline(claim_rows(vendors))).where(
        (F.col("source_url") != "") | (F.col("quote") != ""))


def asserts_source(source_url: Column, field: Column) -> Column:
    return (source_url != "") & (field != "pricing_vote_detail")


def cited(claims: DataFrame) -> DataFrame:
    """Claims that assert a source; vote lines are evidence of a price, not claims."""
    return claims.where(asserts_source(F.col("source_url"), F.col("field")))


def evidence_urls(claims: DataFrame, order: list[str]) -> DataFrame:
    """Distinct cited URLs of each vendor with the position of their first citation."""
    return cited(claims).groupBy("vendor", "source_url").agg(F.min(F.struct(*order)).alias("first"))


QUOTES_AT_ONCE = 256          # quotes of a page that meet one of its texts in one row


def find_quotes(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds `found`: the quote occurs verbatim in some capture of the cited url, a blank quote anywhere.

    Every (url, quote) is asked once.  The quotes of a page are dealt to lists of about QUOTES_AT_ONCE; a text moves
    once, as it is, and meets a list in one row: its plain normal form is searched first, the form without
    links only for what that does not hold.  Only answers go back to the claims, under hashes of the quotes.
    """
    norm = T.norm_ws(F.col("quote"))
    # asked for, counted and answered: three uses of what may be a long way from its source; the quote is kept in one form
    q = settle(claims.withColumn("__q", norm).withColumns({"__h1": F.xxhash64(F.lit(1), "__q"), "__h2": F.xxhash64(F.lit(2), "__q"), "__blank": F.col("__q") == ""}).drop("__q"))
    asked = q.where(~F.col("__blank") & (F.col("source_url") != "")).select("source_url", "__h1", "__h2", "quote")
    many = asked.select("source_url", "__h1", "__h2").distinct().groupBy("source_url").agg(F.ceil(F.count("*") / QUOTES_AT_ONCE).alias("__lists"))
    # counted by hashes; dealt out by url, the quotes move once for the join and the lists
    listed = asked.join(many.hint("merge"), "source_url").withColumn("__list", F.pmod("__h1", "__lists"))
    lists = (listed.groupBy("source_url", "__list", "__h1", "__h2").agg(F.first(norm).alias("__q")).groupBy("source_url", "__list")
             .agg(F.collect_list(F.struct("__h1", "__h2", "__q")).alias("__asked")))
    texts = captures.where(F.coalesce(F.col("text"), F.lit("")) != "").select(F.col("url").alias("source_url"), "text")

    def marked(form: Column, asked: Column) -> Column:
        return V.bound(form, lambda f: F.transform(asked, lambda a: F.struct(a["__h1"].alias("__h1"), a["__h2"].alias("__h2"), a["__q"].alias("__q"), F.contains(f, a["__q"]).alias("hit"))))

    def hits(marks: Column) -> Column:
        return F.filter(marks, lambda a: a["hit"])

    def search(asked: Column) -> Column:
        return V.bound(marked(T.norm_ws(F.col("text")), asked), lambda m: F.when(F.forall(m, lambda a: a["hit"]), m).otherwise(F.concat(
            hits(m), hits(marked(T.norm_stripped(F.col("text")), F.filter(m, lambda a: ~a["hit"]))))))

    answers = (lists.join(texts, "source_url").select("source_url", F.inline(F.transform(search(F.col("__asked")), lambda a: F.struct(a["__h1"].alias("__h1"), a["__h2"].alias("__h2")))))
               .toDF("source_url", "__h1", "__h2").distinct().withColumn("__hit", F.lit(True)))
    joined = q.join(answers, ["source_url", "__h1", "__h2"], "left")
    return joined.withColumn("found", F.col("__blank") | F.coalesce("__hit", F.lit(False))).drop("__hit", "__blank", "__h1", "__h2")


# ------------------------------------------------------------------ quotes without a url
WINDOWS = (2, 4, 6)           # words of the windows that quotes are met by
EDGE = 3                      # characters of a word that a quote may cut
ONE, TWO, THREE = 11, 12, 13  # kinds of keys of quotes of one to three words; others: the words of their window
BIT_ROWS = 1 << 15            # the bitmap of keys holds this many times 64 bits, whatever the number of quotes


def _window(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _quote_key(w: Column) -> Column:
    """struct(m, kind, off, key) of a quote's words: their number, and the kind, first word and value of its key.

    The first and last word of a quote may be cut inside a word of the text, the inner words may not.  A quote of four
    words or more is met by a window of its inner words, the longest in characters; shorter ones by what a
    word of the text must end and begin with.
    """
    m = F.size(w)
    word = lambda k: F.get(w, F.lit(k))
    head = lambda c: F.substring(c, 1, EDGE)
    tail = lambda c: F.when(F.length(c) > EDGE, F.substring(c, -EDGE, EDGE)).otherwise(c)

    def told(kind: int, off: Column, key: Column) -> Column:
        return F.struct(m.alias("m"), F.lit(kind).alias("kind"), off.cast("int").alias("off"), key.alias("key"))

    def by_window(n: int) -> Column:
        places = F.transform(F.sequence(F.lit(1), m - 1 - n), lambda i: F.struct(F.length(F.array_join(F.slice(w, i + 1, F.lit(n)), "")).alias("long"), (-i).alias("at")))
        return V.bound(-F.array_max(places)["at"], lambda off: told(n, off, _window(F.transform(w, lambda x: F.xxhash64(x)), off, n)))

    out = (F.when(m == 1, told(ONE, F.lit(0), F.xxhash64(F.lit(ONE), head(word(0)))))
           .when(m == 2, told(TWO, F.lit(0), F.xxhash64(F.lit(TWO), tail(word(0)), head(word(1)))))
           .when(m == 3, told(THREE, F.lit(0), F.xxhash64(F.lit(THREE), tail(word(0)), word(1), head(word(2))))))
    for n in reversed(WINDOWS):
        out = out.when(m >= n + 2, by_window(n))
    return out


def _text_keys(words: Column, hashes: Column, kinds: Column, known) -> Column:
    """(at, key) of every place of a text where a key that is asked for may stand; kinds nobody asks for are not computed."""
    none = F.array().cast("array<struct<at: int, key: bigint>>")
    size = F.size(words)
    word = lambda i: F.get(words, i)
    edges = F.array(*[F.lit(k) for k in range(1, EDGE + 1)])
    ends = lambda c: F.transform(edges, lambda k: F.substring(c, -k, k))
    starts = lambda c: F.transform(edges, lambda k: F.substring(c, F.lit(1), k))

    def each(kind: int, n: int, keys) -> Column:
        at = F.sequence(F.lit(0), size - n)
        found = F.transform(at, lambda i: F.transform(F.filter(keys(i), known), lambda h: F.struct(i.alias("at"), h.alias("key"))))
        return F.when((F.getbit(kinds, F.lit(kind)) == 1) & (size >= n), F.flatten(found)).otherwise(none)

    def two(i: Column) -> Column:
        return F.flatten(F.transform(ends(word(i)), lambda a: F.transform(starts(word(i + 1)), lambda b: F.xxhash64(F.lit(TWO), a, b))))

    def three(i: Column) -> Column:
        return F.flatten(F.transform(ends(word(i)), lambda a: F.transform(starts(word(i + 2)), lambda b: F.xxhash64(F.lit(THREE), a, word(i + 1), b))))

    def one(i: Column) -> Column:
        inside = F.sequence(F.lit(1), F.greatest(F.length(word(i)), F.lit(1)))
        return F.flatten(F.transform(inside, lambda p: F.transform(edges, lambda k: F.xxhash64(F.lit(ONE), F.substring(word(i), p, k)))))

    parts = [each(n, n, lambda i, n=n: F.array(_window(hashes, i, n))) for n in WINDOWS]
    edged = [each(kind, n, lambda i, keys=keys: F.array_distinct(keys(i))) for kind, n, keys in ((TWO, 2, two), (THREE, 3, three), (ONE, 1, one))]
    return F.concat(*parts, *edged)


def _bit_row(h: Column, bit_rows: int) -> Column:
    return F.shiftrightunsigned(h, 6) % bit_rows


def _bitmap(spark: SparkSession, keyed: DataFrame, bit_rows: int) -> Column:
    """One value of bit_rows times 64 bits, a bit for each `key`."""
    bits = keyed.groupBy(_bit_row(F.col("key"), bit_rows).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b"))
    whole = F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return spark.range(bit_rows).join(bits, "id", "left").agg(F.transform(whole, lambda x: x["b"]).alias("bitmap")).scalar()


def find_passages(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Every (item_id, doc_id) whose text holds the quote, both white-space normalised.

    quotes(item_id, quote), docs(doc_id, text).  Equal quotes are searched once.  Every quote has one key; a
    bitmap of all keys, of a fixed size, comes to the texts where they lie.  Only places of a text whose key is in
    the bitmap become rows, with the words around them, so the check is done there and no text is moved.
    """
    norm = quotes.select("item_id", T.norm_ws(F.col("quote")).alias("q")).where(F.col("q") != "")
    asked = norm.select("q").distinct().select("q", V.bound(F.split("q", " "), _quote_key).alias("k")).select("q", "k.*")
    spark = docs.sparkSession
    row = lambda h: _bit_row(h, BIT_ROWS)
    bitmap = _bitmap(spark, asked, BIT_ROWS)
    kinds = asked.agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, kind)")), F.lit(0).cast("long"))).scalar()
    most = asked.agg(F.coalesce(F.max("m"), F.lit(0))).scalar()
    words = docs.select("doc_id", F.split(T.norm_ws(F.col("text")), " ").alias("words"))
    # each of these is named once below, so the bitmap stays in the plan and is copied into no row
    texts = words.withColumns({"bitmap": bitmap, "kinds": kinds, "most": most})

    def near(e: Column) -> Column:
        known = lambda h: F.getbit(F.get(e["bitmap"], row(h).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.transform(_text_keys(F.col("words"), e["hashes"], e["kinds"], known), lambda p: V.bound(
            F.greatest(p["at"] - e["most"], F.lit(0)), lambda s: F.struct(
                p["at"].alias("at"), p["key"].alias("key"), s.alias("first"), F.slice("words", s + 1, p["at"] - s + e["most"] + 1).alias("near"))))

    told = F.struct("bitmap", "kinds", "most", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # outer: else a filter on the list's size would compute it a second time
    places = texts.select("doc_id", V.bound(told, near).alias("places")).select("doc_id", F.inline_outer("places")).where(F.col("key").isNotNull())
    start = F.col("at") - F.col("off") - F.col("first")
    there = F.array_join(F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("m")), " ")
    hit = places.join(asked, "key").where((start >= 0) & F.contains(there, F.col("q")))
    return norm.join(hit.select("q", "doc_id").distinct(), "q").select("item_id", "doc_id").distinct()


PHRASE_BITS = 1 << 18         # as BIT_ROWS, for phrases by the hundred thousand (2 MB)
PHRASE_WORDS = (1, 2, *WINDOWS[1:])  # inner words a phrase of that many and two more is met by


def find_phrases(phrases: DataFrame, docs: DataFrame, scope: str | None = None) -> DataFrame:
    """As find_passages, for very many phrases of some words, such as headings: (item_id, doc_id) of every text that holds one.

    phrases(item_id, quote), docs(doc_id, text); with a scope, a column of both, only texts of a phrase's own scope are asked.
    A phrase of three words or more is met by its longest window of inner words, as wide as it can be of PHRASE_WORDS; words of
    a text are rows only until the bitmap of all keys has been asked, and what is left takes the words around it along.  A
    phrase of one or two words may be cut at both ends: it is met by every word of the texts that holds its longer word.  Keys
    hold the scope, so a place that only another scope asks for is no row.
    """
    of = (lambda c: F.col(scope).alias(c)) if scope else (lambda c: F.lit(0).alias(c))
    norm = phrases.select("item_id", T.norm_ws(F.col("quote")).alias("q"), of("scope")).where(F.col("q") != "")
    w, m = F.col("w"), F.size("w")
    word = lambda i: F.get(w, i)
    # read for the keys and for what is left
    split = settle(norm.select("q", "scope").distinct().withColumn("w", F.split("q", " ")))

    def window(n: int) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.greatest(m - 1 - n, F.lit(1))), lambda i: F.struct(F.length(F.array_join(F.slice(w, i + 1, F.lit(n)), "")).alias("long"), (-i).alias("at")))
        return V.bound((-F.array_max(places)["at"]).cast("int"), lambda off: F.struct(off.alias("off"), F.xxhash64("scope", F.lit(n), *[word(off + k) for k in range(n)]).alias("key")))

    by_width = None
    for n in reversed(PHRASE_WORDS):
        by_width = F.when(m >= n + 2, window(n)) if by_width is None else by_width.when(m >= n + 2, window(n))
    asked = split.where(m >= 3).select("q", "scope", m.alias("m"), by_width.alias("k")).select("q", "scope", "m", "k.off", "k.key")
    words = docs.select("doc_id", of("scope"), F.split(T.norm_ws(F.col("text")), " ").alias("words"))
    few = split.where(m < 3).select("q", "scope", m.alias("m"), F.when((m == 2) & (F.length(word(1)) > F.length(word(0))), F.lit(1)).otherwise(F.lit(0)).alias("off"),
                                    "w").withColumn("part", word(F.col("off"))).drop("w")
    if not few.isEmpty():
        vocabulary = words.select(F.explode("words").alias("word")).distinct()
        held = find_passages(few.select(F.col("part").alias("item_id"), F.col("part").alias("quote")).distinct(),
                             vocabulary.select(F.col("word").alias("doc_id"), F.col("word").alias("text")))
        asked = asked.unionByName(few.join(held, few["part"] == held["item_id"]).select("q", "scope", "m", "off", F.xxhash64("scope", F.when(F.col("m") == 1, 0).otherwise(1), "doc_id").alias("key")))
    # read for the bitmap, for the longest phrase and for the answers
    asked = settle(asked)
    bitmap = _bitmap(docs.sparkSession, asked, PHRASE_BITS)
    known = lambda h: F.getbit(F.get(bitmap, _bit_row(h, PHRASE_BITS).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    most = asked.agg(F.coalesce(F.max("m"), F.lit(0))).scalar()
    each = words.select("doc_id", "scope", "words", F.posexplode("words").alias("at", "word"))
    next_ = lambda k: F.get("words", F.col("at") + k)
    names = {n: f"k{n}" for n in (0, *PHRASE_WORDS)}  # 0: a phrase of one word, which is there if the word is
    keys = each.select("doc_id", "words", "at", *[F.xxhash64("scope", F.lit(n), "word", *[next_(k) for k in range(1, n)]).alias(c) for n, c in names.items()])
    held = keys.where(reduce(or_, [known(F.col(c)) for c in names.values()]))
    met = held.select("doc_id", "words", "at", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("key")) for n, c in names.items()]))).where(known(F.col("key")))
    # phrases met by n words have fewer than three more, the widest apart
    far = F.when(F.col("n") == 0, 0).when(F.col("n") == PHRASE_WORDS[-1], most).otherwise(F.col("n") + 3)
    first = F.greatest(F.col("at") - F.col("far"), F.lit(0))
    places = met.withColumn("far", far).select("doc_id", "key", F.least("at", "far").alias("at"), F.slice("words", first + 1, F.col("at") - first + F.col("far") + 1).alias("near"))
    start = F.col("at") - F.col("off")
    there = F.array_join(F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("m")), " ")
    hit = places.join(asked, "key").where((start >= 0) & F.contains(there, F.col("q"))).select("q", "scope", "doc_id").distinct()
    return norm.join(hit, ["q", "scope"]).select("item_id", "doc_id").distinct()
