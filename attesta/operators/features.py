"""Features: canonical names, who holds what, exclusives, gaps and capability tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta import constants as K
from attesta.functions import text as T
from attesta.operators.components import connected, settle
from attesta.operators.spread import dense_index

CJK = r"[一-鿿]"


# ------------------------------------------------------------------ alias tables
def default_aliases(spark: SparkSession, families=None) -> DataFrame:
    """canonical, alias, phrase (bool), ord: the default layer or another list of families."""
    rows, n = [], 0
    for canonical, exact, phrases in families or K.DEFAULT_ALIASES:
        for alias, phrase in [(canonical, False)] + [(a, False) for a in exact] + [(p, True) for p in phrases]:
            rows.append((canonical, alias, phrase, n))
            n += 1
    return spark.createDataFrame(rows, "canonical string, alias string, phrase boolean, ord int")


def layer_aliases(default: DataFrame, auto: DataFrame, user: DataFrame) -> DataFrame:
    """Three alias layers in one table (canonical, alias, layer): user over automatic over default.

    An automatic group whose own name is already an alias of another default group is left out.
    The same alias of a canonical name is kept once, from the highest layer.
    """
    key = F.lower(F.trim("alias"))
    taken = default.select(F.lower(F.trim("alias")).alias("k"), F.col("canonical").alias("owner"))
    kept_auto = auto.join(taken, (F.lower(F.trim(auto["canonical"])) == taken["k"]) & (auto["canonical"] != taken["owner"]), "left_anti")
    both = (default.select("canonical", "alias", F.lit(0).alias("rank"), F.lit("default").alias("layer"))
            .unionByName(kept_auto.select("canonical", "alias", F.lit(1).alias("rank"), F.lit("auto").alias("layer")))
            .unionByName(user.select("canonical", "alias", F.lit(2).alias("rank"), F.lit("user").alias("layer"))))
    return (both.withColumn("key", key).groupBy("canonical", "key")
            .agg(F.max_by("alias", F.struct("rank", "alias")).alias("alias"), F.max_by("layer", "rank").alias("layer")))


def phrase_hits(names: DataFrame, phrases: DataFrame, plural: str = "s?") -> DataFrame:
    """(name, pid, pos, size) for every phrase found in a lower-case name on word edges.

    names(name), phrases(pid, key); a key that ends with * matches as a word prefix, a key with CJK
    characters anywhere.  Names and phrases meet on the phrase's first word (or its start, or its
    first two CJK characters), so phrases are not tried on every name.
    """
    star = F.col("key").endswith("*")
    body = F.when(star, F.expr("substring(key, 1, length(key) - 1)")).otherwise(F.col("key"))
    word = F.regexp_extract("body", "([a-z0-9]+)", 1)
    single = F.col("body").rlike("^[a-z0-9]+$")
    ph = phrases.where(F.col("key") != "").select("pid", "key", star.alias("star"), body.alias("body")).select(
        "pid", "body", "star", F.col("body").rlike(CJK).alias("cjk"),
        F.when(F.col("body").rlike(CJK), F.concat(F.lit("#"), F.substring("body", 1, 2)))
        .when(F.col("star") & single, F.concat(F.lit("^"), F.substring(word, 1, 3))).otherwise(word).alias("meet"))
    toks = F.regexp_extract_all("name", F.lit("([a-z0-9]+)"), 1)
    meets = F.concat(
        toks, F.transform(toks, lambda t: F.regexp_replace(t, "s$", "")), F.transform(toks, lambda t: F.regexp_replace(t, "es$", "")),
        F.flatten(F.transform(toks, lambda t: F.array(*[F.concat(F.lit("^"), F.substring(t, 1, k)) for k in (1, 2, 3)]))),
        F.when(F.col("name").rlike(CJK), F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))),
            lambda i: F.concat(F.lit("#"), F.col("name").substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>")))
    cand = (names.select("name", F.explode(F.array_distinct(meets)).alias("meet")).join(ph, "meet")
            .dropDuplicates(["name", "pid"]))
    quoted = F.concat(F.lit("(?<![a-z0-9])\\Q"), F.col("body"), F.lit("\\E"))
    rx = F.concat(quoted, F.when(F.col("star"), F.lit("[a-z]*")).otherwise(F.lit(f"{plural}(?![a-z0-9])")))
    pos = F.when(F.col("cjk"), F.instr("name", F.col("body"))).otherwise(F.regexp_instr("name", rx))
    found = F.when(F.col("cjk"), F.contains("name", "body")).otherwise(F.regexp_like("name", rx))
    return cand.where(found).select("name", "pid", pos.cast("int").alias("pos"), F.length("body").alias("size"))


def canonical_names(names: DataFrame, aliases: DataFrame, auto: DataFrame | None = None, fuzzy: bool = False,
                    stops: DataFrame | None = None) -> DataFrame:
    """(name, canonical): curated alias, then phrase family, then automatic alias, then itself.

    names(name) need not be distinct.  With `fuzzy`, names still unresolved may join the first
    curated alias with similar word stems.
    """
    base = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    exact = (aliases.where(~F.col("phrase")).groupBy(F.lower(F.trim("alias")).alias("key"))
             .agg(F.max_by("canonical", "ord").alias("by_alias")))
    phrases = (aliases.where("phrase").groupBy(F.lower(F.trim("alias")).alias("key"))
               .agg(F.min_by("canonical", "ord").alias("pid")))
    keys = base.select(F.col("key").alias("name")).distinct()
    best = (phrase_hits(keys, phrases.select("pid", "key"))
            .groupBy("name").agg(F.min(F.struct(F.col("pos"), (-F.col("size")).alias("size"), F.col("pid"))).alias("b"))
            .select(F.col("name").alias("key"), F.col("b.pid").alias("by_phrase")))
    out = base.join(exact, "key", "left").join(best, "key", "left")
    if auto is not None:
        a = auto.groupBy(F.lower(F.trim("alias")).alias("key")).agg(F.min("canonical").alias("by_auto"))
        out = out.join(a, "key", "left")
    else:
        out = out.withColumn("by_auto", F.lit(None).cast("string"))
    out = out.withColumn("hit", F.coalesce("by_alias", "by_phrase", "by_auto"))
    if fuzzy:
        out = out.join(_stem_matches(out.where(F.col("hit").isNull()).select("key").distinct(), aliases, stops), "key", "left")
        out = out.withColumn("hit", F.coalesce("hit", "by_stem"))
    return out.select("name", F.coalesce("hit", "name").alias("canonical"))


def strong_stem(c: Column) -> Column:
    """A stem long and specific enough to decide alone that two names mean the same."""
    return (F.length(c) >= 6) & ~c.isin(K.WEAK_STEMS)


def _stop_array(stops: DataFrame | None):
    """Stop tokens as one array value; there are few, each occurs in a third of all names."""
    return None if stops is None else stops.agg(F.collect_set("token").alias("s")).scalar()


def _minus(c: Column, stop) -> Column:
    return c if stop is None else F.array_except(c, F.coalesce(stop, F.array().cast("array<string>")))


def _stem_matches(keys: DataFrame, aliases: DataFrame, stops: DataFrame | None) -> DataFrame:
    stop = _stop_array(stops)
    keys = settle(keys)  # or the test on the stems is made for every row the keys come from
    n = keys.select("key", _minus(T.stem_signature(F.col("key")), stop).alias("sig")).where(F.size("sig") > 0)
    a = (aliases.where(~F.col("phrase")).select("canonical", "ord", T.stem_signature(F.lower("alias")).alias("full"))
         .withColumn("asig", _minus(F.col("full"), stop)))
    pairs = n.select("key", "sig", F.explode("sig").alias("stem")).join(
        a.select("canonical", "ord", "full", "asig", F.explode("asig").alias("stem")), "stem").dropDuplicates(["key", "ord"])
    inter = F.array_intersect("sig", "asig")
    ok = (F.size(inter) / F.size(F.array_union("sig", "full")) >= 0.5) | F.exists(inter, strong_stem)
    return pairs.where(ok).groupBy("key").agg(F.min_by("canonical", "ord").alias("by_stem"))


def stop_tokens(names: DataFrame) -> DataFrame:
    """Tokens found in more than max(3, 35 %) of all names; they say nothing about one feature."""
    low = F.lower("name")
    toks = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("([a-z]{3,})"), 1),
                                     F.regexp_extract_all(low, F.lit("([一-鿿]{2,})"), 1)))
    rows = names.where(F.coalesce("name", F.lit("")) != "")
    total = rows.agg(F.count("*").alias("n")).scalar()
    return (rows.select(F.explode(toks).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
            .where(F.col("n") > F.greatest(F.lit(3.0), total * 0.35)))


# ------------------------------------------------------------------ translated and inflected variants
def variant_edges(sigs: DataFrame, max_subset: int = 10) -> DataFrame:
    """(a, b) links between names(node, sig) of one meaning.

    Two names belong together when they share a strong stem or half of their joint stems.  Names
    with a common stem, or a common stem set, are linked to one hub each, never pair by pair: for
    a set of s shared stems the shortest name is the hub, because whenever two names pass the
    half test through that set, each passes it with the shortest.
    """
    hub_id = F.min("node")
    strong = sigs.select("node", F.explode(F.filter("sig", strong_stem)).alias("stem"))
    by_stem = strong.join(strong.groupBy("stem").agg(hub_id.alias("hub")), "stem").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    sized = sigs.withColumn("n", F.size("sig"))
    subsets = F.aggregate("sig", F.array(F.array().cast("array<string>")),
                          lambda acc, t: F.concat(acc, F.transform(acc, lambda x: F.concat(x, F.array(t)))))
    sub = (sized.where(F.col("n") <= max_subset)
           .select("node", "n", F.explode(F.filter(subsets, lambda x: (F.size(x) > 0) & (F.size(x) * 2 >= F.col("n")))).alias("set")))
    sub = sub.select("node", "n", F.size("set").alias("s"), F.array_join("set", " ").alias("set"))
    hubs = sub.groupBy("set").agg(F.min(F.struct("n", "node")).alias("hub"))
    by_set = sub.join(hubs, "set").where(F.col("n") + F.col("hub.n") <= F.col("s") * 3).select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"))
    freq = sized.select(F.explode("sig").alias("stem")).groupBy("stem").agg(F.count("*").alias("f"))
    ranked = (sized.select("node", "n", "sig", F.explode("sig").alias("stem")).join(freq, "stem")
              .groupBy("node", "n", "sig").agg(F.array_sort(F.collect_list(F.struct("f", "stem"))).alias("r")))
    prefix = ranked.select("node", "n", "sig", F.explode(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") / 2) + 1).cast("int"))).alias("p"))
    prefix = prefix.select("node", "n", "sig", F.col("p.stem").alias("stem"))
    long_, any_ = prefix.where(F.col("n") > max_subset).alias("x"), prefix.alias("y")
    by_prefix = (long_.join(any_, F.col("x.stem") == F.col("y.stem"))
                 .where((F.size(F.array_intersect("x.sig", "y.sig")) * 2 >= F.size(F.array_union("x.sig", "y.sig"))) & (F.col("x.node") != F.col("y.node")))
                 .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return by_stem.unionByName(by_set).unionByName(by_prefix).where(F.col("a") != F.col("b")).distinct()


def variant_groups(catalog: DataFrame, stops: DataFrame) -> DataFrame:
    """(name, rep): names grouped with their variants; the earliest spelling represents a group.

    Groups are connected components of the pair test, so they do not depend on input order.
    """
    # kept, or the test on the stems below would be made for every row of the catalog
    first = settle(catalog.where(F.trim("name") != "").groupBy(F.trim("name").alias("name")).agg(F.min("ord").alias("ord")))
    stop = _stop_array(stops)
    full = T.stem_signature(F.col("name"))
    cut = _minus(full, stop)
    sig = settle(first.withColumn("sig", F.when(F.size(cut) > 0, cut).otherwise(full))).where(F.size("sig") > 0)
    nodes = sig.groupBy("sig").agg(F.min("ord").alias("node"))
    comp = connected(variant_edges(nodes))
    grouped = sig.join(nodes, "sig").join(comp, "node", "left").withColumn("group", F.coalesce("component", "node"))
    reps = grouped.groupBy("group").agg(F.min_by("name", "ord").alias("rep"))
    return grouped.join(reps, "group").select("name", "rep")


def auto_aliases(catalog: DataFrame, stops: DataFrame) -> DataFrame:
    """(canonical, alias): variant groups that at least two vendors use."""
    g = variant_groups(catalog, stops)
    named = catalog.select("vendor", F.trim("name").alias("name")).distinct().join(g, "name", "left")
    named = named.withColumn("rep", F.coalesce("rep", "name"))
    shared = named.groupBy("rep").agg(F.count_distinct("vendor").alias("vendors")).where(F.col("vendors") >= 2)
    return named.select("rep", "name").distinct().join(shared, "rep").select(
        F.col("rep").alias("canonical"), F.col("name").alias("alias"), "vendors")


# ------------------------------------------------------------------ matrix, exclusives, gaps
def with_canonical(catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Catalog rows with their canonical name; rows of a very frequent name are spread by position."""
    return catalog.join(mapping, "name").withColumn("key", F.lower("canonical"))


def feature_marks(named: DataFrame) -> DataFrame:
    """One row per (canonical feature, vendor): first spelling, first source, number of entries."""
    return named.groupBy("canonical", "vendor").agg(
        F.min_by("name", "ord").alias("display"), F.min_by("source", F.when(F.col("source") != "", F.col("ord"))).alias("source"),
        F.min("category").alias("category"), F.count("*").alias("entries"))


def feature_rows(marks: DataFrame) -> DataFrame:
    """One row per canonical feature over all categories: its category, holders and exclusiveness."""
    return marks.groupBy("canonical").agg(
        F.min("category").alias("category"), F.count("*").alias("holders"),
        (F.count("*") == 1).alias("exclusive"))


def matrix_order(rows: DataFrame) -> DataFrame:
    """Report order: by category, shared features first, more holders first, then by name."""
    return rows.orderBy("category", "exclusive", F.col("holders").desc(), "canonical")


def category_totals(marks: DataFrame) -> DataFrame:
    """Features per (category, vendor) with subtotals and grand total."""
    return marks.rollup("category", "vendor").agg(F.count("*").alias("features"))


def exclusive_features(named: DataFrame) -> DataFrame:
    """Features only one vendor holds, category ignored, in the vendor's own first spelling; without a source they do not count."""
    per = named.groupBy("key", "vendor").agg(F.min(F.struct("ord", "canonical", "name", "category", "source")).alias("f"))
    return per.groupBy("key").agg(F.count("*").alias("n"), F.first("vendor").alias("vendor"), F.first("f").alias("f")).where(
        F.col("n") == 1).select("vendor", F.col("f.canonical").alias("feature"), F.col("f.name").alias("display"),
                                F.col("f.category").alias("category"), F.col("f.source").alias("source")).where(
                                    F.coalesce("source", F.lit("")) != "")


def common_gaps(named: DataFrame, vendors: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(vendor, feature): features most vendors hold but this one does not list.

    A feature common to a share of all vendors is one of few: their number is at most the average
    catalog size divided by the ratio.  The list therefore fits one array value, and each vendor's
    held part of it is no longer than the list.
    """
    held = named.select("canonical", "vendor").distinct()
    n = vendors.agg(F.count_distinct("vendor").alias("n")).scalar()
    common = (held.groupBy("canonical").agg(F.count("*").alias("holders"))
              .where((n >= 3) & (F.col("holders") / n >= ratio)).select("canonical"))
    every = common.agg(F.array_sort(F.collect_list("canonical")).alias("a")).scalar()
    mine = held.join(common, "canonical", "left_semi").groupBy("vendor").agg(F.collect_set("canonical").alias("mine"))
    return (vendors.select("vendor").distinct().join(mine, "vendor", "left")
            .select("vendor", F.explode(F.array_except(every, F.coalesce("mine", F.array().cast("array<string>")))).alias("feature")))


# ------------------------------------------------------------------ holders by words
def feature_keys(catalog: DataFrame) -> DataFrame:
    """key, feature (first spelling), ord, toks: names of at least four characters."""
    key = F.lower(F.trim("name"))
    return (catalog.where(F.length(key) >= 4).groupBy(key.alias("key"))
            .agg(F.min_by("name", "ord").alias("feature"), F.min("ord").alias("ord"))
            .withColumn("toks", T.name_tokens(F.col("key"))).where(F.size("toks") > 0))


def vendor_words(catalog: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "name", "desc")
    return catalog.select("vendor", F.explode(T.name_tokens(text)).alias("token")).distinct()


def holders(keys: DataFrame, words: DataFrame) -> DataFrame:
    """(key, vendor): the vendor's catalog words include all words of the key.

    Keys with equal words are decided once.  Candidates come from each key's rarest word; its
    other words are then counted per candidate.
    """
    sets = keys.select(F.array_sort("toks").alias("toks")).distinct().withColumn("sid", F.xxhash64("toks"))
    freq = words.groupBy("token").agg(F.count("*").alias("f"))
    anchor = (sets.select("toks", F.explode("toks").alias("token")).join(freq, "token")
              .groupBy("toks").agg(F.min(F.struct("f", "token")).alias("a"), F.count("*").alias("known"))
              .where(F.col("known") == F.size("toks")).select("toks", F.col("a.token").alias("token")))
    cand = anchor.join(words, "token").select("toks", "vendor")
    ok = (cand.select("toks", "vendor", F.explode("toks").alias("token")).join(words, ["vendor", "token"])
          .groupBy("toks", "vendor").agg(F.count("*").alias("n")).where(F.col("n") == F.size("toks")))
    return keys.select("key", F.array_sort("toks").alias("toks")).join(ok, "toks").select("key", "vendor")


def common_features(catalog: DataFrame, vendors: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(info, ranked, held): features with their holders, common ones numbered from 1, and who holds which number."""
    keys = feature_keys(catalog)
    h = settle(holders(keys, vendor_words(catalog)))
    n = vendors.agg(F.count_distinct("vendor").alias("n")).scalar()
    counts = h.groupBy("key").agg(F.count("*").alias("holders"), F.min("vendor").alias("only"))
    info = keys.select("key", "feature", "ord").join(counts, "key")
    floor_ = F.greatest(F.lit(2), F.bround(n * F.lit(share).cast("decimal(3,2)")))
    common = info.where(F.col("holders") >= floor_).select("key", "feature", F.struct(-F.col("holders"), F.col("ord"), F.col("feature")).alias("c"))
    ranked = settle(dense_index(common, ["c"], "r").drop("c"))
    return info, ranked, h.join(ranked, "key").select("vendor", "r").distinct()


def missing_features(vendors: DataFrame, ranked: DataFrame, held: DataFrame) -> DataFrame:
    """(vendor, nth, feature): every common feature a vendor does not hold, in the order of their numbers.

    The numbers between two held ones are missing, and so are those after the last: no vendor is paired
    with a feature it holds.
    """
    total = ranked.agg(F.count("*").alias("n")).scalar()
    none = vendors.select("vendor").distinct().withColumn("r", F.lit(0).cast("bigint"))
    along = Window.partitionBy("vendor").orderBy("r")
    seen = held.unionByName(none).select("vendor", "r", F.coalesce(F.lead("r").over(along), total + 1).alias("next"), F.row_number().over(along).alias("i"))
    gaps = seen.where("next > r + 1").select("vendor", "i", F.explode(F.sequence(F.col("r") + 1, F.col("next") - 1)).alias("r"))
    return gaps.join(ranked, "r").select("vendor", (F.col("r") - F.col("i") + 1).cast("int").alias("nth"), "feature")


def sole_features(info: DataFrame) -> DataFrame:
    """(vendor, nth, feature): features only one vendor's words cover, in input order."""
    sole = info.where(F.col("holders") == 1).select(F.col("only").alias("vendor"), "ord", "feature")
    return sole.select("vendor", F.row_number().over(Window.partitionBy("vendor").orderBy("ord", "feature")).alias("nth"), "feature")


def feature_points(catalog: DataFrame, vendors: DataFrame, share: float = 0.6) -> DataFrame:
    """(vendor, kind, nth, feature): all exclusive and all missing common features of every vendor, ranked."""
    info, ranked, held = common_features(catalog, vendors, share)
    return (sole_features(info).select("vendor", F.lit("exclusive").alias("kind"), "nth", "feature")
            .unionByName(missing_features(vendors, ranked, held).select("vendor", F.lit("missing").alias("kind"), "nth", "feature")))


def feature_conclusions(catalog: DataFrame, vendors: DataFrame, share: float = 0.6, shown: int = 3) -> DataFrame:
    """Per vendor: how many common features it holds, exclusives, first missing ones, verdict; feature_points has all."""
    info, ranked, held_by = common_features(catalog, vendors, share)
    mine = held_by.groupBy("vendor").agg(F.count("*").alias("held"))
    sole = sole_features(info).groupBy("vendor").agg(F.count("*").alias("exclusives"), F.min_by("feature", "nth").alias("first_exclusive"))
    first = (missing_features(vendors, ranked, held_by).where(F.col("nth") <= shown).groupBy("vendor")
             .agg(F.sort_array(F.collect_list(F.struct("nth", "feature"))).alias("first")))
    j = (vendors.select("vendor").distinct().join(mine, "vendor", "left").join(sole, "vendor", "left").join(first, "vendor", "left")
         .withColumn("total", ranked.agg(F.count("*").alias("n")).scalar()))
    held, total = F.coalesce("held", F.lit(0)).cast("int"), F.col("total").cast("int")
    ratio = F.when(total > 0, held / total).otherwise(F.lit(0.0))
    some = F.coalesce("exclusives", F.lit(0)) > 0
    verdict = (F.when(total == 0, F.lit(K.COVERAGE_UNKNOWN)).when((ratio >= 0.99) & some, F.lit(K.COVERAGE_BEST + K.COVERAGE_OWN))
               .when(ratio >= 0.99, F.lit(K.COVERAGE_BEST)).when((ratio >= 0.6) & some, F.lit(K.COVERAGE_EVEN + K.COVERAGE_OWN))
               .when(ratio >= 0.6, F.lit(K.COVERAGE_EVEN)).otherwise(F.lit(K.COVERAGE_THIN)))
    return j.select("vendor", held.alias("held"), total.alias("total"),
                    F.bround(F.lit(100).cast("decimal(18,6)") * held / F.greatest(total, F.lit(1))).cast("int").alias("ratio"),
                    F.coalesce("exclusives", F.lit(0)).alias("exclusives"), F.coalesce("first_exclusive", F.lit("")).alias("first_exclusive"),
                    F.coalesce(F.array_join(F.transform("first", lambda x: x["feature"]), ", "), F.lit("")).alias("missing"), verdict.alias("verdict"))


def unmentioned_features(catalog: DataFrame, vendors: DataFrame, share: float = 0.6, per_vendor: int | None = None) -> DataFrame:
    """Common features, ranked, that appear nowhere in the entries of the given vendors.

    "Not mentioned" is what it says: the rows carry how many other vendors mention the feature and
    never claim that the vendor lacks it.
    """
    keys = settle(feature_keys(catalog))
    h = settle(holders(keys, vendor_words(catalog)))
    n = catalog.agg(F.count_distinct("vendor").alias("n")).scalar()
    floor_ = F.greatest(F.lit(2), F.bround(n * F.lit(share).cast("decimal(3,2)")))
    common = settle(h.groupBy("key").agg(F.count("*").alias("holders")).join(keys.select("key", "feature", "ord"), "key")
              .where(F.col("holders") >= floor_)
              .select("key", F.struct((-F.col("holders")).alias("rank"), F.col("ord"), F.col("key"), F.col("feature")).alias("c")))
    kind = "array<" + common.schema["c"].dataType.simpleString() + ">"
    every = F.coalesce(common.agg(F.array_sort(F.collect_list("c")).alias("a")).scalar(), F.array().cast(kind))
    entry = F.lower(F.concat_ws(" ", "name", "desc"))
    said = (catalog.join(vendors.select("vendor").distinct(), "vendor", "left_semi")
            .select("vendor", F.array(entry).alias("entry"), every.alias("every"))
            .select("vendor", F.explode(F.get(F.transform("entry", lambda e: F.filter("every", lambda c: F.contains(e, c["key"]))), F.lit(0))).alias("c")).distinct()
            .groupBy("vendor").agg(F.collect_set("c").alias("said")))
    held = h.join(common, "key").select("vendor", "c").distinct().groupBy("vendor").agg(F.collect_set("c").alias("held"))
    j = (vendors.select("vendor").distinct().join(said, "vendor", "left").join(held, "vendor", "left")
         .withColumns({"every": every, "floor": floor_}))
    none = F.array().cast(kind)
    others = lambda c: -c["rank"] - F.when(F.array_contains(F.coalesce("held", none), c), F.lit(1)).otherwise(F.lit(0))
    left = F.filter(F.array_sort(F.array_except("every", F.coalesce("said", none))), lambda c: others(c) >= F.col("floor"))
    return j.select("vendor", F.posexplode(left if per_vendor is None else F.slice(left, 1, per_vendor)).alias("nth", "c"), "held").select(
        "vendor", (F.col("nth") + 1).alias("nth"), F.col("c.feature").alias("feature"), others(F.col("c")).cast("bigint").alias("others"))


# ------------------------------------------------------------------ capability table
def default_capabilities(spark: SparkSession, rows=None) -> DataFrame:
    """id, category, alias, ord: aliases of each capability, its two names last."""
    out = []
    for cid, cn, en, cat, aliases in rows or K.DEFAULT_CAPABILITIES:
        for i, a in enumerate(dict.fromkeys(x.strip().lower() for x in [*aliases, en, cn])):
            out.append((cid, cat, a, i))
    return spark.createDataFrame(out, "id string, category string, alias string, ord int")


def supported_marks(names: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(vendor, id, category, status, confidence, evidence, matched): the capabilities a vendor's names show, and no others.

    names(vendor, name, ord).  An alias equal to a name is sure; an alias inside a name, on word
    edges with a plural ending, is likely; otherwise nothing is claimed.
    """
    low = (names.where(F.trim("name") != "").groupBy("vendor", F.lower(F.trim("name")).alias("key"))
           .agg(F.max("ord").alias("last"), F.min("ord").alias("ord"), F.max_by("name", "ord").alias("name")))
    exact = low.join(capabilities.withColumnRenamed("alias", "key").withColumnRenamed("ord", "pos"), "key").select(
        "vendor", "id", F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "name", F.col("key").alias("alias")).alias("m"))
    long_enough = F.length("alias") >= F.when(F.col("alias").rlike(CJK), F.lit(2)).otherwise(F.lit(4))
    ph = capabilities.where(long_enough).select(F.struct("id", "ord", "alias").alias("pid"), F.col("alias").alias("key"))
    hits = phrase_hits(low.select(F.col("key").alias("name")).distinct(), ph, "(?:s|es)?").select(
        F.col("name").alias("key"), F.col("pid.id").alias("id"), F.col("pid.ord").alias("pos"), F.col("pid.alias").alias("alias"))
    likely = low.join(hits, "key").select(
        "vendor", "id", F.struct(F.lit(1).alias("kind"), F.col("ord").cast("long").alias("k1"), F.col("pos").cast("long").alias("k2"), "name", "alias").alias("m"))
    best = exact.unionByName(likely).groupBy("vendor", "id").agg(F.min("m").alias("m"))
    return best.join(capability_ids(capabilities), "id").select(
        "vendor", "id", "category", F.lit("supports").alias("status"), F.when(F.col("m.kind") == 0, "high").otherwise("medium").alias("confidence"),
        F.col("m.name").alias("evidence"), F.col("m.alias").alias("matched"))


def capability_ids(capabilities: DataFrame) -> DataFrame:
    return capabilities.groupBy("id").agg(F.first("category").alias("category"))


def capability_marks(names: DataFrame, vendors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """supported_marks and a row `unknown` for every other (vendor, capability): a table to show, not to count by."""
    listed = capability_ids(capabilities).agg(F.array_sort(F.collect_list(F.struct("id", "category"))).alias("a")).scalar()
    found = supported_marks(names, capabilities).drop("category")
    shown = vendors.select("vendor").distinct().select("vendor", F.inline(listed)).join(found, ["vendor", "id"], "left")
    return shown.select("vendor", "id", "category", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
                        F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("matched", F.lit("")).alias("matched"))


def override_marks(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """Manual corrections (vendor, id, status, evidence, note) replace the automatic mark."""
    n = notes.select("vendor", "id", F.col("status").alias("n_status"), F.col("evidence").alias("n_evidence"), F.col("note").alias("n_note"))
    return _overridden(marks.join(n, ["vendor", "id"], "left"))


def override_supported(found: DataFrame, notes: DataFrame, vendors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """override_marks on supported_marks alone: corrections of pairs without a mark become rows of their own."""
    n = notes.select("vendor", "id", F.col("status").alias("n_status"), F.col("evidence").alias("n_evidence"), F.col("note").alias("n_note"))
    n = n.join(vendors.select("vendor").distinct(), "vendor", "left_semi").join(
        capability_ids(capabilities).withColumnRenamed("category", "n_category"), "id")
    j = found.join(n, ["vendor", "id"], "full").withColumns({
        "category": F.coalesce("category", "n_category"), "status": F.coalesce("status", F.lit("unknown")),
        "confidence": F.coalesce("confidence", F.lit("low")), "evidence": F.coalesce("evidence", F.lit(""))})
    return _overridden(j)


def _overridden(j: DataFrame) -> DataFrame:
    status = F.coalesce("n_status", "status")
    sure = F.when(status == "supports", F.lit("high")).otherwise(F.lit("medium"))
    return j.select("vendor", "id", "category", status.alias("status"),
                    F.when(F.col("n_note").isNotNull(), sure).otherwise(F.col("confidence")).alias("confidence"),
                    F.coalesce("n_evidence", "evidence").alias("evidence"), F.coalesce("n_note", F.lit("")).alias("note"))


def support_counts(marks: DataFrame, vendors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """capability_support from marks that leave the unknown out: vendors are counted, not paired with capabilities."""
    n = vendors.agg(F.count_distinct("vendor")).scalar()
    yes = marks.where(F.col("status") == "supports").groupBy("id").agg(F.count("*").alias("supported"))
    return capability_ids(capabilities).join(yes, "id", "left").select("id", "category", F.coalesce("supported", F.lit(0)).alias("supported"), n.alias("vendors"))


def vendor_confidence(marks: DataFrame, vendors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """confidence_counts from marks that leave the unknown out: what is neither high nor medium is low."""
    n = capabilities.agg(F.count_distinct("id")).scalar()
    held = marks.groupBy("vendor").agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))
    return vendors.select("vendor").distinct().join(held, "vendor", "left").na.fill(0).select("vendor", "high", "medium", (n - F.col("high") - F.col("medium")).alias("low"))


def capability_support(marks: DataFrame) -> DataFrame:
    return marks.groupBy("id", "category").agg(F.count_if(F.col("status") == "supports").alias("supported"), F.count("*").alias("vendors"))


def confidence_counts(marks: DataFrame) -> DataFrame:
    """Marks per vendor by confidence, one column each."""
    return marks.groupBy("vendor").pivot("confidence", ["high", "medium", "low"]).count().na.fill(0)


# ------------------------------------------------------------------ catalog repair
def repair_catalog(catalog: DataFrame) -> DataFrame:
    """Clean names, no junk, one row per name whatever its case: most capitals, then first."""
    c = catalog.withColumn("name", T.clean_feature_name(F.col("name")))
    c = c.where((F.col("name") != "") & ~T.is_junk_name(F.col("name")))
    caps = F.regexp_count("name", F.lit(r"\p{Lu}"))
    return c.groupBy("vendor", F.lower("name").alias("key")).agg(
        F.max_by("name", F.struct(caps, -F.col("ord"))).alias("name"), F.min("ord").alias("ord"),
        F.min_by("category", "ord").alias("category")).drop("key")


def fill_catalog(catalog: DataFrame, core: DataFrame) -> DataFrame:
    """Vendors without any catalog entry get one unsourced entry per core feature."""
    missing = core.join(catalog.select("vendor").distinct(), "vendor", "left_anti").where(F.trim("name") != "")
    rows = missing.select("vendor", "ord", F.trim("name").alias("name"), F.lit("").alias("source"))
    return catalog.select("vendor", "ord", "name", "source").unionByName(rows)


def unified_share(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Share of catalog names that are unified names or hold a CJK alias; below half is a warning."""
    pool = aliases.where(~F.col("phrase")).select("alias").distinct()
    cjk = pool.where((F.length("alias") >= 2) & F.col("alias").rlike(CJK))
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    exact = counted.join(pool.withColumnRenamed("alias", "name"), "name", "left_semi").select("name")
    inside = phrase_hits(counted.where(F.col("name").rlike(CJK)).select("name"),
                         cjk.select(F.col("alias").alias("pid"), F.col("alias").alias("key"))).select("name")
    hit = exact.unionByName(inside).distinct().withColumn("hit", F.lit(1))
    return counted.join(hit, "name", "left").agg(
        F.sum("n").alias("names"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(F.lit(0))).alias("unified")).withColumn(
        "warn", (F.col("names") > 0) & (F.col("unified") * 2 < F.col("names")))
