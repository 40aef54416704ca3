"""A mix of sources near target weights: blocks of words apportioned by highest quotients."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import WORD, keep, numbered, plain, small_side, table, word_count

ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_part"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, source_size, n_rows).

    Sources in code-point order (null last) weigh `weights`, repeating, and share `share` of all words; a
    target stops at `most` times its source's size and the excess is shared anew by weight.  Each round
    reads one row of sums; the water level only rises, so the rounds end.  A source without words: 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    src = numbered(sizes, F.col("source").asc_nulls_last(), "rank").withColumn("w", w)
    cap = F.col("source_size") * F.lit(most)
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, full = 0.0, -1
    while True:
        is_full = cap <= F.col("w") * F.lit(level)
        r = src.agg(F.count_if(is_full).alias("n"), F.sum(F.when(is_full, cap)).alias("c"),
                    F.sum(F.when(~is_full, F.col("w"))).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - (r["c"] or 0.0)) / r["w"]
    return src.withColumn("target", F.least(cap, F.col("w") * F.lit(level)))


def quotas(units: DataFrame, seats: int, step: int = 32) -> DataFrame:
    """units(..., ideal, most) with `quota`: `seats` seats dealt by the highest quotients ideal / 1, 3, 5, ...

    The lowest quotient that wins a seat is found by narrowing a range `step`-fold a round; a round reads
    one row of sums.  Ideals differ by a billionth of a hash, so equal units are not tied at the border.
    """
    exact = F.col("ideal") * (1 + F.pmod(F.col("tie"), F.lit(1 << 20)) / F.lit(float(1 << 50)))
    units = keep(units.withColumn("exact", exact))

    def won(t: Column) -> Column:
        return F.least(F.col("most"), F.floor((F.col("exact") / t + 1) / 2))

    # in units of one seat: ideal is in seats, so the border lies near quotient 1 / 2
    low, high = 1e-3, 1e3
    border = low
    for _ in range(16):
        tries = [low * (high / low) ** (k / step) for k in range(step + 1)]
        sums = units.agg(*[F.coalesce(F.sum(won(F.lit(t))), F.lit(0)).alias(f"s{k}") for k, t in enumerate(tries)]).first()
        enough = [k for k in range(step + 1) if sums[k] >= seats]
        k = max(enough, default=0)
        border = tries[k]
        if sums[k] <= seats or k == step or tries[k] == tries[k + 1]:
            break
        low, high = tries[k], tries[k + 1]
    return units.withColumn("quota", won(F.lit(border)).cast("long")).drop("exact")


def mix(docs: DataFrame, block: int = 16, rows_per_unit: int = 8192, weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_part added (older columns of these names go).

    Every source is cut by hash into units of about `rows_per_unit` documents.  Blocks of `block` words are
    apportioned to the units by highest quotients (divisors 1, 3, 5, ...), a unit's weight being its part of
    its source's target.  A unit lays its documents end to end in seeded order and hands out its quota of
    blocks from the start, round and round: mix_taken is what falls on a document, at most `most` times its
    words, and mix_part what of it is not a whole copy (the document's first words).

    A source of any size is many units, each sorted in one task of its own; the driver sees sums only.
    Null text: 0 words, 0 taken.  Null source: the last source.  Null ids, repeated rows: rows like any
    other, ordered by their text too, so reruns agree.  Empty table: no rows.
    """
    docs = docs.drop(*ADDED)
    named, (key, text, source) = plain(docs, id_col, text_col, source_col)
    named = named.withColumn("size", word_count(F.col(text))).withColumn("hash", F.xxhash64(F.lit(seed), key, text))
    slim = named.select(F.col(source).alias("source"), "size", "hash")
    by_source = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")),
                               weights, share, most)
    by_source = keep(by_source.withColumn("n_units", F.ceil(F.col("n_rows") / rows_per_unit)))
    # a few sources are sent to the texts; of very many, both sides meet by source
    facts = small_side(by_source.select(F.col("source").alias("of_source"), "rank", "n_units", "source_size", "target"))

    def with_unit(rows: DataFrame, source: str) -> DataFrame:
        return (rows.join(facts, F.col(source).eqNullSafe(F.col("of_source"))).drop("of_source")
                .withColumn("unit", F.pmod(F.shiftright("hash", 20), F.col("n_units"))))

    units = (with_unit(slim, "source").groupBy("rank", "unit")
             .agg(F.sum("size").alias("words"), F.first("source_size").alias("s"), F.first("target").alias("t")))
    units = units.select(
        "rank", "unit", "words", F.when(F.col("s") > 0, F.col("t") * F.col("words") / F.col("s") / block).otherwise(0.0).alias("ideal"),
        F.ceil(F.col("words") * F.lit(most) / block).alias("most"), F.xxhash64("rank", "unit").alias("tie"))
    seats = by_source.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] / block
    dealt = quotas(units, round(seats)).select("rank", "unit", "words", F.least(
        F.col("quota") * block, F.floor(F.col("words") * F.lit(most))).cast("long").alias("dealt"))
    upto = F.sum("size").over(Window.partitionBy("rank", "unit").orderBy("hash", key, "size")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = with_unit(named, source).withColumn("upto", upto).join(dealt, ["rank", "unit"])
    whole = F.when(F.col("words") > 0, F.floor(F.col("dealt") / F.col("words"))).otherwise(0)
    rest = F.col("dealt") - whole * F.col("words")
    part = F.greatest(F.lit(0), F.least(rest - (F.col("upto") - F.col("size")), F.col("size")))
    out = rows.select(*[f"c{k}" for k in range(len(docs.columns))], "size", "source_size", "target",
                      (whole * F.col("size") + part).cast("long").alias("taken"), part.cast("long").alias("part"))
    return out.toDF(*docs.columns, *ADDED)


def mixed_texts(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole copy and one for the part of a copy.

    A part keeps the document's first words, joined by one space; n_chars, where there is one, follows the text.
    """
    names = [n for n in docs.columns if n not in ADDED]
    m, (text, size, taken) = plain(mix(docs, text_col=text_col, **kw), text_col, "mix_size", "mix_taken")
    whole = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size))).otherwise(0)
    left = F.col(taken) - whole * F.col(size)
    copies = (whole + (left > 0).cast("long")).cast("int")
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")))
    out = m.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    out = out.withColumn(text, F.when(F.col("copy") <= whole, F.col(text)).otherwise(cut))
    if "n_chars" in names:
        at = f"c{names.index('n_chars')}"
        out = out.withColumn(at, F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
