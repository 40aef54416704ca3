"""License scans by diagonal voting: word pairs meet template positions, offsets vote for spans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import ascii_lower, table

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of public license notices, by label.
NOTICES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                         "the license you may obtain a copy of the license at",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                      "following conditions are met",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-attribution": "licensed under a creative commons attribution 4 0 international license",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                  "license as published by the free software foundation either version",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Words too common to vote in pairs of their own.
COMMON = ("a", "and", "any", "as", "at", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you", "under")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_grams(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[tuple]:
    """(template, label, exact, n_words, n_grams, tpos, gram) for every word pair that votes."""
    out = []
    for t, (words, label, exact) in enumerate([(p.split(), l, True) for p, l in phrases.items()]
                                              + [(n.split(), l, False) for l, n in notices.items()]):
        grams = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:])) if exact or not (a in COMMON and b in COMMON)]
        out += [(t, label, exact, len(words), len(grams), i, g) for i, g in grams]
    return out


def _values(grams: list[tuple]) -> str:
    return ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {m}, {i}, '{g}')" for t, label, exact, n, m, i, g in grams)


def words_of(text: Column) -> Column:
    """Lower-cased words; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, drift: int = 4,
                  least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, scores): what licenses every document names.

    spans(id, mark, template, label, exact, start, end, share): verified spans of words.  scores(id, mark,
    score): the best share of a template's votes, also below `least`.  mark is the text's hash, so rows
    of one id keep apart.

    Every rolling pair of words is hashed and joined to the positions of the templates' pairs (a list
    whose size the templates fix, so it may be broadcast).  A hit votes for its diagonal, word position
    less template position.  A phrase stands where all its pairs are on one diagonal; a notice may lose
    or gain words: diagonals up to `drift` apart merge, and a span counts if `least` of the votes (all,
    for a notice of fewer than 8 pairs) are there within half as many words again.  Pairs are compared as words, not by hash alone.

    Null, empty text: no span.  Repeated rows: equal hits count once and belong to each of the rows.
    Null id: told apart by its text.  Empty table: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    grams = spark.sql(f"SELECT *, xxhash64(tgram) AS thash FROM VALUES {_values(template_grams(phrases, notices))} AS v(template, label, exact, n_words, n_grams, tpos, tgram)")
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words_of(F.col(text_col)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    rolled = words.where(F.size("w") > 1).select("id", "mark", F.posexplode(pairs).alias("pos", "gram"))
    met = rolled.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(grams), (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram")))
    key = ["id", "mark", "template"]
    votes = (met.groupBy(*key, "label", "exact", "n_words", "n_grams", "pos", "tpos").agg(F.lit(1).alias("one"))
             .withColumn("diagonal", F.col("pos") - F.col("tpos")))
    along = Window.partitionBy(*key).orderBy("diagonal", "pos", "tpos")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(drift)
    group = F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tallied = (votes.withColumn("lane", group).groupBy(*key, "lane", "label", "exact", "n_words", "n_grams")
               .agg(F.count_distinct("tpos").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("end"))
               .withColumn("share", F.col("votes") / F.col("n_grams")))
    fits = (F.col("end") - F.col("start")) * 2 <= F.col("n_words") * 3
    whole = F.col("exact") | (F.col("n_grams") < 8)
    good = fits & (F.col("share") >= F.when(whole, 1.0).otherwise(least))
    spans = tallied.where(good).select("id", "mark", "template", "label", "exact", "start", "end", "share")
    scores = tallied.groupBy("id", "mark").agg(F.max("share").alias("score"))
    return spans, scores


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels, places and score of every document."""
    docs = table(spark, sf_dir, "documents")
    spans, scores = scan_licenses(docs)
    base = F.col("exact")
    found = spans.groupBy("id", "mark").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    found = found.withColumnsRenamed({"id": "fid", "mark": "fmark"})
    per_doc = scores.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("mark") == F.col("fmark")), "left")
    text = F.col("text")
    slim = docs.select("doc_id", F.xxhash64("text").alias("m"), F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = slim.join(per_doc, slim["doc_id"].eqNullSafe(per_doc["id"]) & (F.col("m") == F.col("mark")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


# The same scan for a second engine: rows are told apart by their number.
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT * FROM (VALUES {_values(template_grams())}) v(template, label, exact, n_words, n_grams, tpos, tgram)),
g AS (SELECT rid, p AS pos, w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT rid, w, unnest(range(len(w) - 1)) AS p FROM d WHERE len(w) > 1)),
v AS (SELECT rid, k.*, pos, pos - tpos AS diagonal FROM g JOIN k ON gram = tgram),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal, pos, tpos) > CASE WHEN exact THEN 0 ELSE 4 END THEN 1 ELSE 0 END AS far FROM v),
l AS (SELECT *, sum(far) OVER (PARTITION BY rid, template ORDER BY diagonal, pos, tpos) AS lane FROM s),
t AS (SELECT rid, template, label, exact, n_words, n_grams, count(DISTINCT tpos) / n_grams AS share, min(pos) AS first_pos, max(pos) + 2 AS past
      FROM l GROUP BY rid, template, lane, label, exact, n_words, n_grams),
f AS (SELECT * FROM t WHERE (past - first_pos) * 2 <= n_words * 3 AND share >= CASE WHEN exact OR n_grams < 8 THEN 1.0 ELSE 0.6 END)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce((SELECT count(*) FROM f WHERE f.rid = d.rid AND exact), 0) AS n_base,
  (SELECT min(first_pos) FROM f WHERE f.rid = d.rid AND exact)::BIGINT AS first_word, (SELECT max(first_pos) FROM f WHERE f.rid = d.rid AND exact)::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM f WHERE f.rid = d.rid AND exact), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM f WHERE f.rid = d.rid), '') AS labels,
  coalesce((SELECT max(share) FROM t WHERE t.rid = d.rid), 0.0)::DOUBLE AS score
FROM d
"""
