"""Dialogues rendered once for every participant, with that speaker as the assistant."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import table

END = "<|end|>\n"


def ordered_turns(turns: DataFrame, conv: str, turn: str, speaker: str, text: str, per_segment: int) -> DataFrame:
    """(conv, segment, place, speaker, text): turns numbered from 0 in their dialogue, cut into segments.

    The order is turn (null first), then a hash of speaker and text.  A dialogue is dealt out into cells
    of equal turn number and leading hash bits; cells are summed up and shift the ranks inside them, so
    no task sorts a dialogue that holds a large part of all rows.  Equal rows are counted, then repeated.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(speaker, F.lit("unknown")).alias("speaker"),
                        F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("speaker", "text"))
    rows = rows.groupBy("conv", "turn", "tie", "speaker", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("tie", 52))
    cells = rows.groupBy("conv", "turn", "cell").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    cells = cells.select(*[F.col(c).alias(f"c_{c}") for c in ("conv", "turn", "cell")], "before")
    inside = Window.partitionBy("conv", "turn", "cell").orderBy("tie", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("turn").eqNullSafe(F.col("c_turn")) & (F.col("cell") == F.col("c_cell"))
    first = F.col("before") + F.col("inside")
    placed = rows.join(cells, same).select("conv", "speaker", "text", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("place"))
    return placed.withColumn("segment", F.floor(F.col("place") / per_segment).cast("long"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
                 per_segment: int = 64, system: str = "system") -> DataFrame:
    """(conv, speaker, segment, n_turns, rendered, masks), a row for each participant and segment of a dialogue.

    Every speaker but `system` is a participant.  In a participant's rendering its own turns stand under
    the assistant's tag, the others' under the user's tag with their names, system turns under the system
    tag.  masks are the (start, end) code-point ranges to learn from: the participant's texts with their
    end marks.  Dialogues longer than `per_segment` turns are cut into segments, so no row grows with the
    dialogue; a segment in which a participant is silent has no mask.

    Null speaker: a participant named unknown.  Null or empty text: an empty turn.  Null turn number: first.
    Null conv: one dialogue.  Ties: in the order of a hash of speaker and text.  Repeated rows: repeated turns.
    Only system turns, or an empty table: no rows.  Other columns are not read.
    """
    placed = ordered_turns(turns, conv, turn, speaker, text, per_segment)
    segments = placed.groupBy("conv", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    who = (turns.select(F.col(conv).alias("who_conv"), F.coalesce(speaker, F.lit("unknown")).alias("who"))
           .where(F.col("who") != system).distinct())
    seen = segments.join(who, F.col("conv").eqNullSafe(F.col("who_conv")))
    head = F.transform("turns", lambda t: F.when(t["speaker"] == F.col("who"), F.lit("<|assistant|>\n"))
                       .when(t["speaker"] == system, F.lit("<|system|>\n"))
                       .otherwise(F.concat(F.lit("<|user name="), t["speaker"], F.lit("|>\n"))))
    pieces = F.transform(F.arrays_zip(F.col("turns").alias("t"), F.col("heads").alias("h")), lambda p: F.struct(
        F.concat(p["h"], p["t"]["text"], F.lit(END)).alias("piece"),
        F.char_length(p["h"]).alias("head"), (p["t"]["speaker"] == F.col("who")).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("masks"))

    def step(acc, p):
        end = (acc["at"] + F.char_length(p["piece"])).cast("int")
        own = F.struct((acc["at"] + p["head"]).cast("int").alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(p["own"], F.array_append(acc["masks"], own)).otherwise(acc["masks"]).alias("masks"))

    out = seen.withColumn("heads", head).withColumn("pieces", pieces)
    return out.select(F.col("conv").alias(conv), F.col("who").alias("speaker"), "segment", F.size("turns").cast("long").alias("n_turns"),
                      F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"),
                      F.aggregate("pieces", start, step)["masks"].alias("masks"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its speakers."""
    p = perspectives(table(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return p.select("conv_id", "speaker", "segment", "n_turns", "rendered", marks.alias("masks"))


# Turns equal in conversation and number are taken in the order of their texts here; the tables hold none.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT t.conv_id, w.speaker, t.place // 64 AS segment, t.place, t.role = w.speaker AS own,
         CASE WHEN t.role = w.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head, t.text || '<|end|>' || chr(10) AS body
  FROM t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM p)
SELECT conv_id, speaker, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (start_at + length(head))::BIGINT::VARCHAR || ':' || (start_at + length(head) + length(body) - 1)::BIGINT::VARCHAR END,
                           ',' ORDER BY place), '') AS masks
FROM o GROUP BY conv_id, speaker, segment
"""
