"""Helpers the operators of this package share."""
from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """df computed once and written to the folder the session names in spark.checkpoint.dir.

    Only a local session (a test) that names no folder gets one of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-llm-"))
    return df.checkpoint()


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ... so that no name of it clashes, and the new names of some columns."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def small_side(df: DataFrame, rows: int = 100_000, size: int = 16 << 20) -> DataFrame:
    """df marked for a broadcast if it has at most `rows` rows and `size` bytes of text; else as it is, for a plain join.

    df has to be a kept table: it is counted.
    """
    text = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def bit_map(rows: DataFrame, spot: Column, bits: int = 1 << 25) -> np.ndarray:
    """One bit, set if a row's spot (from 0, below bits) is it: a map of 4 MB whatever the number of rows."""
    spot = spot + 1  # the functions below count from 1
    maps = rows.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("map")).collect()
    size = 32_768  # bits of one of them
    held = np.zeros(bits // size * (size // 8) + size // 8, np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * (size // 8)
        held[at:at + size // 8] = np.frombuffer(bytes(r["map"]), np.uint8)
    return held


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, order: Column, out: str, parts: int = 32) -> DataFrame:
    """0-based position of every row in the given order, kept; no task sorts more than a range of it.

    Rows are dealt out by ranges of the order, numbered inside each range, and shifted by the sizes of
    the ranges before (one number for each of `parts` ranges).  Rows equal in the order may swap places.
    """
    dealt = keep(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(order)
    return keep(dealt.join(F.broadcast(shift), "__part")
                .withColumn(out, F.col("__before") + F.row_number().over(inside) - 1).drop("__part", "__before"))
