"""Joins and orderings that hold when one key owns a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from attesta.operators.components import settle


def dense_index(df: DataFrame, order: list[str], out: str = "idx", parts: int | None = None) -> DataFrame:
    """1-based position in a unique order, without one global sort task.

    Rows are dealt out by ranges of the order, kept, numbered inside each range and shifted by the sizes of
    the ranges before: one number for each of `parts` ranges, the session's number of shuffle partitions unless given.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id()))
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__b").orderBy(*order)
    return (dealt.join(F.broadcast(offsets), "__b").withColumn(out, F.col("__off") + F.row_number().over(within))
            .drop("__b", "__off"))


def stable_rank(df: DataFrame, groups: list[str], value: str, ord_col: str, out: str = "rank",
                bucket_rows: int = 100_000) -> DataFrame:
    """Row-number rank by value descending, then input order, inside large groups.

    `value` has few distinct values (a rounded score).  Rank = rows with a higher value + equal rows
    in earlier order ranges + position in the own range, so no task sorts a whole group.
    """
    b = df.withColumn("__b", F.expr(f"`{ord_col}` div {bucket_rows}"))
    cells = b.groupBy(*groups, value, "__b").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*groups, value).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    higher = (Window.partitionBy(*groups).orderBy(F.col(value).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    values = (cells.groupBy(*groups, value).agg(F.sum("__n").alias("__m"))
              .withColumn("__above", F.coalesce(F.sum("__m").over(higher), F.lit(0))).drop("__m"))
    offsets = (cells.withColumn("__same", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
               .join(values, [*groups, value]))
    within = Window.partitionBy(*groups, value, "__b").orderBy(ord_col)
    return (b.join(offsets, [*groups, value, "__b"])
            .withColumn(out, F.col("__above") + F.col("__same") + F.row_number().over(within))
            .drop("__b", "__above", "__same"))


def first_per_key(df: DataFrame, keys: list[str], order: list, k: int = 1, out: str | None = None) -> DataFrame:
    """The first k rows per key; Spark limits each map task to k rows before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn(out or "__rn", rn).where(F.col(out or "__rn") <= k)
    return ranked if out else ranked.drop("__rn")
