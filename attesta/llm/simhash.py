"""Near-duplicate documents by SimHash: pigeonhole blocks, then Hamming distance."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import keep, plain, table
from attesta.operators.components import connected

BITS = 64
GROUP = 4096  # fingerprints a task compares with each other at most


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, signed; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))] or [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, [seed] * len(joined)), np.uint64, len(joined))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def masks(bits: list[int], cuts: list[int], chosen: int) -> list[int]:
    """Masks over every choice of `chosen` blocks, the listed bits being cut into blocks of the given sizes."""
    blocks, at = [], 0
    for n in cuts:
        blocks.append(sum(1 << b for b in bits[at:at + n]))
        at += n
    return [sum(c) for c in combinations(blocks, chosen)]


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def forest(group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the close pairs in a small group of fingerprints."""
    left, edges, front = group, [], []
    while len(left):
        if front:
            at = front.pop()
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(left ^ at) <= distance
        found = left[near]
        left = left[~near]
        edges += [(at, f) for f in found]
        front += list(found)
    return edges


def close_pairs(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Links inside runs of equal (mask, block) of sorted rows, enough of them to connect what is close."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
        rest, rows = rows[last], rows[~last]
        yield _links(rows, distance)
    if rest is not None:
        yield _links(rest, distance)


def _links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    mask, block = rows["mask"].to_numpy(), rows["block"].to_numpy()
    a, b = [], []
    if len(fp):
        start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (block[1:] != block[:-1])])
        size = np.diff(np.r_[start, len(fp)])
        group = np.repeat(np.arange(len(start)), size)
        big = size > 16
        small_rows = ~big[group]
        for shift in range(1, 16):
            i = np.flatnonzero((group[:-shift] == group[shift:]) & small_rows[:-shift])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
            a.append(fp[i])
            b.append(fp[i + shift])
        for g in np.flatnonzero(big):
            edges = forest(fp[start[g]:start[g] + size[g]], distance)
            if edges:
                pairs = np.array(edges, np.uint64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
    empty = np.zeros(0, np.uint64)
    a, b = np.concatenate(a or [empty]).view(np.int64), np.concatenate(b or [empty]).view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def linked(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b), a below b, that connect what lies within `distance` bits, from distinct fingerprints `fp`.

    Two fingerprints that differ in 3 bits agree on 3 of 6 blocks, so every choice of 3 blocks (20, 31 to
    33 bits each) is a key and only equal keys are compared.  A key with more than GROUP fingerprints is
    split by its free bits the same way: cut into 8 blocks, close pairs agree on 5, and at most 2^13
    fingerprints can share the longer key.  So no task holds more than that many
    fingerprints of a group at once, none is left out, and a group yields a forest, not its pairs.  Groups
    are sorted by fingerprint, so a task that runs again gives the same links, in whatever order its rows arrive.
    """
    if distance != 3:
        raise ValueError("the blocks are cut for 3 differing bits")
    all_bits = list(range(BITS))
    first = masks(all_bits, [11, 11, 11, 11, 10, 10], 3)
    second = []
    for m in first:
        free = [b for b in all_bits if not m >> b & 1]
        n = len(free)
        second.append([signed(m | s) for s in masks(free, [n // 8 + (k < n % 8) for k in range(8)], 5)])
    schema = "a bigint, b bigint"
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for k, m in enumerate(first)])).alias("k"))
    whole = Window.partitionBy("mask", "block").orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(whole)
    met = keyed.select("fp", "k.mask", "k.block").withColumn("n", n).where("n > 1")
    low = met.where(F.col("n") <= GROUP).select("mask", "block", "fp").sortWithinPartitions("mask", "block", "fp")
    deep = F.element_at(F.lit([x for s in second for x in s]), F.col("mask") * 56 + F.col("sub") + 1)
    high = (met.where(F.col("n") > GROUP).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(55))))
            .select((100 + F.col("mask") * 56 + F.col("sub")).alias("mask"), F.col("fp").bitwiseAND(deep).alias("block"), "fp"))
    high = high.repartition("mask", "block").sortWithinPartitions("mask", "block", "fp")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return close_pairs(batches, distance)

    return low.mapInPandas(find, schema).unionByName(high.mapInPandas(find, schema)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42, id_col: str = "doc_id",
                   text_col: str = "text", extra: list | None = None) -> DataFrame:
    """One row (fp, id_col, extra..., root, component_id) for every row of docs.

    Fingerprints at `distance` or fewer bits are linked; component_id is the smallest id reachable
    and root the smallest fingerprint.  Texts
    stay on the map side: only fingerprints are shuffled, each once however many documents carry it.

    Null, empty or blank text: fingerprint 0, linked like any other.  Null id: counts for no component_id
    (null if a component has no other id).  Repeated rows: one row each.  Empty table: no rows.
    `extra` names expressions over docs to carry along; other columns are not read.
    """
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    rows = keep(docs.select(F.col(id_col), prints(F.col(text_col)).alias("fp"), *(extra or [])))
    distinct = keep(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    near = connected(linked(distinct.select("fp"), distance))
    named = distinct.join(near, distinct["fp"] == near["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays.

    Among rows that share that id the one whose text has the smallest hash stays, once.  A group
    without any id keeps the text with the smallest hash.
    """
    rows, (key, text) = plain(docs, id_col, text_col)
    mark = F.xxhash64(text)
    groups = simhash_groups(rows, id_col=key, text_col=text, extra=[mark.alias("mark")], **kw)
    first = F.min(F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), "mark"))
    name = lambda c: F.to_json(F.struct(c.alias("id")))  # noqa: E731  never null, so a text moves once for join and duplicates
    winners = groups.groupBy("root").agg(first.alias("w")).select(name(F.col("w.id")).alias("name"), F.col("w.mark").alias("mark"))
    kept = rows.withColumns({"name": name(F.col(key)), "mark": mark}).join(winners, ["name", "mark"], "left_semi")
    return kept.dropDuplicates(["name", "mark"]).drop("name", "mark").select(*rows.columns).toDF(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
