"""Repeated stretches of bytes by prefix doubling: ranks of sampled places, paired with what follows at growing lengths."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.common import keep, plain, table

LEAST = 400                   # bytes of the shortest repeated stretch
WAYS = 7                      # a round leaves a seventh of the bytes open that a rank does not cover yet
CHUNK = 1 << 20               # places a task works on at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def span_of(least: int) -> int:
    """How many places of a window may hold its sampled place: the largest power of WAYS that leaves a gram of 8 bytes."""
    if least < 1:
        raise ValueError("a stretch has a byte at least")
    span = 1
    while span * WAYS <= least - 8:
        span *= WAYS
    return span


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of `gram` bytes, by sums of powers."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    steps = np.full(len(data), _ODD)
    steps[0] = 1
    power = np.multiply.accumulate(steps)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    steps[:] = np.uint64(pow(int(_ODD), -1, 1 << 64))
    steps[0] = 1
    h = (sums[gram:] - sums[:n]) * np.multiply.accumulate(steps)[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of `width` values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:len(values)] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def sampled(data: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, gram hash) of the sampled places of texts data[start:stop].

    Every window of `least` bytes samples the place of its least gram, the first one of equals.  So equal
    windows sample the same place inside them, wherever they stand, and the windows of a place are neighbours.
    """
    span = span_of(least)
    gram = least - span + 1
    total = len(data)
    found = []
    opens = np.zeros(total + 1, np.int8)
    for s, e in zip(start.tolist(), stop.tolist()):
        if e - s >= least:
            opens[s:e - least + 1] = 1
    for at in range(0, max(total - least + 1, 0), CHUNK):
        h = gram_hashes(data[at:at + CHUNK + least - 1], gram)
        windows = np.flatnonzero(opens[at:at + min(CHUNK, len(h) - span + 1)])
        if not len(windows):
            continue
        low = np.uint64(0xFFFFFFFF)
        least_at = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), span)[windows] & low
        cut = np.flatnonzero(np.r_[True, least_at[1:] != least_at[:-1]])
        place = least_at[cut].astype(np.int64)
        last = windows[np.r_[cut[1:] - 1, len(windows) - 1]]
        found.append((place + at, windows[cut] + at, last + at, h[place]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    place, first, last, h = (np.concatenate([f[k] for f in found]) for k in range(4))
    # a place whose windows were cut by a chunk's end is one place
    new = np.r_[True, place[1:] != place[:-1]]
    end = np.r_[new[1:], True]
    return place[new], first[new], last[end], h[new]


def _texts(batches: Iterator[pd.DataFrame], size: int = 4 << 20) -> Iterator[tuple]:
    """(rows, bytes, starts, stops) of groups of texts of about `size` bytes."""
    for batch in batches:
        texts = batch["text"].tolist()
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= size):
                held += len(texts[to])
                to += 1
            stop = np.cumsum([len(t) for t in texts[at:to]], dtype=np.int64)
            start = np.r_[np.int64(0), stop[:-1]]
            yield batch.iloc[at:to], b"".join(texts[at:to]), start, stop
            at = to


def grams(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """How often each gram is sampled: the first ranks."""
    for _, data, start, stop in _texts(batches):
        h = sampled(np.frombuffer(data, np.uint8), start, stop, least)[3]
        rank, n = np.unique(h, return_counts=True)
        yield pd.DataFrame({"rank": rank.view(np.int64), "n": n})


def places(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """A row for each sampled place: text, place, how far its windows reach to the left, rank and the hash of all its windows."""
    for rows, data, start, stop in _texts(batches):
        place, first, last, h = sampled(np.frombuffer(data, np.uint8), start, stop, least)
        view = memoryview(data)
        hulls = b"".join([xxhash.xxh3_128_digest(view[f:e + least]) for f, e in zip(first.tolist(), last.tolist())])
        pair = np.frombuffer(hulls, np.int64).reshape(-1, 2)
        owner = np.searchsorted(stop, place, side="right")
        lo, hi = place - last, place - first
        # the reach is part of the hash: equal hashes are equal bytes around the same place
        salt = ((lo * 65_537 + hi).astype(np.uint64) * _ODD).view(np.int64)
        yield pd.DataFrame({"t1": rows["t1"].to_numpy()[owner], "t2": rows["t2"].to_numpy()[owner], "place": place - start[owner],
                            "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "rank": h.view(np.int64),
                            "h1": pair[:, 0] ^ salt, "h2": pair[:, 1]})


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t1, t2, who, text): the 128-bit name of a text, a hash of the row's id, and the bytes."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"),
                       F.xxhash64(F.col(id_col)).alias("who"), text.alias("text"))


def _children(rows: DataFrame, width: int, least: int) -> DataFrame:
    """The next ranks of rows(h1, h2, n, lo, hi, ctx, at, rank), whose rank covers what windows at..at+WAYS*width-1 share.

    A place goes into each seventh of these windows that has windows of its own.  The new rank is that of the
    pair (rank so far, what the shared stretch grows by); u1, u2 name all bytes of the place's windows there.
    """
    whole = width * WAYS

    def child(k):
        at = F.col("at") + k * width
        lo, hi = F.greatest(at, F.col("lo")), F.least(at + (width - 1), F.col("hi"))
        left = F.substring("ctx", F.col("hi") - at + 1, at - F.col("at"))
        right = F.substring("ctx", F.col("hi") + least - F.col("at") - (whole - 1) + 1, F.col("at") + whole - width - at)
        hull = F.substring("ctx", F.col("hi") - hi + 1, hi - lo + least)
        return F.when(lo <= hi, F.struct(
            at.alias("at"), lo.alias("from"), hi.alias("to"), F.xxhash64("rank", at, left, right).alias("rank"),
            F.xxhash64(F.lit(1), lo, hi, hull).alias("u1"), F.xxhash64(F.lit(2), lo, hi, hull).alias("u2")))

    parts = F.filter(F.array(*[child(k) for k in range(WAYS)]), lambda c: c.isNotNull())
    return rows.select("h1", "h2", "n", F.explode(parts).alias("c")).select("h1", "h2", "n", "c.*")


def repeated_spans(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t1, t2, start, stop): stretches of the texts named t1, t2 that windows of `least` bytes cover which also start elsewhere.

    Every window has one sampled place, so windows are equal if the bytes around their places are.  Rank 0 of
    a place is its gram; places with a rank of their own leave.  Places that are alike over all their windows
    settle at once, however many there are, and one of them stands for all.  For the rest the windows are cut
    into sevenths round by round: the rank of a place and a seventh covers what its windows share, which grows
    towards `least`; unique ranks leave, ranks without two different surroundings are settled, and in the last
    round a rank covers a whole window.  Only hashes and places are sorted; of the bytes only the surroundings
    of places that are still open move, once a round.
    """
    span = span_of(least)
    texts = _named(docs, id_col, text_col).where(F.octet_length("text") >= least)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return grams(batches, least)

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return places(batches, least)

    ranks = texts.select("text").mapInPandas(first, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n"))
    rows = texts.select("t1", "t2", "text").mapInPandas(
        every, "t1 bigint, t2 bigint, place bigint, lo int, hi int, rank bigint, h1 bigint, h2 bigint")
    # what a join meets is written before, so the rows of a frequent rank can be split while they are joined
    met = keep(rows.join(keep(ranks.where("n > 1").select("rank")), "rank"))

    alike = keep(met.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("rank", "t1", "t2", "place", "lo", "hi")]))
    settled = (met.join(alike.where("n > 1").select("h1", "h2"), ["h1", "h2"])
               .select("t1", "t2", (F.col("place") - F.col("hi")).alias("start"), (F.col("place") - F.col("lo") + least).alias("stop")))
    if span == 1:
        return settled

    mixed = alike.groupBy("rank").agg(F.count("*").alias("ways"), F.count_if(F.col("n") == 1).alias("single")).where("ways > 1 AND single > 0")
    open_ = keep(alike.join(keep(mixed.select("rank")), "rank"))
    spots = open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("h1", "h2", "n", "rank", "place", "lo", "hi")).alias("spots"))
    # of the rows with a text one, that with the least hash of its id, gives the bytes
    asked = texts.select("t1", "t2", "who").join(spots.select("t1", "t2"), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("who").alias("who"))
    around = F.transform("spots", lambda s: F.struct(
        s["h1"].alias("h1"), s["h2"].alias("h2"), s["n"].alias("n"), s["rank"].alias("rank"), s["lo"].alias("lo"), s["hi"].alias("hi"),
        F.substring("text", (s["place"] - s["hi"] + 1).cast("int"), s["hi"] - s["lo"] + least).alias("ctx")))
    surroundings = keep(texts.join(spots.join(asked, ["t1", "t2"]), ["t1", "t2", "who"])
                        .select(F.explode(around).alias("s")).select("s.*").dropDuplicates(["h1", "h2"]))

    level = surroundings.withColumn("at", F.lit(0))
    width = span // WAYS
    hits = None
    while True:
        near = keep(_children(level, width, least))
        same = near.groupBy("rank", "u1", "u2").agg(F.sum("n").alias("all"), *[F.first(c).alias(c) for c in ("h1", "h2", "at")])
        same = keep(same)
        hit = (near.where("n = 1").join(same.where(F.col("all") > 1).select("rank", "u1", "u2"), ["rank", "u1", "u2"])
               .select("h1", "h2", "from", "to"))
        hits = hit if hits is None else hits.unionByName(hit)
        if width == 1:
            break
        more = same.groupBy("rank").agg(F.count("*").alias("ways"), F.count_if(F.col("all") == 1).alias("single")).where("ways > 1 AND single > 0")
        left = same.join(keep(more.select("rank")), "rank").select("h1", "h2", F.col("all").alias("n"), "rank", "at")
        level = left.join(surroundings.select("h1", "h2", "lo", "hi", "ctx"), ["h1", "h2"])
        width //= WAYS
    found = hits.join(open_.select("h1", "h2", "t1", "t2", "place"), ["h1", "h2"]).select(
        "t1", "t2", (F.col("place") - F.col("to")).alias("start"), (F.col("place") - F.col("from") + least).alias("stop"))
    return settled.unionByName(found)


def union_of(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by their start; intervals that touch are one run."""
    reach = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:] - 1, len(stop) - 1]]


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and a column `dedup`: n_bytes, n_removed, spans (start, stop; of bytes removed) and kept (the remaining bytes).

    A byte goes if a string of `least` bytes that covers it also starts anywhere else, in the same text or
    another row's, as the texts are given; so of several copies none stays.

    Null text: as an empty one.  Texts shorter than `least`: kept whole.  Null ids, ties: an id only helps to
    pick one of the rows with a text.  Repeated rows: copies of each other.  Empty table: no rows.  Other
    columns, of any name but `dedup`, are kept as they are; a column named `dedup` is an error.
    """
    if "dedup" in docs.columns:
        raise ValueError("docs has a column named dedup")
    spans = repeated_spans(docs, least, id_col, text_col).groupBy("t1", "t2", "start").agg(F.max("stop").alias("stop"))
    runs = F.sort_array(F.collect_list(F.struct("start", "stop")))
    spans = spans.groupBy("t1", "t2").agg(runs.alias("r"))

    @F.pandas_udf("struct<n_bytes: bigint, n_removed: bigint, spans: array<struct<start: bigint, stop: bigint>>, kept: binary>")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for text, start, stop in zip(texts, starts, stops):
            if start is None or not len(start):
                out.append((len(text), 0, [], text))
                continue
            start, stop = union_of(np.asarray(start, np.int64), np.asarray(stop, np.int64))
            s, e = start.tolist(), stop.tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)]))
            out.append((len(text), len(text) - len(kept), [{"start": a, "stop": b} for a, b in zip(s, e)], kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    rows, (key,) = plain(docs, text_col)
    text = F.coalesce(F.col(key).cast("binary"), F.lit(b""))
    named = rows.withColumns({"n1": F.xxhash64(F.lit(1), text), "n2": F.xxhash64(F.lit(2), text)})
    joined = named.join(spans, (F.col("n1") == F.col("t1")) & (F.col("n2") == F.col("t2")), "left")
    return joined.withColumn("dedup", cut(text, F.col("r.start"), F.col("r.stop"))).select(*rows.columns, "dedup").toDF(*docs.columns, "dedup")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the strings of 400 bytes that stand anywhere twice."""
    d = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"),
                    F.sha2("dedup.kept", 256).alias("kept_sha256"))
