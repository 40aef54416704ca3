"""Price cache with a lifetime as a stream: the same answers as `votes.cached_fallback`, by state that expires in event time."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attesta import constants as K

# the state's code travels with the query, so executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_US = 86_400_000_000
EVENTS = "event string, id string, domain string, at timestamp, cached_url string, cached_at timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastingPrices(StatefulProcessor):
    """Per key the newest cached price and the rows whose time the watermark has not passed yet.

    A row waits until no earlier one can come any more; then entries and requests take effect in the order of
    their times, an entry before a request of the same time.  Two timers at most are due: the time of the
    first waiting row and the end of the entry's life.  An entry leaves the state when its life is over.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "cached_us bigint, url string")
        self.waiting = handle.getListState("waiting", "at_us bigint, side int, name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            new = [(int(a), int(s), n) for a, s, n in zip(part["at_us"], part["side"], part["name"])]
            if new:
                self.waiting.appendList(new)
                least = min(new)[0]
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(a), int(s), n) for a, s, n in self.waiting.get()) if self.waiting.exists() else []
        ready = [w for w in held if w[0] < passed]
        rest = held[len(ready):]
        entry = self.entry.get() if self.entry.exists() else None
        entry = (int(entry[0]), entry[1]) if entry else None
        out = []
        for at, side, name in ready:
            if side == 0:
                entry = (at, name)
            elif entry and at - entry[0] <= self.ttl_us:
                out.append(("hit", name, key[0], at, entry[1], entry[0]))
        if entry and passed > entry[0] + self.ttl_us:
            if key[1] == 0:
                out.append(("expired", None, key[0], entry[0] + self.ttl_us, entry[1], entry[0]))
            entry = None
        if ready:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000)
            else:
                self.waiting.clear()
        if entry:
            self.entry.update(entry)
            self.handle.registerTimer((entry[0] + self.ttl_us) // 1000 + 1)
        else:
            self.entry.clear()
        if out:
            frame = pd.DataFrame(out, columns=["event", "id", "domain", "at", "cached_url", "cached_at"])
            for c in ("at", "cached_at"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            yield frame
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def cache_events(entries: DataFrame, wanted: DataFrame, ttl_days: int = K.TTL_DAYS, late: str = "1 hour", lanes: int = 1) -> DataFrame:
    """(event, id, domain, at, cached_url, cached_at) as a stream: a hit for every request the cache answers, and expired entries.

    entries(domain, url, engines, cached_at) and wanted(id, domain, at) are streams.  A request is answered by
    the newest entry of its domain that is not after it and at most ttl_days old; entries with fewer than two
    engines do not count.  Rows more than `late` behind the newest are dropped.  A busy domain's requests are dealt
    to `lanes` states of their own, each of which holds the domain's entry; then its expiry is told by lane 0.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    stored = (entries.where(F.col("engines") >= 2).select("domain", F.col("cached_at").alias("at"), F.lit(0).alias("side"), F.col("url").alias("name"))
              .withColumn("lane", spread))
    asked = wanted.select("domain", "at", F.lit(1).alias("side"), F.col("id").cast("string").alias("name"))
    asked = asked.withColumn("lane", F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int"))
    rows = stored.unionByName(asked).withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    keyed = rows.groupBy("domain", "lane")
    return keyed.transformWithStateInPandas(statefulProcessor=LastingPrices(ttl_days * DAY_US), outputStructType=EVENTS,
                                            outputMode="append", timeMode="eventTime")


def stream_price_cache(spark: SparkSession, entries: DataFrame, wanted: DataFrame, out: str, checkpoint: str,
                       ttl_days: int = K.TTL_DAYS, late: str = "1 hour", lanes: int = 1) -> StreamingQuery:
    """cache_events written to a folder; a restart from the checkpoint goes on where the last run stopped.

    The state lives in RocksDB, whose provider the session has to name.
    """
    if spark.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    events = cache_events(entries, wanted, ttl_days, late, lanes)
    return (events.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
