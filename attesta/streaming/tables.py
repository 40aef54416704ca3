"""Keyed parquet tables that streams keep up to date, bucket by bucket."""
from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


class KeyedTable:
    """A parquet table cut into buckets by its key; a batch rewrites the buckets its keys fall into and no others.

    The files of a batch lie in v<number>/bucket=<n>, and a manifest with the batch's number says which version
    holds each bucket.  Readers take the newest manifest, which is written last, so they never see half
    a batch.  A batch replayed after a failure starts from the manifest before its own and overwrites its own
    files: every batch takes effect once.  Batch numbers belong to one stream: the table records the stream's
    checkpoint folder and takes no other.  Files stay until no one of the two newest manifests names them, so a running
    reader keeps its own.  The number of buckets is fixed by the first batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    # -------------------------------------------------------------- files
    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _put(self, text: str, *parts: str) -> None:
        """A small file, there as a whole or not at all."""
        path, fs = self._at(*parts)
        draft, _ = self._at(*parts[:-1], f".{parts[-1]}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(draft, path)

    def _get(self, *parts: str) -> str:
        path, _ = self._at(*parts)
        return "\n".join(r["value"] for r in self.spark.read.text(path.toString()).collect())

    # -------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("manifest") if n[:1] == "m")

    def manifest(self, before: int | None = None) -> dict | None:
        found = [v for v in self.versions() if before is None or v < before]
        return json.loads(self._get("manifest", f"m{found[-1]}")) if found else None

    def belongs_to(self, checkpoint: str) -> None:
        """Record the stream that keeps the table; a table another stream has kept is refused."""
        mark, fs = self._at("stream")
        if fs.exists(mark):
            owner = self._get("stream")
            if owner != checkpoint:
                raise ValueError(f"{self.path} is kept by the stream of {owner}, not of {checkpoint}")
        elif self.versions():
            raise ValueError(f"{self.path} holds versions of an unknown stream")
        else:
            self._put(checkpoint, "stream")

    def _files(self, manifest: dict, buckets: set[int] | None = None) -> list[str]:
        return [os.path.join(self.path, f"v{v}", f"bucket={b}") for b, v in sorted(manifest["at"].items())
                if buckets is None or int(b) in buckets]

    def read(self, before: int | None = None) -> DataFrame | None:
        manifest = self.manifest(before)
        files = self._files(manifest) if manifest else []
        return self.spark.read.parquet(*files) if files else None

    # -------------------------------------------------------------- writing
    def upsert(self, new: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], version: int,
               facts: Callable[[], dict] | None = None) -> set[int]:
        """Merge rows into the buckets of their keys and return these buckets.

        `merge` gets the rows of those buckets and the new ones; a key's result may depend on its own rows only.
        `facts` is called when the new rows have been computed; what it tells is added to the manifest.
        """
        before = self.manifest(version)
        n = before["buckets"] if before else self.buckets
        slot = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        held = new.withColumn("bucket", slot).persist()
        try:
            touched = {r["bucket"] for r in held.select("bucket").distinct().collect()}
            told = facts() if facts else {}
            at = dict(before["at"]) if before else {}
            if touched:
                files = self._files(before, touched) if before else []
                rows = held.drop("bucket")
                if files:
                    rows = merge(self.spark.read.parquet(*files), rows)
                (rows.withColumn("bucket", slot).repartition(len(touched), "bucket").write.mode("overwrite")
                 .partitionBy("bucket").parquet(os.path.join(self.path, f"v{version}")))
                written = {int(x.split("=")[1]) for x in self._names(f"v{version}") if x.startswith("bucket=")}
                at = {b: v for b, v in at.items() if int(b) not in touched} | {str(b): version for b in written}
        finally:
            held.unpersist()
        self._put(json.dumps({"buckets": n, "at": at, **told}), "manifest", f"m{version}")
        self._tidy()
        return touched

    def _tidy(self) -> None:
        kept = self.versions()[-2:]
        named = set(kept)
        for v in kept:
            named |= set(json.loads(self._get("manifest", f"m{v}"))["at"].values())
        for name in self._names():
            if name[:1] == "v" and int(name[1:]) not in named:
                path, fs = self._at(name)
                fs.delete(path, True)
        for v in self.versions()[:-2]:
            path, fs = self._at("manifest", f"m{v}")
            fs.delete(path, False)


def upsert_stream(rows: DataFrame, table: KeyedTable, keys: list[str], summarise: Callable[[DataFrame], DataFrame],
                  merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, time: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Keep a keyed table up to date: summarise each micro-batch, then merge it into the buckets it touches.

    With `time`, a timestamp column, every batch counts its rows, and those more than `late` behind the newest
    row of the batches before; such rows still take effect, as merges don't depend on order.  The counts so
    far stand in the manifest as rows and late.
    """
    table.belongs_to(checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        facts = None
        if time:
            before = table.manifest(batch_id) or {}
            newest = before.get("newest")
            behind = F.lit(False) if newest is None else F.col(time) < F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {late}")
            seen = Observation()
            batch = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(behind).alias("late"), F.max(F.unix_micros(time)).alias("newest"))

            def facts() -> dict:
                got = seen.get
                times = [t for t in (newest, got.get("newest")) if t is not None]
                return {"rows": before.get("rows", 0) + (got.get("rows") or 0), "late": before.get("late", 0) + (got.get("late") or 0),
                        "newest": max(times, default=None)}
        table.upsert(summarise(batch), keys, merge, batch_id, facts)

    return (rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
