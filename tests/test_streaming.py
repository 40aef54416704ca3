"""Stream results equal batch results on the same rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators.captures import build_ledger
from attesta.operators.votes import cached_fallback
from attesta.streaming import cache as C, jobs as J
from attesta.streaming.tables import KeyedTable

T0 = dt.datetime(2024, 1, 1)


def staged(spark, df, path, parts=3):
    """Rows written as several files in row order, read back one file per micro-batch."""
    top = df.agg(F.max("seq")).first()[0] + 1
    for k in range(parts):
        df.where((F.col("seq") * parts >= k * top) & (F.col("seq") * parts < (k + 1) * top)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(q):
    assert q.awaitTermination(120)


def test_stats_stream(spark, tmp_path):
    rnd = random.Random(1)
    data = [(i, f"e{rnd.randint(0, 2)}", "docs", rnd.random() < .7, round(rnd.random(), 2), T0 + dt.timedelta(hours=i)) for i in range(200)]
    log = spark.createDataFrame(data, "seq int, engine string, url_type string, success boolean, quality double, ts timestamp")
    # a last row far ahead closes every window before it
    end = spark.createDataFrame([(999, "end", "docs", True, 1.0, T0 + dt.timedelta(days=60))], log.schema)
    stream = staged(spark, log.unionByName(end), str(tmp_path / "in"))
    run(J.stream_stats(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    key = lambda d: sorted((str(r["start"]), r["engine"], r["n"], r["ok"], round(r["q_sum"], 6)) for r in d.collect())
    batch = J.windowed_stats(log, "1 day").select(F.col("window.start").alias("start"), "engine", "n", "ok", "q_sum")
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_lessons_stream(spark, tmp_path):
    rnd = random.Random(2)
    data = [(i, f"d{rnd.randint(0, 3)}", rnd.choice("ab"), rnd.choice(["", "h1", "h2"]), T0 + dt.timedelta(minutes=rnd.randint(0, 500))) for i in range(120)]
    log = spark.createDataFrame(data, "seq int, domain string, issue string, hint string, seen_at timestamp")
    table = KeyedTable(spark, str(tmp_path / "t"))
    run(J.stream_lessons(staged(spark, log, str(tmp_path / "in")), table, str(tmp_path / "cp")))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, J.merge_lessons(log).collect()))


def test_replayed_batch_counts_once(spark, tmp_path):
    log = spark.createDataFrame([(1, "d", "a", "h", T0)], "seq int, domain string, issue string, hint string, seen_at timestamp")
    table = KeyedTable(spark, str(tmp_path / "t"))
    for _ in range(2):
        table.upsert(J.merge_lessons(log), ["domain", "issue"], J.combine_lessons, 1)
    assert table.read().first()["runs_seen"] == 1
    for _ in range(3):
        table.upsert(J.merge_lessons(log), ["domain", "issue"], J.combine_lessons, 2)
    assert table.read().first()["runs_seen"] == 2 and table.read(before=2).first()["runs_seen"] == 1


def bucket_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.glob("v*/bucket=*/part-*")}


def test_batch_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    schema = "seq int, domain string, issue string, hint string, seen_at timestamp"
    many = spark.createDataFrame([(k, f"d{k}", "a", "h", T0) for k in range(300)], schema)
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    assert len(table.upsert(J.merge_lessons(many), ["domain", "issue"], J.combine_lessons, 0)) == 16
    first = bucket_files(tmp_path / "t")
    one = spark.createDataFrame([(1, "d7", "a", "later", T0 + dt.timedelta(days=1))], schema)
    assert len(table.upsert(J.merge_lessons(one), ["domain", "issue"], J.combine_lessons, 1)) == 1
    second = bucket_files(tmp_path / "t")
    assert {k: v for k, v in second.items() if k in first} == first and {k.split("/")[0] for k in set(second) - set(first)} == {"v1"}
    assert len(set(second) - set(first)) == 1
    rows = {r["domain"]: (r["runs_seen"], r["hint"]) for r in table.read().collect()}
    assert len(rows) == 300 and rows.pop("d7") == (2, "later") and set(rows.values()) == {(1, "h")}
    # a third and fourth version let go of files no manifest names any more
    for v in (2, 3):
        table.upsert(J.merge_lessons(one), ["domain", "issue"], J.combine_lessons, v)
    assert table.versions() == [2, 3] and {k.split("/")[0] for k in bucket_files(tmp_path / "t")} == {"v0", "v2", "v3"}
    assert table.read().count() == 300


def test_merge_may_empty_a_bucket(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read() is None
    table.upsert(rows, ["key"], lambda old, new: new, 0)
    table.upsert(rows.where("key = 'a'"), ["key"], lambda old, new: old.unionByName(new).where("key <> 'a'"), 1)
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]
    table.upsert(rows.limit(0), ["key"], lambda old, new: new, 2)
    assert table.read().count() == 1


def test_late_rows_are_counted(spark, tmp_path):
    hours = [0, 10, 20, 21, 3, 20, 22, 2]
    log = spark.createDataFrame([(k, f"d{k}", "a", "h", T0 + dt.timedelta(hours=h)) for k, h in enumerate(hours)],
                                "seq int, domain string, issue string, hint string, seen_at timestamp")
    table = KeyedTable(spark, str(tmp_path / "t"))
    run(J.stream_lessons(staged(spark, log, str(tmp_path / "in"), 2), table, str(tmp_path / "cp"), late="2 hours"))
    told = table.manifest()
    assert (told["rows"], told["late"]) == (8, 2) and table.read().count() == 8


def test_ledger_drops_what_comes_again(spark, tmp_path):
    schema = "seq int, vendor string, url string, kind string, engine string, success boolean, text string, fetched_at string, from_cache boolean, error string"
    rows = [(i, "v", f"u{i % 5}", "docs", f"e{i % 2}", True, f"text {i % 5}", f"2024-01-01 0{i // 10}:00 UTC", False, None) for i in range(30)]
    log = spark.createDataFrame(rows, schema)
    table = KeyedTable(spark, str(tmp_path / "t"))
    run(J.stream_ledger(staged(spark, log, str(tmp_path / "in")), table, str(tmp_path / "cp"), once_within="5 hours"))
    assert table.manifest()["rows"] == 10 and table.read().count() == 5


def test_ledger_stream(spark, tmp_path):
    schema = "seq int, vendor string, url string, kind string, engine string, success boolean, text string, fetched_at string, from_cache boolean, error string"
    data = [(i, "v", f"u{i % 5}", "docs" if i % 2 else "pricing", f"e{i % 3}", i % 4 != 0, f"text {i}" if i % 4 else None, f"2024-01-{i + 1:02d} 00:00 UTC", False, None) for i in range(28)]
    log = spark.createDataFrame(data, schema)
    table = KeyedTable(spark, str(tmp_path / "t"))
    run(J.stream_ledger(staged(spark, log, str(tmp_path / "in")), table, str(tmp_path / "cp")))
    key = lambda d: sorted((r["url"], r["status"], tuple(r["kinds"]), str(sorted(r["engines"].items()))) for r in d.collect())
    assert key(table.read()) == key(build_ledger(log))


def test_cache_stream(spark, tmp_path):
    data = [(i, f"d{i % 4}", f"u{i}", 1 + i % 3, T0 + dt.timedelta(days=i if i % 4 else i / 10)) for i in range(32)]
    log = spark.createDataFrame(data, "seq int, domain string, url string, engines int, cached_at timestamp")
    table = KeyedTable(spark, str(tmp_path / "t"))
    run(J.stream_cache(staged(spark, log, str(tmp_path / "in")), table, str(tmp_path / "cp")))
    got = {r["domain"]: r["url"] for r in J.read_cache(table).collect()}
    newest = max(d[4] for d in data if d[3] >= 2)
    want = {}
    for d in data:
        if d[3] >= 2 and (d[1] not in want or d[4] > want[d[1]][4]):
            want[d[1]] = d
    assert got == {k: v[2] for k, v in want.items() if v[4] >= newest - dt.timedelta(days=14)}


def test_keyed_table_refuses_another_stream(spark, tmp_path):
    data = [(i, "d", f"u{i}", 2, T0 + dt.timedelta(hours=i)) for i in range(8)]
    log = spark.createDataFrame(data, "seq int, domain string, url string, engines int, cached_at timestamp")
    table = KeyedTable(spark, str(tmp_path / "t"))
    src = staged(spark, log, str(tmp_path / "in"))
    run(J.stream_cache(src, table, str(tmp_path / "cp")))
    assert len(table.versions()) <= 2 and table.read().first()["url"] == "u7"
    run(J.stream_cache(src, table, str(tmp_path / "cp")))
    with pytest.raises(ValueError):
        J.stream_cache(src, table, str(tmp_path / "other"))


def test_run_time_stream(spark, tmp_path):
    data = [(i, f"v{i % 2}", 40.0, T0 + dt.timedelta(minutes=5 * i + (300 if i >= 12 else 0))) for i in range(20)]
    log = spark.createDataFrame(data + [(99, "end", 1.0, T0 + dt.timedelta(days=30))], "seq int, vendor string, seconds double, ts timestamp")
    run(J.stream_run_time(staged(spark, log, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 200.0))
    got = sorted((r["vendor"], r["pages"], r["over_budget"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("v0", 4, False), ("v0", 6, True), ("v1", 4, False), ("v1", 6, True)]


# ------------------------------------------------------------------ price cache with a lifetime
@pytest.fixture
def rocks(spark):
    spark.conf.set(C.STORE, C.ROCKS)
    yield
    spark.conf.unset(C.STORE)


def cache_input(spark, tmp_path, extra=()):
    """Entries and requests over 80 days in four pairs of files by time, and a last pair that lets all time pass."""
    rnd = random.Random(1)
    far = T0 + dt.timedelta(days=400)
    ent = sorted(((f"d{rnd.randint(0, 4)}", f"u{i}", rnd.randint(1, 4), T0 + dt.timedelta(hours=rnd.randint(0, 1900), minutes=rnd.randint(0, 59)))
                  for i in range(80)), key=lambda r: r[3])
    req = sorted(((i, f"d{rnd.randint(0, 5)}", T0 + dt.timedelta(hours=rnd.randint(0, 1950))) for i in range(200)), key=lambda r: r[2])
    req += [(1000 + i, e[0], e[3]) for i, e in enumerate(ent[::9])]  # asked at the very time of an entry
    entries = spark.createDataFrame(ent, "domain string, url string, engines int, cached_at timestamp")
    wanted = spark.createDataFrame(req, "id long, domain string, at timestamp")
    cuts = [T0, ent[20][3], ent[40][3], ent[60][3], far]
    for k in range(4):
        entries.where(F.col("cached_at").between(cuts[k], cuts[k + 1] - dt.timedelta(seconds=1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        some = wanted.where(F.col("at").between(cuts[k], cuts[k + 1] - dt.timedelta(seconds=1)))
        if k == 3 and extra:
            some = some.unionByName(spark.createDataFrame(list(extra), wanted.schema))
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    return entries, wanted, far


def cache_streams(spark, tmp_path, entries, wanted):
    read = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    return read(entries, "e"), read(wanted, "r")


@pytest.mark.parametrize("lanes", [1, 3])
def test_cache_answers_like_the_batch(spark, tmp_path, rocks, lanes):
    """Hits, expiry, a restart in the middle, and rows that come too late."""
    late = [(5000, "d1", T0 + dt.timedelta(hours=30)), (5001, "d2", T0 + dt.timedelta(hours=31))]
    entries, wanted, far = cache_input(spark, tmp_path, late)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    es, rs = cache_streams(spark, tmp_path, entries, wanted)
    first = cache_run(spark, es, rs, out, cp, lanes)
    # the second run finds the state of the first; its file lets all time pass
    spark.createDataFrame([("zz", "z", 2, far)], entries.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    spark.createDataFrame([(-1, "zz", far)], wanted.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    before = spark.read.parquet(out).count()
    second = cache_run(spark, es, rs, out, cp, lanes)
    rows = spark.read.parquet(out)
    assert rows.count() > before > 0
    hits = sorted(map(tuple, rows.where("event = 'hit'").select("id", "domain", "at", "cached_url", "cached_at").collect()))
    want = sorted((str(r["id"]), r["domain"], r["at"], r["cached_url"], r["cached_at"]) for r in cached_fallback(wanted, entries).collect())
    assert hits == want and len(want) > 50
    last = {r["domain"]: r["at"] for r in entries.where("engines >= 2").groupBy("domain").agg((F.max("cached_at") + F.expr("INTERVAL 14 DAYS")).alias("at")).collect()}
    gone = rows.where("event = 'expired'").groupBy("domain").agg(F.max("at").alias("at"), F.count("*").alias("n")).collect()
    assert {r["domain"]: r["at"] for r in gone} == last
    dropped = sum(o["numRowsDroppedByWatermark"] for q in (first, second) for p in q.recentProgress for o in p["stateOperators"])
    assert dropped == len(late)


def cache_run(spark, es, rs, out, cp, lanes):
    query = C.stream_price_cache(spark, es, rs, out, cp, late="2 hours", lanes=lanes)
    run(query)
    return query


def test_cache_needs_its_state_store(spark, tmp_path):
    entries, wanted, _ = cache_input(spark, tmp_path)
    with pytest.raises(ValueError):
        C.stream_price_cache(spark, *cache_streams(spark, tmp_path, entries, wanted), str(tmp_path / "o"), str(tmp_path / "cp"))
