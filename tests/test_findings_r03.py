"""Cases of the third review."""
from pyspark.sql import functions as F

from attesta.operators import captures as C, claims as Q, gates as G, votes as V


def test_merged_text_takes_one_text_of_a_url_read_twice(spark):
    long_, short = "Words of a page that was read. " * 20, "Words of a page. " * 20
    caps = spark.createDataFrame([("u", "jina", long_), ("u", "jina", short), ("u", "playwright", short)], "url string, engine string, text string")
    led = spark.createDataFrame([("u", "ok", ["docs"], "t"), ("v", "ok", ["docs"], "t")], "url string, status string, kinds array<string>, fetched_at string")
    got = [r["section"] for r in C.merged_text(caps, led).collect()]
    assert len(got) == 1 and "# Scrapers: jina,playwright\n" in got[0]


def test_lines_at_one_place_of_two_readings_have_a_settled_order(spark):
    rows = [("u", "jina", f"line number {k} of a reading") for k in range(8)]
    asked = spark.createDataFrame([(0, "u", "number")], "pid int, url string, pattern string")
    for order in (rows, rows[::-1]):
        caps = spark.createDataFrame(order, "url string, engine string, text string").coalesce(1)
        got = {r["nth"]: r["line"] for r in C.search_lines(caps, asked).collect()}
        assert [got[k] for k in sorted(got)] == [t for _, _, t in rows]


def test_probes_of_one_time_have_a_settled_order(spark):
    claims = spark.createDataFrame([("v", "f", 0, "https://a.test/x", "", "", "https://a.test")], "vendor string, field string, idx int, source_url string, quote string, statement string, vendor_url string")
    probes = [("https://a.test/x", 200, "https://a.test/x", "t"), ("https://a.test/x", 200, "https://b.test/", "t")]
    for order in (probes, probes[::-1]):
        p = spark.createDataFrame(order, "url string, http_status int, final_url string, probed_at string").coalesce(1)
        assert [r["detail"] for r in G.link_probes(claims, p).collect()] == ["redirected to another domain"]


def test_no_texts_meet_the_ledger_when_price_tokens_are_counted(spark):
    caps = spark.createDataFrame([("u", "jina", "from $5 or $6"), ("u", "jina", "$7"), ("w", "jina", "$8")], "url string, engine string, text string")
    led = spark.createDataFrame([("u", "a", ["pricing"]), ("w", "a", ["docs"]), ("w", "b", ["docs"])], "url string, vendor string, kinds array<string>")
    out = V.tokens_per_engine(caps, led)
    assert sorted(map(tuple, out.collect())) == [("a", "jina", 3), ("b", "jina", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan[:plan.index("Join")]


def test_files_of_a_site_hold_a_block_of_its_vendors(spark, monkeypatch):
    from attesta.plans import queries_files as Q
    d = "/root/testdata/sf0.001"
    whole = Q.file_claims(spark, d).collect()
    written, seen = Q._written, []
    monkeypatch.setattr(Q, "FILE_KEYS", 8)
    monkeypatch.setattr(Q, "_written", lambda s, rows: (seen.append(rows), written(s, rows))[1])
    assert sorted(map(tuple, Q.file_claims(spark, d).collect())) == sorted(map(tuple, whole))
    sizes = seen[0].select(F.regexp_count("json", F.lit('"core_features":')).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 8


def test_short_lines_go_before_they_are_cleaned(one):
    from attesta.functions import text as T
    text = "short\n" + "> A line  that is [long](http://x.test) enough to be quoted, see.\n" + "x" * 40 + "\n[" + "a" * 9 + "](" + "b" * 40 + ")"
    whole = one(lambda c: T.clean_lines(c), text)
    assert one(lambda c: T.clean_lines(c, 35), text) == [w for w in whole if w != "short"]


def test_stems_need_no_patterns(spark):
    import re
    from attesta import constants as K
    from attesta.functions import text as T
    words = "abciones xmente claramente hablando ando comiendo viagem oae aoes casas yes sss bbbs classes ações Été"
    df = spark.createDataFrame([(words,)], "t string").select(T.stem_signature(F.col("t")).alias("s"))

    def stem(w):
        for x in K.STEM_SUFFIXES:
            w = re.sub(f"^(.{{3,}}){x}$", r"\1", w)
        w = re.sub("[oae]+$", "", w) or w
        return re.sub("^(.{4,})s$", r"\1", w)
    plain = [w for w in re.findall("[a-z]{3,}", words.lower().replace("ç", "c").replace("õ", "o").replace("é", "e")) if w not in K.STEM_STOP]
    assert df.first()["s"] == sorted({stem(w) for w in plain} - set(K.STEM_STOP))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1


def test_a_url_twice_in_the_ledger_does_not_double_a_claim(spark):
    claims = spark.createDataFrame([("v", "strengths", 0, "https://a.test/pricing", "not there", "x", "https://b.test")],
                                   "vendor string, field string, idx int, source_url string, quote string, statement string, vendor_url string")
    led = spark.createDataFrame([("https://a.test/pricing", "ok"), ("https://a.test/pricing", "ok")], "url string, status string")
    caps = spark.createDataFrame([("https://a.test/pricing", "jina", "another text")], "url string, engine string, text string")
    got = sorted((r["gate"], r["severity"]) for r in G.claim_gates(claims, led, caps).collect())
    assert got == [("G2", "hard"), ("G6", "warning"), ("G7", "hard")]


def test_one_extractor_that_read_a_url_twice_is_one_witness(spark):
    v = spark.createDataFrame([("v", "u", ["jina"], 1, "2024-01-31 08:00 UTC"), ("w", "u", ["jina", "playwright"], 1, "2024-01-31 08:00 UTC")],
                              "vendor string, url string, engines array<string>, tiers int, scraped_at string")
    meta = spark.createDataFrame([("u", "jina", "h1"), ("u", "jina", "h2"), ("u", "playwright", "h1")], "url string, engine string, content_hash string")
    got = V.price_integrity(v, meta, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert [(r["vendor"], r["defect"]) for r in got.collect()] == [("v", "not independent")]


def test_phrases_of_any_length_are_found_without_pairing_them_with_texts(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "xalpha beta gammax", "one alphabet", "gamma  delta epsilon", "lpha beta", ""]
    phrases = ["alpha beta", "a b", "pha", "pha beta gam", "beta gamma delta epsi", "gamma delta epsilon", "z", "eta gamma", "no such thing at all", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([(p, p) for p in phrases], "item_id string, quote string")
    out = Q.find_phrases(asked, docs)
    flat = [" ".join(t.split()) for t in texts]
    assert {tuple(r) for r in out.collect()} == {(p, k) for p in phrases if p.strip() for k, t in enumerate(flat) if p in t}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_warnings_take_the_documents_once(spark):
    from attesta.plans import queries_reports as R
    out = R.evidence_warnings(spark, "/root/testdata/sf0.001")
    assert out.first()["no_sources"] is False
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
