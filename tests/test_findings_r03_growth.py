"""Work that used to grow with rows it did not need."""
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import documents as D, features as X


def test_documents_are_parsed_once(spark, capsys):
    docs = spark.createDataFrame([(1, '{"competitors": []}')], "id int, j string")
    D.walk(docs, "id", "j").select("path").explain()
    assert capsys.readouterr().out.count("Scan") == 1


def test_empty_values(spark):
    cases = {"null": True, "false": True, "true": False, "0": True, "-0.0": True, "0.00": True, "0.5": False, "10": False, '""': True, '" "': False, '"0"': False,
             '"null"': False, "[]": True, "[null]": False, "[[]]": False, "{}": True, '{"a": null}': False, '{"a": {}}': False, "0e5": True, "1e300": False}
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["e"] for r in rows.select("j", D.is_empty(F.parse_json("j")).alias("e")).collect()} == cases
    assert rows.select(D.is_empty(F.lit(None).cast("variant")).alias("e")).first()["e"]


def test_levels_keep_empty_containers_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, '{"a": [], "b": {}, "c": [[1], []]}'), (1, "x"), (None, "[]")], "id int, j string")
    got = sorted((str(r["id"]), r["path"], str(r["kind"])) for r in D.walk(docs, "id", "j").select("id", "path", "kind").collect())
    assert got == sorted([("1", "", "object"), ("1", "a", "array"), ("1", "b", "object"), ("1", "c", "array"), ("1", "c[0]", "array"), ("1", "c[0][0]", "number"),
                          ("1", "c[1]", "array"), ("1", "", "None"), ("None", "", "array")])


def test_stems_are_taken_of_distinct_names(spark, monkeypatch):
    calls, plain = spark.sparkContext.accumulator(0), T.stem_signature

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    monkeypatch.setattr(T, "stem_signature", lambda c: plain(counted(c)))
    cat = spark.range(4000).select(F.concat(F.lit("v"), F.col("id") % 7).alias("vendor"), F.col("id").alias("ord"),
                                   F.element_at(F.array(F.lit("shared inbox"), F.lit("inbox sharing"), F.lit("call summary")), (F.col("id") % 3 + 1).cast("int")).alias("name"))
    stops = spark.createDataFrame([], "token string")
    X.variant_groups(cat, stops).collect()
    X.canonical_names(cat, X.default_aliases(spark), fuzzy=True, stops=stops).collect()
    assert calls.value < 1000
