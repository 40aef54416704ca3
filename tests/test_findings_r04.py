"""What is sent and kept on the way to an answer is in proportion to the input."""
from attesta.operators import audit as A, claims as Q, gates as G
from attesta.plans import views as W


def test_phrases_of_a_scope_are_asked_in_its_texts_only(spark):
    texts = [("a", "One two three four five six seven eight nine ten"), ("b", "zero one two three four five six seven eight nine ten eleven"), ("a", "xone two, threes"),
             ("b", "three"), ("b", "five six seven eight nine"), ("a", "")]
    phrases = ["one two three four five six seven eight nine", "ne two three four five six seven eight n", "two three four five six seven", "hree four five si",
               "three four five", "four fiv", "one two", "three", "e", "no such"]
    docs = spark.createDataFrame([(k, d, t.lower()) for k, (d, t) in enumerate(texts)], "doc_id int, domain string, text string")
    asked = spark.createDataFrame([(f"{d} {p}", p, d) for d in "ab" for p in phrases], "item_id string, quote string, domain string")
    got = {tuple(r) for r in Q.find_phrases(asked, docs, "domain").collect()}
    assert got == {(f"{d} {p}", k) for p in phrases for k, (d, t) in enumerate(texts) if p in t.lower()}


SF = "/root/testdata/sf0.001"


def test_documents_are_not_dealt_out_again_after_each_join(spark):
    """What belongs to a key is gathered once and stays where the key has put it."""
    out = W.vendor_documents(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan
    keys = {r[0] for name, key in (("pages", "page_id"), ("documents", "doc_id div 4"), ("part", "p_partkey div 8"), ("benchmark", "item_id"))
            for r in W.table(spark, SF, name).selectExpr(key).where(f"{key} is not null").collect()}
    keys |= {r[0] for r in W.table(spark, SF, "conversations").where("role = 'user' and conv_id is not null").select("conv_id").collect()}
    assert sorted(r[0] for r in out.select("page_id").collect()) == sorted(keys)


def test_gates_and_audits_keep_a_quote_once(spark, monkeypatch):
    """Not what a claim states besides, not a second form of the quote, and no documents in which a line stands twice."""
    kept = []
    monkeypatch.setattr(Q, "settle", lambda df: kept.append(df.columns) or df)
    docs, caps = W.vendor_documents(spark, SF), W.captures(spark, SF)
    G.claim_gates(Q.flatten_claims(docs), W.ledger_pages(spark, SF), caps)
    A.quote_accuracy(docs, caps)
    assert len(kept) == 2 and not {"statement", "__q"} & {c for cols in kept for c in cols}
    assert set(kept[1]) == {"vendor", "source_url", "quote", "__h1", "__h2", "__blank"}
    monkeypatch.setattr(W, "settle", lambda df: kept.append(df.columns) or df)
    W.vendor_documents(spark, SF, kept=True)
    assert "docs" in kept[2] and "strengths" not in kept[2]
