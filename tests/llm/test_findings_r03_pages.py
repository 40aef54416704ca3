"""Repeated runs of a host whose pages are dealt to several slots."""
import random

from attesta.llm import html_extraction as H


def test_runs_are_counted_over_all_slots_of_a_host(spark):
    rng = random.Random(5)
    notes = [" ".join(f"n{k}w{j}" for j in range(rng.randint(8, 12))) for k in range(40)]
    rows = []
    for k in range(160):
        # every note stands on one to five pages of the host, wherever they are dealt to
        mine = " ".join(f"<p>{notes[j]}" for j in range(40) if k % 40 == j and k // 40 <= j % 5)
        own = " ".join(f"p{k}w{j}" for j in range(12))
        rows.append((k, f"https://big.test/{k}", f"<nav>{notes[k % 7]} home</nav><div>{mine}<p>{own}</div>" if k % 9 else f"<nav>{notes[k % 7]}</nav><article>{notes[k % 5]} {own}</article>"))
        rows.append((1000 + k, f"https://s{k}.test/", f"<div><p>{notes[0]}<p>{own}</div>"))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, "https://big.test/x", None), (None, "https://big.test/y", f"<p>{notes[39]}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda d: sorted(map(str, d.collect()))
    whole = key(H.main_texts(df, group=100_000))
    assert key(H.main_texts(df, group=20)) == whole == key(H.main_texts(df, group=1))
