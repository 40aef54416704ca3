"""Licenses, quality rules, secrets and pages against plain loops."""
import base64
import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import html_extraction as H, licenses as L, quality as Q, secrets as S

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_rows(spark, monkeypatch, df):
    monkeypatch.setattr(L, "table", lambda *_: df)
    return L.op1_licenses(spark, "").collect()


def test_licenses_match_a_plain_search(spark, monkeypatch, documents, texts):
    rows = license_rows(spark, monkeypatch, documents)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrase_places(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_licenses_spans_bend_but_short_notices_do_not(spark, monkeypatch):
    gpl = L.NOTICES["gpl-notice"].split()
    cases = {1: "CC-BY and cc by, the MIT License; mit license", 2: " ".join(gpl[:10] + ["extra"] + gpl[10:16] + gpl[18:]),
             3: "Licensed under CC BY-NC 4.0.", 4: "gnu general public", 5: "licensed under cc by sa nc 4 0"}
    rows = {r.doc_id: r for r in license_rows(spark, monkeypatch, spark.createDataFrame(list(cases.items()), "doc_id long, text string"))}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (4, 0, 8, "cc-by,mit")
    assert rows[2].labels == "gpl,gpl-notice" and rows[2].score == 1
    assert rows[3].labels == "cc-by,cc-by-nc-4.0"
    assert rows[4].labels == "" and 0 < rows[4].score < 1
    assert rows[5].labels == "cc-by"


def test_licenses_odd_rows(spark, monkeypatch, odd, none):
    rows = license_rows(spark, monkeypatch, odd.withColumn("text", F.when(F.col("doc_id") == 6, "mit license").otherwise(F.col("text"))))
    assert len(rows) == odd.count()
    assert [r.n_base for r in rows if r.doc_id == 6] == [1, 1, 1]
    assert all(r.n_words == 0 and r.labels == "" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert license_rows(spark, monkeypatch, none) == []


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_plain_loops(texts):
    more = ["a b c d e f g h " * 5, "x " * 40, "l\nl\n \nl", "", None, "a b c d e f g h i a b c d e f g h"]
    for t in [*texts.values(), *more]:
        assert Q.statistics(t)[:5] == plain_stats(t)


def test_rules_find_planted_conditions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.95)
    names = ["words", "symbol_share", "top_share"]
    rules = Q.learn(x[:2000], bad[:2000], names)
    guess = np.zeros(1000, bool)
    for r in rules:
        guess |= Q.covered(r, x[2000:], names)
    assert (guess == bad[2000:]).mean() > 0.96
    assert Q.learn(x, np.zeros(3000, bool), names) == [] and Q.learn(x[:0], bad[:0], names) == []


def test_quality_verdicts_hold_out(spark):
    """Labels the rules were not fitted on: a third of them, by id."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = Q.with_quality(docs, labels.where("doc_id % 3 <> 0"))
    got = q.join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    good, bad = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, True), 0) >= 0.98 * good and n.get((0, False), 0) >= 0.9 * bad


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 0), (5, None)], "doc_id long, quality int")
    rows = Q.with_quality(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 7))
    kept = Q.filter_quality(odd, labels)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 1").count() == 0
    assert kept.where("doc_id = 4").first()["stat"] == 2
    assert Q.with_quality(none, labels).count() == 0 and Q.filter_quality(none, labels.where("false")).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


RSA = der(0x30, b"".join(der(2, b) for b in (b"\0", b"\x7f" * 64, b"\1\0\1", b"\x11" * 64, b"\x22" * 32, b"\x23" * 32, b"\x24" * 32, b"\x25" * 32, b"\x26" * 32)))
EC = der(0x30, der(2, b"\1") + der(4, b"\xab" * 32))


def ssh(text):
    return len(text).to_bytes(4, "big") + text


SSH = b"openssh-key-v1\0" + ssh(b"none") + ssh(b"none") + ssh(b"") + (1).to_bytes(4, "big") + ssh(b"p" * 51) + ssh(b"q" * 136)


def url64(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def test_secrets_confirm_structure():
    jwt = f"{url64(json.dumps({'alg': 'HS256'}).encode())}.{url64(b'{}')}.{url64(b's' * 32)}"
    no_alg = f"{url64(json.dumps({'typ': 'x'}).encode())}.{url64(b'{}')}.c2ln"
    b64 = base64.b64encode(RSA).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(RSA).decode()}-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [s[0] for s in S.find(t)]
    assert kinds(f"see {jwt}.") == ["jwt"] and kinds(no_alg) == []
    assert kinds(f"k {b64} k") == ["der-key"] and kinds(f"é {EC.hex().upper()}") == ["der-key"]
    assert kinds(f"x {base64.b64encode(SSH).decode()}") == ["openssh-key"]
    assert kinds(pem) == ["pem-key"] and kinds(pem.replace("M", "N", 1)) == []
    assert kinds("k " + base64.b64encode(RSA[:-1]).decode()) == []
    assert kinds("k " + base64.b64encode(b64.encode()).decode()) == ["der-key"]
    assert kinds("k " + base64.b64encode(b"just a long english sentence, nothing else").decode()) == []
    start = S.find(f"漢字 {jwt}")[0][1:3]
    assert start == (3, 3 + len(jwt))


@pytest.mark.parametrize("text, base", [
    ("password = hunter22", [("assign", 0, 19)]), ("TOKEN:abc", []), ("token:token:abcdef", []), ("ApiKey='x' api_key=\"abcdef1\"", [("assign", 11, 27)]),
    ("ſecret=abcdef toKen=abcdef", []), ("AKIA" + "A" * 15, []), ("xAKIA" + "B" * 16, [("access", 1, 21)]), ("akia" + "B" * 16, []),
    ("f" * 23 + " " + "0" * 24, [("hex", 24, 48)]), ("secret=" + "a" * 30, [("assign", 0, 37), ("hex", 5, 6)][:1] + [("hex", 7, 37)]), ("", []), (None, [])])
def test_secrets_base_patterns(text, base):
    assert [s[:3] for s in S.find(text)] == base


def test_secrets_query_digest(spark, monkeypatch, odd, none, texts, documents):
    monkeypatch.setattr(S, "table", lambda *_: documents)
    for r in S.op5_secrets(spark, "").collect():
        found = [f"{k}:{a}:{z}" for k, a, z, _ in S.find(texts[r.doc_id])]
        base = [x for x in found if x.split(":")[0] in S.BASE_KINDS]
        assert r.spans == ",".join(found) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base)
    assert S.scan_secrets(odd).count() == odd.count() and S.scan_secrets(none).count() == 0


ARTICLE = "<article><h1>Head &amp; line</h1><p><b>Bold<br><p>Next&nbsp; one&#233;<p>a<i>b</i>c<div class='comments'>no</div></article>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_pages_structure():
    join = lambda h: [t for t, r in H.blocks_of(h) if r == "body"]
    assert " ".join(join(page(f"<nav>menu</nav><div class=ad>buy</div>{ARTICLE}<footer>&copy;</footer><script>'<p>x'</script>"))) == \
        "Head & line Bold Next oneé abc"
    open_ = lambda h: " ".join(t for t, r in H.blocks_of(h) if r == "open")
    assert open_("<div id=main-menu>m</div><p>kept<aside>s</aside><form>f</form><p style='display:none'>h</p>") == "kept"
    assert all(H.blocks_of("<p>abc" + cut) == [("abc", "open")] for cut in ("", "<", "</p", '<a href="x y', "<!-- x", "<script>var x"))
    assert H.blocks_of("a < b") == [("a < b", "open")]
    assert H.blocks_of(None) == [] and H.blocks_of("plain text") == [("plain text", "open")]


def plain_repeats(streams, run, pages):
    seen = {}
    for host, key, words in streams:
        for i in range(len(words) - run + 1):
            seen.setdefault((host, tuple(words[i:i + run])), set()).add(key)
    out = []
    for host, _, words in streams:
        gone = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(seen[host, tuple(words[i:i + run])]) >= pages:
                gone[i:i + run] = [True] * run
        out += gone
    return out


def test_repeated_runs_match_plain_counting():
    rng = np.random.default_rng(2)
    streams = []
    for p in range(60):
        host = p % 2
        words = [int(w) for w in rng.integers(0, 3, rng.integers(0, 40))]
        words = words[:5] + [9, 8, 7, 6, 5, 4, 3, 2, 1] * (p % 3 == 0) + words[5:]
        streams.append((host, tuple(words), words))
    words = np.array([h * 100 + w for h, _, s in streams for w in s])
    owner = np.repeat(np.arange(len(streams)), [len(s) for _, _, s in streams])
    content = np.unique([hash(k) for _, k, _ in streams], return_inverse=True)[1]
    for run in (4, 8, 9):
        got = H.repeated(words, owner, content, run, 3)
        assert list(got) == plain_repeats([(h, k, s) for h, k, s in streams], run, 3)


def test_pages_without_article_lose_what_repeats(spark):
    note = "we use small files to make this site work for you today"
    rows = [(k, f"http://h.example/{k}", f"<div><p>{note}<p>story number {k} " + " ".join(f"word{k}x{j}" for j in range(20)) + "</div>") for k in range(9)]
    rows += [(20, "http://other.example/", f"<p>{note}"), (21, None, None), (None, "http://h.example/9", ""), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, place string")
    got = H.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.url}
    assert by[5].text == f"story number 5 " + " ".join(f"word5x{j}" for j in range(20)) and by[5].n_repeated_words == len(note.split())
    assert by[20].text == note
    assert [r.text for r in got if r.page_id in (21, None)] == ["", ""]
    assert H.main_texts(df.limit(0)).count() == 0


def test_pages_query_keeps_articles(spark):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in H.op7_html(spark, SF).collect():
        body = src[r.page_id].split("<article>")[1].split("</article>")[0]
        import html
        want = " ".join(" ".join(html.unescape(x) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_pages_do_not_depend_on_partitions(spark):
    """12 hosts of 4 pages and one large host, each with a notice of its own; any number of partitions, any order of rows."""
    notice = lambda h: f"<p>This site of {h} uses small files and you agree to that by reading on</p>"
    rows = [(h * 100 + k, f"https://h{h}.test/{k}", f"<html><body>{notice(h)}<p>Page {k} of {h} tells of thing{k * 7 + h} alone</p></body></html>") for h in range(12) for k in range(4)]
    rows += [(5000 + k, f"https://big.test/{k}", f"<html><body>{notice('big')}<p>Big page {k} tells of matter{k} alone</p></body></html>") for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (2, 16, 48, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(sorted(map(tuple, H.main_texts(df.repartition(parts % 7 + 1), group=20).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(f == found[0] for f in found) and len(found[0]) == len(rows)
    assert not any("small files" in r[2] for r in found[0]) and all("alone" in r[2] for r in found[0])


def test_pages_inline_and_names_inside_articles(spark):
    inside = lambda x: [t for t, r in H.blocks_of(f"<article>{x}</article>") if r == "body"]
    assert inside('<p>Text <span class="ad">Buy now</span> end <span style="display:none">hid</span></p>') == ["Text end"]
    assert inside('<p>a <b>bold</b> <a href="x">link</a></p>') == ["a bold link"]
    assert inside('<section id="social-history"><p>kept</p></section><p class="notice-of-death">kept too</p>') == ["kept", "kept too"]
    assert inside('<div class="share-buttons">Tweet</div><div class="comments">first!</div><div class="ad-slot-2">ad</div><p>own</p>') == ["own"]
    assert [t for t, r in H.blocks_of('<p>x <span hidden>y</span> z</p>') if r == "open"] == ["x z"]


def test_pages_with_names_used_inside(spark):
    df = spark.createDataFrame([(1, "u", "<article>one</article>", "a"), (1, "u", "<article>one</article>", "a")], "host long, slot string, page string, html string")
    got = H.main_texts(df, ("host", "html", "slot"), "slot", "page")
    assert got.columns == ["host", "html", "slot", "text", "n_repeated_words"] and sorted(map(tuple, got.collect())) == [(1, "a", "u", "one", 0)] * 2
