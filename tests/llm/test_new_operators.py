"""Ranked search, repeated byte strings and dialogue repair against plain loops."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.llm import suffixes, term_pipeline, turn_repair

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ ranked search
def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_ranks(docs, items, top=10):
    counted = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(x)) for i, x in docs)]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // n_terms if n else 0
            v = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in plain_terms(text) if t in c)
            if v:
                scores.append((-v, i is not None, i or 0, i))
        out += [(item, rank, i, -v) for rank, (v, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def ranks(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cell,block", [(1024, 256), (32, 7)])
def test_search_on_tables(spark, documents, monkeypatch, cell, block):
    monkeypatch.setattr(term_pipeline, "CELL", cell)
    monkeypatch.setattr(term_pipeline, "ITEMS", block)
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ranks(term_pipeline.op11_search(spark, SF)) == plain_ranks(docs, items)


def test_search_prunes_nothing_it_needs(spark, monkeypatch):
    """Scores decided by frequent terms, ties and rare terms of no use; cells far smaller than the table."""
    monkeypatch.setattr(term_pipeline, "CELL", 16)
    rnd = random.Random(4)
    docs = [(k, " ".join(rnd.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=rnd.randint(1, 30)))) for k in range(400)]
    items = [(k, " ".join(rnd.choices([f"W{i}" for i in range(45)], k=rnd.randint(1, 12)))) for k in range(30)]
    got = term_pipeline.ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranks(got) == plain_ranks(docs, items)


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha BETA w7x7", 5), (1, "alpha BETA w7x7", 6), (None, "mu漢字 漢字 x", 1), (2, None, 1), (3, "", 1), (4, "none of it", 1)],
                                  "item_id long, text string, rank int")
    got = term_pipeline.ranked_documents(odd, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert ranks(got) == plain_ranks(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert term_pipeline.ranked_documents(none, items).collect() == []
    assert term_pipeline.ranked_documents(odd, items.limit(0)).collect() == []


# ------------------------------------------------------------------ repeated byte strings
def plain_removal(texts, least):
    seen = Counter(t[k:k + least] for t in texts for k in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if seen[t[k:k + least]] > 1:
                gone[k:k + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((t, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(df, least):
    d = suffixes.without_repeats(df, least)
    rows = d.select("text", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans"), F.sha2("dedup.kept", 256)).collect()
    return sorted(((r[0] or "").encode(), *r[1:]) for r in rows)


@pytest.mark.parametrize("least", [1, 9, 24, 64, 400])
def test_repeats(spark, least):
    """Pieces of few base strings, runs of one letter, copies, and stretches one byte short or long."""
    rnd = random.Random(least)
    base = [bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.randint(least - 1, least * 3))) for _ in range(20)]
    texts = [b"a" * (least + 5), b"a" * least, base[0], base[0], base[1][:least], base[1][:least - 1], b""]
    for _ in range(90):
        text = b""
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            i = rnd.randint(0, len(b))
            text += rnd.choice([b, b[i:], b[:i], b"ab" * rnd.randint(0, least), bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(0, least)))])
        texts.append(text)
    docs = spark.createDataFrame([(k if k % 5 else None, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    assert removal(docs.repartition(3), least) == plain_removal(texts, least)


def test_repeats_cut_by_chunks(spark, monkeypatch):
    rnd = random.Random(1)
    long = bytes(rnd.choice(b"abcdef") for _ in range(5000))
    texts = [long, b"x" + long[700:2500] + b"y", b"z" * 900, long[4000:] + long[:300]]
    import numpy as np
    data = b"".join(texts)
    stop = np.cumsum([len(t) for t in texts])
    whole = suffixes.sampled(np.frombuffer(data, np.uint8), np.r_[0, stop[:-1]], stop, 64)
    monkeypatch.setattr(suffixes, "CHUNK", 333)
    for a, b in zip(whole, suffixes.sampled(np.frombuffer(data, np.uint8), np.r_[0, stop[:-1]], stop, 64)):
        assert (a == b).all()


def test_repeats_odd_rows(spark, odd, none):
    got = suffixes.without_repeats(odd, 64)
    assert got.columns == [*odd.columns, "dedup"] and got.count() == odd.count()
    assert removal(odd, 64) == plain_removal([(r["text"] or "").encode() for r in odd.select("text").collect()], 64)
    assert suffixes.without_repeats(none).collect() == []
    with pytest.raises(ValueError):
        suffixes.without_repeats(got)


def test_repeats_query(spark, documents):
    want = plain_removal([(r["text"] or "").encode() for r in documents.select("text").collect()], 400)
    got = suffixes.op12_suffixes(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(w[1:] for w in want)


# ------------------------------------------------------------------ dialogue repair
def cheapest(rows):
    """(cost, audit, lines) of the best edits of (role, text, fault) rows, by all audits a state can have."""
    def role_of(state):
        return {0: "user", 1: "user", 2: "assistant", 3: "user"}[state], {0: 2, 1: 2, 2: 3, 3: 2}[state]

    best = {0: (0, "", ())}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in best.items():
            for _ in range(5):
                name, to = role_of(state)
                ways = [(state, cost + 3, audit + "D", lines)]
                if fault not in ("blank", "duplicate"):
                    more = cost + (fault == "truncated")
                    ways.append((to, more + 2, audit + "R", (*lines, f"{name}:{text}")))
                    if role[:1] == name[0]:
                        ways.append((to, more, audit + "K", (*lines, f"{role}:{text}")))
                    if state == 0 and role[:1] == "s":
                        ways.append((1, more, audit + "K", (*lines, f"{role}:{text}")))
                for s, *way in ways:
                    if s not in after or way[:2] < list(after[s][:2]):
                        after[s] = tuple(way)
                state, cost, audit, lines = to, cost + 2, audit + "I", (*lines, f"{name}:")
        best = after
    ends = []
    for state, (cost, audit, lines) in best.items():
        for _ in range(3):
            if state in (0, 3):
                ends.append((cost, audit, lines))
            name, state = role_of(state)
            cost, audit, lines = cost + 2, audit + "I", (*lines, f"{name}:")
    return min(ends, key=lambda e: e[:2])


def plain_repair(rows):
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        numbers = [t[0] for t in turns if t[0] is not None]
        faults, seen = [], set()
        for _, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(turns, faults)])
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Dialogues with null, tied and repeated turns, odd roles, and long ones."""
    rnd = random.Random(3)
    roles, said = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Hi.", "no end", "ok!", " ", "", None, "wörd?", "x. \n", "漢字。"]
    rows = [(conv, rnd.choice([t, t, t, t, t + 3, None]), rnd.choice(roles), rnd.choice(said), k)
            for k, conv in enumerate([*range(120), None]) for t in range(rnd.randint(0, 12))]
    rows += rows[:20] + [(9000, t, rnd.choice(roles[:5]), f"{t}.", 1) for t in range(500)]
    folder = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int").write.parquet(f"{folder}/conversations.parquet")
    return folder, [r[:4] for r in rows]


def test_repair_query(spark, turns):
    folder, rows = turns
    assert sorted(map(tuple, turn_repair.op13_turns(spark, folder).collect()), key=str) == plain_repair(rows)


def test_repair_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, turn_repair.op13_turns(spark, SF).collect()), key=str) == plain_repair(rows)


@pytest.mark.parametrize("block", [2, 5])
def test_repair_in_blocks(spark, turns, block):
    """Dialogues that are far longer than a block, over several levels, and the texts that come out."""
    folder, rows = turns
    edits = turn_repair.repair_edits(turn_repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet")), block=block).persist()
    audits, lines = {}, {}
    for r in sorted(edits.collect(), key=lambda r: r["place"]):
        audits[r["conv"]] = audits.get(r["conv"], "") + r["edits"]
    for r in sorted(turn_repair.repaired_turns(edits).collect(), key=lambda r: (r["place"], r["step"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    edits.unpersist()
    for w in plain_repair(rows):
        assert audits.get(w[0], "") == w[7]
        assert hashlib.sha256("\n".join(lines.get(w[0], [])).encode()).hexdigest() == w[8]


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turn_repair.op13_turns(spark, str(tmp_path)).collect() == []
