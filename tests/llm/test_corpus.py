"""Near-duplicates, passages, chat, mixing, sharding, decontamination and the pipeline against plain loops."""
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import chat as C, decontamination as D, mixing as M, passages as P, sharding as R, simhash as H
from attesta.llm.common import word_count
from attesta.operators.components import connected

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(documents, texts):
    got = {r.doc_id: r for r in H.simhash_groups(documents).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(sorted(texts), [(a, b) for a, b in combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_connect_dense_and_large_groups(spark, monkeypatch):
    """More fingerprints under one key than a task compares, so keys are split; against all pairs."""
    monkeypatch.setattr(H, "GROUP", 50)
    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 62))
    prints = {base}
    while len(prints) < 700:
        prints.add(list(prints)[int(rng.integers(len(prints)))] ^ sum(1 << int(b) for b in rng.choice(24, int(rng.integers(1, 6)), replace=False)))
    prints |= {int(x) for x in rng.integers(1 << 63, size=300)}
    ids = sorted(prints)
    want = components(ids, [(a, b) for a, b in combinations(ids, 2) if (a ^ b).bit_count() <= 3])
    links = [(r.a, r.b) for r in H.linked(spark.createDataFrame([(x,) for x in ids], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert components(ids, links) == want


def test_components_of_a_source_that_turns_its_edges(spark, tmp_path):
    """Every run of the source gives its edges the other way round."""
    runs = tmp_path / "runs"

    def edges(batches):
        with open(runs, "a") as f:
            f.write(".")
        turned = runs.stat().st_size % 2
        for x in batches:
            yield x.rename(columns={"a": "b", "b": "a"})[["a", "b"]] if turned else x

    source = spark.createDataFrame([(9, 1), (9, 4), (7, 4), (20, 30)], "a long, b long").coalesce(1).mapInPandas(edges, "a long, b long")
    assert {r.node: r.component for r in connected(source).collect()} == {1: 1, 4: 1, 7: 1, 9: 1, 20: 20, 30: 20}


def test_links_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(8)
    for n in (12, 60):
        base = int(rng.integers(1 << 62))
        prints = np.array(sorted({base ^ sum(1 << int(b) for b in rng.choice(9, 3)) for _ in range(n)}))
        rows = pd.DataFrame({"mask": 0, "block": 0, "fp": prints})
        links = [H._links(rows.sample(frac=1, random_state=k), 3) for k in range(2)]
        assert all((x["a"] < x["b"]).all() for x in links)
        want = components(prints, [(a, b) for a, b in combinations(prints, 2) if int(a ^ b).bit_count() <= 3])
        assert all(components(prints, x.itertuples(index=False)) == want for x in links)


def test_simhash_odd_rows(odd, none):
    rows = H.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.fp for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.component_id == 4 for r in rows if r.doc_id in (4, 5))
    kept = H.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[6] == len({r.root for r in rows if r.doc_id == 6}) and kept.where("doc_id = 5").count() == 0
    assert H.simhash_groups(none).count() == 0 and H.one_of_each(none).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hé"), (1, 2, "bob", ""), (1, 3, "ann", None), (2, 0, None, "x"), (3, 0, "system", "only"),
            (None, 0, "ann", "n"), (4, 0, "a", "tie"), (4, 0, "b", "tie"), (4, 0, "a", "tie")]
    rows += [(5, k, "ab"[k % 2], f"t{k}") for k in range(150)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, segment string")
    got = {(r.conv_id, r.speaker, r.segment): r for r in C.perspectives(df).collect()}
    ann = got[1, "ann", 0]
    assert ann.rendered == ("<|system|>\nS<|end|>\n<|assistant|>\nhé<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\n<|end|>\n")
    assert [ann.rendered[a:z] for a, z in ann.masks] == ["hé<|end|>", "<|end|>"]
    assert set(k[1] for k in got if k[0] == 1) == {"ann", "bob"} and (2, "unknown", 0) in got and (None, "ann", 0) in got
    assert not any(k[0] == 3 for k in got) and got[4, "a", 0].n_turns == 3 and len(got[4, "a", 0].masks) == 2
    assert [got[5, "a", s].n_turns for s in range(3)] == [64, 64, 22]
    assert all(r.rendered[a - 14:a] == "<|assistant|>\n" and r.rendered[z - 7:z] == "<|end|>" for r in got.values() for a, z in r.masks)
    assert C.perspectives(df.limit(0)).count() == 0


def shard_rows(df, **kw):
    return R.assign_shards(df, **kw).collect()


def test_shards_balance_and_slots(documents, odd, none):
    for df in (documents, odd):
        rows = shard_rows(df)
        n = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(n.values()) - min(n.get(s, 0) for s in range(8)) <= 1
        for s in n:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    assert sorted(r["size"] for r in shard_rows(odd) if r["doc_id"] in (1, 2, 7)) == [1, 1, 4]
    assert shard_rows(none) == []


def test_shards_walk_the_ring_one_key_at_a_time():
    """The counted flows against a walk of single keys in the same order."""
    rng = np.random.default_rng(8)
    for slack in (0.0, 0.2):
        counts = {int(c): int(n) for c, n in zip(rng.choice(256, 40, replace=False), rng.integers(1, 30, 40))}
        total = sum(counts.values())
        most = [-(-int(total * (1 + slack) + 0.5) // 5)] * 5
        nodes = R.ring(5, 16, 256)
        load, home, late = [0] * 5, defaultdict(Counter), []
        for cell in sorted(counts):
            at = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
            for _ in range(counts[cell]):
                if load[nodes[at][1]] < most[nodes[at][1]]:
                    load[nodes[at][1]] += 1
                    home[cell][nodes[at][1]] += 1
                else:
                    late.append((cell, at))
        for cell, at in late:
            while load[nodes[at % len(nodes)][1]] >= most[nodes[at % len(nodes)][1]]:
                at += 1
            load[nodes[at % len(nodes)][1]] += 1
            home[cell][nodes[at % len(nodes)][1]] += 1
        got = defaultdict(Counter)
        for f in R.flows(counts, 5, 16, 256, most):
            got[f["cell"]][f["shard"]] += f["last"] - f["first"]
        assert got == home


def test_shards_move_little_when_one_is_added(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in shard_rows(df, slack=0.25)}
    after = {r["doc_id"]: r["shard"] for r in shard_rows(df, shards=9, slack=0.25)}
    assert max(Counter(after.values()).values()) <= -(-20_000 * 1.25 // 9)
    assert sum(before[i] != after[i] for i in before) < 20_000 * 0.3


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= w[s] * level}
        if not full:
            return target | {s: w[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def check_mix(df):
    rows = M.mix(df).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    assert len(rows) == df.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.mix_size
        taken[r.source] += r.mix_taken
        assert 0 <= r.mix_taken <= 2 * r.mix_size
    want = plain_targets(sizes)
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    assert sorted(rows) == sorted(M.mix(df.repartition(5)).select(*[c for c in rows[0].__fields__]).collect())


def test_mix_near_targets(documents):
    check_mix(documents)


def test_quotas_are_highest_quotients(spark):
    rng = np.random.default_rng(3)
    ideal = rng.random(50) * 40
    most = rng.integers(5, 60, 50)
    seats = int(np.minimum(ideal, most).sum() * 0.8)
    df = spark.createDataFrame([(i, float(ideal[i]), int(most[i]), i) for i in range(50)], "u int, ideal double, most long, tie long")
    got = {r.u: r.quota for r in M.quotas(df, seats).collect()}
    best = sorted(((ideal[i] / (2 * q + 1), i) for i in range(50) for q in range(most[i])), reverse=True)[:seats]
    assert got == {i: Counter(i for _, i in best)[i] for i in range(50)}


def test_mix_odd_rows(odd, none):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.mix_taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    mixed = M.mixed_texts(odd)
    assert mixed.columns == odd.columns
    words = mixed.select(F.sum(word_count(F.col("text")))).first()[0]
    assert words == sum(r.mix_taken for r in rows)
    assert M.mix(none).count() == 0 and M.mixed_texts(none).count() == 0


def near_copies(seed=6, n=30):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    fresh = lambda k: [word() for _ in range(k)]
    docs, shared = {}, [fresh(60), fresh(90)]
    for i in range(n):
        docs[i] = fresh(int(rng.integers(0, 200)))
        if i % 3 == 0:
            docs[i] += shared[0] + fresh(30)
        if i % 5 == 0:
            docs[i] = shared[1] + docs[i]
    for i in range(n, n + 8):  # a near copy: two words of 200 changed
        docs[i] = fresh(200) if i == n else list(docs[n])
        for k in (40, 150) if i > n else ():
            docs[i][k] = word()
    docs[n + 8] = list(docs[1])
    return {i: " ".join(w) for i, w in docs.items()}


def test_passages_match_brute_force(spark):
    texts = near_copies()
    members, links = P.duplicate_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = members.collect()
    words = {i: t.split() for i, t in texts.items()}
    at = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            at[tuple(w[k:k + 50])].add((i, k))
    spans, of = defaultdict(list), defaultdict(set)
    for r in rows:
        spans[r.doc_id].append((r.start_word, r.end_word))
        of[r.doc_id].add(r.class_id)
    need = {p for s in at.values() if len({i for i, _ in s}) > 1 for p in s}
    assert need and all(any(a <= k and k + 50 <= z for a, z in spans[i]) for i, k in need)
    assert set(spans) == {i for i, _ in need} | set(range(30, 38))
    assert all(of[i] == {30} for i in range(30, 38))
    for r in links.collect():
        assert r.similarity >= 0.8 and r.a_end - r.a_start >= 50 and r.b_end - r.b_start >= 50


def test_passages_that_stand_twice_in_a_text():
    """The passage twice, and a single shingle shared besides: its own shingles are not unique."""
    rng = np.random.default_rng(5)
    words = lambda n: [b"w%d" % k for k in rng.integers(1 << 40, size=n)]
    passage, single = words(60), words(5)
    first = words(30) + passage + words(40) + passage + words(30) + single
    second = words(20) + single + words(50) + passage + words(10)
    found = P.alike(P.shingle_hashes(first), P.shingle_hashes(second), 0.8)
    assert sorted(f[:4] for f in found) == [(30, 90, 75, 135), (130, 190, 75, 135)]
    assert sorted(f[:4] for f in P.alike(P.shingle_hashes(second), P.shingle_hashes(first), 0.8)) == [(75, 135, 30, 90), (75, 135, 130, 190)]


def test_compact_windows_are_the_trees_nodes():
    h = np.random.default_rng(5).integers(1 << 62, size=400, dtype=np.uint64)
    start, stop = np.array([0, 150, 160]), np.array([150, 160, 400])
    got = set(zip(*(x.tolist() for x in P.compact_windows(h, start, stop, 12))))
    want = set()
    for s, e in zip(start, stop):
        for c in range(s, e):
            low = c
            while low > s and h[low - 1] > h[c]:
                low -= 1
            high = c + 1
            while high < e and h[high] > h[c]:
                high += 1
            if high - low >= 12:
                want.add((c, low, high))
    assert got == want


def test_passages_odd_rows(spark, odd, none):
    rows = P.duplicate_passages(odd)[0].collect()
    assert {r.doc_id for r in rows} == {4, 5} and {r.class_id for r in rows} == {4} and {r.end_word for r in rows} == {20_000}
    assert P.duplicate_passages(none)[0].count() == 0
    same = spark.createDataFrame([(k, "der " * 3000) for k in range(6)] + [(9, "der " * 2000), (10, None)], "doc_id long, text string")
    assert {r.doc_id for r in P.duplicate_passages(same)[0].collect()} >= set(range(6))


def plain_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, best[j + 1] = best[j + 1], max(best[j + 1], best[j], old + 1 if x == y else 0)
    return best[-1]


def test_common_subsequence():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = [[bytes([97 + c]) for c in rng.integers(0, 4, rng.integers(1, 25))] for _ in range(2)]
        used, first, last = D.common(a, b)
        assert used.sum() == plain_lcs(a, b) == plain_lcs([x for x, u in zip(a, used) if u], b[first:last])


def test_leaks_found_whole_and_reworded(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rng = np.random.default_rng(9)
    planted = {}
    for k, i in enumerate(sorted(items)):  # one word of eight replaced, another dropped, inside a long document
        w = items[i].split()
        w = [x if rng.random() > 0.125 else f"other{k}" for x in w if rng.random() > 0.06]
        planted[10_000 + k] = (i, docs[k % 50][:3000] + "\n" + " ".join(w) + "\n" + docs[50 + k % 50][:3000])
    rows = list(docs.items()) + [(d, t) for d, (_, t) in planted.items()] + [(None, None), (20_000, "")]
    got = {(r.doc_id, r.item) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    flat = lambda t: " ".join(t.split())
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)}
    assert whole <= got
    assert len({(d, i) for d, (i, _) in planted.items()} & got) >= 0.9 * len(planted)
    honest = {(d, i) for d, i in got if d in docs} - whole
    assert all(set(D.tokens(items[i])) <= set(D.tokens(docs[d])) for d, i in honest)


def test_leaks_among_words_that_dilute_the_cosine(spark):
    """Short verbatim items among words no other text has, and an item whose first word stands early in the text as well."""
    rng = np.random.default_rng(12)
    word = lambda k: f"v{k}"
    items = [" ".join(map(word, rng.integers(3000, size=n))) for n in (4, 5, 6, 8, 12, 20)]
    items.append(" ".join(word(5000 + k) for k in range(12)))
    noise = lambda n: [f"z{x}" for x in rng.integers(1 << 50, size=n)]
    rows = [(k, " ".join(noise(90) + x.split() + noise(90))) for k, x in enumerate(items)]
    rows.append((100, " ".join([word(5000), *noise(40), *items[6].split(), *noise(30)])))
    rows += [(1000 + k, " ".join(map(word, rng.integers(3000, size=120)))) for k in range(300)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item): (r.start, r.end) for r in D.find_leaks(docs, bench).where("doc_id < 1000").collect()}
    want = {(k, k): (90, 90 + len(x.split())) for k, x in enumerate(items)} | {(100, 6): (41, 53)}
    assert got == want


def test_leaks_in_several_passes_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    monkeypatch.setattr(D, "BLOCKS_A_PASS", 2)
    rng = np.random.default_rng(10)
    text = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    items = {i: text(30 if i else 200) for i in range(20)} | {21: "", 22: None}
    docs = {i: text(100) + " " + (items[i] if i < 20 else "") + " " + text(50) for i in range(25)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()) + [(5, items[5]), (None, text(30))], "item_id long, text string")
    got = {(r.doc_id, r.item) for r in D.find_leaks(df, bench).collect()}
    assert got == {(i, i) for i in range(20)}
    assert {r.doc_id for r in D.without_leaks(df, bench).collect()} == set(range(20, 25))


def test_leaks_need_the_items_answer(spark):
    """An item of several passages: its first words without its last sentence are no leak, with it they are."""
    rng = np.random.default_rng(11)
    words = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    body, answer, other = words(125), words(8), words(60)
    item = " ".join(body) + ". " + " ".join(answer) + "."
    texts = {1: body[:64] + other, 2: body[:64] + answer + other, 3: body + answer, 4: other + body[60:] + answer, 5: answer + other, 6: body + other}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, " ".join(words(30))), (-1, " ".join(words(40)))], "item_id long, text string")
    found = {(r.doc_id, r.item) for r in D.find_leaks(docs, bench).collect()}
    assert found == {(2, 7), (3, 7), (4, 7)}
    assert sorted(r.doc_id for r in D.without_leaks(docs, bench).collect()) == [1, 5, 6]


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    assert Counter(r.doc_id for r in D.find_leaks(odd, bench).collect()) == Counter({6: 3, None: 1})
    kept = D.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert D.find_leaks(none, bench).count() == 0 and D.find_leaks(odd, bench.limit(0)).count() == 0
    assert D.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_pipeline_stages(spark, documents, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "sharding"]
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == documents.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, dedup, clean, mixed = kept
    prints = {i: plain_fingerprint(t) for i, t in quality.items()}
    want = components(sorted(quality), [(a, b) for a, b in combinations(sorted(quality), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert set(dedup) == set(want.values())
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, t in dedup.items() if any(x in " ".join(t.split()) for x in items)}
    assert set(clean) == set(dedup) - leaky
    assert set(mixed) <= set(clean)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == docs.count()
    n = Counter(r["shard"] for r in rows)
    assert max(n.values()) - min(n.values()) <= 1
