"""Benchmark decontamination: latent cosine search over TF-IDF passages, then longest common subsequences."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attesta.llm.common import keep, numbered, table

BINS = 1 << 18       # hashed vocabulary
PASSAGE = 64         # words of a passage
STRIDE = 32          # words from one passage to the next
BLOCK = 256          # benchmark passages that share a latent space
BLOCKS_A_PASS = 8    # latent spaces a pass over the corpus carries
RANK = 64            # directions of a latent space at most
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only) of a whole text, ASCII punctuation taken as space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def bins(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64) & (BINS - 1)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that hold each hashed word, documents).  A task sends one count for each of BINS words at most."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BINS, np.int64)
        n = 0
        for batch in batches:
            for text in batch["text"]:
                words = set(tokens(text))
                seen[np.unique(bins(words))] += 1
            n += len(batch)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bin": np.r_[at, -1], "n": np.r_[seen[at], n]})

    rows = (docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bin bigint, n bigint")
            .groupBy("bin").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(BINS, np.int64)
    real = rows["bin"] >= 0
    df[rows["bin"][real]] = rows["n"][real]
    return df, int(rows["n"][~real].sum())


def word_weights(df: np.ndarray, n: int, share: float = 0.1) -> np.ndarray:
    """Inverse document frequency; 0 for words in over `share` of the documents (and 50), as they tell passages apart the least."""
    w = np.log1p(n / (1.0 + df))
    return np.where((df > share * n) & (df > 50), 0.0, w).astype(np.float32)


def answer_of(text: str | None) -> list[bytes]:
    """The words of the last sentence: what follows the last end mark but one, three words at least, a passage at most."""
    body = (text or "").rstrip(" \t\r\n.?!")
    n = len(tokens(body[max(body.rfind(c) for c in ".?!\n") + 1:]))
    return tokens(text)[-min(max(3, n), PASSAGE):]


def passages(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, part, words, answer, rest): items cut into passages of PASSAGE words, the last one as long as the others.

    answer are the words of the item's last sentence, rest is how many words the item has from the passage's start.
    """
    row = "words array<string>, answer array<string>, rest int"

    @F.pandas_udf(f"array<struct<{row}>>")
    def cut(texts: pd.Series) -> pd.Series:
        plain = lambda ws: [x.decode("utf-8", "surrogatepass") for x in ws]
        out = []
        for text in texts:
            w, answer = tokens(text), plain(answer_of(text))
            starts = [min(s, max(len(w) - PASSAGE, 0)) for s in range(0, len(w), PASSAGE)]
            out.append([{"words": plain(w[s:s + PASSAGE]), "answer": answer, "rest": len(w) - s} for s in starts])
        return pd.Series(out, dtype=object)

    return items.select(F.col(id_col).alias("item"), F.posexplode(cut(text_col)).alias("part", "p")).select("item", "part", "p.*")


def latent_space(words: list[list[str]], weight: np.ndarray, rank: int = RANK, power: int = 2) -> dict:
    """Randomised SVD of a block's TF-IDF passages: (bins, basis), and the passages' unit vectors in it.

    Rows have unit length.  The range of the matrix is found from a random test matrix of `rank` columns and some more with
    `power` iterations; the `rank` leading directions are kept, so words that stand in the same passages fall together.
    A passage keeps its common words' weight if these are over half of its words: else nothing would be left to find it by.
    """
    rows = [bins([w.encode("utf-8", "surrogatepass") for w in ws]) for ws in words]
    local = weight.copy()
    for r in rows:
        if (weight[r] == 0).mean() > 0.5:
            local[r] = np.maximum(local[r], 1.0)
    vocab = np.unique(np.concatenate(rows))
    a = np.zeros((len(rows), len(vocab)), np.float64)
    for i, r in enumerate(rows):
        np.add.at(a[i], np.searchsorted(vocab, r), local[r])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    y = a @ np.random.default_rng(3).standard_normal((len(vocab), min(rank + 16, *a.shape)))
    for _ in range(power):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    along = a @ vt.T
    k = min(rank, len(s))
    basis = (vt[:k].T * local[vocab][:, None]).astype(np.float32)  # a word's step in the latent space
    vectors = along[:, :k].astype(np.float32)
    return {"vocab": vocab, "basis": basis, "vectors": vectors, "weight": local}


def common(item: list[bytes], text: list[bytes]) -> tuple[np.ndarray, int, int]:
    """(which words of the item are on a longest common subsequence, first and past-last place in the text)."""
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([code[w] for w in item])
    b = np.array([code.get(w, -1) for w in text])
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(1, len(a) + 1):
        step = np.maximum(best[i - 1, 1:], np.where(b == a[i - 1], best[i - 1, :-1] + 1, 0))
        best[i, 1:] = np.maximum.accumulate(step)
    used, i, j, first, last = np.zeros(len(a), bool), len(a), len(b), len(b), 0
    while i and j:
        if best[i, j] == best[i, j - 1]:
            j -= 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
            first, last = min(first, j), max(last, j + 1)
    return used, first, last


def span(item: list[bytes]) -> int:
    """Words of a text that an item may be spread over at most."""
    return 2 * len(item) + 8


class Matcher:
    """What a task needs to judge texts against the benchmark passages of one pass."""

    def __init__(self, blocks: list[dict], items: list[list[int]], words: list[list[list[bytes]]], answers: list[list[tuple[list[bytes], int]]],
                 weight: np.ndarray, cosine: float, least: float, answer: float):
        self.blocks, self.items, self.words, self.answers = blocks, items, words, answers
        self.weight, self.cosine, self.least, self.answer = weight, cosine, least, answer
        for b in blocks:
            b["row"] = np.full(BINS, -1, np.int32)
            b["row"][b["vocab"]] = np.arange(len(b["vocab"]), dtype=np.int32)
        # a word's part of its passage's weight; words without weight count a little
        self.values, self.parts = [], []
        for b, block in zip(blocks, words):
            values = [np.where(v > 0, v, np.float32(0.1)) for v in (b["weight"][bins(item)] for item in block)]
            self.values.append([v / v.sum() for v in values])
            parts: list[dict[bytes, float]] = []
            for item, v in zip(block, self.values[-1]):
                part: dict[bytes, float] = {}
                for word, x in zip(item, v.tolist()):
                    part[word] = part.get(word, 0.0) + x
                parts.append(part)
            self.parts.append(parts)
        # the same for the exact search: a column for each passage; words without weight count as there
        for b, parts in zip(blocks, self.parts):
            b["share"] = np.zeros((len(b["vocab"]), len(parts)), np.float32)
            b["given"] = np.zeros(len(parts), np.float32)
            for p, part in enumerate(parts):
                spots = bins(part)
                x = np.fromiter(part.values(), np.float32, len(part))
                weighs = b["weight"][spots] > 0
                np.add.at(b["share"][:, p], b["row"][spots[weighs]], x[weighs])
                b["given"][p] = x[~weighs].sum()
            # most words are in few passages: of each word the passages that hold it
            at, b["held_by"] = np.nonzero(b["share"])
            # a match holds one at least of any words that weigh more than it may lack: of the words held by few passages
            b["must"], b["always"] = np.zeros(len(at), bool), []
            few = np.bincount(at, minlength=len(b["vocab"]))
            for p in range(len(parts)):
                mine = np.flatnonzero(b["held_by"] == p)
                share = b["share"][at[mine], p]
                order = np.lexsort((-share, few[at[mine]], -b["weight"][b["vocab"][at[mine]]]))
                enough = int(np.searchsorted(np.cumsum(share[order]), 1 - least + 1e-3)) + 1
                b["must"][mine[order[:enough]]] = True
                if b["given"][p] >= least - 1e-3:  # words without weight can be all that is there
                    b["always"].append(p)
            b["held_at"] = np.searchsorted(at, np.arange(len(b["vocab"]) + 1))
            b["share"] = b["share"][at, b["held_by"]]
            b["key"] = at * np.int64(len(parts)) + b["held_by"]
            b["rare"] = np.bincount(at[b["must"]], minlength=len(b["vocab"])) > 0
        # strides that hold every span an item may take, wherever in the first of them it starts
        self.reach = [np.array([-(-(STRIDE - 1 + span(item)) // STRIDE) for item in block]) for block in words]

    def batch(self, texts: list[str | None], limit: int = 200_000) -> list[list[dict]]:
        """Matches of every text; texts are taken together up to `limit` words, so memory does not grow with a batch."""
        out, now, n = [], [], 0
        for text in texts:
            now.append(tokens(text))
            n += len(now[-1])
            if n >= limit:
                out += self._some(now)
                now, n = [], 0
        return out + self._some(now)

    def _some(self, docs: list[list[bytes]]) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in docs]
        sizes = np.array([len(d) for d in docs], np.int64)
        if not sizes.sum():
            return found
        ids = bins(chain.from_iterable(docs))
        first = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(docs)), sizes)
        # strides of each text: a passage is a stride and the next one of the same text
        strides = -(-sizes // STRIDE)
        stride0 = np.r_[0, np.cumsum(strides)]
        stride = stride0[owner] + (np.arange(len(ids)) - first[owner]) // STRIDE
        n = int(stride0[-1])
        stride_doc = np.repeat(np.arange(len(docs)), strides)
        joined = np.r_[stride_doc[1:] == stride_doc[:-1], False]
        for k_block, b in enumerate(self.blocks):
            w2 = np.bincount(stride, weights=b["weight"][ids].astype(np.float64) ** 2, minlength=n)
            rows = b["row"][ids]
            at = np.flatnonzero((rows >= 0) & (b["weight"][ids] > 0))
            if not len(at):
                continue
            norm = w2.copy()
            norm[:-1][joined[:-1]] += w2[1:][joined[:-1]]
            norm = np.sqrt(np.maximum(norm, 1e-9))
            pair, times = np.unique(stride[at] * np.int64(len(b["vocab"])) + rows[at], return_counts=True)
            where, row = pair // len(b["vocab"]), pair % len(b["vocab"])
            begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            steps = b["basis"][row]
            steps *= times[:, None].astype(np.float32)
            sums = np.zeros((n, steps.shape[1]), np.float32)
            sums[where[begin]] = np.add.reduceat(steps, begin, axis=0)
            sums[:-1][joined[:-1]] += sums[1:][joined[:-1]]
            # no cosine exceeds the length of the latent part: most passages end here
            near = np.flatnonzero(np.einsum("ij,ij->i", sums, sums) >= (self.cosine * norm) ** 2)
            cosines = sums[near] @ b["vectors"].T / norm[near][:, None]
            at_doc = stride_doc[near]
            at_word = (near - stride0[at_doc]) * STRIDE
            have, seen = set(), None
            for k, p in zip(*(x.tolist() for x in np.nonzero(cosines >= self.cosine))):
                d, start = int(at_doc[k]), int(at_word[k])
                if seen != k:  # all words an item of a passage's length may lie among
                    have, seen = set(docs[d][max(0, start - PASSAGE // 2):start + PASSAGE + PASSAGE // 2]), k
                # no subsequence holds more than the words that are there at all
                if sum(x for w, x in self.parts[k_block][p].items() if w in have) >= self.least:
                    low, high = max(0, start - len(self.words[k_block][p]) // 2), start + PASSAGE + len(self.words[k_block][p]) // 2
                    self._verify(found, docs, d, low, high, k_block, p, float(cosines[k, p]))
            self._contained(found, docs, k_block, where, row, stride_doc, stride0)
        return [self._best(f) for f in found]

    def _contained(self, found: list[list[dict]], docs: list[list[bytes]], block: int, where: np.ndarray, row: np.ndarray,
                   stride_doc: np.ndarray, stride0: np.ndarray) -> None:
        """Verify what the cosine may miss, as words around an item dilute it: every place where enough of an item's words are.

        A match has `least` of the item's weight inside span() words, so the words of some strides hold as
        much.  Only strides near a word that every match has to hold one of are summed up; the sums are never
        less than that share, whatever else stands there.  where and row: each stride's words, each once.
        """
        b, reach = self.blocks[block], self.reach[block]
        size = len(reach)
        rare = b["rare"][row]
        n = b["held_at"][row[rare] + 1] - b["held_at"][row[rare]]
        at = np.repeat(b["held_at"][row[rare]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, by = np.repeat(where[rare], n)[b["must"][at]], b["held_by"][at][b["must"][at]]
        near = []
        for k in range(int(reach.max())):
            fits = (place >= k) & (k < reach[by])
            fits[fits] = stride_doc[place[fits] - k] == stride_doc[place[fits]]
            near.append((place[fits] - k) * size + by[fits])
        for p in b["always"]:
            near.append(np.arange(len(stride_doc)) * size + p)
        cells = np.unique(np.concatenate(near))
        if not len(cells):
            return
        start, p = cells // size, cells % size
        first = np.searchsorted(where, start)
        last = np.searchsorted(where, np.minimum(start + reach[p], stride0[stride_doc[start] + 1]))
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = row[at] * np.int64(size) + np.repeat(p, n)
        spot = np.minimum(np.searchsorted(b["key"], key), len(b["key"]) - 1)
        given = np.where(b["key"][spot] == key, b["share"][spot], 0.0)
        held = b["given"][p] + np.bincount(np.repeat(np.arange(len(cells)), n), weights=given, minlength=len(cells))
        enough = np.flatnonzero(held >= self.least - 1e-4)
        seen = None
        for k, p in zip(start[enough].tolist(), p[enough].tolist()):
            d = int(stride_doc[k])
            start = int(k - stride0[d]) * STRIDE
            stop = start + int(reach[p]) * STRIDE
            if seen != (k, reach[p]):
                have, seen = set(docs[d][start:stop]), (k, reach[p])
            most = sum(x for w, x in self.parts[block][p].items() if w in have)
            if most >= self.least - 1e-6 and not self._held(found[d], block, p, most):
                self._verify(found, docs, d, start, stop, block, p, self._cosine(docs[d][start:start + PASSAGE], block, p))

    def _held(self, found: list[dict], block: int, p: int, most: float) -> bool:
        """Whether a match of the item is known that a share of `most` would not better."""
        return any(f["item"] == self.items[block][p] and f["share"] >= most - 1e-6 for f in found)

    def _cosine(self, words: list[bytes], block: int, p: int) -> float:
        """The latent cosine of some words of a text to a passage."""
        b, ids = self.blocks[block], bins(words)
        known = ids[(b["row"][ids] >= 0) & (b["weight"][ids] > 0)]
        return float(b["basis"][b["row"][known]].sum(axis=0) @ b["vectors"][p] / np.sqrt(max((b["weight"][ids].astype(np.float64) ** 2).sum(), 1e-9)))

    def _verify(self, found: list[list[dict]], docs: list[list[bytes]], d: int, low: int, high: int, block: int, p: int, cosine: float) -> None:
        item, value, text = self.words[block][p], self.values[block][p], docs[d][low:high]
        used, a, z = common(item, text)
        most = float(value[used].sum())
        if most < self.least:
            return
        tries = [(used, a, z)]
        if z - a > span(item) or self._answered(block, p, docs[d], low + a, used) < self.answer:
            # the same words may stand closer together elsewhere: every stretch of the allowed length
            if self._held(found[d], block, p, most):
                return
            part, tries = self.parts[block][p], []
            for at, w in enumerate(text):
                if w in part:
                    have = set(text[at:at + span(item)])
                    if sum(x for v, x in part.items() if v in have) >= self.least - 1e-6:
                        u, x, y = common(item, text[at:at + span(item)])
                        tries.append((u, at + x, at + y))
        for used, a, z in tries:
            share = float(value[used].sum())
            answer = self._answered(block, p, docs[d], low + a, used)
            if share >= self.least and answer >= self.answer and z - a <= span(item):
                found[d].append({"item": self.items[block][p], "cosine": cosine, "share": share, "answer": answer, "start": low + a, "end": low + z})

    def _answered(self, block: int, p: int, text: list[bytes], start: int, used: np.ndarray) -> float:
        """The share of the answer's words that a match holds.

        The last passage of an item tells by itself; one before is asked for the words of the item's last sentence
        in what follows its match, as far as the whole item may be spread.
        """
        answer, rest = self.answers[block][p]
        if rest <= len(used):
            return float(used[-len(answer):].mean())
        return float(common(answer, text[start:start + 2 * rest + 8])[0].mean())

    @staticmethod
    def _best(found: list[dict]) -> list[dict]:
        best: dict[int, dict] = {}
        for f in found:
            if f["item"] not in best or (f["share"], f["cosine"]) > (best[f["item"]]["share"], best[f["item"]]["cosine"]):
                best[f["item"]] = f
        return [best[k] for k in sorted(best)]


LEAKS = T.ArrayType(T.StructType([
    T.StructField("item", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()),
    T.StructField("answer", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def leak_columns(docs: DataFrame, items: DataFrame, cosine: float = 0.2, least: float = 0.7, answer: float = 0.5,
                 item_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Column, bool]]:
    """Columns over docs, one for each pass, and whether it is the last: the benchmark items a text holds, with their evidence.

    Items are cut into passages of at most PASSAGE words.  BLOCK of them at a time span a latent space of
    their TF-IDF vectors (randomised SVD, one task for each block); the documents' passages are projected
    into it and those with a high cosine to a benchmark passage, or with enough of its words whatever
    stands around them, are checked by a longest common
    subsequence of words: `least` of the passage's weight has to be on it, and `answer` of the words of
    its last sentence.  Document frequencies cover all documents.

    A pass carries BLOCKS_A_PASS blocks, so what is collected and a task holds is bounded; a larger benchmark takes
    more passes, each of which is made when it is asked for.  Ids of items are integers (null: -1); items without
    words are in no document.
    """
    spark = docs.sparkSession
    df, n = document_frequency(docs, text_col)
    weight = word_weights(df, n)

    distinct = items.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).alias("t")).distinct()
    cut = passages(distinct, "id", "t")
    cut = numbered(cut, F.struct("item", "part", "words", "answer", "rest"), "rank").withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))
    shared = spark.sparkContext.broadcast(weight)

    def fit(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        words = [list(w) for w in block["words"]]
        s = latent_space(words, shared.value)
        return pd.DataFrame({"block": [block["block"].iloc[0]], "vocab": [s["vocab"].tobytes()], "basis": [s["basis"].tobytes()],
                             "vectors": [s["vectors"].tobytes()], "kept": [s["weight"][s["vocab"]].tobytes()], "rank": [s["basis"].shape[1]]})

    fitted = keep(cut.groupBy("block").applyInPandas(fit, "block long, vocab binary, basis binary, vectors binary, kept binary, rank int"))
    n_blocks = fitted.count()
    for low in range(0, n_blocks, BLOCKS_A_PASS):
        here = (F.col("block") >= low) & (F.col("block") < low + BLOCKS_A_PASS)
        spaces = fitted.where(here).orderBy("block").collect()
        rows = cut.where(here).orderBy("rank").collect()
        blocks, ids, words, tails = [], [], [], []
        for s in spaces:
            mine = [r for r in rows if r["block"] == s["block"]]
            vocab = np.frombuffer(s["vocab"], np.int64)
            own = weight.copy()
            own[vocab] = np.frombuffer(s["kept"], np.float32)
            blocks.append({"vocab": vocab, "basis": np.frombuffer(s["basis"], np.float32).reshape(-1, s["rank"]),
                           "vectors": np.frombuffer(s["vectors"], np.float32).reshape(-1, s["rank"]), "weight": own})
            ids.append([r["item"] for r in mine])
            words.append([[w.encode("utf-8", "surrogatepass") for w in r["words"]] for r in mine])
            tails.append([([w.encode("utf-8", "surrogatepass") for w in r["answer"]], r["rest"]) for r in mine])
        held = spark.sparkContext.broadcast((blocks, ids, words, tails))
        yield _leaks_udf(held, shared, cosine, least, answer)(F.col(text_col)), low + BLOCKS_A_PASS >= n_blocks


def _leaks_udf(held, shared, cosine: float, least: float, answer: float):
    @F.pandas_udf(LEAKS)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*held.value, shared.value, cosine, least, answer)
        for t in texts:
            yield pd.Series(matcher.batch(list(t)), dtype=object)

    return leaks


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
               **kw) -> DataFrame:
    """(id_col, item, cosine, share, answer, start, end) for every row of docs and benchmark item it holds.

    start and end are places of words (ASCII punctuation is no word).  Null, empty texts hold nothing.
    Null ids and repeated rows: rows like any other; repeated items: as one.  An empty table on either
    side: no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col if text_col != "id" else "text"))
    text = rows.columns[1]
    parts = []
    for column, last in leak_columns(rows, items, item_col=item_col, text_col=text, **kw):
        if not parts and not last:  # several passes tell a row by its number
            rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
        part = rows.select(*[c for c in rows.columns if c != text], F.explode(column).alias("x")).select("*", "x.*").drop("x")
        parts.append(part if last and not parts else keep(part))
    if not parts:
        kinds = {f.name: f.dataType for f in LEAKS.elementType}
        return docs.limit(0).select(id_col, *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        best = F.max(F.struct("share", "cosine", "answer", "start", "end")).alias("x")
        found = found.groupBy("row", "item").agg(F.first("id").alias("id"), best).select("id", "item", "x.*")
    return found.select(F.col("id").alias(id_col), "item", "cosine", "share", "answer", "start", "end")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that hold no benchmark item.  Nothing is joined: each text is judged where it lies."""
    out = docs
    for column, last in leak_columns(docs, items, text_col=text_col, **kw):
        out = out.where(F.size(column) == 0)
        out = out if last else keep(out)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.col("item").alias("item_id"), "cosine", "share", "answer", F.col("start").alias("start_word"),
                        F.col("end").alias("end_word"))
