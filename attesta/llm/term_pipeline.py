"""Ranked lexical search: items pass from one owner of terms to the next and carry what documents have scored so far."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import keep, numbered, plain, table

ITEMS = 256                   # items that are searched at once
CELL = 1024                   # documents of a bundle
OWNERS = 4                    # stages of a search
COLUMNS = 2048                # terms whose weights a task spreads out at once
UNIT = 1_000_000_000          # what a term's share of a document is counted in
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


@dataclass
class Terms:
    """The terms of one block of items and who owns them; nothing in it grows with the documents."""
    counts: np.ndarray            # terms x items: how often an item holds a term
    weight: np.ndarray            # of every term
    owner: np.ndarray             # of every term
    rest: np.ndarray              # owners x items: the most that later owners can add to a document's score
    n_docs: int
    n_terms: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        """A document's m by its number of terms."""
        return 25 + (75 * n * self.n_docs) // self.n_terms


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (1000 * tf + 8 * m)


def item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item, text in zip(batch["item"], batch["text"]):
            found: dict[bytes, int] = {}
            for t in terms_of(text):
                found[t] = found.get(t, 0) + 1
            yield pd.DataFrame({"item": item, "term": list(found), "times": list(found.values())})


def cells(batches: Iterator[pd.DataFrame], vocabulary: dict[bytes, int]) -> Iterator[pd.DataFrame]:
    """A row for CELL documents: their ids and sizes, and (document, term, occurrences) of the items' terms."""
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, len(batch), CELL):
            rows = batch.iloc[start:start + CELL]
            sizes, found = [], []
            for k, text in enumerate(rows["text"]):
                terms = terms_of(text)
                sizes.append(len(terms))
                ids = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int64, len(terms))
                term, times = np.unique(ids[ids >= 0], return_counts=True)
                found.append((np.full(len(term), k, np.int32), term.astype(np.int32), times.astype(np.int32)))
            doc, term, times = (np.concatenate([f[k] for f in found]) for k in range(3))
            yield pd.DataFrame({"cell": [at], "ids": [rows["id"].to_numpy()], "no_id": [rows["no_id"].to_numpy()],
                                "sizes": [np.array(sizes, np.int64)], "doc": [doc], "term": [term], "times": [times]})
            at += 1


def spread(batches: Iterator[pd.DataFrame], n_docs: int, n_terms: int, width: int) -> Iterator[pd.DataFrame]:
    """How many documents hold each term and the largest share it has in one."""
    for batch in batches:
        df, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for sizes, doc, term, times in zip(batch["sizes"], batch["doc"], batch["term"], batch["times"]):
            m = 25 + (75 * np.asarray(sizes, np.int64) * n_docs) // n_terms
            np.add.at(df, term, 1)
            np.maximum.at(best, term, share(np.asarray(times, np.int64), m[doc]))
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "df": df[held], "best": best[held]})


def owned(batches: Iterator[pd.DataFrame], terms: Terms, owner: int) -> Iterator[pd.DataFrame]:
    """The postings of one owner's terms, a row for each cell."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            mine = terms.owner[r.term] == owner
            out.append((r.cell, r.ids, r.no_id, r.sizes, r.doc[mine], r.term[mine], r.times[mine]))
        yield pd.DataFrame(out, columns=["cell", "ids", "no_id", "sizes", "doc", "term", "times"])


POSTINGS = "cell bigint, ids array<bigint>, no_id array<boolean>, sizes array<bigint>, doc array<int>, term array<int>, times array<int>"
BUNDLES = "cell bigint, item int, open boolean, docs array<int>, scores array<bigint>"
RANKED = "item int, doc_id bigint, score bigint"


def added(postings: pd.DataFrame, terms: Terms) -> np.ndarray:
    """What one owner's terms add to the score of every document of a cell for every item."""
    row = postings.iloc[0]
    doc, term = np.asarray(row["doc"], np.int64), np.asarray(row["term"], np.int64)
    m = terms.damping(np.asarray(row["sizes"], np.int64))
    worth = terms.weight[term] * share(np.asarray(row["times"], np.int64), m[doc])
    # sums of whole numbers below 2^53 are exact in doubles
    most = int(terms.weight.max(initial=0)) * UNIT // 1000 * max(int(terms.counts.sum(axis=0).max(initial=0)), 1)
    kind = np.float64 if most < 1 << 53 else np.int64
    out = np.zeros((len(m), terms.counts.shape[1]), kind)
    used = np.unique(term)
    for at in range(0, len(used), COLUMNS):
        part = used[at:at + COLUMNS]
        here = (term >= part[0]) & (term <= part[-1])
        grid = np.zeros((len(m), len(part)), kind)
        grid[doc[here], np.searchsorted(part, term[here])] = worth[here]
        out += grid @ terms.counts[part].astype(kind)
    return out.astype(np.int64)


def scored(bundles: pd.DataFrame | None, postings: pd.DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(scores so far, whether an item still takes up new documents) after one owner's stage."""
    scores = added(postings, terms)
    open_ = np.ones(scores.shape[1], bool)
    if bundles is not None and len(bundles):
        before = np.zeros_like(scores)
        for item, still, docs, so_far in zip(bundles["item"], bundles["open"], bundles["docs"], bundles["scores"]):
            before[docs, item] = so_far
            open_[item] = still
        scores[(before == 0) & ~open_] = 0
        scores += before
    return scores, open_


def carried(scores: np.ndarray, open_: np.ndarray, rest: np.ndarray, cell: int, top: int) -> pd.DataFrame:
    """The bundles that go on: documents that can still be among the `top` of their cell, and so of all."""
    floor = np.zeros(scores.shape[1], np.int64)
    if len(scores) >= top:
        floor = np.partition(scores, len(scores) - top, axis=0)[len(scores) - top]
    stays = (scores > 0) & (scores + rest >= floor)
    open_ = open_ & (rest >= floor)
    out = []
    for item in np.flatnonzero(stays.any(axis=0) | ~open_):
        docs = np.flatnonzero(stays[:, item])
        out.append((cell, item, bool(open_[item]), docs.astype(np.int32), scores[docs, item]))
    return pd.DataFrame(out, columns=["cell", "item", "open", "docs", "scores"])


def best_of(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, top: int) -> pd.DataFrame:
    """The `top` documents of a cell for every item; equal scores by id, none first."""
    out = []
    for item in np.flatnonzero((scores > 0).any(axis=0)):
        column = scores[:, item]
        docs = np.flatnonzero(column)
        if len(docs) > top:
            docs = docs[column[docs] >= np.partition(column[docs], len(docs) - top)[len(docs) - top]]
        docs = docs[np.lexsort((ids[docs], ~no_id[docs], -column[docs]))][:top]
        out += [(item, None if no_id[d] else int(ids[d]), int(column[d])) for d in docs]
    return pd.DataFrame({"item": [o[0] for o in out], "doc_id": pd.array([o[1] for o in out], "Int64"), "score": [o[2] for o in out]})


# ------------------------------------------------------------------ the operator
def _search(texts: DataFrame, asked: DataFrame, n_items: int, top: int) -> DataFrame | None:
    """(item, doc_id, score): the candidates of all cells for one block of items; None without common terms."""
    held = asked.mapInPandas(item_terms, "item int, term binary, times int").collect()
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in held}))}
    if not vocabulary:
        return None
    counts = np.zeros((len(vocabulary), n_items), np.int32)
    for r in held:
        counts[vocabulary[bytes(r["term"])], r["item"]] = r["times"]
    lots = keep(texts.mapInPandas(lambda b: cells(b, vocabulary), POSTINGS))
    zero = F.lit(0).cast("long")
    total = lots.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))).alias("docs"),
                     F.sum(F.aggregate("sizes", zero, lambda a, n: a + n)).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    if not n_docs:
        return None
    width = len(vocabulary)
    stats = (lots.mapInPandas(lambda b: spread(b, n_docs, n_terms, width), "term int, df bigint, best bigint")
             .groupBy("term").agg(F.sum("df").alias("df"), F.max("best").alias("best")).collect())
    df, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for r in stats:
        df[r["term"]], best[r["term"]] = r["df"], r["best"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    # rare terms first; an owner holds about as many postings as all owners before it
    order = np.argsort(df, kind="stable")
    passed = np.cumsum(df[order])
    owner = np.zeros(width, np.int64)
    owner[order] = sum((passed > passed[-1] >> (OWNERS - 1 - k)).astype(np.int64) for k in range(OWNERS - 1))
    most = counts.astype(np.int64) * (weight * best)[:, None]
    rest = np.array([most[owner > k].sum(axis=0) for k in range(OWNERS)])
    terms = Terms(counts, weight, owner, rest, n_docs, n_terms)

    def first(postings: pd.DataFrame) -> pd.DataFrame:
        scores, open_ = scored(None, postings, terms)
        return carried(scores, open_, terms.rest[0], postings["cell"].iloc[0], top)

    def onward(stage: int):
        def go(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
            scores, open_ = scored(bundles, postings, terms)
            if stage < OWNERS - 1:
                return carried(scores, open_, terms.rest[stage], postings["cell"].iloc[0], top)
            row = postings.iloc[0]
            return best_of(scores, np.asarray(row["ids"]), np.asarray(row["no_id"], bool), top)
        return go

    def of(stage: int) -> DataFrame:
        return lots.mapInPandas(lambda b: owned(b, terms, stage), POSTINGS)

    bundles = of(0).groupBy("cell").applyInPandas(first, BUNDLES)
    for stage in range(1, OWNERS):
        last = stage == OWNERS - 1
        bundles = bundles.groupBy("cell").cogroup(of(stage).groupBy("cell")).applyInPandas(onward(stage), RANKED if last else BUNDLES)
    return bundles


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with a score above 0 for every item, exactly.

    A score is a sum over the item's terms, repeats included, of the term's weight (rarity, in thousandths) times
    its damped share of the document, in whole numbers.  Terms are owned by OWNERS stages, rare ones by the
    first.  The documents lie in cells; a bundle is an item with the scores of a cell's documents so far.  It meets
    the postings of one owner after the other, which add what their terms are worth, and drops documents that
    cannot be among the best of their cell any more even with all that is still to come.  ITEMS items are searched
    at once, one block after another; what tasks are sent is the terms of a block, whatever the number of documents.

    Null text or item: no terms.  Null ids: before all others among equal scores.  Repeated documents: each
    one ranks.  Repeated items (id and text): one.  Very long texts: no limit.  Empty tables: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows, (key, text) = plain(docs, id_col, text_col)
    texts = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(key).isNull().alias("no_id"),
                        F.col(text).cast("binary").alias("text"))
    asked, (name, body) = plain(items, item_col, item_text)
    asked = numbered(asked.select(F.col(name).alias("name"), F.col(body).alias("text")).distinct(), F.struct("name", "text"), "at")
    n = asked.count()
    found = None
    for start in range(0, n, ITEMS):
        block = asked.where(F.col("at").between(start, start + ITEMS - 1)).withColumn("item", (F.col("at") - start).cast("int"))
        hits = _search(texts, block.select("item", F.col("text").cast("binary").alias("text")), min(ITEMS, n - start), top)
        if hits is None:
            continue
        by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        ranked = keep(hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
                      .join(block.select("item", F.col("name").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score"))
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        kind = items.schema[item_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT DISTINCT item_id, text FROM benchmark) b, unnest(regexp_extract_all(translate(b.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM tf JOIN n USING (doc_id) JOIN w USING (term) JOIN q USING (term), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
