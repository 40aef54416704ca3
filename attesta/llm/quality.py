"""Quality rules: base checks, and a decision list learned from labelled statistics."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attesta.llm.common import ASCII_SPACE, keep, plain, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_upper",
         "n_digits", "n_marks", "n_bytes"]
# features of the rules: shares of the counts above
FEATURES = {
    "words": "stat.n_words",
    "word_length": "stat.word_chars / greatest(stat.n_words, 1)",
    "symbol_share": "stat.n_symbols / greatest(stat.word_chars, 1)",
    "dup_line_share": "stat.n_dup_lines / greatest(stat.n_lines, 1)",
    "repeat_share": "stat.n_repeat_words / greatest(stat.n_words, 1)",
    "distinct_share": "stat.n_distinct / greatest(stat.n_words, 1)",
    "top_share": "stat.n_top / greatest(stat.n_words, 1)",
    "upper_share": "stat.n_upper / greatest(stat.n_bytes, 1)",
    "digit_share": "stat.n_digits / greatest(stat.n_bytes, 1)",
    "mark_share": "stat.n_marks / greatest(stat.word_chars, 1)",
}
_MULT = np.random.default_rng(11).integers(1 << 62, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATS for one text; words stand between ASCII white space.

    Words and their windows are compared by 64-bit hashes.
    """
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = 0
    if n > WINDOW:
        h = ids[:n - WINDOW + 1] * _MULT[0]
        for k in range(1, WINDOW):
            h += ids[k:n - WINDOW + 1 + k] * _MULT[k]
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            found = np.zeros(n + 1, np.int64)
            for at in (order[1:][same], order[:-1][same]):
                at = np.unique(at)
                found[at] = 1
            starts = np.flatnonzero(found)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    distinct = top = 0
    if n:
        counts = np.unique(ids, return_counts=True)[1]
        distinct, top = len(counts), int(counts.max())
    lines = [x for x in t.split("\n") if x.strip(ASCII_SPACE)]
    b = np.frombuffer(raw, np.uint8)
    return (n, len(t) - sum(map(t.count, ASCII_SPACE)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
            len(lines), distinct, top, int(((b >= 65) & (b <= 90)).sum()), int(((b >= 48) & (b <= 57)).sum()), t.count("!") + t.count("?"), len(raw))


@F.pandas_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATS, dtype="int64")


def base_failed(stat: str = "stat") -> Column:
    words = F.col(f"{stat}.n_words")
    return (words < 20) | (100 * F.col(f"{stat}.n_repeat_words") > 30 * words)


@dataclass(frozen=True)
class Test:
    """feature > value, or feature <= value."""
    feature: str
    above: bool
    value: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.value!r}D"

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        col = x[:, names.index(self.feature)]
        return col > self.value if self.above else col <= self.value


def covered(rule: list[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x, names)
    return out


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, longest: int) -> list[Test]:
    """Add the test with the highest information gain until only bad rows are covered."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < longest:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not n0 or not p0:
            break
        best = (0.0, None)
        for k, name in enumerate(names):
            values = x[inside, k]
            for v in np.unique(np.quantile(values, np.linspace(0, 1, cuts + 2)[1:-1], method="nearest")):
                v = float(f"{v:.6g}")
                for above in (True, False):
                    hit = values > v if above else values <= v
                    p, n = (hit & bad[inside]).sum(), (hit & ~bad[inside]).sum()
                    if p and (n < n0 or p < p0):
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Test(name, above, v))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x, names)
    return rule


def prune(rule: list[Test], x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Test]:
    """The shortest start of the rule that does best on rows it was not grown on."""
    def worth(r: list[Test]) -> float:
        c = covered(r, x, names)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, cuts: int = 48, longest: int = 4,
          most: int = 24, seed: int = 5) -> list[list[Test]]:
    """Sequential covering: grow a rule on two thirds of the rows left, prune it on the rest, take out what it covers.

    Ends when a rule is right for less than `precision` of what it covers (counted on all rows left) or for
    one row only, or no bad row is left.
    """
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    while len(rules) < most and bad[left].sum() > 1:
        at = rng.permutation(np.flatnonzero(left))
        cut = len(at) * 2 // 3
        rule = prune(grow(x[at[:cut]], bad[at[:cut]], names, cuts, longest), x[at[cut:]], bad[at[cut:]], names)
        if not rule:
            break
        hit = covered(rule, x, names) & left
        if (hit & bad).sum() < max(2, precision * hit.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    arms = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {arms} ELSE true END")


def fit_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id",
              label_col: str = "quality", **kw) -> list[list[Test]]:
    """Rules from at most `max_rows` labelled rows, taken by the smallest hashes of their ids and statistics.

    The rows are a bounded sample, so they may be fitted on the driver.  Rows that fail a base check are
    decided already and not learned from.  Without labels, or with labels of
    one kind only, there are no rules.  Null labels and ids are left out.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    marked = marked.orderBy(F.xxhash64("__id"), "__y").limit(max_rows)
    rows = stats.join(F.broadcast(marked), stats[id_col] == marked["__id"])
    rows = rows.where(~base_failed()).select("__y", F.xxhash64("__id", "stat").alias("__h"), *[F.expr(f"cast({e} as double)").alias(n) for n, e in FEATURES.items()])
    got = rows.orderBy("__h", "__y").limit(max_rows).toPandas()
    names = list(FEATURES)
    return learn(got[names].to_numpy(float), got["__y"].to_numpy() == 0, names, **kw) if len(got) else []


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs' ids with `stat` (counts), base_failed and kept, one row for every row of docs.

    kept is false if a base check fails, else what the learned list says.  Statistics cover whole texts of
    all documents; they are written once and read for the fit and for the verdict.
    Null, empty or blank text: counts 0, base_failed.  Null id: judged, never labelled.  Repeated rows: one
    row each.  Empty table: no rows.  Other columns are not read.
    """
    stats = keep(docs.select(id_col, text_statistics(text_col).alias("stat"), F.xxhash64(text_col).alias("mark")))
    rules = fit_rules(stats, labels, id_col=id_col, **kw)
    failed = base_failed()
    return stats.select(id_col, "stat", "mark", failed.alias("base_failed"), (~failed & decision(rules)).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that with_quality keeps.  Texts stay where they are: counts are taken twice, not shuffled."""
    sample = labels.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    sample = sample.orderBy(F.xxhash64("__id")).limit(kw.get("max_rows", 20_000))
    some = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    some = some.join(F.broadcast(sample), some[id_col] == sample["__id"], "left_semi")
    rules = fit_rules(keep(some.select(id_col, text_statistics("__text").alias("stat"))), labels, id_col=id_col, **kw)
    rows, (text,) = plain(docs, text_col)
    judged = rows.withColumn("stat", text_statistics(text))
    return judged.where(~base_failed() & decision(rules)).drop("stat").toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base checks and the learned verdict for every document."""
    q = with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return q.select("doc_id", *[f"stat.{s}" for s in STATS[:5]], "base_failed", "kept")
