"""Windows around the matches of a pattern, found by folds inside the row that holds the text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from attesta import constants as K

RUN = 256                     # matches of one inner fold; lists grow per run, so a text with many matches stays linear
SPANS = "array<struct<start: int, stop: int>>"
WINDOWS = "array<struct<start: int, stop: int, n: int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _runs(items: Column) -> Column:
    """A list as lists of RUN items at most."""
    n = F.size(items)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(RUN))).otherwise(_empty("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k, F.lit(RUN)))


def match_spans(text: Column, pattern: str) -> Column:
    """(start, stop) of every match in order, 0-based code points; the pattern must not match an empty text."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    sizes = bound(F.struct(gaps.alias("g"), found.alias("m")), lambda b: F.zip_with(
        F.slice(b["g"], F.lit(1), F.size(b["m"])), b["m"], lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))))

    def place(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["gap"]).cast("int")
        stop = (start + x["size"]).cast("int")
        return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"))).alias("out"))

    def place_run(acc: Column, run: Column) -> Column:
        done = F.aggregate(run, F.struct(acc["at"].alias("at"), _empty(SPANS).alias("out")), place)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

    first = F.struct(F.lit(0).alias("at"), _empty(f"array<{SPANS}>").alias("out"))
    return F.flatten(F.aggregate(bound(sizes, _runs), first, place_run)["out"])


def _joined(spans: Column, limit: Callable[[Column, Column], Column] | None, start_of, stop_of, gap: int) -> Column:
    """struct(windows, dropped): spans widened and united while they lie within `gap` of the window before.

    `limit(state, span)` tells whether a span is left out.
    """
    def take(acc: Column, s: Column) -> Column:
        start, stop = start_of(s), stop_of(s)
        near = (acc["open"]["n"] > 0) & (start <= acc["open"]["stop"] + gap)
        reach = F.greatest(acc["open"]["stop"], stop)
        taken = F.when(near, F.struct(
            F.struct(acc["open"]["start"].alias("start"), reach.alias("stop"), (acc["open"]["n"] + 1).alias("n")).alias("open"),
            (acc["used"] + reach - acc["open"]["stop"]).alias("used"), acc["count"].alias("count"),
            acc["closed"].alias("closed"), acc["dropped"].alias("dropped"))).otherwise(F.struct(
                F.struct(start.alias("start"), stop.alias("stop"), F.lit(1).alias("n")).alias("open"),
                (acc["used"] + stop - start).alias("used"), (acc["count"] + 1).alias("count"),
                F.when(acc["open"]["n"] > 0, F.array_append(acc["closed"], acc["open"])).otherwise(acc["closed"]).alias("closed"),
                acc["dropped"].alias("dropped")))
        if limit is None:
            return taken
        left = F.struct(acc["open"].alias("open"), acc["used"].alias("used"), acc["count"].alias("count"), acc["closed"].alias("closed"),
                        F.array_append(acc["dropped"], F.struct(start.alias("start"), stop.alias("stop"))).alias("dropped"))
        return F.when(limit(acc, s), left).otherwise(taken)

    def state(acc: Column, closed: Column, dropped: Column) -> Column:
        return F.struct(acc["open"].alias("open"), acc["used"].alias("used"), acc["count"].alias("count"), closed.alias("closed"), dropped.alias("dropped"))

    def take_run(acc: Column, run: Column) -> Column:
        done = F.aggregate(run, state(acc, _empty(WINDOWS), _empty(SPANS)), take)
        return bound(done, lambda d: state(d, F.array_append(acc["closed"], d["closed"]), F.array_append(acc["dropped"], d["dropped"])))

    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).alias("n"))
    first = F.struct(none.alias("open"), F.lit(0).alias("used"), F.lit(0).alias("count"),
                     _empty(f"array<{WINDOWS}>").alias("closed"), _empty(f"array<{SPANS}>").alias("dropped"))
    return bound(F.aggregate(_runs(spans), first, take_run), lambda d: F.struct(
        F.concat(F.flatten(d["closed"]), F.when(d["open"]["n"] > 0, F.array(d["open"])).otherwise(_empty(WINDOWS))).alias("windows"),
        F.flatten(d["dropped"]).alias("dropped")))


def evidence(text: Column, pattern: str, context: int = 120, join_gap: int = 64) -> Column:
    """The windows (start, stop, n) of `context` characters around the matches; windows that nearly touch are one."""
    return bound(F.struct(text.alias("t"), match_spans(text, pattern).alias("s")), lambda b: _joined(
        b["s"], None, lambda s: F.greatest(F.lit(0), s["start"] - context), lambda s: F.least(F.length(b["t"]), s["stop"] + context), join_gap)["windows"])


def focused(text: Column, pattern: str, max_chars: int = 50_000, tail_chars: int = 10_000, head_chars: int = 2_000,
            context: int = 120, per_match: int = 260, join_gap: int = 64, rounds: int = 4) -> Column:
    """A long text reduced to its head, the windows around the matches of a pattern, and its tail.

    struct(text, head, windows, dropped): head is the number of characters kept at the start, windows (start, stop,
    n) are what follows of the matches' windows, dropped the windows that went over the budget.  The budget is
    what head and tail leave, or `per_match` for each match; it is shared evenly, `context` at least on each
    side.  What the windows leave goes back to the head, which may take in windows, in `rounds` rounds.  Texts of
    max_chars at most are whole; a text without a match keeps head and tail.  Null text: null.
    """
    body = max_chars - tail_chars

    def cut(b: Column) -> Column:
        spans, size = b["s"], F.length(b["t"])
        n = F.size(spans)
        budget = F.greatest(F.lit(body - head_chars), n * per_match)
        matched = F.aggregate(spans, F.lit(0), lambda a, s: a + s["stop"] - s["start"])
        around = F.greatest(F.lit(context), F.floor((budget - matched) / (2 * n)).cast("int"))
        return bound(F.struct(budget.alias("budget"), around.alias("around")), lambda c: bound(_joined(
            spans, lambda acc, s: acc["used"] + s["stop"] - s["start"] + 2 * c["around"] > c["budget"] + 64 * acc["count"],
            lambda s: F.greatest(F.lit(0), s["start"] - c["around"]), lambda s: F.least(size, s["stop"] + c["around"]), join_gap),
            lambda w: _told(b["t"], w)))

    def beyond(windows: Column, head: Column) -> Column:
        return F.transform(F.filter(windows, lambda w: w["stop"] > head),
                           lambda w: F.struct(F.greatest(w["start"], head).alias("start"), w["stop"].alias("stop"), w["n"].alias("n")))

    def _told(t: Column, w: Column) -> Column:
        def grow(acc: Column, _: Column) -> Column:
            left = F.filter(w["windows"], lambda x: x["stop"] > acc["head"])
            used = F.aggregate(left, F.lit(0), lambda a, x: a + x["stop"] - F.greatest(x["start"], acc["head"]))
            more = F.greatest(F.lit(head_chars), F.least(F.lit(body) - used - 128 * F.greatest(F.size(left), F.lit(1)), F.lit(body)))
            return F.struct((F.greatest(acc["head"], F.when(acc["done"], acc["head"]).otherwise(more))).alias("head"),
                            (acc["done"] | (more <= acc["head"])).alias("done"))

        grown = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(head_chars).alias("head"), F.lit(False).alias("done")), grow)["head"]

        def told(head: Column) -> Column:
            windows = beyond(w["windows"], head)
            pieces = F.transform(windows, lambda x: F.substring(t, x["start"] + 1, x["stop"] - x["start"]))
            missing = F.when(F.size(w["dropped"]) > 0, F.concat(F.lit(K.CUT_DROPPED[0]), F.size(w["dropped"]).cast("string"), F.lit(K.CUT_DROPPED[1]))).otherwise("")
            whole = F.concat(F.substring(t, F.lit(1), head), F.lit(K.CUT_FOCUS), F.array_join(pieces, K.CUT_MIDDLE), F.lit(K.CUT_MIDDLE), missing,
                             F.substring(t, -tail_chars, tail_chars))
            return F.struct(whole.alias("text"), head.alias("head"), windows.alias("windows"), w["dropped"].alias("dropped"))
        return bound(grown, told)

    def plain(whole: Column, head: Column) -> Column:
        return F.struct(whole.alias("text"), head.cast("int").alias("head"), _empty(WINDOWS).alias("windows"), _empty(SPANS).alias("dropped"))

    ends = F.concat(F.substring(text, 1, body), F.lit(K.CUT_MIDDLE), F.substring(text, -tail_chars, tail_chars))
    return (F.when(text.isNull(), F.lit(None))
            .when(F.length(text) <= max_chars, plain(text, F.length(text)))
            .otherwise(bound(F.struct(text.alias("t"), match_spans(text, pattern).alias("s")),
                             lambda b: F.when(F.size(b["s"]) == 0, plain(ends, F.lit(body))).otherwise(cut(b)))))
