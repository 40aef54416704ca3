"""Cheapest edits that give dialogues a legal structure, found by Hirschberg's divide and conquer."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.llm.common import keep, numbered, plain, table

BLOCK = 2048                        # turns, or units of turns, that one step of the recursion looks at
SYSTEM, USER, ASSISTANT = 1, 2, 3   # states after a turn of that role; 0: before any turn
FOLLOWS = (USER, USER, ASSISTANT, USER)
TAIL = ("", "II", "I", "")          # what makes a dialogue that ends in a state legal
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
KEPT, GONE, CUT = 0, 1, 2           # a turn's duty: none, has to be deleted, costs one more unless deleted
NEVER = 1 << 40

# (cost, order) of a stretch of turns, each four by four from the state before to the state after it.  order ranks
# the best audits of one state before by the alphabet; no audit is the beginning of another, as all end with
# the last turn.
Unit = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


def steps(initial: str, duty: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, edits) of the best way over one turn, insertions before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, cost, made = before, 0, ""
        for _ in range(4):
            ways = [("D", state)]
            if duty != GONE:
                ways.append(("R", FOLLOWS[state]))
                if initial == "s" and state == 0:
                    ways.append(("K", SYSTEM))
                elif initial in ("u", "a") and FOLLOWS[state] == (USER if initial == "u" else ASSISTANT):
                    ways.append(("K", FOLLOWS[state]))
            for edit, after in ways:
                found = (cost + COST[edit] + (1 if duty == CUT and edit != "D" else 0), made + edit)
                best[before, after] = min(best.get((before, after), (NEVER, "")), found)
            state, cost, made = FOLLOWS[state], cost + COST["I"], made + "I"
    return best


KINDS = [steps(i, d) for i in ("s", "u", "a", "") for d in (KEPT, GONE, CUT)]


def unit_of(ways: dict[tuple[int, int], tuple[int, str]]) -> Unit:
    cost = tuple(tuple(ways.get((p, c), (NEVER, ""))[0] for c in range(4)) for p in range(4))
    order = []
    for p in range(4):
        ranked = sorted(range(4), key=lambda c: (ways.get((p, c), (NEVER, "~"))[1], c))
        order.append(tuple(ranked.index(c) for c in range(4)))
    return cost, tuple(order)


TURN_UNITS = [unit_of(k) for k in KINDS]
Front = tuple[list[int], list[int]]


def forward(front: Front, unit: Unit) -> Front:
    """Costs and order of the states after a unit from those before it."""
    cost, order = front
    ways = []
    for after in range(4):
        ways.append(min((cost[p] + unit[0][p][after], order[p], unit[1][p][after], p) for p in range(4)))
    rank = [0, 0, 0, 0]
    for k, after in enumerate(sorted(range(4), key=lambda c: (ways[c][0] >= NEVER, ways[c][1], ways[c][2]))):
        rank[after] = k
    return [min(w[0], NEVER) for w in ways], rank


def backward(cost: list[int], unit: Unit) -> list[int]:
    return [min(min(unit[0][p][c] + cost[c] for c in range(4)), NEVER) for p in range(4)]


def entering(state: int) -> Front:
    return [0 if p == state else NEVER for p in range(4)], [0 if p == state else 1 for p in range(4)]


def merged(units: list[Unit]) -> Unit:
    """The unit of a run of units."""
    cost, order = [], []
    for state in range(4):
        front = entering(state)
        for u in units:
            front = forward(front, u)
        cost.append(tuple(front[0]))
        order.append(tuple(front[1]))
    return tuple(cost), tuple(order)


def last_state(units: list[Unit], first: int = 0) -> int:
    """The state a dialogue best ends in before its legal ending is added."""
    front = entering(first)
    for u in units:
        front = forward(front, u)
    return min(range(4), key=lambda c: (front[0][c] + COST["I"] * len(TAIL[c]), front[1][c]))


def crossings(units: list[Unit], first: int, last: int) -> list[int]:
    """The states before, between and after the units on the best path: costs from both ends meet in the middle, then each half alone.

    Of the states with the least sum the one with the least audit before it is taken, so the whole audit is
    the least of all the cheapest.  Only four costs from each end are held beside the states themselves.
    """
    states = [first] + [0] * (len(units) - 1) + [last]
    left = [(0, len(units))]
    while left:
        a, b = left.pop()
        if b - a < 2:
            continue
        mid = (a + b) // 2
        front = entering(states[a])
        for k in range(a, mid):
            front = forward(front, units[k])
        back = [0 if c == states[b] else NEVER for c in range(4)]
        for k in range(b - 1, mid - 1, -1):
            back = backward(back, units[k])
        states[mid] = min(range(4), key=lambda c: (front[0][c] + back[c], front[1][c]))
        left += [(a, mid), (mid, b)]
    return states


# ------------------------------------------------------------------ in tasks
def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted rows and where in them each (dialogue, unit) starts and stops, every unit whole."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        dialogue, unit = rows["dialogue"].to_numpy(), rows["unit"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (dialogue[1:] != dialogue[:-1]) | (unit[1:] != unit[:-1])]).tolist()
        rest = rows.iloc[cuts[-1]:]
        if len(cuts) > 1:
            yield rows.iloc[:cuts[-1]], list(zip(cuts, cuts[1:]))
    if rest is not None:
        yield rest, [(0, len(rest))]


def _units(rows: pd.DataFrame) -> list[Unit]:
    if "kind" in rows:
        return [TURN_UNITS[k] for k in rows["kind"].tolist()]
    four = lambda v: tuple(tuple(int(x) for x in v[4 * p:4 * p + 4]) for p in range(4))
    return [(four(c), four(o)) for c, o in zip(rows["cost"], rows["order"])]


def merge_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One unit for each (dialogue, unit) of sorted rows."""
    for rows, cuts in runs_of(batches):
        units, out = _units(rows), []
        for a, b in cuts:
            cost, order = merged(units[a:b])
            out.append((rows["dialogue"].iloc[a], rows["unit"].iloc[a], [x for r in cost for x in r], [x for r in order for x in r]))
        yield pd.DataFrame(out, columns=["dialogue", "place", "cost", "order"])


def enter_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states before and after each child of the units of sorted rows; a last of -1 is still free."""
    for rows, cuts in runs_of(batches):
        units, firsts, lasts = _units(rows), rows["first"].tolist(), rows["last"].tolist()
        before, after = [], []
        for a, b in cuts:
            states = crossings(units[a:b], firsts[a], last_state(units[a:b], firsts[a]) if lasts[a] < 0 else lasts[a])
            before += states[:-1]
            after += states[1:]
        yield pd.DataFrame({"dialogue": rows["dialogue"], "unit": rows["place"], "first": before, "last": after})


def edit_turns(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The edits at every turn of the units of sorted rows, and the roles they give."""
    known: dict[tuple, tuple[list[str], list[str]]] = {}
    for rows, cuts in runs_of(batches):
        kinds, firsts, lasts, ends = (rows[c].tolist() for c in ("kind", "first", "last", "ends"))
        edits, gives = [], []
        for a, b in cuts:
            asked = (tuple(kinds[a:b]), firsts[a], lasts[a], ends[a])
            if b - a > 32:
                found = _edits(*asked)
            else:
                if len(known) > 10_000:
                    known.clear()
                found = known[asked] if asked in known else known.setdefault(asked, _edits(*asked))
            edits += found[0]
            gives += found[1]
        yield rows.assign(edits=edits, gives=gives)[columns]


def _edits(kinds: tuple, first: int, last: int, ends: bool) -> tuple[list[str], list[str]]:
    units = [TURN_UNITS[k] for k in kinds]
    if last < 0:
        last = last_state(units, first)
    states = crossings(units, first, last)
    edits = [KINDS[k][p, c][1] for k, p, c in zip(kinds, states, states[1:])]
    if ends:
        edits[-1] += TAIL[last]
    gives = []
    for kind, made, state in zip(kinds, edits, states):
        roles = ""
        for e in made:
            if e != "D":
                state = SYSTEM if e == "K" and state == 0 and kind // 3 == 0 else FOLLOWS[state]
            roles += {"D": "-", "K": "="}.get(e, "ua"[state - USER])
        gives.append(roles)
    return edits, gives


# ------------------------------------------------------------------ the operator
SPACE = r"\x20\x09-\x0D"


def turn_faults(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(dialogue, conv, place, turn, role, text, fault, kind, n): turns in order, kept; nulls in role and text are one space.

    dialogue is a number of the conversation, n its turns.  The order is turn (null first), role, text; it is cut
    into ranges, so a conversation with a large part of all rows lies in many tasks.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(rows, F.struct("conv", "turn", "role", "text"), "at", parts)
    whole = rows.groupBy("conv").agg(F.min("at").alias("dialogue"), F.count("*").alias("n")).withColumnRenamed("conv", "of")
    rows = rows.join(whole, F.col("conv").eqNullSafe(F.col("of"))).withColumn("place", F.col("at") - F.col("dialogue"))
    named = rows.withColumns({"t1": F.xxhash64(F.lit(1), "text"), "t2": F.xxhash64(F.lit(2), "text")})
    again = (named.groupBy("dialogue", "role", "t1", "t2").agg(F.min("place").alias("seen"), F.count("*").alias("times"))
             .where("times > 1").drop("times"))
    named = named.join(again, ["dialogue", "role", "t1", "t2"], "left")
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("seen") < F.col("place"), "duplicate")
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated"))
    duty = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(KEPT)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return keep(named.withColumn("fault", fault).select("dialogue", "conv", "place", "turn", "role", "text", "fault",
                                                       (letter * 3 + duty).alias("kind"), "n"))


def _sorted(df: DataFrame) -> DataFrame:
    # a number of partitions of its own: the rows are small, the work on them is not
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "dialogue", "unit").sortWithinPartitions("dialogue", "unit", "place")


def unit_states(turns: DataFrame, block: int) -> DataFrame:
    """(dialogue, unit, first, last): the states at the ends of every block of the dialogues with several blocks, kept.

    Blocks are summed up to units, blocks of units again, until a dialogue is one block of units; from there
    the states are settled downwards.  So no task sees more than `block` turns or units of a dialogue at once.
    """
    unit_rows = "dialogue bigint, place bigint, cost array<bigint>, order array<bigint>"
    of_block = F.floor(F.col("place") / block).cast("long")
    levels = [turns.select("dialogue", "place", "kind")]
    most = turns.agg(F.max("n")).first()[0]
    while most > block:
        levels.append(keep(_sorted(levels[-1].withColumn("unit", of_block)).mapInPandas(merge_units, unit_rows)))
        most = -(-most // block)
    states = levels[-1].select("dialogue").distinct().select("dialogue", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("first"), F.lit(-1).alias("last"))
    for level in reversed(levels[1:]):
        children = level.withColumn("unit", of_block).join(states, ["dialogue", "unit"])
        states = keep(_sorted(children).mapInPandas(enter_units, "dialogue bigint, unit bigint, first int, last int"))
    return states


def repair_edits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for every turn: (dialogue, conv, place, turn, role, text, fault, edits, gives).

    A repaired dialogue's role initials are `(s?(ua)+)?`.  `edits` are the letters of the cheapest edits at the
    turn, in order, insertions beside it included: K keep (0), R give it the role user or assistant (2), D delete (3;
    a must for blank and duplicate turns), I insert an empty turn (2); a truncated turn that stays costs 1 more.  Of
    equally cheap audits it is the least by the alphabet.  `gives` holds a letter for each edit: u or a the role given,
    = the turn's own, - none.

    Null conv: one dialogue.  Null turn: first.  Null role or text: one space.  Equal turns: by role, then text.  Repeated
    rows: the later ones are duplicates.  Very long dialogues: in blocks.  Empty table: no rows.  Other columns are not read.
    """
    rows = turn_faults(turns, conv, turn, role, text)
    unit = F.floor(F.col("place") / block).cast("long")
    columns = ["dialogue", "conv", "place", "turn", "role", "text", "fault"]
    short = rows.where(F.col("n") <= block).withColumns({"unit": F.lit(0).cast("long"), "first": F.lit(0), "last": F.lit(-1), "ends": F.lit(True)})
    work = short.select(*columns, "kind", "unit", "first", "last", "ends")
    long = rows.where(F.col("n") > block)
    if not long.isEmpty():
        long = long.withColumn("unit", unit).join(unit_states(long, block), ["dialogue", "unit"])
        work = work.unionByName(long.withColumn("ends", F.col("unit") == F.floor((F.col("n") - 1) / block)).select(*work.columns))
    # a conversation's own value stays out of the tasks' frames, where a null would change the others
    named = ["dialogue", "place", "kind", "unit", "first", "last", "ends"]
    out = ["dialogue", "place", "edits", "gives"]
    found = _sorted(work.select(*named)).mapInPandas(
        lambda batches: edit_turns(batches, out), "dialogue bigint, place bigint, edits string, gives string")
    return work.select(*columns).join(found, ["dialogue", "place"])


def repaired_turns(edits: DataFrame) -> DataFrame:
    """(conv, place, step, edit, role, text): the turns of the repaired dialogues, in the order of place and step."""
    made = F.arrays_zip(F.split("edits", "").alias("edit"), F.split("gives", "").alias("role"))
    rows = edits.select("conv", "place", "role", "text", F.posexplode(made).alias("step", "m")).where(F.col("m.role").isin("u", "a", "="))
    given = F.when(F.col("m.role") == "u", "user").when(F.col("m.role") == "a", "assistant").otherwise(F.col("role"))
    return rows.select("conv", "place", "step", F.col("m.edit").alias("edit"), given.alias("role"),
                       F.when(F.col("m.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, audit and hash of the dialogues of sorted rows; a dialogue passes row by row."""
    out, now, d = [], None, {}

    def close() -> None:
        if now is not None:
            out.append((now, d["blank"], d["duplicate"], d["truncated"], d["illegal"], d["cost"], "".join(d["audit"]), d["sha"].hexdigest()))

    for batch in batches:
        for dialogue, role, text, fault, edits, gives in zip(*(batch[c] for c in ("dialogue", "role", "text", "fault", "edits", "gives"))):
            if dialogue != now:
                close()
                now, d = dialogue, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
            elif d["last"] + role[:1] not in ("su", "ua", "au"):
                d["illegal"] += 1
            d["last"] = role[:1]
            if fault:
                d[fault] += 1
            d["audit"].append(edits)
            for e, g in zip(edits, gives):
                d["cost"] += COST[e] + (fault == "truncated" and e in "KR")
                if g != "-":
                    name = {"u": "user", "a": "assistant"}.get(g, role)
                    line = f"{name}:" if e == "I" else f"{name}:{text}"
                    d["sha"].update((("\n" if d["any"] else "") + line).encode("utf-8", "surrogatepass"))
                    d["any"] = True
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=DIGEST)
            out = []
    close()
    yield pd.DataFrame(out, columns=DIGEST)


DIGEST = ["dialogue", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DIGEST_ROWS = "dialogue bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of their keys; nulls are one space."""
    rows, (conv, turn, role, text) = plain(turns, "conv_id", "turn", "role", "text")
    spaced: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    draw = (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).cast("int")
    rows = rows.withColumn("draw", draw).where(F.col("draw") != 0)
    rows = rows.withColumn("text", F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("time", F.explode(times)).drop("draw", "time")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text of every conversation after planted damage.

    The hash of a repaired conversation reads its text in order, so the turns of one conversation pass through
    one task here, row by row; the repair itself does not.
    """
    turns = table(spark, sf_dir, "conversations")
    edits = keep(repair_edits(damaged(turns)))
    totals = edits.select("dialogue", "place", "role", "text", "fault", "edits", "gives").repartition("dialogue").sortWithinPartitions("dialogue", "place").mapInPandas(digests, DIGEST_ROWS)
    gaps = edits.groupBy("dialogue", "conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = gaps.join(totals, "dialogue").withColumnRenamed("conv", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
