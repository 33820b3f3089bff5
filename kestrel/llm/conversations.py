"""Conversation structure repair: A* on the edit lattice of each conversation.

A node is (rows read, state of the grammar); edits keep, rerole, delete or insert a row.  The
heuristic is the suffix sum of what no path escapes: deletions of blank and repeated rows, charges of
truncated ones.  It is consistent, and the queue is ordered by (cost plus heuristic, audit), so the
first time a node comes out its cost is the least and its audit the first in ASCII order.

Rows are put in order over ranges, and a range is cut into chunks.  A chunk gives, for each pair of
states at its ends, the best edits between them; a conversation's chunks are then composed in order.
So a conversation of any length is searched in many tasks, a chunk at a time; only its repaired text
passes through one task, as a stream, because its digest has to.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kestrel.llm.common import partitions, ready, shared_dir, stash

#: Costs of edits; roles that rows can be given; rows of a chunk.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")
CHUNK = 512
BLANKS = " \t\n\x0b\x0c\r"
#: The grammar (s?(ua)+)?: the state after a role's initial.  States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: The state after a row that was inserted or given another role: the only one that the grammar has.
FORCED = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")
OK, BLANK, DUPLICATE, CUT = range(4)


def search(initials: list[str], faults: list[int], entry: int = START, ends: tuple[int, ...] | None = ENDS) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest edits from the entry state: the best of `ends`, or of each state where ends is None."""
    n = len(faults)
    due = [DELETE if f in (BLANK, DUPLICATE) else TRUNCATED if f == CUT else 0 for f in faults]
    rest = list(accumulate(reversed(due), initial=0))[::-1]
    queue, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        reach, audit, i, state = heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = reach - rest[i]
        if i == n:
            if ends is None:
                found[state] = (cost, audit)
                if len(found) == 4 or len(found) == 3 and entry != START:  # the start state has no way back
                    return found
            elif state in ends:
                return {state: (cost, audit)}
        else:
            heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
            if faults[i] not in (BLANK, DUPLICATE):
                charge = cost + (TRUNCATED if faults[i] == CUT else 0) + rest[i + 1]
                kept = STEP.get((state, initials[i]))
                if kept is not None:
                    heappush(queue, (charge, audit + "K", i + 1, kept))
                if kept != FORCED[state]:
                    heappush(queue, (charge + REROLE, audit + "R", i + 1, FORCED[state]))
        heappush(queue, (reach + INSERT, audit + "I", i, FORCED[state]))
    return found


class Composer:
    """The best edits over the chunks of one conversation, in order."""

    def __init__(self):
        self.best = {START: (0, "")}  # audits without what all of them begin with, which no comparison needs
        self.back: list[dict[int, tuple[int, str]]] = []

    def add(self, paths: dict[tuple[int, int], tuple[int, str]]) -> None:
        """paths: {(entry, end): (cost, audit)} of the next chunk."""
        new: dict[int, tuple[int, str, int, str]] = {}
        for (entry, end), (cost, audit) in paths.items():
            if entry in self.best:
                before, head = self.best[entry]
                new[end] = min(new.get(end, (1 << 62,)), (before + cost, head + audit, entry, audit))
        shared = len(commonprefix([x[1] for x in new.values()]))
        self.best = {end: (x[0], x[1][shared:]) for end, x in new.items()}
        self.back.append({end: x[2:] for end, x in new.items()})

    def done(self) -> tuple[int, list[tuple[int, str]]]:
        """(cost, entry state and audit of each chunk)."""
        (cost, _), state = min((self.best[end], end) for end in ENDS if end in self.best)
        out = []
        for back in reversed(self.back):
            entry, audit = back[state]
            out.append((entry, audit))
            state = entry
        return cost, out[::-1]


def repaired(entry: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that a chunk's edits leave."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "I":
            state = FORCED[state]
            out.append(f"{ROLES[state == ASSISTANT]}:")
            continue
        if edit != "D":
            state = STEP[state, roles[i][:1]] if edit == "K" else FORCED[state]
            out.append(f"{roles[i] if edit == 'K' else ROLES[state == ASSISTANT]}:{texts[i]}")
        i += 1
    return out


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and there, by crc32(`conv:turn`) % 20: 0 drops a row (it stays with there = false),
    1 empties its text, 2 takes out [.!?], 3 repeats it, 4 gives it the role user.  A null is one space, but for order and gaps."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    what = F.crc32(F.encode(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)), "UTF-8")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    out = rows.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.when(what == 4, "user").otherwise(blank(role_col)).alias("role"),
        text.alias("text"),
        (what != 0).alias("there"),
        F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def _key() -> Column:
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    conv = F.coalesce(F.concat(F.lit("c"), sized(F.col("conv").cast("string"))), F.lit("n"))
    return F.unhex(F.sha2(F.concat(conv, sized(F.col("role")), F.col("text")), 256))


def _with_again(rows: DataFrame) -> DataFrame:
    """Adds again: role and text stood in an earlier turn of the conversation.

    Counts are summed on the map side.  Few (role, text) can hold a fixed share of all rows each; these are sent to the tasks, others joined.
    """
    keyed = rows.withColumn("key", _key())
    seen = keyed.where("there").groupBy("key").agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("blank"))
    # Rows whose turn is the first of their kind are told apart in order; a null turn is the least.
    several = seen.where("blank and most is not null or least < most").select("key", "n", F.when(~F.col("blank"), F.col("least")).alias("first"))
    share = max(1, rows.count() // (4 * partitions(rows.sparkSession)))
    hot = several.where(F.col("n") > share).select("key", F.lit(True).alias("hot"), F.col("first").alias("hot_first"))
    both = keyed.join(F.broadcast(hot), "key", "left")
    later = lambda found, first: F.col(found).isNotNull() & F.col("turn").isNotNull() & (F.col(first).isNull() | (F.col("turn") > F.col(first)))
    shape = ["conv", "turn", "role", "text", "there"]
    known = both.where("hot").select(*shape, later("hot", "hot_first").alias("again"))
    rest = both.where("hot is null").drop("hot", "hot_first").join(several.where(F.col("n") <= share), "key", "left")
    return known.unionByName(rest.select(*shape, later("n", "first").alias("again")))


def _chunk_schema(kind: str) -> str:
    return f"conv {kind}, part int, seq int, size int, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, paths array<struct<entry:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>"


def _fault(text: str, repeated: bool) -> int:
    said = text.rstrip(BLANKS)
    return BLANK if not said else DUPLICATE if repeated else OK if said[-1] in ".!?" else CUT


def _chunks(rows: DataFrame) -> DataFrame:
    """A row for each chunk: counts within it, its best edits between states, its roles and texts."""
    spark, kind = rows.sparkSession, rows.schema["conv"].dataType
    # Rows of one conversation, turn, role and beginning of a text are in one range, so the whole order is kept.
    ranged = rows.repartitionByRange(partitions(spark), "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
    ordered = ranged.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    schema = _chunk_schema(kind.simpleString())
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = {"seq": 0, "before": None}
        made: list[dict] = []

        def close(conv, held, opens, closes):
            """held: (turn, role, text, fault) of a chunk; opens: it is the conversation's first for sure; closes: it is its last for sure."""
            turns = [t for t, _, _, _ in held if t is not None]
            initials, faults = [r[:1] for _, r, _, _ in held], [f for _, _, _, f in held]
            paths = []
            for entry in (START,) if opens else range(4):
                ends = search(initials, faults, entry, ENDS if closes else None)
                paths += [{"entry": entry, "end": end, "cost": cost, "audit": audit} for end, (cost, audit) in ends.items()]
            made.append({
                "conv": conv, "part": part, "seq": state["seq"], "size": len(held),
                "low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(set(turns)),
                "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                "first": initials[0] if held else None, "last": initials[-1] if held else None,
                "paths": paths, "roles": [r for _, r, _, _ in held], "texts": [t for _, _, t, _ in held],
            })
            state["seq"] += 1

        now, held, weight, opens, previous, any_yet = None, [], 0, False, None, False
        for batch in batches:
            for conv, turn, role, text, there, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not any_yet or conv != now:
                    if any_yet:
                        # Its end is known; whether it began here is known if it isn't the range's first.
                        close(now, held, opens, True)
                    now, held, weight, opens, previous = conv, [], 0, any_yet, None
                    any_yet = True
                if not there:
                    continue
                if len(held) >= CHUNK or weight > 1 << 22:
                    close(now, held, opens, False)
                    held, weight, opens = [], 0, False
                same = previous == (turn, role, text)
                held.append((turn, role, text, _fault(text, again or same)))
                weight, previous = weight + len(text), (turn, role, text)
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made.clear()
        if any_yet:
            close(now, held, opens, False)
            yield pa.RecordBatch.from_pylist(made, arrow)

    return ordered.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of rows that may be damaged: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows as `damaged` gives them (conv, turn, role, text, there).  Rows are taken by turn, nulls first,
    those of one turn by role and text.  Null conversations are one.  Repeated rows are duplicates.  A
    conversation none of whose rows is there has zeros, an empty audit and the digest of an empty
    string.  Long texts and conversations of any length are whole; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ready(spark)
    folder = shared_dir(spark, "conversations")
    kind = rows.schema["conv"].dataType.simpleString()
    chunks = stash(_chunks(_with_again(rows)), folder, "chunks")
    none = lambda *names: [F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in names]
    own = ["size", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths"]
    head = chunks.select("conv", F.lit(0).alias("kind"), "part", "seq", *own, *none("roles", "texts"))
    body = chunks.where("size > 0").select("conv", F.lit(1).alias("kind"), "part", "seq", *none(*own), "roles", "texts")
    ordered = head.unionByName(body).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", "part", "seq")
    result = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    arrow = spark.createDataFrame([], result).toArrow().schema

    def run(batches):
        now, open_, whole, plan = None, False, None, None

        def begin(conv):
            return {"conv": conv, "low": None, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "composer": Composer(), "sha": hashlib.sha256(), "any": False}

        def planned(w):
            cost, steps = w["composer"].done()
            return cost, "".join(a for _, a in steps), iter(steps)

        def end(w, plan):
            cost, audit, _ = plan or planned(w)
            gaps = w["high"] - w["low"] + 1 - w["distinct"] if w["low"] is not None else 0
            return {"conv": w["conv"], "gaps": gaps, **{k: w[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": w["sha"].hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not open_ or row["conv"] != now:
                    if open_:
                        out.append(end(whole, plan))
                    now, open_, whole, plan = row["conv"], True, begin(row["conv"]), None
                if row["kind"] == 0:
                    if not row["size"]:
                        continue
                    for k in ("blank", "duplicate", "truncated", "illegal"):
                        whole[k] += row[k]
                    whole["illegal"] += whole["last"] is not None and whole["last"] + row["first"] not in LEGAL
                    whole["last"] = row["last"]
                    if row["low"] is not None:
                        # Turns are in order: a chunk may go on with the turn that the one before ended with.
                        whole["distinct"] += row["distinct"] - (row["low"] == whole["high"])
                        whole["low"] = row["low"] if whole["low"] is None else whole["low"]
                        whole["high"] = row["high"]
                    whole["composer"].add({(p["entry"], p["end"]): (p["cost"], p["audit"]) for p in row["paths"]})
                else:
                    plan = plan or planned(whole)
                    for line in repaired(*next(plan[2]), row["roles"], row["texts"]):
                        whole["sha"].update(("\n" * whole["any"] + line).encode())
                        whole["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if open_:
            yield pa.RecordBatch.from_pylist([end(whole, plan)], arrow)

    return ordered.mapInArrow(run, result)
