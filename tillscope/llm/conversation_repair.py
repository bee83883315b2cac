"""Repair of the role structure of conversations, with the least edits.

A conversation is in order if its role initials are ``(s?(ua)+)?``.  Each of its
rows is a symbol, the class of its role and its first fault, and equal
consecutive symbols are one run.  Over four states (nothing yet, after the
system's, the user's or the assistant's turn) a symbol is a transition matrix
whose sums are costs and whose choice is the least one (min-plus); a run of
``n`` is the ``n``-th power, from binary powers that each worker keeps.  Run by
run from the end, the matrices give the cost that is left in each state; then
the choices are unrolled from the start, the least letter among the cheapest.

Counts and first occurrences are found by Spark's aggregations, and rows that
are equal in all columns travel as one with a count.  The rest depends on the
order of rows: a task reads its conversations one after the other, as a sorted
stream, first the symbols alone, then the texts with the edits.  It holds the
runs of one conversation, never its texts; as a hash of a whole conversation
is asked for, the stream of one conversation cannot be shared by tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import pick, stored

# Fixed values of the contract: costs, white space and sentence ends.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ROLE = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role initial leads to from each state in which it is in order.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INF = 1 << 60
#: Rows of an output batch.
BATCH_ROWS = 10_000

Vector = tuple[int, int, int, int]


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    """Min-plus product."""
    return tuple(tuple(min(INF, *(a[p][k] + b[k][q] for k in range(4))) for q in range(4)) for p in range(4))


def applied(a: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(INF, *(a[p][k] + v[k] for k in range(4))) for p in range(4))


def wanted(state: int) -> str:
    """The one role initial, besides the system's, that is in order in a state."""
    return "a" if state == USER else "u"


def edits(symbol: str) -> Iterator[tuple[str, int, int, int]]:
    """``(letter, from, to, cost)`` of the edits of a row with this symbol (role class and number of its fault)."""
    role, fault = symbol[0], FAULTS[int(symbol[1])]
    more = TRUNCATED if fault == "truncated" else 0
    for p in range(4):
        yield "D", p, p, DELETE
        if fault in ("blank", "duplicate"):
            continue
        if p in NEXT.get(role, {}):
            yield "K", p, NEXT[role][p], KEEP + more
        if wanted(p) != role:
            yield "R", p, NEXT[wanted(p)][p], REROLE + more


@lru_cache(None)
def inserts() -> tuple[Vector, ...]:
    """Least cost from state to state by inserted rows alone."""
    one = tuple(tuple(0 if p == q else INSERT if q == NEXT[wanted(p)][p] else INF for q in range(4)) for p in range(4))
    two = times(one, one)
    return times(two, two)


@lru_cache(None)
def power(symbol: str, k: int) -> tuple[Vector, ...]:
    """Transition of ``2**k`` rows with one symbol, inserted rows before each."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    step = [[INF] * 4 for _ in range(4)]
    for _, p, q, cost in edits(symbol):
        step[p][q] = min(step[p][q], cost)
    return times(inserts(), tuple(map(tuple, step)))


#: Cost that is left after the last row: only what is in order may end.
END: Vector = applied(inserts(), (0, INF, INF, 0))


def before_run(symbol: str, n: int, left: Vector) -> Vector:
    """Cost that is left in each state before a run, given the cost after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            left = applied(power(symbol, k), left)
    return left


@lru_cache(1 << 14)
def unrolled(symbol: str, n: int, left: Vector, state: int) -> tuple[str, int]:
    """The run's cheapest edits, the least letters first, and the state after it; costs count from the least one."""
    costs = [left]
    for _ in range(n):
        costs.append(applied(power(symbol, 0), costs[-1]))
    choices = [[] for _ in range(4)]
    for letter, p, q, cost in edits(symbol):
        choices[p].append((letter, q, cost))
    out, at = [], n
    while at:
        options = [(letter, q, at - 1) for letter, q, cost in choices[state] if cost + costs[at - 1][q] == costs[at][state]]
        q = NEXT[wanted(state)][state]
        if INSERT + costs[at][q] == costs[at][state]:
            options.append(("I", q, at))
        letter, state, at = min(options)
        out.append(letter)
    return "".join(out), state


def solve(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost of a conversation's runs ``(symbol, rows)``, and its edits' letters."""
    left = [END]
    for symbol, n in reversed(runs):
        left.append(before_run(symbol, n, left[-1]))
    out, state = [], START
    for (symbol, n), after in zip(runs, left[-2::-1]):
        least = min(after)
        letters, state = unrolled(symbol, n, tuple(x - least for x in after), state)
        out.append(letters)
    while END[state]:
        out.append("I")
        state = NEXT[wanted(state)][state]
    return left[-1][START], "".join(out)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, n``: conversations with planted faults, equal rows as one with their count.

    crc32 of ``conv_id:turn`` modulo 20 names the fault of a row: 0 drops it, 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the
    user's.  A null of any column counts as one space in names and texts.
    """
    rows = pick(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = rows.withColumn("fault", F.crc32(named.cast("binary")) % 20).where("fault <> 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", "".join(ENDS), "")).otherwise(
            F.col("text")).alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n")).groupBy(
        "conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def _content() -> Column:
    """Hash that stands for role and text."""
    return F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.lit(":"), F.col("text")), 256))


def _turn() -> Column:
    """Turns in order, nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))


def symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, at, content, first, rest, n``: the symbols of each row's first copy and of the other ones."""
    keyed = rows.select("conv_id", _turn().alias("at"), "role", "text", "n", _content().alias("content"))
    ended = F.rtrim("text", F.lit(SPACE))
    role = F.substring("role", 1, 1)
    light = keyed.select(
        "conv_id", "at", "content", "n", F.when(role.isin(list("sua")), role).otherwise("-").alias("role"),
        F.col("role").alias("full"), (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(*ENDS)).alias("open"))
    light = stored(light, "rows")
    # a table of its own, so that the join can be split where a conversation is hot
    earliest = stored(light.groupBy("conv_id", "content").agg(F.min("at").alias("earliest")), "first-turns")
    same = light["conv_id"].eqNullSafe(earliest["conv_id"]) & (light["content"] == earliest["content"])
    both = light.join(earliest, same).select(*(light[c] for c in light.columns), "earliest")
    blank, again = F.col("blank"), F.col("at") > F.col("earliest")
    code = lambda later: F.concat("role", F.when(blank, "1").when(later, "2").when(F.col("open"), "3").otherwise("0"))
    return both.select("conv_id", "at", "full", "content", "n", code(again).alias("first"), code(F.lit(True)).alias("rest"))


def _sorted(rows: DataFrame, *more: str) -> DataFrame:
    """Whole conversations in each partition, in order: by turn, equal turns by role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more)


_SOLVED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SOLVED_TYPES = [pa.int64()] * 6 + [pa.string()]


def _batches(rows: Iterable[tuple], schema: str, types: list) -> Iterator[pa.RecordBatch]:
    names, out, held = [c.split()[0] for c in schema.split(", ")], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= BATCH_ROWS or held >= 8 << 20:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _stream(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _runs(rows: Iterable[tuple]) -> list[tuple[str, int]]:
    """Equal consecutive symbols of rows ``(conv_id, first, rest, n)`` as runs."""
    runs: list[list] = []
    for _, first, rest, n in rows:
        for symbol, count in ((first, 1), (rest, n - 1)):
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += count
            elif count:
                runs.append([symbol, count])
    return [tuple(r) for r in runs]


def audited(rows: DataFrame) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` of conversations that have rows.

    ``rows`` are those of ``damaged``.
    """
    ordered = _sorted(symbols(rows), "at", "full", "content").select("conv_id", "first", "rest", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv, own in groupby(_stream(batches, "conv_id", "first", "rest", "n"), lambda r: r[0]):
                runs = _runs(own)
                counts = [sum(n for s, n in runs if s[1] == str(k)) for k in (1, 2, 3)]
                pairs = [(a[0][0] + b[0][0], 1) for a, b in zip(runs, runs[1:])] + [(s[0] * 2, n - 1) for s, n in runs]
                yield (conv, *counts, sum(n for p, n in pairs if p not in ("su", "ua", "au")), *solve(runs))

        yield from _batches(found(), _SOLVED, _SOLVED_TYPES)

    return ordered.mapInArrow(run, _SOLVED)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, str, str]]]]:
    """``(conv_id, rows)`` of each conversation of a sorted stream that has its audit before its rows."""
    stream = _stream(batches, "conv_id", "audit", "role", "text", "n")
    for conv, own in groupby(stream, lambda r: r[0]):
        yield conv, _repaired(next(own)[1], own)


def _repaired(audit: str, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """``(letter, role, text)`` of the rows that stay or are inserted."""
    copies = ((role, text) for _, _, role, text, n in rows for _ in range(n))
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(copies)
        if letter == "D":
            continue
        if letter != "K":
            role = ROLE[wanted(state)]
        state = NEXT[role[:1]][state]
        yield letter, role, text


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", F.lit(1).alias("kind"), _turn().alias("at"), none.alias("audit"), "role", "text",
                       _content().alias("content"), "n").unionByName(
        audits.select("conv_id", F.lit(0).alias("kind"), F.struct(F.lit(False).alias("given"), F.lit(0).cast("long").alias("turn"))
                      .alias("at"), "audit", none.alias("role"), none.alias("text"), F.lit(None).cast("binary").alias("content"),
                      F.lit(0).cast("long").alias("n")))
    return _sorted(both, "kind", "at", "role", "content").select("conv_id", "audit", "role", "text", "n")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired conversations, row by row (``rows`` and ``audits`` as above)."""
    schema = "conv_id long, place long, edit string, role string, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((conv, n, *row) for conv, own in _edited(batches) for n, row in enumerate(own)),
                            schema, [pa.int64(), pa.int64()] + [pa.string()] * 3)

    return _with_audits(rows, audits).mapInArrow(run, schema)


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of the repaired ``role:text`` lines of each conversation."""
    schema = "conv_id long, repaired_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv, own in _edited(batches):
                digest = hashlib.sha256()
                for n, (_, role, text) in enumerate(own):
                    digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                yield conv, digest.hexdigest()

        yield from _batches(found(), schema, [pa.int64(), pa.string()])

    return _with_audits(rows, audits).mapInArrow(run, schema)


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Damage conversations and repair them; one row for each conversation id of the input.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    * rows without a conversation id are one conversation, of id null; null
      roles and texts are one space, null turns come first;
    * rows of one turn are in order of role, then of a hash of role and text;
      rows equal in all columns are copies, so all but the first are duplicates;
    * texts and conversations may be of any length: texts are streamed;
    * a conversation whose rows are all gone has zeros, an empty audit and the hash of nothing;
    * an empty table gives an empty result; other columns are ignored.
    """
    every = pick(conversations, conv_id=id_col).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = stored(damaged(conversations, id_col, turn_col, role_col, text_col), "damaged")
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    audits = stored(audited(rows), "audits")
    out = every
    for found in (gaps, audits, repaired_hashes(rows, audits)):
        own = found.withColumnRenamed("conv_id", "own_id")
        out = out.join(own, out["conv_id"].eqNullSafe(own["own_id"]), "left").drop("own_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
