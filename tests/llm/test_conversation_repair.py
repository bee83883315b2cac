"""Conversation repair against a search over all edits, row by row."""

import collections
import hashlib
import random
import zlib

import pytest

from tillscope.llm import conversation_repair as C
from tillscope.llm.common import ship_package

NAMES = ["conv_id", "turn", "role", "text", "TEXT", "Turn", "n", "audit"]
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, "clash", 9, 4, "x") for r in rows],
                                 "a long, b long, c string, d string, e string, f long, g int, h string").toDF(*NAMES)


def cheapest(rows):
    """``(cost, letters, lines)`` over all edits of rows ``(role, text, fault)``, the least letters among the cheapest."""
    after, name = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    best = {}
    for i in range(len(rows), -1, -1):
        found = {last: [(0, "", ())] if i == len(rows) and last in ("", "a") else [] for last in after}
        for last in after if i < len(rows) else ():
            role, text, fault = rows[i]
            c, a, t = best[last]
            found[last].append((c + 2, "D" + a, t))
            if fault in ("blank", "duplicate"):
                continue
            for r in after[last]:
                c, a, t = best[r]
                c += 5 if fault == "truncated" else 0
                if role[:1] == r:
                    found[last].append((c, "K" + a, (f"{role}:{text}", t)))
                if r != "s":
                    found[last].append((c + 1, "R" + a, (f"{name[r]}:{text}", t)))
        for _ in range(4):  # up to four inserted rows
            for last in after:
                for r in after[last].replace("s", ""):
                    found[last] += [(c + 5, "I" + a, (f"{name[r]}:", t)) for c, a, t in found[r]]
            found = {last: [min(x)] if x else [] for last, x in found.items()}
        best = {last: x[0] if x else (10**9, "", ()) for last, x in found.items()}
    cost, audit, rest = best[""]
    lines = []
    while rest:
        lines.append(rest[0])
        rest = rest[1]
    return cost, audit, lines


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, own in convs.items():
        order = lambda r: (r[0] is not None, r[0] or 0, r[1], C_hash(r[1], r[2]))
        own.sort(key=order)
        seen, marked = set(), []
        for _, role, text in own:
            plain = text.rstrip(SPACE)
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        counts = collections.Counter(f for *_, f in marked)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        turns = [t for t, *_ in own if t is not None]
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"],
                    counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def C_hash(role, text):
    return hashlib.sha256(f"{hashlib.sha256(role.encode()).hexdigest()}:{text}".encode()).digest()


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "open end", "", " \t", None, "a.b", "é日本.", "done. \n", "nul\0 byte."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent"]
    rows = []
    for conv in range(n):
        turn = r.randrange(3)
        for _ in range(r.randrange(1, 12)):
            text = r.choice(texts) if r.random() < 0.5 else f"text {r.randrange(1000)}" + r.choice(["", ".", "?"])
            rows.append((conv, turn if r.random() < 0.95 else None, r.choice(roles) if r.random() < 0.6 else roles[len(rows) % 2], text))
            turn += r.choice([0, 1, 1, 1, 1, 2])
    return rows


def test_runs_equal_a_search_over_all_edits():
    r = random.Random(4)
    for n in range(3000):
        rows = []
        while len(rows) < r.randrange(9):
            rows += [(r.choice(["user", "assistant", "system", "-"]), "t", r.choice(C.FAULTS))] * r.choice([1, 1, 2, 5])
        runs = [(f"{role[0]}{C.FAULTS.index(fault)}", 1) for role, _, fault in rows]
        merged = []
        for symbol, _ in runs:
            if merged and merged[-1][0] == symbol:
                merged[-1] = (symbol, merged[-1][1] + 1)
            else:
                merged.append((symbol, 1))
        assert C.solve(merged) == cheapest(tuple(rows))[:2], rows


def test_long_runs_by_powers():
    cost, audit = C.solve([("u0", 100_001)])
    assert cost == 50_000 + 2 and audit == "D" + "KR" * 50_000
    assert C.solve([("u2", 1 << 40)][:0] + [("u2", 70_000)]) == (140_000, "D" * 70_000)
    for symbol in ("u0", "a3", "s0", "-1"):
        left, n = C.END, 1000
        for _ in range(n):
            left = C.applied(C.power(symbol, 0), left)
        assert C.before_run(symbol, n, C.END) == left


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = conversations(seed, 300) + [(None, 0, "user", "no id."), (None, None, "assistant", "no turn"), (None, 1, "user", None)]
    rows += [(900, None, "user", "Hi."), (900, None, "assistant", "Ho."), (-4, 7, "user", "Hi."), (-4, 5, "assistant", "Ho.")]
    assert got(C.repair(table(spark, rows))) == brute(rows)


def test_a_hot_conversation_of_equal_and_of_different_rows(spark):
    rows = [(1, 5, "user", "same.")] * 3000 + [(1, 6 + i // 3, ("user", "assistant", "tool")[i % 3], f"{i}.") for i in range(900)]
    rows += [(2 + i % 50, i, ("user", "assistant")[i // 50 % 2], f"t{i}.") for i in range(400)]
    assert got(C.repair(table(spark, rows))) == brute(rows)


def test_a_very_long_text(spark):
    rows = [(1, 1, "user", "long " * 400_000 + "?"), (1, 2, "assistant", "yes."), (1, 4, "user", "open " * 300_000)]
    assert got(C.repair(table(spark, rows))) == brute(rows)


def test_rows_that_stay(spark):
    df = table(spark, [(7, 1, "user", "One?"), (7, 2, "assistant", "Two."), (7, 3, "assistant", "cut off"), (7, 4, "assistant", "")])
    rows = C.damaged(df)
    audits = C.audited(rows)
    out = sorted(tuple(r) for r in C.repaired_rows(rows, audits).collect())
    want = []
    for conv, *_, audit, _ in brute([tuple(r)[:4] for r in df.collect()]):
        want += [x for x in audit if x != "D"]
    assert [r[2] for r in out] == want and [r[1] for r in out] == list(range(len(out)))


def test_empty_table(spark):
    assert C.repair(table(spark, [])).count() == 0
