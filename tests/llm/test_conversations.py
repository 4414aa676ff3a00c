import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from foldwise.llm import conversations, queries

COLUMNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def faults_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """Shortest path from the end over (row, state), ties by the audit's text."""
    best = {}
    for i in range(len(rows), -1, -1):
        for inserts in (3, 2, 1, 0):
            for state in range(4):
                ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
                if inserts < 3:
                    cost, audit = best[i, NEXT[state][1], inserts + 1]
                    ways.append((cost + 3, "I" + audit))
                if i < len(rows):
                    edits = [(4, "D", state)]
                    if faults[i] in (None, "truncated"):
                        extra = 3 if faults[i] else 0
                        edits.append((3 + extra, "R", NEXT[state][1]))
                        kept = KEEP.get((rows[i][1][:1], state))
                        edits += [(extra, "K", kept)] if kept else []
                    for cost, letter, after in edits:
                        rest, audit = best[i + 1, after, 0]
                        ways.append((cost + rest, letter + audit))
                best[i, state, inserts] = min(ways, default=(10**9, ""))
    return best[0, 0, 0]


def applied(rows, audit):
    out, state, i = [], 0, 0
    for letter in audit:
        if letter == "I":
            out.append((NEXT[state][0], ""))
            state = NEXT[state][1]
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "K":
            out.append((role, text))
            state = KEEP[role[:1], state]
        elif letter == "R":
            out.append((NEXT[state][0], text))
            state = NEXT[state][1]
    return out


def brute(rows):
    faults = faults_of(rows)
    cost, audit = cheapest(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    out = applied(rows, audit)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def ordered(rows):
    digest = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))


def by_conversation(rows, damage):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = (" " if v is None else v for v in (role, text))
        if damage:
            kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            if kind == 3:
                groups[conv].append((turn, role, text))
        groups[conv].append((turn, role, text))
    return {c: ordered(g) for c, g in groups.items()}


def rows_of(conversations_, longest, seed=2):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sx"]
    texts = ["Hi.", "ok", " \t", "", "Hi!", "a\n\n", None, "b? ", "é.", "what?", "z" * 5000]
    return [
        (None if c == 3 else c, rng.choice([None, t, t, t, t + 3]), rng.choice(roles), rng.choice(texts))
        for c in range(conversations_)
        for t in range(rng.randint(0, longest))
    ] + [(900, 1, "user", "ok")] * 9


@pytest.mark.parametrize("segment, longest, damage", [(4096, 12, True), (4, 50, True), (4, 50, False)])
def test_repair_as_brute_force(spark, monkeypatch, segment, longest, damage):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = rows_of(40, longest)
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS audit", "1 AS cost", "2 AS tag")
    turns = queries.damaged(df) if damage else df
    report = conversations.repair(turns, conversations=df)
    got = {r[0]: tuple(r)[1:] for r in conversations.with_digest(turns, report).collect()}
    groups = by_conversation(rows, damage)
    assert got == {c: brute(g) for c, g in groups.items()}
    repaired = defaultdict(list)
    for r in sorted(conversations.repaired_turns(turns, report).collect(), key=lambda r: r["place"]):
        repaired[r["conv_id"]].append((r["role"], r["text"]))
    want = {c: applied(g, got[c][6]) for c, g in groups.items()}
    assert repaired == {c: g for c, g in want.items() if g}


def test_rules_are_shared_and_matrices_right():
    rng = random.Random(3)
    sequences = ["".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    sequences += ["u" * 4000, "ua" * 2000, "sua", "sua"]
    grammar, roots = conversations.compress(sequences)
    assert len(grammar) < 700
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for sequence, root in zip(sequences[:40], roots[:40].tolist()):
        rows = [(i, names.get(c.lower(), ""), f"{i}" if c.isupper() else f"{i}.") for i, c in enumerate(sequence)]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else None for c in sequence]
        cost, path, last = conversations.best_path(grammar.costs[[root]], grammar.ranks[[root]])
        audit = grammar.audit(root, *path[0], {}) + "I" * (0, 2, 1, 0)[last]
        assert (cost, audit) == cheapest(rows, faults)


def test_all_rows_dropped_and_empty_table(spark):
    df = spark.createDataFrame([(5, 1, "user", "Hi.")], COLUMNS)
    none = df.where("false")
    report = conversations.repair(none, conversations=df)
    row = tuple(conversations.with_digest(none, report).first())
    assert row == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(none).count() == 0
