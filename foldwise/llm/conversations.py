"""Cheapest repair of conversations by a grammar-compressed dynamic programme (operator 12).

A conversation is a sequence of symbols, one per row: the initial of its role with
its fault, or "must go".  Editing it into ``(s?(ua)+)?`` is a shortest path through
an automaton of four states, and a run of rows acts on it as a 4 x 4 matrix under
(min, +).  Sequences are cut into segments of a bounded length; the distinct
segments of a task are compressed together by Re-Pair, every rule's matrix is the
product of its two parts, and so each repeated piece is evaluated once for all
conversations.

Each entry of a matrix stands for an audit, the edits' letters, as a rope: the middle
state says which entries of the two parts it joins.  An audit of a run ends with a
row's letter, and from one state equal audits lead to one state; so audits of
one row of a matrix differ before either ends, and their order follows from the
parts' orders alone.  Ropes become texts only for whole segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldwise.llm.common import fields, sized, stored

# Edit costs and the surcharge of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Rows of a segment at most.
SEGMENT = 4096
# Symbols that are compressed together: what a task holds, not a cut.
_CHUNK = 1 << 20
_SALTS = 4096

# ASCII white space of the fault rules.
SPACES = " \t\n\x0b\f\r"
# "x" must go; others are role initials ("o": any other), in capitals where truncated.
_SYMBOLS = "xsuaoSUAO"
# States: nothing yet, after the system's row, after the user's, after the assistant's.
_EXPECTED = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)  # after the expected role
_TAIL = (0, 2, 1, 0)  # inserts from a state to an end
_FAR = 1 << 40

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _terminals() -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Costs, ranks and audits of single rows, inserts before them included."""
    costs = np.full((len(_SYMBOLS), 4, 4), _FAR, np.int64)
    audits = [[""] * 16 for _ in _SYMBOLS]
    for x, symbol in enumerate(_SYMBOLS):
        extra = TRUNCATED if symbol.isupper() else 0
        for start in range(4):
            state, inserts = start, 0
            while inserts <= 3:
                edits = [(DELETE, "D", state)]
                if symbol != "x":
                    edits.append((REROLE + extra, "R", _NEXT[state]))
                    kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None,
                            "a": 3 if state == 2 else None}.get(symbol.lower())
                    if kept is not None:
                        edits.append((extra, "K", kept))
                for cost, letter, end in edits:
                    found = (inserts * INSERT + cost, "I" * inserts + letter)
                    if found < (costs[x, start, end], audits[x][4 * start + end]):
                        costs[x, start, end], audits[x][4 * start + end] = found
                state, inserts = _NEXT[state], inserts + 1
    ranks = np.zeros((len(_SYMBOLS), 4, 4), np.int64)
    for x in range(len(_SYMBOLS)):
        for start in range(4):
            row = audits[x][4 * start : 4 * start + 4]
            order = sorted(range(4), key=lambda q: (costs[x, start, q] >= _FAR, row[q]))
            ranks[x, start, order] = range(4)
    return costs, ranks, audits


@dataclass
class Grammar:
    """Rules over the terminals, each with its parts, matrix and rope."""

    left: np.ndarray
    right: np.ndarray
    costs: np.ndarray  # (rule, start, end)
    ranks: np.ndarray  # order of a row's audits
    via: np.ndarray  # middle state of the joined audits
    audits: list[list[str]]  # of the terminals

    @staticmethod
    def empty() -> Grammar:
        costs, ranks, audits = _terminals()
        none = np.full(len(costs), -1, np.int64)
        return Grammar(none, none.copy(), costs, ranks, np.zeros_like(ranks), audits)

    def __len__(self) -> int:
        return len(self.left)

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New rules ``left right`` with their matrices; their numbers."""
        a, b = self.costs[left], self.costs[right]
        sums = np.minimum(a[:, :, :, None] + b[:, None, :, :], _FAR)  # rule, start, middle, end
        key = sums * 4 + self.ranks[left][:, :, :, None]
        via = key.argmin(axis=2)
        costs = np.take_along_axis(sums, via[:, :, None, :], 2)[:, :, 0, :]
        rows = np.arange(len(left))[:, None, None]
        starts, ends = np.arange(4)[None, :, None], np.arange(4)[None, None, :]
        first = self.ranks[left][rows, starts, via]
        second = self.ranks[right][rows, via, ends]
        order = np.where(costs >= _FAR, 1 << 20, first * 4 + second)
        ranks = order.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable")
        begin = len(self)
        self.left = np.r_[self.left, left]
        self.right = np.r_[self.right, right]
        self.costs = np.concatenate([self.costs, costs])
        self.ranks = np.concatenate([self.ranks, ranks])
        self.via = np.concatenate([self.via, via])
        return np.arange(begin, len(self))

    def audit(self, rule: int, start: int, end: int, known: dict) -> str:
        """The text of a rope; ``known`` keeps those of rules."""
        parts: list[str] = []
        stack = [(rule, start, end)]
        while stack:
            at = stack.pop()
            if at in known:
                parts.append(known[at])
                continue
            r, p, q = at
            if self.left[r] < 0:
                parts.append(self.audits[r][4 * p + q])
                continue
            middle = int(self.via[r, p, q])
            stack += [(int(self.right[r]), middle, q), (int(self.left[r]), p, middle)]
        known[rule, start, end] = "".join(parts)
        return known[rule, start, end]


def _chosen(codes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The most frequent pairs, as long as no two of them share a symbol."""
    used: set[int] = set()
    found = []
    for code in codes[np.lexsort((codes, -counts))].tolist():
        a, b = divmod(code, width)
        if a not in used and b not in used:
            used.update((a, b))
            found.append(code)
    return np.array(sorted(found), np.int64)


def _replace(
    symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, made: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the pairs that begin at ``at`` replaced."""
    symbols = symbols.copy()
    symbols[at] = made
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep], owner[keep]


def compress(sequences: list[str]) -> tuple[Grammar, np.ndarray]:
    """Re-Pair of non-empty sequences together: the grammar, and each sequence's rule.

    In a round the most frequent pairs that share no symbol become rules at the
    same time.  When no pair occurs twice, what is left is joined pair by pair.
    """
    grammar = Grammar.empty()
    data = np.frombuffer("".join(sequences).encode(), np.uint8)
    symbols = np.array([_SYMBOLS.find(chr(c)) for c in range(128)])[data]
    owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    while True:
        width = len(grammar)
        pairs = symbols[:-1] * width + symbols[1:]
        joined = owner[:-1] == owner[1:]
        codes, counts = np.unique(pairs[joined], return_counts=True)
        often = counts >= 2
        if not often.any():
            break
        picked = _chosen(codes[often], counts[often], width)
        place = np.minimum(np.searchsorted(picked, pairs), len(picked) - 1)
        at = np.flatnonzero(joined & (picked[place] == pairs))
        # In a run of one symbol every other pair, from the left.
        fresh = np.r_[True, np.diff(at) != 1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        rules = grammar.add(picked // width, picked % width)
        symbols, owner = _replace(symbols, owner, at, rules[place[at]])
    while len(symbols) > len(sequences):
        first = np.searchsorted(owner, owner)
        even = (np.arange(len(symbols)) - first) % 2 == 0
        at = np.flatnonzero(even[:-1] & (owner[:-1] == owner[1:]))
        width = len(grammar)
        codes, which = np.unique(symbols[at] * width + symbols[at + 1], return_inverse=True)
        rules = grammar.add(codes // width, codes % width)
        symbols, owner = _replace(symbols, owner, at, rules[which])
    return grammar, symbols


def _solve_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("symbols", pa.string()), ("costs", pa.list_(pa.int64())),
        ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ])

    def answer(sequences: list[str]) -> pa.RecordBatch:
        grammar, roots = compress(sequences)
        known: dict = {}
        audits = [
            [
                grammar.audit(r, p, q, known) if grammar.costs[r, p, q] < _FAR else None
                for p in range(4)
                for q in range(4)
            ]
            for r in roots.tolist()
        ]
        flat = lambda m: m[roots].reshape(-1, 16).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((sequences, flat(grammar.costs), flat(grammar.ranks), audits), schema)],
            schema=schema,
        )

    held: list[str] = []
    size = 0
    for batch in batches:
        for sequence in batch.column(0).to_pylist():
            held.append(sequence)
            size += len(sequence)
            if size >= _CHUNK:
                yield answer(held)
                held, size = [], 0
    if held:
        yield answer(held)


def best_path(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[tuple[int, int]], int]:
    """Least cost over segments (n, 4, 4), their (start, end) states, and the last state.

    From the end: of equal costs the segment's first audit goes first, as audits
    differ inside the first segment in which the states do.
    """
    n = len(costs)
    rest = np.array([INSERT * t for t in _TAIL], np.int64)
    choice = np.zeros((n, 4), np.int64)
    for i in range(n - 1, -1, -1):
        total = np.minimum(costs[i] + rest[None, :], _FAR)
        choice[i] = (total * 4 + ranks[i]).argmin(axis=1)
        rest = np.take_along_axis(total, choice[i][:, None], 1)[:, 0]
    path, state = [], 0
    for i in range(n):
        path.append((state, int(choice[i, state])))
        state = path[-1][1]
    return int(rest[0]), path, state


def _line(role: Column, text: Column) -> Column:
    """128 bits that stand for a role with its text."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names, NULL roles and texts as one space; and the row's digest."""
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("line", _line(F.col("role"), F.col("text")))


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows without their texts, in range partitions of the order inside conversations.

    ``tag`` ascends in that order: the partition, and the row in it.  A salt spreads
    equal rows.
    """
    body = F.rtrim("text", F.lit(SPACES))
    whole = body.endswith(".") | body.endswith("!") | body.endswith("?")
    initial = F.substring("role", 1, 1)
    narrow = turns.select(
        "conv", "turn", "role", "line",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("class"),
        (body == "").alias("blank"), (~whole).alias("open"),
        F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int").alias("salt"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "line", "salt")]
    ranged = stored(narrow, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.drop("role", "salt").withColumn("tag", F.monotonically_increasing_id()), "ordered")


def _segments(ordered: DataFrame) -> DataFrame:
    """Runs of at most ``SEGMENT`` rows of a conversation with their symbols and counts."""
    again = ordered.where("NOT blank").groupBy("conv", "line").agg(
        F.count(F.lit(1)).alias("n"), F.min("tag").alias("first")
    )
    again = again.where("n > 1").select(F.col("conv").alias("c"), F.col("line").alias("l"), "first")
    match = F.col("conv").eqNullSafe(F.col("c")) & (F.col("line") == F.col("l"))
    rows = ordered.join(again, match, "left").withColumns({
        "repeat": ~F.col("blank") & F.coalesce(F.col("tag") > F.col("first"), F.lit(False)),
    })
    cut = F.col("open") & ~F.col("blank") & ~F.col("repeat")
    symbol = F.when(F.col("blank") | F.col("repeat"), "x").when(cut, F.upper("class")).otherwise(F.col("class"))
    rows = rows.select(
        "conv", "turn", "tag", "class", symbol.alias("symbol"), "blank", "repeat", cut.alias("cut"),
        F.shiftright("tag", 33).alias("part"),
        F.shiftright(F.col("tag").bitwiseAND((1 << 33) - 1), SEGMENT.bit_length() - 1).alias("block"),
    )
    item = F.struct("tag", "symbol", "class")
    runs = rows.groupBy("conv", "part", "block").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        *[F.count_if(c).alias(n) for n, c in (("blank", "blank"), ("duplicate", "repeat"), ("truncated", "cut"))],
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
    )
    classes = F.concat_ws("", F.transform("items", lambda x: x["class"]))
    legal = sum(
        ((F.length("classes") - F.length(F.replace("classes", F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au")),
        F.lit(0),
    )
    return (
        runs.withColumn("symbols", F.concat_ws("", F.transform("items", lambda x: x["symbol"])))
        .withColumn("classes", classes)
        .withColumn("illegal", (F.length("classes") - 1 - legal).cast("long"))
        .withColumn("head", F.left("classes", F.lit(1)))
        .withColumn("tail", F.right("classes", F.lit(1)))
        .drop("items", "classes")
    )


def _totals(segments: list[dict]) -> dict:
    """A conversation's report from its segments in order, and the way through them."""
    out = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")}
    lows = [s["low"] for s in segments if s["low"] is not None]
    distinct = sum(s["turns"] for s in segments)
    for a, b in zip(segments, segments[1:]):
        out["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
        distinct -= a["high"] is not None and a["high"] == b["low"]
    highs = [s["high"] for s in segments if s["high"] is not None]
    out["gaps"] = min(max(highs) - min(lows) + 1 - distinct, (1 << 63) - 1) if lows else 0
    shape = (len(segments), 4, 4)
    costs = np.array([s["costs"] for s in segments], np.int64).reshape(shape)
    ranks = np.array([s["ranks"] for s in segments], np.int64).reshape(shape)
    out["cost"], path, last = best_path(costs, ranks)
    out["inserts"] = _TAIL[last]
    out["steps"] = [{"pattern": s["pattern"], "entry": 4 * p + q} for s, (p, q) in zip(segments, path)]
    return out


def repair(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    conversations: DataFrame | None = None,
) -> DataFrame:
    """``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Rows of a conversation stand by ``turn`` (NULL first), then role, then a digest
    of role and text.  A NULL role or text is one space; NULL is a conversation, too.
    A row's first fault counts: blank (only ASCII white space), duplicate (role and
    text seen earlier), truncated (the last other character is none of ``.!?``).
    ``gaps`` are numbers missing between the least and the greatest turn (at most the
    largest long), ``illegal`` adjacent role initials other than su, ua and au.
    ``audit`` has the letters of the cheapest edits, of equal ones the first in ASCII
    order: Keep 0, Rerole to user or assistant 3, Delete 4 (all blank and duplicate
    rows), Insert an empty user's or assistant's row 3, and 3 for each truncated row
    that stays; then role initials are ``(s?(ua)+)?``.

    ``conversations`` names more ids to report (column ``conv``): those without rows
    have zeros and an empty audit.  No rows give an empty table; other columns are
    ignored.  A conversation may hold any share of the rows: it is cut into segments
    of ``SEGMENT`` rows, and only some forty numbers of each come together.
    """
    ordered = _ordered(_turns(df, conv, turn, role, text))
    segments = stored(_segments(ordered), "segments")
    distinct = segments.select("symbols").distinct()
    kinds = "symbols string, costs array<long>, ranks array<long>, audits array<string>"
    solved = distinct.mapInArrow(_solve_patterns, fields(kinds))
    patterns = stored(solved.withColumn("pattern", F.monotonically_increasing_id()), "patterns")
    matrices = sized(patterns.select("symbols", "pattern", "costs", "ranks"))
    names = [c for c in segments.columns if c not in ("conv", "symbols")]
    found = segments.join(matrices, "symbols").select(
        "conv", F.struct(*names, "pattern", "costs", "ranks").alias("segment")
    )
    if conversations is not None:
        more = conversations.select(F.col(f"`{conv}`").alias("conv"), F.lit(None).alias("segment"))
        found = found.unionByName(more.distinct())
    # 1 / SEGMENT of a conversation's rows, and numbers only.
    gathered = found.groupBy("conv").agg(F.collect_list("segment").alias("segments"))
    kind = gathered.schema["conv"].dataType
    steps = "inserts int, steps array<struct<pattern: long, entry: int>>"
    result = StructType([StructField("conv", kind), *fields(f"{_REPORT}, {steps}").fields])
    target = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in batch.column(1).to_pylist():
                rows.append(_totals(sorted(part, key=lambda s: (s["part"], s["block"]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in list(target)[1:]]],
                schema=target,
            )

    report = stored(gathered.mapInArrow(run, result), "reports")
    audits = sized(patterns.select("pattern", F.posexplode("audits").alias("entry", "piece")).where("piece IS NOT NULL"))
    columns = [f.name for f in fields(_REPORT)] + ["inserts"]
    pieces = report.select("conv", *columns, F.posexplode_outer("steps").alias("number", "step"))
    pieces = pieces.withColumns({"pattern": F.col("step.pattern"), "entry": F.col("step.entry")})
    pieces = pieces.join(audits, ["pattern", "entry"], "left")
    whole = pieces.groupBy("conv").agg(
        *[F.first(c).alias(c) for c in columns],
        F.sort_array(F.collect_list(F.struct("number", "piece"))).alias("pieces"),
    )
    audit = F.concat(
        F.concat_ws("", F.transform("pieces", lambda x: x["piece"])), F.repeat(F.lit("I"), F.col("inserts"))
    )
    return whole.select(F.col("conv").alias(conv), *columns[:-1], audit.alias("audit"))


class _Editor:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _insert(self) -> tuple[str, str, str]:
        role = _EXPECTED[self.state]
        self.state = _NEXT[self.state]
        self.at += 1
        return "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands for a row, rows inserted before it first."""
        while self.audit[self.at] == "I":
            yield self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = " sua".index(role[:1])
            yield edit, role, text
        elif edit == "R":
            role = _EXPECTED[self.state]
            self.state = _NEXT[self.state]
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit):
            yield self._insert()


def _streamed(df: DataFrame, report: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's report, then its rows in order, in one partition and not gathered."""
    heads = report.withColumnRenamed(conv, "conv").withColumn("line", F.lit(None).cast("binary"))
    rows = _turns(df, conv, turn, role, text)
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("conv")
    order = [F.col("audit").isNull(), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "line")]]
    return both.sortWithinPartitions(F.col("conv").asc_nulls_first(), *order).drop("line")


def repaired_turns(
    df: DataFrame,
    report: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The repaired conversations: ``conv``, ``place`` (from 0), ``edit``, ``turn``, ``role``, ``text``.

    ``report`` is that of ``repair`` for the same rows.  Inserted rows have no turn.
    """
    stream = _streamed(df, report, conv, turn, role, text)
    names = stream.columns
    result = StructType([
        StructField(conv, stream.schema["conv"].dataType),
        *fields("place long, edit string").fields, StructField(turn, fields("t long")[0].dataType),
        *fields(f"`{role}` string, `{text}` string").fields,
    ])
    target = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, owner, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(found, at):
                nonlocal place
                for edit, r, t in found:
                    out.append((owner, place, edit, None if edit == "I" else at, r, t))
                    place += 1

            columns = [batch.column(names.index(c)).to_pylist() for c in ("conv", "audit", "turn", "role", "text")]
            for key, audit, at, r, t in zip(*columns):
                if audit is not None:
                    if editor:
                        put(editor.rest(), None)
                    editor, owner, place = _Editor(audit), key, 0
                else:
                    put(editor.row(r, t), at)
            yield _table(out, target)
        if editor:
            out = []
            put_last = [(owner, place + i, e, None, r, t) for i, (e, r, t) in enumerate(editor.rest())]
            yield _table(put_last, target)

    return stream.mapInArrow(run, result)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def with_digest(
    df: DataFrame,
    report: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``report`` with ``repaired_sha256``: of the repaired ``role:text`` rows, joined by newlines.

    Rows are hashed as they stream by; a conversation's digest depends on all of
    its rows in order, so they pass through one task, but never stand in memory.
    """
    stream = _streamed(df, report, conv, turn, role, text)
    names = stream.columns
    kept = ["conv", *[c for c in report.columns if c != conv]]
    result = StructType(
        [StructField(conv if c == "conv" else c, stream.schema[c].dataType) for c in kept]
        + fields("repaired_sha256 string").fields
    )
    target = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, head, sha, begun = None, None, None, False

        def feed(found):
            nonlocal begun
            for _, r, t in found:
                sha.update((("\n" if begun else "") + f"{r}:{t}").encode())
                begun = True

        for batch in batches:
            done: list[tuple] = []
            at = {c: batch.column(names.index(c)) for c in names}
            audits, roles, texts = (at[c].to_pylist() for c in ("audit", "role", "text"))
            for i, (audit, r, t) in enumerate(zip(audits, roles, texts)):
                if audit is not None:
                    if editor:
                        feed(editor.rest())
                        done.append((*head, sha.hexdigest()))
                    editor, sha, begun = _Editor(audit), hashlib.sha256(), False
                    head = tuple(at[c][i].as_py() for c in kept)
                else:
                    feed(editor.row(r, t))
            yield _table(done, target)
        if editor:
            feed(editor.rest())
            yield _table([(*head, sha.hexdigest())], target)

    return stream.mapInArrow(run, result)
