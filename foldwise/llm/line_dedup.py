"""Fuzzy line deduplication by MinHash (operator 3).

Lines are compared as sets of character shingles.  MinHash signatures cut into
bands bring similar lines together, exact Jaccard similarity decides, and a
distributed union-find joins links to components; the first line of each
component in the corpus stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwise.llm import ragged
from foldwise.llm.common import fields, release, require_text, sized, steps, stored
from foldwise.llm.lsh import Likeness, groups, identified, matches, once, renamed

SHINGLE = 8
# 10 bands of 4: a pair of similarity 0.8 is found with a probability of 0.995.
BANDS, ROWS = 10, 4
SIMILARITY = 0.8
# Lines of a band, in several components, that are listed as pairs; more of them are compared in blocks.
PAIRWISE = 128
# Compared lines are of so many characters at least; blank ones never are.
SHORTEST = 1
# Characters whose shingles are hashed or sorted together: what fits a processor's cache.
_CACHED = 1 << 15
# Lines whose bands are mixed together.
_MIXED = 4096

# Columns that hold the bands.
_BANDS = [f"b{i}" for i in range(BANDS)]

_SEEDS = (ragged.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)).astype(np.uint32)


def normal(line: str) -> str:
    """What of a line is compared: lower case, single spaces."""
    line = line.lower()
    # A printable line has no white space but blanks.
    if line.isprintable() and "  " not in line:
        return line.strip(" ")
    return " ".join(line.split())


def _grams(points: np.ndarray, kind: type, base: int) -> np.ndarray:
    """Polynomial hash of the ``SHINGLE`` characters from each place on."""
    n = len(points) - SHINGLE + 1
    h = points[:n].astype(kind)
    for i in range(1, SHINGLE):
        h *= kind(base)
        h += points[i : n + i].astype(kind)
    return h


def signatures(lines: list[str]) -> np.ndarray:
    """Bucket of every band, lines x ``BANDS``; a line below ``SHINGLE`` characters is one shingle."""
    out = np.empty((len(lines), BANDS), np.uint64)
    padded = [line.ljust(SHINGLE, "\0") for line in lines]
    ends = np.cumsum([len(line) for line in padded])
    for first in range(0, len(lines), _MIXED):
        end = min(first + _MIXED, len(lines))
        least = np.empty((BANDS * ROWS, end - first), np.uint32)
        start = first
        while start < end:
            held = ends[start - 1] if start else 0
            stop = min(end, max(start + 1, int(np.searchsorted(ends, held + _CACHED))))
            _, points, offsets = ragged.code_points(padded[start:stop])
            # Shingles over the end of a line are not counted: the last one of a line is repeated there.
            grams = _grams(points, np.uint32, 0x9E3779B1)
            grams ^= grams >> np.uint32(15)
            for i in range(1, SHINGLE):
                grams[offsets[1:-1] - i] = grams[offsets[1:-1] - SHINGLE]
            begins = offsets[:-1]
            hashed = np.empty_like(grams)
            for row, seed in enumerate(_SEEDS):
                np.multiply(grams, seed, out=hashed)
                np.minimum.reduceat(hashed, begins, out=least[row, start - first : stop - first])
            start = stop
        # Bands of all these lines together: mixing a few at a time costs more than their hashes.
        for band in range(BANDS):
            bucket = np.full(end - first, band + 1, np.uint64)
            for row in range(ROWS):
                bucket = ragged.mix(bucket * np.uint64(0x9E3779B97F4A7C15) + least[band * ROWS + row].astype(np.uint64))
            out[first:end, band] = bucket
    return out


class ShingleSets(Likeness):
    """Lines as sets of ``SHINGLE`` characters, 48 bits of a hash each; Jaccard similarity decides."""

    def elements(self, payloads: Sequence[bytes]) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        held, size = [], 0
        for payload in payloads:
            held.append(payload.decode().ljust(SHINGLE, "\0"))
            size += len(held[-1])
            if size >= _CACHED:
                found += self._sets(held)
                held, size = [], 0
        return found + self._sets(held) if held else found

    def _sets(self, lines: list[str]) -> list[np.ndarray]:
        """Ascending shingles of each line; all are sorted together, by line (fewer than 2^16) and shingle."""
        _, points, offsets = ragged.code_points(lines)
        grams = ragged.mix(_grams(points, np.uint64, 0x9E3779B97F4A7C15)) >> np.uint64(16)
        owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(offsets))[: len(grams)]
        inside = np.arange(len(grams)) <= np.repeat(offsets[1:] - SHINGLE, np.diff(offsets))[: len(grams)]
        keys = np.sort((owner[inside] << np.uint64(48)) | grams[inside])
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        begins = np.searchsorted(keys, np.arange(len(lines), dtype=np.uint64) << np.uint64(48))
        return np.split(keys & np.uint64((1 << 48) - 1), begins[1:])

    def needed(self, size: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.ceil(SIMILARITY / (1 + SIMILARITY) * (size + sizes) - 1e-6).astype(np.int64)

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[place] == small).sum())
        return both >= SIMILARITY * (len(x) + len(y) - both)


def alike(x: bytes, y: bytes) -> bool:
    """Whether two lines' shingle sets have a Jaccard similarity of ``SIMILARITY``."""
    return ShingleSets().same(*ShingleSets().elements([x, y]))


def _digests(lines: list[str]) -> np.ndarray:
    """128 bits of every line as two whole numbers."""
    found = [hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=16).digest() for line in lines]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _compared(texts: list[str | None], shortest: int) -> tuple[list[int], list[int], list[str]]:
    """Text, number and compared form of every line that is compared."""
    rows, numbers, lines = [], [], []
    for row, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            if len(line) >= shortest and len(line := normal(line)) >= shortest:
                rows.append(row)
                numbers.append(number)
                lines.append(line)
    return rows, numbers, lines


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """Document, number and digest of every line that is compared.

    The first line of each compared form in a step has its bands and ``payload`` (that
    form); the others leave them NULL, as they would say the same.
    """
    kind = docs.schema["k"].dataType.simpleString()
    schema = fields(
        f"k {kind}, t1 long, t2 long, line int, h1 long, h2 long, " + ", ".join(f"{b} long" for b in _BANDS) + ", payload binary"
    )
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 3, 1 << 21):
                rows, numbers, lines = _compared(part.column(3).to_pylist(), shortest)
                if not lines:
                    continue
                place: dict[str, int] = {}
                which = np.array([place.setdefault(line, len(place)) for line in lines], np.int64)
                distinct = list(place)
                digests = _digests(distinct)[which]
                # Forms are numbered as they come: a line is the first one if its number is a new maximum.
                first = np.diff(np.maximum.accumulate(which), prepend=-1) > 0
                own = pa.array(which, mask=~first)
                taken = pa.array(rows, pa.int64())
                columns = [part.column(i).take(taken) for i in range(3)]
                columns += [pa.array(numbers, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                bands = signatures(distinct).view(np.int64)
                columns += [pa.array(np.ascontiguousarray(bands[:, i])).take(own) for i in range(BANDS)]
                columns.append(pa.array([line.encode("utf-8", "replace") for line in distinct], pa.binary()).take(own))
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        release()

    return docs.mapInArrow(run, schema)


def _forms(lines: DataFrame) -> DataFrame:
    """Digest and ``payload`` of lines, once for each step of a task that has them."""
    return lines.where("payload IS NOT NULL").select("h1", "h2", "payload")


def _payloads(docs: DataFrame, shortest: int) -> DataFrame:
    return _forms(_lines(docs, shortest))


def _repeats(docs: DataFrame, shortest: int) -> DataFrame:
    """``k``, ``t1``, ``t2`` of documents with lines to drop, and their numbers ``gone``."""
    # Texts are taken apart once; all later steps read this table, each its own columns.
    # Half of it are bands, which no codec makes smaller, so a quick one is used.
    lines = stored(_lines(docs, shortest), "lines", compression="lz4_raw")
    # Bands as whole numbers are combined by hash; arrays would be sorted.
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *[F.min(b).alias(b) for b in _BANDS])
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")

    def buckets() -> DataFrame:
        # Repeated shingles leave no bound on sizes.
        return classes.select(F.explode(F.array(*_BANDS)).alias("bucket"), "id", F.lit(0).alias("size"))

    def payloads(ids: DataFrame) -> DataFrame:
        wanted = sized(stored(classes.join(ids, "id", "left_semi").select("id", "h1", "h2"), "wanted-lines"))
        found = _forms(lines).join(wanted, ["h1", "h2"])
        return found.groupBy("id").agg(F.first("payload").alias("payload"))

    roots = stored(groups(buckets, payloads, ShingleSets, pairwise=PAIRWISE), "line-roots")
    state = classes.select("h1", "h2", "id", "n").join(sized(roots), "id", "left").where("n > 1 OR root IS NOT NULL")
    state = sized(stored(state.select("h1", "h2", F.coalesce("root", "id").alias("root")), "line-groups"))
    here = F.struct(F.col("k").isNull().alias("none"), "k", "t1", "t2", "line")
    grouped = lines.select("k", "t1", "t2", "line", "h1", "h2").join(state, ["h1", "h2"]).select("root", "k", "t1", "t2", "line")
    best = sized(stored(grouped.groupBy("root").agg(F.min(here).alias("best")), "line-best"))
    gone = grouped.join(best, "root").where(~here.eqNullSafe(F.col("best")))
    # At most the lines of one document.
    return gone.groupBy("k", "t1", "t2").agg(F.collect_set("line").alias("gone"))


def drop_repeated_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """``df`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Of all lines of the corpus whose compared forms are linked (Jaccard
    similarity of 8-character shingles >= ``SIMILARITY``), directly or over
    others, the one in the first document by key (NULL last, then by text hash)
    and first place stays.  Lines whose compared form has fewer than ``shortest``
    characters (1 at least: blank ones) always stay; one below 8 characters is a single
    shingle, so it is linked with its equals only.  Of rows equal in key and text one stays; rows that repeat a key with
    another text are documents of their own.  A document may end up empty; NULL
    texts stay NULL and count no lines, empty ones count one.  An empty table
    gives an empty one; all other columns are carried along, and columns named
    like a result raise ``ValueError``.
    """
    require_text(df, text)
    clash = {"n_lines", "n_dropped"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"input columns {sorted(clash)} have the names of results; rename them")
    gone = sized(stored(renamed(_repeats(identified(df, key, text), max(1, shortest)), "gone"), "lines-gone"))
    marked = once(df, key, text).join(gone.withColumnRenamed("gone", "__gone"), matches(key), "left")
    lines = F.split(f"`{text}`", "\n")
    # The lambda names the lines, so that a text is split once and not for each line kept.
    left = F.transform(
        F.array(lines),
        lambda l: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("__gone")), lambda i: F.get(l, i)), "\n"
        ),
    )
    kept = F.when(F.size("__gone") > 0, F.get(left, F.lit(0))).otherwise(F.col(f"`{text}`"))
    return marked.select(
        *[kept.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("n_dropped"),
    )
