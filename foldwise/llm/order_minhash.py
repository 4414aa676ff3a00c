"""Near-duplicate documents by order MinHash (operator 1).

A sketch function orders all occurrence-labelled k-mers of a text by a hash,
takes the first few of them and keeps those in text order.  Two texts have equal
sketches the likelier the smaller their edit distance is: moved passages break
the order, which a plain MinHash would not see.  Texts that share a sketch are
compared by an alignment inside a band, which proves an edit similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm import ragged
from foldwise.llm.common import release, require_text, sized, steps, stored
from foldwise.llm.lsh import Likeness, groups, identified, keep_rows

WORDS = 5  # words in a k-mer
SKETCHES = 64
KEPT = 2  # k-mers in a sketch
SIMILARITY = 0.8
# Bytes of text that are sketched together: a word's hash takes many times its bytes.
STEP = 1 << 20
# Up to so many words one edit is the most that SIMILARITY allows; such pairs are found exactly.
EXACT = 9
# Texts of up to so many words have few k-mers, and scattered edits spoil most of them:
# they get further sketches, of k-mers of two words.
SHORT, SHORT_WORDS, SHORT_SKETCHES = 80, 2, 24

_SEEDS = ragged.mix(np.arange(1, 4 * SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and each text's bounds."""
    return ragged.word_hashes([ragged.folded(t.lower() if t else t) for t in texts])


def _occurrences(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each value came before in its text."""
    order = np.lexsort((values, owner))
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    place = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return out


def sketches(tokens: np.ndarray, bounds: np.ndarray, words: int = WORDS, kept: int = KEPT, number: int = SKETCHES) -> np.ndarray:
    """Order MinHash sketches, texts x ``number``; texts without a word get zeros.

    A text of fewer words than ``words`` has one k-mer, the whole of it.
    """
    sizes = np.diff(bounds)
    count = np.where(sizes > 0, np.maximum(1, sizes - words + 1), 0)
    out = np.zeros((len(sizes), number), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    owner = np.repeat(np.arange(len(sizes)), count)
    begins = np.cumsum(count) - count
    starts = np.arange(len(owner)) - begins[owner] + bounds[:-1][owner]
    ends = np.minimum(starts + words, bounds[1:][owner])
    kmers = ragged.span_hashes(tokens, starts, ends)
    labels = ragged.mix(kmers + _occurrences(kmers, owner).astype(np.uint64) * _SEEDS[-1])
    heads = begins[full]
    # The low bits of a rank hold the place in the text, so a minimum finds it.
    low = np.uint64((1 << int(count.max()).bit_length()) - 1)
    place_in_text = (np.arange(len(owner)) - begins[owner]).astype(np.uint64)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(number):
        rank = labels * _SEEDS[j]
        np.bitwise_and(rank, ~low, out=rank)
        np.bitwise_or(rank, place_in_text, out=rank)
        places = np.empty((len(full), kept), np.int64)
        for i in range(kept):
            least = np.minimum.reduceat(rank, heads)
            found = heads + (least & low).astype(np.int64)
            places[:, i] = np.where(least == last, places[:, 0], found)
            rank[found[least != last]] = last
        places.sort(axis=1)
        sketch = np.full(len(full), j + 1, np.uint64)
        for i in range(kept):
            sketch = ragged.mix(sketch * np.uint64(0x9E3779B97F4A7C15) + kmers[places[:, i]])
        out[full, j] = sketch
    return out


def band_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is ``most`` or less, else None.

    Bit vectors hold one column of the band of 2 * most + 1 diagonals; the band
    moves down a row with every element of the shorter sequence.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    most = min(most, len(a))
    if most == 0:
        return None
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    masks = {}
    for x in set(b) & where.keys():
        bits = bytearray(len(a) // 8 + 1)
        for i in where[x]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[x] = int.from_bytes(bits, "little")
    width = 2 * most + 1
    full = (1 << width) - 1
    lowest = 1 << (width - 1)
    plus = full & ~((1 << most) - 1)  # rows below the first: one more each
    minus = 0
    distance = most
    turn = len(a) - most  # columns until the band's lowest row is the last one
    edge = lowest >> 1
    for j, x in enumerate(b):
        start = j - most
        seen = masks.get(x, 0)
        seen = (seen << -start if start < 0 else seen >> start) & full
        zero = ((((seen & plus) + plus) ^ plus) | seen | minus) & full
        up = minus | (full & ~(zero | plus))
        down = zero & plus
        if j < turn:
            distance += not zero & lowest
        else:
            distance += bool(up & edge) - bool(down & edge)
            edge >>= 1
        plus = down | (full & ~((zero >> 1) | up))
        minus = (zero >> 1) & up
        # Below, every remaining column can lower the distance by one at most.
        if distance - (len(b) - 1 - max(j, turn - 1)) > most:
            return None
    return distance if distance <= most else None


def most_edits(longer: np.ndarray | int, similarity: float = SIMILARITY) -> np.ndarray | int:
    """Edits that leave ``similarity`` to texts of which the longer one has so many words."""
    return np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)


class EditLikeness(Likeness):
    """Texts as word sequences; 1 - distance / longer length decides."""

    def elements(self, payloads: Sequence[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(p, np.uint32) for p in payloads]

    def needed(self, size: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
        # An edit changes one word of either text: all others are shared.
        longer = np.maximum(size, sizes)
        return longer - most_edits(longer)

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        longer = max(len(x), len(y))
        most = int(most_edits(longer))
        if abs(len(x) - len(y)) > most:
            return False
        values, counts = np.unique(np.concatenate([x, y]), return_inverse=True)
        in_x = np.bincount(counts[: len(x)], minlength=len(values))
        in_y = np.bincount(counts[len(x) :], minlength=len(values))
        if np.minimum(in_x, in_y).sum() < longer - most:
            return False
        left, right = x.tolist(), y.tolist()
        for band in (16, 128):
            if band < most and band_distance(left, right, band) is not None:
                return True
        return band_distance(left, right, most) is not None


def alike(x: bytes, y: bytes) -> bool:
    """Whether two word sequences, 32 bits a word, have an edit similarity of ``SIMILARITY``."""
    return EditLikeness().same(*EditLikeness().elements([x, y]))


def deletions(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashes of a short text's word sequence and of those with one word left out, else none.

    Texts of up to ``EXACT`` words that one edit makes equal share one of them.
    """
    sizes = np.diff(bounds)
    found = [np.empty(0, np.uint64)] * len(sizes)
    for n in range(1, EXACT + 1):
        rows = np.flatnonzero(sizes == n)
        if not len(rows):
            continue
        words = tokens[bounds[rows][:, None] + np.arange(n)]
        variants = [words, *[np.delete(words, i, axis=1) for i in range(n)]]
        hashes = []
        for variant in variants:
            h = np.full(len(rows), 0xD1B54A32D192ED03, np.uint64)
            for column in variant.T:
                h = ragged.mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
            hashes.append(h)
        for row, own in zip(rows, np.stack(hashes, axis=1)):
            found[row] = np.unique(own)
    return found


def buckets_of(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """All that brings a text together with others: sketches, and the further ones of short texts."""
    sizes = np.diff(bounds)
    short = np.flatnonzero(sizes <= SHORT)
    own, _ = ragged.gather(tokens, bounds, short)
    more = sketches(own, np.r_[0, np.cumsum(sizes[short])], SHORT_WORDS, KEPT, SHORT_SKETCHES)
    found = list(sketches(tokens, bounds))
    for row, further in zip(short.tolist(), more):
        found[row] = np.concatenate([found[row], further])
    return [np.concatenate(both) for both in zip(found, deletions(tokens, bounds))]


def _digest(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(df: DataFrame) -> DataFrame:
    """Identity, word digest and sketches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 3, STEP):
                tokens, bounds = word_tokens(part.column(3).to_pylist())
                found = buckets_of(tokens, bounds)
                digests = [_digest(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]
                flat = pa.array(np.concatenate(found).view(np.int64))
                offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([d[0] for d in digests], pa.int64()),
                     pa.array([d[1] for d in digests], pa.int64()),
                     pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)],
                    names=["k", "t1", "t2", "h1", "h2", "words", "sketch"],
                )
        release()

    kind = df.schema["k"].dataType.simpleString()
    return df.mapInArrow(run, f"k {kind}, t1 long, t2 long, h1 long, h2 long, words int, sketch array<long>")


def _tokens(df: DataFrame) -> DataFrame:
    """``h1``, ``h2`` and the words, 32 bits each, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0, STEP):
                tokens, bounds = word_tokens(part.column(0).to_pylist())
                digests = [_digest(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]
                short = tokens.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                     pa.array([short[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                    names=["h1", "h2", "payload"],
                )
        release()

    return df.mapInArrow(run, "h1 long, h2 long, payload binary")


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (``k``, ``t1``, ``t2``) with their group's least key and row."""
    require_text(df, text)
    source = identified(df, key, text)
    rows = stored(_signed(source), "order-sketches")
    first = F.struct(F.col("k").isNull().alias("none"), "k", "t1", "t2")
    classes = rows.groupBy("h1", "h2").agg(
        F.min(first).alias("least"), F.first("words").alias("words"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "text-classes")

    def buckets() -> DataFrame:
        return classes.where("words > 0").select(F.explode("sketch").alias("bucket"), "id", F.col("words").alias("size"))

    def payloads(ids: DataFrame) -> DataFrame:
        # The texts that stand for the classes are looked up by key and hash.
        wanted = classes.join(ids, "id", "left_semi").select("id", "h1", "h2", "least.k", "least.t1", "least.t2")
        wanted = sized(stored(wanted, "wanted-texts"))
        texts = source.join(
            wanted.select(F.col("k").alias("wk"), F.col("t1").alias("w1"), F.col("t2").alias("w2")),
            F.col("k").eqNullSafe(F.col("wk")) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")),
            "left_semi",
        )
        found = _tokens(texts.select("text")).join(wanted.select("id", "h1", "h2"), ["h1", "h2"])
        return found.groupBy("id").agg(F.first("payload").alias("payload"))

    roots = groups(buckets, payloads, EditLikeness, SIMILARITY)
    state = stored(
        classes.join(roots, "id", "left").select("h1", "h2", "least", F.coalesce("root", "id").alias("root")),
        "text-groups",
    )
    best = sized(stored(state.groupBy("root").agg(F.min("least").alias("best")), "text-best"))
    state = sized(stored(state.join(best, "root").select("h1", "h2", "best"), "text-states"))
    return rows.select("k", "t1", "t2", "h1", "h2").join(state, ["h1", "h2"]).drop("h1", "h2")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``component_id`` and ``kept`` of every row.

    Texts are compared as sequences of lower-case words.  Two of them are linked
    when their edit similarity is ``SIMILARITY`` or more and an order sketch
    brings them together (texts of up to ``SHORT`` words have more of those, of
    shorter k-mers), or, up to ``EXACT`` words, an equal rest after leaving out a word; equal word sequences are one class from the start.
    ``component_id`` is the least key a row reaches over links (NULL if all are
    NULL); ``kept`` marks the row with it, by text hash where keys repeat, and
    rows equal in key and text alike.  Texts without any word are one class.  An
    empty table gives an empty one; other columns are ignored.
    """
    best = F.col("best")
    same = (F.col("t1") == best["t1"]) & (F.col("t2") == best["t2"]) & F.col("k").eqNullSafe(best["k"])
    return _grouped(df, key, text).select(
        F.col("k").alias(key), best["k"].alias("component_id"), same.alias("kept")
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay: one of every group.

    Of rows equal in key and text any one stays, whatever else they hold.
    """
    groups_ = _grouped(df, key, text).groupBy("best").agg(F.count(F.lit(1)).alias("n"))
    return keep_rows(df, key, text, groups_.select("best.k", "best.t1", "best.t2"))
