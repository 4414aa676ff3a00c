"""Benchmark decontamination by greedy string tiling (operator 8).

Seeds are token windows that a document and a benchmark item share.  For every
pair with a seed, the longest common runs of unmarked tokens are found with
running Karp-Rabin hashes and marked, again and again down to the minimum
length.  The share of an item's tokens that lie in tiles is its coverage; the
order of the tiles does not matter, so reordered passages are caught.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldwise.llm import ragged
from foldwise.llm.common import fields, filter_texts, pick, require_text, steps

MINIMUM_MATCH = 5
COVERAGE = 0.5
# Text of benchmark items that one pass over the documents carries along.
BLOCK_BYTES = 16 << 20
# Pairs of agreeing windows that are looked at together.
HELD = 1 << 20


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and each text's bounds."""
    return ragged.word_hashes([ragged.folded(t.lower() if t else t) for t in texts])


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` values."""
    starts = np.arange(max(0, len(values) - size + 1))
    return ragged.span_hashes(values, starts, starts + size)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Windows of ``size`` without a marked value."""
    used = np.r_[0, np.cumsum(marked)]
    return used[size:] == used[:-size]


def _matches(doc, item, doc_used, item_used, size) -> np.ndarray:
    """Maximal common runs of windows of ``size`` unmarked tokens: rows (length, doc, item).

    Windows that agree are taken for so many places of the document at a time as make
    ``HELD`` pairs; runs along a diagonal that reach the end of a part go on in the
    next.  So memory grows with the two lengths, however often the same words return.
    """
    if min(len(doc), len(item)) < size:
        return np.empty((0, 3), np.int64)
    ours, theirs = windows(doc, size), windows(item, size)
    places = np.flatnonzero(_free(item_used, size))
    places = places[np.argsort(theirs[places], kind="stable")]
    known = theirs[places]
    mine = np.flatnonzero(_free(doc_used, size) & np.isin(ours, known))
    low, high = (np.searchsorted(known, ours[mine], side) for side in ("left", "right"))
    counts = high - low
    marks = np.cumsum(counts) // HELD
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(mine)] if len(mine) else [0]
    ended: list[np.ndarray] = []
    open_ = np.empty((0, 3), np.int64)  # diagonal, first and last place in the document
    for x, y in zip(cuts, cuts[1:]):
        i = np.repeat(mine[x:y], counts[x:y])
        j = places[np.arange(len(i)) - np.repeat(np.cumsum(counts[x:y]) - counts[x:y], counts[x:y]) + np.repeat(low[x:y], counts[x:y])]
        order = np.lexsort((i, i - j))
        i, diagonal = i[order], (i - j)[order]
        heads = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)])
        runs = np.stack([diagonal[heads], i[heads], i[np.r_[heads[1:], len(i)] - 1]], axis=1)
        if len(open_):
            # The first run of a diagonal may go on from the part before.
            at = np.minimum(np.searchsorted(open_[:, 0], runs[:, 0]), len(open_) - 1)
            goes_on = (open_[at, 0] == runs[:, 0]) & (open_[at, 2] + 1 == runs[:, 1])
            runs[goes_on, 1] = open_[at[goes_on], 1]
            stopped = np.ones(len(open_), bool)
            stopped[at[goes_on]] = False
            ended.append(open_[stopped])
        last = runs[:, 2] == mine[y - 1]
        ended.append(runs[~last])
        open_ = runs[last]
    runs = np.concatenate([*ended, open_])
    return np.stack([runs[:, 2] - runs[:, 1] + size, runs[:, 1], runs[:, 1] - runs[:, 0]], axis=1)


def tile(doc: np.ndarray, item: np.ndarray, minimum: int = MINIMUM_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first."""
    doc_used, item_used = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(minimum, min(len(doc), len(item)) // 2)
    while True:
        again = False
        runs = _matches(doc, item, doc_used, item_used, size)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], -runs[:, 0]))]
        for n, i, j in runs.tolist():
            if doc_used[i : i + n].any() or item_used[j : j + n].any():
                again = True  # an earlier tile took a part; look at what is left
                continue
            if np.array_equal(doc[i : i + n], item[j : j + n]):  # and not only by hash
                doc_used[i : i + n] = item_used[j : j + n] = True
                tiles.append((i, j, n))
                if item_used.all() or doc_used.all():
                    return tiles
        if again:
            continue
        if size == minimum:
            return tiles
        size = max(minimum, size // 2)


@dataclass
class Index:
    """Items of one block: their tokens, and where each seed occurs."""

    ids: list
    items: list[np.ndarray]
    minimum: int
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by window size: hash, first, item

    @staticmethod
    def build(ids: list, texts: list[str | None], minimum: int) -> Index:
        values, bounds = tokens(texts)
        items = [values[a:b] for a, b in zip(bounds, bounds[1:])]
        seeds = {}
        for size in sorted({min(minimum, len(t)) for t in items if len(t)}):
            own = [k for k, t in enumerate(items) if min(minimum, len(t)) == size]
            hashes = [np.unique(windows(items[k], size)) for k in own]
            flat = np.concatenate(hashes)
            of = np.repeat(own, [len(h) for h in hashes])
            order = np.argsort(flat, kind="stable")
            unique, first = np.unique(flat[order], return_index=True)
            seeds[size] = (unique, np.r_[first, len(flat)], of[order])
        return Index(ids, items, minimum, seeds)

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float, list]]:
        """(text, item, document tokens, coverage, tiles) for pairs that share a seed."""
        data = [ragged.folded(t.lower() if t else t) for t in texts]
        for a, b in ragged.byte_slices(data):
            values, bounds = ragged.word_hashes(data[a:b])
            candidates: dict[tuple[int, int], list[np.ndarray]] = {}
            for size, (hashes, first, item) in self.seeds.items():
                ours = windows(values, size)
                at = np.searchsorted(hashes, ours)
                at[at == len(hashes)] = 0
                hit = np.flatnonzero(hashes[at] == ours)
                doc = np.searchsorted(bounds, hit, "right") - 1
                inside = hit + size <= bounds[doc + 1]
                hit, doc = hit[inside], doc[inside]
                pair, sizes = ragged.gather(item, first, at[hit])
                key = np.repeat(doc, sizes) * len(self.items) + pair
                place = np.repeat(hit, sizes)
                order = np.argsort(key, kind="stable")
                keys, begin = np.unique(key[order], return_index=True)
                for k, where in zip(keys.tolist(), np.split(place[order], begin[1:])):
                    candidates[divmod(k, len(self.items))] = (where, size)
            for (doc, item), (where, size) in sorted(candidates.items()):
                near, origin = _region(values, where, size)
                minimum = min(self.minimum, len(self.items[item]))
                found = tile(near, self.items[item], minimum)
                covered = sum(n for _, _, n in found) / len(self.items[item])
                places = [(int(origin[i] - bounds[doc]), j, n) for i, j, n in found]
                yield a + doc, item, int(bounds[doc + 1] - bounds[doc]), covered, places


def _region(values: np.ndarray, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens within seeds, gaps closed by one value that matches nothing, and their places."""
    wanted = np.unique((where[:, None] + np.arange(size)).ravel())
    gaps = np.flatnonzero(np.diff(wanted) > 1)
    tokens_ = np.insert(values[wanted], gaps + 1, np.arange(len(gaps), dtype=np.uint64))
    return tokens_, np.insert(wanted, gaps + 1, -1)


def _blocks(benchmark: DataFrame, item_key: str, text: str, minimum: int, block_bytes: int):
    """Indexes of the benchmark, each over items of about ``block_bytes``."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_key).alias("id"), F.col(text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for k in range(count):
        rows = items.where(block == k).orderBy("id", "text").collect()
        index = Index.build([r["id"] for r in rows], [r["text"] for r in rows], minimum)
        yield spark.sparkContext.broadcast(index)


def leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", minimum: int = MINIMUM_MATCH,
    coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it covers to ``coverage`` or more.

    One row per pair: both keys, ``coverage``, ``n_tiles``, ``n_words`` of the
    document and the ``tiles`` (first word in the document, in the item, length).
    Items of fewer words than ``minimum`` must occur as a whole; empty and NULL
    items and texts match nothing.  Repeated or NULL keys stand for themselves:
    every row is compared.  Columns other than key and text are ignored.  A
    benchmark beyond ``block_bytes`` is taken in blocks, a pass over the
    documents each; nothing is shuffled.
    """
    require_text(df, text)
    require_text(benchmark, item_text)
    item_kind = benchmark.schema[item_key].dataType
    result = fields("coverage double, n_tiles int, n_words long, tiles array<struct<doc_word long, item_word int, length int>>")
    narrow = pick(df, [key, text], StructType([StructField(item_key, item_kind), *result.fields]))
    schema = StructType([narrow.schema[0], StructField(item_key, item_kind), *result.fields])
    target = to_arrow_schema(schema)

    def pass_over(index):
        def run(batches):
            for batch in batches:
                for part in steps(batch, 1):
                    found = [m for m in index.value.find(part.column(1).to_pylist()) if m[3] >= coverage]
                    rows, items, sizes, covered, places = zip(*found) if found else [()] * 5
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([index.value.ids[i] for i in items], target.field(1).type),
                        pa.array(covered, pa.float64()),
                        pa.array([len(p) for p in places], pa.int32()),
                        pa.array(sizes, pa.int64()),
                        pa.array([[dict(zip(("doc_word", "item_word", "length"), t)) for t in p] for p in places], target.field(5).type),
                    ], schema=target)

        return narrow.mapInArrow(run, schema)

    passes = [pass_over(i) for i in _blocks(benchmark, item_key, item_text, minimum, block_bytes)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text",
    item_key: str = "item_id", item_text: str = "text", minimum: int = MINIMUM_MATCH,
    coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``df``, all columns, that cover no benchmark item; see ``leaks``."""
    require_text(df, text)
    require_text(benchmark, item_text)

    def pass_over(rows, index):
        def start():
            def clean(texts):
                mask = np.ones(len(texts), bool)
                for row, _, _, covered, _ in index.value.find(texts):
                    mask[row] &= covered < coverage
                return mask

            return clean

        return filter_texts(rows, text, start)

    for index in _blocks(benchmark, item_key, item_text, minimum, block_bytes):
        df = pass_over(df, index)
    return df
