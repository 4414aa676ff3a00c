"""Token counts by rank-synchronous merging of ragged arrays (operator 10).

All pre-tokens of a step are held as one flat symbol array with offsets.  Each
round looks up the rank of every adjacent pair, and every sequence applies its
own lowest-ranked pair at the same time; sequences without a pair left are
done, and their symbols are the count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from foldwise.llm import ragged
from foldwise.llm.common import per_text, require_text

_NO_RANK = np.iinfo(np.int32).max
_WIDTH = 1 << 20
# Counts remembered per worker, by hash of the word; a memory bound, not a cap on words.
_REMEMBERED = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


@dataclass
class MergeTable:
    """Merges as sorted arrays: about a megabyte, bounded by the vocabulary file."""

    pairs: np.ndarray  # left * 2^20 + right, ascending
    ranks: np.ndarray
    made: np.ndarray
    alone: np.ndarray  # by rank: merging one occurrence may create a better pair
    inner: np.ndarray  # symbol of a byte
    final: np.ndarray  # symbol of a word's last byte

    @staticmethod
    def read(text: str) -> MergeTable:
        model = json.loads(text)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        first_use = np.full(max(vocab.values()) + 1, _NO_RANK, np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        pairs = left * _WIDTH + right
        order = np.argsort(pairs, kind="stable")
        symbols = byte_symbols()
        return MergeTable(
            pairs[order], rank[order], made[order], first_use[made] <= rank,
            np.array([vocab[s] for s in symbols], np.int64),
            np.array([vocab[s + suffix] for s in symbols], np.int64),
        )

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 where it is no merge."""
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pairs, at, -1)


def count_symbols(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Symbols left of every non-empty word when no merge applies any more."""
    sizes = np.array([len(w) for w in words], np.int64)
    counts = sizes.copy()
    data = np.frombuffer(b"".join(words), np.uint8)
    symbols = table.inner[data]
    last = np.cumsum(sizes) - 1
    symbols[last] = table.final[data[last]]
    owner = np.repeat(np.arange(len(words)), sizes)
    while len(symbols) > 1:
        joined = owner[1:] == owner[:-1]
        place = np.full(len(symbols), -1, np.int64)
        place[:-1][joined] = table.look_up(symbols[:-1][joined] * _WIDTH + symbols[1:][joined])
        rank = np.where(place >= 0, table.ranks[place], _NO_RANK)
        begins = np.flatnonzero(np.r_[True, ~joined])
        best = np.minimum.reduceat(rank, begins)
        best_here = np.repeat(best, np.diff(np.r_[begins, len(symbols)]))
        hit = (rank == best_here) & (rank != _NO_RANK)
        # Of overlapping occurrences (aaa) every other one, from the left.
        at = np.flatnonzero(hit)
        if not len(at):
            break
        fresh = np.r_[True, np.diff(at) != 1]
        run_head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_head) % 2 == 0]
        # Where a merge may create a pair that goes first, only the leftmost one.
        careful = table.alone[rank[at]]
        leftmost = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        at = at[~careful | leftmost]
        symbols[at] = table.made[place[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        keep &= best_here != _NO_RANK  # finished sequences leave
        counts -= np.bincount(owner[at], minlength=len(counts))
        symbols, owner = symbols[keep], owner[keep]
    return counts


@lru_cache(1)
def unassigned() -> np.ndarray:
    """Code points that Python's Unicode tables do not know; the library's may be newer."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def newer_classes(library: Tokenizer) -> list[tuple[int, int]]:
    """(code point, class) of unassigned ones that the library takes for letters or numbers.

    One of each stands behind a letter and behind a mark: a letter makes one word
    with the former, a number with neither.
    """
    found = []
    known = unassigned().copy()
    # Planes 4 to 13 hold no characters in any version of Unicode, 15 and 16 are private.
    known[0x40000:0xE0000] = known[0xE1000:] = False
    points = np.flatnonzero(known).tolist()
    for a in range(0, len(points), 1 << 16):
        part = points[a : a + (1 << 16)]
        apart = {}
        for lead in "x!":
            pieces = library.pre_tokenizer.pre_tokenize_str(" ".join(lead + chr(c) for c in part))
            apart[lead] = {begin // 3 for _, (begin, _) in pieces if begin % 3 == 1}
        for i, c in enumerate(part):
            if i not in apart["x"]:
                found.append((c, ragged.LETTER))
            elif i in apart["!"]:
                found.append((c, ragged.NUMBER))
    return found


def _clean(text: str) -> str:
    """Normal form C in lower case, letter by letter as the library does it."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    """Counts tokens of texts; remembers counts of words it has seen."""

    def __init__(self, vocabulary: str, newer: Sequence[tuple[int, int]] = ()):
        self.table = MergeTable.read(vocabulary)
        self.classes = ragged.char_classes().copy()
        for point, kind in newer:
            self.classes[point] = kind
        self.library = Tokenizer.from_str(vocabulary)
        special = [t["content"] for t in json.loads(vocabulary)["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[int, int] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special else [text]
            found[i] += len(parts) - 1
            pieces += [self._normal(p) for p in parts]
            owners += [i] * len(parts)
        for rows, parts in ragged.slices(pieces):
            counts, bounds = self._slice(parts)
            np.add.at(found, np.array(owners)[rows], ragged.sums_by(counts, bounds))
        return found

    def _normal(self, text: str) -> str:
        """``text`` as it is merged; characters new to Python are left to the library's tables."""
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            if unassigned()[points].any():
                return self.library.normalizer.normalize_str(text)
        return _clean(text)

    def _slice(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, offsets = ragged.code_points(parts)
        starts, ends = ragged.word_spans(points, offsets, self.classes)
        codes, hashes, where = ragged.distinct(ragged.span_hashes(points, starts, ends))
        keys = hashes.tolist()
        if len(self.known) + len(keys) > _REMEMBERED:
            self.known.clear()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            at = where[new]
            words = [joined[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            counts = count_symbols(self.table, words).tolist()
            self.known.update(zip([keys[i] for i in new], counts))
        each = np.array([self.known[k] for k in keys], np.int64)
        return each[codes] if len(each) else each, np.searchsorted(starts, offsets)


def token_counts(
    df: DataFrame,
    vocabulary_file: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``vocabulary_file`` is a word-end BPE in JSON form, read on the driver.
    Whole texts count; NULL counts as empty (0 bytes, 0 tokens).  Strings of
    special tokens inside a text are one token each.  Repeated and NULL keys
    are rows of their own, an empty table gives an empty one, and other columns
    are ignored; a key column with the name of a result raises ``ValueError``.
    """
    require_text(df, text)
    with open(vocabulary_file, encoding="utf-8") as f:
        text_of_file = f.read()
    newer = newer_classes(Tokenizer.from_str(text_of_file))
    vocabulary = df.sparkSession.sparkContext.broadcast((text_of_file, tuple(newer)))

    def start():
        count = _counter(*vocabulary.value)

        def answer(texts):
            tokens = count(texts)
            return {
                "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": tokens,
                "over_limit": tokens > limit,
            }

        return answer

    return per_text(df, key, text, "n_bytes long, n_tokens long, over_limit boolean", start)


@lru_cache(2)
def _counter(vocabulary: str, newer: tuple[tuple[int, int], ...]) -> Counter:
    """One counter per worker process and vocabulary."""
    return Counter(vocabulary, newer)
