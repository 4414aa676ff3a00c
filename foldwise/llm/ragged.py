"""Flat numpy views of batches of texts: pre-tokens, words and their hashes.

A slice of texts is one array of code points (or bytes) plus offsets.  Spans are
pairs of start and end arrays; nothing here loops over characters in Python.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd

SPACE, LETTER, NUMBER, OTHER = range(4)

# Characters per slice: bounds the arrays of one step, whatever the batch holds.
SLICE_CHARS = 1 << 20
# Longer spans are hashed one by one with a cryptographic hash.
_LONG_SPAN = 512

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

# Code points with the Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CUT = re.compile(r"\S(?=\s)")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for every code point."""
    major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    table = np.full(0x110000, OTHER, np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[_WHITE] = SPACE
    return table


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """(row, part) lists of about ``limit`` characters; longer texts are cut.

    A cut lies between a non-space and a space, where no pre-token spans it.  A
    text without such a place stays whole.  Every row occurs at least once.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > limit:
                found = _CUT.search(text, at + limit - 1)
                end = found.end() if found else end
            rows.append(row)
            parts.append(text[at:end] if at or end < len(text) else text)
            held += end - at
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
            at = end
            if at >= len(text):
                break
    if rows:
        yield rows, parts


def code_points(parts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points and the offsets of the parts."""
    joined = "".join(parts)
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), offsets


def _run_starts(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    fresh = np.empty(len(kinds), bool)
    fresh[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < len(kinds)]] = True
    return fresh


def _contractions(cp: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
    """Join apostrophes that begin a span with 's 't 'm 'd 're 've 'll, in place."""
    n = len(cp)
    at = np.flatnonzero((cp == 39) & begins)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    if not len(at):
        return
    one = np.isin(cp[at + 1], [ord(c) for c in "stmd"])
    longer = at[~one]
    longer = longer[longer + 2 < n]
    longer = longer[~first[longer + 2]]
    pair = cp[longer + 1].astype(np.int64) * 0x110000 + cp[longer + 2]
    two = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
    for found, size in ((at[one], 2), (longer[two], 3)):
        begins[found + 1] = False
        after = found + size
        begins[after[after < n]] = True


def byte_level_spans(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the matches of ``public_tokenizers.PATTERN``; they cover every character."""
    if not len(cp):
        return np.empty(0, np.int64)
    kinds = char_classes()[cp]
    begins = _run_starts(kinds, offsets)
    first = np.zeros(len(cp), bool)
    first[offsets[:-1][offsets[:-1] < len(cp)]] = True
    # A run after white space: the last space goes with it, another one stands alone.
    heads = np.flatnonzero(begins & (kinds != SPACE) & ~first)
    heads = heads[kinds[heads - 1] == SPACE]
    begins[heads - 1] = True
    begins[heads[cp[heads - 1] == 32]] = False
    _contractions(cp, begins, first)
    return np.flatnonzero(begins)


def word_spans(
    cp: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spans of letter runs, single numbers, other runs and contractions; no white space.

    ``classes`` takes the place of ``char_classes()``.
    """
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = (char_classes() if classes is None else classes)[cp]
    begins = _run_starts(kinds, offsets) | (kinds == NUMBER)
    first = np.zeros(len(cp), bool)
    first[offsets[:-1][offsets[:-1] < len(cp)]] = True
    _contractions(cp, begins, first)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(cp))
    kept = kinds[starts] != SPACE
    return starts[kept], ends[kept]


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        powers = np.full(size, base, np.uint64)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit rolling (Karp-Rabin) hashes of spans of ``values``, from prefix sums.

    Spans of over 512 values, where such hashes can be made to collide, get a
    cryptographic one.
    """
    n = len(values)
    up, down = _powers(max(1 << 21, 1 << (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    for i in np.flatnonzero(ends - starts > _LONG_SPAN):
        digest = hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each hash, the distinct hashes, and where each first occurs."""
    codes, values = pd.factorize(hashes)
    where = np.empty(len(values), np.int64)
    where[codes[::-1]] = np.arange(len(hashes))[::-1]
    return codes, np.asarray(values, np.uint64), where


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``which`` of (flat, offsets); also their lengths."""
    begin = offsets[which]
    sizes = offsets[which + 1] - begin
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(begin - (ends - sizes), sizes)
    return flat[index], sizes


def sums_by(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``sizes`` between consecutive ``bounds``."""
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# ASCII letters in lower case, every other ASCII character but digits as a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and other ASCII non-words as spaces (NULL: empty)."""
    return text.encode("utf-8", "replace").translate(_FOLD) if text else b""


def byte_words(
    folded_texts: Sequence[bytes],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends and per-text bounds (in words) of folded texts."""
    data = np.frombuffer(b" ".join(folded_texts) + b" ", np.uint8)
    word = np.zeros(len(data) + 1, np.int8)
    np.not_equal(data, 32, out=word[1:], casting="unsafe")
    step = np.diff(word)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    begins = np.zeros(len(folded_texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in folded_texts], out=begins[1:])
    return data, starts, ends, np.searchsorted(starts, begins)


def word_hashes(folded_texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the texts' bounds in that array."""
    data, starts, ends, bounds = byte_words(folded_texts)
    return span_hashes(data, starts, ends), bounds


def byte_slices(rows: Sequence[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, one row at least."""
    start, held = 0, 0
    for i, row in enumerate(rows):
        held += len(row) + 1
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(rows):
        yield start, len(rows)
