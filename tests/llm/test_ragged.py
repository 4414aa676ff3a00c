import random

import numpy as np
import public_tokenizers
import regex

from foldwise.llm import ragged
from tests.llm.conftest import ALPHABET

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def random_parts(rng):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]


def test_byte_level_spans_are_the_matches_of_the_pattern():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(0)
    for _ in range(2000):
        parts = random_parts(rng)
        joined, points, offsets = ragged.code_points(parts)
        starts = ragged.byte_level_spans(points, offsets).tolist()
        got = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])]
        assert got == [m for p in parts for m in pattern.findall(p)]


def test_word_spans_are_the_matches_of_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        parts = random_parts(rng)
        joined, points, offsets = ragged.code_points(parts)
        starts, ends = ragged.word_spans(points, offsets)
        assert [joined[a:b] for a, b in zip(starts, ends)] == [m for p in parts for m in WORDS.findall(p)]


def test_slices_cut_only_before_space_and_lose_nothing():
    texts = ["ab cd  ef" * 50, "", "x" * 300, "one two"]
    parts = [(r, p) for rows, parts in ragged.slices(texts, 40) for r, p in zip(rows, parts)]
    for i, text in enumerate(texts):
        mine = [p for r, p in parts if r == i]
        assert "".join(mine) == text and mine
        assert all(p[:1].isspace() for p in mine[1:])


def test_hashes_tell_spans_apart_and_repeat():
    values = np.frombuffer("abcabc".encode("utf-32-le"), np.uint32)
    h = ragged.span_hashes(values, np.array([0, 3, 0, 1]), np.array([3, 6, 2, 3]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_long_spans_hash_without_collisions_of_periodic_words():
    # Thue-Morse words collide under any rolling hash modulo a power of two.
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    values = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
    h = ragged.span_hashes(values, np.array([0, len(a)]), np.array([len(a), len(a + b)]))
    assert h[0] != h[1]


def test_byte_words():
    data, starts, ends, bounds = ragged.byte_words([ragged.folded(t) for t in ("It's É9,x", None, "a")])
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == ["it", "s", "É9", "x", "a"] and bounds.tolist() == [0, 4, 4, 5]
