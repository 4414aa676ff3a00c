"""License scan by ordered signature rules (operator 4).

A text is folded to lower-case words.  An automaton finds the rules' keywords in
one pass; only rules whose keywords all occur run their regular expression.
Detections are then taken by priority, and one that lies inside the interval of
a detection taken before is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from foldwise.llm import ragged
from foldwise.llm.common import per_text, require_text
from foldwise.llm.license_rules import Rule, rules

# Phrases that always count, with their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
_BASE_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def words(text: str | None) -> bytes:
    """Words of a text, lower-case in ASCII, between single spaces; ends included."""
    return b" " + b" ".join(ragged.folded(text).split()) + b" "


def base_places(folded: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place where a base phrase stands."""
    found = []
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = folded.find(needle)
        while at >= 0:
            found.append((folded.count(b" ", 0, at), label))
            at = folded.find(needle, at + 1)
    return sorted(found)


class Scanner:
    """Compiled rules behind their keywords."""

    def __init__(self, ordered: list[Rule]):
        self.rules = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in ordered]
        self.wanted = [frozenset(r.keywords) for r in ordered]
        self.choices = {k: frozenset(k.split("|")) for k in frozenset().union(*self.wanted)}
        self.automaton = ahocorasick.Automaton()
        for word in frozenset().union(*self.choices.values()):
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()
        # Every rule needs one of these; a text without any needs no automaton.
        self.gates = self._gates()

    def _gates(self) -> list[bytes]:
        """Longest keyword of each rule, all its alternatives: one occurs where the rule can match."""
        shortest = lambda k: (min(map(len, self.choices[k])), len(k))
        return sorted({word.encode() for w in self.wanted for word in self.choices[max(w, key=shortest)]})

    def all_matches(self, text: str, keywords: set[str]) -> list[Detection]:
        found = []
        met = {k for k, words in self.choices.items() if not words.isdisjoint(keywords)}
        for (rule, pattern), wanted in zip(self.rules, self.wanted):
            if wanted <= met:
                found += [Detection(m.start(), m.end(), rule) for m in pattern.finditer(text)]
        return found

    def detect(self, folded: bytes) -> list[Detection]:
        """Detections that survive, in the order they were taken."""
        if not any(g in folded for g in self.gates):
            return []
        text = folded.decode("utf-8", "replace")
        keywords = {word for _, word in self.automaton.iter(text)}
        return resolve(self.all_matches(text, keywords))


def resolve(found: list[Detection]) -> list[Detection]:
    """By priority, then length, then place; contained intervals are suppressed."""
    kept: list[Detection] = []
    order = lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.name)
    # The furthest end of a kept interval that holds each place.
    reach = np.zeros(max((d.end for d in found), default=0) + 1, np.int64)
    for d in sorted(found, key=order):
        if reach[d.start] < d.end:
            kept.append(d)
            inside = reach[d.start : d.end]
            np.maximum(inside, d.end, out=inside)
    return kept


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner(rules())


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License labels and their places for every row, from its whole text.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word`` of the base
    phrases' places (NULL without any); ``base_labels`` and ``labels`` (sorted,
    comma-joined, empty without any); ``score``, the confidence of the best
    detection; ``rules``, the names of the rules behind the labels.  NULL counts
    as empty, repeated and NULL keys are rows of their own, an empty table gives
    an empty one, other columns are ignored.
    """
    require_text(df, text)
    result = (
        "n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, rules array<string>"
    )

    def start():
        scan = scanner()

        def answer(texts):
            columns = {name.split()[0]: [] for name in result.split(", ")}
            for text in texts:
                folded = words(text)
                base = base_places(folded)
                kept = scan.detect(folded)
                named = {label for _, label in base}
                row = {
                    "n_words": max(0, folded.count(b" ") - 1) if len(folded) > 2 else 0,
                    "n_base": len(base),
                    "first_word": base[0][0] if base else None,
                    "last_word": base[-1][0] if base else None,
                    "base_labels": ",".join(sorted(named)),
                    "labels": ",".join(sorted(named | {d.rule.label for d in kept})),
                    "score": max([0.0, *[_BASE_CONFIDENCE for _ in base], *[d.rule.confidence for d in kept]]),
                    "rules": sorted({d.rule.name for d in kept}),
                }
                for name, value in row.items():
                    columns[name].append(value)
            return columns

        return answer

    return per_text(df, key, text, result, start)
