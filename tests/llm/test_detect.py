import random
import re
import zlib

import numpy as np
import pytest

from foldwise.llm import language, quality
from foldwise.llm.decontam import Index, leaks, tile, without_leaks
from foldwise.llm.license_rules import Rule, rules
from foldwise.llm.licenses import Detection, resolve, scan_licenses, scanner, words
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# License scan


def plain_scan(text):
    """Words, base places and labels the slow way: every rule on every text."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(folded)
    places = []
    for phrase, label in [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]:
        want = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(want)] == want]
    joined = f" {' '.join(found)} "
    hits = [
        Detection(m.start(), m.end(), r) for r in rules() for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined)
    ]
    kept = []
    for d in sorted(hits, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.name)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    base = {label for _, label in places}
    return (
        len(found), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {d.rule.label for d in kept})),
    )


LICENSED = [
    (1, "Released under the MIT License. cc by nc cc by nc"),
    (2, "Licensed under the Apache License, Version 2.0; SPDX-License-Identifier: GPL-3.0-or-later"),
    (3, "under the terms of the Mozilla Public License, v. 2.0 and CC-BY-NC-SA 4.0 license"),
    (4, "Mit der Lizenz. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (5, "Licensed under the GNU Lesser General Public License version 2.1 " * 700),
]


def test_license_scan_as_brute_force(documents, odd_rows):
    rows = [*odd_rows, *LICENSED]
    found = scan_licenses(documents(rows, ["'a' AS labels", "1 AS score"]).drop("zz")).collect()
    got = [tuple(r)[:7] for r in found]
    assert sorted(got, key=repr) == sorted([(k, *plain_scan(t)) for k, t in rows], key=repr)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in found)


def test_license_query_over_documents(spark, corpus):
    got = {r["doc_id"]: tuple(r)[1:7] for r in QUERIES["op4_license_scan"](spark, SF).collect()}
    assert got == {r["doc_id"]: plain_scan(r["text"]) for r in corpus.collect()}


def test_rules_are_many_distinct_and_valid():
    names = [r.name for r in rules()]
    assert len(names) > 200 and len(set(names)) == len(names)
    for r in rules():
        re.compile(r.pattern)
        assert r.keywords and 0 < r.confidence <= 1


def test_contained_detections_are_suppressed_by_priority():
    rule = lambda name, priority: Rule(name, name, "x", ("x",), priority, 0.5)
    low, high = rule("low", 1), rule("high", 2)
    kept = resolve([Detection(2, 5, low), Detection(0, 9, high), Detection(8, 12, low), Detection(0, 9, low)])
    assert [(d.start, d.rule.name) for d in kept] == [(0, "high"), (8, "low")]


def test_labels_of_known_phrasings():
    labels = lambda text: {d.rule.label for d in scanner().detect(words(text))}
    assert labels("SPDX-License-Identifier: BSL-1.0") == {"bsl-1.0"}
    assert labels("see https://www.gnu.org/licenses/gpl-3.0") == {"gpl-3.0"}
    assert labels("an ordinary sentence under the sun") == set()


def samples(pattern):
    """Texts that match a rule's expression: one at least for each of its alternatives."""

    def of(tokens):
        parts = [part(kind, value) for kind, value in tokens]
        out = ["".join(p[0] for p in parts)]
        for i, p in enumerate(parts):
            out += ["".join(q[0] if j != i else other for j, q in enumerate(parts)) for other in p[1:]]
        return out

    def part(kind, value):
        kind = str(kind)
        if kind == "LITERAL":
            return [chr(value)]
        if kind == "BRANCH":
            return [s for branch in value[1] for s in of(branch)]
        if kind == "SUBPATTERN":
            return of(value[3])
        if kind == "MAX_REPEAT":
            return [""] + of(value[2]) if value[0] == 0 else of(value[2])
        if kind == "IN":
            name, first = str(value[0][0]), value[0][1]
            return ["1"] if name == "CATEGORY" else [chr(first[0] if name == "RANGE" else first)]
        return {"ANY": ["x"], "ASSERT_NOT": [""], "ASSERT": [""]}[kind]

    return of(re._parser.parse(pattern))


def test_keywords_keep_every_alternative():
    # Each sample is cut off from other text, which could hold a keyword by chance.
    scan = scanner()
    for rule, (_, pattern) in zip(rules(), scan.rules):
        texts = [f" {s} " for s in samples(rule.pattern)]
        assert any(pattern.search(t) for t in texts), rule.name
        for text in texts:
            if pattern.search(text):
                keywords = {word for _, word in scan.automaton.iter(text)}
                assert any(g in text.encode() for g in scan.gates), text
                assert rule.name in {d.rule.name for d in scan.all_matches(text, keywords)}, text


@pytest.mark.parametrize(
    "text, label",
    [
        ("Released under the Python Software Foundation License", "psf-2.0"),
        ("distributed via the MIT license", "mit"),
        ("released by zlib", "zlib"),
        ("released under expat", "mit"),
        ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
    ],
)
def test_labels_do_not_depend_on_other_words(text, label):
    kept = scanner().detect(words(text))
    assert label in {d.rule.label for d in kept}
    assert max(d.rule.confidence for d in kept) >= 0.9


# Classifiers


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = QUERIES["op6_quality_classifier"](spark, folder)
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    good = [r["predicted"] for r in held if r["quality"] == 1]
    assert np.mean(good) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, begins, y = rng.random((9, quality.FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])
    model = quality.BagModel.fresh(1)

    def loss():
        p = model.forward(x, begins)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, slope in model.gradients(x, begins, y).items():
        flat, want = model.weights[name].reshape(-1), slope.reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - want[i]) < 1e-6
            flat[i] = old


def test_quality_edges(documents, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    docs = documents(odd_rows, ["1 AS score", "2 AS predicted", "3 AS y"])
    model = quality.learn(docs, labels)
    assert quality.score(docs, model).count() == len(odd_rows)
    assert quality.learn(docs, labels.where("false")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(documents([]), model).count() == 0
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.accepted(docs, None).count() == len(odd_rows)


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language_id"](spark, folder).join(documents, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_edges(documents, odd_rows):
    docs = documents(odd_rows, ["IF(doc_id % 3 = 0, NULL, IF(doc_id % 2 = 0, 'b', 'a')) AS lang", "1 AS score"])
    model = language.learn(docs)
    assert model.names == ["a", "b"]
    got = language.detect(docs, model).collect()
    assert len(got) == len(odd_rows)
    by_text = {t: None for _, t in odd_rows}
    blank = [t for t in by_text if not any(c.isalpha() for c in t or "")]
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == sum(t in blank for _, t in odd_rows)
    assert language.detect(documents([]), model).count() == 0
    none = language.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language.detect(docs, none).collect()} == {"und"}


def test_too_many_languages_are_refused(documents, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.learn(documents([(1, "ab"), (2, "cd")], ["string(doc_id) AS lang"]))


def test_naive_bayes_as_brute_force():
    model = language.LanguageModel(["x", "y"], np.log([0.5, 0.5]), np.log(np.random.default_rng(0).random((2, language.BUCKETS))))
    text = "It's -- Ümläut  no. 9"
    folded = " it s ümläut no "
    grams = [folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1) if folded[i : i + n] != " "]
    buckets, _, letters = language.ngrams([text])
    assert len(buckets) == len(grams) and letters[0] == 11
    total, _ = model.scores([text])
    want = [np.log(0.5) + sum(row[b] for b in buckets) for row in model.matrix]
    assert np.allclose(total[0], want)


# Decontamination


def plain_tiling(a, b, minimum):
    """Greedy string tiling by its definition; tokens of ``b`` that are covered."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n >= minimum:
                    best.append((n, i, j))
        if not best:
            return covered
        longest = max(best)[0]
        for n, i, j in best:
            if n == longest and not any(used_a[i : i + n]) and not any(used_b[j : j + n]):
                used_a[i : i + n] = used_b[j : j + n] = [True] * n
                covered += n


def test_tiling_as_by_definition():
    rng = random.Random(2)
    number = lambda s: np.array([ord(c) * 7919 + 1 for c in s], np.uint64)
    for _ in range(400):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(1, 30))]
        if a and rng.random() < 0.7:
            s = rng.randrange(len(a))
            b[len(b) // 2 : len(b) // 2] = a[s : s + 12]
        minimum = rng.choice([3, 5])
        assert sum(n for *_, n in tile(number(a), number(b), minimum)) == plain_tiling(a, b, minimum)


def test_leaks_over_documents_as_brute_force(spark, corpus):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    split = lambda t: WORD.findall(t.lower())
    bench = {r["item_id"]: split(r["text"]) for r in items}
    grams = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in bench.items()}
    want = set()
    for r in corpus.collect():
        tokens = split(r["text"])
        own = {tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)}
        for i, t in bench.items():
            if own & grams[i] and plain_tiling(tokens, t, 5) >= 0.5 * len(t):
                want.add((r["doc_id"], i))
    found = QUERIES["op8_benchmark_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and want
    assert all(0.5 <= r["coverage"] <= 1 for r in found)


def test_leaks_find_reordered_passages_in_blocks(documents, spark, odd_rows):
    first, second = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame(
        [(1, f"{first} {second}"), (2, "short item"), (3, ""), (4, None), (4, "alpha beta gamma delta epsilon"), (None, first)],
        "item_id long, text string",
    )
    rows = [*odd_rows, (500, f"x {second} y {first.upper()} z"), (501, "a short item here"), (502, first), (None, second)]
    docs = documents(rows, ["'c' AS coverage", "1 AS n_tiles", "2 AS item_id"])
    with pytest.raises(ValueError):
        leaks(docs, bench, key="item_id")
    for block in (1 << 20, 40):
        got = {(r["doc_id"], r["item_id"]) for r in leaks(docs.drop("item_id"), bench, block_bytes=block).collect()}
        assert got == {(500, 1), (500, None), (501, 2), (502, 1), (502, None)}
        kept = without_leaks(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert leaks(documents([]), bench).count() == 0
    assert leaks(docs.drop("item_id"), bench.where("false")).count() == 0
    assert without_leaks(docs, bench.where("false")).count() == len(rows)


def test_index_of_repeated_tokens():
    index = Index.build([1], ["the the the the the the"], 5)
    (row,) = index.find(["the " * 4000])
    assert row[3] == 1.0


@pytest.mark.parametrize("text", [
    "published by the MIT Press", "offered by MIT", "shared by Ruby", "provided by Vim maintainers",
    "available via OpenSSL", "provided by FreeBSD", "distributed by PostgreSQL Global", "published by X Consortium",
    "provided by X11", "offered by the Python Software Foundation",
])
def test_names_of_people_and_products_grant_nothing(text):
    assert scanner().detect(words(text)) == []


@pytest.mark.parametrize("text, label", [
    ("distributed via the MIT license", "mit"), ("released under MIT", "mit"), ("available via GPL 3", "gpl-3.0"),
    ("shared by the Mozilla Public License 2.0", "mpl-2.0"), ("licensed by the Apache License, Version 2.0", "apache-2"),
    ("offered via BSD 3-clause licence", "bsd-3-clause"),
    ("Redistributions in binary form must reproduce the above copyright notice", "bsd"),
    ("either version 3 of the License, or (at your option) any later version", "gpl-3.0"),
    ("You must give appropriate credit, provide a link to the license, and indicate if changes were made.", "cc-by"),
    ("By installing this software you agree to these terms", "eula"),
])
def test_grants_and_bodies(text, label):
    assert label in {d.rule.label for d in scanner().detect(words(text))}
