import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import embeddings, lsh
from foldwise.llm.components import components
from foldwise.llm.line_dedup import SHORTEST, ShingleSets, drop_repeated_lines, normal
from foldwise.llm.order_minhash import EditLikeness, alike, band_distance, keep_one, near_duplicates, sketches, word_tokens
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Sets:
    """Union-find on the driver, for small expectations."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Names(lsh.Likeness):
    """Payloads are numbers, alike if they differ by ``most`` at best; counts exact comparisons."""

    compared = 0

    def __init__(self, most=1):
        self.most = most

    def elements(self, payloads):
        return [np.array([int(p)], np.uint64) for p in payloads]

    def needed(self, size, sizes):
        return np.zeros(len(sizes), np.int64)

    def same(self, x, y):
        Names.compared += 1
        return abs(int(x[0]) - int(y[0])) <= self.most


# Components


def test_components_of_stars_chains_and_rings(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, i) for i in range(100, 400)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = [*chain, *star, *loose, (7, 7), (5, 100)]
    want = Sets({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(df).collect()}
    assert got.keys() == want.up.keys()
    by_root, by_set = {}, {}
    for x in got:
        by_root.setdefault(got[x], set()).add(x)
        by_set.setdefault(want.find(x), set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_set.values()))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_compare_in_rounds(spark, monkeypatch):
    # One bucket of 60: three families and loners; leaders only see their own.
    monkeypatch.setattr(lsh, "PAIRWISE", 4)
    names = {i: f"{i % 3 if i < 45 else i}".encode() for i in range(60)}
    table = spark.createDataFrame([(9, i, bytearray(n)) for i, n in names.items()], "bucket long, id long, payload binary")
    roots = lsh.groups(
        lambda: table.selectExpr("bucket", "id", "1 AS size"),
        lambda ids: table.join(ids, "id").select("id", "payload"),
        lambda: Names(0),
    )
    found = {r["id"]: r["root"] for r in roots.collect()}
    for i in range(3):
        assert len({found[j] for j in range(i, 45, 3)}) == 1
    assert len({found.get(i, i) for i in range(60)}) == 18


def grouped(spark, rows):
    """Roots of (bucket, id, size, name) rows; names are alike that differ by one at most."""
    table = spark.createDataFrame(rows, "bucket long, id long, size int, name int")
    roots = lsh.groups(
        lambda: table.select("bucket", "id", "size"),
        lambda ids: table.join(ids, "id").selectExpr("id", "CAST(CAST(name AS STRING) AS BINARY) AS payload").distinct(),
        Names,
    )
    return {r["id"]: r["root"] for r in roots.collect()}


def test_groups_of_a_hot_bucket_behind_loners(spark, monkeypatch):
    # The smallest 30 ids are alone; 20 true pairs follow, spread over several blocks.
    monkeypatch.setattr(lsh, "PAIRWISE", 4)
    monkeypatch.setattr(lsh, "BLOCK", 16)
    rows = [(9, i, 1, 10 * i) for i in range(30)] + [(9, i, 2, 10 * (i // 2) + 1000) for i in range(30, 70)]
    found = grouped(spark, rows)
    assert all(found[i] == found[i + 1] for i in range(30, 70, 2))
    assert len({found.get(i, i) for i in range(70)}) == 50


@pytest.mark.parametrize("pairwise", [32, 2])
def test_groups_of_a_chain_in_one_bucket(spark, monkeypatch, pairwise):
    # The leader is like the second id only, which is like the third.
    monkeypatch.setattr(lsh, "PAIRWISE", pairwise)
    found = grouped(spark, [(9, 1, 1, 100), (9, 2, 2, 101), (9, 3, 3, 102), (9, 4, 4, 500)])
    assert found[1] == found[2] == found[3] and 4 not in found


def test_pairs_of_hot_buckets_are_compared_once():
    """1,000 copies of one component and 50 loners in 10 buckets: only what can still join, once."""
    ids = np.arange(1050)
    names = [str(7 if i < 1000 else 100 * i).encode() for i in ids]
    table = pa.table({
        "block": np.zeros(1050, np.int64), "id": ids, "size": np.ones(1050, np.int64),
        "root": np.where(ids < 1000, 0, ids), "buckets": [list(range(10))] * 1050, "payload": names,
    })
    Names.compared = 0
    found = [lsh._met(Names(), table, bucket, 0, 0, 0.0) for bucket in range(10)]
    # Copies with each loner, and loners with each other, in the first bucket alone.
    assert Names.compared == 1000 * 50 + 50 * 49 // 2 and not any(found)

    class Pruned(Names):
        def needed(self, size, sizes):
            return np.full(len(sizes), 1)

    Names.compared = 0
    lsh._met(Pruned(), table, 0, 0, 0, 0.0)
    assert Names.compared < 5000  # one bin in 64 agrees by chance


@pytest.mark.parametrize("likeness", [ShingleSets(), EditLikeness()])
def test_bounds_never_exclude_a_like_pair(likeness):
    rng = random.Random(6)
    payloads = []
    for _ in range(120):
        words = [rng.choice(["alpha", "beta", "gamma", "de", "e"]) for _ in range(rng.randint(1, 30))]
        for _ in range(2):
            changed = list(words)
            changed[rng.randrange(len(words))] = rng.choice(["zeta", "de"])
            line = " ".join(changed)
            tokens = word_tokens([line])[0].astype(np.uint32).tobytes()
            payloads.append(line.encode() if isinstance(likeness, ShingleSets) else tokens)
    items = likeness.elements(payloads)
    sizes, bins = lsh.profiles(items)
    alike_ = 0
    for i in range(len(items)):
        bound, needed = lsh._shared(bins, bins[i]), likeness.needed(int(sizes[i]), sizes)
        for j in range(len(items)):
            if likeness.same(items[i], items[j]):
                alike_ += 1
                assert bound[j] >= needed[j]
    assert alike_ > len(items)


def test_profiles_of_large_counts():
    _, bins = lsh.profiles([np.zeros(70_000, np.uint32), np.zeros(300, np.uint32), np.empty(0, np.uint32)])
    assert bins[:, 0].tolist() == [70_000, 300, 0]


# Near-duplicate documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_band_distance_as_the_full_table():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice("abcd") for _ in range(rng.randint(0, 2))]
        most = rng.randint(0, 12)
        d = distance(a, b)
        assert band_distance(a, b, most) == (d if d <= most else None)


def test_sketches_keep_order():
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    swapped = words[150:] + words[:150]
    edited = list(words)
    edited[40] = edited[200] = "new"
    texts = [" ".join(w) for w in (words, swapped, edited, words)]
    found = sketches(*word_tokens([*texts, "", None, "one", "two words"]))
    same = lambda i, j: (found[i] == found[j]).mean()
    assert same(0, 3) == 1 and same(0, 2) > 0.8 and 0.3 < same(0, 1) < 0.75
    assert (found[4] == 0).all() and (found[5] == 0).all() and (found[6] != found[7]).all()


def brute_groups(texts):
    tokens = {k: word_tokens([t])[0].astype(np.uint32).tobytes() for k, t in texts.items()}
    sets = Sets(tokens)
    keys = sorted(tokens)
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            small, large = sorted((len(tokens[i]), len(tokens[j])))
            if small >= 0.8 * large and (tokens[i] == tokens[j] or alike(tokens[i], tokens[j])):
                sets.join(i, j)
    return {k: sets.find(k) for k in keys}


def test_near_duplicates_as_brute_force(spark, corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    want = brute_groups(texts)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in QUERIES["op1_order_minhash"](spark, SF).collect()}
    assert got == {k: (root, k == root) for k, root in want.items()}
    assert len(set(want.values())) < len(want)


def test_near_duplicate_edges(documents, odd_rows):
    base = " ".join(f"word{i}" for i in range(100))
    rows = [*odd_rows, (600, base), (601, base.replace("word5 ", "")), (601, base.upper()), (None, base + " more"), (600, base)]
    docs = documents(rows, ["1 AS kept", "'x' AS best", "2 AS id", "3 AS k"])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    mine = [r for r in got if r["component_id"] == 600]
    assert sorted(r["kept"] for r in mine) == [False, False, False, True, True]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    stay = kept.collect()
    assert sum(r["text"] == base for r in stay) == 1 and not any(r["doc_id"] == 601 for r in stay)
    assert near_duplicates(documents([])).count() == 0 and keep_one(documents([])).count() == 0


def test_a_large_group_of_near_copies(documents):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.random()}" for _ in range(50))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(rows)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == i for i in range(1000, 1020))


# Lines


def brute_lines(rows):
    """Text, lines and dropped lines of every document, from all pairs of lines."""
    first = {}
    for key, text in sorted(rows):
        for n, line in enumerate(text.split("\n")):
            if len(normal(line)) >= SHORTEST:
                first.setdefault(normal(line), (key, n))
    shingles = {line: {line[i : i + 8] for i in range(max(1, len(line) - 7))} for line in first}
    lines, sets = list(shingles), Sets(shingles)
    for x, a in enumerate(lines):
        for b in lines[x + 1 :]:
            small, large = sorted((len(shingles[a]), len(shingles[b])))
            if small >= 0.8 * large:
                both = len(shingles[a] & shingles[b])
                if both >= 0.8 * (small + large - both):
                    sets.join(a, b)
    best = {}
    for line in lines:
        root = sets.find(line)
        best[root] = min(best.get(root, first[line]), first[line])
    out = {}
    for key, text in rows:
        all_ = text.split("\n")
        stay = [v for n, v in enumerate(all_) if len(normal(v)) < SHORTEST or best[sets.find(normal(v))] == (key, n)]
        out[key] = ("\n".join(stay), len(all_), len(all_) - len(stay))
    return out


def test_lines_as_brute_force(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_line_dedup"](spark, SF).collect()}
    assert got == brute_lines(rows)


def test_line_edges(documents, odd_rows):
    line = "this is the line that returns again and again"
    rows = [*odd_rows, (700, f"{line}\nshort\n{line.upper()}"), (701, f"short\n  {line}!"), (None, line), (702, line), (702, line)]
    docs = documents(rows, ["1 AS line", "2 AS gone", "'x' AS h1"])
    got = drop_repeated_lines(docs, shortest=20)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = got.collect()
    text = {r["doc_id"]: r["text"] for r in found if (r["doc_id"] or 0) >= 700}
    assert text == {700: f"{line}\nshort", 701: "short", 702: ""}
    assert sum(r["doc_id"] == 702 for r in found) == 1
    assert [r["n_lines"] for r in found if r["text"] is None] == [0] * sum(r["text"] is None for r in found)
    assert drop_repeated_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_lines(documents([], ["1 AS n_lines"]))


def test_short_lines(documents):
    """By default every line that is not blank is compared; below a shingle's length exactly."""
    rows = [(1, "ab\n\nok\nabcdefghi"), (2, "ab \nOK\n  \nabcdefghj"), (3, "abc\nok then\nok\nabcdefghi")]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(documents(rows)).collect()}
    assert got == {1: "ab\n\nok\nabcdefghi", 2: "  \nabcdefghj", 3: "abc\nok then"}
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(documents(rows), shortest=3).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "abc\nok then\nok"}


def test_very_long_lines(documents):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows = [(i, base[: 199_000 + 100 * i]) for i in range(8)] + [(9, base[:100_000])]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeated_lines(documents(rows)).collect()}
    assert got == {0: 0, 9: 0} | {i: 1 for i in range(1, 8)}


@pytest.mark.parametrize("size", [5, 6, 7, 9])
def test_short_texts_with_one_edit_are_found(documents, size):
    """One word changed, left out or added leaves 0.8; every such pair is found."""
    rng, rows = random.Random(size), []
    for i in range(60):
        words = [f"w{rng.random()}" for _ in range(size)]
        edited, at = list(words), rng.randrange(size)
        edited[at : at + rng.choice([1, 1, 0])] = rng.choice([["new"], ["new"], []]) or []
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(rows)).collect()}
    want = brute_groups(dict(rows))
    assert got == want and len(set(want.values())) <= 60


# Vectors


def brute_vectors(rows, threshold):
    """Links and components in double precision."""
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    sets, links = Sets(range(len(rows))), Counter()
    scaled = [np.array(v, float) / np.abs(v).max() if u else None for (_, v), u in zip(rows, usable)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        root = sets.find(i)
        if key is not None:
            least[root] = min(least.get(root, key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        found = least.get(sets.find(i))
        out.append((key, links[i], found, key is not None and key == found))
    return out


def test_vectors_as_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = [tuple(r) for r in QUERIES["op9_embedding_near_duplicates"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_vectors(rows, 0.9))


def test_vector_edges(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    monkeypatch.setattr(embeddings, "PANEL", 2)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 20))
    rows = [(i, (centres[i % 4] + rng.normal(scale=0.3, size=20)).tolist()) for i in range(120)]
    same = rows[5][1]
    rows += [(200, same), (200, same), (None, same), (300, None), (301, []), (302, [0.0] * 20), (302, [0.0] * 20),
             (303, [float("nan")] * 20), (304, [None, *same[1:]]), (305, [float("inf"), *same[1:]]),
             (306, [1.0, 0.0]), (307, [2.0, 0.1]), (308, [1e-200, 1e-220]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS n")
    for threshold in (0.9, 0.6):
        got = [tuple(r) for r in embeddings.near_duplicates(df, threshold=threshold).collect()]
        assert sorted(got, key=repr) == sorted(brute_vectors(rows, threshold), key=repr)
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id BETWEEN 300 AND 305")).count() == 7
    with pytest.raises(ValueError):
        embeddings.near_duplicates(df, threshold=0)


def test_line_signatures_and_payloads_in_steps(spark, monkeypatch):
    """Bands do not depend on which lines are mixed together; a step sends a line's text once."""
    from foldwise.llm import line_dedup
    from foldwise.llm.lsh import identified

    lines = [f"line {i} " * (i % 9 + 1) for i in range(40)] + ["", "a", "x" * 8]
    whole = line_dedup.signatures(lines)
    monkeypatch.setattr(line_dedup, "_MIXED", 7)
    assert (line_dedup.signatures(lines) == whole).all()
    assert all((line_dedup.signatures([x])[0] == w).all() for x, w in zip(lines, whole))
    docs = spark.createDataFrame([(i, "the same line\nThe  same line") for i in range(50)], "doc_id long, text string").coalesce(1)
    found = line_dedup._payloads(identified(docs, "doc_id", "text"), 1).collect()
    assert [bytes(r.payload) for r in found] == [b"the same line"]


def test_lines_are_taken_apart_once(documents, monkeypatch):
    """All steps read one table of lines, and taking lines out needs no Python."""
    from foldwise.llm import line_dedup

    calls, whole = [], line_dedup._lines
    monkeypatch.setattr(line_dedup, "_lines", lambda *a: calls.append(a) or whole(*a))
    line = "a line that comes back in another text"
    found = drop_repeated_lines(documents([(1, f"{line}\n\n"), (2, f"\n{line}.\nelse\n"), (3, ""), (4, None)]))
    assert len(calls) == 1
    assert "InArrow" not in found._jdf.queryExecution().toString()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()}
    assert got == {1: (f"{line}\n\n", 3, 0), 2: ("\nelse\n", 4, 1), 3: ("", 1, 0), 4: (None, 0, 0)}
