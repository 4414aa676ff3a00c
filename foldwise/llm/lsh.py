"""From sketch buckets to verified groups, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.llm.common import is_empty, release, sized, stored
from foldwise.llm.components import components

# Buckets in several components of up to this many ids are listed as pairs; larger ones are
# compared block against block, in blocks of about so many ids and bytes of payload.
PAIRWISE = 32
BLOCK, BLOCK_BYTES = 1024, 4 << 20
# Bytes of payload of the pairs that are verified together.
PAIR_BYTES = 1 << 20
# Counts of a profile; more of them prune better and take longer.
BINS = 64


class Likeness:
    """How payloads are compared: as bags of elements first, then exactly."""

    def elements(self, payloads: Sequence[bytes]) -> list[np.ndarray]:
        """What each payload consists of, as whole numbers (hashes)."""
        raise NotImplementedError

    def needed(self, size: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many elements like payloads of these sizes must at least share."""
        raise NotImplementedError

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        """The exact decision, from elements."""
        raise NotImplementedError


def profiles(items: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of elements of each item, and how many fall into each of ``BINS`` bins.

    Two items share at most the sum of the bins' lesser counts.
    """
    sizes = np.array([len(x) for x in items], np.int64)
    if not len(items):
        return sizes, np.zeros((0, BINS), np.uint8)
    owner = np.repeat(np.arange(len(items)), sizes)
    bins = (np.concatenate(items) % np.array(BINS, items[0].dtype)).astype(np.int64)
    counts = np.bincount(owner * BINS + bins, minlength=len(items) * BINS).reshape(-1, BINS)
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint16 if counts.max() < 1 << 16 else np.int64
    return sizes, counts.astype(kind)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of what profiles share."""
    return np.minimum(x, y).sum(axis=1, dtype=np.int64)


def verified(pairs: DataFrame, payloads: DataFrame, agree: Callable[[], Likeness]) -> DataFrame:
    """The pairs ``a``, ``b`` (a table marked by its size) whose payloads agree.

    Both payloads of a pair meet by the pair, so an id with very many pairs
    makes no large partition, and payloads without a pair are not moved.
    """
    left = payloads.select(F.col("id").alias("a"), F.col("payload").alias("x")).join(pairs, "a")
    right = payloads.select(F.col("id").alias("b"), F.col("payload").alias("y")).join(pairs, "b")
    rows = left.select("a", "b", "x").join(right.select("a", "b", "y"), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = agree()
        for batch in batches:
            for part in _parts(batch):
                place: dict[bytes, int] = {}
                sides = [
                    np.array([place.setdefault(v, len(place)) for v in part.column(c).to_pylist()], np.int64)
                    for c in ("x", "y")
                ]
                items = likeness.elements(list(place))
                sizes, bins = profiles(items)
                x, y = sides
                bound = _shared(bins[x], bins[y])
                least = likeness.needed(sizes[x], sizes[y])
                same = [
                    bool(ok) and likeness.same(items[i], items[j])
                    for ok, i, j in zip(bound >= least, x.tolist(), y.tolist())
                ]
                yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))
        release()

    return rows.mapInArrow(run, "a long, b long")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of pairs whose payloads hold about ``PAIR_BYTES`` bytes."""
    if not batch.num_rows:
        return
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
    marks = np.cumsum(sizes) // PAIR_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def groups(
    buckets: Callable[[], DataFrame],
    payloads: Callable[[DataFrame], DataFrame],
    agree: Callable[[], Likeness],
    ratio: float = 0.0,
    pairwise: int | None = None,
) -> DataFrame:
    """``id`` and ``root`` of all ids that some verified link reaches.

    ``buckets`` gives (``bucket``, ``id``, ``size``) rows from a written table,
    ``payloads`` the ``payload`` of given ids; sizes of linked ids must be within
    ``ratio`` of each other.  Every id is first compared with the smallest id of
    each of its buckets (with a ``ratio`` the one with the least besides what the bucket shares),
    so a group of near copies takes one comparison an id however large it is.
    Then all pairs of a bucket that are still in different components are compared,
    those with ids of the leader's component as well (likeness is not transitive):
    by listed pairs in buckets of up to ``pairwise`` (``PAIRWISE``) ids, block
    against block in larger ones.
    """
    pairwise = pairwise or PAIRWISE
    if ratio:
        spread = F.shiftleft(F.col("size").cast("long"), 24) + F.pmod(F.xxhash64("id"), F.lit(1 << 24))
        least = [F.min_by("id", spread).alias("leader"), F.shiftright(F.min(spread), 24).alias("leader_size")]
    else:
        # Any sizes may be alike, so the leader need not be a short one.
        least = [F.min("id").alias("leader"), F.lit(0).cast("long").alias("leader_size")]
    near = F.least("size", "leader_size") >= ratio * F.greatest("size", "leader_size")
    ends = buckets().groupBy("bucket").agg(*least, F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = sized(stored(ends.drop("n"), "buckets"))
    members = stored(buckets().join(shared, "bucket"), "bucket-members")
    held = stored(payloads(sized(stored(members.select("id").distinct(), "bucket-ids"))), "bucket-payloads")
    star = members.where(near & (F.col("id") != F.col("leader")))
    tried = sized(stored(star.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs"))
    roots = sized(stored(components(verified(tried, held, agree)), "roots"))
    known = members.join(roots, "id", "left").select("bucket", "id", "size", F.coalesce("root", "id").alias("root"))
    # Buckets with ids in several components.
    counts = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    left = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    open_ = stored(known.join(sized(stored(left.drop("roots"), "bucket-left")), "bucket"), "bucket-open")
    listed = open_.where(F.col("n") <= pairwise).groupBy("bucket").agg(
        F.collect_list(F.struct("id", "size", "root")).alias("all")
    )
    pairs = (
        listed.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.size").alias("size"),
                F.col("y.size").alias("leader_size"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))
        .where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near)
    )
    fresh = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = verified(sized(stored(fresh, "pairs")), held, agree)
    large = open_.where(F.col("n") > pairwise)
    if not is_empty(large):
        links = links.unionByName(_blocks(large, held, agree, ratio))
    links = stored(links, "verified")
    return roots if is_empty(links) else sized(stored(_joined(roots, links), "roots"))


def _blocks(large: DataFrame, held: DataFrame, agree: Callable[[], Likeness], ratio: float) -> DataFrame:
    """Links ``a``, ``b`` that join all components of each bucket which have a similar pair.

    Every block of a bucket meets every other and itself in a group of its own,
    which holds two blocks however large the bucket is.  Of the pairs in different
    components those are compared exactly whose profiles allow it, each in the
    first of the large buckets that it shares; pairs that links of the same group
    have joined before are passed over.
    """
    # An id has a bucket per sketch at most.
    shared = F.collect_set("bucket").over(W.partitionBy("id"))
    rows = large.drop("n").withColumn("buckets", shared).join(held, "id")
    parts = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("payload").cast("long")) / BLOCK_BYTES)
    )
    parts = sized(stored(rows.groupBy("bucket").agg(parts.alias("parts")), "bucket-parts"))
    own = rows.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = other.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "id", "size", "root", "buckets", "payload",
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        found = _met(agree(), table, bucket, i, j, ratio)
        ends = [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    return met.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _met(likeness: Likeness, table: pa.Table, bucket: int, i: int, j: int, ratio: float) -> list[tuple[int, int]]:
    """Links between block ``i`` and block ``j`` of a bucket."""
    numbers = {c: table.column(c).to_numpy() for c in ("block", "id", "size", "root")}
    if (numbers["root"] == numbers["root"][0]).all():
        return []
    items = likeness.elements(table.column("payload").to_pylist())
    counts, bins = profiles(items)
    buckets = table.column("buckets").to_pylist()
    size, root = numbers["size"], numbers["root"].copy()
    left = np.flatnonzero(numbers["block"] == i)
    right = left if i == j else np.flatnonzero(numbers["block"] == j)
    # Four bins together of the right side as rows, of a type that holds the sums as well.
    most = counts.max(initial=0)
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
    coarse = bins.reshape(-1, BINS // 4, 4).sum(axis=2, dtype=kind)
    turned = np.ascontiguousarray(coarse[right].T)
    lesser = np.empty_like(turned)
    needed: dict[int, np.ndarray] = {}
    found = []
    for at, a in enumerate(left.tolist()):
        open_ = root[right] != root[a]
        if i == j:
            open_[: at + 1] = False
        if ratio:
            few, many = np.minimum(size[right], size[a]), np.maximum(size[right], size[a])
            open_ &= few >= ratio * many
        places = np.flatnonzero(open_)
        if not len(places):
            continue
        others = right[places]
        size_a = int(counts[a])
        if size_a not in needed:
            needed[size_a] = likeness.needed(size_a, counts[right])
        least = needed[size_a][places]
        if 8 * len(places) >= len(right):
            # Fewer, wider bins bound the shared elements as well, and leave few pairs to the narrow ones.
            np.minimum(turned, coarse[a][:, None], out=lesser)
            near = np.flatnonzero(lesser.sum(axis=0, dtype=kind)[places] >= least)
            others, least = others[near], least[near]
        others = others[_shared(bins[others], bins[a]) >= least]
        own = set(buckets[a]) if len(others) else set()
        for b in others.tolist():
            if root[a] == root[b] or min(own.intersection(buckets[b])) != bucket:
                continue
            if likeness.same(items[a], items[b]):
                found.append((int(numbers["id"][a]), int(numbers["id"][b])))
                root[root == root[b]] = root[a]
    return found


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links: only links between roots are contracted."""
    left = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    between = links.join(left, "a", "left").join(right, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    moved = sized(stored(components(between), "moved"))
    to = moved.select(F.col("id").alias("root"), F.col("root").alias("new"))
    known = roots.join(to, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return known.unionByName(moved.join(roots, "id", "left_anti"))


def identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text hash (``k``, ``t1``, ``t2``) of every row, and its ``text``."""
    return df.select(F.col(f"`{key}`").alias("k"), *_marks(text, "t1", "t2"), F.col(f"`{text}`").alias("text"))


def _marks(text: str, first: str, second: str) -> list[Column]:
    return [F.xxhash64(f"`{text}`").alias(first), F.xxhash64(F.lit(1), f"`{text}`").alias(second)]


def matches(key: str) -> Column:
    """Rows marked ``__t1``, ``__t2`` against a table of ``__k``, ``__w1``, ``__w2``."""
    same_text = (F.col("__t1") == F.col("__w1")) & (F.col("__t2") == F.col("__w2"))
    return F.col(f"`{key}`").eqNullSafe(F.col("__k")) & same_text


def renamed(identities: DataFrame, *more: str) -> DataFrame:
    names = [F.col("k").alias("__k"), F.col("t1").alias("__w1"), F.col("t2").alias("__w2")]
    return identities.select(*names, *more)


def once(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` marked with ``__t1``, ``__t2``, one row of those equal in key and text.

    Only identities that occur several times are shuffled with their rows.
    """
    own = df.select("*", *_marks(text, "__t1", "__t2"))
    repeated = own.groupBy(F.col(f"`{key}`").alias("k"), F.col("__t1").alias("t1"), F.col("__t2").alias("t2")).count()
    repeated = stored(renamed(repeated.where("count > 1")), "repeated-rows")
    if repeated.isEmpty():
        return own
    repeated = sized(repeated)
    several = own.join(repeated, matches(key), "left_semi").dropDuplicates([key, "__t1", "__t2"])
    return own.join(repeated, matches(key), "left_anti").unionByName(several)


def keep_rows(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` with a wanted (``k``, ``t1``, ``t2``), one of each."""
    wanted = sized(stored(renamed(wanted), "kept-rows"))
    return once(df, key, text).join(wanted, matches(key), "left_semi").drop("__t1", "__t2")
