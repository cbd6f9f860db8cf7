"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Shingles are hashed into groups, and a document's counts by group are a point.
The overlap of two documents is at most the sum of the smaller coordinates, so
pairs whose points are too far apart need no look at the shingles. Points lie
in R-trees, whose boxes bound all points below them in the same way. What
survives is verified on the whole shingle sets.

With this many coordinates a single tree over a corpus prunes little above its
leaves, so trees are built over blocks that can't separate a pair: two sets of
at least 80 % similarity, each put in one and the same order, share one of
their first n - ceil(0.8 n) + 1 shingles. There is a block for each shingle
that is such a first one of several sets, for one of them among the first
n - ceil(8 n / 9) + 1, as it is for the smaller set of a similar pair. The
order has common shingles last (any order is right), so that a passage of many
documents makes no large blocks; blocks are cut by the sizes of the sets.

Equal sets are one class from the start. A first round links documents to a
central one of a few of their blocks, so groups of copies cost a comparison
per copy; the second round takes all pairs of different components in all
blocks. The links of each document are counted in a third pass over all pairs
inside the components, which keeps sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, wide
from .text import Words, text_slices

SHINGLE = 5
#: Similarity of at least SHARE percent links: SHARE * union <= 100 * intersection.
SHARE = 80
#: Groups of the points in the trees, and of the finer points by which pairs are bounded that the trees leave (powers of two).
GROUPS, FINE = 256, 4096
#: Blocks of a document that the first round looks at, and central documents tried in each.
FIRST_BLOCKS, CENTERS = 4, 24
#: A shingle is common from this sum of its repetitions within ``CHUNK`` shingles on; so many at most are known to be (12 bytes each, sent to all tasks).
COMMON, MOST_COMMON, CHUNK = 32, 1 << 18, 1 << 20
#: Points per leaf and children per node of a tree.
LEAF, FAN = 32, 16
#: Factor of a size class: a set is compared with those of its class and the next, so it must be more than 1.25.
SIZE_CLASS = 1.26
#: A pair that meets in several blocks is taken in one, if these many smallest block keys of both have one in common.
LEAST_KEYS = 6
#: Members of a block that one task compares with each other; what is larger is compared tile by tile.
TILE = 4096
#: Sets, and shingles in them, of a component that one task compares with as many others when links are counted.
LINK_TILE, LINK_SHINGLES = 2048, 1 << 21
#: Pairs, and rows of blocks, looked at at once.
PAIRS, ROWS = 1024, 1024
#: Up to so many ids (8 bytes each) are sent to all tasks to pick their texts; more are joined.
SENT_IDS = 1 << 20
SIGNATURE = "doc_id long, text_hash long, n_shingles long, fp binary, firsts array<long>, point binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The ascending distinct 64-bit shingle values of each text of a slice.

    A text of fewer than five words is one shingle; one without words has none.
    """
    import xxhash

    words = Words(column, lower_ascii=True)
    values = np.array([xxhash.xxh3_64_intdigest(x) for x in words.vocabulary] or [0], np.uint64)
    w = values[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            rolled = _mix(rolled + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1) + w[k : k + len(rolled)])
        for a, b in zip(words.offsets[:-1], words.offsets[1:]):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                short = np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=int(b - a))], np.uint64)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def first_count(n: int) -> int:
    """How many first shingles a set of n needs to share one with each similar set."""
    return n - -(-SHARE * n // 100) + 1


def first_shingles(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Those of which sets of at least 80 % similarity share one: the first ones in the order of (rank, value).

    common: ascending values of common shingles; rank: theirs, all others have
    0; seen: a bitmap of common values by their last bits.
    """
    n = len(shingles)
    most = first_count(n)
    maybe = np.flatnonzero(seen[shingles & np.uint64(len(seen) - 1)])
    if not len(maybe):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles[maybe]), len(common) - 1)
    own = np.zeros(n, rank.dtype)
    own[maybe] = np.where(common[at] == shingles[maybe], rank[at], 0)
    return shingles[np.argsort(own, kind="stable")[:most]]


def common_shingles(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(values in ascending order, rank) of the commonest shingles of all texts; rank is the binary logarithm of the count.

    Counted are repetitions within ``CHUNK`` shingles of a task, so all but
    rare ones meet in the sums. Whole ranks are taken, from the highest down,
    as long as they have no more than ``MOST_COMMON`` shingles together: so
    many at most reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["s", "n"])

        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                for shingles in shingle_sets(part):
                    held.append(shingles)
                    size += len(shingles)
                    if size > CHUNK:
                        yield repeated()
                        held, size = [], 0
        if held:
            yield repeated()

    found = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    ranked = scratch.table(found.select("s", F.floor(F.log2("n")).cast("int").alias("rank")), "common")
    least, total = 64, 0
    for rank, n in sorted(map(tuple, ranked.groupBy("rank").count().collect()), reverse=True):
        total += n
        if total > MOST_COMMON:
            break
        least = rank
    rows = ranked.where(F.col("rank") >= least).toPandas()
    scratch.remove("common")
    value = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], rows["rank"].to_numpy(np.uint8)[order]


def point(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed(shingles: np.ndarray) -> bytes:
    """The counts of an ascending set in ``FINE`` groups, which are its first bits.

    Either the steps between the groups of its shingles, in bytes (255 goes
    on), or the counts themselves; nothing if one is over 255, which bounds
    nothing.
    """
    group = (shingles >> np.uint64(65 - FINE.bit_length())).astype(np.int64)
    if len(group) < FINE // 2:
        step = np.diff(group, prepend=0)
        more = step // 255
        out = np.full(len(step) + int(more.sum()), 255, np.uint8)
        out[np.cumsum(more + 1) - 1] = step % 255
        return b"s" + out.tobytes()
    counts = np.bincount(group, minlength=FINE)
    return b"" if counts.max() > 255 else b"c" + counts.astype(np.uint8).tobytes()


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts in ``FINE`` groups, which rows have them)."""
    out, known = np.zeros((len(data), FINE), np.uint8), np.array([bool(x) for x in data], bool)
    for i, x in enumerate(data):
        raw = np.frombuffer(x, np.uint8)[1:]
        if x[:1] == b"s":
            out[i] = np.bincount(np.cumsum(raw, dtype=np.int64)[raw < 255], minlength=FINE)
        elif x:
            out[i] = raw
    return out, known


def signatures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: doc_id, text."""
    common, rank = common_shingles(docs, scratch)
    seen = np.zeros(1 << max(16, min(24, len(common).bit_length() + 4)), bool)
    seen[common & np.uint64(len(seen) - 1)] = True
    sent = docs.sparkSession.sparkContext.broadcast((common, rank, np.packbits(seen)))
    names = [x.split()[0] for x in SIGNATURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, bits = sent.value
        order = common, rank, np.unpackbits(bits).astype(bool)
        for batch in batches:
            for at, part in text_slices(batch.column(2)):
                own = batch.slice(at, len(part))
                n, fp, firsts, points = [], [], [], []
                for s in shingle_sets(part):
                    n.append(len(s))
                    fp.append(fingerprint(s) if len(s) else None)
                    firsts.append(first_shingles(s, *order).view(np.int64) if len(s) else None)
                    points.append(packed(s) if len(s) else None)
                columns = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(points, pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *columns], names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


class Points:
    """Rows to compare: ids, sizes, points, components; with finer points also these and which rows have them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, points: np.ndarray, components: np.ndarray, fine: np.ndarray | None = None, known: np.ndarray | None = None):
        self.ids, self.sizes, self.points, self.components, self.fine, self.known = ids, sizes, points, components, fine, known

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray, data: list[bytes], components: np.ndarray) -> Points:
        fine, known = unpacked(data)
        points = fine.reshape(len(fine), GROUPS, FINE // GROUPS).sum(axis=2, dtype=np.int32)
        points[~known] = np.iinfo(np.int32).max // GROUPS
        return cls(ids, sizes, points, components, fine, known)

    def part(self, rows: slice) -> Points:
        return Points(*(None if x is None else x[rows] for x in (self.ids, self.sizes, self.points, self.components, self.fine, self.known)))

    @staticmethod
    def joined(parts: list[Points]) -> Points:
        names = ("ids", "sizes", "points", "components", "fine", "known")
        return parts[0] if len(parts) == 1 else Points(*(np.concatenate([getattr(p, n) for p in parts]) for n in names))

    def enough(self, most: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether an overlap of ``most`` would do for rows a and b."""
        n = self.sizes[a] + self.sizes[b]
        return (100 + SHARE) * np.minimum(most, np.minimum(self.sizes[a], self.sizes[b])) >= SHARE * n

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows may overlap enough."""
        ok = self.enough(np.minimum(self.points[a], self.points[b]).sum(axis=1), a, b)
        if self.fine is not None:
            left = np.flatnonzero(ok & self.known[a] & self.known[b])
            for k in range(0, len(left), PAIRS):
                own = left[k : k + PAIRS]
                ok[own] = self.enough(np.minimum(self.fine[a[own]], self.fine[b[own]]).sum(axis=1, dtype=np.int64), a[own], b[own])
        return ok


class CountTree:
    """An R-tree over points, packed from rows sorted by size and then by the widest coordinates.

    Nodes keep the upper corner of their box, the range of sizes, and the
    component if all rows below share one.
    """

    def __init__(self, rows: Points):
        self.rows = rows
        wide = np.argsort(-rows.points.std(axis=0))[:2]
        tall = max(1, int(np.sqrt(len(rows.ids) / LEAF)))
        slab = np.argsort(np.argsort(rows.sizes, kind="stable"), kind="stable") * tall // max(1, len(rows.ids))
        self.order = np.lexsort((rows.points[:, wide[1]], rows.points[:, wide[0]], slab))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        p, s, c = rows.points[self.order], rows.sizes[self.order], rows.components[self.order]
        upper, low, high, same, step = p, s, s, c, LEAF
        while True:
            cuts = np.arange(0, len(low), step)
            first, last = np.minimum.reduceat(same, cuts), np.maximum.reduceat(same, cuts)
            mixed = np.minimum.reduceat(same, cuts) == _MIXED
            upper, low, high = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            same = np.where((first == last) & ~mixed, first, _MIXED)
            self.levels.append((upper, low, high, same))
            if len(cuts) <= FAN:
                break
            step = FAN

    def search(self, i: int) -> np.ndarray:
        """Rows of other components whose overlap with row i may be large enough."""
        r = self.rows
        q, n, own = r.points[i], r.sizes[i], r.components[i]
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high, same = (x[nodes] for x in self.levels[depth])
            most = np.minimum(np.minimum(upper, q).sum(axis=1), np.minimum(high, n))
            nodes = nodes[((100 + SHARE) * most >= SHARE * (n + np.maximum(low, SHARE * n // 100))) & (same != own)]
            fan = LEAF if depth == 0 else FAN
            total = len(self.order) if depth == 0 else len(self.levels[depth - 1][1])
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < total]
        rows = self.order[nodes]
        rows = rows[r.components[rows] != own]
        return rows[r.near(np.full(len(rows), i), rows)] if len(rows) else rows


_MIXED = np.iinfo(np.int64).min


def _central_links(rows: Points) -> list[np.ndarray]:
    """Pairs (row numbers) of each row with a central one near enough, for a few central rows."""
    left, out = np.arange(len(rows.ids)), []
    for _ in range(CENTERS):
        if len(left) < 2:
            break
        mean = rows.points[left].mean(axis=0)
        center = int(left[np.argmin(np.abs(rows.points[left] - mean).sum(axis=1))])
        others = left[left != center]
        near = others[rows.near(np.full(len(others), center), others)]
        out.append(np.stack([np.full(len(near), center), near]))
        left = np.setdiff1d(others, near, assume_unique=True)
    return out


def _cross_pairs(rows: Points) -> list[np.ndarray]:
    """All pairs (row numbers) of rows of different components that are near enough."""
    tree, out = CountTree(rows), []
    for i in range(len(rows.ids)):
        near = tree.search(i)
        near = near[near > i]
        if len(near):
            out.append(np.stack([np.full(len(near), i), near]))
    return out


def _leaf_links(rows: Points, block: np.ndarray) -> list[np.ndarray]:
    """``_central_links`` of many blocks that fit a leaf each, ``block`` being that of each row (ascending, -1: none)."""
    left, out = np.flatnonzero(block >= 0), []
    while len(left):
        first = np.append(True, block[left][1:] != block[left][:-1])
        center = left[first][np.cumsum(first) - 1]
        a, b = center[~first], left[~first]
        near = np.concatenate([rows.near(a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]) if len(a) else np.zeros(0, bool)
        out.append(np.stack([a[near], b[near]]))
        left = b[~near]
    return out


def _leaf_pairs(rows: Points, firsts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``_cross_pairs`` of many blocks that fit a leaf each, at (firsts, sizes)."""
    out = []
    for size in np.unique(sizes):
        a, b = np.triu_indices(int(size), 1)
        at = firsts[sizes == size]
        step = max(1, PAIRS // len(a))
        for k in range(0, len(at), step):
            x, y = ((at[k : k + step, None] + own).ravel() for own in (a, b))
            other = rows.components[x] != rows.components[y]
            x, y = x[other], y[other]
            near = rows.near(x, y)
            out.append(np.stack([x[near], y[near]]))
    return out


BLOCK_ROWS = ["key", "id", "n", "point", "component", "block", "least"]


def _block_pairs(blocks: DataFrame, exact: bool) -> DataFrame:
    """(a, b), a < b, from rows of ``BLOCK_ROWS``, those of a key in one task and sorted by it.

    ``block`` and ``least`` are the row's block and the smallest of all its
    blocks: with ``exact`` a pair is left to the first block that is one of
    the smallest of both, if there is one.
    """

    def solve(keys: np.ndarray, block: np.ndarray, least: np.ndarray, rows: Points) -> pa.RecordBatch:
        """Pairs of whole blocks."""
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(firsts, len(keys)))
        small = (sizes > 1) & (sizes <= LEAF)
        number = np.repeat(np.where(small, np.arange(len(sizes)), -1), sizes)
        found = _leaf_pairs(rows, firsts[small], sizes[small]) if exact else _leaf_links(rows, number)
        for a, n in zip(firsts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
            part = rows.part(slice(a, a + n))
            found += [x + a for x in (_cross_pairs(part) if exact else _central_links(part))]
        a, b = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1).astype(np.int64)
        if exact and len(a):
            none = np.iinfo(np.int64).max
            first = np.concatenate([_first_common(least[a[k : k + PAIRS]], least[b[k : k + PAIRS]], none) for k in range(0, len(a), PAIRS)])
            own = (first == none) | (first == block[a])
            a, b = a[own], b[own]
        a, b = rows.ids[a], rows.ids[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = (np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)) & (a != b)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the last block, which may go on

        def joined() -> tuple:
            return *(np.concatenate([x[k] for x in held]) for k in range(3)), Points.joined([x[3] for x in held])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                key, ids, n, _, component, block = (part.column(k).to_numpy() if k != 3 else None for k in range(6))
                least = np.stack(part.column(6).to_numpy(zero_copy_only=False)) if exact else np.zeros((len(key), 1), np.int64)
                rows = Points.of(ids, n, part.column(3).to_pylist(), component)
                last = int(np.searchsorted(key, key[-1], "left"))  # where the last block begins
                if last or held and held[0][0][0] != key[0]:
                    held.append((key[:last], block[:last], least[:last], rows.part(slice(0, last))))
                    yield solve(*joined())
                    held = []
                held.append((key[last:], block[last:], least[last:], rows.part(slice(last, None))))
        if held:
            yield solve(*joined())

    return blocks.mapInArrow(run, "a long, b long")


def _first_common(x: np.ndarray, y: np.ndarray, none: int) -> np.ndarray:
    """The smallest value that rows of both have in common."""
    both = (x[:, :, None] == y[:, None, :]).any(axis=2)
    return np.where(both, x, none).min(axis=1)


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose points allow enough overlap. points: id, n, point."""
    side = lambda c: points.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                m = part.num_rows
                sizes = np.concatenate([part.column(k).to_numpy() for k in (2, 3)])
                rows = Points.of(np.arange(2 * m), sizes, part.column(4).to_pylist() + part.column(5).to_pylist(), np.arange(2 * m))
                yield part.select(["a", "b"]).filter(pa.array(rows.near(np.arange(m), np.arange(m) + m)))

    return both.mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = scratch.table(ids.join(classes.select("id", "fp", "doc_id", "text_hash"), "id"), f"{name}-ids")
    wanted = F.broadcast(ids) if ids.count() <= SENT_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_slices(batch.column(1)):
                own = batch.slice(at, len(part))
                found = [(i, s.tobytes()) for i, f, s in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), shingle_sets(part)) if fingerprint(s) == f]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["id", "s"])

    same = (docs["doc_id"].eqNullSafe(wanted["doc_id"])) & (docs["text_hash"] == wanted["text_hash"])
    texts = docs.join(wanted, same).select(wanted["id"], "text", "fp")
    table = scratch.table(texts.mapInArrow(sets, "id long, s binary"), f"{name}-sets").dropDuplicates(["id"])
    both = pairs.join(table.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(table.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id reachable, for all ids in links (a, b).

    Rounds of large-star and small-star: each id links its larger neighbours,
    then all its smaller ones, to the smallest of them, until nothing changes.
    Each round is written to the shared folder.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        turn += 1
        edges = scratch.table(small, f"{name}-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
        if turn > 1:
            scratch.remove(f"{name}-{turn - 2}")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def _link_counts(sets: DataFrame, found: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, linked): the rows of all classes that link with each class of a component, from all pairs of its classes.

    sets: id, s; found: id, component; copies: id, copies. Components are cut
    into tiles, and each pair of tiles is compared in one task.
    """
    rows = sets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(copies, "id")
    large = F.greatest(F.count(F.lit(1)) / LINK_TILE, F.sum(F.octet_length("s")) / (8 * LINK_SHINGLES))
    shared = rows.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.ceil(large).cast("int").alias("tiles")).where("m > 1").drop("m")
    rows = rows.join(shared, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "own").alias("i"), F.greatest(t, "own").alias("j")))
    tiled = rows.withColumn("t", F.explode(tiles)).select("component", "t.i", "t.j", "own", "id", "s", "copies")

    def count(block: pa.Table) -> pa.Table:
        n_rows = block.num_rows
        own, copies = block["own"].to_numpy(), block["copies"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["s"]]
        sizes = np.array([len(x) for x in sets])
        # inside a tile all rows are compared, else those of one tile with those of the other
        groups = np.arange(n_rows) if block["i"][0].as_py() == block["j"][0].as_py() else own.astype(np.int64)
        tree = CountTree(Points(np.arange(n_rows), sizes, np.stack([point(x) for x in sets]), groups))
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(numbers, np.cumsum(sizes)[:-1])
        inside, linked = np.zeros(len(values), np.int64), np.zeros(n_rows, np.int64)
        for i in range(n_rows):
            near = tree.search(i)
            near = near[near > i]
            if len(near):
                inside[sets[i]] = 1
                starts = np.cumsum(sizes[near]) - sizes[near]
                both = np.add.reduceat(inside[np.concatenate([sets[j] for j in near])], starts)
                inside[sets[i]] = 0
                near = near[100 * both >= SHARE * (sizes[near] + sizes[i] - both)]
                linked[i] += copies[near].sum()
                linked[near] += copies[i]
        return pa.table({"id": block["id"], "linked": pa.array(linked)})

    return tiled.groupBy("component", "i", "j").applyInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def _classes(docs: DataFrame, scratch: Scratch, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """(signatures of the rows, what is known of each class of equal sets: fp, component_id, component, first, n_links).

    ``component`` numbers the component; ``first`` is (no id, doc_id,
    text_hash) of the row with its smallest id. Docs: doc_id, text.
    """
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = scratch.table(signatures(docs, scratch), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    facts = [F.first(c).alias(c) for c in ("n_shingles", "firsts", "point")]
    classes = signed.where("n_shingles > 0").groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), *facts)
    # the number of a class is that of its row in the written table
    classes = scratch.table(classes.select("fp", "first", "first.doc_id", "first.text_hash", "copies", F.col("n_shingles").alias("n"), "firsts", "point", F.monotonically_increasing_id().alias("id")), "classes")
    signed = scratch.table(signed.select("doc_id", "text_hash", "n_shingles", "fp"), "rows")
    scratch.remove("signatures")
    # in a similar pair the smaller set has a shared first shingle early on
    early = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * SHARE) * F.col("n") / F.lit(100 + SHARE))
    members = classes.select("id", "n", F.posexplode("firsts").alias("pos", "key")).select("id", "n", "key", early.alias("early"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("early").alias("early")).where("size > 1 and early").drop("early")
    members = scratch.table(members.drop("early").join(shared, "key"), "members")
    classes = scratch.table(classes.drop("firsts"), "kept")
    scratch.remove("classes")
    points = classes.select("id", "n", "point")

    def blocks(rows: DataFrame) -> DataFrame:
        rows = rows.join(points.drop("n"), "id")
        return rows.repartition(*wide(rows), "key").sortWithinPartitions("key").select(*BLOCK_ROWS)

    # the first round: the blocks whose hashes are smallest, which copies have in common, in parts of at most a tile or so
    part = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("size") / TILE))
    chosen = members.groupBy("id", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "key", "size"))), 1, FIRST_BLOCKS).alias("b"))
    chosen = chosen.select("id", "n", F.explode("b").alias("b")).select("id", "n", "b.key", "b.size")
    unused = {"component": F.col("id"), "block": F.col("key"), "least": F.lit(None).cast("array<long>")}
    first = blocks(chosen.withColumns(unused).withColumn("key", F.xxhash64("key", part)))
    tried = scratch.table(_block_pairs(first, exact=False).distinct(), "first")
    links = scratch.table(_verified(tried, own, classes, scratch, "first"), "first-links")
    scratch.remove("first-ids")
    found = components(links, scratch, "first-components")

    # the second: all pairs of different components, first those that are blocks of their own
    rows = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    facts = [f(c).alias(f"{n}_{c}") for c in ("component", "n", "id") for n, f in (("lo", F.min), ("hi", F.max))]
    mixed = scratch.table(rows.groupBy("key").agg(F.first("size").alias("size"), *facts).where("lo_component < hi_component"), "mixed")
    two = mixed.where((F.col("size") == 2) & (100 * F.col("lo_n") >= SHARE * F.col("hi_n"))).select(F.col("lo_id").alias("a"), F.col("hi_id").alias("b")).distinct()
    # larger ones by size class: a cell has the sets of a class and of the next
    level = F.floor(F.log("n") / F.log(F.lit(SIZE_CLASS))).cast("int")
    rows = rows.where("size > 2").join(mixed.where("size > 2").select("key"), "key", "left_semi").withColumn("level", level)
    rows = rows.withColumn("cell", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    cells = rows.groupBy("key", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("level") == F.col("cell")).alias("own"), F.count(F.lit(1)).alias("m"))
    cells = cells.where("lo < hi and own").select("key", "cell", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    rows = scratch.table(rows.join(cells, ["key", "cell"]).select("key", "cell", "tiles", "id", "n", "component"), "cells")
    least = rows.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    least = least.select("id", F.transform(F.sequence(F.lit(0), F.lit(LEAST_KEYS - 1)), lambda i: F.coalesce(F.get("keys", i), F.get("keys", F.lit(0)))).alias("least"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "own").alias("i"), F.greatest(t, "own").alias("j")))
    tiled = rows.withColumn("t", F.explode(tiles)).select(F.xxhash64("key", "cell", "t.i", "t.j").alias("tile"), "id", "n", "component", F.col("key").alias("block"))
    more = _block_pairs(blocks(tiled.withColumnRenamed("tile", "key").join(least, "id")), exact=True)
    pairs = _bounded(two.join(tried, ["a", "b"], "left_anti"), points).unionByName(more.distinct().join(tried, ["a", "b"], "left_anti"))
    pairs = scratch.table(pairs.distinct(), "second")
    scratch.remove("members", "mixed", "cells", "first")
    named = ["first-sets"]
    if not pairs.isEmpty():
        links = links.unionByName(scratch.table(_verified(pairs, own, classes, scratch, "second"), "second-links"))
        found = components(links, scratch, "second-components")
        named.append("second-sets")
    known = classes.select("id", "fp", "first", "copies").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = known.drop("first").join(least, "component").withColumn("component_id", F.col("least.doc_id"))
    if count_links:
        sets = scratch.spark.read.schema("id long, s binary").parquet(*map(scratch.path, named)).dropDuplicates(["id"])
        linked = scratch.table(_link_counts(sets, found, classes.select("id", "copies")), "linked")
        known = known.join(linked, "id", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).drop("linked")
    known = scratch.table(known.drop("id", "copies"), "known")
    scratch.remove("kept", "first-sets", "second-ids", "second-sets", "linked")
    return signed, known


def similar_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and with ``count_links`` n_links.

    Documents link when the Jaccard similarity of their shingle sets is at
    least 0.8; ``component_id`` is the smallest doc_id reachable, itself
    included, and ``n_links`` the number of other rows that the row links
    with, copies included. Null texts and texts without words have no shingles
    and are alone. Rows are told apart by their texts, not by their ids: rows
    of one id and different texts link only if their texts do. A null id links
    like any other and is never the smallest, so ``component_id`` is null only
    where no row reached has an id. An empty table gives no rows; other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, known = _classes(own, scratch, count_links)
    out = signed.select("doc_id", "n_shingles", "fp").join(known, "fp", "left")
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *n_links)


def first_of_similar(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, but of similar ones only the one with the smallest id.

    Of rows with that id and the same text one stays. Rows without shingles
    are similar to nothing and all stay, and so do rows with a null id if
    nothing similar has an id (one of them).
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, known = _classes(own, scratch, False)
    chosen = known.select(F.col("least.doc_id").alias("_i"), F.col("least.text_hash").alias("_h")).distinct()
    alone = signed.where("n_shingles = 0").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    wanted = scratch.table(chosen.withColumn("_one", F.lit(True)).unionByName(alone.withColumn("_one", F.lit(False))), "wanted")
    hashed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_text": F.xxhash64(text_col)})
    rows = hashed.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_h")))
    rows = rows.withColumn("_copy", F.when(F.col("_one"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["_id", "_text", "_copy"]).select(*[F.col(f"`{c}`") for c in docs.columns])
