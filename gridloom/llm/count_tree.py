"""Jaccard joins over n-gram sets by count-vector R-trees.

A document's set is its distinct shingles of `width` words (ASCII lower-cased); with fewer words, the whole sequence is one
shingle. Documents without a word (null, empty or blank text) have an empty set and link with nothing. Documents link where
100 * |intersection| >= percent * |union|.

Shingles are hashed into groups, a power of two between once and twice the set's size; a set's counts by group are its point.
Two sets share no more shingles than the coordinate minima of their points add up to. An R-tree over points bounds all that a
node holds at once, by the largest count of each coordinate and the smallest size; points of the next power of two are folded in
half, as sizes that can link differ by less. What a tree lets through is verified on the full sets. Points take two bits a
group; trees with the same members are one.

One tree over all points would not do: random points of hundreds of coordinates lie in boxes that overlap, wherever they are
cut. So points are dealt to many small trees: in one order of all shingles, the rarest first, sets that link share one of their
first |set| - ceil(percent / 100 * |set|) + 1 (any order is exact; frequencies come from a count sketch of a fixed number of
slots over all documents). Each shared shingle names a tree of the sets that have it among their first ones. Boilerplate is
frequent, so it comes last and names few trees.

Equal sets are one point (an aggregate, so a third of all rows may be copies). The most central member of each tree but the
smallest is asked first against the tree; of what these links connect, only trees that still hold several parts are searched
on: the members outside a tree's largest part against all of it. Trees whose members another tree has are left out, so that
copies of one text, which share all their first shingles, are in few trees; trees of more than BLOCK points are searched in
blocks. Links between documents that are connected already are not looked for. Points travel to the blocks, texts only for
pairs that a tree lets through.

A document without an id takes part in no link; its component is null. Rows that repeat an id are one node. Ties go to the
smallest id. An empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import discard, slices, written
from gridloom.llm.components import components
from gridloom.llm.shingles import Shingler, U, copies, equal_sets, grouped, hashed, named, prefix_size

#: Slots of the frequency sketch, and of one of its parts; points of a block and of a leaf; the fewest groups.
SLOTS, SLOT_PART, BLOCK, LEAF, LEAST = 1 << 18, 1 << 12, 512, 8, 8
#: Members from which on a tree's most central one is asked before the others.
LED = 9


def frequencies(docs: DataFrame, width: int, slots: int = SLOTS) -> np.ndarray:
    """How often shingles fall into each slot, over all documents: `slots` numbers, whatever the size of the table."""
    parts = max(1, slots // SLOT_PART)

    def out(total: np.ndarray) -> pa.RecordBatch:
        rows = total.reshape(parts, -1)
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(width), np.zeros(slots, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text", 1 << 20):
                sets = [shingler.set_of(t) for t in texts]
                total += np.bincount((np.concatenate(sets) & U(slots - 1)).astype(np.int64), minlength=slots)
        yield out(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind)
    total = np.zeros((parts, slots // parts), np.int64)
    for row in summed.collect():  # `parts` rows
        total[row["part"]] += np.frombuffer(row["counts"], np.int64)
    return total.reshape(-1)


def can_link(size: int, percent: int) -> bool:
    """Whether a set of that size can link with a different one."""
    return 100 * size >= percent * (size + 1) or 100 * (size - 1) >= percent * size


def first_shingles(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, the rarest first, of which sets that link share one."""
    if not can_link(len(s), percent):
        return np.empty(0, np.int64)
    order = np.lexsort((s, often[(s & U(len(often) - 1)).astype(np.int64)]))
    return s[order[: prefix_size(len(s), percent)]].view(np.int64)


def sketched(docs: DataFrame, width: int, percent: int, often: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, keys) of the columns (doc_id, text); no fingerprint without a word."""
    sent = docs.sparkSession.sparkContext.broadcast(often)  # a fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(width), sent.value
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                sets = [shingler.set_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([first_shingles(s, held, percent) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "fingerprint", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, fingerprint binary, keys array<bigint>")


def point(s: np.ndarray) -> bytes:
    """A set's counts by group, two bits each: counts over 3 are 3, what that loses is known from the set's size."""
    groups = max(LEAST, 1 << (len(s) - 1).bit_length())
    counts = np.minimum(np.bincount((s >> U(20) & U(groups - 1)).astype(np.int64), minlength=groups), 3).astype(np.uint8).reshape(-1, 4)
    return (counts[:, 0] | counts[:, 1] << 2 | counts[:, 2] << 4 | counts[:, 3] << 6).tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    four = np.frombuffer(packed, np.uint8)
    return np.stack([four & 3, four >> 2 & 3, four >> 4 & 3, four >> 6], axis=1).reshape(-1)


def pointed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, size, point, text) of the columns (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                sets = [shingler.set_of(t) for t in texts]
                cols = [pa.array([len(s) for s in sets], pa.int32()), pa.array([point(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, part.column(1)], names=["doc_id", "size", "point", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, size int, point binary, text string")


class Tree:
    """An R-tree over points (rows of counts) with the sizes of their sets, packed by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(points)) if at is None else at
        own, n = points[self.at], sizes[self.at]
        self.high, self.least, self.most = own.max(axis=0), int(n.min()), int(n.max())
        self.lost = int((n - own.sum(axis=1, dtype=np.int64)).max())  # of counts that are too large for a point
        self.below: list[Tree] = []
        if len(self.at) > LEAF:
            low = own.min(axis=0)
            wide = self.most - self.least
            along = n if wide > int((self.high - low).max()) else own[:, int((self.high - low).argmax())]
            order = np.argsort(along, kind="stable")
            half = len(order) // 2
            self.below = [Tree(points, sizes, self.at[part]) for part in (order[:half], order[half:])]

    def search(self, points: np.ndarray, sizes: np.ndarray, asked: np.ndarray, asked_sizes: np.ndarray, which: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked, own) rows whose bound reaches percent."""
        lost = asked_sizes[which] - asked[which].sum(axis=1, dtype=np.int64)
        bound = np.minimum(asked[which], self.high).sum(axis=1, dtype=np.int64) + np.minimum(lost, self.lost)
        bound = np.minimum(bound, np.minimum(asked_sizes[which], self.most))
        which = which[100 * bound >= percent * (asked_sizes[which] + self.least - bound)]
        if not len(which):
            return
        if self.below:
            for child in self.below:
                yield from child.search(points, sizes, asked, asked_sizes, which, percent)
            return
        for own in self.at:
            lost = np.minimum(asked_sizes[which] - asked[which].sum(axis=1, dtype=np.int64), sizes[own] - int(points[own].sum(dtype=np.int64)))
            bound = np.minimum(asked[which], points[own]).sum(axis=1, dtype=np.int64) + lost
            hit = which[100 * bound >= percent * (asked_sizes[which] + sizes[own] - bound)]
            yield hit, np.full(len(hit), own)


def folded(points: np.ndarray) -> np.ndarray:
    """Points in half as many groups."""
    half = points.shape[1] // 2
    return np.minimum(points[:, :half].astype(np.uint16) + points[:, half:], 255).astype(np.uint8)


def bounded_pairs(asked: list[bytes], asked_sizes: np.ndarray, own: list[bytes], own_sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked, own): all pairs whose bound reaches percent, found through trees by the number of groups."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    levels = [np.array([len(p) for p in side]) for side in (asked, own)]
    rows = lambda side, at: np.stack([unpacked(side[i]) for i in at])
    for width in np.unique(np.concatenate(levels)):
        q, q2 = (np.flatnonzero(levels[0] == w) for w in (width, 2 * width))
        o, o2 = (np.flatnonzero(levels[1] == w) for w in (width, 2 * width))
        for a, b, fold_a, fold_b in ((q, o, False, False), (q, o2, False, True), (q2, o, True, False)):
            if not len(a) or not len(b):
                continue
            pa_, pb = rows(asked, a), rows(own, b)
            pa_, pb = folded(pa_) if fold_a else pa_, folded(pb) if fold_b else pb
            tree = Tree(pb, own_sizes[b])
            found += [(a[i], b[j]) for i, j in tree.search(pb, own_sizes[b], pa_, asked_sizes[a], np.arange(len(a)), percent)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def searched(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that a tree lets through, of rows (block, side, doc_id, part, size, point).

    Those of side 0 are asked against the tree of side 1. Of a block whose rows have no side, all are in the tree, and those that are
    not of its largest part are asked. Members of one part are not paired."""
    dealt = rows.select("block", "side", "doc_id", "part", "size", "point").repartition("block").sortWithinPartitions("block")

    def pairs(sides: list[int | None], ids: list[int], parts: list[int], sizes: list[int], points: list[bytes]) -> Iterator[pa.RecordBatch]:
        size, part, ident = np.array(sizes, np.int64), np.array(parts, np.int64), np.array(ids, np.int64)
        if sides and sides[0] is None:
            names, at, counts = np.unique(part, return_inverse=True, return_counts=True)
            a, b = np.flatnonzero(at != counts.argmax()), np.arange(len(ids))
        else:
            side = np.array(sides, np.int64)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return
        i, j = bounded_pairs([points[k] for k in a], size[a], [points[k] for k in b], size[b], percent)
        i, j = a[i], b[j]
        keep = (part[i] != part[j]) & (ident[i] != ident[j])
        i, j = ident[i[keep]], ident[j[keep]]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        held: list[list] = [[] for _ in range(5)]
        for batch in batches:
            for part, points in slices(batch, "point"):
                cols = [part.column(k).to_pylist() for k in range(5)]
                for block, *row in zip(*cols, points, strict=True):
                    if block != now:
                        yield from pairs(*held)
                        now, held = block, [[] for _ in range(5)]
                    for c, v in zip(held, row, strict=True):
                        c.append(v)
        yield from pairs(*held)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def verified(pairs: DataFrame, points: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by their full sets."""
    texts = points.select("doc_id", "text")
    # both sides are tables, so that joins are free to split an id that many pairs have
    both = written(pairs.distinct()).join(texts.withColumnsRenamed({"doc_id": "u", "text": "a"}), "u").join(texts.withColumnsRenamed({"doc_id": "v", "text": "b"}), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        last: tuple[object, np.ndarray] = (None, np.empty(0, U))
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if v != last[0]:
                    last = v, shingler.set_of(b.as_py())
                x, y = shingler.set_of(a.as_py()), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def led_pairs(met: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of a tree's most central member (the one with the most company in all its trees) and the others."""
    degrees = met.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    chosen = F.max_by(F.struct("doc_id", "size"), F.struct("degree", -F.col("doc_id")))
    leaders = written(met.join(degrees, "doc_id").groupBy("key").agg(chosen.alias("lead")).select("key", F.col("lead.doc_id").alias("lead"), F.col("lead.size").alias("lead_size")))
    fits = (100 * F.least("size", "lead_size") >= percent * F.greatest("size", "lead_size")) & (F.col("doc_id") != F.col("lead"))
    asked = written(met.join(leaders, "key").where(fits).select("doc_id", "lead").distinct())
    chunks = written(asked.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")))
    placed = asked.join(chunks, "lead").withColumn("chunk", F.floor(hashed("doc_id", 1) * F.col("chunks")).cast("int"))
    points = points.select("doc_id", "size", "point")
    own = placed.join(points, "doc_id").select(named("lead", "chunk").alias("block"), F.lit(1).alias("side"), "doc_id", F.col("doc_id").alias("part"), "size", "point")
    lead = copies(chunks.withColumnRenamed("lead", "doc_id").join(points, "doc_id"), "chunks", "chunk")
    lead = lead.select(named("doc_id", "chunk").alias("block"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("part"), "size", "point")
    return searched(own.unionByName(lead), percent)


def distinct_trees(member: DataFrame) -> DataFrame:
    """(key, doc_id, size, n) of (key, pos, doc_id, size): the members of the trees that have several, without the trees whose members
    are all in one other.

    If all members of a tree have the same shared shingle before its own in their order, the tree of that one has them all."""
    trees = written(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = member.join(trees, "key")
    before = F.lag("key").over(Window.partitionBy("doc_id").orderBy("pos")).alias("before")  # of a prefix's shingles
    met = written(met.select("key", "doc_id", "size", "n", before))
    inside = (F.count("before") == F.max("n")) & (F.min("before") == F.max("before"))
    kept = written(met.groupBy("key").agg(F.coalesce(inside, F.lit(False)).alias("inside")).where("NOT inside").select("key"))
    return met.join(kept, "key").select("key", "doc_id", "size", "n")


def small_trees(full: DataFrame, points: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs in trees (key, doc_id, part) of one block at most: trees of the same members are one block."""
    listed = F.sort_array(F.collect_list("doc_id")).alias("members")
    sets = full.groupBy("key").agg(listed, F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("members").distinct()
    numbered = written(sets.withColumn("block", F.monotonically_increasing_id()))
    each = numbered.select(F.col("block").cast("string").alias("block"), F.explode("members").alias("doc_id"))
    ready = each.join(points.select("doc_id", "size", "point"), "doc_id").join(parts, "doc_id", "left")
    return searched(ready.select("block", F.lit(None).cast("int").alias("side"), "doc_id", F.coalesce("part", "doc_id").alias("part"), "size", "point"), percent)


def large_trees(full: DataFrame, points: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs in trees (key, doc_id, part) of any size: what is not in a tree's largest part, asked against all of it, block by block."""
    sizes = full.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    of_tree = sizes.groupBy("key").agg(F.max_by("part", F.struct("size", -F.col("part"))).alias("main"), F.max("size").alias("most"), F.sum("size").alias("n"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    trees = written(of_tree.where("most < n").select("key", "main", blocks(F.col("n")).alias("chunks"), blocks(F.col("n") - F.col("most")).alias("rests")))
    placed = written(full.join(trees, "key").select("key", "doc_id", "part", (F.col("part") != F.col("main")).alias("apart"), "chunks", "rests"))
    ready = placed.join(points.select("doc_id", "size", "point"), "doc_id")
    name = named(F.col("key").cast("string"), "rest", "chunk").alias("block")
    asked = ready.where("apart").withColumn("rest", F.floor(hashed("doc_id", 3) * F.col("rests")).cast("int"))
    asked = copies(asked, "chunks", "chunk").select(name, F.lit(0).alias("side"), "doc_id", "part", "size", "point")
    against = copies(ready.withColumn("chunk", F.floor(hashed("doc_id", 1) * F.col("chunks")).cast("int")), "rests", "rest")
    against = against.select(name, F.lit(1).alias("side"), "doc_id", "part", "size", "point")
    return searched(asked.unionByName(against), percent)


def open_pairs(met: DataFrame, parts: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of different parts (doc_id, part) in the trees (key, doc_id, n) that hold several."""
    full = written(met.join(parts, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("part", "doc_id").alias("part")))
    found = small_trees(full.where(F.col("n") <= BLOCK), points, parts, percent)
    return found.unionByName(large_trees(full.where(F.col("n") > BLOCK).drop("n"), points, percent, BLOCK))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, slots: int = SLOTS) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest id that links reach) and kept (it is that one)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(sketched(docs, width, percent, frequencies(docs, width, slots)))
    owned = equal_sets(rows)
    sets = rows.where("fingerprint is not null and doc_id is not null").join(owned.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    member = sets.select("doc_id", F.col("n_shingles").cast("int").alias("size"), F.posexplode("keys").alias("pos", "key"))
    met = written(distinct_trees(member))
    points = written(pointed(met.select("doc_id").distinct().hint("merge").join(docs, "doc_id"), width))
    first = written(verified(led_pairs(met.where(F.col("n") >= LED), points, percent), points, width, percent))
    parts = written(components(first).select(F.col("node").alias("doc_id"), F.col("root").alias("part")))
    second = written(verified(open_pairs(met, parts, points, percent), points, width, percent))
    discard(points)
    return grouped(rows, owned, first.unionByName(second))
