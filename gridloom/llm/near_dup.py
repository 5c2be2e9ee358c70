"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find.

A document's set is its distinct shingles of `width` words (ASCII lower-cased); with fewer words, the whole sequence is
one shingle. Documents without a word (null, empty or blank text) have no set and are linked with nothing. Documents link
where 100 * |intersection| >= percent * |union| of the full sets; groups are the connected components of the links.

Steps: one pass makes each document's set size, fingerprint and band keys. Equal sets fall together by their fingerprint
(an aggregate, so a third of all rows may be copies). Set representatives that share a band key form candidate
components, by ids alone. A component of a block's size is compared by one exact matrix product of its full sets. Larger
ones are cut into blocks that share some pivots (random members and the most central ones); what a component's largest
part has not reached by then is looked for by prefixes: with the shingles of a component in one order, the rarest first,
two sets that link share one of the first few of each, so only members that share such a shingle are looked at. These send
points, not texts: counts of shingles by group, whose coordinate minima bound what two sets share (`count_tree`), in blocks of
POINTS; only pairs whose bound reaches the similarity are compared by their texts. Pages of one template, with words or
paragraphs of their own, are not compared again: texts sent grow in proportion to documents.
A block of texts returns a spanning forest of its links.

A document without an id takes part in no group: its component is null and it is kept. Rows that repeat an id are one
node. Ties go to the smallest id. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import count_tree
from gridloom.llm.base import discard, slices, written
from gridloom.llm.components import components, roots
from gridloom.llm.shingles import Shingler, U, copies, equal_sets, grouped, hashed, mixed, named, prefix_size

BANDS, ROWS = 24, 6
#: Members of a block; random pivots that a component of several blocks is expected to have; its central ones at most.
BLOCK, PIVOTS, CENTRAL = 224, 24, 16
#: Shingles of a block's members together, as far as single members let that be; columns of a slice of a product.
SHINGLES, WIDE = 1 << 22, 4096
#: Points of a block in which members that are still apart are looked through.
POINTS = 1024
#: Sets with fewer shingles take many levels of ranks.
FEW, BATCH = 16, 8192


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m floats for each (non-empty) set.

    Each element deals the ranks 0, 1, 2, ... to slots in the order of a random permutation of its own, and puts
    rank + fraction there if that is smaller. The ranks are dealt level by level over all elements at once; a set is done
    when every slot holds less than the next rank. A set of few elements takes many levels: its permutations are held as
    arrays; of others the few swaps so far are looked through.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    few = lengths < FEW
    if few.any() and not few.all():
        out = np.empty((len(sets), m))
        for part in (few, ~few):
            out[part] = signatures([s for s, p in zip(sets, part, strict=True) if p], m)
        return out
    if few.any() and lengths.sum() > BATCH and len(sets) > 1:  # arrays that stay in a core's cache
        half = len(sets) // 2
        return np.concatenate([signatures(sets[:half], m), signatures(sets[half:], m)])
    doc = np.repeat(np.arange(len(sets)), lengths)
    seed = np.concatenate(sets) if len(sets) else np.empty(0, U)
    best = np.full((len(sets), m), np.inf)
    swaps: list[np.ndarray] = []
    held = np.tile(np.arange(m, dtype=np.int16), (len(seed), 1)) if few.any() else None
    for level in range(m):
        draw = mixed(seed + U((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        fraction = (draw >> U(11)).astype(np.float64) * 2.0**-53
        other = level + ((mixed(draw + U(0xD1B54A32D192ED03)) >> U(32)) * U(m - level) >> U(32)).astype(np.int64)
        if held is not None:
            flat, at = held.reshape(-1), np.arange(0, held.size, m) + other
            slot = flat.take(at).astype(np.int64)
            flat[at] = held[:, level]
        else:
            slot = other.copy()  # what the earlier swaps have left at that place
            for k in range(level - 1, -1, -1):
                slot[slot == swaps[k]] = k
        np.minimum.at(best.reshape(-1), doc * m + slot, level + fraction)
        open_docs = best.max(axis=1) > level + 1
        if not open_docs.any():
            break
        swaps.append(other)
        if not open_docs.all():
            stay = open_docs[doc]
            if stay.sum() < 0.7 * len(stay):
                doc, seed, swaps = doc[stay], seed[stay], [s[stay] for s in swaps]
                held = held[stay] if held is not None else None
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, one for each set and band."""
    bits = signature.view(U).reshape(-1, bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U), bits.shape[:2]).copy()
    for k in range(rows):
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return keys.view(np.int64)


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, keys) of the columns (doc_id, text); no fingerprint or keys without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                sets = [shingler.set_of(t) for t in texts]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands * rows), bands, rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "fingerprint", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, fingerprint binary, keys array<bigint>")


def links(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> np.ndarray:
    """Where sets of the rows `left` and `right` link, as a boolean matrix; exact.

    Only shingles that both sides have, and more than one row, are columns; they are sorted once and multiplied slice by slice,
    so time and memory grow with the shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((len(left), len(right)), np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    value, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    on = np.zeros((2, len(sets)), bool)
    on[0, left], on[1, right] = True, True
    both = np.zeros((2, len(value)), bool)
    for k in range(2):
        both[k, column[on[k][rows]]] = True
    kept = both.all(axis=0) & (held > 1)
    number = np.cumsum(kept) - 1
    cell = kept[column]
    at, row = number[column[cell]], rows[cell]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    total = int(kept.sum())
    ends = np.searchsorted(at, np.arange(0, total + WIDE, WIDE))
    for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
        parts = []
        for side, n in ((0, len(left)), (1, len(right))):
            mine = place[side, row[i:j]]
            dense = np.zeros((n, min(WIDE, total - k * WIDE)), np.float32)
            dense[mine[mine >= 0], at[i:j][mine >= 0] - k * WIDE] = 1
            parts.append(dense)
        common += np.rint(parts[0] @ parts[1].T).astype(np.int64)  # whole numbers below 2^24: exact
    own = sizes[left][:, None] + sizes[right][None, :]
    # a member beside itself shares all, lone shingles too
    common = np.where(np.array(left)[:, None] == np.array(right)[None, :], sizes[left][:, None], common)
    return 100 * common >= percent * (own - common)


def prefixed(s: np.ndarray, order: np.ndarray, seen: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare, rest) of a set: all shingles that no pivot has, and as many of the others, those of the fewest pivots first, as
    its prefix may need. `order` holds the pivots' shingles, `seen` in how many pivots each is."""
    at = np.minimum(np.searchsorted(order, s), max(0, len(order) - 1))
    n = np.where(order[at] == s, seen[at], 0) if len(order) else np.zeros(len(s), np.int64)
    held = np.flatnonzero(n)
    need = max(0, prefix_size(len(s), percent) - (len(s) - len(held)))
    return s[n == 0].view(np.int64), s[held[np.lexsort((s[held], n[held]))[:need]]].view(np.int64)


COMPARED = "u bigint, v bigint, doc_id bigint, rare array<bigint>, rest array<bigint>, size int"


def compared(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) inside each block of rows (block: a key, doc_id, side, text), as a spanning forest; exact.

    Rows of side 0 meet those of side 1, rows of side null all. Rows of side 2 are pivots: they meet all, and in their blocks
    each row of side null also gives its prefix (doc_id, rare, rest, size)."""
    dealt = rows.select("block", "side", "doc_id", "text").repartition("block").sortWithinPartitions("block")
    names = [c.split()[0] for c in COMPARED.split(", ")]

    def out(**given: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
        return pa.RecordBatch.from_arrays([given[c].cast(k) if c in given else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def forest(ids: list[int], sides: list[int | None], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pivots = [i for i, s in enumerate(sides) if s == 2 and len(sets[i])]
        left = [i for i, s in enumerate(sides) if s != 1 and len(sets[i])]
        right = [i for i, s in enumerate(sides) if s != 0 and len(sets[i])]
        if left and right:
            i, j = np.nonzero(links(sets, left, right, percent))
            ids_ = np.array(ids, np.int64)
            nodes, root = roots(ids_[np.array(left)[i]], ids_[np.array(right)[j]])
            yield out(u=pa.array(nodes[nodes != root]), v=pa.array(root[nodes != root]))
        if pivots:
            order, seen = np.unique(np.concatenate([sets[i] for i in pivots]), return_counts=True)
            own = [i for i, s in enumerate(sides) if s is None and len(sets[i])]
            found = [prefixed(sets[i], order, seen, percent) for i in own]
            if own:
                yield out(doc_id=pa.array([ids[i] for i in own]), rare=pa.array([f[0] for f in found], pa.list_(pa.int64())), rest=pa.array([f[1] for f in found], pa.list_(pa.int64())), size=pa.array([len(sets[i]) for i in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now = Shingler(width), None
        ids: list[int] = []
        sides: list[int | None] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            for part, found in slices(batch, "text"):
                for block, side, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), found, strict=True):
                    if block != now:
                        if len(ids) > 1:
                            yield from forest(ids, sides, sets)
                        now, ids, sides, sets = block, [], [], []
                    ids.append(doc)
                    sides.append(side)
                    sets.append(shingler.set_of(text))
        if len(ids) > 1:
            yield from forest(ids, sides, sets)

    return dealt.mapInArrow(run, COMPARED)


def blocks(n: Column, shingles: Column) -> Column:
    """Of how many blocks so many members with so many shingles are."""
    return F.ceil(F.greatest(n / BLOCK, shingles / SHINGLES)).cast("int")


def prefix_groups(prefixes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(doc_id, root, part) of the members that share a shingle of their prefixes with a member of another part; root names
    those that hang together so.

    The order of a component's shingles: those that no pivot has by how many members have them, then those of the fewest
    pivots; the prefixes give the latter in that order."""
    held = written(prefixes.join(parts.drop("n_shingles"), "doc_id").select("doc_id", "root", "part", "rare", "rest", "size"))
    each = held.select("doc_id", "root", F.explode("rare").alias("shingle"))
    often = written(each.groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # shingles of one member alone come first and are in no other prefix: they only use up places
    found = each.join(often, ["root", "shingle"]).groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    near = held.join(found, ["doc_id", "root"], "left")
    common = F.coalesce(F.transform("shared", lambda x: x["shingle"]), F.array().cast("array<bigint>"))
    places = F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    near = near.select("doc_id", "root", "part", "rest", common.alias("shared"), F.size("rare").alias("n_rare"), places.alias("places"))
    alone = F.col("n_rare") - F.size("shared")
    upto = lambda c, n: F.slice(c, F.lit(1), F.greatest(F.lit(0), F.least(n, F.size(c))))
    prefix = F.concat(upto("shared", F.col("places") - alone), upto("rest", F.col("places") - F.col("n_rare")))
    met = written(near.select("doc_id", "root", "part", F.explode(prefix).alias("shingle")))
    groups = written(met.groupBy("root", "shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("doc_id").alias("top")).where("low < high").select("root", "shingle", "top"))
    edges = met.join(groups, ["root", "shingle"]).select(F.col("doc_id").alias("u"), F.col("top").alias("v"))
    return components(edges).select(F.col("node").alias("doc_id"), "root").join(parts.select("doc_id", "part", "n_shingles"), "doc_id")


def verified_links(candidates: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact links (u, v) inside candidate components (node, root, degree, n_shingles), connecting all that a full comparison would connect."""
    # candidates grow with the data: never sent to every task, whatever their size, so that the plan is one at every size;
    # all texts are shuffled once, those of the candidates are kept for the rounds below
    chosen = candidates.select(F.col("node").alias("doc_id"))
    texts = written(chosen.hint("merge").join(texts, "doc_id").select("doc_id", "text"))
    # tables of their own, so that joins are free to split a root that many members share
    sizes = written(candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).withColumn("chunks", blocks(F.col("n"), F.col("shingles"))))
    dealt = candidates.join(sizes, "root").withColumnRenamed("node", "doc_id")
    dealt = written(dealt.withColumn("chunk", F.floor(hashed("doc_id", 1) * F.col("chunks")).cast("int")))
    large = dealt.where("chunks > 1")
    # central members link with more of the others: one of each of a few hash classes
    kind = F.floor(hashed("doc_id", 4) * CENTRAL).cast("int").alias("kind")
    central = large.groupBy("root", kind).agg(F.max_by("doc_id", F.struct("degree", "doc_id")).alias("doc_id")).select("root", "doc_id")
    pivots = large.where(hashed("doc_id", 2) * F.col("n") < PIVOTS).select("root", "doc_id").unionByName(central).distinct()
    pivots = pivots.join(sizes.select("root", "chunks"), "root")
    pivot_rows = copies(pivots.join(texts, "doc_id"), "chunks", "chunk").select(named("root", "chunk").alias("block"), F.lit(2).alias("side"), "doc_id", "text")
    # pivots are members too: without a side, so that they give their prefixes; their second copy in that block links with the first
    own = dealt.join(texts, "doc_id").select(named("root", "chunk").alias("block"), F.lit(None).cast("int").alias("side"), "doc_id", "text")
    found = written(compared(own.unionByName(pivot_rows), width, percent))
    first = found.where("u IS NOT NULL").select("u", "v")
    prefixes = found.where("doc_id IS NOT NULL").select("doc_id", "rare", "rest", "size")
    if prefixes.isEmpty():
        discard(texts, dealt)
        return first
    # of each component that was cut, the parts that are still apart
    reached = components(first)
    parts = large.select("doc_id", "root", "n_shingles").join(reached.select(F.col("node").alias("doc_id"), F.col("root").alias("part")), "doc_id", "left")
    parts = written(parts.withColumn("part", F.coalesce("part", "doc_id")))
    torn = written(parts.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("root"))
    parts = parts.join(torn, "root", "left_semi")
    near = written(prefix_groups(prefixes, parts, percent))
    points = written(count_tree.pointed(near.select("doc_id").distinct().join(texts, "doc_id"), width))
    pairs = count_tree.large_trees(near.select(F.col("root").alias("key"), "doc_id", "part"), points, percent, POINTS)
    second = written(count_tree.verified(pairs, points, width, percent))
    discard(texts, dealt, near, points)  # the links alone are read from now on
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest id of its group), kept (it is that one)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows_ = written(sketched(docs, width, bands, rows))
    owned = equal_sets(rows_)
    sets = rows_.where("fingerprint is not null and doc_id is not null").join(owned.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    member = sets.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    buckets = member.groupBy("key").agg(F.min("doc_id").alias("top"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("top < last").select("key", "top", "n")
    met = member.join(buckets, "key")
    # the members of a document's buckets: how central it is
    near = written(met.groupBy("doc_id").agg(F.sum("n").alias("degree"), F.max("n_shingles").alias("n_shingles"), F.collect_set("top").alias("tops")))
    linked = components(near.select(F.col("doc_id").alias("u"), F.explode("tops").alias("v")))
    candidates = written(linked.join(near.select(F.col("doc_id").alias("node"), "degree", "n_shingles"), "node"))
    found = verified_links(candidates, docs, width, percent)
    return grouped(rows_, owned, found)
