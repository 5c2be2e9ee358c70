"""Repeated passages by sparse suffix arrays.

Of all suffixes of the word sequences, those are retained that begin at minimisers: of every window of `least` words the
leftmost smallest hash of `GRAM` words. Equal passages of `least` words select equal places, so each is met by at least
one pair of retained suffixes. Retained suffixes whose first words occur once are dropped; the others are sorted over the
whole corpus (by range, with document and place as last keys, so that no group of equal suffixes meets in one task) and
compared with the next ones in that order; a match is extended to the right and to the left as far as a passage of
`least` words through that place can need, and the spans of a document's matches are merged.

That settles the hashes of few suffixes, where each meets all others. Of the others, every window is settled by
aggregates: a retained place owns the windows that selected it, equal windows have equal owners, and the least and the
greatest document of a window's hash tell whether two have it. Equal stretches of owned windows count as one row first.

Words are compared by 24-bit hashes after a 64-bit hash of the first `GRAM`; case counts. Null and blank texts, and those of
fewer than `least` words, have no passages. Ids are whole numbers from -2^62 on. Matches count between different ids alone,
or also inside one with `within`, so repeated rows of one id are one document. Rows without an id are told apart by their
texts: passages that two of them share are found, exact copies without an id are one document; their `doc_id` (and `other`)
is null. Other columns of any name play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import discard, slices, written
from gridloom.llm.near_dup import U, mixed

GRAM = 8
#: Neighbours in the sorted order that each suffix is compared with.
NEAR = 4
WIDE = 3  # bytes of a word's hash
#: Ids below stand for rows without one.
LEAST_ID = -(1 << 62)
#: Suffixes of a partition of the sorted order, about 300 bytes each.
SORTED = 200_000
REMEMBERED = 300_000


class Words:
    """Texts as arrays of 64-bit word hashes; remembers words up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(found).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, found), U, len(found))


def owners(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the retained place of each window of a word array, ascending, and the hash of each."""
    if len(words) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(words) - GRAM + 1
    gram = np.zeros(n, U)
    for k in range(GRAM):
        gram = mixed(gram * U(0x9E3779B97F4A7C15) + words[k : k + n])
    wide = least - GRAM + 1
    windows = np.lib.stride_tricks.sliding_window_view(gram, wide)
    places = np.concatenate([np.argmin(windows[i : i + 4096], axis=1) + np.arange(i, min(i + 4096, len(windows))) for i in range(0, len(windows), 4096)])
    return places, gram[places].view(np.int64)


def minimisers(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the retained suffixes of a word array."""
    owner, keys = owners(words, least)
    places, first = np.unique(owner, return_index=True)
    return places, keys[first]


def window_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """A 64-bit hash of each window of `least` words, put together from those of 1, 2, 4, ... words."""
    n, size, done, power = len(words) - least + 1, 1, 0, words
    out = np.full(n, least, U)
    while size <= least:
        if least & size:
            out = mixed(out * U(0x9E3779B97F4A7C15) + power[done : done + n])
            done += size
        power = mixed(power[:-size] * U(0x9E3779B97F4A7C15) + power[size:])
        size *= 2
    return out.view(np.int64)


def owned(words: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, pa.Array]:
    """The first window that each retained place owns, and the hashes of all that it owns, one after the other."""
    owner, hashes = owners(words, least)[0], window_hashes(words, least)
    first, size = np.searchsorted(owner, places), np.searchsorted(owner, places, "right") - np.searchsorted(owner, places)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
    return first, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[at]))


def contexts(words: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words from each place on, and of those before it (nearest first); zeros beyond the text."""
    left = least - GRAM
    short = ((words >> U(40)) | U(1)).astype(np.uint32)  # never zero
    padded = np.concatenate([np.zeros(left, np.uint32), short, np.zeros(least, np.uint32)]).view(np.uint8).reshape(-1, 4)[:, :WIDE]
    at = places[:, None] + left
    return padded[at + np.arange(least)[None, :]].reshape(len(places), -1), padded[at - 1 - np.arange(left)[None, :]].reshape(len(places), -1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the rows of two context arrays have in common from their start."""
    shape = (len(a), a.shape[1] // WIDE, WIDE)
    same = (a == b).reshape(shape).all(axis=2) & (a.reshape(shape) != 0).any(axis=2)
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1))


SUFFIX = ["key", "after", "before", "doc_id", "row", "place"]
SPAN = "doc_id bigint, row bigint, start int, stop int, other bigint"


def matched(table: pa.Table, least: int, within: bool, apart: int = 0) -> pa.RecordBatch:
    """Spans from sorted suffixes, each compared with the next NEAR; `apart`: only pairs across that many first rows."""
    n = table.num_rows
    names = [f.split()[0] for f in SPAN.split(", ")]
    key, doc, row, place = (table[c].to_numpy() for c in ("key", "doc_id", "row", "place"))
    after, before = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(n, -1) for c in ("after", "before"))
    parts: list[list[np.ndarray]] = []
    for d in range(1, min(NEAR, n - 1) + 1):
        i = np.flatnonzero(key[d:] == key[:-d])
        if apart:
            i = i[(i < apart) & (i + d >= apart)]
        i = i[(doc[i] != doc[i + d]) | (within & ((row[i] != row[i + d]) | (place[i] != place[i + d])))]
        right, left = common(after[i], after[i + d]), common(before[i], before[i + d])
        ok = left + right >= least
        i, right, left = i[ok], right[ok], left[ok]
        for one, two in ((i, i + d), (i + d, i)):
            parts.append([doc[one], row[one], place[one] - left, place[one] + right, doc[two]])
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)


def settled(stretches: DataFrame, least: int, within: bool) -> DataFrame:
    """Spans of (doc_id, row, first, windows, stretch) whose windows another document has, however many have them."""
    own = F.struct("doc_id", "row", "first") if within else F.struct("doc_id")
    # tables of their own, so that the joins are free to split a stretch or a window that many documents share
    each = written(stretches.groupBy("stretch").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.any_value("windows").alias("windows")))
    ends = each.select(F.explode("windows").alias("window"), "low", "high").groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = written(ends.where("low < high"))
    other = F.when(own == F.col("low"), F.col("high.doc_id")).otherwise(F.col("low.doc_id")).alias("other")
    met = stretches.join(each.select("stretch", "low", "high"), "stretch")
    whole = met.where("low < high").select("doc_id", "row", F.col("first").alias("start"), (F.col("first") + F.size("windows") + (least - 1)).alias("stop"), other)
    lone = met.where("low = high").select("doc_id", "row", "first", F.posexplode("windows").alias("nth", "window")).join(ends, "window")
    start = F.col("first") + F.col("nth")
    return whole.unionByName(lone.select("doc_id", "row", start.alias("start"), (start + least).alias("stop"), other))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, within: bool = False) -> DataFrame:
    """(doc_id, start, stop, n_words, other): the maximal runs of words start..stop-1 that repeat elsewhere, the text's words,
    and the smallest id of a document that a match of the run was found in."""
    row = F.xxhash64(text)
    unnamed = F.shiftrightunsigned(row, 2) + F.lit(-(1 << 63))
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), unnamed).alias("doc_id"), row.alias("row"), F.col(text).alias("text"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                arrays = [words.of(t) for t in texts]
                found = [minimisers(w, least) for w in arrays]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(w) for w in arrays], pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_words", "places", "keys"],
                )

    retained = written(docs.mapInArrow(select, "doc_id bigint, row bigint, n_words int, places array<int>, keys array<bigint>").where(F.size("places") > 0))
    suffixes = retained.select("doc_id", "row", F.explode(F.arrays_zip("places", "keys")).alias("s")).select("doc_id", "row", F.col("s.places").alias("place"), F.col("s.keys").alias("key"))
    # a table of its own, so that the join below is free to split a key that many suffixes share
    often = written(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a text's places are at most its words: a bounded list
    many = F.collect_set(F.when(F.col("n") > NEAR + 1, F.col("place"))).alias("many")
    wanted = suffixes.join(often, "key").groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"), many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                for doc, row, places, many, t in zip(*(part.column(c).to_pylist() for c in range(4)), texts, strict=True):
                    w = words.of(t)
                    at, keys = minimisers(w, least)
                    hit = np.isin(at, places)
                    at, keys = at[hit], keys[hit]
                    after, before = contexts(w, at, least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array([r.tobytes() for r in after], pa.binary()), pa.array([r.tobytes() for r in before], pa.binary()), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32))],
                        names=SUFFIX,
                    ).append_column("first", pa.nulls(len(at), pa.int32())).append_column("windows", pa.nulls(len(at), pa.list_(pa.int64())))
                    if many:
                        first, windows = owned(w, at := np.unique(np.array(many, np.int64)), least)
                        none = [pa.nulls(len(at), c) for c in (pa.int64(), pa.binary(), pa.binary())]
                        yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)), pa.array(first.astype(np.int32)), windows], names=[*SUFFIX, "first", "windows"])

    # `wanted` grows with the data: one plan at every size
    texts = wanted.hint("merge").join(docs, ["doc_id", "row"]).select("doc_id", "row", "places", "many", "text")
    cuts = written(texts.mapInArrow(cut, "key bigint, after binary, before binary, doc_id bigint, row bigint, place int, first int, windows array<bigint>"))
    kept = cuts.where("windows is null").select(*SUFFIX)
    order = ["key", "after", "doc_id", "row", "place"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SORTED))
    ranged = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans inside the partition, then its first and last suffixes: they meet their neighbours afterwards."""
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if sum(len(f) for f in first) < NEAR:
                first.append(table.slice(0, NEAR))
            table = pa.concat_tables([last, table]) if last is not None else table
            spans = matched(table, least, within)
            yield edged(spans, None, None)
            last = table.slice(max(0, table.num_rows - NEAR))
        if last is not None:
            yield edged(None, pa.concat_tables(first).slice(0, NEAR), 2 * part)
            yield edged(None, last, 2 * part + 1)

    def edged(spans: pa.RecordBatch | None, edge: pa.Table | None, side: int | None) -> pa.RecordBatch:
        names = [f.split()[0] for f in SPAN.split(", ")] + ["side", *(f"e_{c}" for c in SUFFIX)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        n = spans.num_rows if spans is not None else edge.num_rows
        left = list(spans.columns) if spans is not None else [pa.nulls(n, t) for t in types[:5]]
        right = [pa.nulls(n, t) for t in types[6:]] if edge is None else [edge[c].combine_chunks() for c in SUFFIX]
        return pa.RecordBatch.from_arrays([*left, pa.array([side] * n, pa.int32()), *right], names=names)

    both = written(ranged.mapInArrow(compare, SPAN + ", side int, e_key bigint, e_after binary, e_before binary, e_doc_id bigint, e_row bigint, e_place int"))
    edges = both.where("side is not null").select("side", *[F.col(f"e_{c}").alias(c) for c in SUFFIX])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last suffixes of the partitions so far against the first of the next: 2 * NEAR rows of each partition."""
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None:
            return
        sides = rows["side"].to_numpy()
        before: pa.Table | None = None
        for part in np.unique(sides // 2):
            head, tail = rows.filter(pa.array(sides == 2 * part)), rows.filter(pa.array(sides == 2 * part + 1))
            if before is not None:
                yield matched(pa.concat_tables([before, head]), least, within, before.num_rows)
            before = pa.concat_tables([before, tail]) if before is not None and tail.num_rows < NEAR else tail
            before = before.slice(max(0, before.num_rows - NEAR))

    across = edges.repartition(1).sortWithinPartitions("side", *order).mapInArrow(meet, SPAN)
    stretches = cuts.where("windows is not null").select("doc_id", "row", "first", "windows", F.xxhash64("windows").alias("stretch"))
    spans = both.where("side is null").drop("side", *[f"e_{c}" for c in SUFFIX]).unionByName(across).unionByName(settled(stretches, least, within)).distinct()
    spans = written(spans)
    discard(cuts, both)  # suffixes and their contexts: the spans alone are read from now on
    # merge the spans of a text that touch or overlap
    by = Window.partitionBy("doc_id", "row").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.groupBy("doc_id", "row", "start", "stop").agg(F.min("other").alias("other")).withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = begun.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other"))
    sizes = retained.select("doc_id", "row", "n_words").distinct()
    real = lambda c: F.when(F.col(c) >= LEAST_ID, F.col(c)).alias(c)
    return runs.join(sizes, ["doc_id", "row"]).select(real("doc_id"), F.col("start").cast("long"), F.col("stop").cast("long"), F.col("n_words").cast("long"), real("other"))
