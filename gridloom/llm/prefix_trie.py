"""The prefix trie of conversations by truncation peeling.

A conversation is a sequence of turns (role, text); each distinct sequence of first d turns is a node of depth d, from the
textless root. Turns are hashed first, so a conversation is one path of 16 bytes a turn, and equal conversations are merged by
an aggregate. Paths are then range-partitioned and sorted, so that those of one subtree lie side by side, and taken in runs of
bounded size. A run is peeled from its maximum depth: the paths that end at that depth join the longer ones, neighbours that are
equal up to it become one node with all its sums, its last turn is stripped, and the shorter paths are grouped again. Every node
is found and summed in that one descent.

Only the nodes on a run's first and last path can go on in other runs. They are left open: a run hands on these two paths
with the sums at each depth, and the paths of all runs are peeled again by the same rule until one run holds them all. A run of
thousands of paths leaves two, so a second descent ends it for all but huge tables; a popular first turn or a family of copies
lies in many runs, and a conversation of thousands of turns is one path.

Null roles and texts count as empty. Turns go by number, null first; turns of one number by the hash of role and text, and
repeated rows are turns like others. Rows without a conversation's id are left out. A conversation without turns ends at the
root. An empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import written
from gridloom.llm.manifest import CRC32_SQL

WIDE = 16
#: Paths of one run, and their bytes; conversations of one part of a list of ends.
RUN, RUN_BYTES, PART = 8192, 32 << 20, 10
#: Copies of a node's id that its children are dealt over.
SALT = 16
LAST = np.iinfo(np.int64).max
SUMS = ("n", "kids", "leaves", "saved")
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, node binary, parent binary"
SPINE = "path binary, lens array<int>, least array<bigint>, n array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of a hash and the text's code points."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    hashed = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    each = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), hashed.alias("hash"), F.char_length(said).alias("size")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hash"].alias("hash"), t["size"].alias("size")))
    return each.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(convs: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c of (conv_id, turns) with its first h turns taken from its family's first, c - c % family, and its own
    after its first h; h is the crc32 of c modulo `most`."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    named = convs.withColumns({"first": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(heads, "first", "left")
    none = F.array().cast(convs.schema["turns"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest(F.lit(1), F.col("h")))).otherwise(none)
    return named.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns")))).alias("turns"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, lens, n, least, ends) of (conv_id, turns): how many conversations are that sequence, the least of their ids, and the
    SHA-256 of all ids in order. Ids are put together in parts of a bounded size first."""
    path = F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), "")
    rows = convs.select(F.unhex(path).alias("path"), F.transform("turns", lambda t: t["size"]).alias("lens"), "conv_id")
    part = F.shiftright("conv_id", PART).alias("part")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = rows.groupBy("path", "lens", part).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), listed.alias("ids"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"]), ",")
    return parts.groupBy("path", "lens").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sha2(whole, 256).alias("ends"))


def spines(paths: DataFrame) -> DataFrame:
    """Distinct paths with their sums at each depth: nothing but at the last."""
    at_end = lambda c, kind: F.concat(F.transform("lens", lambda x: F.lit(None).cast(kind)), F.array(F.col(c).cast(kind)))
    zeros = F.transform(F.concat("lens", F.array(F.lit(0))), lambda x: F.lit(0).cast("long"))
    return paths.select("path", "lens", at_end("least", "bigint").alias("least"), at_end("n", "bigint").alias("n"), *[zeros.alias(c) for c in ("kids", "leaves", "saved")], at_end("ends", "string").alias("ends"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    most = min(len(a), len(b)) // WIDE
    if a[: most * WIDE] == b[: most * WIDE]:
        return most
    low, high = 0, most  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * WIDE] == b[: mid * WIDE] else (low, mid)
    return low


class Run:
    """Paths side by side, peeled together; `whole` where no other run holds any of their nodes."""

    def __init__(self, rows: pa.Table, whole: bool, named: bool):
        self.paths, self.whole, self.named = rows["path"].to_pylist(), whole, named
        self.deep = np.array([len(p) // WIDE for p in self.paths], np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.deep + 1)[:-1]]).astype(np.int64)
        flat = lambda c, empty: rows[c].combine_chunks().flatten().fill_null(empty).to_numpy(zero_copy_only=False)
        self.own = {c: flat(c, 0) for c in SUMS}
        self.least = flat("least", int(LAST))
        self.ends = rows["ends"].combine_chunks().flatten().to_pylist()
        self.size = np.zeros(int((self.deep + 1).sum()), np.int64)  # of the last text of each prefix
        inner = np.ones(len(self.size), bool)
        inner[self.off] = False
        self.size[inner] = flat("lens", 0)
        self.shared = np.array([shared_turns(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)] + [-1], np.int64)

    def prefix_name(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.paths[row][: depth * WIDE]).digest()

    def peeled(self) -> Iterator[dict]:
        """Nodes as columns, depth by depth, then the open paths."""
        count, last = len(self.paths), len(self.paths) - 1
        both = shared_turns(self.paths[0], self.paths[last])
        # what closed children add to their parent, by the row that stands for it
        acc = {c: np.zeros(count, np.int64) for c in SUMS}
        least = np.full(count, LAST, np.int64)
        has_ends = np.array([e is not None for e in self.ends])
        left = [{c: [] for c in (*SUMS, "least", "ends")} for _ in range(2)]  # of the first and the last path, deepest first
        waiting = None
        for d in range(int(self.deep.max()), -1, -1):
            rows = np.flatnonzero(self.deep >= d)  # all, as a path that was handed on has sums of its own at each depth
            between = np.minimum.reduceat(self.shared, rows)[:-1]
            start = np.concatenate([[True], between < d])
            first = np.flatnonzero(start)
            at = self.off[rows] + d
            node = {c: np.add.reduceat(acc[c][rows] + self.own[c][at], first) for c in SUMS}
            low = np.minimum.reduceat(np.minimum(least[rows], self.least[at]), first)
            told = np.maximum.reduceat(np.where(has_ends[at], at, -1), first)
            stands = rows[first]
            open_ = np.zeros(len(first), bool)
            if not self.whole:
                for side, edge in ((0, 0), (1, last)):
                    if self.deep[edge] < d:
                        continue
                    k = 0 if side == 0 else len(first) - 1
                    kept = left[side]
                    here = side == 0 or d > both  # nodes of both paths are left with the first
                    for c in SUMS:
                        kept[c].append(int(node[c][k]) if here else 0)
                    kept["least"].append(int(low[k]) if here and low[k] != LAST else None)
                    kept["ends"].append(self.ends[told[k]] if here and told[k] >= 0 else None)
                    open_[k] = True
            shut = ~open_
            childless = node["kids"] == 0
            leaves = np.where(childless, 1, node["leaves"])
            saved = node["saved"] + (node["n"] - 1) * self.size[self.off[stands] + d]
            if waiting is not None:  # the children of these nodes, now that their parents are known
                group = (np.cumsum(start) - 1)[np.searchsorted(rows, waiting["row"])]
                yield self.out(waiting, low[group], open_[group], stands[group], d)
            waiting = {"depth": d, "row": stands[shut], "low": low[shut], "n": node["n"][shut], "kids": node["kids"][shut], "leaves": leaves[shut], "saved": saved[shut], "ends": told[shut]}
            for c, value in (("n", node["n"]), ("kids", np.ones(len(first), np.int64)), ("leaves", leaves), ("saved", saved)):
                acc[c][:] = 0
                acc[c][stands] = np.where(shut, value, 0)
            least[:] = LAST
            least[stands] = np.where(shut, low, LAST)
        yield self.out(waiting, None, None, None, -1)
        if not self.whole:
            for side, edge in [(0, 0), (1, last)][: 1 if last == 0 else 2]:
                kept = {c: v[::-1] for c, v in left[side].items()}
                yield {"path": [self.paths[edge]], "lens": [self.size[self.off[edge] + 1 : self.off[edge] + self.deep[edge] + 1].tolist()], **{c: [v] for c, v in kept.items()}}

    def out(self, w: dict, low: np.ndarray | None, open_: np.ndarray | None, stands: np.ndarray | None, d: int) -> dict:
        count = len(w["row"])
        if low is None:
            parent_id, parent = [None] * count, [None] * count
        else:
            parent_id = [None if o else int(p) for p, o in zip(low, open_, strict=True)]
            names = {int(r): self.prefix_name(int(r), d) for r in np.unique(stands[open_])}
            parent = [names[int(r)] if o else None for r, o in zip(stands, open_, strict=True)]
        node = [self.prefix_name(int(r), w["depth"]) for r in w["row"]] if self.named else [None] * count
        ends = [self.ends[k] if k >= 0 else NO_ENDS for k in w["ends"]]
        return {"conv_id": w["low"], "depth": np.full(count, w["depth"]), "parent_conv_id": parent_id, "n_convs": w["n"], "n_children": w["kids"], "n_leaves": w["leaves"], "saved_tokens": w["saved"], "ends_sha256": ends, "node": node, "parent": parent}


_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in f"{NODE}, {SPINE}".split(", ")])


def peel(paths: DataFrame, whole: bool, named: bool) -> DataFrame:
    """Nodes and open paths of sorted paths, run by run; with `whole` each partition is one run that leaves nothing open."""

    def batch_of(cols: dict) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def peeled(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(batch_of, Run(pa.Table.from_batches(rows), whole, named).peeled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                if held and not whole and (count + part.num_rows > RUN or size > RUN_BYTES and not named):
                    yield from peeled(held)
                    held, count, size = [], 0, 0
                held.append(part)
                count, size = count + part.num_rows, size + part.get_total_buffer_size() * part.num_rows // max(1, batch.num_rows)
        if count:
            yield from peeled(held)

    return paths.mapInArrow(run, f"{NODE}, {SPINE}")


def trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns), see `sequences`: conv_id, the smallest of the conversations that begin
    with it; depth; parent_conv_id; n_convs; n_children; n_leaves and saved_tokens of its subtree; ends_sha256."""
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spine = [c.split()[0] for c in SPINE.split(", ")]
    rows = spines(written(distinct_paths(convs)))
    found = []
    dealt = rows.repartitionByRange("path")
    while True:
        made = written(peel(dealt.sortWithinPartitions("path"), False, bool(found)))
        found.append(made.where("path IS NULL"))
        rows = made.where("path IS NOT NULL").select(*spine)
        count = rows.count()
        if count <= RUN:
            break
        dealt = rows.repartitionByRange(count // (RUN // 2), "path")  # so that each run holds many paths
    found.append(written(peel(rows.coalesce(1).sortWithinPartitions("path"), True, True)))  # RUN paths at most
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    # nodes whose parent was still open learn its id: a few rows for each run, copied so that no parent's children meet in one task
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    opened = nodes.where("node IS NOT NULL").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), salts)
    asked = nodes.where("parent IS NOT NULL").drop("parent_conv_id").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int"))
    return nodes.where("parent IS NULL").select(*kept).unionByName(asked.join(opened, ["parent", "salt"]).select(*kept))



#: DuckDB's form of the trie: nodes by the hash of all turns so far, subtrees by the paths of each node's smallest member.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS p
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, c - c % 100 AS family, {CRC32_SQL.format("c")} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
built AS (SELECT c, 0 AS part, p, role, text FROM ids JOIN t ON t.conv_id = family AND p <= h
          UNION ALL SELECT c, 1, p, role, text FROM ids JOIN t ON t.conv_id = c AND p > h),
chains AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, len(text) AS size,
                  md5(string_agg(CAST(strlen(role) AS VARCHAR) || ':' || role || CAST(strlen(text) AS VARCHAR) || ':' || text, '') OVER (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)) AS k FROM built),
paths AS (SELECT c, d, size, k FROM chains UNION ALL SELECT c, 0, 0, '' FROM ids),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ended FROM paths),
nodes AS (SELECT k, any_value(d) AS d, any_value(up) AS up, any_value(size) AS size, min(c) AS conv_id, count(*) AS n,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends FROM linked GROUP BY k),
kids AS (SELECT up AS k, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (k)),
trees AS (SELECT a.k, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.size) AS saved FROM counted f JOIN linked a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM counted n JOIN trees USING (k) LEFT JOIN nodes q ON q.k = n.up
"""
