"""A Merkle manifest of a dataset: a digest for each row, a root for each source, one root for all, and each row's proof.

Nodes carry the interval [lo, hi) of the leaf ranks that they cover. Leaves get ranks within their source in the order of
their id; a node of level k covers `fan` to the power k leaves at most, and begins at a multiple of that: the multiple is the
bucket by which a level's nodes meet the level above. A parent is made where the nodes of one bucket come together (never
more than `fan` of them), and keeps their intervals. Proofs are handed down from the roots: at each level a containment join
within buckets attaches the parent, and what the difference of its interval and the node's own leaves are the siblings.
Level k has a `fan`-th of the nodes below it, so all joins together move little more than the leaves once.

Ranks need no window over a source: rows are range-partitioned by (source, id, digest), and counts of the partitions before
are added, so that one source may hold most rows.

The digest of a row is the SHA-256, as lower-case hex, of its fields put together: `-` for null, else the number of UTF-8 bytes,
a colon and the value. Rows without an id come first in their source, rows without a source are a source of their own that
comes first. Rows that repeat an id are leaves of their own in the order of their digests; equal rows can't be told apart, nor
need they be. A source of one row has that row's leaf as its root, and one source is the root of all. An empty table gives an
empty table. Other columns of the table play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a number of `monotonically_increasing_id` that count inside a partition.
INSIDE = 33


def digest(*fields: Column) -> Column:
    """The digest of a row with these values."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def joined_digest(digests: Column) -> Column:
    """The digest over an array of digests, as hex text."""
    return F.sha2(F.array_join(digests, ""), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `lo`, their rank within the group in that order, and `n`, the group's rows. Rows that are equal in group and
    order may lie in several partitions."""
    keys = [group, *order]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", INSIDE))
    # a row for each group and partition that has it: groups that lie in one partition have one
    counted = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    pieces = counted.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("part", "here", "first"))).alias("parts"), F.sum("here").alias("n"))
    start = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + p["here"])
    starts = written(pieces.select(group, "n", F.explode(F.transform("parts", lambda p, i: F.struct(p["part"].alias("part"), (start(i) - p["first"]).alias("shift")))).alias("p")).select(group, "n", "p.*"))
    return placed.join(starts, [group, "part"]).withColumn("lo", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climbed(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables, tops) of leaves (name, n, lo, digest, ...): tables[k] holds the nodes of level k + 1 (name, n, lo, hi, digest and
    their children), tops (name, digest) the last node of each group."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    now, tables, width = leaves.withColumn("hi", F.col("lo") + 1), [], 1
    tops = now.where("n = 1").select("name", "digest")
    while width < most:
        below, width = width, width * fan
        child = F.struct("lo", "hi", *[c for c in now.columns if c not in ("name", "n", "lo", "hi")])
        bucket = F.floor(F.col("lo") / F.lit(width)).alias("bucket")
        met = now.where(F.col("n") > below).groupBy("name", "n", bucket).agg(F.sort_array(F.collect_list(child)).alias("children"))
        made = joined_digest(F.transform("children", lambda c: c["digest"])).alias("digest")
        table = written(met.select("name", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), made, "children"))
        tables.append(table)
        now = table.select("name", "n", "lo", "hi", "digest")
        tops = tops.unionByName(now.where(F.col("n") <= width).select("name", "digest"))
    return tables, tops


def descended(leaves: DataFrame, tables: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The leaves with the columns of tops (name, proof, ...), the proof begun with what is between a leaf and its group's top:
    for each level a struct of the siblings' digests to the left and to the right."""
    more = [c for c in tops.columns if c not in ("name", "proof")]
    own = [c for c in leaves.columns if c not in ("name", "n", "lo")]
    above = None
    for level in reversed(range(len(tables))):
        table, width = tables[level], fan ** (level + 1)
        led = table.where(F.col("n") <= width).join(tops, "name").select("name", "n", "children", "proof", *more)
        if above is not None:
            bucket = F.floor(F.col("lo") / F.lit(width))
            upper = above.select("name", bucket.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "proof", *more)
            held = table.where(F.col("n") > width).withColumn("bucket", bucket).join(upper, ["name", "bucket"]).where("lo >= from AND hi <= to")
            led = led.unionByName(held.select("name", "n", "children", "proof", *more))
        each = led.select("*", F.explode("children").alias("child"))
        side = lambda f: F.array_join(F.transform(F.filter("children", f), lambda c: c["digest"]), "")
        siblings = F.struct(side(lambda c: c["hi"] <= F.col("child.lo")).alias("left"), side(lambda c: c["lo"] >= F.col("child.hi")).alias("right"))
        kept = own if level == 0 else ["hi"]
        above = each.select("name", "n", "child.lo", *[f"child.{c}" for c in kept], F.concat(F.array(siblings), "proof").alias("proof"), *more)
    alone = leaves.where("n = 1").join(tops, "name").select("name", "n", "lo", *own, "proof", *more)
    return alone if above is None else above.unionByName(alone)


def manifest(docs: DataFrame, leaf: Column, doc_id: str = "doc_id", source: str = "source", fan: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) for each row of docs, and the columns of `carry`.

    `leaf` is the row's digest. The proof is an array of (left, right), from the leaf up to the root of all: a digest that takes
    the place of the leaf folds to the root as `folded` does."""
    carry = carry or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("name")
    own = {f"own{i}": c for i, c in enumerate(carry.values())}
    # texts are read once, digests alone are dealt from here on
    hashed = docs.select(name, F.col(doc_id).alias("id"), leaf.alias("digest"), *[c.alias(k) for k, c in own.items()])
    leaves = ranked(hashed, "name", ["id", "digest"])
    leaves = written(leaves.select("name", "n", "lo", "id", "digest", *own))
    tables, tops = climbed(leaves, fan)
    # the sources' tops are the leaves of one more tree
    tops = written(tops.select(F.lit("").alias("all"), F.col("name").alias("source"), "digest"))
    upper = ranked(tops, "all", ["source"]).select(F.col("all").alias("name"), "n", "lo", "source", "digest")
    upper = written(upper)
    upper_tables, root = climbed(upper, fan)
    row = root.first()  # the one root
    if row is None:
        row = {"digest": None}
    none = F.array().cast("array<struct<left:string,right:string>>")
    subroots = descended(upper, upper_tables, root.select("name", none.alias("proof")), fan)
    subroots = written(subroots.select(F.col("source").alias("name"), "proof", F.col("digest").alias("subroot")))
    found = descended(leaves, tables, subroots, fan)
    return found.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(row["digest"]).cast("string").alias("root"), "proof",
        *[F.col(k).alias(c) for k, c in zip(own, carry, strict=True)],
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest over a proof's siblings, level by level, left to right."""
    return joined_digest(F.transform(proof, lambda p: F.concat(p["left"], p["right"])))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds where the crc32 of the id is even, else as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


#: crc32 of a decimal number in DuckDB, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> CAST(k AS INTEGER)) & 1))),
                   lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))))"""

_PART = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_PART, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _climb(name: str, base: str) -> str:
    """A recursive relation: all nodes of the trees over `base` (g, n, lo, digest) with the siblings of each."""
    return f"""{name} AS (
  SELECT 0 AS level, g, n, lo, digest, CAST(1 AS BIGINT) AS width FROM {base}
  UNION ALL
  SELECT level + 1, g, n, lo // 3, sha256(string_agg(digest, '' ORDER BY lo)), width * 3 FROM {name} WHERE width < n GROUP BY level, g, n, lo // 3, width)"""


#: DuckDB's form of the manifest: levels by recursion, siblings by windows, proofs by the ranks of the ancestors.
ORACLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_LEAF("text")} AS leaf,
         {_LEAF(f"(CASE WHEN {CRC32_SQL.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS other FROM documents),
leaves AS (SELECT *, coalesce('=' || source, '') AS g, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo FROM hashed),
base AS (SELECT g, n, lo, leaf AS digest FROM leaves),
{_climb("nodes", "base")},
tops AS (SELECT g, digest FROM nodes WHERE width >= n AND (width = 1 OR width < n * 3)),
top_base AS (SELECT '' AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS lo, digest FROM tops),
{_climb("uppers", "top_base")},
root AS (SELECT digest FROM uppers WHERE width >= n AND (width = 1 OR width < n * 3)),
around AS (
  SELECT level, g, lo,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, lo // 3 ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, lo // 3 ORDER BY lo ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
  FROM (SELECT level, g, lo, digest FROM nodes WHERE width < n UNION ALL SELECT level + 1000, NULL, lo, digest FROM uppers WHERE width < n)),
top_ranks AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS lo FROM tops),
steps AS (
  SELECT l.g, l.lo AS spot, a.level, a.lhs, a.rhs FROM leaves l JOIN around a ON a.g = l.g AND a.lo = l.lo // CAST(3 ** a.level AS BIGINT)
  UNION ALL
  SELECT l.g, l.lo, a.level, a.lhs, a.rhs FROM leaves l JOIN top_ranks t ON t.g = l.g JOIN around a ON a.g IS NULL AND a.lo = t.lo // CAST(3 ** (a.level - 1000) AS BIGINT)),
proofs AS (SELECT g, spot, list({{'l': lhs, 'r': rhs}} ORDER BY level) AS p FROM steps GROUP BY g, spot),
told AS (SELECT l.doc_id, l.leaf, l.other, t.digest AS subroot, (SELECT digest FROM root) AS root, coalesce(p.p, []) AS p
         FROM leaves l JOIN top_ranks t ON t.g = l.g LEFT JOIN proofs p ON p.g = l.g AND p.spot = l.lo),
folds AS (
  SELECT row_number() OVER () AS k, 0 AS i, doc_id, leaf, subroot, root, p, other AS now FROM told
  UNION ALL
  SELECT k, i + 1, doc_id, leaf, subroot, root, p, sha256(p[i + 1].l || now || p[i + 1].r) FROM folds WHERE i < len(p))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256, now AS folded_root, now = root AS verified
FROM folds WHERE i = len(p)
"""
