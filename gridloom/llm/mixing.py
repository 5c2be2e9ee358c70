"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Sources in order of their code points (null last) take the weights in turn and share `percent` of all sizes; a target
stops at `most` times its source's size and the excess goes to the others by weight. A document's expected copies are
its source's target over its size; their prefix sums run through the source in order of size (within a sixteenth of an
octave), then of a hash, start at one random offset, and the document is taken once for each whole number that they
cross. Neighbours in that order are of like size, so what a source gives comes near its target.

The prefix sums take three levels, as no source may go through one task: rows are counted in cells of a size step and a
hash range (about the square root of the step's rows in each), cells are summed within a source, hashes within a cell, and
rows that are alike within a hash. Those (rows without id and text, or copies that share an id) may be most of a source: they
are dealt over `ALIKE` shares by their place in the table, so that neither a count nor a rank sees them all. Ranks and the join
with the sums share one dealing of the rows, by a source's name that is never null.

Null texts have size 0; so do blank ones. Null ids and repeated rows are rows like others: a row's place is a hash of its id
and its text, so rows of one id (or of none) lie apart, and rows that are alike in both share the copies that fall to them, in the
order of their places in the table.
Sources without a word have target 0. Sources are few, as a source is what a weight is set for: one row of each goes through
one window. An empty table gives an empty table. Reruns agree: the order and the offset depend only on the rows and the seed.
Carried columns with the name of a new one are handed on as `<name>_before`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import apart, words, written

WEIGHTS = (5, 2, 1)
#: Documents with fewer rows in a size step than this many squared have a single cell there.
SPREAD = 4
#: Shares over which rows that are alike in id and text are dealt.
ALIKE = 1024


def word_count(text: Column) -> Column:
    """The number of words: the places where a word begins."""
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target) of (source, size); one row for each source, the null source included.

    The level at which weights are served rises until the target is spent: with the sources in order of size over
    weight, those before a point stop at their caps and the others share the rest by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.cast("long").alias("w"))
    rising = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent = ranked.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(Window.partitionBy()) * percent - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most * 100).alias("left"),
        F.sum("w").over(rest).alias("w_left"),
    )
    # the first source that its share does not fill sets the level; `left` is in hundredths of a word
    level = F.when(F.col("left") <= F.col("w_left") * F.col("source_size") * most * 100 / F.col("w"), F.struct(F.col("left") / 100.0, F.col("w_left").cast("double")))
    first = F.first(level, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = spent.select("source", "source_size", "w", first.alias("at"))
    share = F.col("w") * F.col("at").getField("col1") / F.col("at").getField("col2")
    return at.select("source", "source_size", F.coalesce(F.least(share, F.col("source_size") * F.lit(float(most))), F.lit(0.0)).alias("target"))


def systematic_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target and copies for each row of docs, and the columns in `carry`."""
    of_text = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), of_text).cast("binary"))
    carry = carry or []
    names = apart(carry, ["doc_id", "size", "source_size", "target", "copies"])
    carried = [F.struct(*carry).alias("carried")] if carry else []
    size = word_count(F.col(text))
    bits = F.length(F.bin("size"))
    step = F.when(F.col("size") < 16, F.col("size")).otherwise(bits * 16 + F.call_function("shiftrightunsigned", F.col("size"), bits - 5) % 16)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"), *carried)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("name")
    rows = written(rows.withColumns({"step": step.cast("int"), "name": named("source"), "share": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ALIKE)).cast("int")}))
    targets = source_targets(rows, weights, percent, most).select("source_size", "target", named("source"))
    cells = rows.groupBy("name", "step").agg(F.ceil(F.sqrt(F.count(F.lit(1))) / SPREAD).cast("long").alias("cells"))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("cells") / F.lit(float(1 << 32))).cast("int")
    # a row for each hash: rows that are alike are counted where they are read, then by share
    shares = rows.groupBy("name", "step", "key", "share").agg(F.count(F.lit(1)).alias("n"))
    alike = shares.groupBy("name", "step", "key").agg(F.sort_array(F.collect_list(F.struct("share", "n"))).alias("shares"), F.sum("n").alias("n"))
    placed = alike.join(cells, ["name", "step"]).withColumn("cell", place).drop("cells")
    counts = placed.groupBy("name", "step", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("name").orderBy("step", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("name", "step", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, "name")
    within = Window.partitionBy("name", "step", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["name", "step", "cell"])
    upto_share = lambda i: F.aggregate(F.slice("shares", F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    begun = F.transform("shares", lambda x, i: F.struct(x["share"].alias("share"), (F.col("start") + F.col("earlier") + upto_share(i)).alias("start")))
    sums = ranked.select("name", "step", "key", "source_size", "target", F.inline(begun))
    own = Window.partitionBy("name", "step", "key", "share").orderBy("doc_id", *([F.xxhash64("carried")] if carry else []))
    joined = rows.withColumn("rank", F.row_number().over(own)).join(sums, ["name", "step", "key", "share"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    upto = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    ready = joined.withColumns({"rate": rate, "offset": offset, "at": F.col("start") + F.col("rank")})
    copies = upto(F.col("at")) - upto(F.col("at") - 1)
    return ready.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), *[F.col("carried")[c].alias(names[c]) for c in carry])


#: DuckDB's form of the mix: one window over each source's whole order.
ORACLE_SQL = rf"""
WITH rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM by_source),
spent AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 150 - 200 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
                 CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_rest FROM ranked),
level AS (SELECT rest, w_rest FROM spent WHERE rest <= w_rest * source_size * 200 / w ORDER BY source_size / w, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(w * (SELECT rest / 100.0E0 FROM level) / (SELECT w_rest FROM level), source_size * 2.0E0), 0) AS target FROM spent),
placed AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0E0 END AS rate,
                  row_number() OVER (PARTITION BY r.source ORDER BY CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 5)) % 16 END, key, r.doc_id, size) AS pos,
                  CAST('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8) AS BIGINT) / 4294967296.0E0 AS off
           FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(pos * rate + off) - floor((pos - 1) * rate + off)) * size AS BIGINT) AS taken FROM placed
"""
