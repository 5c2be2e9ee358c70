"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Fixed base rules come first. Then every rate of a document (scaled to whole numbers) is held against a fence of its
language and source: upper quartile plus `REACH` quartile ranges, lower quartile less as many for the word length.
Quartiles come from mergeable sketches: counts, least and largest value in bins of a sixteenth of an octave. Sketches of
(language, source) merge into those of a language, and these into one of all; a group of fewer than `LEAST` documents
uses the next wider sketch: of so few a quartile says little. Sketches are small sums, so no group of rows ever meets in one
task.

A column of the caller with the name of a new one is handed on as `<name>_before`.

Null and blank texts have no words and fail the base rules. Null languages and sources are groups like others; null ids
stay as they are; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import SPACES, apart, join_null_safe, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
REACH, LEAST = 3, 50
#: Rate -> (formula over the base columns, least width of a fence beyond the quartile, has a lower fence).
RATES = {
    "symbols": ("n_symbols * 1000 div nullif(n_words, 0)", 150, False),
    "word_length": ("word_chars * 100 div nullif(n_words, 0)", 200, True),
    "dup_lines": ("n_dup_lines * 1000 div nullif(n_words, 0)", 50, False),
    "repeats": ("n_repeat_words * 1000 div nullif(n_words, 0)", 300, False),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered(positions: Column) -> Column:
    """Words inside the windows that begin at the ascending positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def repeated_words(found: Column) -> Column:
    """Of an array of words, those inside windows that occur twice or more, the first occurrence included."""

    def twice(pairs: Column) -> Column:
        like = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, i: like(i - 1, x) | like(i + 1, x))
        return covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    def look(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i, WINDOW)))
    return F.when(F.size(found) >= WINDOW, let(windows, look)).otherwise(F.lit(0))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    own = [c for c in docs.columns if c != text]
    names = apart(own, BASE)
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda x, chars: F.length(F.translate(x, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: without(x, SPACES) > 0)
    counted = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")))
    measured = docs.select(
        *([F.struct(*own).alias("own")] if own else []),
        counted.alias("counted"),
        without(t, SPACES).cast("long").alias("word_chars"),
        (F.length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeats = F.col("counted.n").cast("long"), F.col("counted.repeats").cast("long")
    measured = measured.withColumns({"n_words": n, "n_repeat_words": repeats}).drop("counted")
    measured = measured.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return measured.select(*[F.col("own")[c].alias(names[c]) for c in own], *BASE)


def sketches(rates: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, bin, n, least, most): mergeable counts of the rates in bins of a sixteenth of an octave."""
    value, bits = F.col("value"), F.length(F.bin("value"))
    place = F.when(value < 16, value).otherwise(bits * 16 + F.call_function("shiftrightunsigned", value, bits - 5) % 16)
    binned = rates.withColumn("bin", place.cast("int"))
    return binned.groupBy(*by, "rate", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def fences(parts: DataFrame, by: list[str], least_docs: int) -> DataFrame:
    """(by, <rate>_low, <rate>_high) of groups with enough documents."""
    ordered = Window.partitionBy(*by, "rate").orderBy("bin")
    upto, n = F.sum("n").over(ordered), F.sum("n").over(Window.partitionBy(*by, "rate"))
    reached = parts.withColumns({"upto": upto, "of": n}).where(F.col("of") >= least_docs)
    quartiles = reached.groupBy(*by, "rate").agg(F.min(F.when(F.col("upto") * 4 >= F.col("of"), F.col("least"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("of") * 3, F.col("most"))).alias("q3"))
    width = F.greatest((F.col("q3") - F.col("q1")) * REACH, F.element_at(F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v[1]))]), F.col("rate")))
    sides = quartiles.select(*by, "rate", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))
    pick = [F.max(F.when(F.col("rate") == k, F.col(side))).alias(f"{k}_{side}") for k in RATES for side in ("low", "high")]
    return sides.groupBy(*by).agg(*pick)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST) -> DataFrame:
    """docs without the text, with the base measures, base_failed, the fences that held and kept."""
    own = [c for c in docs.columns if c != text]
    sides = [f"{k}_{side}" for k in RATES for side in ("low", "high")]
    names = apart(own, [*BASE, *sides, "kept"])
    inner = docs.select(F.col(text).alias("text"), F.col(lang).alias("fence_lang"), F.col(source).alias("fence_source"), *([F.struct(*own).alias("own")] if own else []))
    rows = written(base_measures(inner))
    rated = rows.where("n_words > 0").select(F.col("fence_lang").alias("lang"), F.col("fence_source").alias("source"), *[F.expr(v[0]).alias(k) for k, v in RATES.items()])
    long = rated.unpivot(["lang", "source"], list(RATES), "rate", "value")
    parts = written(sketches(long, ["lang", "source"]))
    by_lang = merged(parts, ["lang"])
    levels = [(["lang", "source"], parts, least_docs), (["lang"], by_lang, least_docs), ([], merged(by_lang, []), 1)]
    out = rows
    for at, (by, sketch, least) in enumerate(levels):
        found = fences(sketch, by, least).withColumnsRenamed({c: f"{c}_{at}" for c in sides} | {c: f"fence_{c}" for c in by})
        out = join_null_safe(out, found, [f"fence_{c}" for c in by], "left") if by else out.join(found, how="left")
    held = {c: F.coalesce(*[F.col(f"{c}_{at}") for at in range(len(levels))]) for c in sides}
    inside = ~F.col("base_failed")
    for k, (formula, _, low) in RATES.items():
        inside &= F.expr(formula) <= held[f"{k}_high"]
        if low:
            inside &= F.expr(formula) >= held[f"{k}_low"]
    return out.select(*[F.col("own")[c].alias(names[c]) for c in own], *BASE, *[v.alias(c) for c, v in held.items()], F.coalesce(inside, F.lit(False)).alias("kept"))


def _oracle() -> str:
    bin_ = "CASE WHEN value < 16 THEN value ELSE length(bin(value)) * 16 + (value >> (length(bin(value)) - 5)) % 16 END"
    rates = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v[1]} AS slack, {v[0].replace('div', '//')} AS value FROM measured WHERE n_words > 0" for k, v in RATES.items())

    def level(name: str, by: str, least: int) -> str:
        keys = f"{by}, " if by else ""
        same = " AND ".join(f"b.{c} IS NOT DISTINCT FROM q.{c}" for c in by.split(", ") if c) or "true"
        return f"""
{name}_b AS (SELECT {keys}rate, slack, {bin_} AS bin, count(*) AS n, min(value) AS least, max(value) AS most FROM rates GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}rate) AS total FROM {name}_b),
{name}_q AS (SELECT {keys}rate, min(least) FILTER (upto * 4 >= total) AS q1, min(most) FILTER (upto * 4 >= total * 3) AS q3, max(slack) AS slack FROM {name}_c WHERE total >= {least} GROUP BY ALL),
{name} AS (SELECT q.*, q1 - greatest((q3 - q1) * {REACH}, slack) AS low, q3 + greatest((q3 - q1) * {REACH}, slack) AS high FROM {name}_q q)"""

    checks = " AND ".join(
        f"{v[0].replace('div', '//')} <= (SELECT coalesce(a.high, l.high, g.high) FROM global_ g LEFT JOIN by_lang l ON l.rate = g.rate AND l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN by_source a ON a.rate = g.rate AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source WHERE g.rate = '{k}')"
        + (f" AND {v[0].replace('div', '//')} >= (SELECT coalesce(a.low, l.low, g.low) FROM global_ g LEFT JOIN by_lang l ON l.rate = g.rate AND l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN by_source a ON a.rate = g.rate AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source WHERE g.rate = '{k}')" if v[2] else "")
        for k, v in RATES.items()
    )
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split_ AS MATERIALIZED (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
wins AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM split_)),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
reps AS (SELECT rid, CAST(sum(least(8, i - coalesce(prev, -8))) AS BIGINT) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM twice) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
measured AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
             FROM docs d JOIN split_ s USING (rid) JOIN lines l USING (rid) LEFT JOIN reps r USING (rid)),
rates AS ({rates}),{level("by_source", "lang, source", LEAST)},{level("by_lang", "lang", LEAST)},{level("global_", "", 1)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN false ELSE {checks} END AS kept FROM measured m
"""


ORACLE_SQL = _oracle()
