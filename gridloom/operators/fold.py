"""Folds of pixels to cells, zones and days, and mergeable partial folds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.functions.scalars import above_floor, coded_value, ordered_code, present
from gridloom.sources.tables import discard, join_null_safe, written


def with_cell(pixels: DataFrame, level: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return pixels.withColumn("cell", grid.cell(F.col(lat), F.col(lon), level))


def fold_mean(pixels: DataFrame, level: int, value: str = "v", positive: bool = False, by: Iterable[str] = ()) -> DataFrame:
    """(by, cell, value, px): mean and count of present values; `positive` drops cells whose mean is not, zeros stay in it."""
    out = with_cell(pixels.where(present(F.col(value))), level).groupBy(*by, "cell").agg(F.avg(F.col(value).cast("double")).alias("value"), F.count(F.lit(1)).alias("px"))
    return out.where("value > 0") if positive else out


def fold_terrain(pixels: DataFrame, level: int, elev: str = "elev", floor: float = -100.0, eps: float = 0.01) -> DataFrame:
    """The mean fold of land alone."""
    return fold_mean(pixels.where(above_floor(F.col(elev), floor, eps)), level, elev)


def fold_hourly(cube: DataFrame, level: int, values: Iterable[str], time: str = "t") -> DataFrame:
    """(t, cell, values): means of several variables for each hour and cell."""
    return with_cell(cube, level).groupBy(time, "cell").agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def fold_mode(pixels: DataFrame, level: int, cls: str = "cls", by: Iterable[str] = ()) -> DataFrame:
    """(by, cell, cls, n, total, purity): the most frequent class, the smaller on ties."""
    by = list(by)
    counts = with_cell(pixels, level).groupBy(*by, "cell", cls).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "cell").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(cls).alias("c"))).alias("best"), F.sum("n").alias("total"))
    n = -F.col("best.m")
    return best.select(*by, "cell", F.col("best.c").alias(cls), n.alias("n"), "total", (n / F.col("total")).alias("purity"))


def fold_zone_hours(cube: DataFrame, mapping: DataFrame, value: str, time: str = "t") -> DataFrame:
    """(t, id, value, px) straight from the cube through a pixel mapping (y, x, id): a lookup of the size of the raster."""
    return cube.join(mapping, ["y", "x"]).groupBy(time, "id").agg(F.avg(F.col(value).cast("double")).alias("value"), F.count(F.lit(1)).alias("px"))


def rollup_daily(hourly: DataFrame, key: str, value: str, how: str = "mean", time: str = "t") -> DataFrame:
    f = {"mean": F.avg, "max": F.max}[how]
    return hourly.groupBy(F.date_trunc("day", time).alias("day"), key).agg(f(value).alias(value))


PARTIAL = ("s", "n", "mn", "mx")


def partial_fold(pixels: DataFrame, level: int, value: str = "v", by: Iterable[str] = ()) -> DataFrame:
    """(by, cell, s, n, mn, mx): sums that merge; persisted per tile, a new tile adds rows and recomputes nothing."""
    v = F.col(value).cast("double")
    return with_cell(pixels.where(present(F.col(value))), level).groupBy(*by, "cell").agg(F.sum(v).alias("s"), F.count(F.lit(1)).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx"))


def merge_partials(parts: DataFrame, keys: Iterable[str] = ("cell",)) -> DataFrame:
    """(keys, value, n, relief) of partial folds."""
    s, n = F.sum("s"), F.sum("n")
    return parts.groupBy(*keys).agg((s / F.nullif(n, F.lit(0))).alias("value"), n.alias("n"), (F.max("mx") - F.min("mn")).alias("relief"))


def join_partials(a: DataFrame, b: DataFrame, key: str = "cell") -> DataFrame:
    """Two partial folds side by side, cells of either kept: s, n of the first and s2, n2 of the second."""
    return a.join(b.select(key, F.col("s").alias("s2"), F.col("n").alias("n2")), key, "full")


def union_tiles(tiles: Iterable[DataFrame]) -> DataFrame:
    """Tiles as one table, though their columns, the order of these or their types differ: columns that a tile has not are null,
    a column of several numeric types gets the widest, one of other differing types is text."""
    tiles = list(tiles)
    types: dict[str, set[str]] = {}
    for t in tiles:
        for f in t.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    wide = ["tinyint", "smallint", "int", "bigint", "float", "double"]

    def common(found: set[str]) -> str | None:
        if len(found) == 1:
            return None
        if found <= set(wide):
            return "double" if found & {"float", "double"} and found & {"int", "bigint", "double"} else max(found, key=wide.index)
        return "string"

    cast = {c: to for c, found in types.items() if (to := common(found))}
    alike = [t.withColumns({c: F.col(c).cast(to) for c, to in cast.items() if c in t.columns}) for t in tiles]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


#: Rows of a search for ranks that may be sent to every task.
SENT = 10_000
#: Bits of the digits by which ranks are looked for, and how far they stand from the right.
DIGIT, SHIFTS = 16, (48, 32, 16, 0)


def radix_counts(df: DataFrame, keys: Iterable[str], value: str) -> DataFrame:
    """(keys, digit, n, low, high): how many present values have each leading digit of their ordered code, and the least and the
    greatest such code. Counts of tiles merge by `merged_counts`: 65536 digits for each of the keys at most, however many rows."""
    coded = df.where(present(F.col(value))).select(*keys, ordered_code(F.col(value).cast("double")).alias("code"))
    return _counted(coded, list(keys))


def merged_counts(parts: DataFrame, keys: Iterable[str]) -> DataFrame:
    return parts.groupBy(*keys, "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _counted(coded: DataFrame, by: list[str], shift: int = SHIFTS[0]) -> DataFrame:
    return coded.groupBy(*by, F.shiftright("code", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))


def between_values(low: Column, high: Column, part: Column) -> Column:
    """The straight line from one value to another: no sum of it overflows, and nothing is drawn towards an infinite end where the
    rank is a value's own."""
    span = high - low
    infinite = F.abs(span) == float("inf")
    return F.when((low == high) | (part == 0), low).when(infinite, low * (1 - part) + high * part).otherwise(low + span * part)


def quantiles_by(df: DataFrame, keys: Iterable[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ps): exact quantiles of the present values, between ranks as a straight line.

    No task holds a group's values. Values are coded as whole numbers of the same order, and a table of codes is written once. A
    pass counts the 16-bit digits below a prefix that holds a wanted rank and so lengthens it: four passes at most for any
    doubles, fewer where a digit holds one value. Infinities are values like others (between a finite value and an infinite
    one lies infinity, between both infinities NaN); -0.0 counts as 0.0."""
    keys = list(keys)
    base = written(df.where(present(F.col(value))).select(F.lit(0).alias("one"), *keys, ordered_code(F.col(value).cast("double")).alias("code")))
    by = ["one", *keys]
    counts = written(_counted(base, by))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(at(p)).cast("long").alias("rank"), (at(p) - F.floor(at(p))).alias("part")) for name, p in ps.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    wanted = sizes.select(*by, F.explode(ranks).alias("r")).select(*by, "r.*", F.lit(0).cast("long").alias("before"))
    named = [*by, "name", "side", "rank", "part"]
    found: DataFrame | None = None
    tables, prefix = [base, counts], []
    for shift in SHIFTS:
        if prefix:
            asked = wanted.select(*by, "prefix").distinct()
            small = F.broadcast(asked) if asked.count() <= SENT else asked
            met = join_null_safe(base.withColumn("prefix", F.shiftright("code", shift + DIGIT)), small, [*by, "prefix"])
            counts = _counted(met, [*by, "prefix"], shift)
        upto = F.sum("n").over(Window.partitionBy(*by, *prefix).orderBy("digit"))
        placed = counts.withColumn("upto", upto)
        hit = join_null_safe(placed, wanted, [*by, *prefix]).where("before + upto > rank AND before + upto - n <= rank")
        state = written(hit.select(*named, "low", "high", F.col("digit").alias("prefix"), (F.col("before") + F.col("upto") - F.col("n")).alias("before")))
        tables.append(state)
        done = state.where("low = high").select(*named, F.col("low").alias("code"))
        found = done if found is None else found.unionByName(done)
        wanted, prefix = state.where("low < high").select(*named, "prefix", "before"), ["prefix"]
        if wanted.isEmpty():
            break
    end = written(found)
    discard(*tables)
    side = lambda name, s: F.max(F.when((F.col("name") == name) & (F.col("side") == s), coded_value(F.col("code"))))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return end.groupBy(*by).agg(*[between_values(side(name, "low"), side(name, "high"), part(name)).alias(name) for name in ps]).drop("one")


def quantiles(df: DataFrame, value: str, ps: Iterable[float]) -> DataFrame:
    """One row of exact quantiles, named p2, p50, ...; none without a value."""
    return quantiles_by(df, [], value, {f"p{round(p * 100)}": p for p in ps})


def band_stats(df: DataFrame, band: str, value: str, at_least: float = 0.5) -> DataFrame:
    return df.groupBy(band).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col(value) >= at_least, 1.0).otherwise(0.0)).alias("share"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate: NaN where a side holds one value alone, at which Spark's own divides by zero and stops
    the query; null without pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    alike = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b)) | (spread == 0)
    return F.when(alike, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / spread)


def share_of_children(fine: DataFrame, up: int, flag: Column) -> DataFrame:
    """(parent, hits, share): flagged fine cells over all the children that a parent has."""
    return fine.groupBy(grid.parent(F.col("cell"), up).alias("parent")).agg(F.count_if(flag).alias("hits")).withColumn("share", F.least(F.lit(1.0), F.col("hits") / float(4**up)))


def row_index(df: DataFrame, key: str, name: str = "row", coarse: int = 1 << 31) -> DataFrame:
    """Rows numbered in order of a whole-number key, without a window over all of them: ranks inside stretches of the key, which
    are numbered by the rows of the stretches before (one row for each stretch)."""
    stretch = F.floor(F.col(key) / coarse)
    dealt = df.withColumn("stretch", stretch)
    sizes = dealt.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("stretch").orderBy(key)))
    return ranked.join(sizes.select("stretch", before.alias("before")), "stretch").withColumn(name, (F.col("before") + F.col("rn") - 1).cast("long")).drop("stretch", "rn", "before")
