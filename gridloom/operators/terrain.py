"""Terrain on cells and rasters: rebasing, relief, flow, focal means, hillshade, sampling, mosaics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import grid, proj
from gridloom.functions.scalars import present
from gridloom.operators.fold import quantiles
from gridloom.operators.zones import with_candidates


def rebased(df: DataFrame, value: str = "elev") -> DataFrame:
    """Values over the lowest of the scene: one number is read first, instead of a window over all rows in one task."""
    low = df.agg(F.min(value)).first()[0]
    return df.withColumn(value, F.col(value) - F.lit(low))


def relief_floor(df: DataFrame, value: str = "elev", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values over a low percentile, not below 0, and the relief between the percentiles; empty values (0, NaN) don't count."""
    row = quantiles(df.where(F.col(value) != 0), value, [low, high]).first()
    p2, p98 = row or (None, None)
    return df.withColumns({"over": F.greatest(F.col(value) - F.lit(p2), F.lit(0.0)), "relief": F.lit(None if p2 is None else p98 - p2)})


def flow(cells: DataFrame, value: str = "value", k: int = 1) -> DataFrame:
    """(cell, flow): the mean over a cell's disk less its own value; missing neighbours drop out."""
    around = cells.select(F.col("cell").alias("own"), F.explode(grid.disk(F.col("cell"), k)).alias("cell"))
    mean = around.join(cells.select("cell", value), "cell").groupBy("own").agg(F.avg(value).alias("mean"))
    return cells.join(mean.withColumnRenamed("own", "cell"), "cell").select("cell", (F.col("mean") - F.col(value)).alias("flow"))


def adjacency(cells: DataFrame) -> DataFrame:
    """(cell, neighbour) of cells that are both in the set."""
    around = cells.select("cell", F.explode(grid.neighbours(F.col("cell"))).alias("neighbour"))
    return around.join(cells.select(F.col("cell").alias("neighbour")), "neighbour").select("cell", "neighbour")


def focal_mean(raster: DataFrame, radius: int, value: str = "v", by: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """(by, y, x, mean): the mean over a square of pixels, of those that have a value.

    Pixels go to square tiles of `tile` or twice the radius a side, with a margin of the radius: few are sent twice, whatever the
    radius. In a tile, running sums of values and of counts give each square's sum by its four corners. A missing pixel takes
    nothing from its neighbours; every row of the raster gets a mean, also one whose own value is missing (null or NaN), null
    where the whole square is."""
    side = max(tile, 2 * radius)
    home = lambda c: F.floor(F.col(c) / side).cast("long")
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side).cast("long"), F.floor((F.col(c) + radius) / side).cast("long")))
    held = raster.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(present(F.col(value)), F.col(value).cast("double")).alias("v_"))
    dealt = held.withColumn("ty_", reach("y")).withColumn("tx_", reach("x"))
    dealt = dealt.withColumn("own_", (F.col("ty_") == home("y")) & (F.col("tx_") == home("x"))).where("own_ OR v_ IS NOT NULL")
    wide = side + 2 * radius
    kinds = [f"`{c}` {raster.schema[c].dataType.simpleString()}" for c in by]

    def means(key: tuple, rows: pa.Table) -> pa.Table:
        y0, x0 = key[-2].as_py() * side - radius, key[-1].as_py() * side - radius
        y, x = (rows[c].to_numpy() for c in ("y", "x"))
        v = rows["v_"].to_numpy()  # NaN where missing
        sums = np.zeros((2, wide + 1, wide + 1))
        there = ~np.isnan(v)
        np.add.at(sums[0], (y[there] - y0 + 1, x[there] - x0 + 1), v[there])
        np.add.at(sums[1], (y[there] - y0 + 1, x[there] - x0 + 1), 1)
        sums = sums.cumsum(axis=1).cumsum(axis=2)
        own = rows["own_"].to_numpy(zero_copy_only=False)
        y, x = y[own], x[own]
        top, left = y - y0 - radius, x - x0 - radius
        span = 2 * radius + 1
        total, n = (c[top + span, left + span] - c[top, left + span] - c[top + span, left] + c[top, left] for c in sums)
        mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0.5)
        return pa.table({**{c: pa.array([k.as_py()] * len(y), k.type) for c, k in zip(by, key, strict=False)}, "y": y, "x": x, "mean": pa.array(mean, mask=n < 0.5)})

    out = dealt.groupBy(*by, "ty_", "tx_").applyInArrow(means, ", ".join([*kinds, "y long", "x long", "mean double"]))
    return out.withColumns({c: F.col(c).cast(raster.schema[c].dataType) for c in ("y", "x")})


def hillshade(raster: DataFrame, size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, value: str = "v", by: tuple[str, ...] = (), size_y: float | None = None, scale: float = 1.0, inside: Column | None = None) -> DataFrame:
    """Shade 0..1 of a surface whose rows run north: the sun on its normal, from central differences, one-sided where a
    neighbour is missing. `size` is a pixel's width, `size_y` its height (the same by default), `scale` exaggerates heights.

    Rasters in tiles (`by`) are given with a margin of one pixel at least, so that seams have central differences too; `inside`
    then picks the tile's own pixels of the result."""

    def slope(along: str, across: str, step: float) -> Column:
        w = Window.partitionBy(*by, across).orderBy(along)
        near = lambda c, d: F.when(F.abs(c(along).over(w) - F.col(along)) == 1, c(value).over(w))
        before, after = near(F.lag, -1), near(F.lead, 1)
        both = (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) * scale / step
        return F.when(before.isNotNull() & after.isNotNull(), both / 2).otherwise(both)

    sloped = raster.withColumns({"dx": slope("x", "y", size), "dy": slope("y", "x", size_y or size)})
    alt, az = math.radians(altitude), math.radians(azimuth)
    facing = -F.col("dx") * (math.cos(alt) * math.sin(az)) - F.col("dy") * (math.cos(alt) * math.cos(az)) + math.sin(alt)
    shade = facing / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    shaded = sloped.select(*by, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("shade"))
    return shaded if inside is None else shaded.where(inside)


def bilinear(points: DataFrame, raster: DataFrame, height: int, width: int, row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """Points with the value of a raster of so many rows and columns between its pixel centres (0, 1, ...).

    Valid to the edge of the outer pixels: the outer half pixel goes on with the slope of the last pair, so that rasters that
    touch leave no crack. Points beyond, or with one of the four pixels missing, have no row."""
    r0, c0 = (F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor(p))).cast("int") for p, n in ((row, height), (col, width)))
    ty, tx = F.col(row) - r0, F.col(col) - c0
    corner = lambda dr, dc: F.struct((r0 + dr).alias("y"), (c0 + dc).alias("x"), ((ty if dr else 1 - ty) * (tx if dc else 1 - tx)).alias("weight"))
    valid = points.where(F.col(row).between(-0.5, height - 0.5) & F.col(col).between(-0.5, width - 0.5))
    four = valid.withColumn("corner", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).select(*points.columns, "corner.*")
    hit = four.join(raster.where(present(F.col(value))).select("y", "x", value), ["y", "x"])
    summed = hit.groupBy(*points.columns).agg(F.sum(F.col("weight") * F.col(value)).alias("sample"), F.count(F.lit(1)).alias("n"))
    return summed.where("n = 4").drop("n")


def depth_inside(x: Column, y: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """How far inside a box a place is: 0 at its edge, a half in its middle, whatever the size of the box."""
    along = lambda v, a, b: F.least(v - a, b - v) / F.greatest(b - a, F.lit(1e-12))
    return F.least(along(x, w, e), along(y, s, n))


def mosaic(pixels: DataFrame, footprints: DataFrame, value: str = "v") -> DataFrame:
    """(y, x, value, depth, sources): of the sources (source, y, x, lon, lat, value) over a place, that whose footprint
    (source, w, s, e, n) has it deepest inside, the first on ties. Places outside a source's footprint are not its own."""
    placed = pixels.where(present(F.col(value))).join(footprints.select("source", "w", "s", "e", "n"), "source")
    deep = placed.withColumn("depth", depth_inside(F.col("lon"), F.col("lat"), *map(F.col, "wsen"))).where("depth >= 0")
    best = F.struct("depth", -F.col("source"))
    return deep.groupBy("y", "x").agg(F.max_by(value, best).alias(value), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("sources"))


def source_pixels(places: DataFrame, sources: DataFrame, level: int = 6) -> DataFrame:
    """places (lon, lat, ...) with source, row, col and depth for each source whose footprint has them.

    Sources differ in projection and pixel size: (source, kind, left, top, dx, dy, w, s, e, n), where kind is `degrees`, `albers`
    (metres) or `webmap` (pixels of the world map at zoom 0 of 256 pixels, rows run down), left and top the raster's corner, dx
    and dy the size of a pixel, and w to n the footprint in degrees. A place is carried into each source's own units, which
    gives the row and column of its pixel. Footprints meet places by cells of a level, so no place looks at all sources."""
    reach = with_candidates(sources, level, *map(F.col, "wsen"), name="at")
    met = places.withColumn("at", grid.cell(F.col("lat"), F.col("lon"), level)).join(reach, "at")
    met = met.where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    ax, ay = proj.albers(F.col("lon"), F.col("lat"))
    mx, my = proj.mercator_pixel(F.col("lon"), F.col("lat"), 0)
    along = F.when(F.col("kind") == "albers", ax).when(F.col("kind") == "webmap", mx).otherwise(F.col("lon")) - F.col("left")
    down = F.when(F.col("kind") == "webmap", my - F.col("top")).when(F.col("kind") == "albers", F.col("top") - ay).otherwise(F.col("top") - F.col("lat"))
    col, row = F.floor(along / F.col("dx")).cast("int"), F.floor(down / F.col("dy")).cast("int")
    return met.select(*places.columns, "source", row.alias("row"), col.alias("col"), depth_inside(F.col("lon"), F.col("lat"), *map(F.col, "wsen")).alias("depth"))


def mosaic_by_lookup(lattice: DataFrame, sources: DataFrame, pixels: DataFrame, level: int = 6, value: str = "v") -> DataFrame:
    """(y, x, value, depth, source): for each place of a lattice (y, x, lon, lat) the pixel of the source that has it deepest inside
    its footprint, the first on ties; places that no source has a value for have no row. See `source_pixels` for the sources;
    pixels are (source, row, col, value), met by an equi-join."""
    asked = source_pixels(lattice.select("y", "x", "lon", "lat"), sources, level).drop("lon", "lat")
    hit = asked.join(pixels.where(present(F.col(value))).select("source", "row", "col", value), ["source", "row", "col"])
    best = F.max_by(F.struct(value, "source"), F.struct("depth", -F.col("source"))).alias("best")
    return hit.groupBy("y", "x").agg(best, F.max("depth").alias("depth")).select("y", "x", F.col("best")[value].alias(value), "depth", F.col("best.source").alias("source"))


def covered_share(lattice: DataFrame, made: DataFrame) -> DataFrame:
    """One row: the share of a lattice's places (y, x) that a mosaic has."""
    hit = lattice.select("y", "x").join(made.select("y", "x", F.lit(1.0).alias("hit")), ["y", "x"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"), F.count(F.lit(1)).alias("places"))


def painted(lattice: DataFrame, cells: DataFrame, level: int, value: str = "value") -> DataFrame:
    """A lattice (lat, lon) with its cells' values; a missing cell is null."""
    return lattice.withColumn("cell", grid.cell(F.col("lat"), F.col("lon"), level)).join(cells.select("cell", value), "cell", "left")


def raised(lattice: DataFrame, inside: DataFrame, base: DataFrame, scale: float = 1.0) -> DataFrame:
    """A surface (y, x, ground) under buildings: `inside` has (id, y, x, height), `base` the ground (id, base) at each one's centroid."""
    tops = inside.join(base, "id").groupBy("y", "x").agg(F.max(F.col("base") + F.col("height") * scale).alias("top"))
    return lattice.join(tops, ["y", "x"], "left").select("y", "x", F.greatest("ground", F.coalesce("top", "ground")).alias("surface"))


def footprint_counts(buildings: DataFrame, inside: DataFrame, base: DataFrame) -> DataFrame:
    """One row: buildings (id, height) that raise a lattice (stamped), those between its places (unresolved), and those without
    a height or without ground under them (dropped)."""
    live = buildings.withColumn("live", F.coalesce(F.col("height") > 0, F.lit(False)))
    with_base = live.join(base.select("id", F.lit(True).alias("based")).distinct(), "id", "left")
    with_all = with_base.join(inside.select("id", F.lit(True).alias("held")).distinct(), "id", "left")
    ok = F.col("live") & F.coalesce("based", F.lit(False))
    held = F.coalesce("held", F.lit(False))
    return with_all.agg(F.count_if(ok & held).alias("stamped"), F.count_if(ok & ~held).alias("unresolved"), F.count_if(~ok).alias("dropped"))
