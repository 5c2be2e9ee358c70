"""Connected regions of cells or pixels, their outlines, blobs and tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators.components import components
from gridloom.sources.tables import written


def labelled(nodes: DataFrame, keys: list[str], node: str, neighbours: Callable[[Column], Column]) -> DataFrame:
    """nodes with `label`, the smallest node that can be reached inside the same keys.

    Nodes get numbers in the order of their place, neighbours inside the keys become edges, and the components of those give
    the labels. Edges are dealt by ranges of numbers, so that regions are put together inside partitions first and only what
    crosses their borders is left to the rounds.
    """
    base = written(nodes.select(*keys, node).distinct().repartitionByRange(*keys, node).sortWithinPartitions(*keys, node).withColumn("number", F.monotonically_increasing_id()))
    near = base.select(*keys, F.col("number").alias("u"), F.explode(neighbours(F.col(node))).alias("near"))
    edges = near.join(base.withColumnsRenamed({node: "near", "number": "v"}), [*keys, "near"]).where("u > v").select("u", "v")
    linked = components(edges.repartitionByRange("u")).withColumnRenamed("node", "number")
    rooted = base.join(linked, "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = rooted.groupBy("root").agg(F.min(node).alias("label"))
    return nodes.join(rooted.join(least, "root").select(*keys, node, "label"), [*keys, node])


def cell_regions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, cell) with the label of their connected region inside the keys."""
    return labelled(cells, keys, "cell", grid.neighbours)


PIXEL = 1 << 32


def pixel_regions(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x) with the label of their connected region, four neighbours."""
    near = lambda p: F.array(p - 1, p + 1, p - PIXEL, p + PIXEL)
    return labelled(px.withColumn("pixel", F.col("y").cast("long") * PIXEL + F.col("x")), keys, "pixel", near)


def patches(regions: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, cells, patches, largest): regions of at least so many cells."""
    sizes = regions.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return sizes.groupBy(*keys).agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("patches"), F.max("n").alias("largest"))


def blobs(regions: DataFrame, keys: list[str], level: int, least_km2: float = 0.0) -> DataFrame:
    """(keys, label, cells, km2, lat, lon): area and mean centre of each region, without the small ones."""
    lat, lon = grid.centre(F.col("cell"))
    out = regions.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cells"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))
    return out.withColumn("km2", F.col("cells") * grid.area_km2(level)).where(F.col("km2") >= least_km2)


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, dir, x1, y1, x2, y2): the sides of a set's cells whose neighbour is not in it."""
    sides = cells.select(*keys, "cell", F.inline(grid.edges(F.col("cell"))))
    return sides.join(cells.select(*keys, F.col("cell").alias("neighbour")), [*keys, "neighbour"], "left_anti").drop("neighbour")


def pixel_boundary(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, dir): the sides of pixels whose neighbour is not of the same keys."""
    steps = F.array(*[F.struct(F.lit(d).alias("dir"), (F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for d, (dx, dy) in grid.EDGES.items()])
    sides = px.select(*keys, "y", "x", F.inline(steps))
    return sides.join(px.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx")), [*keys, "ny", "nx"], "left_anti").select(*keys, "y", "x", "dir")


def track(found: DataFrame, by: list[str], size: str = "km2", label: str = "label") -> DataFrame:
    """The largest blob of each frame, the smaller label on ties."""
    w = Window.partitionBy(*by).orderBy(F.col(size).desc(), label)
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def summary(found: DataFrame, by: list[str], frame: str = "f") -> DataFrame:
    """(by, blobs, largest, at_frame): how many blobs, the largest area and the first frame that had it."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("blobs"), F.max("km2").alias("largest"), F.max_by(F.col(frame), F.struct("km2", -F.col(frame))).alias("at_frame"))
