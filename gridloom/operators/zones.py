"""Filling zones with cells, joins on the cell, and zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry, grid


def box_range(level: int | Column, w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """(first row, last row, first column, last column) of a level that a box (degrees) can touch. A box over the date line has
    w > e, or runs beyond 180; its columns go on beyond the last."""
    rows = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    cols = rows * 2
    row = lambda lat: F.greatest(F.lit(0.0), F.least(rows - 1, F.floor((1 + F.sin(F.radians(lat))) / 2 * rows))).cast("long")
    at = lambda lon: F.floor((lon + 180) / 360 * cols)
    first = at(w).cast("long")
    last = F.when(e < w, at(e) + cols).when(e <= 180, F.least(cols - 1, at(e))).otherwise(at(e)).cast("long")
    return row(s), row(n), first, F.greatest(first, F.least(last, first + cols.cast("long") - 1))


def candidates(level: int, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Array of the cells of a level that a small box (degrees) can touch."""
    south, north, first, last = box_range(level, w, s, e, n)
    return F.flatten(F.transform(F.sequence(south, north), lambda r: F.transform(F.sequence(first, last), lambda c: grid.made(level, r, F.pmod(c, F.lit(2 << level))))))


def with_candidates(df: DataFrame, level: int, w: Column, s: Column, e: Column, n: Column, name: str = "cell") -> DataFrame:
    """df with each cell of a level that a box (degrees) can touch: rows of the grid first, then columns, so that no array holds
    a box's cells."""
    south, north, first, last = box_range(level, w, s, e, n)
    rows = df.select("*", first.alias("first_"), last.alias("last_"), F.explode(F.sequence(south, north)).alias("row_"))
    each = rows.select("*", F.explode(F.sequence("first_", "last_")).alias("col_"))
    return each.withColumn(name, grid.made(level, F.col("row_"), F.pmod("col_", F.lit(2 << level)))).drop("first_", "last_", "row_", "col_")


#: Cells that an area begins with, and degrees by which a cell's box is widened so that rounding never cuts an edge off.
COARSE, PAD = 64, 1e-9


def cover(areas: DataFrame, level: int, ring: str = "ring", names: tuple[str, str, str, str] = ("cell", "turn", "inside", "edges")) -> DataFrame:
    """areas, without their rings, with the cells of a level that they touch: (cell, turn, inside, edges), or under other names.

    A quadtree: an area begins with some tens of coarse cells, and only those that its ring crosses are looked at again, split in
    sixteen, down to the level. A cell that no edge meets is inside or outside as a whole; what is inside is split without any
    test. No row holds more than the edges that can decide for its cell: those go with the cells that the ring crosses, and
    `geometry.edges_contain` settles a place of such a cell at longitude + `turn` (the turn is that of cells beyond the date
    line). Cells of one large area are dealt out once they are some hundreds."""
    w, s, e, n = geometry.envelope(F.col(ring))
    share = F.greatest((e - w) / 360, F.lit(1e-12)), F.greatest((F.sin(F.radians(n)) - F.sin(F.radians(s))) / 2, F.lit(1e-12))
    fits = F.least((F.log2(COARSE / 2 / (share[0] * share[1]))) / 2, F.log2(COARSE / F.greatest(share[0] * 2, share[1])))
    began = F.greatest(F.lit(0), F.least(F.lit(level), F.floor(fits).cast("int")))
    own = ["own_"]  # the areas' other columns, whatever their names
    areas = areas.select(F.struct(*[c for c in areas.columns if c != ring]).alias("own_"), ring)
    lowest = areas.agg(F.min(began)).first()[0]  # how often the coarsest is split
    south, north, first, last = box_range(F.col("lv"), w, s, e, n)
    rows = dealt(areas).withColumn("lv", began).select(*own, "lv", geometry.edges_of(F.col(ring)).alias("edges"), F.lit(False).alias("inside"), first.alias("first_"), last.alias("last_"), F.explode(F.sequence(south, north)).alias("row"))
    cells = rows.select(*own, "lv", "edges", "inside", "row", F.explode(F.sequence("first_", "last_")).alias("col"))

    def settled(df: DataFrame) -> DataFrame:
        box = [c + d for c, d in zip(grid.rectangle(F.col("lv"), F.col("row"), F.col("col")), (-PAD, -PAD, PAD, PAD), strict=True)]
        cut = F.when(F.col("inside"), F.filter("edges", lambda g: F.lit(False))).otherwise(geometry.edges_beside(F.col("edges"), box[0], box[1], box[3]))
        held = df.withColumns({"w_": box[0], "s_": box[1], "e_": box[2], "n_": box[3], "edges": cut})
        crossed = geometry.edges_cross(F.col("edges"), *[F.col(c) for c in ("w_", "s_", "e_", "n_")])
        middle = geometry.edges_contain(F.col("edges"), (F.col("w_") + F.col("e_")) / 2, (F.col("s_") + F.col("n_")) / 2)
        told = held.withColumn("state", F.when(F.col("inside"), "in").when(crossed, "edge").when(middle, "in").otherwise("out")).where("state != 'out'")
        return told.select(*own, "lv", "row", "col", F.when(F.col("state") == "edge", F.col("edges")).otherwise(F.filter("edges", lambda g: F.lit(False))).alias("edges"), (F.col("state") == "in").alias("inside"))

    now = settled(cells)
    steps = 0 if lowest is None else -(-(level - lowest) // 2)
    for step in range(steps):
        if step == 1:
            now = now.repartition("lv", "row", "col")
        m = F.when(F.col("lv") >= level, 1).when(F.col("lv") == level - 1, 2).otherwise(4)
        split = now.withColumn("m", m).select(*own, "lv", "edges", "inside", "row", "col", "m", F.explode(F.sequence(F.lit(0), F.col("m") * F.col("m") - 1)).alias("i"))
        deep = F.col("lv") + F.when(F.col("m") == 4, 2).when(F.col("m") == 2, 1).otherwise(0)
        down = split.select(*own, deep.alias("lv"), "edges", "inside", (F.col("row") * F.col("m") + F.floor(F.col("i") / F.col("m"))).alias("row"), (F.col("col") * F.col("m") + F.col("i") % F.col("m")).alias("col"))
        now = settled(down)
    col = F.pmod("col", F.lit(2 << level))
    made = (grid.made(level, F.col("row"), col), (F.col("col") - col) / (2 << level) * 360, F.col("inside"), F.col("edges"))
    return now.select("own_.*", *[c.alias(n) for c, n in zip(made, names, strict=True)])


def between_lons(lon: Column, w: Column, e: Column) -> Column:
    """Half open in longitude, also over the date line (w > e, or an end beyond 180)."""
    plain = (lon >= w) & (lon < e)
    return F.when(e < w, (lon >= w) | (lon < e)).when(e > 180, plain | (lon + 360 < e)).when(w < -180, plain | (lon - 360 >= w)).otherwise(plain)


def fill_centres(zones: DataFrame, level: int, ring: str = "ring", key: str = "id") -> DataFrame:
    """(id, cell): cells whose centre is inside the ring. A row is one piece; pieces of an id are united by the distinct. A ring
    over the date line runs beyond 180 (or -180)."""
    touched = cover(zones.select(key, ring), level, ring)
    lat, lon = grid.centre(F.col("cell"))
    held = F.col("inside") | geometry.edges_contain(F.col("edges"), lon + F.col("turn"), lat)
    return touched.where(held).select(key, "cell").distinct()


def fill_boxes(zones: DataFrame, level: int, key: str = "id", pieces: bool = True) -> DataFrame:
    """The centre rule for boxes (w, s, e, n), half open. Without `pieces` each id has one box, whose cells are distinct as they are."""
    boxed = with_candidates(zones.select(key, "w", "s", "e", "n"), level, *map(F.col, "wsen"))
    lat, lon = grid.centre(F.col("cell"))
    filled = boxed.where(between_lons(lon, F.col("w"), F.col("e")) & (lat >= F.col("s")) & (lat < F.col("n"))).select(key, "cell")
    return filled.distinct() if pieces else filled


def fill_touched(objects: DataFrame, level: int, key: str = "id") -> DataFrame:
    """The overlap rule for boxes (w, s, e, n): every cell that a box touches, so that each object has one at least."""
    return with_candidates(objects.select(key, "w", "s", "e", "n"), level, *map(F.col, "wsen")).select(key, "cell").distinct()


def single_owner(mapping: DataFrame, key: str = "id") -> DataFrame:
    """(cell, id): the smallest id that has the cell."""
    return mapping.groupBy("cell").agg(F.min(key).alias(key))


def zonal_mean(cells: DataFrame, mapping: DataFrame, value: str = "value", key: str = "id") -> DataFrame:
    """(id, value, cells): all cells weigh alike, as they are of one area. Either side may be large: joined on the cell."""
    return mapping.join(cells.select("cell", value), "cell").groupBy(key).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("cells"))


def with_names(zonal: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """Zones with their attributes; zones that no cell reached have no row, never a 0."""
    return zonal.join(names, key)


def unreached(names: DataFrame, zonal: DataFrame, key: str = "id") -> DataFrame:
    return names.join(zonal.select(key), key, "left_anti")


def top_zones(zonal: DataFrame, n: int, value: str = "value", key: str = "id") -> DataFrame:
    return zonal.orderBy(F.col(value).desc(), key).limit(n)


def first_with_rows(ranked: DataFrame, ladder: str, order: list[str]) -> DataFrame:
    """Of rows on several rungs, those of the first rung in `order` that has any."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(ladder))
    first = ranked.where(place > 0).agg(F.min(place).alias("first"))
    return ranked.join(F.broadcast(first), place == F.col("first")).drop("first")  # one row


def ranked_on_ladder(cells: DataFrame, pieces: DataFrame, order: list[str], n: int, value: str = "value", key: str = "id") -> DataFrame:
    """(rung, id, value, cells): the n zones with the greatest mean on the first rung of `order` on which any zone has a cell.

    `pieces` (rung, id, cell) holds the fills of all rungs: one join and one aggregate for the whole ladder."""
    zonal = pieces.join(cells.select("cell", value), "cell").groupBy("rung", key).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("cells"))
    return first_with_rows(zonal, "rung", order).orderBy(F.col(value).desc(), key).limit(n)


def points_in(points: DataFrame, areas: DataFrame, level: int, ring: str = "ring", x: str = "lon", y: str = "lat") -> DataFrame:
    """Points with the areas that hold them: an equi-join on the areas' covering cells, then, in cells that a ring crosses, the
    exact test against the edges beside the cell. Points of cells that lie inside need no test.

    The cover keeps a large area's points apart by cell, so no area's points meet in one task."""
    covering = cover(areas, level, ring, ("at", "turn_", "inside_", "edges_"))
    met = points.withColumn("at", grid.cell(F.col(y), F.col(x), level)).join(covering, "at")
    held = F.col("inside_") | geometry.edges_contain(F.col("edges_"), F.col(x) + F.col("turn_"), F.col(y))
    return met.where(held).drop("at", "turn_", "inside_", "edges_")


def dealt(areas: DataFrame) -> DataFrame:
    """Areas over all cores: a file of many small ones may be one task's, and each becomes many rows."""
    return areas.repartition(2 * areas.sparkSession.sparkContext.defaultParallelism)


def points_in_small(points: DataFrame, areas: DataFrame, level: int, ring: str = "ring", x: str = "lon", y: str = "lat") -> DataFrame:
    """`points_in` for very many areas that span a few cells of the level each, such as footprints: an equi-join on the cells that an
    area's box can touch, then the exact test against its whole ring. No cover is made, as most of its cells would hold no point."""
    w, s, e, n = geometry.envelope(F.col(ring))
    boxed = dealt(areas).withColumns({"w_": w - PAD, "s_": s - PAD, "e_": e + PAD, "n_": n + PAD})
    south, north, first, last = box_range(level, *map(F.col, ("w_", "s_", "e_", "n_")))
    rows = boxed.withColumns({"first_": first, "last_": last, "row_": F.explode(F.sequence(south, north))})
    each = rows.withColumn("col_", F.explode(F.sequence("first_", "last_")))
    col = F.pmod("col_", F.lit(2 << level))
    placed = each.withColumns({"at": grid.made(level, F.col("row_"), col), "turn_": (F.col("col_") - col) / (2 << level) * 360}).drop("first_", "last_", "row_", "col_")
    met = points.withColumn("at", grid.cell(F.col(y), F.col(x), level)).join(placed, "at")
    near = F.col(y).between(F.col("s_"), F.col("n_")) & (F.col(x) + F.col("turn_")).between(F.col("w_"), F.col("e_"))
    held = near & geometry.contains(F.col(ring), F.col(x) + F.col("turn_"), F.col(y))
    return met.where(held).drop("at", "turn_", "w_", "s_", "e_", "n_", ring)


def parent_join(fine: DataFrame, coarse: DataFrame, up: int, how: str = "left") -> DataFrame:
    """Fine cells with the values of the coarse cell that they sit in; no match stays null."""
    return fine.withColumn("parent", grid.parent(F.col("cell"), up)).join(coarse.withColumnRenamed("cell", "parent"), "parent", how).drop("parent")


def worst_class(objects: DataFrame, zone_cells: DataFrame, key: str = "id") -> DataFrame:
    """(id, zc): the worst class of an object's cells, -1 where none is rated."""
    return objects.join(zone_cells, "cell", "left").groupBy(key).agg(F.coalesce(F.max("zc"), F.lit(-1)).alias("zc"))


def widened(mapping: DataFrame, k: int = 1, key: str = "id") -> DataFrame:
    """A mapping and the rings around it."""
    return mapping.select(key, F.explode(grid.disk(F.col("cell"), k)).alias("cell")).distinct()


def rank_in(df: DataFrame, keys: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
