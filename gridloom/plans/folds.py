"""Queries of sources, scalar functions and folds."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, grid, proj, scalars
from gridloom.operators import fold, heat, zones
from gridloom.plans.registry import Views, cell_sql, query
from gridloom.sources import tables

C7, C6, C9 = cell_sql(7), cell_sql(6), cell_sql(9)
#: SQL for the cell parts.
ROW, COL = "((cell >> 29) % 536870912)", "(cell % 536870912)"


ALB = f"(1 - {proj.E2}) * (s / (1 - {proj.E2} * s * s) - ln((1 - {proj.E} * s) / (1 + {proj.E} * s)) / (2 * {proj.E}))"
ALBERS_SQL = f"SELECT y, x, lat, lon, rho * sin(th) AS ax, {proj.RHO0} - rho * cos(th) AS ay FROM (SELECT *, {proj.A} * sqrt({proj.C} - {proj.N} * {ALB}) / {proj.N} AS rho, {proj.N} * (radians(lon) - {proj.LON0}) AS th FROM (SELECT DISTINCT y, x, lat, lon, sin(radians(lat)) AS s FROM px))"


def r(c: Column | str, n: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- sources

@query("s2_time_window", "WITH d AS (SELECT date_trunc('day', min(t)) AS a FROM cube) SELECT t, x, y, tc FROM cube, d WHERE t >= a AND t < a + INTERVAL 3 DAY", "cube")
def _(v: Views) -> DataFrame:
    """Three days, given the wrong way round and from before the store begins."""
    first, last = v.cube.agg(F.min("t"), F.max("t")).first()
    day = datetime.timedelta(days=1)
    a, b = tables.time_window(str((first + 2 * day).date()), str((first - day).date()), str(first.date()), str(last.date()), 14)
    return tables.in_time(v.cube, a, b).select("t", "x", "y", "tc")


@query("s3_space_window", "SELECT year, y, x, v FROM px WHERE lon BETWEEN -110 AND -90 AND lat BETWEEN 30 AND 42", "px")
def _(v: Views) -> DataFrame:
    return tables.in_box(v.px, -110, 30, -90, 42).select("year", "y", "x", "v")


def pyramid(v: Views, steps: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Levels of a raster: the means of blocks of pixels, placed at their first pixel."""
    k = F.explode(F.array(*[F.lit(x) for x in steps])).alias("level")
    first = lambda c: (F.floor(F.col(c) / F.col("level")) * F.col("level")).cast("int").alias(c)
    return v.px.select("y", "x", "v", k).groupBy("level", first("y"), first("x")).agg(F.avg("v").alias("v"))


PYRAMID = "lv AS (SELECT k AS level, y // k * k AS y, x // k * k AS x, avg(v) AS v FROM px, (VALUES (1), (2), (4), (8)) t(k) GROUP BY ALL)"


@query("s4_level_choice", f"WITH {PYRAMID} SELECT level, y, x, round(v, 9) AS v FROM lv WHERE level = 4", "px")
def _(v: Views) -> DataFrame:
    """A view of 25 degrees on 200 pixels asks for cells of level 7, these for a level of the pyramid: one partition of it."""
    level = tables.level_in_view(-110.0, -85.0, 200, 9, {5: 8, 7: 4, 9: 1})
    path = tables.new_path(v.spark)
    pyramid(v).write.partitionBy("level").parquet(path)
    return tables.grid_table(v.spark, path, level).select("level", "y", "x", r("v").alias("v"))


@query("s4_s5_level_budget", f"WITH {PYRAMID}, c AS (SELECT level, count(*) AS n FROM lv GROUP BY level) SELECT level, n, level = coalesce((SELECT min(level) FROM c WHERE n <= 300), 8) AS chosen FROM c", "px")
def _(v: Views) -> DataFrame:
    levels = pyramid(v)
    best = tables.level_in_budget(levels, 300)
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("chosen", F.col("level") == F.lit(best))


@query("s5_budget_in_box", f"WITH {PYRAMID}, b AS (SELECT * FROM lv WHERE x BETWEEN 4 AND 44 AND y BETWEEN 4 AND 40), c AS (SELECT k AS level, 1440.0 / (k * k) AS bound, (SELECT count(*) FROM b WHERE level = k) AS n FROM (VALUES (1), (2), (4), (8)) t(k)) SELECT level, y, x, round(v, 9) AS v FROM b WHERE level = coalesce((SELECT min(level) FROM c WHERE level < 8 AND (bound <= 200 OR bound <= 4800 AND n <= 200)), 8)", "px")
def _(v: Views) -> DataFrame:
    levels = pyramid(v)
    best = tables.level_for_box(levels, [1, 2, 4, 8], (4, 4, 44, 40), 1.0, 200)
    return tables.in_box(levels.where(F.col("level") == best), 4, 4, 44, 40, "x", "y").select("level", "y", "x", r("v").alias("v"))


@query("s6_bbox_scan", "SELECT id, cx, cy FROM fields WHERE cx - r > -115 AND cx + r < -85 AND cy - r > 28 AND cy + r < 40", "fields")
def _(v: Views) -> DataFrame:
    """Features stored with their boxes, as struct columns: the comparisons reach the scan."""
    x, y, rr = F.col("cx"), F.col("cy"), F.col("r")
    stored = tables.written(v.fields.withColumn("bbox", F.struct((x - rr).alias("xmin"), (y - rr).alias("ymin"), (x + rr).alias("xmax"), (y + rr).alias("ymax"))))
    return stored.where(tables.strictly_inside(-115, 28, -85, 40)).select("id", "cx", "cy")


def filed(v: Views) -> str:
    """The raster as a table of four files, one for each sixteen columns; the folder."""
    path = tables.new_path(v.spark)
    v.px.withColumn("strip", F.floor(F.col("x") / 16)).repartition("strip").write.partitionBy("strip").parquet(path)
    return path


@query("s7_s8_extent_index", "SELECT CAST(x // 16 AS INT) AS strip, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, min(lon) <= -105 AND max(lon) >= -124 AND min(lat) <= 26 AND max(lat) >= 24 AS read FROM px GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    index = tables.file_index(v.spark, filed(v), "lon", "lat")
    hit = tables.files_over(index, -124, 24, -105, 26).select("file", F.lit(True).alias("read"))
    strip = F.regexp_extract("file", "strip=([0-9]+)", 1).cast("int").alias("strip")
    return index.join(hit, "file", "left").select(strip, "xmin", "ymin", "xmax", "ymax", F.coalesce("read", F.lit(False)).alias("read"))


@query("s7_read_over", "SELECT year, y, x, v FROM px WHERE lon BETWEEN -124 AND -105 AND lat BETWEEN 24 AND 26", "px")
def _(v: Views) -> DataFrame:
    path = filed(v)
    index = tables.file_index(v.spark, path, "lon", "lat")
    return tables.read_over(v.spark, index, (-124, 24, -105, 26), "lon", "lat", v.px.schema).select("year", "y", "x", "v")


@query("s9_a12_u1_union_tiles", f"WITH tiles AS (SELECT lat, lon, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v, cls FROM px WHERE x < 40 UNION ALL SELECT lat, lon, v, NULL FROM px WHERE x >= 32) SELECT {C6} AS cell, round(avg(v), 9) AS value, count(*) AS px, count(cls) AS classed FROM tiles GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    """Two tiles that share some columns and whose columns differ in order, in type, and in what there is."""
    west, east = v.px.where("x < 40").select("lat", "lon", F.col("v").cast("float").alias("v"), "cls"), v.px.where("x >= 32").select("v", "year", "lat", "lon")
    both = fold.union_tiles([west, east])
    classed = fold.with_cell(both, 6).groupBy("cell").agg(F.count("cls").alias("classed"))
    return fold.fold_mean(both, 6).join(classed, "cell").select("cell", r("value").alias("value"), "px", "classed")


def albers_tiles(v: Views, size: float) -> DataFrame:
    """An index of the square tiles of so many metres that hold pixels."""
    ax, ay = proj.albers(F.col("lon"), F.col("lat"))
    i, j = F.floor(ax / size), F.floor(ay / size)
    found = v.px.select(i.alias("i"), j.alias("j"), "year", "v").groupBy("i", "j").agg(F.max("year").alias("year"), F.max(F.col("v") * 1000).alias("z_max"))
    edge = {"aw": F.col("i") * size, "as": F.col("j") * size, "ae": (F.col("i") + 1) * size, "an": (F.col("j") + 1) * size}
    return found.select((F.col("i") * 100 + F.col("j")).alias("tile"), F.concat(F.lit("tiles/"), "i", F.lit("/"), "j").alias("link"), F.make_date("year", F.lit(7), F.lit(1)).alias("date"), "z_max", *[c.alias(k) for k, c in edge.items()])


def inverse_sql(x: str, y: str) -> str:
    """[lon, lat] of Albers metres: Newton steps over a list."""
    q = f"(({proj.C} - (({x}) ** 2 + ({proj.RHO0} - ({y})) ** 2) * {proj.N**2} / {proj.A**2}) / {proj.N})"
    one = f"(1 - {proj.E2} * sin(a) ** 2)"
    step = f"a + {one} ** 2 / (2 * cos(a)) * ({q} / (1 - {proj.E2}) - sin(a) / {one} + ln((1 - {proj.E} * sin(a)) / (1 + {proj.E} * sin(a))) / (2 * {proj.E}))"
    return f"[degrees(atan2({x}, {proj.RHO0} - ({y})) / {proj.N} + {proj.LON0}), degrees(list_reduce([asin({q} / 2), 0, 0, 0, 0, 0, 0], lambda a, b: {step}))]"


CORNERS = {"sw": ("aw", "as_"), "se": ("ae", "as_"), "ne": ("ae", "an"), "nw": ("aw", "an")}


@query("s10_tile_corners", f"WITH a AS ({ALBERS_SQL}), t AS (SELECT CAST(floor(ax / 1e6) AS BIGINT) AS i, CAST(floor(ay / 1e6) AS BIGINT) AS j, max(year) AS year, max(v * 1000) AS z_max FROM px JOIN a USING (y, x) GROUP BY 1, 2), e AS (SELECT *, i * 1e6 AS aw, j * 1e6 AS as_, (i + 1) * 1e6 AS ae, (j + 1) * 1e6 AS an FROM t), c AS (SELECT *, {', '.join(f'{inverse_sql(*p)} AS {k}' for k, p in CORNERS.items())} FROM e) SELECT i * 100 + j AS tile, concat('tiles/', i, '/', j) AS link, make_date(year, 7, 1) AS date, round(z_max, 6) AS z_max, CAST(aw AS DOUBLE) AS aw, CAST(ae AS DOUBLE) AS ae, {', '.join(f'round({k}[{n}], 7) AS {k}_{c}' for k in CORNERS for n, c in ((1, 'lon'), (2, 'lat')))} FROM c", "px")
def _(v: Views) -> DataFrame:
    found = tables.tile_corners(albers_tiles(v, 1e6))
    return found.select("tile", "link", "date", r("z_max", 6).alias("z_max"), "aw", "ae", *[r(f"{k}_{c}", 7).alias(f"{k}_{c}") for k in CORNERS for c in ("lon", "lat")])


@query("s11_source_filters", "SELECT id, name, substr('ZZ-' || region, 4) AS short FROM zones WHERE region NOT IN ('ASIA', 'AFRICA')", "zones")
def _(v: Views) -> DataFrame:
    return v.zones.where(~F.col("region").isin("ASIA", "AFRICA")).select("id", "name", tables.short_region(F.concat(F.lit("ZZ-"), "region")).alias("short"))


@query("s12_forecast", "SELECT t + to_hours(x + 1) AS t, x, tc FROM cube WHERE t = (SELECT max(t) FROM cube)", "cube")
def _(v: Views) -> DataFrame:
    runs = v.cube.select(F.col("t").alias("init_time"), (F.col("x") + 1).alias("lead_hours"), "x", "tc")
    return tables.latest_forecast(runs).select("t", "x", "tc")


@query("s14_strided", "SELECT year, y, x, v FROM px WHERE y % 4 = 1 AND x % 4 = 2", "px")
def _(v: Views) -> DataFrame:
    return tables.strided(v.px, 4, 1, 2).select("year", "y", "x", "v")


@query("s13_p14_blocks", "SELECT year, y, x FROM px WHERE (y // 8, x // 8) IN (SELECT (y // 8, x // 8) FROM px WHERE cls = 12 AND year = 1995)", "px")
def _(v: Views) -> DataFrame:
    px = v.px
    return tables.in_blocks(px, px.where("cls = 12 AND year = 1995"), 8).select("year", "y", "x")


@query("s1_s13_block_store", "SELECT year, y, x, v FROM px WHERE (y // 8, x // 8) IN (SELECT (y // 8, x // 8) FROM px WHERE cls = 12 AND year = 1995)", "px")
def _(v: Views) -> DataFrame:
    """The same blocks from a store that is partitioned by them."""
    path = tables.new_path(v.spark)
    tables.write_blocks(v.px, path, 8, ["year"])
    return tables.read_blocks(v.spark, path, v.px.where("cls = 12 AND year = 1995"), 8).select("year", "y", "x", "v")


@query("s13_j2_zone_hours_by_block", "SELECT t, id, round(avg(tc), 9) AS value, count(*) AS px FROM cube JOIN zones ON lon >= w AND lon < e AND lat >= s AND lat < n WHERE region = 'ASIA' GROUP BY 1, 2", "cube zones")
def _(v: Views) -> DataFrame:
    """Hours of the zones of one region, from the blocks of the cube that they touch."""
    path = tables.new_path(v.spark)
    tables.write_blocks(v.cube, path, 16, ["t"])
    lookup = v.cube.select("y", "x", "lat", "lon").distinct()
    ringed = v.zones.where("region = 'ASIA'").select("id", geometry.box_ring(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("ring"))
    mapping = tables.written(zones.points_in(lookup, ringed, 4).select("y", "x", "id"))
    return fold.fold_zone_hours(tables.read_blocks(v.spark, path, mapping, 16), mapping, "tc").select("t", "id", r("value").alias("value"), "px")


@query("s17_p33_clustered_sink", "SELECT year, y, x, v FROM px WHERE lon BETWEEN -124 AND -105 AND lat BETWEEN 24 AND 36", "px")
def _(v: Views) -> DataFrame:
    """A box of a table that lies along the Hilbert curve, from the files whose row groups meet it."""
    path = tables.new_path(v.spark)
    tables.write_clustered(v.px, path, "lon", "lat", (-125.0, 24.0, -67.0, 49.0), group_bytes=1 << 16)
    index = tables.file_index(v.spark, path, "lon", "lat")
    return tables.read_over(v.spark, index, (-124, 24, -105, 36), "lon", "lat", v.px.schema).select("year", "y", "x", "v")


@query("s18_grid_round_trip", f"SELECT year * 100 + y AS line, {', '.join(f'max(v) FILTER (x = {i}) AS x{i}' for i in range(64))} FROM px GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    """All columns of the raster, a line for each row of a year."""
    lines = v.px.withColumn("line", F.col("year") * 100 + F.col("y"))
    return tables.labelled_grid(lines, "line", "x", "v", list(range(64))).withColumnsRenamed({str(i): f"x{i}" for i in range(64)})


# --- grid and projections

@query("p7_cells", f"SELECT DISTINCT y, x, {C7} AS cell, {C9} AS fine FROM px", "px")
def _(v: Views) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return v.px.select("y", "x", grid.cell(lat, lon, 7).alias("cell"), grid.cell(lat, lon, 9).alias("fine")).distinct()


@query("p8_parents", f"SELECT {cell_sql(5)} AS parent, count(DISTINCT {C7}) AS children FROM px GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    return fold.with_cell(v.px, 7).groupBy(grid.parent(F.col("cell"), 2).alias("parent")).agg(F.count_distinct("cell").alias("children"))


@query("p9_disk", f"WITH c AS (SELECT DISTINCT {C7} AS cell FROM px) SELECT cell, (7::BIGINT << 58) + ({ROW} + dy) * 536870912 + ({COL} + dx + 256) % 256 AS near FROM c, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) WHERE {ROW} + dy BETWEEN 0 AND 127", "px")
def _(v: Views) -> DataFrame:
    return fold.with_cell(v.px, 7).select("cell").distinct().select("cell", F.explode(grid.disk(F.col("cell"), 1)).alias("near"))


@query("p10_centres", f"WITH c AS (SELECT DISTINCT {C7} AS cell FROM px) SELECT cell, round(degrees(asin(({ROW} + 0.5) / 128 * 2 - 1)), 9) AS lat, round(({COL} + 0.5) / 256 * 360 - 180, 9) AS lon FROM c", "px")
def _(v: Views) -> DataFrame:
    lat, lon = grid.centre(F.col("cell"))
    return fold.with_cell(v.px.select("lat", "lon"), 7).select("cell").distinct().select("cell", r(lat).alias("lat"), r(lon).alias("lon"))


@query("p11_edges", f"WITH c AS (SELECT DISTINCT {C6} AS cell FROM px) SELECT cell, dir, (6::BIGINT << 58) + ({ROW} + dy) * 536870912 + {COL} + dx AS neighbour, round(({COL} + ex) / 128.0 * 360 - 180, 9) AS x1, round(degrees(asin(({ROW} + ey) / 64.0 * 2 - 1)), 9) AS y1 FROM c, (VALUES ('e', 1, 0, 1, 0), ('n', 0, 1, 1, 1), ('w', -1, 0, 0, 1), ('s', 0, -1, 0, 0)) s(dir, dx, dy, ex, ey)", "px")
def _(v: Views) -> DataFrame:
    cells = fold.with_cell(v.px.select("lat", "lon"), 6).select("cell").distinct()
    return cells.select("cell", F.inline(grid.edges(F.col("cell")))).select("cell", "dir", "neighbour", r("x1").alias("x1"), r("y1").alias("y1"))


@query("p1_albers", f"SELECT y, x, round(ax, 2) AS ax, round(ay, 2) AS ay FROM ({ALBERS_SQL})", "px")
def _(v: Views) -> DataFrame:
    ax, ay = proj.albers(F.col("lon"), F.col("lat"))
    return v.px.select("y", "x", "lat", "lon").distinct().select("y", "x", r(ax, 2).alias("ax"), r(ay, 2).alias("ay"))


BOX_EDGES = "SELECT id, unnest([w + (e - w) * k / 8, w + (e - w) * k / 8, w, e]) AS lon, unnest([s, n, s + (n - s) * k / 8, s + (n - s) * k / 8]) AS lat FROM zones, range(9) t(k)"


@query("p2_box_reprojected", f"WITH p AS ({BOX_EDGES}), q AS ({ALBERS_SQL.replace('SELECT y, x, lat, lon, rho', 'SELECT id, rho').replace('SELECT DISTINCT y, x, lat, lon, sin(radians(lat)) AS s FROM px', 'SELECT *, sin(radians(lat)) AS s FROM p')}) SELECT id, round(greatest(min(ax), {proj.EXTENT[0]}), 1) AS w, round(greatest(min(ay), {proj.EXTENT[1]}), 1) AS s, round(least(max(ax), {proj.EXTENT[2]}), 1) AS e, round(least(max(ay), {proj.EXTENT[3]}), 1) AS n FROM q GROUP BY id", "zones")
def _(v: Views) -> DataFrame:
    return proj.albers_box(v.zones).select("id", *[r(c, 1).alias(c) for c in "wsen"])


@query("p5_albers_inverse", "SELECT DISTINCT y, x, round(lat, 9) AS lat, round(lon, 9) AS lon FROM px", "px")
def _(v: Views) -> DataFrame:
    ax, ay = proj.albers(F.col("lon"), F.col("lat"))
    lon, lat = proj.albers_inverse(F.col("ax"), F.col("ay"))
    return v.px.select("y", "x", ax.alias("ax"), ay.alias("ay")).distinct().select("y", "x", r(lat).alias("lat"), r(lon).alias("lon"))


@query("p3_mercator", "SELECT id, round((cx + 180) / 360 * 1048576, 4) AS col, round((1 - ln(tan(radians(cy)) + 1 / cos(radians(cy))) / pi()) / 2 * 1048576, 4) AS row, round(cx, 9) AS lon, round(cy, 9) AS lat FROM fields", "fields")
def _(v: Views) -> DataFrame:
    """Pixels of the web map, and the places that they give back."""
    col, row = proj.mercator_pixel(F.col("cx"), F.col("cy"), 12)
    lon, lat = proj.mercator_place(F.col("col"), F.col("row"), 12)
    return v.fields.select("id", col.alias("col"), row.alias("row")).select("id", r("col", 4).alias("col"), r("row", 4).alias("row"), r(lon).alias("lon"), r(lat).alias("lat"))


@query("p4_mollweide", f"WITH RECURSIVE it AS (SELECT id, cx, radians(cy) AS phi, radians(cy) AS th, 0 AS k FROM fields UNION ALL SELECT id, cx, phi, th - (2 * th + sin(2 * th) - pi() * sin(phi)) / greatest(2 + 2 * cos(2 * th), 1e-12), k + 1 FROM it WHERE k < 12) SELECT id, round(2 * sqrt(2.0) / pi() * {proj.A} * radians(cx) * cos(th), 2) AS mx, round(sqrt(2.0) * {proj.A} * sin(th), 2) AS my FROM it WHERE k = 12", "fields")
def _(v: Views) -> DataFrame:
    mx, my = proj.mollweide(F.col("cx"), F.col("cy"))
    return v.fields.select("id", r(mx, 2).alias("mx"), r(my, 2).alias("my"))


@query("p6_f4_tile_fits", "SELECT DISTINCT y, x, round(lon, 6) AS lon, round(lat, 6) AS lat FROM px", "px")
def _(v: Views) -> DataFrame:
    """Pixels in metres get their degrees by the fit of their tile of 200 km; the fits are a table of coefficients."""
    ax, ay = proj.albers(F.col("lon"), F.col("lat"))
    at = v.px.select("y", "x", ax.alias("ax"), ay.alias("ay")).distinct()
    at = at.withColumns({"i": F.floor(F.col("ax") / 2e5), "j": F.floor(F.col("ay") / 2e5)}).withColumn("tile", F.col("i") * 10_000 + F.col("j"))
    tiles = at.select("tile", (F.col("i") * 2e5).alias("w"), (F.col("j") * 2e5).alias("s"), ((F.col("i") + 1) * 2e5).alias("e"), ((F.col("j") + 1) * 2e5).alias("n")).distinct()
    fits = proj.lonlat_fits(tiles, degree=6).select("tile", F.struct("cx", "cy", "sx", "sy", "lon", "lat").alias("fit"))
    place = at.join(fits, "tile").select("y", "x", proj.lonlat(F.col("ax"), F.col("ay"), degree=6).alias("p"))
    return place.select("y", "x", r("p.lon", 6).alias("lon"), r("p.lat", 6).alias("lat"))


# --- scalars

@query("p12_p13_p16_predicates", "SELECT year, y, x, CAST(floor((lon + 180) / 0.5) AS BIGINT) AS gx, CAST(floor((50 - lat) / 0.5) AS BIGINT) AS gy FROM px WHERE cls NOT IN (3, 7) AND v BETWEEN 0.01 AND 0.08 AND lon >= -110 AND lon < -95.5 AND lat >= 30 AND lat < 40.5", "px")
def _(v: Views) -> DataFrame:
    kept = v.px.where(~F.col("cls").isin(3, 7) & F.col("v").between(0.01, 0.08) & scalars.owned(F.col("lon"), F.col("lat"), *map(F.lit, (-110, 30, -95.5, 40.5))))
    return kept.select("year", "y", "x", scalars.bin_index(F.col("lon"), -180.0, 0.5).alias("gx"), scalars.bin_index(F.col("lat"), 50.0, 0.5, down=True).alias("gy"))


@query("p15_voids", "SELECT year, y, x, v * 1000 - 20 AS elev FROM px WHERE x % 11 <> 0 AND v * 1000 - 20 > -15 AND abs(v * 1000 - 20) > 0.5", "px")
def _(v: Views) -> DataFrame:
    elev = F.when(F.col("x") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("v") * 1000 - 20)
    return v.px.withColumn("elev", elev).where(scalars.above_floor(F.col("elev"), -15.0, 0.5)).select("year", "y", "x", "elev")


HI = """(CASE WHEN ((0.5 * (tf + 61 + (tf - 68) * 1.2 + rh * 0.094)) + tf) / 2 >= 80 THEN
  -42.379 + 2.04901523 * tf + 10.14333127 * rh - 0.22475541 * tf * rh - 0.00683783 * tf * tf - 0.05481717 * rh * rh + 0.00122874 * tf * tf * rh + 0.00085282 * tf * rh * rh - 0.00000199 * tf * tf * rh * rh
  - CASE WHEN rh < 13 AND tf BETWEEN 80 AND 112 THEN (13 - rh) / 4 * sqrt((17 - abs(tf - 95)) / 17) ELSE 0 END + CASE WHEN rh > 85 AND tf BETWEEN 80 AND 87 THEN (rh - 85) / 10 * ((87 - tf) / 5) ELSE 0 END
  ELSE 0.5 * (tf + 61 + (tf - 68) * 1.2 + rh * 0.094) END - 32) * 5 / 9"""


@query("p17_p21_heat", f"SELECT t, x, y, round({HI}, 9) AS hi, CAST(greatest(0, least(254, round_even((tc + 40) * 2, 0))) AS INT) AS code, (CAST(least(15, round_even(mm, 0)) AS INT) << 4) | CAST(least(15, round_even(rh / 10, 0)) AS INT) AS packed, round(sqrt(tc * tc + mm * mm), 9) AS wind, round(greatest(0, tc - 18) * greatest(0, 1 - 0.5 * mm / 10), 9) AS over FROM (SELECT *, tc * 9 / 5 + 32 AS tf FROM cube)", "cube")
def _(v: Views) -> DataFrame:
    tc, rh, mm = F.col("tc"), F.col("rh"), F.col("mm")
    return v.cube.select("t", "x", "y", r(scalars.heat_index(tc, rh), 9).alias("hi"), scalars.half_degree_code(tc).alias("code"), scalars.packed_nibbles(mm, rh / 10).alias("packed"), r(scalars.wind_speed(tc, mm), 9).alias("wind"), r(scalars.excess(tc, 18.0, mm, 0.5), 9).alias("over"))


@query("p18_p22_bands", "SELECT year, y, x, round(v * 3600, 9) AS rate, round(cls * 2.5 * 247.105, 4) AS acres, CASE WHEN cls >= 9 THEN 3 WHEN cls >= 6 THEN 2 WHEN cls >= 3 THEN 1 ELSE 0 END AS band FROM px", "px")
def _(v: Views) -> DataFrame:
    return v.px.select("year", "y", "x", r(F.col("v") * 3600).alias("rate"), r(scalars.acres(F.col("cls"), 2.5), 4).alias("acres"), scalars.band(F.col("cls"), [3, 6, 9]).alias("band"))


@query("p23_severity", "SELECT fid, CASE WHEN zone IN ('V', 'VE') THEN 3 WHEN zone IN ('A', 'AE', 'AH', 'AO', 'A99', 'AR') THEN 2 WHEN zone = 'X' AND subty LIKE '%0.2%' THEN 1 WHEN zone = 'D' THEN 0 ELSE -1 END AS zc FROM hazard", "hazard")
def _(v: Views) -> DataFrame:
    return v.hazard.select("fid", scalars.zone_severity(F.col("zone"), F.col("subty")).alias("zc"))


@query("p24_p31_p38_classes", "WITH c AS (SELECT cls, count(*) AS n FROM px GROUP BY cls) SELECT cls, name, n, round(100 * n / sum(n) OVER (), 1) AS pct, name IN ('class_3') OR name LIKE 'class_1%' AS plain FROM c JOIN classes ON cls = code", "px classes")
def _(v: Views) -> DataFrame:
    from gridloom.operators import classes

    out = classes.legend(classes.class_ranking(v.px), v.classes)
    return out.withColumn("plain", scalars.non_crop(F.col("name"), ["class_3"], ["class_1"]))


@query("p25_p27_p39_pixels", "SELECT year, y, x, CASE WHEN x % 5 <> 0 THEN round((cls - v) / greatest(cls + v, 1), 9) END AS ndvi, cls * 256 + y + x / 256 - 32768 AS elev, CASE WHEN cls < 6 AND x % 2 = 0 THEN 1 WHEN cls < 6 THEN 2 WHEN x % 2 = 0 THEN 3 END AS kind, round(v + 0.5 * cls, 9) AS shade FROM px", "px")
def _(v: Views) -> DataFrame:
    cls, val, x, y = map(F.col, ("cls", "v", "x", "y"))
    return v.px.select("year", "y", "x", r(scalars.ndvi(cls, val, x % 5 != 0)).alias("ndvi"), scalars.terrarium(cls, y, x).alias("elev"), scalars.disagreement(cls < 6, x % 2 == 0).alias("kind"), r(val + 0.5 * cls).alias("shade"))


@query("p28_normalised", "SELECT year, y, x, round((log10(greatest(0.01, least(0.1, v))) - log10(0.01)) / (log10(0.1) - log10(0.01)), 9) AS lg, round(sqrt(greatest(0, least(1, v / 0.08))), 9) AS sq, round(greatest(0, least(1, (v - (SELECT quantile_cont(v, 0.02) FROM px)) / (SELECT quantile_cont(v, 0.98) - quantile_cont(v, 0.02) FROM px))), 9) AS lin, round(greatest(-1, least(1, (v - 0.05) / 0.02)), 9) AS piv, round(ln(1 + v), 9) AS l1 FROM px", "px")
def _(v: Views) -> DataFrame:
    px = v.px
    low, high = fold.quantiles(px, "v", [0.02, 0.98]).first()
    val = F.col("v")
    return px.select("year", "y", "x", r(scalars.log_clip(val, 0.01, 0.1)).alias("lg"), r(scalars.sqrt_clip(val, 0.08)).alias("sq"), r(scalars.linear_clip(val, F.lit(low), F.lit(high))).alias("lin"), r(scalars.pivot_clip(val, 0.05, 0.02)).alias("piv"), r(F.log1p(val)).alias("l1"))


def tagged(v: Views) -> DataFrame:
    tag = F.when(F.col("id") % 4 == 0, F.concat((F.col("id") % 7 * 1000).cast("string"), F.lit("; 110000"))).when(F.col("id") % 4 == 1, F.lit("400000,x")).when(F.col("id") % 4 == 2, F.lit("n/a"))
    cls = F.when(F.col("id") % 3 == 0, "power_line").otherwise("power_tower")
    kind = F.when(F.col("id") % 5 == 0, "POINT").when(F.col("id") % 5 == 1, "MULTILINESTRING").otherwise("LINESTRING")
    return v.buildings.select("id", cls.alias("cls"), kind.alias("kind"), F.when(tag.isNotNull(), F.create_map(F.lit("voltage"), tag)).alias("tags"))


@query("p29_tags", "SELECT id, CAST(CASE WHEN id % 4 = 0 THEN greatest(id % 7 * 1000, 110000) WHEN id % 4 = 1 THEN 400000 ELSE 0 END AS BIGINT) AS voltage FROM buildings", "buildings")
def _(v: Views) -> DataFrame:
    return tagged(v).select("id", scalars.voltage(F.col("tags")).alias("voltage"))


@query("p29_power_lines", "SELECT id FROM buildings WHERE id % 3 = 0 AND id % 5 <> 0 AND id % 4 = 1", "buildings")
def _(v: Views) -> DataFrame:
    return tagged(v).where(scalars.power_line(F.col("cls"), F.col("kind"), F.col("tags"))).select("id")


@query("p30_heights", "SELECT id, round(coalesce(height, num_floors * 3.0), 4) AS h FROM buildings WHERE NOT underground AND coalesce(height, num_floors * 3.0, 1) > 0", "buildings")
def _(v: Views) -> DataFrame:
    h = scalars.building_height(F.col("height"), F.col("num_floors"))
    return v.buildings.where(~F.col("underground") & (F.coalesce(h, F.lit(1.0)) > 0)).select("id", r(h, 4).alias("h"))


@query("p32_quadkeys", "SELECT DISTINCT y, x, array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda i: CAST(((x >> i) & 1) + 2 * ((y >> i) & 1) AS VARCHAR)), '') AS qk FROM px", "px")
def _(v: Views) -> DataFrame:
    return v.px.select("y", "x").distinct().select("y", "x", scalars.quadkey(F.col("x"), F.col("y"), 6).alias("qk"))


@query("p33_hilbert", "WITH RECURSIVE h AS (SELECT DISTINCT y, x, CAST(x AS BIGINT) AS a, CAST(y AS BIGINT) AS b, CAST(32 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM px UNION ALL SELECT y, x, CASE WHEN (b // s) % 2 = 0 THEN CASE WHEN (a // s) % 2 = 1 THEN s - 1 - b % s ELSE b % s END ELSE a % s END, CASE WHEN (b // s) % 2 = 0 THEN CASE WHEN (a // s) % 2 = 1 THEN s - 1 - a % s ELSE a % s END ELSE b % s END, s // 2, d + s * s * xor(3 * ((a // s) % 2), (b // s) % 2) FROM h WHERE s > 0) SELECT y, x, d + 1365 AS tile FROM h WHERE s = 0", "px")
def _(v: Views) -> DataFrame:
    return v.px.select("y", "x").distinct().select("y", "x", scalars.hilbert(F.col("x"), F.col("y"), 6).alias("tile"))


@query("p34_p35_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, dayofyear(o_orderdate) BETWEEN least(greatest(105 + 0.9 * (lat - 35), 60), 160) AND least(greatest(305 - 0.9 * (lat - 35), 250), 340) AS leaf FROM (SELECT *, o_custkey % 90 AS lat FROM orders)")
def _(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.date_trunc("day", "o_orderdate").alias("day"), scalars.leaf_on(F.col("o_orderdate"), F.col("o_custkey") % 90).alias("leaf"))


@query("p36_geometry", "SELECT id, round(2 * r * r, 9) AS area, round(cx, 9) AS x, round(cy, 9) AS y, round(cx - r, 9) AS w, round(cy + r, 9) AS n FROM fields", "fields")
def _(v: Views) -> DataFrame:
    ringed = v.fields.withColumn("ring", geometry.diamond(F.col("cx"), F.col("cy"), F.col("r")))
    x, y = geometry.centroid(F.col("ring"))
    w, _s, _e, n = geometry.envelope(F.col("ring"))
    return ringed.select("id", r(geometry.area(F.col("ring"))).alias("area"), r(x).alias("x"), r(y).alias("y"), r(w).alias("w"), r(n).alias("n"))


@query("p37_squares", "SELECT DISTINCT y, x, round(0.9 * 0.9, 9) AS area, round(lon - 0.45, 9) AS w FROM px", "px")
def _(v: Views) -> DataFrame:
    ringed = v.px.select("y", "x", geometry.square(F.col("lon"), F.col("lat"), 0.45).alias("ring")).distinct()
    return ringed.select("y", "x", r(geometry.area(F.col("ring"))).alias("area"), r(geometry.envelope(F.col("ring"))[0]).alias("w"))


# --- folds

@query("a1_fold_mean", f"SELECT {C7} AS cell, round(avg(v), 9) AS value, count(*) AS px FROM px WHERE x % 11 <> 0 GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    holes = v.px.withColumn("v", F.when(F.col("x") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return fold.fold_mean(holes, 7).select("cell", r("value").alias("value"), "px")


@query("a2_fold_positive", f"SELECT {C7} AS cell, round(avg(v), 9) AS value, count(*) AS px FROM px GROUP BY 1 HAVING avg(v) > 0", "px")
def _(v: Views) -> DataFrame:
    return fold.fold_mean(v.px, 7, positive=True).select("cell", r("value").alias("value"), "px")


@query("a3_fold_terrain", f"SELECT {C7} AS cell, round(avg(v * 1000 - 20), 9) AS value, count(*) AS px FROM px WHERE v * 1000 - 20 > -15 AND abs(v * 1000 - 20) > 0.5 GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    return fold.fold_terrain(v.px.withColumn("elev", F.col("v") * 1000 - 20), 7, floor=-15.0, eps=0.5).select("cell", r("value").alias("value"), "px")


@query("a4_fold_hourly", f"SELECT t, {C6} AS cell, round(avg(tc), 9) AS tc, round(avg(rh), 9) AS rh, round(avg(mm), 9) AS mm FROM cube GROUP BY 1, 2", "cube")
def _(v: Views) -> DataFrame:
    return fold.fold_hourly(v.cube, 6, ["tc", "rh", "mm"]).select("t", "cell", *[r(c).alias(c) for c in ("tc", "rh", "mm")])


@query("a5_j2_zone_hours", "SELECT t, id, round(avg(tc), 9) AS value, count(*) AS px FROM cube JOIN zones ON lon >= w AND lon < e AND lat >= s AND lat < n GROUP BY 1, 2", "cube zones")
def _(v: Views) -> DataFrame:
    lookup = v.cube.select("y", "x", "lat", "lon").distinct()
    ringed = v.zones.select("id", geometry.box_ring(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("ring"), "w", "s", "e", "n")
    mapping = zones.points_in(lookup, ringed.select("id", "ring"), 4).select("y", "x", "id")
    return fold.fold_zone_hours(v.cube, mapping, "tc").select("t", "id", r("value").alias("value"), "px")


@query("a6_rollup_daily", f"WITH h AS (SELECT t, {C6} AS cell, avg(tc) AS tc FROM cube GROUP BY 1, 2) SELECT date_trunc('day', t) AS day, cell, round(avg(tc), 9) AS mean, round(max(tc), 9) AS most FROM h GROUP BY 1, 2", "cube")
def _(v: Views) -> DataFrame:
    hourly = fold.fold_hourly(v.cube, 6, ["tc"])
    both = fold.rollup_daily(hourly, "cell", "tc").join(fold.rollup_daily(hourly, "cell", "tc", "max").withColumnRenamed("tc", "most"), ["day", "cell"])
    return both.select("day", "cell", r("tc").alias("mean"), r("most").alias("most"))


@query("a7_fold_mode", f"WITH c AS (SELECT {C6} AS cell, cls, count(*) AS n FROM px GROUP BY 1, 2) SELECT cell, cls, n, total, round(n / total, 9) AS purity FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY cell) AS BIGINT) AS total, row_number() OVER (PARTITION BY cell ORDER BY n DESC, cls) AS rn FROM c) WHERE rn = 1", "px")
def _(v: Views) -> DataFrame:
    return fold.fold_mode(v.px, 6).withColumn("purity", r("purity"))


PARTS = f"SELECT CAST(x // 16 AS BIGINT) AS tile, {C6} AS cell, sum(v) AS s, count(*) AS n, min(v) AS mn, max(v) AS mx FROM px GROUP BY 1, 2"


@query("a9_partials", f"SELECT tile, cell, round(s, 9) AS s, n, mn, mx FROM ({PARTS})", "px")
def _(v: Views) -> DataFrame:
    parts = fold.partial_fold(v.px.withColumn("tile", F.floor(F.col("x") / 16)), 6, by=["tile"])
    return parts.withColumn("s", r("s"))


@query("a10_a11_merge", f"SELECT cell, round(sum(s) / sum(n), 9) AS value, CAST(sum(n) AS BIGINT) AS n, round(max(mx) - min(mn), 9) AS relief FROM ({PARTS}) GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    parts = fold.partial_fold(v.px.withColumn("tile", F.floor(F.col("x") / 16)), 6, by=["tile"])
    return fold.merge_partials(parts).select("cell", r("value").alias("value"), "n", r("relief").alias("relief"))


@query("j10_outer_partials", f"WITH a AS (SELECT {C6} AS cell, sum(v) AS s, count(*) AS n FROM px WHERE x < 30 GROUP BY 1), b AS (SELECT {C6} AS cell, sum(v) AS s2, count(*) AS n2 FROM px WHERE x >= 26 GROUP BY 1) SELECT coalesce(a.cell, b.cell) AS cell, round(s, 9) AS s, n, round(s2, 9) AS s2, n2 FROM a FULL JOIN b ON a.cell = b.cell", "px")
def _(v: Views) -> DataFrame:
    out = fold.join_partials(fold.partial_fold(v.px.where("x < 30"), 6), fold.partial_fold(v.px.where("x >= 26"), 6))
    return out.select("cell", r("s").alias("s"), "n", r("s2").alias("s2"), "n2")


@query("a13_child_share", f"WITH f AS (SELECT {cell_sql(8)} AS cell, max(cls) AS cls FROM px GROUP BY 1) SELECT (6::BIGINT << 58) + ({ROW} >> 2) * 536870912 + ({COL} >> 2) AS parent, count(*) FILTER (cls >= 9) AS hits, least(1, count(*) FILTER (cls >= 9) / 16) AS share FROM f GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    fine = fold.with_cell(v.px, 8).groupBy("cell").agg(F.max("cls").alias("cls"))
    return fold.share_of_children(fine, 2, F.col("cls") >= 9)


@query("a28_band_stats", "SELECT year AS band, round(avg(v), 9) AS mean, round(avg(CASE WHEN v >= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share FROM px GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    return fold.band_stats(v.px, "year", "v", 0.05).select(F.col("year").alias("band"), r("mean").alias("mean"), r("share").alias("share"))


@query("a29_scan", "SELECT l_returnflag, count(*) AS n, round(avg(CAST(l_quantity AS DOUBLE)), 9) AS q FROM lineitem GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("l_quantity").cast("double"))).alias("q"))


@query("a30_distincts", "SELECT count(*) AS n, count(DISTINCT cls) AS classes, count(DISTINCT (y, x)) AS places FROM px", "px")
def _(v: Views) -> DataFrame:
    return v.px.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cls").alias("classes"), F.count_distinct("y", "x").alias("places"))


@query("a31_quantiles", "SELECT round(quantile_cont(tc, 0.02), 9) AS p2, round(quantile_cont(tc, 0.5), 9) AS p50, round(quantile_cont(tc, 0.98), 9) AS p98 FROM cube", "cube")
def _(v: Views) -> DataFrame:
    return fold.quantiles(v.cube, "tc", [0.02, 0.5, 0.98]).select(*[r(p).alias(p) for p in ("p2", "p50", "p98")])


@query("a38_pyramid", "WITH lv AS (SELECT year, k AS level, y // k, x // k, avg(v) AS v FROM px, (VALUES (1), (2), (4)) t(k) GROUP BY 1, 2, 3, 4) SELECT year, level, round(avg(v), 9) AS mean, round(max(v), 9) AS most, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 9) AS zeros FROM lv GROUP BY year, level", "px")
def _(v: Views) -> DataFrame:
    k = F.explode(F.array(*[F.lit(x) for x in (1, 2, 4)])).alias("level")
    levels = v.px.select("year", "y", "x", "v", k).groupBy("year", "level", F.floor(F.col("y") / F.col("level")), F.floor(F.col("x") / F.col("level"))).agg(F.avg("v").alias("v"))
    return levels.groupBy("year", "level").agg(r(F.avg("v")).alias("mean"), r(F.max("v")).alias("most"), r(F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0))).alias("zeros"))


@query("a32_frame_means", "SELECT t AS f, round(avg(tc), 9) AS tc FROM cube GROUP BY 1", "cube")
def _(v: Views) -> DataFrame:
    return heat.frame_means(v.cube.withColumnRenamed("t", "f"), "tc").withColumn("tc", r("tc"))
