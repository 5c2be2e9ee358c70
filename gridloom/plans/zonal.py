"""Queries of fills, joins, zonal statistics, class analytics and fields."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, grid, scalars
from gridloom.operators import classes, fold, zones
from gridloom.plans.folds import COL, ROW, r
from gridloom.plans.registry import Views, cell_sql, query
from gridloom.sources import tables

C6, C7, C9 = cell_sql(6), cell_sql(7), cell_sql(9)


def cells_sql(level: int, w: int = -135, s: int = 20, e: int = -60, n: int = 60) -> str:
    """All cells of a level in a region, with their centres: what the plain fill tests."""
    rows, cols = 1 << level, 2 << level
    return f"""SELECT (CAST({level} AS BIGINT) * 288230376151711744 + iy * 536870912 + ix) AS cell, degrees(asin((iy + 0.5) / {rows} * 2 - 1)) AS clat, (ix + 0.5) / {cols} * 360 - 180 AS clon,
 degrees(asin(iy / {float(rows)} * 2 - 1)) AS s0, degrees(asin((iy + 1) / {float(rows)} * 2 - 1)) AS n0, ix / {float(cols)} * 360 - 180 AS w0, (ix + 1) / {float(cols)} * 360 - 180 AS e0, iy, ix
 FROM range({int((w + 180) / 360 * cols)}, {int((e + 180) / 360 * cols)}) a(ix), range({rows // 2}, {rows}) b(iy)"""


FILL7 = f"fill AS (SELECT id, cell FROM ({cells_sql(7)}) c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n)"
FOLD7 = f"fold AS (SELECT {C7} AS cell, avg(v) AS value FROM px GROUP BY 1)"
HITS = "hits AS (SELECT f.id, p.cls, p.lat, p.lon FROM px p JOIN fields f ON abs(p.lon - f.cx) + abs(p.lat - f.cy) < f.r WHERE p.year = 1995)"
MAJ = "maj AS (SELECT *, n / total AS purity, row_number() OVER (PARTITION BY id ORDER BY n DESC, cls) AS rn FROM (SELECT id, cls, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY id) AS BIGINT) AS total FROM hits GROUP BY id, cls))"


def field_rings(v: Views) -> DataFrame:
    return v.fields.select("id", "r", geometry.diamond(F.col("cx"), F.col("cy"), F.col("r")).alias("ring"))


def field_hits(v: Views) -> DataFrame:
    return zones.points_in(v.px.where("year = 1995"), field_rings(v).select("id", "ring"), 7).select("id", "cls", "lat", "lon")


def boxes(v: Views) -> DataFrame:
    """Building footprints as boxes."""
    x, y = F.col("cx"), F.col("cy")
    return v.buildings.select("id", "cx", "cy", (x - 0.02).alias("w"), (y - 0.02).alias("s"), (x + 0.02).alias("e"), (y + 0.02).alias("n"))


# --- fills and zonal statistics

@query("g1_fill_centres", f"WITH {FILL7} SELECT id, cell FROM fill", "zones")
def _(v: Views) -> DataFrame:
    return zones.fill_boxes(v.zones, 7, pieces=False)


@query("g1_g2_date_line", f"WITH c AS (SELECT (CAST(7 AS BIGINT) * 288230376151711744 + iy * 536870912 + ix) AS cell, degrees(asin((iy + 0.5) / 128 * 2 - 1)) AS clat, (ix + 0.5) / 256.0 * 360 - 180 AS clon, degrees(asin(iy / 128.0 * 2 - 1)) AS s0, degrees(asin((iy + 1) / 128.0 * 2 - 1)) AS n0, ix / 256.0 * 360 - 180 AS w0, (ix + 1) / 256.0 * 360 - 180 AS e0 FROM range(256) a(ix), range(128) b(iy)), z AS (SELECT id, 172 + (w + 125) / 12 AS w, 172 + (w + 125) / 12 + 10.5 - 360 AS e, s - 20.5 AS s, n - 20.25 AS n FROM zones) SELECT id, cell, clat >= s AND clat < n AND (clon >= w OR clon < e) AS centre FROM c JOIN z ON n0 > s AND s0 <= n AND (e0 > w OR w0 <= e)", "zones")
def _(v: Views) -> DataFrame:
    """Boxes over the date line, by both rules."""
    west = 172 + (F.col("w") + 125) / 12
    moved = v.zones.select("id", west.alias("w"), (west + 10.5 - 360).alias("e"), (F.col("s") - 20.5).alias("s"), (F.col("n") - 20.25).alias("n"))
    centres = zones.fill_boxes(moved, 7, pieces=False).withColumn("centre", F.lit(True))
    return zones.fill_touched(moved, 7).join(centres, ["id", "cell"], "left").withColumn("centre", F.coalesce("centre", F.lit(False)))


@query("g1_fill_rings", f"SELECT id, cell FROM ({cells_sql(8)}) c JOIN fields ON abs(clon - cx) + abs(clat - cy) < r", "fields")
def _(v: Views) -> DataFrame:
    return zones.fill_centres(field_rings(v), 8)


@query("g2_fill_touched", f"SELECT id, cell FROM ({cells_sql(9)}) c JOIN buildings ON e0 > cx - 0.02 AND w0 <= cx + 0.02 AND n0 > cy - 0.02 AND s0 <= cy + 0.02", "buildings")
def _(v: Views) -> DataFrame:
    return zones.fill_touched(boxes(v), 9)


@query("g3_single_owner", f"SELECT cell, min(fid) AS fid FROM ({cells_sql(7)}) c JOIN hazard ON clon >= w AND clon < e AND clat >= s AND clat < n GROUP BY 1", "hazard")
def _(v: Views) -> DataFrame:
    return zones.single_owner(zones.fill_boxes(v.hazard, 7, "fid"), "fid")


@query("g9_pieces_united", f"SELECT DISTINCT region, cell FROM ({cells_sql(6)}) c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n", "zones")
def _(v: Views) -> DataFrame:
    return zones.fill_boxes(v.zones, 6, "region")


@query("g10_land_mask", f"SELECT y, x FROM (SELECT DISTINCT y, x, {C7} AS cell FROM px) WHERE cell IN (SELECT cell FROM ({cells_sql(7)}) c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n WHERE region = 'ASIA')", "px zones")
def _(v: Views) -> DataFrame:
    mask = zones.fill_boxes(v.zones.where("region = 'ASIA'"), 7)
    return fold.with_cell(v.px, 7).select("y", "x", "cell").distinct().join(mask, "cell", "left_semi").select("y", "x")


@query("g11_blob_centroids", "SELECT id, round(cx, 5) AS x, round(cy, 5) AS y, round(0.04 * 0.04, 8) AS area FROM buildings", "buildings")
def _(v: Views) -> DataFrame:
    ringed = boxes(v).select("id", geometry.box_ring(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("ring"))
    x, y = geometry.centroid(F.col("ring"))
    return ringed.select("id", r(x, 5).alias("x"), r(y, 5).alias("y"), r(geometry.area(F.col("ring")), 8).alias("area"))


@query("j1_a8_zonal_mean", f"WITH {FILL7}, {FOLD7} SELECT id, round(avg(value), 9) AS value, count(*) AS cells FROM fill JOIN fold USING (cell) GROUP BY 1", "px zones")
def _(v: Views) -> DataFrame:
    return zones.zonal_mean(fold.fold_mean(v.px, 7), zones.fill_boxes(v.zones, 7, pieces=False)).withColumn("value", r("value"))


@query("w8_zone_ranking", f"WITH {FILL7}, {FOLD7}, z AS (SELECT id, avg(value) AS value, count(*) AS cells FROM fill JOIN fold USING (cell) WHERE value > 0 GROUP BY 1) SELECT id, name, round(value, 9) AS value, cells FROM z JOIN zones USING (id) ORDER BY value DESC, id LIMIT 10", "px zones")
def _(v: Views) -> DataFrame:
    ranked = zones.with_names(zones.zonal_mean(fold.fold_mean(v.px, 7, positive=True), zones.fill_boxes(v.zones, 7, pieces=False)), v.zones.select("id", "name"))
    return zones.top_zones(ranked, 10).select("id", "name", r("value").alias("value"), "cells")


@query("w8_ladder", f"WITH c AS ({cells_sql(8)}), pieces AS (SELECT 'locality' AS rung, CAST(id AS VARCHAR) AS id, cell FROM c JOIN buildings ON clon >= cx - 1e-6 AND clon < cx + 1e-6 AND clat >= cy - 1e-6 AND clat < cy + 1e-6 UNION ALL SELECT 'county', CAST(id AS VARCHAR), cell FROM c JOIN fields ON abs(clon - cx) + abs(clat - cy) < r UNION ALL SELECT 'region', CAST(id AS VARCHAR), cell FROM c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n UNION ALL SELECT DISTINCT 'country', region, cell FROM c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n), fold AS (SELECT {cell_sql(8)} AS cell, avg(v) AS value FROM px GROUP BY 1), z AS (SELECT rung, id, avg(value) AS value, count(*) AS cells FROM pieces JOIN fold USING (cell) GROUP BY 1, 2) SELECT rung, id, round(value, 9) AS value, cells FROM z WHERE CASE rung WHEN 'locality' THEN 1 WHEN 'county' THEN 2 WHEN 'region' THEN 3 ELSE 4 END = (SELECT min(CASE rung WHEN 'locality' THEN 1 WHEN 'county' THEN 2 WHEN 'region' THEN 3 ELSE 4 END) FROM z) ORDER BY value DESC, id LIMIT 12", "px buildings fields zones")
def _(v: Views) -> DataFrame:
    """Zones of a view, ranked one level finer than the view asks for, on the first rung that any cell reaches."""
    level = min(9, tables.level_in_view(-125.0, -65.0, 480, 9) + 1)
    x, y = F.col("cx"), F.col("cy")
    spots = v.buildings.select("id", (x - 1e-6).alias("w"), (y - 1e-6).alias("s"), (x + 1e-6).alias("e"), (y + 1e-6).alias("n"))
    rungs = {"locality": zones.fill_boxes(spots, level), "county": zones.fill_centres(field_rings(v), level), "region": zones.fill_boxes(v.zones, level, pieces=False), "country": zones.fill_boxes(v.zones, level, "region").withColumnRenamed("region", "id")}
    pieces = functools.reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("rung"), F.col("id").cast("string").alias("id"), "cell") for k, d in rungs.items()])
    ranked = zones.ranked_on_ladder(fold.fold_mean(v.px, level), pieces, list(rungs), 12)
    return ranked.select("rung", "id", r("value").alias("value"), "cells")


@query("j20_unreached", f"WITH {FILL7}, {FOLD7} SELECT id, name FROM zones WHERE id NOT IN (SELECT id FROM fill JOIN fold USING (cell) WHERE value > 0.05)", "px zones")
def _(v: Views) -> DataFrame:
    reached = zones.zonal_mean(fold.fold_mean(v.px, 7).where("value > 0.05"), zones.fill_boxes(v.zones, 7))
    return zones.unreached(v.zones.select("id", "name"), reached)


@query("a39_coverage", f"WITH {FILL7}, a AS (SELECT {C7} AS cell, count(*) AS n FROM px GROUP BY 1), b AS (SELECT {C7} AS cell FROM px WHERE cls = 1 GROUP BY 1) SELECT count(*) AS cells, round(avg(n), 9) AS mean_px, min(n) AS least, (SELECT count(DISTINCT id) FROM fill JOIN a USING (cell)) AS zones, round(avg(CASE WHEN b.cell IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS both_share FROM a LEFT JOIN b USING (cell)", "px zones")
def _(v: Views) -> DataFrame:
    cells = fold.fold_mean(v.px, 7)
    second = fold.fold_mean(v.px.where("cls = 1"), 7).select("cell", F.lit(1.0).alias("second"))
    reached = zones.zonal_mean(cells, zones.fill_boxes(v.zones, 7, pieces=False)).agg(F.count(F.lit(1)).alias("zones"))
    one = cells.join(second, "cell", "left").agg(F.count(F.lit(1)).alias("cells"), r(F.avg("px")).alias("mean_px"), F.min("px").alias("least"), r(F.avg(F.coalesce("second", F.lit(0.0)))).alias("both_share"))
    both = one.unionByName(reached, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("cells", "mean_px", "least", "zones", "both_share")])


@query("a37_join_quality", f"WITH {FOLD7}, b AS (SELECT id, {cell_sql(7, 'cy', 'cx')} AS cell, (abs(cx) + cy) / 2 AS w FROM buildings) SELECT round(corr(value, w), 9) AS c, round(quantile_cont(value / w, 0.5), 9) AS ratio, count(*) AS n FROM b JOIN fold USING (cell)", "px buildings")
def _(v: Views) -> DataFrame:
    at = v.buildings.select("id", grid.cell(F.col("cy"), F.col("cx"), 7).alias("cell"), ((F.abs("cx") + F.col("cy")) / 2).alias("w"))
    both = at.join(fold.fold_mean(v.px, 7), "cell").select("value", "w", (F.col("value") / F.col("w")).alias("part"))
    middle = fold.quantiles_by(both, [], "part", {"ratio": 0.5}).select(r("ratio").alias("ratio"))
    one = both.agg(r(fold.correlation("value", "w")).alias("c"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(middle, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("c", "ratio", "n")])


# --- joins

@query("j4_points_in_fields", f"WITH {HITS} SELECT * REPLACE (round(lat, 4) AS lat, round(lon, 4) AS lon) FROM hits", "px fields")
def _(v: Views) -> DataFrame:
    return field_hits(v).select("id", "cls", r("lat", 4).alias("lat"), r("lon", 4).alias("lon"))


@query("j5_holes", "SELECT b.id, z.id AS zone FROM buildings b JOIN zones z ON cx >= w AND cx < e AND cy >= s AND cy < n AND NOT (cx >= w + 3 AND cx < e - 3 AND cy >= s + 1 AND cy < n - 1)", "buildings zones")
def _(v: Views) -> DataFrame:
    w, s, e, n = map(F.col, ("w", "s", "e", "n"))
    rings = F.array(geometry.box_ring(w, s, e, n), geometry.box_ring(w + 3, s + 1, e - 3, n - 1))
    cover = v.zones.select(F.col("id").alias("zone"), rings.alias("rings"), F.explode(zones.candidates(5, w, s, e, n)).alias("at"))
    points = v.buildings.select("id", "cx", "cy", grid.cell(F.col("cy"), F.col("cx"), 5).alias("at"))
    return points.join(cover, "at").where(geometry.contains_even_odd(F.col("rings"), F.col("cx"), F.col("cy"))).select("id", "zone")


@query("j6_rotation", "SELECT a.cls AS cls_from, b.cls AS cls_to, count(*) AS n FROM px a JOIN px b USING (y, x) WHERE a.year = 1995 AND b.year = 1996 GROUP BY 1, 2", "px")
def _(v: Views) -> DataFrame:
    return classes.rotation(v.px, 1995, 1996)


@query("a16_rotation_matrix", "WITH p AS (SELECT a.cls AS cls_from, b.cls AS cls_to FROM px a JOIN px b USING (y, x) WHERE a.year = 1995 AND b.year = 1996) SELECT cls_from, " + ", ".join(f"CAST(nullif(count(*) FILTER (cls_to = {c}), 0) AS BIGINT) AS to_{c}" for c in (1, 2, 3, 4)) + " FROM p GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    pairs = classes.rotation(v.px, 1995, 1996)
    return classes.rotation_matrix(pairs, [1, 2, 3, 4])


@query("j3_j18_a14_area_by_year", "SELECT year, cls, name, n, round(n * 0.75 * 247.105, 9) AS acres FROM (SELECT year, cls, count(*) AS n FROM px WHERE cls IN (SELECT cls FROM px GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 6) GROUP BY 1, 2) JOIN classes ON cls = code", "px classes")
def _(v: Views) -> DataFrame:
    out = classes.area_by_year(v.px, 6, 0.75)
    return out.join(v.classes, out["cls"] == F.col("code")).select("year", "cls", "name", "n", r("acres", 6).alias("acres"))


@query("j7_a23_agreement", "WITH f AS (SELECT DISTINCT CAST(floor((cx + 180) / 2) AS BIGINT) AS gx, CAST(floor((60 - cy) / 2) AS BIGINT) AS gy FROM fields), p AS (SELECT cls, cls NOT IN (3, 7, 11) AS is_crop, CAST(floor((lon + 180) / 2) AS BIGINT) AS gx, CAST(floor((60 - lat) / 2) AS BIGINT) AS gy FROM px) SELECT cls, is_crop, f.gx IS NOT NULL AS is_field, count(*) AS px FROM p LEFT JOIN f USING (gx, gy) GROUP BY ALL", "px fields")
def _(v: Views) -> DataFrame:
    return agreed(v)


def agreed(v: Views) -> DataFrame:
    index = lambda x, y: (scalars.bin_index(F.col(x), -180.0, 2.0).alias("gx"), scalars.bin_index(F.col(y), 60.0, 2.0, down=True).alias("gy"))
    crops = v.px.select("cls", (~F.col("cls").isin(3, 7, 11)).alias("is_crop"), *index("lon", "lat"))
    return classes.agreement(crops, v.fields.select(*index("cx", "cy")), ["gx", "gy"])


AGREED = "f AS (SELECT DISTINCT CAST(floor((cx + 180) / 2) AS BIGINT) AS gx, CAST(floor((60 - cy) / 2) AS BIGINT) AS gy FROM fields), c AS (SELECT cls, cls NOT IN (3, 7, 11) AS is_crop, f.gx IS NOT NULL AS is_field, count(*) AS px FROM (SELECT *, CAST(floor((lon + 180) / 2) AS BIGINT) AS gx, CAST(floor((60 - lat) / 2) AS BIGINT) AS gy FROM px) p LEFT JOIN f USING (gx, gy) GROUP BY ALL)"


@query("a24_p27_two_by_two", f"WITH {AGREED} SELECT is_crop, is_field, CAST(sum(px) AS BIGINT) AS px, round(100 * sum(px) / sum(sum(px)) OVER (), 9) AS pct, CASE WHEN is_crop AND is_field THEN 1 WHEN is_crop THEN 2 WHEN is_field THEN 3 END AS kind FROM c GROUP BY 1, 2", "px fields")
def _(v: Views) -> DataFrame:
    return classes.agreement_table(agreed(v)).withColumn("pct", r("pct"))


@query("a25_misses", f"WITH {AGREED} SELECT cls, CAST(sum(px) AS BIGINT) AS px, round(100 * sum(CASE WHEN NOT is_field THEN px ELSE 0 END) / sum(px), 9) AS pct FROM c GROUP BY 1 HAVING sum(px) >= 5 ORDER BY 100 * sum(CASE WHEN NOT is_field THEN px ELSE 0 END) / sum(px) DESC, cls LIMIT 15", "px fields")
def _(v: Views) -> DataFrame:
    return classes.misses(agreed(v), 5, 15, ~F.col("is_field")).withColumn("pct", r("pct"))


@query("j8_j9_terrain_cover", f"WITH a AS (SELECT {C7} AS cell, avg(cls) AS c FROM px GROUP BY 1), b AS (SELECT {C7} AS cell, avg(tc) AS elev FROM cube GROUP BY 1) SELECT cell, round(c, 9) AS c, round(coalesce(elev, 0), 9) AS elev FROM a LEFT JOIN b USING (cell)", "px cube")
def _(v: Views) -> DataFrame:
    cover = fold.fold_mean(v.px.withColumn("cls", F.col("cls").cast("double")), 7, "cls")
    dem = fold.fold_mean(v.cube, 7, "tc").select("cell", F.col("value").alias("elev"))
    return cover.join(dem, "cell", "left").select("cell", r("value").alias("c"), r(F.coalesce("elev", F.lit(0.0))).alias("elev"))


PARENT = f"(7::BIGINT << 58) + ({ROW} >> 2) * 536870912 + ({COL} >> 2)"


@query("j11_parent_join", f"WITH f AS (SELECT {C9} AS cell, avg(v) AS fine FROM px GROUP BY 1), c AS (SELECT {C7} AS parent, avg(tc) AS coarse FROM cube GROUP BY 1) SELECT cell, round(fine, 9) AS fine, round(coarse, 9) AS coarse FROM (SELECT *, {PARENT} AS parent FROM f) LEFT JOIN c USING (parent)", "px cube")
def _(v: Views) -> DataFrame:
    coarse = fold.fold_mean(v.cube, 7, "tc").select("cell", F.col("value").alias("coarse"))
    return zones.parent_join(fold.fold_mean(v.px, 9).select("cell", F.col("value").alias("fine")), coarse, 2).select("cell", r("fine").alias("fine"), r("coarse").alias("coarse"))


HZ9 = f"hz AS (SELECT cell, max(CASE WHEN zone IN ('V', 'VE') THEN 3 WHEN zone IN ('A', 'AE', 'AH', 'AO', 'A99', 'AR') THEN 2 WHEN zone = 'X' AND subty LIKE '%0.2%' THEN 1 WHEN zone = 'D' THEN 0 ELSE -1 END) AS zc FROM ({cells_sql(9)}) c JOIN hazard ON clon >= w AND clon < e AND clat >= s AND clat < n GROUP BY 1)"


def hazard_cells(v: Views, level: int = 9) -> DataFrame:
    rated = v.hazard.withColumn("zc", scalars.zone_severity(F.col("zone"), F.col("subty")))
    return zones.fill_boxes(rated, level, "fid").join(rated.select("fid", "zc"), "fid").groupBy("cell").agg(F.max("zc").alias("zc"))


@query("j12_two_ladders", f"WITH {HZ9}, p AS (SELECT {PARENT} AS cell, count(*) FILTER (zc >= 2) AS hits, least(1, count(*) FILTER (zc >= 2) / 16) AS share FROM hz GROUP BY 1), {FILL7} SELECT id, round(avg(coalesce(share, 0)), 9) AS share, count(*) AS cells FROM fill LEFT JOIN p USING (cell) GROUP BY 1", "zones hazard")
def _(v: Views) -> DataFrame:
    rolled = fold.share_of_children(hazard_cells(v), 2, F.col("zc") >= 2).withColumnRenamed("parent", "cell")
    return zones.fill_boxes(v.zones, 7).join(rolled, "cell", "left").groupBy("id").agg(r(F.avg(F.coalesce("share", F.lit(0.0)))).alias("share"), F.count(F.lit(1)).alias("cells"))


@query("j13_worst_class", f"WITH {HZ9}, b AS (SELECT id, cell FROM ({cells_sql(9)}) c JOIN buildings ON e0 > cx - 0.02 AND w0 <= cx + 0.02 AND n0 > cy - 0.02 AND s0 <= cy + 0.02) SELECT id, coalesce(max(zc), -1) AS zc FROM b LEFT JOIN hz USING (cell) GROUP BY 1", "buildings hazard")
def _(v: Views) -> DataFrame:
    return zones.worst_class(zones.fill_touched(boxes(v), 9), hazard_cells(v))


@query("j15_ring_widened", f"WITH m AS (SELECT id, cell, iy, ix FROM ({cells_sql(9)}) c JOIN buildings ON e0 > cx - 0.02 AND w0 <= cx + 0.02 AND n0 > cy - 0.02 AND s0 <= cy + 0.02), wd AS (SELECT DISTINCT id, cell + dy * 536870912 + dx AS cell FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)), f AS (SELECT {C9} AS cell, avg(v) AS v, avg(cls) AS c FROM px GROUP BY 1), t AS (SELECT id, avg(v) AS fire FROM m LEFT JOIN f USING (cell) GROUP BY 1), u AS (SELECT id, avg(c) AS fuel FROM wd JOIN f USING (cell) GROUP BY 1) SELECT id, round(fire, 9) AS fire, round(fuel, 9) AS fuel FROM t LEFT JOIN u USING (id)", "buildings px")
def _(v: Views) -> DataFrame:
    tight = zones.fill_touched(boxes(v), 9)
    cells = fold.with_cell(v.px, 9).groupBy("cell").agg(F.avg("v").alias("v"), F.avg("cls").alias("c"))
    fire = tight.join(cells, "cell", "left").groupBy("id").agg(F.avg("v").alias("fire"))
    fuel = zones.widened(tight).join(cells, "cell").groupBy("id").agg(F.avg("c").alias("fuel"))
    return fire.join(fuel, "id", "left").select("id", r("fire").alias("fire"), r("fuel").alias("fuel"))


@query("j21_j22_trimmed", "SELECT b.id, z.id AS zone FROM (SELECT * FROM buildings WHERE cx BETWEEN -115 AND -90 AND cy BETWEEN 28 AND 44) b JOIN zones z ON cx - 0.02 <= e AND cx + 0.02 >= w AND cy - 0.02 <= n AND cy + 0.02 >= s", "buildings zones")
def _(v: Views) -> DataFrame:
    from gridloom.sources.tables import in_box

    kept = in_box(boxes(v), -115, 28, -90, 44, "cx", "cy")
    box = lambda df: F.explode(zones.candidates(5, *[df[c] for c in "wsen"])).alias("at")
    b, z = kept.select("*", box(kept)), v.zones
    z = z.select(F.col("id").alias("zone"), *[F.col(c).alias(f"z{c}") for c in "wsen"], box(z))
    hit = geometry.overlaps(tuple(F.col(c) for c in "wsen"), tuple(F.col(f"z{c}") for c in "wsen"))
    return b.join(z, "at").where(hit).select("id", "zone").distinct()


# --- classes

@query("a15_ranking", "SELECT cls, count(*) AS n FROM px GROUP BY cls ORDER BY n DESC, cls LIMIT 14", "px")
def _(v: Views) -> DataFrame:
    return classes.top_classes(v.px, 14)


@query("a17_top_in_box", f"WITH {HITS} SELECT cls, count(*) AS n FROM hits WHERE lon BETWEEN -120 AND -80 GROUP BY 1 ORDER BY n DESC, cls LIMIT 10", "px fields")
def _(v: Views) -> DataFrame:
    return classes.top_classes(field_hits(v).where(F.col("lon").between(-120, -80)), 10)


@query("a18_timelapse", "SELECT year, cls, count(*) AS n FROM px WHERE cls IN (SELECT cls FROM px GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 6) AND lat BETWEEN 28 AND 44 GROUP BY 1, 2", "px")
def _(v: Views) -> DataFrame:
    return classes.area_by_year(v.px, 6, 1.0).select("year", "cls").join(v.px.where(F.col("lat").between(28, 44)), ["year", "cls"]).groupBy("year", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("a26_w3_composition", "SELECT year, cls, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY year), 9) AS pct FROM px GROUP BY 1, 2", "px")
def _(v: Views) -> DataFrame:
    return classes.composition(v.px).withColumn("pct", r("pct"))


@query("a27_change", "SELECT cls, count(*) FILTER (year = (SELECT min(year) FROM px)) AS first_n, count(*) FILTER (year = (SELECT max(year) FROM px)) AS last_n, count(*) FILTER (year = (SELECT max(year) FROM px)) - count(*) FILTER (year = (SELECT min(year) FROM px)) AS change FROM px GROUP BY 1", "px")
def _(v: Views) -> DataFrame:
    return classes.change(v.px)


@query("a19_field_summary", "SELECT count(*) AS fields, round(sum(2 * r * r), 9) AS area, round(quantile_cont(2 * r * r, 0.5), 9) AS median, round(max(2 * r * r), 9) AS largest FROM fields", "fields")
def _(v: Views) -> DataFrame:
    sized = field_rings(v).select(geometry.area(F.col("ring")).alias("a"))
    middle = fold.quantiles_by(sized, [], "a", {"median": 0.5}).select(r("median").alias("median"))
    one = sized.agg(F.count(F.lit(1)).alias("fields"), r(F.sum("a")).alias("area"), r(F.max("a")).alias("largest"))
    return one.unionByName(middle, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("fields", "area", "median", "largest")])


@query("a20_w1_w2_majority", f"WITH {HITS}, {MAJ} SELECT id, cls, n, total, round(purity, 9) AS purity, CAST(rn AS INT) AS rn FROM maj", "px fields")
def _(v: Views) -> DataFrame:
    return classes.field_majority(field_hits(v)).withColumn("purity", r("purity"))


@query("a21_crop_summary", f"WITH {HITS}, {MAJ} SELECT cls, count(*) AS fields, round(sum(2 * r * r), 9) AS area, round(quantile_cont(2 * r * r, 0.5), 9) AS median_area, round(avg(purity), 9) AS mean_purity FROM maj JOIN fields USING (id) WHERE rn = 1 GROUP BY 1", "px fields")
def _(v: Views) -> DataFrame:
    areas = field_rings(v).select("id", geometry.area(F.col("ring")).alias("area"))
    return classes.crop_summary(classes.field_majority(field_hits(v)), areas).select("cls", "fields", *[r(c).alias(c) for c in ("area", "median_area", "mean_purity")])


@query("a22_j19_mixed_fields", f"WITH {HITS}, {MAJ} SELECT a.id, a.cls AS first, b.cls AS second, round(a.purity, 9) AS purity, round(b.purity, 9) AS second_share FROM maj a JOIN maj b ON a.id = b.id WHERE a.rn = 1 AND b.rn = 2 ORDER BY a.purity, a.id LIMIT 12", "px fields")
def _(v: Views) -> DataFrame:
    return classes.mixed_fields(classes.field_majority(field_hits(v)), 12).withColumns({"purity": r("purity"), "second_share": r("second_share")})


CAMPAIGN_ITEMS = "SELECT CAST(o_custkey % 25 AS BIGINT) AS footprint, CAST(year(o_orderdate) AS INT) AS campaign, max(o_orderdate) AS date FROM orders GROUP BY 1, 2"


@query("a36_campaigns", f"WITH c AS ({cells_sql(6)}), aoi AS (SELECT DISTINCT cell FROM c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n), lk AS (SELECT id AS footprint, cell FROM c JOIN zones ON clon >= w AND clon < e AND clat >= s AND clat < n), i AS ({CAMPAIGN_ITEMS}), s AS (SELECT campaign, count(DISTINCT footprint) AS footprints, count(DISTINCT date) AS days, bool_and(dayofyear(date) < 106.8 OR dayofyear(date) > 303.2) AS leaf_off FROM i GROUP BY 1), h AS (SELECT campaign, count(DISTINCT cell) AS hit FROM i JOIN lk USING (footprint) GROUP BY 1), t AS (SELECT s.*, coalesce(hit, 0) / (SELECT count(*) FROM aoi) AS cov, days = 1 AS one_date FROM s LEFT JOIN h USING (campaign)), nr AS (SELECT *, cov >= (SELECT max(cov) FROM t) - 0.02 AS near FROM t), pk AS (SELECT campaign FROM nr WHERE near AND (one_date OR NOT EXISTS (SELECT 1 FROM nr x WHERE x.near AND x.one_date)) ORDER BY cov DESC, campaign DESC LIMIT 1) SELECT campaign, footprints, days, round(cov, 9) AS cov, one_date, leaf_off, campaign = (SELECT campaign FROM pk) AS best FROM nr", "zones")
def _(v: Views) -> DataFrame:
    """Flights over the zones' area: an order is an item over the zone of its customer, its year is the campaign."""
    day, footprint = F.col("o_orderdate"), F.col("o_custkey") % 25
    items = v.orders.select(footprint.cast("long").alias("footprint"), F.year(day).alias("campaign"), day.alias("date"))
    lookup = zones.fill_boxes(v.zones, 6, pieces=False).withColumnRenamed("id", "footprint")
    scored = classes.best_campaign(classes.campaign_scores(items, lookup, lookup.select("cell").distinct(), 37.0))
    return scored.select("campaign", "footprints", "days", r("cov").alias("cov"), "one_date", "leaf_off", "best")
