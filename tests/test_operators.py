"""Properties of the operators: areas, partitions of space, merges, recurrences, streams."""

import datetime as dt
import glob
import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, grid, proj, scalars
from gridloom.operators import fold, heat, regions, terrain, zones
from gridloom.plans import core, terrain_heat
from gridloom.sources import tables


def places(spark, n=400):
    return spark.range(n).select(F.col("id"), (F.col("id") * 0.37 % 170 - 85).alias("lat"), (F.col("id") * 7.13 % 360 - 180).alias("lon"), (F.col("id") % 7 / 3.0).alias("v"))


def test_cells_have_parents_children_and_centres(spark):
    df = places(spark).withColumn("cell", grid.cell(F.col("lat"), F.col("lon"), 9))
    lat, lon = grid.centre(F.col("cell"))
    again = df.select("cell", grid.cell(lat, lon, 9).alias("again"), grid.parent(F.col("cell"), 3).alias("up"), grid.cell(F.col("lat"), F.col("lon"), 6).alias("coarse"))
    assert again.where("cell != again OR up != coarse").count() == 0
    assert math.isclose(grid.area_km2(3), 4 * grid.area_km2(4))


def test_disk_wraps_and_stops_at_poles(spark):
    df = spark.createDataFrame([(0.0, 179.9), (89.9, 0.0)], "lat double, lon double")
    sizes = df.select(F.size(grid.disk(grid.cell(F.col("lat"), F.col("lon"), 5), 1)).alias("n")).collect()
    assert [r.n for r in sizes] == [5, 4]


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(-120.0, 35.0), (-75.5, 44.25)], "lon double, lat double")
    x, y = proj.albers(F.col("lon"), F.col("lat"))
    lon, lat = proj.albers_inverse(F.col("ax"), F.col("ay"))
    for r in df.select("lon", "lat", x.alias("ax"), y.alias("ay")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9


def test_nan_and_null_are_not_present(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id int, v double")
    assert [r.id for r in df.where(scalars.present(F.col("v"))).collect()] == [1]
    empty = df.where("false").withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    assert fold.fold_mean(empty, 5).count() == 0 and fold.fold_mode(empty.withColumn("cls", F.lit(1)), 5).count() == 0


def test_partials_merge_to_the_global_fold(spark):
    df = places(spark)
    parts = fold.partial_fold(df.withColumn("tile", F.col("id") % 5), 3, by=["tile"])
    merged = {r.cell: (round(r.value, 9), r.n) for r in fold.merge_partials(parts).collect()}
    assert merged == {r.cell: (round(r.value, 9), r.px) for r in fold.fold_mean(df, 3).collect()}


def test_mode_takes_the_smaller_class_on_ties(spark):
    df = spark.createDataFrame([(10.0, 10.0, 4), (10.0, 10.0, 2)], "lat double, lon double, cls int")
    assert fold.fold_mode(df, 4).first().cls == 2


def test_centre_fill_partitions_space(spark):
    boxes = spark.createDataFrame([(1, -10.0, 0.0, 0.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0)], "id int, w double, s double, e double, n double")
    filled = zones.fill_boxes(boxes, 8)
    assert filled.count() == filled.select("cell").distinct().count()
    touched = zones.fill_touched(boxes, 8)
    assert filled.join(touched, ["id", "cell"], "left_anti").count() == 0


def test_even_odd_with_a_hole(spark):
    outer = geometry.box_ring(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))
    hole = geometry.box_ring(*map(F.lit, (4.0, 4.0, 6.0, 6.0)))
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 1.0)], "x double, y double")
    got = [r.i for r in df.select(geometry.contains_even_odd(F.array(outer, hole), F.col("x"), F.col("y")).alias("i")).collect()]
    assert got == [True, False, False]


def film(spark, values):
    rows = [(1, f, v, 0.0) for f, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell int, f int, hi double, mm double")


def test_sustained_matches_the_plain_recurrence(spark):
    values = [20.0, 30.0, None, 35.0, float("nan"), 10.0]
    for first in (False, True):
        for nan in ("decay", "hold"):
            a, load, expected = 2 ** (-1 / 6), 0.0, []
            for f, x in enumerate(values):
                missing = x is None or math.isnan(x)
                if not (missing and nan == "hold"):
                    load = a * load + (1 - a) * (0 if missing else max(0, x - 18))
                if f == 0 and not first:
                    load = 0.0
                expected.append(load)
            got = [r.load for r in heat.sustained(film(spark, values), 6, 18, include_first=first, nan=nan).orderBy("f").collect()]
            assert got == pytest.approx(expected)


def test_window_form_equals_fold_form_without_rain(spark):
    df = film(spark, [20.0, 30.0, 25.0, 35.0, 10.0])
    one = [r.load for r in heat.sustained(df, 6, 18, include_first=True).orderBy("f").collect()]
    assert one == pytest.approx([r.load for r in heat.sustained_window(df, 6, 18).orderBy("f").collect()])


def test_regions_follow_a_long_snake(spark):
    snake = [(0, x) for x in range(40)] + [(1, 39)] + [(2, x) for x in range(39, -1, -1)]
    df = spark.createDataFrame([(1, y, x) for y, x in snake] + [(1, 9, 9), (2, 0, 0)], "k int, y int, x int")
    got = {(r.k): (r.cells, r.patches, r.largest) for r in regions.patches(regions.pixel_regions(df, ["k"]), ["k"]).collect()}
    assert got == {1: (82, 2, 81), 2: (1, 1, 1)}


def test_hillshade_of_a_plain_is_even(spark):
    df = spark.createDataFrame([(y, x, 5.0) for y in range(4) for x in range(4)], "y int, x int, v double")
    assert {round(r.shade, 6) for r in terrain.hillshade(df).collect()} == {round(math.sin(math.radians(45)), 6)}


def test_time_window_swaps_clamps_and_rejects():
    a, b = tables.time_window("2024-01-09", "2024-01-05", "2024-01-06", "2024-02-01", 14)
    assert (a, b) == (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 9, 23, 59, 59))
    with pytest.raises(ValueError):
        tables.time_window("2024-01-01", "2024-01-30", "2024-01-01", "2024-02-01", 14)


def test_file_index_reads_files_without_extent(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 5.0, 6.0, 6.0), ("c", None, None, None, None)], "file string, xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.file for r in tables.files_over(df, 0.5, 0.5, 2, 2).collect()) == ["a", "c"]


def test_predicates_reach_the_scan(spark, tmp_path):
    places(spark).write.parquet(str(tmp_path / "t"))
    plan = tables.in_box(spark.read.parquet(str(tmp_path / "t")), -10, -10, 10, 10).select("v")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lon), IsNotNull(lat), GreaterThanOrEqual(lon,-10.0)" in plan


def test_window_memory_of_long_films(spark):
    """Films of more blocks than powers of a half-life fit in a double, with frames left out and frames without a value."""
    rows = [(c, f, None if f % 7 == 3 else 20.0 + (f * 37 % 11) if f % 900 < 300 else 0.0, 0.0) for c in (1, 2) for f in range(c * 40, 3000) if f % 13]
    df = spark.createDataFrame(rows, "cell long, f int, hi double, mm double")
    a, expected, last = 2 ** (-1 / 1.5), {}, {}
    for c, f, hi, _ in rows:
        load, at = last.get(c, (0.0, f))
        load = load * a ** (f - at) + (1 - a) * max(0.0, (hi or 0.0) - 16)
        expected[c, f], last[c] = load, (load, f)
    got = {(r.cell, r.f): r.load for r in heat.sustained_window(df, 1.5, 16).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in expected)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_heat_index_by_hand(spark):
    """20 C and 50 %: 68 F, simple formula 0.5 (68 + 61 + 0 + 4.7) = 66.85 F; 35 C and 60 %: the regression."""
    f = lambda tc, rh: scalars.heat_index(F.lit(tc), F.lit(rh))
    mild, hot = one(spark, f(20.0, 50.0), f(35.0, 60.0))
    assert mild == pytest.approx((66.85 - 32) * 5 / 9) and round(mild, 2) == 19.36
    t, r = 95.0, 60.0
    full = -42.379 + 2.04901523 * t + 10.14333127 * r - 0.22475541 * t * r - 0.00683783 * t * t - 0.05481717 * r * r + 0.00122874 * t * t * r + 0.00085282 * t * r * r - 0.00000199 * t * t * r * r
    assert hot == pytest.approx((full - 32) * 5 / 9)


def test_hazard_classes_by_hand(spark):
    rows = [("VE", None, 3), (" v ", None, 3), ("AE", "FLOODWAY", 2), ("A99", None, 2), ("AREA NOT INCLUDED", None, -1), ("X", "0.2 PCT ANNUAL CHANCE FLOOD HAZARD", 1), ("X", "AREA WITH REDUCED RISK DUE TO LEVEE", -1), ("X", None, -1), ("D", None, 0), ("OPEN WATER", None, -1), (None, None, -1)]
    df = spark.createDataFrame(rows, "zone string, subty string, expected int")
    assert df.where(scalars.zone_severity(F.col("zone"), F.col("subty")) != F.col("expected")).count() == 0


def test_season_of_leaves_by_hand(spark):
    rows = [(35.0, 105.0, 305.0), (45.0, 114.0, 296.0), (-45.0, 114.0, 296.0), (0.0, 73.5, 336.5), (89.0, 153.6, 256.4)]
    for lat, first, last in rows:
        assert one(spark, *scalars.leaf_season(F.lit(lat))) == pytest.approx((first, last))
    days = spark.createDataFrame([(dt.date(2023, 4, 14),), (dt.date(2023, 4, 15),), (dt.date(2023, 11, 1),), (dt.date(2023, 11, 2),)], "d date")
    assert [r[0] for r in days.orderBy("d").select(scalars.leaf_on(F.col("d"), F.lit(35.0))).collect()] == [False, True, True, False]


def test_voltages(spark):
    rows = [({"voltage": "115000;230000"}, 230000), ({"voltage": " 400 , x"}, 400), ({"voltage": "none"}, 0), ({"a": "5"}, 0), (None, 0)]
    df = spark.createDataFrame(rows, "tags map<string,string>, v long")
    assert df.where(scalars.voltage(F.col("tags")) != F.col("v")).count() == 0


def test_focal_mean_with_a_hole(spark):
    values = [[1.0, 2.0, 3.0], [4.0, None, 6.0], [1.0, 2.0, 5.0]]
    rows = [(y, x, v) for y, row in enumerate(values) for x, v in enumerate(row)]
    expected = {}
    for y, x, _ in rows:
        near = [v for b, a, v in rows if abs(a - x) <= 1 and abs(b - y) <= 1 and v is not None]
        expected[y, x] = sum(near) / len(near)
    whole = spark.createDataFrame(rows, "y int, x int, v double")
    assert {(r.y, r.x): r["mean"] for r in terrain.focal_mean(whole, 1).collect()} == pytest.approx(expected)
    assert expected[1, 1] == 3.0
    del expected[1, 1]
    assert {(r.y, r.x): r["mean"] for r in terrain.focal_mean(whole.where("v is not null"), 1).collect()} == pytest.approx(expected)


def test_bilinear_goes_on_beyond_the_outer_pixels(spark):
    raster = spark.createDataFrame([(y, x, 3.0 * y - 2.0 * x) for y in range(4) for x in range(5)], "y int, x int, v double")
    points = spark.createDataFrame([(0, -0.5, -0.5), (1, 3.5, 4.5), (2, 1.25, 2.5), (3, -0.6, 1.0), (4, 1.0, 4.6)], "id int, row double, col double")
    got = {r.id: r.sample for r in terrain.bilinear(points, raster, 4, 5).collect()}
    assert got == pytest.approx({0: -0.5, 1: 1.5, 2: -1.25})
    holed = raster.where("NOT (y = 1 AND x = 2)")
    assert 2 not in {r.id for r in terrain.bilinear(points, holed, 4, 5).collect()}


def test_hillshade_of_slopes(spark):
    """Rows run north: a slope that falls to the north-west faces the sun, its opposite is dark; scale and sizes count."""
    def shade(fx, fy, **more):
        df = spark.createDataFrame([(y, x, fx * x + fy * y) for y in range(4) for x in range(4)], "y int, x int, v double")
        return {round(r.shade, 9) for r in terrain.hillshade(df, **more).collect()}

    lit, dark = shade(1.0, -1.0), shade(-1.0, 1.0)
    c = math.cos(math.radians(45))
    assert lit == {round(min(1.0, (2 * c * c + c) / math.sqrt(3)), 9)} and dark == {0.0}
    assert shade(2.0, -6.0, size=4.0, size_y=12.0, scale=2.0) == lit


def test_mosaic_takes_the_deepest(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 0.0, 25.0, 10.0)], "source int, w double, s double, e double, n double")
    pixels = spark.createDataFrame([(s, 0, x, float(x), 5.0, float(s)) for s in (1, 2) for x in range(12)], "source int, y int, x int, lon double, lat double, v double")
    got = {r.x: (r.v, r.sources) for r in terrain.mosaic(pixels, boxes).collect()}
    assert got == {**{x: (1.0, 1) for x in range(5)}, 5: (1.0, 2), 6: (1.0, 2), 7: (1.0, 2), 8: (1.0, 2), 9: (2.0, 2), 10: (2.0, 2), 11: (2.0, 1)}
    lattice = pixels.select("y", "x").distinct()
    assert terrain.covered_share(lattice, terrain.mosaic(pixels.where("x < 3"), boxes)).first().covered == 0.25


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_quantiles_by_digits_are_exact(spark):
    groups = {"a": [float(i * 37 % 101) ** 3 for i in range(500)], "b": [5.0] * 40 + [1e300, -1e300], "c": [2.5], None: [1e-9 * i for i in range(7)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p2, r.p50, r.p98) for r in fold.quantiles_by(df, ["k"], "v", {"p2": 0.02, "p50": 0.5, "p98": 0.98}).collect()}
    assert got == {k: pytest.approx(tuple(quantile(vs, p) for p in (0.02, 0.5, 0.98))) for k, vs in groups.items()}
    assert fold.quantiles(df.where("false"), "v", [0.5]).collect() == []


def test_long_films_in_time_that_grows_with_their_frames(spark):
    import time

    n = 20_000
    rows = [(1, f, None if f % 7 == 3 else 20.0 + f * 37 % 11, 1.0 if f % 50 == 0 else 0.0) for f in range(5, n) if f % 1000 > 5]
    df = spark.createDataFrame(rows, "cell int, f int, hi double, mm double")
    for first in (False, True):
        a, load, expected = 2 ** (-1 / 24), 0.0, []
        for i, (_, _f, hi, mm) in enumerate(rows):
            load = (a * load + (1 - a) * max(0.0, (hi or 0.0) - 22)) * (1 - 0.5 * min(1.0, mm / 2.5))
            load = 0.0 if i == 0 and not first else load
            expected.append(load)
        began = time.perf_counter()
        got = [r.load for r in heat.sustained(df, 24, 22, 0.5, include_first=first).orderBy("f").collect()]
        assert time.perf_counter() - began < 20 and got == pytest.approx(expected, abs=1e-9)


def test_boxes_and_rings_over_the_date_line(spark):
    boxes = spark.createDataFrame([(1, 178.0, 0.0, -178.0, 4.0), (2, 178.0, 0.0, 182.0, 4.0)], "id int, w double, s double, e double, n double")
    touched = {r.id: r.n for r in zones.fill_touched(boxes, 7).groupBy("id").agg(F.count("*").alias("n")).collect()}
    filled = {r.id: r.cells for r in zones.fill_boxes(boxes, 7).groupBy("id").agg(F.sort_array(F.collect_list("cell")).alias("cells")).collect()}
    plain = zones.fill_boxes(spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0)], boxes.schema), 7).count()
    assert touched[1] == touched[2] < 30 and filled[1] == filled[2] and abs(len(filled[1]) - plain) <= 4
    ringed = boxes.where("id = 2").select("id", geometry.box_ring(*map(F.col, "wsen")).alias("ring"))
    assert sorted(r.cell for r in zones.fill_centres(ringed, 7).collect()) == filled[1]


def test_index_chooses_files(spark, tmp_path):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 20 * 1.0).alias("x"), (F.col("id") / 20).alias("y"), F.floor(F.col("id") % 20 / 5).alias("strip"))
    path = str(tmp_path / "t")
    df.repartition("strip").write.partitionBy("strip").parquet(path)
    index = tables.file_index(spark, path, "x", "y")
    assert index.count() == 4
    got = tables.read_over(spark, index, (0.0, 0.0, 4.0, 3.0), "x", "y", df.drop("strip").schema)
    assert {r.id for r in got.collect()} == {r.id for r in df.where("x <= 4 AND y <= 3").collect()}
    assert len(got.inputFiles()) == 1 and tables.read_over(spark, index, (90.0, 0.0, 91.0, 1.0), "x", "y", df.schema).count() == 0


def test_struct_boxes_prune_the_scan(spark, tmp_path):
    boxed = spark.range(10).select("id", F.struct(*[F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    boxed.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(tables.strictly_inside(1, 1, 5, 5)).select("id")._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: ")[1].splitlines()[0]
    assert "bbox.xmax" in pushed and "GreaterT" in pushed


def test_tiles_that_disagree(spark):
    a = spark.createDataFrame([(1, 2.5, "x")], "k int, v float, only_a string")
    b = spark.createDataFrame([(7.25, 1 << 40, 3)], "v double, k long, mixed int")
    c = spark.createDataFrame([("text",)], "mixed string")
    got = fold.union_tiles([a, b, c])
    assert dict(got.dtypes) == {"k": "bigint", "v": "double", "only_a": "string", "mixed": "string"} and got.count() == 3


def test_level_by_budget_counts_only_what_the_bound_leaves_open(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0)], "level int, x double, y double")
    assert tables.level_for_box(df, [1, 2, 4], (0, 0, 10, 10), 1.0, 100) == 1  # the bound fits
    assert tables.level_for_box(df, [1, 2, 4], (0, 0, 10, 10), 1.0, 50) == 1  # counted: one row
    assert tables.level_for_box(df, [1, 2, 4], (0, 0, 100, 100), 1.0, 20) == 4  # far over at 1 and 2
    # 360 degrees over 20 on 400 pixels are 7200 pixels, 900 cells of 8 pixels: 2^(r+1) columns up to that
    assert tables.level_in_view(-10.0, 10.0, 400, 9) == 8 and tables.level_in_view(-10.0, 10.0, 400, 3) == 3


def test_written_tables_can_be_deleted(spark):
    a, b = tables.written(spark.range(3)), tables.written(spark.range(4))
    tables.discard(a)
    assert b.count() == 4 and a.written_path.startswith(tables.session_dir(spark))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(a.written_path).count()


def odd_doubles():
    import random
    import struct

    rnd = random.Random(4)
    some = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7e308, -1.7e308, 1.7976931348623157e308, 1.0, 2.0, 3.0, 0.1]
    some += [f(2.0**e) for e in range(-1070, 1024, 37) for f in (lambda x: x, lambda x: -x, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, math.inf))]
    drawn = [struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] for _ in range(500)]
    return some + [x for x in drawn if not math.isnan(x)]


def test_codes_keep_the_order_of_all_doubles(spark):
    from gridloom.functions import scalars

    values = odd_doubles()
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.ordered_code(F.col("v")).alias("code"))
    rows = df.select("v", "code", scalars.coded_value(F.col("code")).alias("back")).collect()
    assert all(r.v == r.back for r in rows)
    in_order = sorted(rows, key=lambda r: r.v)
    assert all((a.code < b.code) == (a.v < b.v) for a, b in zip(in_order, in_order[1:], strict=False))


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, math.inf], [-1.7e308, 0.0, 1.7e308], [-math.inf, 1.0], [0.0, -0.0, 5e-324], odd_doubles()])
def test_quantiles_of_infinite_and_huge_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ps = {f"p{k}": k / 8 for k in range(9)}
    got = fold.quantiles_by(df, [], "v", ps).first()
    values = sorted(values)
    for name, p in ps.items():
        at = (len(values) - 1) * p
        low, high, part = values[math.floor(at)], values[math.ceil(at)], at % 1
        if low == high or not part:
            assert got[name] == low
        elif math.isinf(low) and math.isinf(high):
            assert math.isnan(got[name])
        else:
            assert got[name] == pytest.approx(low * (1 - part) + high * part)


def test_counts_of_tiles_merge(spark):
    df = spark.createDataFrame([("a", float(i * 7919 % 503)) for i in range(900)] + [(None, 1.0), ("a", None)], "k string, v double")
    parts = fold.radix_counts(df.where("v < 200"), ["k"], "v").unionByName(fold.radix_counts(df.where("v >= 200"), ["k"], "v"))
    assert sorted(map(tuple, fold.merged_counts(parts, ["k"]).select("digit", "n", "low", "high").collect())) == sorted(map(tuple, fold.radix_counts(df, ["k"], "v").select("digit", "n", "low", "high").collect()))


def test_contraction_takes_time_that_grows_with_the_edges():
    import time

    import numpy as np

    from gridloom.operators.components import roots

    took = []
    for n in (400_000, 800_000):
        began = time.perf_counter()
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        nodes, root = roots(np.concatenate([u, np.arange(n) * 2 + 1]), np.concatenate([v, np.arange(n) * 2]))
        took.append(time.perf_counter() - began)
        assert (root == nodes // 2 * 2).all()
    assert took[1] < max(1.0, 3 * took[0])
    chain, shuffled = np.arange(200_000), np.random.default_rng(1).permutation(199_999)
    nodes, root = roots(chain[1:][shuffled], chain[:-1][shuffled])
    assert (root == 0).all()


def test_partitions_of_many_batches_are_contracted(spark, monkeypatch):
    from gridloom.operators import components

    edges = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("v")).select((F.col("v") + 1).alias("u"), "v").coalesce(1)
    kept = components.contract(edges)
    assert kept.count() == 60_000 and kept.agg(F.max("v")).first()[0] == 0


def cells_plain(points, level):
    """The cells whose centre is inside a ring, by a test of every cell of the level."""
    out = set()
    for row in range(1 << level):
        lat = math.degrees(math.asin((row + 0.5) / (1 << level) * 2 - 1))
        for col in range(-(2 << level), 2 * (2 << level)):
            lon = (col + 0.5) / (2 << level) * 360 - 180
            hit = False
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
                if (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax:
                    hit = not hit
            if hit:
                out.add((level << 58) + (row << 29) + col % (2 << level))
    return out


RINGS = {
    "comb": [(-100, 10), (-40, 10), (-40, 60), (-50, 15), (-60, 60), (-70, 15), (-80, 60), (-90, 15), (-100, 60)],
    "speck": [(10.01, 10.01), (10.02, 10.01), (10.015, 10.02)],
    "over": [(150, -30), (200, -50), (215, 20), (170, 30)],
    "bow": [(0, 0), (40, 40), (40, 0), (0, 40)],
    "pole": [(-170, 70), (170, 70), (170, 90), (-170, 90)],
}


def ringed(spark, names):
    return spark.createDataFrame([(n, [(float(x), float(y)) for x, y in RINGS[n]], 1, "own") for n in names], "id string, ring array<struct<x:double,y:double>>, row int, edges string")


@pytest.mark.parametrize("coarse", [2, 64])
def test_cover_gives_the_same_cells_as_a_test_of_all(spark, monkeypatch, coarse):
    monkeypatch.setattr(zones, "COARSE", coarse)
    got = {}
    for r in zones.fill_centres(ringed(spark, RINGS), 6).collect():
        got.setdefault(r.id, set()).add(r.cell)
    assert got == {n: c for n in RINGS if (c := cells_plain(RINGS[n], 6))}


def test_cover_keeps_rows_small_and_edges_few(spark):
    wavy = [(x / 10, 40 + 3 * math.sin(x) + (x % 7) / 10) for x in range(-900, 900)] + [(90.0, -40.0), (-90.0, -40.0)]
    df = spark.createDataFrame([("wavy", wavy)], "id string, ring array<struct<x:double,y:double>>")
    cover = zones.cover(df, 8).select("cell", "inside", F.size("edges").alias("n")).cache()
    assert cover.where("inside AND n > 0").count() == 0 and cover.agg(F.max("n")).first()[0] < 900
    assert cover.where("inside").count() > 5 * cover.where("NOT inside").count()
    assert cover.count() == cover.select("cell").distinct().count()


def test_points_in_rings_equal_a_plain_test(spark):
    points = [(i, (i * 7919 % 3600) / 10 - 180, (i * 104729 % 1790) / 10 - 89.5) for i in range(4000)]
    df = spark.createDataFrame(points, "p int, lon double, lat double")
    got = {(r.p, r.id) for r in zones.points_in(df, ringed(spark, RINGS), 5).select("p", "id").collect()}

    def inside(x, y, ring):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    assert got == {(i, n) for i, x, y in points for n, ring in RINGS.items() if any(inside(x + turn, y, ring) for turn in (-360, 0, 360))}


def test_wind_and_missing_indices(spark):
    """Vent cuts what a frame adds; a NaN is missing in every form; gaps are no steps of the fold and decay in the window."""
    a = 2 ** (-1 / 6)
    his, winds = [25.0, 30.0, math.nan, 28.0, None, 40.0], [0.0, 5.0, 1.0, 30.0, 2.0, None]
    rows = [(1, f, hi, 0.0, w) for f, (hi, w) in enumerate(zip(his, winds, strict=True))]
    df = spark.createDataFrame(rows, "cell int, f int, hi double, mm double, wind double")
    load, expected = 0.0, [0.0]
    for hi, w in list(zip(his, winds, strict=True))[1:]:
        x = 0.0 if hi is None or math.isnan(hi) else max(0.0, hi - 20) * max(0.0, 1 - 0.5 * (w or 0.0) / 10)
        load = a * load + (1 - a) * x
        expected.append(load)
    assert [r.load for r in heat.sustained(df, 6, 20, vent=0.5).orderBy("f").collect()] == pytest.approx(expected)
    assert [r.load for r in heat.swept(df, [(9, 9), (6, 20, 0, 0.5)]).where("setting = 1").orderBy("f").collect()] == pytest.approx(expected)
    windowed = [r.load for r in heat.sustained_window(df, 6, 20).orderBy("f").collect()]
    assert windowed == pytest.approx([r.load for r in heat.sustained(df, 6, 20, include_first=True).orderBy("f").collect()]) and not any(map(math.isnan, windowed))
    gap = df.where("f in (0, 1, 5)")
    assert heat.sustained(gap, 6, 20, include_first=True).where("f = 5").first().load != pytest.approx(heat.sustained_window(gap, 6, 20).where("f = 5").first().load)


def test_windows_of_several_blocks(spark):
    """Half-lives so short that powers are counted anew many times in a film."""
    rows = [(c, f, 20.0 + (f * 37 + c) % 11) for c in (1, 2) for f in range(3000)]
    df = spark.createDataFrame(rows, "cell int, f int, hi double").withColumn("mm", F.lit(0.0))
    got = {(r.cell, r.f): r.load for r in heat.sustained_window(df, 0.5, 22).collect()}
    assert got == pytest.approx({(r.cell, r.f): r.load for r in heat.sustained(df, 0.5, 22, include_first=True).collect()}, abs=1e-9)


def spoiled(path):
    """Zeroes over all pages of a Parquet file; the footer stays."""
    with open(path, "r+b") as f:
        f.seek(-8, 2)
        at = f.tell() - int.from_bytes(f.read(4), "little")
        f.seek(4)
        f.write(b"\0" * (at - 4))


def test_extents_are_read_from_footers_alone(spark, tmp_path):
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    spark.range(400).select("id", (F.col("id") % 20 * 1.0).alias("x"), (F.col("id") / 20).alias("y")).repartitionByRange(4, "id").write.parquet(str(path))
    expected = {(r.xmin, r.ymin, r.xmax, r.ymax) for r in tables.extent_index_by_scan(spark.read.parquet(str(path)).withColumn("file", F.col("_metadata.file_path")), "x", "y").collect()}
    for f in glob.glob(f"{path}/part-*"):
        spoiled(f)
    index = tables.file_index(spark, str(path), "x", "y")
    assert {tuple(r)[1:] for r in index.collect()} == expected and len(expected) == 4
    with pytest.raises(Exception, match="parquet|Parquet|FAILED_READ_FILE|decompress|Expected"):
        spark.read.parquet(str(path)).agg(F.sum("x")).collect()
    table = pa.table({"x": [1.0, 2.0], "y": [3.0, 4.0]})
    (tmp_path / "u").mkdir()
    pq.write_table(table, tmp_path / "u" / "a.parquet", write_statistics=False)
    pq.write_table(table, tmp_path / "u" / "b.parquet", row_group_size=1)
    groups = tables.group_index(spark, str(tmp_path / "u"), "x", "y").collect()
    assert sorted((r.file[-9:], r.row_group, r.rows, r.xmin, r.ymax) for r in groups) == [("a.parquet", 0, 2, None, None), ("b.parquet", 0, 1, 1.0, 3.0), ("b.parquet", 1, 1, 2.0, 4.0)]
    index = tables.file_index(spark, str(tmp_path / "u"), "x", "y")
    assert [r.file[-9:] for r in tables.files_over(index, 90, 90, 91, 91).collect()] == ["a.parquet"]


def test_clustered_tables_touch_few_groups(spark, tmp_path):
    df = spark.range(40_000).select("id", (F.col("id") * 7919 % 1000 / 10.0).alias("x"), (F.col("id") * 104729 % 997 / 10.0).alias("y"))
    tables.write_clustered(df, str(tmp_path / "a"), "x", "y", (0.0, 0.0, 100.0, 100.0), group_bytes=1 << 14)
    df.repartition(4).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "b"))
    met = []
    for name in "ab":
        groups = tables.group_index(spark, str(tmp_path / name), "x", "y")
        total = groups.agg(F.sum("rows")).first()[0]
        met.append(tables.files_over(groups, 20, 20, 30, 30).agg(F.sum("rows")).first()[0] / total)
    assert met[0] < 0.35 and met[1] == 1.0
    index = tables.file_index(spark, str(tmp_path / "a"), "x", "y")
    got = tables.read_over(spark, index, (20.0, 20.0, 30.0, 30.0), "x", "y", df.schema)
    assert {r.id for r in got.collect()} == {r.id for r in df.where("x BETWEEN 20 AND 30 AND y BETWEEN 20 AND 30").collect()}


def test_blocks_are_pruned_before_files_are_opened(spark, tmp_path):
    import glob

    cube = spark.range(20_000).select((F.col("id") % 40).cast("int").alias("x"), (F.col("id") / 40 % 50).cast("int").alias("y"), (F.col("id") / 2000).cast("int").alias("t"))
    path = str(tmp_path / "store")
    tables.write_blocks(cube, path, 10, ["t"])
    mask = spark.createDataFrame([(3, 5), (4, 6), (45, 39)], "y int, x int")
    got = tables.read_blocks(spark, path, mask, 10)
    assert {r.block for r in got.select("block").distinct().collect()} == {0, 4 * 2**31 + 3}
    assert got.count() == tables.in_blocks(cube, mask, 10).count() == 2000
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    for f in glob.glob(f"{path}/block=*/part-*"):  # (4, 0) and (0, 3) as well
        if "block=0/" not in f and f"block={4 * 2**31 + 3}/" not in f:
            spoiled(f)
    assert got.agg(F.sum("t")).first()[0] == tables.in_blocks(cube, mask, 10).agg(F.sum("t")).first()[0]


@pytest.mark.parametrize(("radius", "tile"), [(0, 4), (1, 4), (5, 4), (3, 256)])
def test_focal_means_over_tiles_equal_a_plain_version(spark, radius, tile):
    """Holes, missing values, negative places, several rasters; tiles smaller than the raster and than the square."""
    rows = [(k, y, x, None if (y * 5 + x) % 7 == 0 else float("nan") if (y + x) % 11 == 0 else float((y * 31 + x * 17) % 23)) for k in ("a", None) for y in range(-7, 9) for x in range(-5, 12) if (y + 2 * x) % 13]
    df = spark.createDataFrame(rows, "k string, y int, x int, v double")
    held = {(k, y, x): v for k, y, x, v in rows if v is not None and not math.isnan(v)}
    expected = {}
    for k, y, x, _ in rows:
        near = [held[k, b, a] for b in range(y - radius, y + radius + 1) for a in range(x - radius, x + radius + 1) if (k, b, a) in held]
        expected[k, y, x] = pytest.approx(sum(near) / len(near)) if near else None
    got = {(r.k, r.y, r.x): r["mean"] for r in terrain.focal_mean(df, radius, by=("k",), tile=tile).collect()}
    assert got == expected


def test_mosaic_by_lookup_takes_the_deepest_that_has_a_value(spark):
    """Two sources of different pixel sizes, one with a hole."""
    sources = spark.createDataFrame([(1, "degrees", 0.0, 10.0, 1.0, 1.0, 0.0, 0.0, 10.0, 10.0), (2, "degrees", 4.0, 10.0, 0.5, 2.5, 4.0, 0.0, 12.0, 10.0)], "source int, kind string, left double, top double, dx double, dy double, w double, s double, e double, n double")
    pixels = spark.createDataFrame([(1, y, x, float(y * 100 + x)) for y in range(10) for x in range(10)] + [(2, y, x, None if x == 8 else float(-y * 100 - x)) for y in range(4) for x in range(16)], "source int, row int, col int, v double")
    lattice = spark.createDataFrame([(0, 0, 1.5, 5.5), (0, 1, 8.9, 5.5), (0, 2, 8.2, 5.5), (0, 3, 11.9, 0.1), (0, 4, 13.0, 5.0)], "y int, x int, lon double, lat double")
    got = {r.x: (r.v, r.source) for r in terrain.mosaic_by_lookup(lattice, sources, pixels).collect()}
    assert got == {0: (401.0, 1), 1: (-109.0, 2), 2: (408.0, 1), 3: (-315.0, 2)}


def test_loads_are_those_of_the_recurrence_to_the_last_bit(spark):
    """Sums made in another order differ in their last bits, and then by one in the ninth decimal of some row of a long table."""
    rows = [(c, f, None if f % 7 == 3 else 15 + (f * f * 37 + c * 11) % 2801 / 100, 2.5 * (f % 5 == 0)) for c in range(4) for f in range(500)]
    df = spark.createDataFrame(rows, "cell long, f int, hi double, mm double").repartition(3)
    a, new = 2 ** (-1 / 12), float(1 - Decimal(repr(2 ** (-1 / 12))))
    for first, nan, wash in ((True, "hold", 0.0), (False, "decay", 0.4), (True, "decay", 0.0)):
        expected, load = {}, 0.0
        for c, f, hi, mm in rows:
            if f == 0:
                load = 0.0
            if hi is not None or nan == "decay":
                load = (a * load + new * max(0.0, (hi or 0.0) - 16)) * (1 - wash * min(1.0, mm / 2.5))
            if f == 0 and not first:
                load = 0.0
            expected[c, f] = load
        assert {(r.cell, r.f): r.load for r in heat.sustained(df, 12, 16, wash, first, nan).collect()} == expected
        assert {(r.cell, r.f): r.load for r in heat.swept(df, [(3, 9), (12, 16, wash)], include_first=first, nan=nan).where("setting = 1").collect()} == expected
    assert {(r.cell, r.f): r.load for r in heat.sustained_window(df, 12, 16).collect()} == expected


def test_loads_are_rounded_as_the_sql_rounds(spark):
    """A double just below a tie, which its scaled double lies on."""
    x = next(x for x in (k + 0.0000000005 - 2.0**-50 for k in range(1, 4000)) if math.floor(x * 1e9 + 0.5) / 1e9 != float(round(Decimal(x), 9)))
    found = spark.range(1).select(terrain_heat.scaled(F.lit(x)).alias("x")).first().x
    assert found == duckdb.sql(f"SELECT round({x!r}::DOUBLE, 9)").fetchall()[0][0]


def test_wind_comes_with_its_frame(spark, tmp_path):
    """Two films under one name: a join of frames with their wind by name and number would make four rows of two."""
    rows = [(60 * u + k, dt.datetime(2024, 1, 1, k), u, "error", 100.0 + k) for u in (1602, 1603, 3) for k in range(5)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = core.QUERIES["t3_sweep_vent"](spark, str(tmp_path)).groupBy("cell").count().collect()
    assert sum(r["count"] for r in found) == 30


def test_points_in_small_rings_equal_the_cover_form(spark):
    points = [(i, (i * 7919 % 3600) / 10 - 180, (i * 104729 % 1790) / 10 - 89.5) for i in range(4000)]
    df = spark.createDataFrame(points, "p int, lon double, lat double")
    small = [(f"s{k}", [(x, y), (x + 3, y + 1), (x + 2, y + 4), (x - 1, y + 2)]) for k, (x, y) in enumerate([(-179.0, -80.0), (178.5, 10.0), (0.0, 0.0), (10.05, 84.0)] * 3)]
    rings = ringed(spark, RINGS).select("id", "ring").unionByName(spark.createDataFrame(small, "id string, ring array<struct<x:double,y:double>>")).coalesce(1)
    got, expected = (sorted(map(tuple, f(df, rings, 4).select("p", "id").collect())) for f in (zones.points_in_small, zones.points_in))
    assert got == expected and len(got) > 100


def test_areas_of_one_file_are_dealt_out(spark):
    """Areas that begin at the level are not split, and were all one task's."""
    rings = [(k, [(k % 90, 1.0), (k % 90 + 0.5, 1.0), (k % 90 + 0.2, 1.5)]) for k in range(400)]
    df = spark.createDataFrame([(k, [(float(x), y) for x, y in r]) for k, r in rings], "id int, ring array<struct<x:double,y:double>>").coalesce(1)
    tasks = zones.cover(df, 6).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4


def test_zone_hours_by_block_keep_few_files(spark, tmp_path, monkeypatch):
    """A raster of 2,000 rows: blocks of a few pixels would be a thousand folders."""
    paths, write = [], tables.write_blocks
    monkeypatch.setattr(tables, "write_blocks", lambda df, path, *a, **k: (paths.append(path), write(df, path, *a, **k))[1])
    rows = [(k, dt.datetime(2024, 1, 1), 16 * k + k % 16, "error", 100.0) for k in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert core.QUERIES["s13_j2_zone_hours_by_block"](spark, str(tmp_path)).count() > 0
    assert len(glob.glob(f"{paths[0]}/block=*")) == 125


def test_correlation_with_a_side_of_one_value(spark, tmp_path):
    """Every pixel holds the same value, as in large tables: Spark's own correlation divides by zero."""
    for t in ("lineitem", "customer"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (df.withColumn("l_discount", F.lit(0.0)) if t == "lineitem" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    found = core.QUERIES["a37_join_quality"](spark, str(tmp_path)).first()
    assert math.isnan(found.c) and found.ratio == 0 and found.n > 0
    df = spark.createDataFrame([(0.1, 1.0, 2.0), (0.1, 2.0, 4.5), (0.1, 4.0, 8.0), (None, 9.0, None)], "a double, b double, c double")
    one, two, none = (fold.correlation(*p) for p in (("a", "b"), ("b", "c"), ("a", "a")))
    r = df.agg(one.alias("one"), two.alias("two"), F.round(F.corr("b", "c"), 12).alias("own")).first()
    assert math.isnan(r.one) and round(r.two, 12) == r.own
    assert df.where("a IS NULL").agg(none.alias("none")).first().none is None


def shared_names(spark, tmp_path, users):
    """Events of users whose films are of 5 to 7 frames."""
    rows = [(60 * u + 7 * k, dt.datetime(2024, 1, 1, k), u, "error" if (u + k) % 3 == 0 else "view", 40.0 + (u * 13 + k * k * 29) % 90) for u in users for k in range(5 + u % 3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")


def by_sql(tmp_path, name, columns, where="true"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE {where}")
    return Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({core.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["t1_hold_first", "t1_t2_sustained", "t3_sweep_vent", "w6_window_memory"])
def test_films_that_share_a_name_keep_their_own_loads(spark, tmp_path, name):
    """Each film's rows are those that the SQL gives for it alone, and the SQL has them among those of the whole table, where it goes
    on from each load of a name with each frame of it (2, 4, 8, ... rows of two films)."""
    users = (1602, 3, 5)  # the first two are 300 both
    shared_names(spark, tmp_path, users)
    got = core.QUERIES[name](spark, str(tmp_path))
    found = Counter(map(tuple, got.collect()))
    assert found == sum((by_sql(tmp_path, name, got.columns, f"user_id = {u}") for u in users), Counter())
    assert found <= by_sql(tmp_path, name, got.columns)


def test_greatest_loads_of_films_that_share_a_name_are_those_of_the_sql(spark, tmp_path):
    shared_names(spark, tmp_path, (1602, 3, 5, 3202, 4))
    got = core.QUERIES["t3_sweep"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == by_sql(tmp_path, "t3_sweep", got.columns)


@pytest.mark.parametrize("name", ["t1_hold_first", "t1_t2_sustained", "t3_sweep", "t3_sweep_vent", "w6_window_memory"])
def test_loads_with_nulls_are_those_of_the_sql(spark, tmp_path, name):
    """Frames without a time come last, a film without a name ends at its first frame, and a null wind leaves no heat."""
    rows = [(None if k % 5 == 3 else 60 * k + 7, None if k == 2 else dt.datetime(2024, 1, 1, k), u, "view", 40.0 + (k * k * 29) % 90) for u in (3, 20, None) for k in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = core.QUERIES[name](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == by_sql(tmp_path, name, got.columns)
