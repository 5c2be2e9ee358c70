"""Class rasters: areas, rankings, rotations, composition, fields and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import acres, disagreement, leaf_season
from gridloom.operators.fold import quantiles_by
from gridloom.operators.zones import rank_in


def class_ranking(px: DataFrame, cls: str = "cls") -> DataFrame:
    return px.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def top_classes(px: DataFrame, n: int, cls: str = "cls") -> DataFrame:
    """(cls, n) of the n most frequent classes, the smaller code first on ties."""
    return class_ranking(px, cls).orderBy(F.col("n").desc(), cls).limit(n)


def area_by_year(px: DataFrame, n: int, pixel_km2: float) -> DataFrame:
    """(year, cls, n, acres) of the n most frequent classes. Their codes are n rows."""
    kept = px.join(F.broadcast(top_classes(px, n).select("cls")), "cls", "left_semi")
    return kept.groupBy("year", "cls").agg(F.count(F.lit(1)).alias("n")).withColumn("acres", acres(F.col("n"), pixel_km2))


def rotation(px: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """(cls_from, cls_to, n) of the pixels that two years both have."""
    side = lambda y, name: px.where(F.col("year") == y).select("y", "x", F.col("cls").alias(name))
    return side(year_a, "cls_from").join(side(year_b, "cls_to"), ["y", "x"]).groupBy("cls_from", "cls_to").agg(F.count(F.lit(1)).alias("n"))


def rotation_matrix(pairs: DataFrame, codes: list[int]) -> DataFrame:
    return pairs.groupBy("cls_from").pivot("cls_to", codes).agg(F.sum("n")).withColumnsRenamed({str(c): f"to_{c}" for c in codes})


def composition(px: DataFrame, by: str = "year", cls: str = "cls") -> DataFrame:
    """(by, cls, n, pct) within each year."""
    counts = px.groupBy(by, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def change_of_patches(areas: DataFrame, patches: DataFrame, least_pct: float = 0.5, cls: str = "cls") -> DataFrame:
    """(cls, pct_0, pct_1, pct_change, patches_0, patches_1, patches_change) between the first year and the last, of areas
    (year, cls, n) and patches (year, cls, patches); classes under `least_pct` of both years' areas are left out."""
    every = Window.partitionBy()  # a row for each class and year
    share = areas.select("year", cls, (100 * F.col("n") / F.sum("n").over(Window.partitionBy("year"))).alias("pct"))
    both = share.join(patches.select("year", cls, "patches"), ["year", cls], "left")
    dated = both.withColumns({"y0": F.min("year").over(every), "y1": F.max("year").over(every)})
    end = lambda c, y, none: F.coalesce(F.max(F.when(F.col("year") == F.col(y), F.col(c))), F.lit(none))
    ends = dated.groupBy(cls).agg(end("pct", "y0", 0.0).alias("pct_0"), end("pct", "y1", 0.0).alias("pct_1"), end("patches", "y0", 0).alias("patches_0"), end("patches", "y1", 0).alias("patches_1"))
    kept = ends.where(F.greatest("pct_0", "pct_1") >= least_pct)
    return kept.withColumns({"pct_change": F.col("pct_1") - F.col("pct_0"), "patches_change": F.col("patches_1") - F.col("patches_0")})


def campaign_scores(items: DataFrame, lookup: DataFrame, aoi: DataFrame, lat: float) -> DataFrame:
    """(campaign, footprints, days, cov, one_date, leaf_off) of items (footprint, campaign, date): the newest item of each
    footprint counts, a campaign's coverage is the share of the area's cells (cell) that its footprints (footprint, cell) have,
    and it is leaf-off where no date is in the season of leaves at that latitude."""
    newest = items.groupBy("footprint", "campaign").agg(F.max("date").alias("date"))
    first, last = leaf_season(F.lit(lat))
    off = ~F.dayofyear("date").between(first, last)
    scores = newest.groupBy("campaign").agg(F.count(F.lit(1)).alias("footprints"), F.count_distinct(F.to_date("date")).alias("days"), F.min(off).alias("leaf_off"))
    hit = newest.select("footprint", "campaign").join(lookup, "footprint").join(aoi.select("cell"), "cell").groupBy("campaign").agg(F.count_distinct("cell").alias("hit"))
    total = aoi.select("cell").distinct().agg(F.count(F.lit(1)).alias("total"))
    whole = scores.join(hit, "campaign", "left").join(F.broadcast(total))  # one row
    cov = F.coalesce("hit", F.lit(0)) / F.col("total")
    return whole.select("campaign", "footprints", "days", cov.alias("cov"), (F.col("days") == 1).alias("one_date"), "leaf_off")


def best_campaign(scored: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """scored with `best`: coverage first, the seam second. Of the campaigns within `tolerance` of the best coverage those of a
    single day, if any, and of these the one with the most coverage, the newest on ties. A row for each campaign: few."""
    every = Window.partitionBy()
    near = F.col("cov") >= F.max("cov").over(every) - tolerance
    order = Window.orderBy(near.desc(), (near & F.col("one_date")).desc(), F.col("cov").desc(), F.col("campaign").desc())
    return scored.withColumn("best", F.row_number().over(order) == 1)


def change(px: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, first_n, last_n, change) between the first year and the last."""
    every = Window.partitionBy()  # a row for each class and year
    counts = px.groupBy(cls, "year").agg(F.count(F.lit(1)).alias("n")).withColumns({"y0": F.min("year").over(every), "y1": F.max("year").over(every)})
    end = lambda y: F.coalesce(F.sum(F.when(F.col("year") == F.col(y), F.col("n"))), F.lit(0))
    counted = counts.groupBy(cls).agg(end("y0").alias("first_n"), end("y1").alias("last_n"))
    return counted.withColumn("change", F.col("last_n") - F.col("first_n"))


def field_majority(hits: DataFrame, key: str = "id", cls: str = "cls") -> DataFrame:
    """(id, cls, n, total, purity, rn): classes of each field in order of pixels, the smaller code first on ties."""
    counts = hits.groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return rank_in(counts.withColumn("total", total).withColumn("purity", F.col("n") / F.col("total")), [key], F.col("n").desc(), F.col(cls))


def crop_summary(majority: DataFrame, areas: DataFrame, key: str = "id", cls: str = "cls") -> DataFrame:
    """(cls, fields, area, median_area, mean_purity) of the fields by their majority class."""
    led = majority.where("rn = 1").join(areas, key)
    summed = led.groupBy(cls).agg(F.count(F.lit(1)).alias("fields"), F.sum("area").alias("area"), F.avg("purity").alias("mean_purity"))
    return summed.join(quantiles_by(led, [cls], "area", {"median_area": 0.5}), cls)


def mixed_fields(majority: DataFrame, n: int, key: str = "id", cls: str = "cls") -> DataFrame:
    """(id, first, second, purity, second_share) of the least pure fields: both ranks in one pass."""
    two = majority.where("rn <= 2").groupBy(key).agg(*[F.max(F.when(F.col("rn") == k, F.col(c))).alias(name) for k, c, name in ((1, cls, "first"), (2, cls, "second"), (1, "purity", "purity"), (2, "purity", "second_share"))])
    return two.where("second is not null").orderBy("purity", key).limit(n)


def agreement(crops: DataFrame, field_cells: DataFrame, keys: list[str]) -> DataFrame:
    """(cls, is_crop, is_field, px) of two rasters joined on a grid index; places without a field are not one."""
    joined = crops.join(field_cells.select(*keys, F.lit(True).alias("field")).distinct(), keys, "left")
    return joined.groupBy("cls", "is_crop", F.coalesce("field", F.lit(False)).alias("is_field")).agg(F.count(F.lit(1)).alias("px"))


def agreement_table(counts: DataFrame) -> DataFrame:
    """The two by two table with each cell's share of all pixels and its disagreement class."""
    cells = counts.groupBy("is_crop", "is_field").agg(F.sum("px").alias("px"))
    share = 100 * F.col("px") / F.sum("px").over(Window.partitionBy())  # at most four rows
    return cells.select("is_crop", "is_field", "px", share.alias("pct"), disagreement(F.col("is_crop"), F.col("is_field")).alias("kind"))


def misses(counts: DataFrame, least: int, n: int, where: Column) -> DataFrame:
    """(cls, px, pct): classes by the share of their pixels for which `where` holds."""
    hit = F.sum(F.when(where, F.col("px")).otherwise(0))
    return counts.groupBy("cls").agg(F.sum("px").alias("px"), (100 * hit / F.sum("px")).alias("pct")).where(F.col("px") >= least).orderBy(F.col("pct").desc(), "cls").limit(n)


def legend(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Class names and rounded percentages of all pixels, for a legend; a class table is small by nature and joined as Spark sees fit."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.join(classes, counts["cls"] == classes["code"]).select("cls", "name", "n", F.round(100 * F.col("n") / total, 1).alias("pct"))
