"""Gridded tables and vector layers as parquet: windows, levels, pruning by extent, sinks."""

from __future__ import annotations

import datetime as dt
import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions import proj, scalars


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is set: a new local one in local mode, as in tests; on a
    cluster ValueError, as executors don't share their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application has written."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors.

    The table stays until `discard` or `clear`, as results may still be read from it."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that still read from them are lost."""
    _delete(spark, session_dir(spark))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the keys are equal or both null."""
    right = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"right_{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"right_{k}" for k in keys])


def grid_table(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """An unravelled cube: dimensions and variables as columns, `level` as a partition column if there are several."""
    df = spark.read.parquet(path)
    return df if level is None else df.where(F.col("level") == level)


def time_window(first: str, last: str, start: str, stop: str, most_days: int) -> tuple[dt.datetime, dt.datetime]:
    """Whole UTC days from first to last (swapped if reversed), clamped to what the store holds; ValueError if too many."""
    a, b = sorted((dt.date.fromisoformat(first), dt.date.fromisoformat(last)))
    a, b = max(a, dt.date.fromisoformat(start)), min(b, dt.date.fromisoformat(stop))
    if a > b:
        raise ValueError("no day of the store is in the window")
    if (b - a).days + 1 > most_days:
        raise ValueError(f"more than {most_days} days")
    return dt.datetime.combine(a, dt.time.min), dt.datetime.combine(b, dt.time(23, 59, 59))


def in_time(df: DataFrame, first: dt.datetime, last: dt.datetime, time: str = "t") -> DataFrame:
    return df.where(F.col(time).between(F.lit(first), F.lit(last)))


def in_box(df: DataFrame, w: float, s: float, e: float, n: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows of a box, bounds included: comparisons that reach the scan."""
    return df.where(F.col(x).between(w, e) & F.col(y).between(s, n))


def level_for(cell_level: int, table: dict[int, int]) -> int:
    """The pyramid level for a cell level: that of the nearest level in the table that is not finer."""
    fits = [k for k in table if k <= cell_level]
    return table[max(fits)] if fits else table[min(table)]


def level_in_view(w: float, e: float, width: int, most: int, table: dict[int, int] | None = None) -> int:
    """The cell level for a box shown so many pixels wide: about eight pixels to a cell, `most` at most; with a table the
    pyramid level for it."""
    span = max(e - w, 1e-9)
    level = max(0, min(most, math.floor(math.log2(360 / span * width / 8)) - 1))
    return level if table is None else level_for(level, table)


def level_in_budget(df: DataFrame, budget: int, level: str = "level") -> int | None:
    """The finest level (the smallest number) with at most `budget` rows; the coarsest if none fits."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min(F.when(F.col("n") <= budget, F.col(level))).alias("fits"), F.max(level).alias("coarsest")).first()
    return row["fits"] if row["fits"] is not None else row["coarsest"]


def level_for_box(pyramid: DataFrame, levels: list[int], box: tuple[float, float, float, float], pixel: float, budget: int, x: str = "x", y: str = "y", level: str = "level", far: int = 24) -> int:
    """The finest of `levels` whose rows in the box fit a budget, counting only where that is needed: the cells that the box can
    hold (its area over that of a pixel times the level) are an upper bound, which settles a level that is under the budget and
    one that is `far` times over it."""
    w, s, e, n = box
    bound = {k: (e - w) * (n - s) / (pixel * k) ** 2 for k in levels}
    open_ = [k for k in sorted(levels)[:-1] if budget < bound[k] <= far * budget]
    counted = {}
    if open_:
        rows = in_box(pyramid.where(F.col(level).isin(open_)), w, s, e, n, x, y).groupBy(level).agg(F.count(F.lit(1)).alias("n"))
        counted = {r[0]: r[1] for r in rows.collect()}  # a row for each level
    for k in sorted(levels)[:-1]:
        if bound[k] <= budget or k in open_ and counted.get(k, 0) <= budget:
            return k
    return max(levels)


def strictly_inside(w: float, s: float, e: float, n: float, box: str = "bbox") -> Column:
    """A feature's box inside the query's: comparisons on struct fields, which prune row groups."""
    b = F.col(box)
    return (b["xmin"] > w) & (b["xmax"] < e) & (b["ymin"] > s) & (b["ymax"] < n)


def extent_index_by_scan(df: DataFrame, x: str, y: str, file: str = "file") -> DataFrame:
    """(file, xmin, ymin, xmax, ymax) of a table with a column for its file: for stores without footers."""
    return df.groupBy(file).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The data files of a table's folder: what any scan of it is told as well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    return sorted(f for f in files if not f.rsplit("/", 1)[-1].startswith(("_", ".")))


GROUPS = "file string, row_group int, rows bigint, xmin double, ymin double, xmax double, ymax double"


def group_index(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """The extents of the row groups of a Parquet table (`GROUPS`), from the footers alone: tasks open a share of the files each and
    read no page. To be stored once for each release. A group without statistics, or a file whose store only Spark can open, has
    no extent: it is always read."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f in batch.column(0).to_pylist() for r in _extents(f, x, y)]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in GROUPS.split(", ")])

    files = listed(spark, path)
    table = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "file")
    return written(table.mapInArrow(footers, GROUPS))


def _extents(file: str, x: str, y: str) -> list[tuple]:
    """(file, group, rows, xmin, ymin, xmax, ymax) of each row group, from the footer."""
    try:
        store, at = pyarrow.fs.FileSystem.from_uri(unquote(file))
        with store.open_input_file(at) as f:
            meta = pyarrow.parquet.read_metadata(f)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return [(file, None, None, None, None, None, None)]
    out = []
    for k in range(meta.num_row_groups):
        group = meta.row_group(k)
        seen = {c.path_in_schema: c.statistics for c in (group.column(i) for i in range(group.num_columns))}
        ends = [seen.get(c) for c in (x, y)]
        if all(s is not None and s.has_min_max for s in ends):
            low, high = [float(s.min) for s in ends], [float(s.max) for s in ends]
            out.append((file, k, group.num_rows, *low, *high))
        else:
            out.append((file, k, group.num_rows, None, None, None, None))
    return out


def file_index(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """(file, xmin, ymin, xmax, ymax): what the row groups of each file cover, see `group_index`. A file with a group of unknown
    extent has none, and is always read by `read_over`."""
    known = F.count("xmin") == F.count(F.lit(1))
    ends = [F.when(known, f(c)).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    return group_index(spark, path, x, y).groupBy("file").agg(*ends)


def read_over(spark: SparkSession, index: DataFrame, box: tuple[float, float, float, float], x: str, y: str, schema: StructType) -> DataFrame:
    """The rows of a box, read from those files alone that an index has over it. Their paths are what a scan is told anyway."""
    paths = [r.file for r in files_over(index, *box).select("file").collect()]
    whole = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return in_box(whole, *box, x, y)


def files_over(index: DataFrame, w: float, s: float, e: float, n: float, pad: float = 0.0) -> DataFrame:
    """Files whose extent meets a (padded) box; a file without an extent is always read."""
    unknown = F.col("xmin").isNull()
    return index.where(unknown | ((F.col("xmin") <= e + pad) & (F.col("xmax") >= w - pad) & (F.col("ymin") <= n + pad) & (F.col("ymax") >= s - pad)))


def tile_corners(tiles: DataFrame) -> DataFrame:
    """An index of tiles in projected metres (tile, link, date, z_max, aw, as, ae, an) with the places of its four corners: a square
    in metres is a turned quad in degrees, so an envelope would not do. The envelope in metres stays for choosing tiles."""
    out = tiles
    for name, px, py in (("sw", "aw", "as"), ("se", "ae", "as"), ("ne", "ae", "an"), ("nw", "aw", "an")):
        lon, lat = proj.albers_inverse(F.col(px), F.col(py))
        out = out.withColumns({f"{name}_lon": lon, f"{name}_lat": lat})
    return out


def latest_forecast(df: DataFrame, init: str = "init_time", lead: str = "lead_hours") -> DataFrame:
    """The rows of the latest run with the time that each is valid for."""
    last = df.agg(F.max(init)).first()[0]
    return df.where(F.col(init) == F.lit(last)).withColumn("t", F.col(init) + F.make_interval(hours=F.col(lead)))


def strided(df: DataFrame, step: int, row0: int = 0, col0: int = 0, row: str = "y", col: str = "x") -> DataFrame:
    """Every step-th row and column: what the operator is for."""
    return df.where((F.pmod(F.col(row) - row0, F.lit(step)) == 0) & (F.pmod(F.col(col) - col0, F.lit(step)) == 0))


def short_region(region: Column) -> Column:
    """The last part of a region's code: `US-CA` is `CA`."""
    return F.substring_index(region, "-", -1)


def in_blocks(df: DataFrame, mask: DataFrame, size: int, row: str = "y", col: str = "x") -> DataFrame:
    """Rows of the blocks that a mask (y, x) touches, of any table: a semi-join on block ids. `read_blocks` is the form for a store
    that is partitioned by block, of which it reads no other files."""
    block = [F.floor(F.col(c) / size).alias(f"b{c}") for c in (row, col)]
    return df.select("*", *block).join(mask.select(*block).distinct(), [f"b{row}", f"b{col}"], "left_semi").drop(f"b{row}", f"b{col}")


#: Blocks that may be sent to every task.
SENT = 100_000


def blocks_of(df: DataFrame, size: int, row: str = "y", col: str = "x") -> DataFrame:
    """df with the number of its block of size by size pixels: one column, as Spark prunes partitions by each column alone."""
    by, bx = (F.floor(F.col(c) / size) for c in (row, col))
    return df.withColumn("block", by * F.lit(1 << 31) + bx)


def write_blocks(df: DataFrame, path: str, size: int, order: Iterable[str] = (), row: str = "y", col: str = "x") -> None:
    """A cube as a store with a partition for each block. Rows are dealt by ranges of (block, order), so that a block with a long
    history is several files, each of a range of `order` (the time, say), and not one task's work."""
    keys = ["block", *order]
    blocks_of(df, size, row, col).repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("block").parquet(path)


def read_blocks(spark: SparkSession, path: str, mask: DataFrame, size: int, row: str = "y", col: str = "x") -> DataFrame:
    """The rows of a store's blocks that a mask (y, x) touches. The blocks are known when the query runs: the join on the partition
    column prunes the files before they are opened. A mask of more blocks than may be sent is joined like any table."""
    # the comparison holds for every block: Spark prunes by a side only if something selects its rows
    touched = written(blocks_of(mask.select(row, col), size, row, col).select("block").distinct()).where(F.col("block") > -(1 << 62))
    few = touched.count() <= SENT
    return spark.read.parquet(path).join(F.broadcast(touched) if few else touched, "block", "left_semi")


def write_clustered(df: DataFrame, path: str, x: str, y: str, box: tuple[float, float, float, float], zoom: int = 12, group_bytes: int | None = None) -> None:
    """A Parquet table whose rows lie along the Hilbert curve of their places (x, y) in a box (w, s, e, n): files and row groups
    cover small compact areas, so that the statistics of few of them meet a box that is asked for. Rows without a place come
    first; places outside the box go to its edge."""
    w, s, e, n = box
    step = lambda c, low, high: F.least(F.lit((1 << zoom) - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / (high - low) * (1 << zoom))))
    placed = df.withColumn("hilbert_", scalars.hilbert(step(x, w, e), step(y, s, n), zoom))
    out = placed.repartitionByRange("hilbert_").sortWithinPartitions("hilbert_").drop("hilbert_").write
    (out.option("parquet.block.size", group_bytes) if group_bytes else out).parquet(path)


def labelled_grid(df: DataFrame, row: str, col: str, value: str, cols: list) -> DataFrame:
    """A small grid from a long table: a row for each `row`, a column for each of `cols`."""
    return df.groupBy(row).pivot(col, cols).agg(F.first(value)).orderBy(row)
