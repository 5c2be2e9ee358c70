"""Hourly partial folds of a stream, merged batch by batch into a table that any number of readers fold again.

Each micro-batch writes its own part (sums, counts, extremes of each hour and key) under its number, so that a batch that is
replayed after a failure replaces its part and changes nothing else. Parts are merged when they are read; `compact` folds the
parts so far into one base, whose number says up to which batch it holds: parts of those batches, replayed ones as well, are
passed over. So no row counts twice, whatever fails in between.

Rows behind the newest event of earlier batches by more than `late` are merged like all others and counted as late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

SCHEMA = "t timestamp, key bigint, s double, n bigint, mn double, mx double, late bigint, newest timestamp"


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> folder of the complete tables `path/<name>=<number>`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return {}
    found = [f.getPath() for f in store.listStatus(at)]
    done = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return {int(p.getName().split("=")[1]): p.toString() for p in found if "=" in p.getName() and done(p)}


def _live(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(the batch up to which the base holds, the folders to be read)."""
    bases, parts = _folders(spark, f"{path}/base"), _folders(spark, f"{path}/parts")
    upto = max(bases, default=-1)
    return upto, [bases[k] for k in bases if k == upto] + [f for k, f in sorted(parts.items()) if k > upto]


def partials(spark: SparkSession, path: str) -> DataFrame:
    """All partial folds that count: the base and the parts after it."""
    _, live = _live(spark, path)
    return spark.read.schema(SCHEMA).parquet(*live) if live else spark.createDataFrame([], SCHEMA)


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("t", "key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("late").alias("late"), F.max("newest").alias("newest"))


def merge_batch(batch: DataFrame, batch_id: int, path: str, key: Column, value: str, time: str = "ts", late: str = "2 hours") -> None:
    """Writes the part of one micro-batch; a batch that a base holds already is passed over."""
    spark = batch.sparkSession
    upto, _ = _live(spark, path)
    if batch_id <= upto:
        return
    earlier = [f for k, f in _folders(spark, f"{path}/parts").items() if upto < k < batch_id] + [f for k, f in _folders(spark, f"{path}/base").items() if k == upto]
    mark = spark.read.schema(SCHEMA).parquet(*earlier).agg(F.max("newest")).first()[0] if earlier else None
    behind = F.count_if(F.col(time) < F.lit(mark) - F.expr(f"INTERVAL {late}")) if mark else F.lit(0).cast("long")
    v = F.col(value).cast("double")
    part = batch.groupBy(F.date_trunc("hour", time).alias("t"), key.cast("long").alias("key")).agg(
        F.sum(v).alias("s"), F.count(v).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx"), behind.alias("late"), F.max(time).alias("newest")
    )
    part.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")


def compact(spark: SparkSession, path: str) -> None:
    """Folds the base and the parts so far into a new base, then deletes what it holds."""
    parts, upto = _folders(spark, f"{path}/parts"), _live(spark, path)[0]
    last = max(parts, default=-1)
    if last <= upto:
        return
    _merged(partials(spark, path)).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    old = [f for k, f in parts.items() if k <= last] + [f for k, f in _folders(spark, f"{path}/base").items() if k < last]
    for folder in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merged_hours(spark: SparkSession, path: str) -> DataFrame:
    """(t, key, value, n, mn, mx, late): the fold of all batches so far."""
    return _merged(partials(spark, path)).select("t", "key", (F.col("s") / F.nullif("n", F.lit(0))).alias("value"), "n", "mn", "mx", "late")


def merged_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, key, mean, most) from the same partial sums."""
    days = partials(spark, path).groupBy(F.date_trunc("day", "t").alias("day"), "key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("mx").alias("most"))
    return days.select("day", "key", (F.col("s") / F.nullif("n", F.lit(0))).alias("mean"), "most")


def partial_sink(events: DataFrame, path: str, key: Column, value: str, checkpoint: str, time: str = "ts", late: str = "2 hours", compact_every: int = 100) -> DataStreamWriter:
    """A writer of a stream's partial folds, to be started by the caller: one part for each micro-batch, a new base now and then."""

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, key, value, time, late)
        if batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, path)

    writer: Callable[[DataFrame, int], None] = each
    return events.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).outputMode("update")
