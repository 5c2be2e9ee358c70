"""Streams give the rows of their batch forms once the watermark has passed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import heat
from gridloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def events(spark, path):
    rows = [(T0 + dt.timedelta(minutes=37 * i), i % 3, float(i % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp, k int, value double")
    end = spark.createDataFrame([(T0 + dt.timedelta(days=30), 0, 5.0)], "ts timestamp, k int, value double")
    df.coalesce(1).write.parquet(f"{path}/a")
    end.coalesce(1).write.mode("append").parquet(f"{path}/a")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/a")


@pytest.mark.parametrize("kind", ["hour", "day", "session"])
def test_stream_equals_batch(spark, tmp_path, kind):
    batch, stream = events(spark, tmp_path)
    forms = {
        "hour": lambda d: streams.hourly_fold(d, F.col("k"), "value"),
        "day": lambda d: streams.daily_rollup(d, F.col("k"), "value"),
        "session": lambda d: streams.hot_sessions(d, F.col("k"), F.col("value") >= 3, "3 hours"),
    }
    name = f"out_{kind}"
    q = forms[kind](stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table(name).where("true").collect()))
    expected = sorted(map(tuple, forms[kind](batch).collect()))
    assert [r for r in got if r in expected] == expected and len(got) == len(expected)


def test_sustained_stream(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(hours=h), 20.0 + h % 5, 0.5 * (h % 2)) for h in range(30)]
    df = spark.createDataFrame(rows, "key long, t timestamp, hi double, mm double")
    end = spark.createDataFrame([(2, T0 + dt.timedelta(days=9), 0.0, 0.0)], df.schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/a")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/a")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = streams.sustained_stream(stream, 6, 20, 0.3).writeStream.format("memory").queryName("loads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.load for r in spark.table("loads").where("key = 1").orderBy("t").collect()]
    frames = df.select(F.col("key").alias("cell"), ((F.unix_timestamp("t") - int(T0.replace(tzinfo=dt.UTC).timestamp())) / 3600).cast("int").alias("f"), "hi", "mm")
    assert got == pytest.approx([r.load for r in heat.sustained(frames, 6, 20, 0.3).orderBy("f").collect()])


def test_sustained_stream_and_hours_after_the_watermark(spark, tmp_path):
    """Hours that come when the watermark has passed them change no load: Spark drops them before the processor."""
    hour = lambda h, hi: (1, T0 + dt.timedelta(hours=h), hi, 0.0)
    files = [[hour(h, 25.0) for h in range(6)], [hour(30, 22.0)], [hour(3, 99.0), hour(31, 22.0)], [hour(200, 0.0)], [hour(300, 0.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "key long, t timestamp, hi double, mm double").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    schema = "key long, t timestamp, hi double, mm double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "live").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/live")
    q = streams.sustained_stream(stream, 6, 20).writeStream.format("memory").queryName("late_loads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for i in range(len(files)):
        for f in (tmp_path / "in" / f"b={i}").glob("*.parquet"):
            f.rename(tmp_path / "live" / f"{i}-{f.name}")
        q.processAllAvailable()
    q.stop()
    got = spark.table("late_loads").orderBy("t").collect()
    loads = [r for r in got if not r.late]
    assert [r.t for r in loads][:8] == [T0 + dt.timedelta(hours=h) for h in (*range(6), 30, 31)]
    a, load, expected = 2 ** (-1 / 6), 0.0, []
    for i, hi in enumerate([25.0] * 6 + [22.0, 22.0]):
        load = 0.0 if i == 0 else a * load + (1 - a) * max(0.0, hi - 20)
        expected.append(load)
    assert [r.load for r in loads][:8] == pytest.approx(expected)
    assert not any(r.late for r in got)


def test_sliding_film_stream(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    q = streams.sliding_film(stream, F.col("k"), "value", 3).writeStream.format("memory").queryName("films").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    expected = sorted(map(tuple, streams.sliding_film(batch, F.col("k"), "value", 3).collect()))
    assert [r for r in sorted(map(tuple, spark.table("films").collect())) if r in expected] == expected


def test_partial_folds_of_batches_are_idempotent(spark, tmp_path):
    """A stream in small batches, stopped and gone on with; a replayed batch changes nothing, before a new base and after it."""
    import datetime as dt

    from gridloom.streaming import partials

    day = dt.datetime(2024, 1, 1)
    for k in range(6):
        rows = [(k * 50 + i, i % 3, day + dt.timedelta(minutes=37 * (k * 50 + i) if i % 10 else 0), float(i * k) if i % 7 else None) for i in range(50)]
        spark.createDataFrame(rows, "id long, key long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = "id long, key long, ts timestamp, value double"
    path, check = f"{tmp_path}/out", f"{tmp_path}/check"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        partials.partial_sink(events, path, F.col("key"), "value", check, compact_every=2).trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    fold = lambda: sorted((r.t, r.key, r.n, r.value and round(r.value, 9), r.mx) for r in partials.merged_hours(spark, path).collect())
    expected = sorted((r.t, r.key, r.n, r.value and round(r.value, 9), r.mx) for r in whole.groupBy(F.date_trunc("hour", "ts").alias("t"), "key").agg(F.avg("value").alias("value"), F.count("value").alias("n"), F.max("value").alias("mx")).collect())
    assert len(partials._folders(spark, f"{path}/base")) == 1 and fold() == expected
    late = partials.merged_hours(spark, path).agg(F.sum("late")).first()[0]
    assert late == 20  # the first rows of the second and third batch's files, of two files each, are of the first hour
    partials.merge_batch(whole.where("id < 100"), 0, path, F.col("key"), "value")
    assert fold() == expected
    partials.merge_batch(whole.where("id < 10"), 7, path, F.col("key"), "value")
    once = fold()
    partials.merge_batch(whole.where("id < 10"), 7, path, F.col("key"), "value")
    assert fold() == once != expected
    days = partials.merged_days(spark, path).collect()
    assert sum(1 for r in days) == len({(r.day, r.key) for r in days})
