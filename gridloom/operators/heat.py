"""Heat in time: sustained load, frames, episodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def missing(hi: Column) -> Column:
    """An index that is not there, in every form of the recurrence: null or NaN."""
    return hi.isNull() | F.isnan(hi)


def excess(hi: Column, limit: Column) -> Column:
    """What an index adds: its degrees over the threshold, nothing where it is missing."""
    return F.when(missing(hi), 0.0).otherwise(F.greatest(F.lit(0.0), hi - limit))


Decay = tuple[Column, Column]  # what is kept of the load at each frame, and the share of a frame's own heat


def decay(half_life: float | Column) -> Decay:
    """From a half-life in frames. Of a plain number, the share is one less the decimals of what is kept, as SQL takes it."""
    if isinstance(half_life, Column):
        kept = F.pow(F.lit(2.0), -1.0 / half_life)
        return kept, 1 - kept
    kept = 2 ** (-1 / half_life)
    return F.lit(kept), F.lit(float(1 - Decimal(repr(kept))))


def step(kept: Column, new: Column, limit: Column, wash: Column, vent: Column, nan: str) -> Column:
    """A frame as one function of the load before it, load -> (a * load + b) * c."""
    rained = 1 - wash * F.least(F.lit(1.0), F.col("mm") / 2.5)
    own = new * excess(F.col("hi"), limit) * F.greatest(F.lit(0.0), 1 - vent * F.col("wind") / 10)
    if nan == "hold":
        held = missing(F.col("hi"))
        kept, own, rained = F.when(held, 1.0).otherwise(kept), F.when(held, 0.0).otherwise(own), F.when(held, 1.0).otherwise(rained)
    return F.struct(kept.alias("a"), own.alias("b"), rained.alias("c"))


def prepared(frames: DataFrame) -> DataFrame:
    """Frames with hi, mm and wind as doubles: no rain and no wind where there are none."""
    absent = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in frames.columns else F.lit(0.0)
    return frames.withColumns({"hi": F.col("hi").cast("double"), "mm": absent("mm"), "wind": absent("wind")})


def in_order(by: tuple[str, ...]) -> WindowSpec:
    """Prepared frames of a film; those of one number in an order that reruns repeat."""
    return Window.partitionBy(*by).orderBy("f", "hi", "mm", "wind")


def followed(frames: DataFrame, steps: list[Column], by: tuple[str, ...], include_first: bool, shared: bool = False) -> DataFrame:
    """(by, f, load0, load1, ...) of prepared frames: the load under each of `steps`, frame after frame in order, so that sums are
    made in the order of the recurrence. One shuffle; a task holds a batch of its sorted rows and two loads for each step.

    Frames of one number are steps one after another; where films are `shared`, each goes on from the greatest load of the number
    before, which is the greatest that any way through the films reaches, as no step makes more of less."""
    film = in_order(by)
    ready = frames.select(*by, "f", (F.row_number().over(film) == 1).alias("first_"), *[x.alias(f"step{i}_") for i, x in enumerate(steps)])
    flat = ready.select(*by, "f", "first_", *[F.col(f"step{i}_.{c}").alias(f"{c}{i}_") for i in range(len(steps)) for c in "abc"])
    kept, count = len(by) + 1, len(steps)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [(0.0, None, None)] * count
        for batch in batches:
            first = batch.column(kept).to_pylist()
            number = batch.column(kept - 1).to_pylist()
            loads = []
            for i in range(count):
                a, b, c = (batch.column(kept + 1 + 3 * i + k).to_numpy(zero_copy_only=False).tolist() for k in range(3))
                (load, before, at), out = last[i], []
                if shared:
                    most = load
                    for begun, f, x, y, z in zip(first, number, a, b, c, strict=True):
                        same = f == at and not begun
                        before, at = None if begun else before if same else most, f
                        own = (x * before + y) * z if before is not None else y * z if include_first else 0.0
                        most = max(most, own) if same else own
                        out.append(own)
                    load = most
                else:
                    for begun, x, y, z in zip(first, a, b, c, strict=True):
                        if begun:
                            load = y * z if include_first else 0.0
                        else:
                            load = (x * load + y) * z
                        out.append(load)
                last[i] = load, before, at
                loads.append(pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *loads], names=[*batch.schema.names[:kept], *[f"load{i}" for i in range(count)]])

    doubles = [StructField(f"load{i}", DoubleType()) for i in range(count)]
    return flat.mapInArrow(follow, StructType([*flat.schema.fields[:kept], *doubles]))


def sustained(frames: DataFrame, half_life: float | Column = 24.0, threshold: float | Column = 27.0, flush: float | Column = 0.0, include_first: bool = False, nan: str = "decay", by: tuple[str, ...] = ("cell",), vent: float = 0.0) -> DataFrame:
    """(by, f, load) of frames (by, f, hi, mm, and wind where there is a vent): L = a L' + (1 - a) x, cut by rain, where x is
    max(0, hi - threshold) less the share `vent` of it for each 10 of wind.

    A missing index (null or NaN) decays the load or holds it. A frame without a row is no step: the load goes on from the frame
    before, as if frames were numbered without gaps; give such frames a row with a missing index where they shall count. The
    first frame begins at 0 unless `include_first`.

    Frames are sorted by cell and number and gone through in that order, see `followed`: no array holds a film, and loads are
    those of the recurrence to the last bit."""
    wide = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    one = step(*decay(half_life), wide(threshold), wide(flush), wide(vent), nan)
    return followed(prepared(frames), [one], by, include_first).withColumnRenamed("load0", "load")


def sustained_window(frames: DataFrame, half_life: float, threshold: float, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """The same without rain, first frame included. A frame without a row is a step of decay here: a frame keeps a power of what is
    kept at one step, the number of frames since the one before it, which a window tells."""
    kept, new = decay(half_life)
    gap = F.col("f") - F.lag("f").over(in_order(by))
    one = step(F.pow(kept, F.coalesce(gap, F.lit(1)).cast("double")), new, F.lit(float(threshold)), F.lit(0.0), F.lit(0.0), "decay")
    return followed(prepared(frames.select(*by, "f", "hi")), [one], by, True).withColumnRenamed("load0", "load")


def swept(frames: DataFrame, params: list[tuple[float, ...]], by: tuple[str, ...] = ("cell",), include_first: bool = False, nan: str = "decay", shared: bool = False) -> DataFrame:
    """(setting, by, f, load): loads for each of a few settings (half-life, threshold, flush and, where given, vent).

    Films are shuffled, sorted and gone through once, with a load for each setting; `shared` as in `followed`."""
    full = [(*p, 0.0, 0.0)[:4] for p in params]
    steps = [step(*decay(half), *[F.lit(float(x)) for x in more], nan) for half, *more in full]
    loads = followed(prepared(frames), steps, by, include_first, shared)
    each = F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"load{i}").alias("load")) for i in range(len(full))])
    return loads.select(*by, "f", F.inline(each)).select("setting", *by, "f", "load")


def level_sets(bands: DataFrame, levels: Iterable[int], band: str = "band") -> DataFrame:
    """A row for each level that a cell's band reaches: (.., lvl) with lvl <= band; no join on an inequality."""
    at = F.filter(F.array(*[F.lit(x) for x in sorted(levels)]), lambda x: x <= F.col(band))
    return bands.withColumn("lvl", F.explode(at))


def frame_means(loads: DataFrame, value: str = "load") -> DataFrame:
    return loads.groupBy("f").agg(F.avg(value).alias(value))


def episodes(frames: DataFrame, hot: Column, gap: int = 1, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """(by, first, last, hours): runs of hot frames, merged over gaps of up to `gap` frames."""
    w = Window.partitionBy(*by).orderBy("f")
    kept = frames.where(hot).withColumn("new", F.coalesce(F.col("f") - F.lag("f").over(w) > gap + 1, F.lit(True)).cast("int"))
    return kept.withColumn("run", F.sum("new").over(w)).groupBy(*by, "run").agg(F.min("f").alias("first"), F.max("f").alias("last"), F.count(F.lit(1)).alias("hours")).drop("run")
