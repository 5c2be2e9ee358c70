"""Small helpers shared by the text operators.

One rule holds for clashing names in all of them: an operator's new columns have the names that it states, and a column of
the caller that has such a name already is handed on as `<name>_before` (as `<name>_before_before` if that is taken too).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tables import clear, discard, join_null_safe, shared_dir, written

__all__ = ["apart", "clear", "discard", "join_null_safe", "kept_schema", "shared_dir", "slices", "table", "with_columns", "words", "written"]

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text (runs without white space) as an array; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(plain, " "), "")


def apart(columns: list[str], made: Iterable[str]) -> dict[str, str]:
    """Column -> its name beside the columns that an operator makes, for all of `columns`."""
    taken = {c.lower() for c in [*columns, *made]}
    out = {}
    for c in columns:
        name = c
        if c.lower() in {m.lower() for m in made}:
            while name.lower() in taken:
                name += "_before"
            taken.add(name.lower())
        out[c] = name
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of an Arrow batch whose texts take about most_bytes, with the texts; bounds a worker's memory."""
    at, start, size = batch.schema.get_field_index(column), 0, 0
    lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (size + n > most_bytes or i - start >= most_rows):
            part = batch.slice(start, i - start)
            yield part, part.column(at).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        part = batch.slice(start)
        yield part, part.column(at).to_pylist()
    pa.default_memory_pool().release_unused()  # workers are used again: give back what the batch took


def with_columns(part: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    cols = {c: part.column(part.schema.get_field_index(c)) for c in keep} | more
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def kept_schema(df: DataFrame, keep: list[str], *more: tuple[str, str]) -> str:
    """A DDL schema of the kept columns and the new ones."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{c}` {t}" for c, t in more])
