"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null texts encode as empty; every text is encoded whole. Long texts are cut at places where the split pattern always
begins a new match, so that the cut changes no token. Rows are independent: repeated rows give equal results, an empty
table gives an empty table, and columns that are not named in `keep` play no part; a kept column with the name of a new one is handed on as
`<name>_before`.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from gridloom.llm.base import apart, kept_schema, slices, with_columns

#: A letter or digit run always ends its match where one of these follows; no match reaches across.
SAFE = re.compile(r"[A-Za-z0-9](?=[ \n\t])|[A-Za-z](?=[0-9!-/:-@])|[0-9](?=[A-Za-z!-/:-@])")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once in each worker."""
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int) -> Iterator[str]:
    """text in parts of at least `limit` characters, cut only at safe boundaries."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(text: str | None, enc: tiktoken.Encoding, limit: int = 1 << 15) -> list[int]:
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in enc.encode_ordinary(piece)]


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, limit: int = 1 << 15) -> DataFrame:
    """The columns `keep` (all by default) and `ids`: the token ids of `text`, array<int>."""
    names = apart(df.columns, [ids])
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    inner = df.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for part, texts in slices(batch, text):
                yield with_columns(part, keep, **{ids: pa.array([encode_text(t, enc, limit) for t in texts], pa.list_(pa.int32()))})

    return inner.mapInArrow(run, kept_schema(df, keep, (ids, "array<int>")))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and `out`: the raw bytes of `ids`, binary. A null list gives no bytes."""
    names = apart(df.columns, [out])
    df, keep, ids = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[ids]
    inner = df.select(*dict.fromkeys([*keep, ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield with_columns(part, keep, **{out: pa.array([enc.decode_bytes(x or []) for x in part.column(at).to_pylist()], pa.binary())})

    return inner.mapInArrow(run, kept_schema(df, keep, (out, "binary")))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, exact: str | None = "exact", keep: list[str] | None = None, limit: int = 1 << 15) -> DataFrame:
    """The columns `keep` (all by default), `ids`, `decoded` (their raw bytes) and `exact`, whether these are the text's: one
    pass, one worker a task. `decoded` and `exact` may be None, for no such column."""
    made = [c for c in (ids, decoded, exact) if c]
    names = apart(df.columns, made)
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    inner = df.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for part, texts in slices(batch, text):
                found = [encode_text(t, enc, limit) for t in texts]
                back = [enc.decode_bytes(i) for i in found]
                more = {ids: pa.array(found, pa.list_(pa.int32()))}
                if decoded:
                    more[decoded] = pa.array(back, pa.binary())
                if exact:
                    more[exact] = pa.array([b == (t or "").encode() for b, t in zip(back, texts, strict=True)])
                yield with_columns(part, keep, **more)

    types = {ids: "array<int>", decoded: "binary", exact: "boolean"}
    return inner.mapInArrow(run, kept_schema(df, keep, *[(c, types[c]) for c in made]))
