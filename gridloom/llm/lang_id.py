"""Language identification by nearest centroid.

A text is its character n-grams (1 to 3 letters, case folded, anything else is one space), hashed to a fixed number of
places; their counts are damped, weighted by inverse document frequency and scaled to length 1. Each language has a few
centroids, found by spherical k-means; a text takes the language of the centroid with the largest cosine. A text whose
cosine is below what that centroid's own members have is rejected (`rejected`; as language `und` if so asked).

The model is fitted on at most `fit_docs` documents of each language, picked by a hash of id and text (rows alike in both count
once, so rows without ids are picked like others), and is a few vectors for each language: small enough to send to every task. Prediction reads the text alone, whole.

Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned (no rows
with text and language). Languages with fewer documents than centroids get fewer. Rows are independent; ties go to the
language first by name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import apart, kept_schema, slices, with_columns, written

UNKNOWN = "und"
PLACES = 1 << 13
#: Texts whose counts a worker holds at once.
BATCH = 512


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> a number for its folded letter, 0 for anything else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c)).startswith("L"):
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def counts(text: str | None, places: int = PLACES) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None without a letter."""
    if not text:
        return None
    code = letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = code == 0
    if blank.all():
        return None
    code = code[~blank | np.append(True, ~blank[:-1])]  # runs of other characters become one
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + code[2:]
    shift = np.uint32(32 - places.bit_length() + 1)
    out = np.zeros(places, np.int32)
    for gram, salt in ((code, 0x27D4EB2F), (two, 0x165667B1), (three, 0xC2B2AE3D)):
        out += np.bincount(((gram ^ (gram >> np.uint32(15))) * np.uint32(salt)) >> shift, minlength=places).astype(np.int32)
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, places)
    owner: np.ndarray  # the language of each centroid
    floor: np.ndarray  # cosines below this are rejected


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 from rows of counts."""
    v = np.log1p(rows.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1 and each row's cosine with its own. Starts from rows far from each other."""
    start, best = [0], v @ v[0]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[start[-1]])
    centres = v[start]
    for _ in range(rounds):
        near = np.argmax(v @ centres.T, axis=1)
        sums = np.stack([v[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = v @ centres.T
    return centres, np.stack([np.argmax(cosine, axis=1), cosine.max(axis=1)])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = 1000, per_lang: int = 4, places: int = PLACES, spread: float = 4.0) -> Model:
    """The model of the rows with text and language: `fit_docs` of each language at most."""
    # rows that are alike in id and text count once: a row's place in the sample is a hash of both
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("place"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct("place", 0.02)).collect()}
    if not sizes:
        return Model([], np.ones(places, np.float32), np.zeros((0, places), np.float32), np.zeros(0, np.int64), np.zeros(0))
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.1 * fit_docs / max(1, n)))]), F.col("lang"))
    likely = usable.where((F.shiftrightunsigned("place", 11) * 2.0**-53) < part).dropDuplicates(["lang", "place"])
    # a little more than fit_docs of each language are left: the rank makes the bound hard
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("place", 11), "place"))
    picked = likely.withColumn("rank", rank).where(F.col("rank") <= fit_docs).select("id", "lang", "place", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in slices(batch, "text", 1 << 20, BATCH):
                found = [counts(t, places) for t in texts]
                held = [np.flatnonzero(c) if c is not None else np.empty(0, np.int64) for c in found]
                values = [c[at] if c is not None else at for c, at in zip(found, held, strict=True)]
                yield with_columns(group, ["id", "lang", "place"], at=pa.array(held, pa.list_(pa.int32())), n=pa.array(values, pa.list_(pa.int32())))

    sample = written(picked.mapInArrow(features, "id string, lang string, place bigint, at array<int>, n array<int>").where(F.size("at") > 0))
    total = sample.count()
    seen = np.zeros(places, np.int64)
    for place, n in sample.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        seen[place] = n
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def centres(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("place", "ascending")])
        dense = np.zeros((group.num_rows, places), np.float32)
        for i, (at, n) in enumerate(zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True)):
            dense[i, at] = n
        middle, own = clustered(vectors(dense, idf), per_lang)
        floor = [float(x.mean() - spread * x.std()) if len(x := own[1][own[0] == c]) else 0.0 for c in range(len(middle))]
        return pa.table({"lang": [key[0].as_py()] * len(middle), "floor": floor, "centre": pa.array(list(middle), pa.list_(pa.float32()))})

    rows = sample.groupBy("lang").applyInArrow(centres, "lang string, floor double, centre array<float>").collect()
    rows.sort(key=lambda r: r["lang"])
    langs = sorted({r["lang"] for r in rows})
    return Model(langs, idf, np.array([r["centre"] for r in rows], np.float32), np.array([langs.index(r["lang"]) for r in rows]), np.array([r["floor"] for r in rows]))


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, reject: bool = True) -> DataFrame:
    """The columns `keep` (all by default), lang_pred, score (the best cosine), margin (to the best other language) and rejected.

    With `reject`, rejected texts get the language `und`. Own columns of these names are handed on as `<name>_before`.
    """
    made = ("lang_pred", "score", "margin", "rejected")
    names = apart(df.columns, made)
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few vectors for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        ends = np.flatnonzero(np.append(True, m.owner[1:] != m.owner[:-1])) if len(m.owner) else []
        for batch in batches:
            for part, texts in slices(batch, text, 1 << 20, BATCH):
                found = [counts(t, len(m.idf)) for t in texts]
                some = [i for i, c in enumerate(found) if c is not None]
                lang, score, margin, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if some and len(m.langs):
                    cosine = np.clip(vectors(np.stack([found[i] for i in some]), m.idf) @ m.centroids.T, 0, 1)
                    by_lang = np.maximum.reduceat(cosine, ends, axis=1)
                    at = np.argmax(by_lang, axis=1)
                    score[some] = by_lang.max(axis=1)
                    rest = by_lang.copy()
                    rest[np.arange(len(some)), at] = 0
                    margin[some] = score[some] - rest.max(axis=1)
                    out[some] = score[some] < m.floor[np.argmax(cosine, axis=1)]
                    for i, k in zip(some, at.tolist(), strict=True):
                        lang[i] = UNKNOWN if reject and out[i] else m.langs[k]
                yield with_columns(part, keep, lang_pred=pa.array(lang, pa.string()), score=pa.array(score), margin=pa.array(margin), rejected=pa.array(out))

    schema = kept_schema(df, keep, *zip(made, ("string", "double", "double", "boolean"), strict=True))
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Documents that no model may learn from: one fold in `folds` by the crc32 of the id as text; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
