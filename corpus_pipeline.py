"""From raw documents to encoded training text: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, also those of
any other name that docs has. What holds for awkward rows in all stages: null, empty and blank texts pass through as the
operators grade them and have no near copies, no personal data, size 0 (so the mix takes them zero times or more by its own
draw) and no tokens; rows without an id are kept by the near-duplicate stage, rows that share an id stay or go together there
and are rows like others elsewhere; repeated rows are rows like others; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe_codec, mixing, near_dup, pii, quality_model
from gridloom.llm.base import discard, table, written
from gridloom.llm.queries import CLEAN, PII_KEY, RANK_FILE, quality_grades

#: Columns of documents that stages work on; others are carried.
WORKED = ("doc_id", "text", "lang", "source", "n_chars")
#: Bands for a similarity of 0.8: of pairs at the bound they miss 7e-6.
NEAR = {"percent": 80, "bands": 30, "rows": 5}


def carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its other columns named by their place, so that no name meets an operator's own; and what each is named."""
    names = {c: c if c in WORKED else f"carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def given_back(done: DataFrame, names: dict[str, str]) -> DataFrame:
    return done.select(*[F.col(now).alias(c) for c, now in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good and not toxic."""
    model = quality_model.fit(docs, quality_grades(spark, sf_dir))
    plain, names = carried(docs)
    return given_back(quality_model.graded(plain, model, **CLEAN).where("selected"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a similarity of 0.8 or more): that with the smallest id."""
    found = near_dup.near_duplicates(docs, **NEAR).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
    # a table of its own, so that the join is free to split an id that many rows share; both sides grow with the data
    kept = written(found.distinct()).hint("merge")
    named = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars, where there is one, is that of the new text."""
    plain, names = carried(docs)
    done = pii.surrogate_texts(plain, PII_KEY, spans=None)
    if "n_chars" in names:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(size, F.col("n_chars"))))
    return given_back(done, names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    rows = docs.withColumn("mixed_row", F.struct(*docs.columns)).select("doc_id", "source", "text", "mixed_row")
    taken = mixing.systematic_copies(rows, carry=["mixed_row"]).where("copies > 0")
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return taken.select("mixed_row", F.explode(copies).alias("copy")).select("mixed_row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether they decode to the text."""
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    ids = bpe_codec.round_trip(docs.select("doc_id", "text", "lang", "source", "n_chars"), path, pattern)
    return ids.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encoded", encoded)]

#: The classifier, the surrogates and the encoding are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, last = written(stage(spark, docs, sf_dir)), before
        if last is not None:
            discard(last)
        before = docs
    return docs
