"""The registered queries of the text operators and the SQL that checks them. Each query is thin: it applies its operator
with production parameters to whole tables and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe_codec, count_tree, lang_id, manifest, media, mixing, near_dup, pii, prefix_trie, quality_model, quality_rules, repeats, token_counts
from gridloom.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    found = lang_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"], reject=False)
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


#: Of the registered queries; a real run takes its own.
PII_KEY = b"a key for the registered queries"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.surrogate_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    count = lambda kind: F.size(F.filter("entities", lambda e: e["type"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *map(count, pii.TYPES))


def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labelled documents: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


#: A document is kept where it is this probable to be good and not toxic: of held-out ones 0.996 of the clean are, 0.05 of the toxic.
CLEAN = {"at_least": 2, "least": 0.8}


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, quality_grades(spark, sf_dir))
    found = quality_model.graded(docs, model, keep=["doc_id"], **CLEAN)
    return found.select("doc_id", "expected_grade", F.get("tails", 0).alias("p_grade_1"), F.get("tails", 1).alias("p_grade_2"), F.col("selected").alias("kept"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with passages of 50 words or more that other documents have too, and where they are."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_counts(docs, public_tokenizers.path(PIECE_MODEL), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_codec.round_trip(docs, path, pattern, decoded="decoded", exact=None, keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = media.encode(docs, keep=["doc_id", "n_bytes"])
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = media.decode(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32")
    payload = (F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail)
    feature = F.array_join(F.col("features").cast("array<string>"), " ").alias("feature")
    return read.select("doc_id", "n_bytes", *payload, "media_bytes", "media_sha256", feature, F.sha2("rgb", 256).alias("rgb_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    *others, text = map(F.col, manifest.FIELDS)
    other = manifest.digest(*others, manifest.tampered(text, F.col("doc_id")))
    listed = manifest.manifest(docs, manifest.digest(*others, text), carry={"other": other})
    ended = listed.withColumns({"proof_sha256": manifest.proof_digest(F.col("proof")), "folded_root": manifest.folded(F.col("other"), F.col("proof"))})
    return ended.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Query]:
    return {
        "op1_lang_id": op1_lang_id,
        "op2_pii": op2_pii,
        "op3_quality_model": op3_quality_model,
        "op4_repeats": op4_repeats,
        "op5_token_counts": op5_token_counts,
        "op6_media": op6_media,
        "op7_mixing": op7_mixing,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_quality_rules": op9_quality_rules,
        "op10_near_dup": op10_near_dup,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_manifest": op12_manifest,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mixing": mixing.ORACLE_SQL,
        "op9_quality_rules": quality_rules.ORACLE_SQL,
        "op12_manifest": manifest.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
