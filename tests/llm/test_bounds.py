"""Bounds of samples and of tasks where many rows are alike, and the time of long texts."""

import random
import time

import duckdb
import numpy as np
import pytest
from test_ops import SCHEMA, prose
from tests_plain import plain

from gridloom.llm import lang_id, mixing, near_dup, quality_model


def test_language_sample_is_bounded_though_ids_are_missing(spark, monkeypatch):
    """Thousands of rows without an id, or with one id, or alike: no more than fit_docs of a language are learned from."""
    rows = [(None, f"the plain words of page {i}", "en", "s", 1) for i in range(5000)]
    rows += [(7, f"die wörter der seite {i}", "de", "s", 1) for i in range(3000)] + [(None, "les mots", "fr", "s", 1)] * 2000 + [(9, "les pages", "fr", "s", 1)]
    seen, written = [], lang_id.written
    monkeypatch.setattr(lang_id, "written", lambda df: seen.append(written(df)) or seen[-1])
    model = lang_id.fit(spark.createDataFrame(rows, SCHEMA), fit_docs=100)
    counts = {r.lang: r["count"] for r in seen[0].groupBy("lang").count().collect()}
    assert model.langs == ["de", "en", "fr"] and counts["fr"] == 2 and 50 < counts["en"] <= 100 and 50 < counts["de"] <= 100


def test_grade_sample_is_bounded_though_ids_repeat(spark, monkeypatch):
    rows = [(i % 10, f"good text {i}", "en", "s", 1) for i in range(3000)] + [(i, f"bad {i}", "en", "s", 1) for i in range(100, 400)]
    grades = [(i % 10, 1) for i in range(500)] + [(i, 0) for i in range(100, 400)]
    seen, written = [], quality_model.written
    monkeypatch.setattr(quality_model, "written", lambda df: seen.append(written(df)) or seen[-1])
    model = quality_model.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(grades, "doc_id long, grade int"), fit_rows=200)
    assert model is not None and 100 < seen[-1].count() <= 200


@pytest.mark.parametrize("share", [4, 1024])
def test_alike_rows_share_their_copies(spark, tmp_path, monkeypatch, share):
    """A third of all rows are one row; the copies are those of one order of all rows, as the SQL has it."""
    monkeypatch.setattr(mixing, "ALIKE", share)
    rnd = random.Random(3)
    rows = [(None, "same words here", "en", "a", 1)] * 700 + [(4, None, "en", "a", 1)] * 300 + [(8, "copied text of five", "en", None, 1)] * 400
    rows += [(i, prose(i, rnd.randrange(60)), "en", rnd.choice("abc"), 1) for i in range(900)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.systematic_copies(spark.read.parquet(f"{tmp_path}/documents.parquet")).selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(got.collect()) == plain(con.sql(mixing.ORACLE_SQL).fetchall())


def test_links_of_long_texts_take_time_that_grows_with_the_shingles():
    rnd = np.random.default_rng(1)
    took = []
    for n in (5_000, 20_000):
        base = rnd.integers(0, 2**63, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rnd.choice(base, n // 2, replace=False), rnd.integers(0, 2**63, n // 2, dtype=np.uint64)])) for _ in range(264)]
        sets.append(sets[3][: int(len(sets[3]) * 0.9)])
        began = time.perf_counter()
        found = near_dup.links(sets, list(range(265)), list(range(265)), 85)
        took.append(time.perf_counter() - began)
        assert found.sum() == 267 and found[3, 264] and found[264, 3]
    assert took[1] < 7 * took[0] + 0.5


def test_links_between_sides_equal_brute_force():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.sort(rnd.choice(base, rnd.integers(20, 60), replace=False)) for _ in range(50)]
    left, right = list(range(30)), list(range(10, 50))
    plain_links = [[100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j])) for j in right] for i in left]
    assert (near_dup.links(sets, left, right, 70) == np.array(plain_links)).all()


