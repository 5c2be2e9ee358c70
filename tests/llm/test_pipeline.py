"""The corpus pipeline against a plain version of its decisions, and the queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from gridloom.llm import bpe_codec, pii, queries
from tests_plain import near_plain, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(expected)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "near_duplicates", "personal_data", "mix", "encoded"]
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()
    bad = labels.where("quality = 0 OR toxic = 1").join(docs, "doc_id")
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.15 * bad.count()
    one = stages["near_duplicates"](spark, kept, SF)
    expected = {d for d, (_, _, k) in near_plain([(r.doc_id, r.text) for r in kept.collect()], 80).items() if k}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == expected
    made = pii.Surrogates(queries.PII_KEY)
    clean = stages["personal_data"](spark, one, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert clean.columns == columns and texts == {r.doc_id: pii.replaced(r.text, made)[0] for r in one.collect()}
    mixed = stages["mix"](spark, clean, SF)
    rows = mixed.collect()
    taken, total = sum(len(r.text.split()) for r in rows), sum(len(t.split()) for t in texts.values())
    assert mixed.columns == columns and abs(taken - 1.5 * total) <= 0.1 * total
    last = stages["encoded"](spark, mixed, SF).collect()
    enc = bpe_codec.encoding(queries.public_tokenizers.path(queries.RANK_FILE), queries.public_tokenizers.PATTERN)
    assert len(last) == len(rows) and all(r.exact and r.ids == enc.encode_ordinary(texts[r.doc_id]) for r in last)


def test_mix_draws_for_each_row_of_an_id(spark):
    sizes = [10 + i % 30 for i in range(400)]
    rows = [(None if i % 2 else 7, " ".join(f"w{i}x{k}" for k in range(n)), "en", "s", 1, "x") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    got = corpus_pipeline.mix(spark, docs, SF)
    words = [len(r.text.split()) for r in got.collect()]
    assert got.columns == docs.columns and abs(sum(words) - 1.5 * sum(sizes)) <= 0.05 * sum(sizes)


AWKWARD = [None, "", " \n\t", "a", "漢字 🙂 fé", "word " * 20_000, *["the same text of several words, twice here"] * 2, "Mary Smith, mary@mail.example.com, 10.2.3.4, one two three"]
COLUMNS = "selected tails entities ids exact copies size key kept component_id n_tokens mixed_row carried_0".split()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows, and columns with the operators' own names."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(AWKWARD)]
    rows += [(None, None, None, None, None), (None, "no id here at all", "en", "s", 17), (None, "no id here at all", "en", "s", 17), (1, "", None, None, None), (1, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"concat('own ', coalesce(doc_id, -1)) AS {c}" for c in COLUMNS])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, awkward, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, awkward, str(tmp_path))
    rows = got.collect()
    assert stage(spark, awkward.where("false"), str(tmp_path)).count() == 0
    if name == "encoded":
        assert len(rows) == 14 and all(r.exact for r in rows) and sum(r.n_tokens == 0 for r in rows) == 5
        return
    assert got.columns == awkward.columns and dict(got.dtypes) == dict(awkward.dtypes)
    assert all(r[c] == f"own {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in COLUMNS)
    expected = sorted((str(r.doc_id), str(r.text)) for r in awkward.collect())
    found = sorted((str(r.doc_id), str(r.text)) for r in rows)
    if name == "quality":  # nothing was graded, so all is kept
        assert found == expected
    elif name == "near_duplicates":
        assert found == [x for x in expected if x[0] != "7"]
    elif name == "personal_data":
        changed = [r for r in rows if r.doc_id == 8]
        assert [x for x in found if x[0] != "8"] == [x for x in expected if x[0] != "8"]
        assert "Smith" not in changed[0].text and changed[0].n_chars == len(changed[0].text)
    else:
        assert set(found) <= set(expected) and len(found) <= 2 * len(expected)


def test_near_duplicates_link_at_four_fifths(spark):
    base = [f"w{i}" for i in range(300)]
    edit = lambda at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    texts = [" ".join(base), edit({20, 60, 100, 140, 180, 220}), " ".join(f"v{i}" for i in range(90))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2]
