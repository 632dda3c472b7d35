from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline as c
from rillet.llm import quality_rules
from test_near_dedup import brute as groups_of
from test_packing import encode
from test_pii import brute as spans_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and result, as the driver runs them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in c.STAGES:
        result = c.staged(stage(spark, docs, SF), "test-stage")
        out[name] = (docs.toPandas(), result.toPandas(), docs.columns, result.columns)
        docs = result
    return out


def test_all_stages_but_the_last_keep_the_columns(stages):
    for _, _, before, after in list(stages.values())[:-1]:
        assert before == after


def test_quality_keeps_what_the_policy_keeps(spark, stages):
    before, after, *_ = stages["quality rules"]
    judged = quality_rules.digest(spark.createDataFrame(before[["doc_id", "text"]])).where("kept").toPandas()
    assert set(after.doc_id) == set(judged.doc_id) and len(after) == len(judged) < len(before)


def test_language_keeps_texts_of_the_known_languages(stages):
    before, after, *_ = stages["language ID"]
    assert len(after) > 0.97 * len(before) and set(after.doc_id) <= set(before.doc_id)


def test_one_document_of_each_group_stays(stages):
    before, after, *_ = stages["near-duplicates"]
    groups = groups_of(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted({component for _, _, component in groups})


def test_personal_data_is_replaced(stages):
    before, after, *_ = stages["personal data"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    assert any(spans_of(t) for t in before.text) and not any(spans_of(t) for t in after.text)
    assert (after.n_chars == after.text.str.len()).all()
    was = before.set_index("doc_id").text
    for doc_id, text in zip(after.doc_id, after.text, strict=True):
        if "<" not in text:
            assert text == was[doc_id]


def test_packing_holds_every_id(stages):
    before, after, *_ = stages["packing"]
    ids = dict(zip(before.doc_id, encode(before.text), strict=True))
    total = defaultdict(int)
    for r in after.itertuples():
        total[r.doc_id] += r.length
        assert r.doc_tokens == len(ids[r.doc_id])
    assert {d: len(x) for d, x in ids.items()} == total


def test_run_applies_the_stages(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(map(tuple, df[key].itertuples(index=False)))
    assert rows(c.run(spark, SF).toPandas()) == rows(stages["packing"][1])


def test_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i} of the" for i in range(12))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (None, text + " q", "en"), (3, "", "en"), (4, text + " mail a@b.org", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, component_id long"
    df = spark.createDataFrame([(*r, None, None, "x", 7) for r in rows], schema)
    for many in (df, df.limit(0)):
        docs = many
        for _, stage in c.STAGES[:-1]:
            docs = c.staged(stage(spark, docs, SF), "test-stage")
            assert docs.columns == df.columns
        assert sorted(r["doc_id"] for r in docs.collect()) == ([1] if many is df else [])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_topk_search", "op5_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    from rillet.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(want)
