import numpy as np
import pandas as pd
import pytest

from rillet.llm import language_id as lid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return lid.train(docs.where(~lid.held_out()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_proportions_of_mixed_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000").toPandas()
    text = {x: docs[docs.lang == x].text.iloc[0] for x in ("en", "fr", "de")}
    mixed = pd.Series([text["en"][:2000] + " " + text["fr"][:1000], text["de"][:3000], text["fr"][:400] + " " + text["en"][:3000] + " " + text["de"][:400]])
    got = lid.mixtures(mixed, model)
    assert got.languages.tolist() == ["en,fr", "de", "de,en,fr"]
    assert got.lang_pred.tolist() == ["en", "de", "en"]
    assert 0.5 < got.score[0] < 0.8 and got.score[1] == 1


def test_undetermined_texts(model):
    got = lid.mixtures(pd.Series([None, "", "123 !?", " \n"]), model)
    assert got.lang_pred.tolist() == ["und"] * 4 and got.score.tolist() == [0.0] * 4


def test_pieces_do_not_change_the_words(model, monkeypatch):
    text = "les éaux de la ville et der Berg ist hoch " * 60
    whole = lid.mixtures(pd.Series([text, "x", text]), model)
    monkeypatch.setattr(lid, "PIECE", 200)
    cut = lid.mixtures(pd.Series([text, "x", text]), model)
    assert cut.lang_pred.tolist() == whole.lang_pred.tolist()
    assert np.allclose(cut.score, whole.score)
    assert "".join(lid._cut(text)) == text


def test_without_labels_everything_is_undetermined(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "", "")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in lid.digest(df).collect()} == {"und"}
    assert lid.digest(df.limit(0)).count() == 0


def test_prediction_reads_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source")
    model = lid.train(docs)
    one = docs.select(lid.predictor(model)("text").alias("p")).collect()
    other = docs.selectExpr("text", "'zz' AS lang").select(lid.predictor(model)("text").alias("p")).collect()
    assert one == other


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "the of and to in", "en"), (None, "the of and to in", "en"), (4, "le la les des", "fr"), (4, "le la les des", "fr")]
    got = lid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 4
