import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sentigrid.config import Training
from sentigrid.plans import scoring, training
from sentigrid.streaming import live

DOCS = ["saya suka mobil bagus ini", "pelayanan buruk dan jelek", "cuaca hari ini biasa", "produk bagus dan keren",
        "mobil rusak parah", "hari biasa saja", "film keren dan bagus", "makanan buruk rusak"] * 6


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id bigint, text string")
    prepared = training.label_and_prepare(docs).cache()
    return training.train_naive_bayes(prepared, Training(alpha_max=0.3)), prepared


def test_scoring_is_narrow_and_whole(fitted, spark):
    model = fitted[0].model
    texts = spark.createDataFrame([(1, "mobil bagus"), (2, "   "), (3, "zzz")], "doc_id bigint, text string")
    result = scoring.score(model, texts, "doc_id")
    assert "Exchange" not in result._jdf.queryExecution().toString()
    rows = {r.doc_id: r for r in result.collect()}
    assert set(rows) == {1, 2, 3} and rows[1].prediction == "positive" and rows[1].sentiment == "Positive"
    assert sum(rows[3].proba.values()) == pytest.approx(1)
    assert rows[2].prediction is None and rows[2].sentiment is None and rows[2].proba is None


def test_explain(fitted, spark):
    trained, prepared = fitted
    texts = spark.createDataFrame([(1, "mobil bagus sekali")], "doc_id bigint, text string")
    rows = {r.label: r for r in scoring.explain(trained.model, texts, prepared).collect()}
    assert set(rows) == set(trained.model.classes)
    assert rows["positive"].features.split(", ")[0] in ("mobil", "bagus")
    assert len(rows["positive"].weights) == 2 and rows["positive"].training_percent == pytest.approx(37.5)
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id bigint, text string")
    assert [(r.label, r.prediction) for r in scoring.explain(trained.model, blank, prepared).collect()] == [(None, None)] * 2
    assert rows["positive"].words == "bagus, mobil" and rows["positive"].training_rows == 18


def test_stream_equals_batch(fitted, spark, tmp_path):
    model = fitted[0].model
    texts = spark.createDataFrame(list(enumerate(DOCS[:8] + ["", "keren"])), "doc_id bigint, text string")
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.read_text_stream(spark, str(tmp_path / "in"), texts.schema)
    live.score_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "log"), "doc_id", once=True).awaitTermination()
    flat = ["doc_id", "prediction", F.map_entries("proba").alias("p")]
    got = spark.read.parquet(str(tmp_path / "out")).select(*flat).collect()
    want = scoring.score(model, texts, "doc_id").select(*flat).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 10


def test_entry_points(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    if os.path.isdir(entry.SMOKE_FOLDER):
        assert entry.entry(spark).columns == ["label", "n", "percent"]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_of_a_table_in_one_file_or_in_a_folder(spark, tmp_path, parts):
    texts = spark.createDataFrame(list(enumerate(DOCS[:6])), "doc_id bigint, text string")
    if parts == 1:
        import pyarrow.parquet as pq
        pq.write_table(texts.toArrow(), str(tmp_path / "messages.parquet"))
    else:
        texts.repartition(parts).write.parquet(str(tmp_path / "messages.parquet"))
    stream = live.read_text_stream(spark, live.table_files(str(tmp_path), "messages.parquet"), texts.schema)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(texts.collect())
