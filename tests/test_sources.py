import os

import pytest
from pyspark.sql import functions as F

from sentigrid.session import scratch_path, scratch_root, stage_table, staging
from sentigrid.sources import csv, tables


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def values(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_long_lines_skipped_short_lines_padded(spark, tmp_path):
    lines = b'a,b,c\n1,x,y\n2,short\n3,too,long,line\n4,"quoted, comma",z\n5,"line\nbreak",w\n6,,e\n7,long,empty,\n8,"say ""hi""",q\n'
    df = csv.read_csv(spark, put(tmp_path / "in", "f.csv", lines))
    assert df.columns == ["a", "b", "c"]
    assert values(df) == [
        ("1", "x", "y"), ("2", "short", None), ("4", "quoted, comma", "z"), ("5", "line\nbreak", "w"),
        ("6", None, "e"), ("8", 'say "hi"', "q")]


def test_header_of_each_file(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "1.csv", b"a,b\n1,x\n")
    put(folder, "2.csv", b"b,a\ny,2\n")
    put(folder, "3.csv", b"a,c\n3,z\n")
    put(folder, "4.csv", b"")
    want = [("1", "x", None), ("2", "y", None), ("3", None, "z")]
    assert values(csv.read_csv(spark, str(folder)).select("a", "b", "c")) == want
    assert values(csv.read_csv_any_encoding(spark, str(folder)).select("a", "b", "c")) == [
        tuple(x or "nan" for x in row) for row in want]


def test_na_texts(spark, tmp_path):
    path = put(tmp_path / "in", "f.csv", b"a,b\n1,NA\n2,null\n3,nano\n")
    assert values(csv.read_csv(spark, path)) == [("1", None), ("2", None), ("3", "nano")]
    assert values(csv.read_csv(spark, path, na_texts=[]))[0] == ("1", "NA")


def test_encodings(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "u.csv", "id,text\n1,żółć\n".encode())
    put(folder, "l.csv", "id,text\n2,café\n3,\n".encode("latin1"))
    got = values(csv.read_csv_any_encoding(spark, str(folder)))
    assert got == [("1", "żółć"), ("2", "café"), ("3", "nan")]


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert csv.read_csv_any_encoding(spark, str(tmp_path / "none")) is None


def test_null_policy(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    assert values(tables.corpus(df)) == [(1, "x")]
    assert values(tables.corpus(df, null_policy="nan")) == [(1, "x"), (2, "nan")]
    assert values(tables.stringify_columns(df)) == [(1, "x"), (2, "nan")]
    with pytest.raises(ValueError):
        tables.apply_null_policy(df, "other")


def test_stage_and_write(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert values(stage_table(df, "t")) == values(df)
    path = scratch_path(spark, "w")
    tables.write_table(df, path)
    assert values(tables.read_table(spark, path)) == values(df)


def test_staged_tables_go_with_their_block(spark, tmp_path):
    there = lambda folder: os.path.exists(folder.removeprefix("file:"))
    outside = stage_table(spark.range(3), "kept")
    with staging(spark) as folder:
        staged = stage_table(spark.range(5), "numbers")
        assert there(folder) and all(os.path.basename(folder) in f for f in staged.inputFiles())
        with staging(spark) as inner:
            assert stage_table(spark.range(2), "numbers").count() == 2 and scratch_path(spark, "x").startswith(inner)
        assert not there(inner) and scratch_path(spark, "x").startswith(folder)
        staged.write.parquet(str(tmp_path / "result"))
    assert not there(folder) and spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(ValueError), staging(spark) as folder:
        stage_table(spark.range(5), "numbers")
        raise ValueError
    assert not there(folder) and outside.count() == 3
    assert os.path.dirname(scratch_path(spark, "x")) == os.path.join(scratch_root(spark), "sentigrid")


@pytest.mark.parametrize("splits", [1, 16])
def test_scans_are_not_shuffled(spark, splits):
    df = spark.range(0, 1000, 1, splits).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    assert "Exchange" not in tables.corpus(df)._jdf.queryExecution().toString()


def test_joins_of_a_bucketed_pair_move_no_rows(spark, tmp_path):
    from sentigrid.sources import tables as src

    left = spark.range(500).selectExpr("id AS doc_id", "id % 3 AS a").repartition(3)
    right = spark.range(400).selectExpr("id AS doc_id", "id % 5 AS b").repartition(2)
    one, two = src.write_pair(left, right, "doc_id", str(tmp_path / "pair-1"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one.join(two, "doc_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        counted = one.groupBy("doc_id").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert {(r.doc_id, r.a, r.b) for r in joined.collect()} == {(i, i % 3, i % 5) for i in range(400)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE pair_1_left")
        spark.sql("DROP TABLE pair_1_right")
