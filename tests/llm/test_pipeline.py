import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sentigrid.llm import catalog

SMALL = "/root/testdata/sf0.001"


def test_stages_on_messy_documents(spark, tmp_path):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item, copy = words(30), words(150)
    rows = [(i, " ".join(words(120)) + "\nshared footer line", f"s{i % 2}") for i in range(40)]
    rows += [(100, " ".join(copy), "s0"), (101, " ".join(copy + ["more"]), "s1"), (102, " ".join(copy), None)]
    rows += [(200, " ".join(words(40) + item + words(40)), "s0"), (300, None, "s0"), (301, "", None), (302, "junk " * 400, "s1"), (None, " ".join(words(90)), "s1")]
    full = [(*r[:2], "en", r[2], len(r[1] or ""), "x") for r in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    kept = {r.doc_id: r for r in step.collect()}
    assert set(kept) == {*range(40), 100, None}
    assert all("shared footer" not in r.text and r.n_chars == len(r.text) for r in kept.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_are_registered_and_run(spark, name):
    assert entry.queries()[name] is catalog.QUERIES[name] and "pipeline" in entry.queries()
    table = "pages" if name == "op10_site_lines" else "conversations" if name == "op7_chat" else "documents"
    rows = entry.queries()[name](spark, SMALL).count()
    source = spark.read.parquet(f"{SMALL}/{table}.parquet")
    if name == "op7_chat":
        assert rows == source.select(F.col("conv_id")).distinct().count() + 1
    elif name == "op11_ranked_search":
        assert rows == 10 * spark.read.parquet(f"{SMALL}/benchmark.parquet").count()
    elif name != "op3_decontaminate":
        assert rows == source.count()
