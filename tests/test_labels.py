import pytest
from pyspark.sql import functions as F

from sentigrid.functions import lexicon as lx
from sentigrid.functions import words
from sentigrid.operators import labelling as lb

GOLDEN = [
    ("Saya sangat bahagia hari ini! Mobil sport ini keren banget!", (1, 0), (1, 0), "positive"),
    ("Saya suka mobil sport yang bagus dan cepat", (2, 0), (2, 0), "positive"),
    ("Situasi ekonomi semakin memburuk #indonesiagelap", (0, 2), (0, 2), "negative"),
    ("Cuaca hari ini biasa saja, tidak ada yang istimewa", (0, 0), (0, 0), "neutral"),
    ("Terima kasih atas dukungannya! Saya senang sekali #syukur", (3, 0), (3, 0), "positive"),
    ("Pemerintah harus lebih tegas #peringatandarurat", (0, 1), (0, 1), "negative"),
    ("Produk ini bagus sekali, saya sangat puas!", (2, 0), (2, 0), "positive"),
    ("Pelayanan buruk sekali, saya kecewa berat", (0, 2), (1, 3), "negative"),
]


def scores(texts, rows, lexicon, engine):
    out = lx.with_scores(texts(rows), lexicon, engine=engine).collect()
    return [(r.positive_score, r.negative_score) for r in sorted(out, key=lambda r: r.doc_id)]


def test_lexicon_sizes():
    assert len(lx.COMPACT.side("positive")) == 28 and len(lx.COMPACT.side("negative")) == 19
    assert sum(w for _, w in lx.EXTENDED.side("positive")) == 66
    assert sum(w for _, w in lx.EXTENDED.side("negative")) == 49
    assert len(lx.EXTENDED.side("negative")) == 47
    assert dict(lx.EXTENDED.side("negative"))["kecewa"] == 2


@pytest.mark.parametrize("engine", ["builtin", "automaton"])
def test_golden_sentences(texts, engine):
    rows = [g[0] for g in GOLDEN]
    assert scores(texts, rows, lx.COMPACT, engine) == [g[1] for g in GOLDEN]
    assert scores(texts, rows, lx.EXTENDED, engine) == [g[2] for g in GOLDEN]
    for lexicon in (lx.COMPACT, lx.EXTENDED):
        found = {r.doc_id: r.label for r in lx.with_label(texts(rows), lexicon, engine=engine).collect()}
        assert [found[i] for i in range(len(rows))] == [g[3] for g in GOLDEN]


@pytest.mark.parametrize("engine", ["builtin", "automaton"])
def test_label_edge_cases(texts, engine):
    rows = ["tidak suka", "#indonesiagelap2025", "broken", "kecewa", "KECEWA", "", "   ", None, "bagus bagus bagus buruk"]
    assert scores(texts, rows, lx.EXTENDED, engine) == [
        (1, 1), (0, 2), (1, 1), (1, 2), (1, 2), (0, 0), (0, 0), (0, 0), (1, 1)]
    assert scores(texts, rows[:4], lx.COMPACT, engine) == [(1, 1), (0, 2), (0, 0), (0, 1)]


def test_smoke_frame(texts):
    rows = ["I love this!", "This is terrible", "Okay, not bad"]
    assert scores(texts, rows, lx.EXTENDED, "builtin") == [(1, 0), (0, 2), (0, 1)]
    assert scores(texts, rows, lx.COMPACT, "builtin") == [(1, 0), (0, 0), (0, 0)]


def test_expression_form_agrees(column):
    rows = [g[0] for g in GOLDEN]
    assert column(rows, lx.contains_score(F.lower("text"), lx.EXTENDED, "negative")) == [g[2][1] for g in GOLDEN]


def test_matches_and_explanation(texts):
    frame = texts(["saya kecewa", "biasa"])
    rows = sorted(lb.lexicon_matches(frame).collect(), key=str)
    assert {(r.doc_id, r.term, r.weight) for r in rows} == {(0, "kecewa", 2), (0, "kece", 1), (1, None, None)}
    told = {r.doc_id: r for r in lb.explain_label(frame).collect()}
    assert told[0].negative_matches == ["kecewa", "kecewa"] and told[0].positive_matches == ["kece"]
    assert told[0].label == "negative" and told[1].label == "neutral"
    long = lb.explain_label(texts(["x" * 300])).first()
    assert len(long.preview) == 100


def test_own_lexicon_table(spark, texts):
    table = spark.createDataFrame([("Up", "positive", 3), ("down", "negative", 1)], "term string, polarity string, weight int")
    lexicon = lx.Lexicon.from_table(table)
    assert scores(texts, ["up and down"], lexicon, "builtin") == [(3, 1)]


def test_sentiment_names(column):
    assert column(["positive", "negative", "neutral", "other", None], lb.sentiment_name(F.col("text"))) == [
        "Positive", "Negative", "Neutral", "Neutral", "Neutral"]


def test_min_classes(texts):
    with pytest.raises(ValueError):
        lb.require_min_classes(lx.with_label(texts(["a", "b"])))
    lb.require_min_classes(lx.with_label(texts(["bagus", "buruk"])))


def test_label_by_words_equals_contains(texts):
    rows = [g[0] for g in GOLDEN] + ["xsUKAx", "tidak  suka", "#indonesiagelap2025", "KECEWA tİdak suka", "wor\nth it", "", None]
    assert scores(texts, rows, lx.EXTENDED, "words") == scores(texts, rows, lx.EXTENDED, "builtin")
    own = lx.Lexicon((("é", "positive", 1), ("a b", "negative", 2), ("é", "negative", 1)))
    assert scores(texts, ["É a b", "a  b"], own, "words") == scores(texts, ["É a b", "a  b"], own, "builtin") == [(1, 3), (0, 0)]


def test_labels_do_not_test_term_by_term(texts):
    plan = lx.with_label(texts(["a"])).filter("label = 'negative'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan


def test_texts_are_folded_in_bulk_as_one_by_one(texts):
    rows = ["GOOD", None, "\u212aECE bad", "", "İ TOP", "É Nice BAD", "plain"]
    df = texts(rows).select("doc_id", words.term_positions(F.col("text"), ["good", "kece", "top", "bad", "nice"], fold=True).alias("v"))
    want = [[i for i, t in enumerate(["good", "kece", "top", "bad", "nice"]) if t in (r or "").lower()] for r in rows]
    assert [r.v for r in sorted(df.collect(), key=lambda r: r.doc_id)] == want
