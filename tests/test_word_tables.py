import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentigrid.functions import lexicon as lx
from sentigrid.functions import text as tx
from sentigrid.functions.stemming import porter_stem
from sentigrid.operators import abbreviations as ab
from sentigrid.operators import lexicon_join as lj
from sentigrid.operators import word_tables as wt

ROWS = ["the cat sat on the mat", "", None, "the", "zebra the , ... cat", "cats running the"]


@pytest.fixture(params=["one way", "frequent words apart"])
def frequent(request, monkeypatch):
    """Runs a test with every word rare, and with some words frequent."""
    monkeypatch.setattr(wt, "FREQUENT", 0 if request.param == "one way" else 6)


def listed(frame):
    return {r.doc_id: list(r.tokens) for r in frame.collect()}


def words():
    return tx.non_empty(F.split(F.col("text"), " "))


def test_stop_table_equals_the_literal_list(texts, spark, frequent):
    table = spark.createDataFrame([("the",), ("on",), ("the",), ("absent",), (None,)], "term string")
    got = listed(wt.remove_listed(texts(ROWS), words(), table))
    want = {r.doc_id: r.t or [] for r in texts(ROWS).select("doc_id", tx.remove_stopwords(words(), ["the", "on"]).alias("t")).collect()}
    assert got == {i: list(t) for i, t in want.items()}
    assert listed(wt.remove_listed(texts(ROWS), words(), table, punctuation=False))[4] == ["zebra", ",", "...", "cat"]


def test_stop_table_of_any_size(texts, spark):
    table = spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("term"))
    got = listed(wt.remove_listed(texts(["w1 x w299999 y w300000", "w5"]), words(), table))
    assert got == {0: ["x", "y", "w300000"], 1: []}


def test_stems_by_a_users_table(texts, spark, frequent):
    table = spark.createDataFrame([("cats", "cat"), ("the", "T"), ("the", "THE"), ("running", "run"), ("unused", "x")], "token string, stem string")
    got = listed(wt.stem_by_table(texts(ROWS), words(), table))
    assert got == {0: ["T", "cat", "sat", "on", "T", "mat"], 1: [], 2: [], 3: ["T"],
                   4: ["zebra", "T", ",", "...", "cat"], 5: ["cat", "run", "T"]}


def test_stems_by_the_corpus_dictionary(texts, frequent):
    rows = ["running cats happily", "relational Cats", "", None]
    got = listed(wt.stem_by_table(texts(rows), words()))
    assert got == {i: [porter_stem(w) for w in (t or "").split()] for i, t in enumerate(rows)}
    dictionary = wt.stem_dictionary(wt.word_rows(texts(["a cats", "cats cats", None]), words())).collect()
    assert sorted((r.token, r.stem) for r in dictionary) == [("a", "a"), ("cats", "cat")]


def test_frequent_words_meet_a_broadcast_and_rare_ones_a_shuffle(texts, spark, monkeypatch):
    monkeypatch.setattr(wt, "FREQUENT", 2)
    rows = wt.word_rows(texts(["hot hot hot hot rare", "hot"]), words())
    table = spark.createDataFrame([("hot", 1), ("rare", 2)], "token string, n int")
    got = sorted((r.token, r.n) for r in wt.meet(rows, table, "token", "inner").collect())
    assert got == [("hot", 1)] * 5 + [("rare", 2)]


# --- lexicon tables ------------------------------------------------------------------------------

def test_lexicon_table_equals_the_literal_lexicon(texts, spark, frequent):
    rows = ["Saya SUKA mobil bagus", "kecewa, buruk sekali!", "broken oke", "", None, "terima kasih #syukur", "日本 good 😀 bad", "x"]
    table = spark.createDataFrame(list(lx.EXTENDED.entries), "term string, polarity string, weight int")
    got = {r.doc_id: (r.positive_score, r.negative_score, r.label) for r in lj.label_by_table(texts(rows), table).collect()}
    scored = lx.with_scores(texts(rows)).withColumn("label", lx.label_of(F.col("positive_score"), F.col("negative_score")))
    assert got == {r.doc_id: (r.positive_score, r.negative_score, r.label) for r in scored.collect()}


def test_short_terms_repeats_and_empty_terms(texts, spark):
    table = spark.createDataFrame([("A", "positive", 1), ("a", "positive", 2), ("bc", "negative", 1), ("", "negative", 9),
                                   (None, "negative", 9), ("a", "negative", 1), ("😀", "positive", 1)], "term string, polarity string, weight int")
    got = {(r.doc_id, r.term, r.polarity, r.weight) for r in lj.matches(texts(["xbcx", "A", "😀y", ""]), table).collect()}
    assert got == {(0, "bc", "negative", 1), (1, "a", "positive", 3), (1, "a", "negative", 1), (2, "😀", "positive", 1)}


def test_two_hundred_thousand_terms(texts, spark):
    table = spark.range(200_000).select(
        F.concat(F.lit("term"), "id", F.lit("#")).alias("term"), F.lit("positive").alias("polarity"), F.lit(1).alias("weight"))
    rows = ["xterm7#y term123456# term199999#", "term200000# term7", None]
    got = {r.doc_id: r.positive_score for r in lj.label_by_table(texts(rows), table).collect()}
    assert got == {0: 3, 1: 0, 2: 0}


# --- abbreviations -----------------------------------------------------------------------------

CORPUS = ["Dr. Budi datang ke kota. Ia melihat dr. Sari di jalan.", "Menurut Dr. Ali, kota itu besar. Jalan itu panjang.",
          "Ia tinggal di kota. dr. Budi tidak.", "Kami bertemu (Dr. Sari) di kota besar sekali."] * 6


def brute_scores(texts_):
    with_, without = Counter(), Counter()
    for text in texts_:
        for w in text.lower().split():
            m = re.search(r"([^\W][\w.]*?)(\.?)[^\w.]*$", w)
            if m and re.search(r"[^\W\d_]", m.group(0)):
                (with_ if m.group(2) else without)[m.group(1)] += 1
    periods, n = sum(with_.values()), sum(with_.values()) + sum(without.values())
    out = {}
    for t in with_:
        a, b = with_[t], without[t]
        p = periods / n
        ratio = 2 * (a * (math.log(0.99) - math.log(p)) + b * (math.log(0.01) - math.log(1 - p)))
        letters = len(t.replace(".", ""))
        score = ratio * math.exp(-letters) * (len(t) - letters + 1) * float(letters) ** -b
        if score >= 0.3:
            out[t] = (a, b, pytest.approx(score))
    return out


def test_abbreviations_of_a_corpus(texts):
    got = {r.term: (r.n_with, r.n_without, r.score) for r in ab.abbreviations(texts(CORPUS)).collect()}
    assert got == brute_scores(CORPUS) and set(got) == {"dr"}
    assert ab.abbreviations(texts(["no periods here", ""])).count() == 0
    assert ab.abbreviations(texts([None])).count() == 0


def test_known_abbreviations_keep_their_period(texts, spark, frequent):
    table = spark.createDataFrame([("dr",), ("e.g",), ("absent",)], "term string")
    rows = ["Dr. Budi pergi.", "see (e.g. this) and dr.", "dr budi dr.", "", None, "Budi. Dr. x"]
    got = {r.doc_id: r.tokens for r in ab.tokenize_with(texts(rows), table, F.col("text")).collect()}
    assert got == {0: ["Dr.", "Budi", "pergi", "."], 1: ["see", "(", "e.g.", "this", ")", "and", "dr", "."],
                   2: ["dr", "budi", "dr", "."], 3: [], 4: None, 5: ["Budi", ".", "Dr.", "x"]}
    none = table.limit(0)
    plain = {r.doc_id: r.t for r in texts(rows).select("doc_id", tx.tokenize(F.col("text")).alias("t")).collect()}
    assert {r.doc_id: r.tokens for r in ab.tokenize_with(texts(rows), none, F.col("text")).collect()} == plain


def test_small_tables_need_no_rows_per_word(texts, spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows per word")

    table = spark.createDataFrame([("the", "T"), ("cats", None), (None, "x")], "token string, stem string")
    listed_words = table.select(F.col("token").alias("term"))
    lexicon = spark.createDataFrame([("cat", "positive", 1), ("THE", "negative", 2)], "term string, polarity string, weight int")

    def run(frame):
        return [listed(wt.remove_listed(frame, words(), listed_words)), listed(wt.stem_by_table(frame, words(), table)),
                sorted(lj.matches(frame, lexicon).collect())]

    twice = texts(ROWS).unionByName(texts(ROWS).filter("doc_id > 3"))
    with monkeypatch.context() as m:
        m.setattr(wt, "IN_ROW", 0)
        m.setattr(lj, "IN_ROW", 0)
        by_rows, by_rows_twice = run(texts(ROWS)), run(twice)
    assert run(twice) == by_rows_twice
    monkeypatch.setattr(wt, "word_rows", refused)
    monkeypatch.setattr(lj, "grams", refused)
    assert run(texts(ROWS)) == by_rows


def test_types_are_taken_apart_once_per_different_word(texts):
    plan = ab.type_counts(texts(CORPUS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract") < plan.index("Generate") and "regexp_extract" not in plan[plan.index("Generate"):]
    rows = ["Dr. x. (e.g.) ... 5. a.b", "", None]
    frame = texts(rows).select("doc_id", ab.period_types(F.col("text")).alias("p"), ab.word_types(F.col("text")).alias("w")).collect()
    assert all(r.p is None or set(r.p) == {w for w in r.w if w.endswith(".")} for r in frame)


def test_large_stem_tables_meet_blocks_of_texts(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows per word")

    monkeypatch.setattr(wt, "IN_ROW", 0)
    table = spark.createDataFrame([("the", "T"), ("the", "THE"), ("cats", None), ("zebra", "z"), (None, "x")], "token string, stem string")
    rows = [(1, ["the", "cats", None, "the"]), (2, None), (3, []), (4, ["zebra", "cat"] * 9), (None, ["the"]), (5, ["cat", "zebra"]), (6, [None])]
    want = {1: ["T", "cats", None, "T"], 2: [], 3: [], 4: ["z", "cat"] * 9, None: ["T"], 5: ["cat", "z"], 6: [None]}
    schema = "doc_id bigint, words array<string>"
    for size in (16 << 20, 40, 1):
        with monkeypatch.context() as m:
            m.setattr(wt, "BLOCK_BYTES", size, raising=False)
            m.setattr(wt, "word_rows", refused)
            m.setattr(wt, "meet", refused)
            assert listed(wt.stem_by_table(spark.createDataFrame(rows, schema).repartition(2), F.col("words"), table)) == want
            assert listed(wt.stem_by_table(spark.createDataFrame([], schema), F.col("words"), table)) == {}
    # texts of one key are one text, word by word
    twice = spark.createDataFrame([*rows, (5, ["the"]), (2, ["cats"]), (None, ["a", "the"])], schema)
    assert listed(wt.stem_by_table(twice, F.col("words"), table)) == {
        **want, 2: ["cats"], 5: ["T", "cat", "z"], None: ["T", "a", "T"]}


def test_a_word_is_one_row_a_block(texts, monkeypatch):
    frame = texts(["the cat the", "the cat", None, "the"]).coalesce(1)
    for size, blocks in ((16 << 20, [["cat", "the"]]), (1, [["cat", "the"], ["cat", "the"], [], ["the"]])):
        monkeypatch.setattr(wt, "BLOCK_BYTES", size)
        got = wt.word_blocks(frame, words(), "doc_id").collect()
        assert sorted(sorted(r.words) for r in got if r.words is not None) == sorted(blocks)
        assert len(got) == 4 and len({r.block for r in got}) == len(blocks)
