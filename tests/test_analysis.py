import math
import random
import re
from collections import Counter

import pytest

from sentigrid.operators import analysis as an
from sentigrid.operators import metrics as mt
from sentigrid.operators import phrases
from sentigrid.functions import scores as sc
from pyspark.sql import functions as F

SCORED = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(SCORED, "label string, prediction string")


def test_confusion(scored):
    rows = {(r.label, r.prediction): r.n for r in mt.confusion_matrix(scored).collect()}
    assert len(rows) == 9 and sum(rows.values()) == len(SCORED)
    assert rows["a", "b"] == 2 and rows["c", "c"] == 0
    wide = {r.label: r for r in mt.confusion_wide(scored, ["a", "b", "c"]).collect()}
    assert (wide["a"].a, wide["a"].b, wide["a"].c) == (5, 2, 0)


def test_report(scored):
    rows = {r.row: r for r in mt.classification_report(scored, 4).collect()}
    assert rows["a"].precision == round(5 / 6, 4) and rows["a"].recall == round(5 / 7, 4)
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f1, rows["c"].support) == (0, 0, 0, 1)
    assert rows["accuracy"].support == round(8 / 11, 4)
    assert rows["weighted avg"].recall == round(8 / 11, 4)
    assert rows["macro avg"].support == 11
    assert mt.weighted_scores(scored).first().accuracy == pytest.approx(8 / 11)


def test_comparison_needs_both(scored):
    first = mt.metric_rows(scored, "one")
    both = mt.metric_union([first, mt.metric_rows(scored, "two")])
    assert mt.model_comparison(both, ["one", "two"]).count() == 4
    assert mt.model_comparison(first, ["one", "two"]).count() == 0


def test_mean_loss(spark):
    df = spark.createDataFrame([("s", 0.5), ("s", 0.25)], "split string, p_true double")
    assert mt.mean_loss(df, "split").first().loss == pytest.approx((math.log(2) + math.log(4)) / 2)


@pytest.mark.parametrize("lengths", [[3, 3, 3], [7]])
def test_histogram_of_a_constant(spark, lengths):
    df = spark.createDataFrame([("x", n) for n in lengths], "label string, word_count int")
    rows = an.word_count_histogram(df).collect()
    assert len(rows) == 30 and {r.bin: r.n for r in rows}[15] == len(lengths)
    assert an.word_count_density(df).count() == 0


def test_histogram_includes_the_maximum(spark):
    df = spark.createDataFrame([("x", n) for n in range(31)] + [("y", 0)], "label string, word_count int")
    rows = an.word_count_histogram(df).collect()
    assert sum(r.n for r in rows) == 32
    assert {(r.label, r.bin): r.n for r in rows}["x", 29] == 2


def test_density_integrates_to_almost_one(spark):
    df = spark.createDataFrame([("x", n) for n in [10] * 5 + [11] * 9 + [12] * 5 + [0, 30]], "label string, word_count int")
    rows = sorted(an.word_count_density(df).collect(), key=lambda r: r.point)
    area = sum((b.x - a.x) * (a.density + b.density) / 2 for a, b in zip(rows, rows[1:]))
    assert 0.85 < area <= 1.0


def test_term_counts_merge_plurals(spark):
    df = spark.createDataFrame([("a", "cat cats dog's 42 glass the cats"), ("b", "cats")], "label string, clean string")
    rows = {(r.label, r.term): r.n for r in an.term_counts_by_label(df).collect()}
    assert rows == {("a", "cat"): 3, ("a", "dog"): 1, ("a", "glass"): 1, ("b", "cats"): 1}


def brute_cloud(texts, stop, threshold):
    """Plain Python counts of words and phrases, without plural merging."""
    words, pairs = {}, {}
    for text in texts:
        ws = text.split()
        for w in ws:
            if w not in stop:
                words[w] = words.get(w, 0) + 1
        for a, b in zip(ws, ws[1:]):
            if a not in stop and b not in stop:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    total = sum(words.values())

    def ll(k, n, p):
        return math.log(max(p, 1e-10)) * k + math.log(max(1 - p, 1e-10)) * (n - k)

    kept = {}
    for (a, b), c12 in pairs.items():
        c1, c2 = words[a], words[b]
        if total <= c1 or total <= c2:
            continue
        p, p1, p2 = c2 / total, c12 / c1, (c2 - c12) / (total - c1)
        score = -2 * (ll(c12, c1, p) + ll(c2 - c12, total - c1, p) - ll(c12, c1, p1) - ll(c2 - c12, total - c1, p2))
        if score > threshold:
            kept[f"{a} {b}"] = (c12, round(score, 6))
    return kept


def test_collocations_by_brute_force(spark):
    texts = ["new york big apple pie", "new york tall tower", "old york new deal"] * 6 + ["apple tower the deal", "pie big old"] * 5
    df = spark.createDataFrame([("a", t) for t in texts], "label string, clean string")
    got = {r.phrase: (r.n, round(r.score, 6)) for r in an.bigram_collocations(df, 10.0).collect()}
    assert got == brute_cloud(texts, {"the"}, 10.0) and got
    cloud = {r.term: r for r in an.word_cloud(df, 5, 10.0).collect()}
    assert len(cloud) == 5 and max(r.relative for r in cloud.values()) == 1.0


def test_overlap(spark):
    training = spark.createDataFrame([("a", "x y z"), ("b", "y w")], "label string, clean string")
    inputs = spark.createDataFrame([(1, "y z q y"), (2, "q")], "doc_id int, clean string")
    rows = {(r.doc_id, r.label): (r.n_common, r.words) for r in an.class_vocab_overlap(inputs, training).collect()}
    assert rows == {(1, "a"): (2, "y, z"), (1, "b"): (1, "y")}
    common = {(r.label, r.term) for r in an.word_intersection(inputs, training).collect()}
    assert common == {("a", "y"), ("a", "z"), ("b", "y")}


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [1000.0, 0.0, 0.0])], "i int, s array<double>")
    rows = {r.i: r for r in df.select("i", sc.softmax(F.col("s")).alias("p"), sc.argmax_class(F.col("s"), ["a", "b", "c"]).alias("c")).collect()}
    assert sum(rows[1].p) == pytest.approx(1) and rows[2].p[0] == pytest.approx(1)
    assert rows[1].c == "b" and rows[2].c == "a"


def test_sample_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    assert an.random_sample(df, 3).collect() == an.random_sample(df.repartition(5), 3).collect()
    assert [r.doc_id for r in an.preview(df, 3).collect()] == [0, 1, 2]


def test_histogram_and_density_have_no_one_task_stage(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), (F.col("id") * 37 % 211).cast("int").alias("word_count"))
    for frame in (an.word_count_histogram(df), an.word_count_density(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_density_equals_the_dense_sum(spark):
    import math
    import statistics

    lengths = {"a": [1, 1, 2, 5, 900], "b": [3, 4, 4], "c": [7, 7]}
    df = spark.createDataFrame([(k, n) for k, v in lengths.items() for n in v], "label string, word_count int")
    rows = an.word_count_density(df).collect()
    assert {r.label for r in rows} == {"a", "b"} and len(rows) == 2 * an.DENSITY_POINTS
    for r in rows:
        own = lengths[r.label]
        h = statistics.stdev(own) * len(own) ** -0.2
        want = sum(math.exp(-0.5 * ((r.x - n) / h) ** 2) for n in own) / (len(own) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 1e-15
    assert an.word_count_density(df.limit(0)).count() == 0 and an.word_count_histogram(df.limit(0)).count() == 0


def test_words_are_counted_in_bulk_as_one_by_one(texts, monkeypatch):
    rows = ["cats cat dog's dogs 12 the cat's x'S", "cat cats, (cats) n't 's don't the", "", None, "é cats'é dog 9 cat", "a b\ta　b", "cats cat cats cat"]
    df = texts(rows).select((F.col("doc_id") % 2).cast("string").alias("label"), F.col("text").alias("clean"))
    listed = F.filter(F.transform(F.regexp_extract_all("clean", F.lit(an.CLOUD_WORD), F.lit(0)), an._bare_word), an._is_word)
    one_by_one = df.select("label", listed.alias("ws")).collect()
    words, pairs, by_label = Counter(), Counter(), set()
    for r in one_by_one:
        words.update((r.label, w) for w in r.ws or [] if w != "the")
        pairs.update((r.label, f"{a} {b}") for a, b in zip(r.ws or [], (r.ws or [])[1:]) if "the" not in (a, b))
    for r in df.collect():
        by_label |= {(r.label, w) for w in re.split(r"[\t 　]+", r.clean or "") if w}
    for most in (an.COUNT_BYTES, 10):
        monkeypatch.setattr(an, "COUNT_BYTES", most)
        for name, neighbours, want in (("term", False, words), ("phrase", True, pairs)):
            counted = an._count_by_label(df, name, neighbours, ["the"])
            assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
            got = Counter()
            for r in counted.collect():
                got[(r.label, r[name])] += r.n
            assert got == want
        assert {(r.label, r.term) for r in an._label_terms(df).collect()} == by_label


def counted_phrases(rows, stop, threshold):
    """Plain Python: (label, phrase) -> (n, c1, c2, score) of (label, text) rows, plurals counted under their singular."""
    def base(word):
        return word[:-1] if word.endswith("s") and not word.endswith("ss") else word

    words, pairs, shown = Counter(), Counter(), {}
    for label, text in rows:
        found = [re.sub(r"'[sS]\Z", "", w) for w in re.findall(r"\w[\w']*", text or "")] if label else []
        found = [w for w in found if not w.isdigit()]
        words.update((label, base(w)) for w in found if w not in stop)
        for a, b in zip(found, found[1:]):
            if a not in stop and b not in stop:
                pairs[label, a, base(b)] += 1
                shown[label, a, base(b)] = min(b, shown.get((label, a, base(b)), b), key=len)
    out = {}
    for (label, a, b), n in pairs.items():
        total, c1, c2 = sum(v for k, v in words.items() if k[0] == label), words[label, base(a)], words[label, b]

        def ll(k, n, p):
            return math.log(max(p, 1e-10)) * k + math.log(max(1 - p, 1e-10)) * (n - k)

        p, p1, p2 = c2 / total, n / c1, (c2 - n) / (total - c1)
        score = -2 * (ll(n, c1, p) + ll(c2 - n, total - c1, p) - ll(n, c1, p1) - ll(c2 - n, total - c1, p2))
        if score > threshold:
            out[label, f"{a} {shown[label, a, b]}"] = (n, c1, c2, round(score, 6))
    return out


def test_phrases_of_many_blocks_equal_a_count_of_all(spark, monkeypatch):
    pick = random.Random(3)
    known = ["cat", "cats", "dog", "dogs", "glass", "s", "bus", "the", "dog's", "12", "tree", "x_1", "été", "étés", "'"]
    rows = [(pick.choice(["a", "b", None]), " ".join(pick.choices(known, k=pick.randint(0, 12))) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, clean string").repartition(3)
    want = counted_phrases(rows, {"the"}, 0.5)
    assert len(want) > 40
    for block, pairs in ((phrases.BLOCK_BYTES, phrases.PAIRS), (150, 40)):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
        monkeypatch.setattr(phrases, "PAIRS", pairs)
        found = an.bigram_collocations(df, 0.5, ["the"]).collect()
        assert {(r.label, r.phrase): (r.n, r.c1, r.c2, round(r.score, 6)) for r in found} == want
    assert an.bigram_collocations(df.limit(0), 0.5).count() == 0 and an.word_cloud(df.limit(0)).count() == 0


def test_pairs_are_merged_without_a_row_for_each_in_a_shuffle(spark):
    df = spark.createDataFrame([("a", "new york new deal")] * 30 + [("b", "old york")], "label string, clean string")
    plan = an.bigram_collocations(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "substring_index" not in plan and "Aggregate [label" not in plan
