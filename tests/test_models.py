import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentigrid.config import HeadTraining, Training
from sentigrid.functions import text as tx
from sentigrid.operators import features as ft
from sentigrid.operators import metrics as mt
from sentigrid.operators import naive_bayes as nb
from sentigrid.operators import sequences as sq
from sentigrid.operators import split as sp
from sentigrid.plans import training

CORPUS = [(0, "a", "red red green"), (1, "a", "red blue"), (2, "a", "green"), (3, "b", "blue blue black")]


@pytest.fixture
def small(spark):
    df = spark.createDataFrame(CORPUS, "doc_id bigint, label string, clean string")
    return ft.with_terms(df)


def test_term_counts(small):
    rows = {(r.doc_id, r.term): r.tf for r in ft.tfidf_terms(small, "doc_id").collect()}
    assert rows[0, "red"] == 2 and rows[3, "blue"] == 2 and len(rows) == 7


def test_document_without_terms(spark):
    df = ft.with_terms(spark.createDataFrame([(1, ""), (2, "x y")], "doc_id bigint, clean string"))
    assert ft.tfidf_terms(df, "doc_id").count() == 0
    assert ft.document_frequency(df).count() == 0


def test_vocabulary_by_hand(small):
    rows = ft.vocabulary_table(small, 3).orderBy("term_idx").collect()
    assert [(r.term, r.df, r.total_tf) for r in rows] == [("blue", 2, 3), ("red", 2, 3), ("green", 2, 2)]
    assert rows[0].idf == pytest.approx(math.log(5 / 3) + 1)


def test_weights_have_length_one(small):
    vocabulary = ft.Vocabulary.fit(small, 4)
    rows = ft.tfidf_transform(small, vocabulary, "doc_id").collect()
    for doc in range(4):
        assert sum(r.weight ** 2 for r in rows if r.doc_id == doc) == pytest.approx(1)
    idf = {t: w for t, w in zip(vocabulary.terms, vocabulary.idf)}
    raw = np.array([2 * idf["red"], idf["green"]])
    got = {r.term: r.weight for r in rows if r.doc_id == 0}
    assert [got["red"], got["green"]] == pytest.approx(list(raw / np.linalg.norm(raw)))


def test_top_features(small):
    vocabulary = ft.Vocabulary.fit(small, 4)
    rows = {r.doc_id: [t.term for t in r.top] for r in ft.top_features(vocabulary.transform(small), vocabulary, 2).collect()}
    assert rows == {0: ["red", "green"], 1: ["blue", "red"], 2: ["green"], 3: ["blue", "black"]}


def test_model_by_hand(small):
    vocabulary = ft.Vocabulary.fit(small, 4)
    featured = vocabulary.transform(small)
    dense = np.array([r.features.toArray() for r in featured.orderBy("doc_id").select("features").collect()])
    alpha, labels = 0.7, np.array(["a", "a", "a", "b"])
    sums = np.array([dense[labels == c].sum(axis=0) for c in "ab"])
    theta = np.log((sums + alpha) / (sums.sum(axis=1, keepdims=True) + alpha * 4))
    prior = np.log([0.75, 0.25])

    table = nb.theta_table(ft.class_term_sums(featured), vocabulary.table(small), ["a", "b"], alpha).collect()
    got = {(r.label, r.position): r.theta for r in table}
    assert len(got) == 8
    assert all(got[c, t] == pytest.approx(theta[i, t]) for i, c in enumerate("ab") for t in range(4))

    model = nb.NaiveBayesModel.fit(featured, ["a", "b"], vocabulary, alpha)
    scored = {r.doc_id: r for r in model.score_features(featured).collect()}
    for doc in range(4):
        raw = prior + dense[doc] @ theta.T
        assert list(scored[doc].scores) == pytest.approx(list(raw))
        p = np.exp(raw - raw.max())
        assert list(scored[doc].probabilities) == pytest.approx(list(p / p.sum()))
        assert scored[doc].prediction == "ab"[raw.argmax()]


def test_unknown_text_falls_to_the_prior(small, spark):
    vocabulary = ft.Vocabulary.fit(small, 4)
    model = nb.NaiveBayesModel.fit(vocabulary.transform(small), ["a", "b"], vocabulary, 1.0)
    row = model.score_text(spark.createDataFrame([("zzz qqq",)], "text string")).first()
    assert row.prediction == "a" and list(row.probabilities) == pytest.approx([0.75, 0.25])


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(1)
    words = {"a": ["red", "rose", "ruby"], "b": ["blue", "sky", "sea"], "c": ["green", "leaf", "moss"]}
    rows = []
    for i in range(150):
        label = "abc"[i % 3]
        noise = [w for ws in words.values() for w in ws]
        text = list(rng.choice(words[label], 3)) + list(rng.choice(noise, 4))
        rows.append((i, label, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, label string, clean string")
    return ft.with_terms(df).cache()


def test_sweep_equals_single_fits(prepared):
    config = Training(alpha_min=0.1, alpha_max=0.4)
    fitted = training.train_naive_bayes(prepared, config)
    history = {r.alpha: r for r in fitted.history.collect()}
    assert sorted(history) == config.alphas()
    for alpha in (0.1, 0.3):
        model = nb.NaiveBayesModel.fit(fitted.part("train"), fitted.model.classes, fitted.vocabulary, alpha)
        for part, column in (("train", "train_score"), ("test", "val_score")):
            one = mt.accuracy(model.score_features(fitted.part(part))).first().accuracy
            assert history[alpha][column] == pytest.approx(one)
    assert fitted.model.alpha == min(history.values(), key=lambda r: (-r.val_score, r.alpha)).alpha


def test_fit_on_train_only(prepared):
    config = Training(fit_on="train", choose_on="val", alpha_max=0.2)
    fitted = training.train_naive_bayes(prepared, config)
    parts = {r.split: r["count"] for r in fitted.features.groupBy("split").count().collect()}
    assert set(parts) == {"train", "val", "test"} and sum(parts.values()) == 150


def test_save_and_load(prepared, spark, tmp_path):
    fitted = training.train_naive_bayes(prepared, Training(), alpha=0.5)
    fitted.model.save(spark, str(tmp_path / "m"))
    loaded = nb.NaiveBayesModel.load(spark, str(tmp_path / "m"))
    assert (loaded.classes, loaded.alpha, loaded.options, loaded.words) == (
        fitted.model.classes, 0.5, fitted.model.options, fitted.model.words)
    text = spark.createDataFrame([("red rose sky",)], "text string")
    assert list(loaded.score_text(text).first().scores) == pytest.approx(list(fitted.model.score_text(text).first().scores))


def test_one_class_is_refused(prepared):
    with pytest.raises(ValueError):
        training.train_naive_bayes(prepared.filter("label = 'a'"))


# 108 rows of sizes 1, 2, 5, 100: 11, 22 and 54 rows by hand
@pytest.mark.parametrize("ratio, quotas", [
    (0.1, {"one": 0, "two": 0, "five": 1, "many": 10}),
    (0.2, {"one": 0, "two": 1, "five": 1, "many": 20}),
    (0.5, {"one": 0, "two": 1, "five": 3, "many": 50}),
])
def test_split_quotas(spark, ratio, quotas, monkeypatch):
    monkeypatch.setattr(sp, "RANKED", 2)  # many rows for one prefix: it is refined
    sizes = {"one": 1, "two": 2, "five": 5, "many": 100}
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    df = spark.createDataFrame(rows, "doc_id bigint, label string")
    monkeypatch.setattr(sp, "STEP_DIGITS", 1)
    got = sp.stratified_split(df, ratio).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(range(i))
    import hashlib
    for label in sizes:
        mine = sorted((hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest(), r.doc_id) for r in got if r.label == label)
        test = {r.doc_id for r in got if r.label == label and r.split == "test"}
        assert test == {d for _, d in mine[:quotas[label]]}


def test_three_way_split_is_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    first = {(r.doc_id, r.split) for r in sp.three_way_split(df).collect()}
    assert first == {(r.doc_id, r.split) for r in sp.three_way_split(df.repartition(7)).collect()}
    assert {s: sum(x == s for _, x in first) for s in ("train", "val", "test")} == {"train": 700, "val": 100, "test": 200}
    other = {(r.doc_id, r.split) for r in sp.three_way_split(df, seed=7).collect()}
    assert other != first


def test_encode_sequences(spark):
    df = spark.createDataFrame([(1, ["x", "y", "z"]), (2, []), (3, ["x"] * 20)], "doc_id int, tokens array<string>")
    rows = {r.doc_id: r for r in sq.encode_sequences(df, ["x", "y"], 6).collect()}
    assert rows[1].input_ids == [2, 4, 5, 1, 3, 0] and rows[1].attention_mask == [1, 1, 1, 1, 1, 0]
    assert rows[2].input_ids == [2, 3, 0, 0, 0, 0]
    assert rows[3].input_ids == [2, 4, 4, 4, 4, 3]


def test_embeddings(spark):
    df = spark.createDataFrame([(1, ["x", "y"], "x y"), (2, [], "")], "doc_id int, tokens array<string>, clean string")
    rows = {r.doc_id: r.embedding for r in sq.hashed_embedding(df, 16).collect()}
    assert len(rows[1]) == 16 and sum(v * v for v in rows[1]) == pytest.approx(1, abs=1e-6) and sum(rows[2]) == 0

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    assert {r.doc_id: r.embedding for r in sq.embed_documents(df, make).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_softmax_head(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "xy"[i % 2], [float(v) for v in rng.normal((i % 2) * 2, 1, 4)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id bigint, label string, embedding array<float>")
    head, history, parts = training.train_softmax_head(vectors, HeadTraining(epochs=2), 5)
    steps = history.orderBy("step").collect()
    assert len(steps) == 2 and steps[1].train_loss < steps[0].train_loss
    scored = head.predict(parts.filter("split = 'test'")).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) for r in scored)
    assert np.mean([r.prediction == r.label for r in scored]) > 0.8
    summary = mt.history_summary(history).first()
    assert summary.final_train_loss == steps[1].train_loss
    head.save(spark, str(tmp_path / "h"))
    from sentigrid.operators.softmax_head import SoftmaxHead
    again = SoftmaxHead.load(spark, str(tmp_path / "h")).predict(parts.filter("split = 'test'"))
    assert {r.doc_id: r.prediction for r in again.collect()} == {r.doc_id: r.prediction for r in scored}


def test_parameter_ranges():
    for bad in (dict(test_ratio=0.6), dict(max_features=20000), dict(alpha_min=0.0), dict(fit_on="x")):
        with pytest.raises(ValueError):
            Training(**bad)
    assert len(Training().alphas()) == 20 and Training().alphas()[-1] == 2.0


def test_split_of_many_classes_equals_that_of_few(spark, monkeypatch):
    sizes = {f"c{i:03d}": 1 + (i * i) % 23 for i in range(60)} | {"big": 400, "huge": 900}
    rows = [(n * 10000 + i, label, "x") for n, (label, size) in enumerate(sizes.items()) for i in range(size)]
    rows += [(10**7 + i, None, "y") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string, place string").repartition(5)

    def splits():
        frames = [sp.stratified_split(df, 0.3), sp.three_way_split(df, 0.2, 0.1, 7)]
        return [sorted((r.doc_id, r.label or "", r.place, r.split) for r in f.collect()) for f in frames]

    few = splits()
    monkeypatch.setattr(sp, "MAX_CLASSES", 10)
    monkeypatch.setattr(sp, "RANKED", 300)
    assert splits() == few
    monkeypatch.setattr(sp, "RANKED", 10**6)
    assert splits() == few


def test_quotas_as_a_table_equal_those_on_the_driver(spark):
    sizes = {f"l{i}": (i * 7919) % 1000 + 1 for i in range(500)}
    table = spark.createDataFrame(list(sizes.items()), "label string, n bigint")
    rows = {r.label: (r.cut_0, r.cut_1) for r in sp.cut_table(table, [0.25, 0.125]).collect()}
    cuts = sp.cumulative_quotas(sizes, [0.25, 0.125])
    assert rows == {c: (cuts[0][c], cuts[1][c]) for c in sizes}


def test_a_hundred_thousand_classes_are_split(spark):
    df = spark.range(250_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100_000).cast("string").alias("label"))
    parts = {r.split: r["count"] for r in sp.stratified_split(df).groupBy("split").count().collect()}
    assert parts == {"test": 50_000, "train": 200_000}


def test_signed_counts_equal_brute_force(spark):
    import hashlib

    rows = [(1, ["x", "y", "x", "é", ""]), (2, []), (3, [f"w{i}" for i in range(300)]), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    got = {r.doc_id: r for r in sq.hashed_embedding(df.withColumn("c", sq.signed_counts(F.col("tokens"), 16)), 16).collect()}
    for doc, tokens in rows:
        want = np.zeros(16)
        for t in tokens or []:
            h = hashlib.md5(t.encode()).hexdigest()
            want[int(h[:7], 16) % 16] += 1 if h[7] < "8" else -1
        if tokens is not None:
            assert list(got[doc].c) == want.tolist()
        length = np.linalg.norm(want) or 1.0
        assert list(got[doc].embedding) == pytest.approx((want / length).tolist(), abs=1e-6)


def _vectors(spark, n=240):
    rng = np.random.default_rng(8)
    rows = [(i, "xyz"[i % 3], [float(v) for v in rng.normal(i % 3, 1.5, 5).astype(np.float32)]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, label string, embedding array<float>").repartition(3)


def _dense_training(parts, config):
    """The same training on one matrix: batches and masks by the row's hashes, the optimiser written out."""
    from sentigrid.operators import minibatch_head as mh

    train = parts.filter("split = 'train'")
    n, batches = train.count(), math.ceil(train.count() / config.batch_size)
    w, m, v, step = np.zeros((6, 3)), 0.0, 0.0, 0
    losses = []
    for epoch in range(1, config.epochs + 1):
        rows = train.select("doc_id", "label", "embedding", mh.batch_number(F.col("doc_id"), config, epoch, batches).alias("b"),
                            mh.mask_key(F.col("doc_id"), config, epoch).alias("k")).collect()
        assert len(rows) == n
        seen = []
        for number in range(batches):
            mine = [r for r in rows if r.b == number]
            if not mine:
                continue
            mask = mh.dropout_mask(np.array([r.k for r in mine]).view(np.uint64), 5, config.dropout)
            x = np.hstack([np.array([r.embedding for r in mine], dtype=np.float64) * mask, np.ones((len(mine), 1))])
            y = np.eye(3)[["xyz".index(r.label) for r in mine]]
            p = np.exp(x @ w)
            p /= p.sum(axis=1, keepdims=True)
            seen.append(-np.log((p * y).sum(axis=1)).mean())
            g = x.T @ (p - y) / len(mine)
            rate = config.learning_rate * (step / config.warmup if step < config.warmup else
                                           (config.epochs * batches - step) / max(1, config.epochs * batches - config.warmup))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * config.weight_decay) - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        losses.append(np.mean(seen))
    return w, losses


def test_minibatch_training_equals_a_dense_one(spark, tmp_path):
    from sentigrid.operators.minibatch_head import LinearHead

    config = HeadTraining(solver="adamw", learning_rate=0.1, batch_size=64, warmup=2, epochs=2, dropout=0.2, weight_decay=0.05)
    head, history, parts = training.train_softmax_head(_vectors(spark), config)
    want, losses = _dense_training(parts, config)
    assert head.weights == pytest.approx(want, abs=1e-9)
    rows = history.orderBy("step").collect()
    assert [r.train_loss for r in rows] == pytest.approx(losses)
    scored = head.predict(parts).collect()
    for r in scored:
        s = np.append(np.array(r.embedding), 1.0) @ want
        p = np.exp(s - s.max())
        assert list(r.probabilities) == pytest.approx((p / p.sum()).tolist())
        assert r.prediction == "xyz"[int(np.argmax(s))]
    assert np.mean([r.prediction == r.label for r in scored]) > 0.45  # a third by chance
    val = [r for r in scored if r.split == "val"]
    assert rows[-1].val_accuracy == pytest.approx(np.mean([r.prediction == r.label for r in val]))
    assert rows[-1].val_loss == pytest.approx(np.mean([-math.log(r.probabilities["xyz".index(r.label)]) for r in val]))
    head.save(spark, str(tmp_path / "l"))
    assert (LinearHead.load(spark, str(tmp_path / "l")).weights == head.weights).all()


def test_every_training_parameter_acts(spark):
    vectors = _vectors(spark, 90)
    base = dict(solver="adamw", learning_rate=0.1, batch_size=32, warmup=2, epochs=2, dropout=0.1, weight_decay=0.01, seed=42)
    weights = [training.train_softmax_head(vectors, HeadTraining(**{**base, **change}))[0].weights for change in (
        {}, {}, dict(learning_rate=0.2), dict(batch_size=16), dict(warmup=1), dict(epochs=3), dict(dropout=0.3), dict(weight_decay=0.5), dict(seed=7))]
    assert (weights[0] == pytest.approx(weights[1]))
    assert all(np.abs(w - weights[0]).max() > 1e-6 for w in weights[2:])


def test_head_prediction_equals_its_layer(spark):
    vectors = _vectors(spark, 90)
    head, _, parts = training.train_softmax_head(vectors, HeadTraining(epochs=1), 3)
    flat = head.model.weights.toArray()
    w, bias = flat[:15].reshape(5, 3), flat[15:]
    for r in head.predict(parts).collect():
        s = np.array(r.embedding, dtype=np.float64) @ w + bias
        p = np.exp(s - s.max())
        assert list(r.probabilities) == pytest.approx((p / p.sum()).tolist(), abs=1e-9)
        assert r.prediction == "xyz"[int(np.argmax(s))]


def test_sweep_by_blocks_equals_that_at_once(spark, prepared, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, f"c{i % 13:02d}", " ".join(rng.choice(["red", "blue", "sky", "leaf", f"own{i % 13}"], 6))) for i in range(260)]
    rows += [(1000 + i, f"c{i % 2:02d}", "red") for i in range(6)]  # ties between classes
    many = ft.with_terms(spark.createDataFrame(rows, "doc_id bigint, label string, clean string"))
    for frame in (many, prepared):
        features, vocabulary = training.split_features(frame)
        classes = sorted(r.label for r in features.select("label").distinct().collect())
        sums = nb.TermSums.collect(features.filter("split = 'train'"), classes, len(vocabulary.terms))
        alphas = [0.1, 0.7, 2.0]

        def swept():
            return sorted((r.split, r.alpha, r.n, r.correct) for r in nb.alpha_sweep(features, sums, alphas).collect())

        at_once = swept()
        for width in (1, 2, 5):
            monkeypatch.setattr(nb, "SWEEP_CELLS", width * len(alphas) * len(vocabulary.terms))
            assert swept() == at_once
        monkeypatch.undo()


def test_terms_as_one_text_train_as_an_array_of_terms_does(texts):
    rows = ["Saya SUKA mobil bagus, bagus!", "kecewa buruk sekali http://x.y don't", "", " ", "cannot x 9 a_b é ok", "日本 good 😀 bad",
            "yang dan", "baik baik baik"]
    both = texts(rows).select("doc_id", tx.feature_terms(tx.full_pipeline(F.col("text"))).alias("terms"), tx.term_text(F.col("text")).alias("joined"))
    assert all(r.joined == " ".join(r.terms) for r in both.collect())
    vocabulary = ft.Vocabulary.fit(both.select("terms"))
    joined = both.select("doc_id", F.col("joined").alias("terms"))
    assert ft.Vocabulary.fit(joined) == vocabulary

    def vectors(frame):
        return {r.doc_id: (r.tf, r.features) for r in vocabulary.transform(frame).collect()}

    assert vectors(joined) == vectors(both.drop("joined"))


def test_vocab_join_moves_a_text_of_terms_and_counts_as_by_hand(spark, tmp_path, monkeypatch):
    from sentigrid.catalog.queries import QUERIES

    docs = ["good cars, good roads", "x y bad roads! @me", None, "", "cars cars 12 é"]
    turns = [(1, 0, "Roads and roads: good"), (1, 1, ""), (2, 0, "nothing known"), (2, 0, "cars 12"), (None, 3, "bad")]
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kinds, fit = [], ft.Vocabulary.fit.__func__

    def seen(cls, df, *args):
        kinds.append(df.schema["terms"].dataType.simpleString())
        return fit(cls, df, *args)

    monkeypatch.setattr(ft.Vocabulary, "fit", classmethod(seen))
    rows = QUERIES["vocab_join"](spark, str(tmp_path)).collect()
    assert kinds == ["string"]
    assert sorted(tuple(r) for r in rows) == [
        ("1:0", "good", 1), ("1:0", "roads", 2), ("2:0", "12", 1), ("2:0", "cars", 1), ("3", "bad", 1)]
