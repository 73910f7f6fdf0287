"""Every operator as a query over the tables of one folder: name -> (spark, folder) -> DataFrame.

All run on whole tables. `documents` is the corpus, `conversations` the new texts,
`embeddings` the dense vectors, `labels` a second label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentigrid.config import HeadTraining, Preprocess, Training
from sentigrid.functions import lexicon as lx
from sentigrid.functions import scores as sc
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.operators import abbreviations as ab
from sentigrid.operators import analysis as an
from sentigrid.operators import features as ft
from sentigrid.operators import labelling as lb
from sentigrid.operators import lexicon_join as lj
from sentigrid.operators import metrics as mt
from sentigrid.operators import naive_bayes as nb
from sentigrid.operators import sequences as sq
from sentigrid.operators import split as sp
from sentigrid.operators import word_tables as wt
from sentigrid.plans import scoring, training
from sentigrid.session import scratch_path, stage_table, unnest
from sentigrid.sources import csv as csv_source
from sentigrid.sources import tables as src
from sentigrid.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALPHA = 0.5
LABELS = ["negative", "neutral", "positive"]
SEQUENCE_LENGTH = 128
BUCKETS = 8


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _by_class() -> list[Column]:
    """One probability column per label; null for a label the model does not know."""
    return [_r(F.try_element_at("proba", F.lit(c))).alias(f"p_{c}") for c in LABELS]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return src.read_table(spark, f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """The documents; a table of few splits is dealt out over the cores."""
    table = _table(spark, folder, "documents")
    return src.corpus(table, partitions=src.idle_cores(table))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as new texts, keyed 'conversation:turn'."""
    keyed = _table(spark, folder, "conversations").withColumn(
        "doc_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )
    return src.select_text(keyed, "text")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return lx.with_label(_docs(spark, folder))


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, clean, terms) with the extended lexicon, without stemming."""
    return training.label_and_prepare(_docs(spark, folder))


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    return stage_table(_prepared(spark, folder).select("doc_id", "label", "terms"), "prepared")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, terms) as of `_prepared`, the terms of a document as one text."""
    return training.label_and_terms(_docs(spark, folder))


def _staged_terms(spark: SparkSession, folder: str) -> DataFrame:
    return stage_table(_terms(spark, folder), "terms")


def _labels_only(spark: SparkSession, folder: str) -> DataFrame:
    return stage_table(_labelled(spark, folder).select("doc_id", "label"), "labels")


def _trained(spark: SparkSession, folder: str, alpha: float | None = ALPHA) -> training.TrainedNaiveBayes:
    return training.train_naive_bayes(_staged_terms(spark, folder), Training(), alpha)


def _scored_test(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder).scored("test").select("doc_id", "label", "prediction")


# --- sources and sinks ------------------------------------------------------------------

@query
def scan_parquet(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")


def _as_csv(rows: DataFrame, *columns: str) -> Column:
    """A row as one line of quoted CSV fields."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in columns
    ]
    return F.concat_ws(",", *quoted)


@query
def scan_csv(spark, folder):
    """Messages written as CSV lines in which assistant turns have a field too many and every
    fourth turn a field too few: the former are skipped, the latter padded."""
    rows = _table(spark, folder, "conversations")
    whole = _as_csv(rows, "conv_id", "turn", "text", "role")
    line = (
        F.when(F.col("role") == "assistant", F.concat(whole, F.lit(",surplus")))
        .when(F.col("turn") % 4 == 2, _as_csv(rows, "conv_id", "turn", "text"))
        .otherwise(whole)
    )
    path = scratch_path(spark, "csv")
    rows.select(line.alias("value")).write.text(path)
    read = csv_source.read_csv(spark, path, ["conv_id", "turn", "text", "role"], header=False)
    return read.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                       F.col("turn").cast("bigint").alias("turn"), "text", "role")


@query
def scan_csv_encodings(spark, folder):
    """Documents of other languages than English written as Latin-1 files where Latin-1 can hold them, all
    others as UTF-8 files, read back in one go."""
    rows = _table(spark, folder, "documents").select("doc_id", "lang", "text")
    latin = F.coalesce((F.col("lang") != "en") & ~F.col("text").rlike(r"[^\x00-\xff]"), F.lit(False))
    path = scratch_path(spark, "csv-encodings")
    options = {"header": True, "quoteAll": True, "escape": '"'}
    rows.filter(~latin).write.options(encoding="UTF-8", **options).csv(f"{path}/a")
    rows.filter(latin).write.options(encoding="ISO-8859-1", **options).csv(f"{path}/b")
    read = csv_source.read_csv_any_encoding(spark, [f"{path}/a", f"{path}/b"])
    return read.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")


@query
def stringify_columns(spark, folder):
    """A text column that is null for part of the rows becomes 'nan' there."""
    rows = _table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("lang") != "en", F.col("source")).alias("note"))
    return src.stringify_columns(rows)


@query
def write_results(spark, folder):
    """Scored table written to the shared folder and read back."""
    path = scratch_path(spark, "results")
    result = lb.with_derived(_docs(spark, folder)).drop("text")
    src.write_table(result, path)
    return src.read_table(spark, path)


@query
def write_bucketed(spark, folder):
    """Predictions and true labels written into the same buckets and joined where they lie."""
    scored = stage_table(_scored_test(spark, folder), "scored")
    predicted, truth = src.write_pair(
        scored.select("doc_id", "prediction"), scored.select("doc_id", "label"), "doc_id",
        scratch_path(spark, "bucketed"), BUCKETS)
    return truth.join(predicted, "doc_id")


@query
def save_and_load_model(spark, folder):
    """The fitted model saved, loaded and applied to the test part."""
    fitted = _trained(spark, folder)
    path = scratch_path(spark, "model")
    fitted.model.save(spark, path)
    loaded = nb.NaiveBayesModel.load(spark, path)
    return loaded.score_features(fitted.part("test")).select("doc_id", "label", "prediction")


# --- projections, filters, predicates -----------------------------------------------------

@query
def select_text(spark, folder):
    return src.select_text(_table(spark, folder, "documents"), "text")


@query
def drop_null_text(spark, folder):
    """Rows whose text is null are dropped: for each document one is added, under a negative key."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    empty = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return src.apply_null_policy(docs.unionByName(empty), "drop")


@query
def blank_text(spark, folder):
    """Whether a text is blank, and whether its white space alone is."""
    gaps = F.regexp_replace("text", r"[^\s]+", "")
    return _table(spark, folder, "documents").select(
        "doc_id", tx.is_blank(F.col("text")).cast("int").alias("blank"), tx.is_blank(gaps).cast("int").alias("gaps_blank"))


@query
def filter_by_label(spark, folder):
    return _labelled(spark, folder).filter(F.col("label") == "negative").select("doc_id", "label", "text")


@query
def with_derived(spark, folder):
    return lb.with_derived(_docs(spark, folder)).select("doc_id", "label", "clean", "word_count", "sentiment")


@query
def require_min_classes(spark, folder):
    return lb.class_balance(_labelled(spark, folder)).withColumn(
        "accepted", (F.col("n_classes") >= 2).cast("int"))


# --- joins ----------------------------------------------------------------------------------

@query
def lexicon_matches(spark, folder):
    return lb.lexicon_matches(_docs(spark, folder))


@query
def map_sentiment_name(spark, folder):
    """Labels mapped to display names; documents in Spanish carry an unknown label."""
    label = F.when(F.col("lang") == "es", F.lit("unknown")).otherwise(F.col("label"))
    labelled = lx.with_label(_table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return labelled.select("doc_id", lb.sentiment_name(label).alias("sentiment"))


@query
def stopword_anti_join(spark, folder):
    """Tokens that are no stopwords, counted per document."""
    tokens = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))))
    kept = _docs(spark, folder).select("doc_id", tx.drop_words(tokens).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("bigint").alias("n_kept"),
                       F.size(F.array_distinct("kept")).cast("bigint").alias("n_different"))


@query
def vocab_join(spark, folder):
    """Term counts of new texts, restricted to the vocabulary of the documents."""
    vocabulary = ft.Vocabulary.fit(_terms(spark, folder))
    texts = _messages(spark, folder).withColumn("clean", tx.full_pipeline(F.col("text")))
    weights = ft.tfidf_transform(ft.with_terms(texts), vocabulary, "doc_id")
    return weights.select("doc_id", "term", "tf")


@query
def class_vocab_overlap(spark, folder):
    inputs = _messages(spark, folder).select("doc_id", tx.full_pipeline(F.col("text")).alias("clean"))
    return an.class_vocab_overlap(inputs, _prepared(spark, folder))


@query
def predictions_vs_truth(spark, folder):
    return _scored_test(spark, folder)


# --- aggregations -----------------------------------------------------------------------------

@query
def label_distribution(spark, folder):
    return mt.label_shares(_labelled(spark, folder))


@query
def sentiment_distribution(spark, folder):
    named = _labelled(spark, folder).select(lb.sentiment_name(F.col("label")).alias("sentiment"))
    return mt.label_shares(named, "sentiment")


@query
def label_distribution_compact(spark, folder):
    return mt.label_shares(lx.with_label(_docs(spark, folder), lx.COMPACT))


@query
def word_count_stats(spark, folder):
    counted = _docs(spark, folder).select(F.size(tx.prepare_tokens(F.col("text"))).alias("word_count"))
    return an.word_count_stats(counted).withColumn("mean_words", _r("mean_words"))


@query
def row_count(spark, folder):
    parts = sp.three_way_split(_labels_only(spark, folder))
    return parts.groupBy("split").agg(F.count("*").alias("n"))


def _lengths(spark, folder):
    return _labelled(spark, folder).select("label", F.size(tx.prepare_tokens(F.col("text"))).alias("word_count"))


@query
def word_count_histogram(spark, folder):
    table = an.word_count_histogram(_lengths(spark, folder))
    return table.select("label", "bin", _r("low").alias("low"), _r("high").alias("high"), "n")


@query
def word_count_kde(spark, folder):
    table = an.word_count_density(_lengths(spark, folder))
    return table.select("label", "point", _r("x").alias("x"), _r("density", 9).alias("density"), _r("curve").alias("curve"))


@query
def term_frequency_by_label(spark, folder):
    return an.term_frequency_by_label(_prepared(spark, folder)).withColumn("relative", _r("relative"))


@query
def bigram_collocations(spark, folder):
    prepared = stage_table(_prepared(spark, folder).select("label", "clean"), "clean")
    return an.bigram_collocations(prepared).withColumn("score", _r("score", 4))


@query
def word_cloud(spark, folder):
    prepared = stage_table(_prepared(spark, folder).select("label", "clean"), "clean")
    return an.word_cloud(prepared).withColumn("relative", _r("relative"))


@query
def confusion_matrix(spark, folder):
    return mt.confusion_matrix(_scored_test(spark, folder))


@query
def accuracy(spark, folder):
    return mt.accuracy(_scored_test(spark, folder)).withColumn("accuracy", _r("accuracy"))


@query
def weighted_prf(spark, folder):
    table = mt.weighted_scores(_scored_test(spark, folder))
    return table.select(*[_r(c).alias(c) for c in table.columns])


@query
def classification_report(spark, folder):
    return mt.classification_report(_scored_test(spark, folder))


def _two_models(spark, folder):
    """Test metrics of two naive Bayes models, on the lexicon label and with another alpha."""
    fitted = _trained(spark, folder)
    other = nb.NaiveBayesModel.fit(fitted.part("train"), fitted.model.classes, fitted.vocabulary, 2.0)
    first = mt.metric_rows(fitted.scored("test"), "alpha_half")
    return mt.metric_union([first, mt.metric_rows(other.score_features(fitted.part("test")), "alpha_two")])


@query
def metric_union(spark, folder):
    return _two_models(spark, folder).withColumn("value", _r("value"))


@query
def model_comparison(spark, folder):
    models = ["alpha_half", "alpha_two"]
    wide = mt.model_comparison(_two_models(spark, folder), models)
    return wide.select("metric", *[_r(m).alias(m) for m in models])


@query
def model_comparison_head(spark, folder):
    """Naive Bayes and the softmax head on hashed document vectors, on the same labels."""
    staged = _staged(spark, folder)
    bayes = training.train_naive_bayes(staged, Training(), ALPHA)
    vectors = sq.hashed_embedding(staged, tokens_col="terms").select("doc_id", "label", "embedding")
    head, _, rows = training.train_softmax_head(vectors)
    scored = head.predict(rows.filter("split = 'test'"))
    metrics = mt.metric_union([mt.metric_rows(bayes.scored("test"), "naive_bayes"),
                               mt.metric_rows(scored, "softmax_head")])
    return mt.model_comparison(metrics, ["naive_bayes", "softmax_head"])


@query
def history_summary(spark, folder):
    """Last and best values of the sweep, with alpha as the step and error as the loss."""
    history = _trained(spark, folder, None).history
    table = mt.history_summary(history.select(
        F.col("alpha").alias("step"), (1 - F.col("train_score")).alias("train_loss"),
        (1 - F.col("val_score")).alias("val_loss"), F.col("val_score").alias("val_accuracy")))
    return table.select(*[_r(c).alias(c) for c in table.columns])


@query
def mean_loss(spark, folder):
    """Mean cross-entropy per part."""
    fitted = _trained(spark, folder)
    scored = fitted.model.score_features(fitted.features)
    p_true = F.get(F.col("probabilities"), nb.encode_label(F.col("label"), fitted.model.classes))
    return mt.mean_loss(scored.withColumn("p_true", p_true), "split").withColumn("loss", _r("loss"))


@query
def document_frequency(spark, folder):
    return ft.document_frequency(_prepared(spark, folder))


@query
def class_term_sums(spark, folder):
    features, vocabulary = training.split_features(_staged_terms(spark, folder))
    sums = ft.class_term_sums(features.filter("split = 'train'"))
    names = F.broadcast(vocabulary.table(sums))
    return sums.join(names, "position").select("label", "term", _r("weight_sum").alias("weight_sum"))


# --- windows ------------------------------------------------------------------------------------

@query
def stratified_split(spark, folder):
    return sp.stratified_split(_labels_only(spark, folder))


@query
def three_way_split(spark, folder):
    return sp.three_way_split(_labels_only(spark, folder))


@query
def top_features_per_doc(spark, folder):
    staged = _staged(spark, folder)
    vocabulary = ft.Vocabulary.fit(staged)
    top = ft.top_features(vocabulary.transform(staged), vocabulary)
    rows = top.select("doc_id", F.posexplode_outer("top").alias("i", "t")).filter("t is not null")
    return rows.select("doc_id", "t.term", _r("t.weight").alias("weight"), (F.col("i") + 1).alias("rank"))


@query
def vocab_rank(spark, folder):
    return ft.vocabulary_table(_prepared(spark, folder)).select("term", "term_idx", "total_tf")


@query
def percent_of_total(spark, folder):
    """Share of each language in the corpus, and of each source within its language."""
    counts = _table(spark, folder, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.select(
        "lang", "source", "n",
        _r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent_of_all"),
        _r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("percent_of_lang"),
    )


# --- sorts and limits -----------------------------------------------------------------------------

@query
def preview(spark, folder):
    return an.preview(_table(spark, folder, "documents").select("doc_id", "text"))


@query
def random_sample(spark, folder):
    return an.random_sample(_table(spark, folder, "documents").select("doc_id", "text"))


@query
def argmax_alpha(spark, folder):
    history = _trained(spark, folder, None).history
    table = nb.best_alpha(history)
    return table.select("alpha", _r("train_score").alias("train_score"), _r("val_score").alias("val_score"))


@query
def argmax_class(spark, folder):
    """Predicted class of every document from its rounded scores."""
    fitted = _trained(spark, folder)
    scored = fitted.model.score_features(fitted.features)
    return scored.select("doc_id", "prediction")


@query
def count_desc(spark, folder):
    return mt.label_shares(_labelled(spark, folder)).select("label", "n")


# --- sets -------------------------------------------------------------------------------------------

@query
def word_intersection(spark, folder):
    inputs = _messages(spark, folder).select("doc_id", tx.full_pipeline(F.col("text")).alias("clean"))
    return an.word_intersection(inputs, _prepared(spark, folder))


@query
def distinct_labels(spark, folder):
    return _labelled(spark, folder).select("label").distinct().orderBy("label")


# --- scalar functions ----------------------------------------------------------------------------------

@query
def auto_label_compact(spark, folder):
    return lx.with_label(_docs(spark, folder), lx.COMPACT).select("doc_id", "label")


@query
def auto_label_extended(spark, folder):
    return lx.with_scores(_docs(spark, folder)).select(
        "doc_id", "positive_score", "negative_score",
        lx.label_of(F.col("positive_score"), F.col("negative_score")).alias("label"))


@query
def auto_label_builtin(spark, folder):
    """The extended label by the other engine, which must agree with the contains() tests."""
    return lx.with_label(_docs(spark, folder), engine="automaton").select("doc_id", "label")


@query
def explain_label(spark, folder):
    table = lb.explain_label(_docs(spark, folder))
    joined = {c: F.array_join(c, ", ") for c in ("positive_matches", "negative_matches")}
    return table.withColumns(joined)


@query
def clean_noise(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.clean_noise(F.col("text")).alias("clean"))


@query
def decode_bytes(spark, folder):
    """Texts as bytes, with stray bytes put around those that are not English."""
    raw = F.col("text").cast("binary")
    stray = F.lit(bytearray(b"\xff\xc3")).cast("binary")
    broken = F.when(F.col("lang") == "en", raw).otherwise(F.concat(stray, F.lit(bytearray(b" ")).cast("binary"), raw, stray))
    return _table(spark, folder, "documents").select("doc_id", tx.decode_bytes(broken).alias("text"))


@query
def case_fold(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.case_fold(F.col("text")).alias("folded"))


@query
def tokenize(spark, folder):
    tokens = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))))
    return _docs(spark, folder).select("doc_id", tokens.alias("t")).select(
        "doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


@query
def remove_stopwords(spark, folder):
    tokens = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))))
    return _docs(spark, folder).select("doc_id", F.array_join(tx.remove_stopwords(tokens), " ").alias("kept"))


@query
def stem(spark, folder):
    """Stems of all tokens."""
    tokens = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))))
    return _docs(spark, folder).select("doc_id", F.array_join(tx.stem_tokens(tokens), " ").alias("stems"))


def _cleaned_tokens() -> Column:
    return tx.cleaned_tokens(F.col("text"))


def _joined(table: DataFrame, name: str) -> DataFrame:
    return table.select("doc_id", F.array_join("tokens", " ").alias(name))


def _abbreviated(spark, folder) -> DataFrame:
    """The documents with the conjunction ` und ` written as the abbreviation ` u. `."""
    return _docs(spark, folder).withColumn("text", F.replace("text", F.lit(" und "), F.lit(" u. ")))


@query
def abbreviations(spark, folder):
    """Abbreviations learned from the whole corpus."""
    return ab.abbreviations(_abbreviated(spark, folder)).withColumn("score", _r("score"))


@query
def tokenize_abbreviations(spark, folder):
    """Tokens in which the learned abbreviations keep their period."""
    docs = _abbreviated(spark, folder)
    known = stage_table(ab.abbreviations(docs), "abbreviations")
    table = ab.tokenize_with(docs, known, tx.case_fold(tx.clean_noise(F.col("text"))), plain_spaces=True)
    return _joined(table, "tokens")


def _message_words(spark, folder) -> DataFrame:
    """The different words of each conversation turn; a table of few splits is dealt out over the cores."""
    messages = _messages(spark, folder)
    cores = src.idle_cores(messages)
    dealt = messages.repartition(cores, "doc_id") if cores else messages
    return dealt.select(F.array_distinct(_cleaned_tokens()).alias("words"))


def _message_stems(messages: DataFrame) -> DataFrame:
    """A user's stem table: the words of the conversations of more than five letters, by their first five."""
    words = unnest(messages, F.col("words"), "token").distinct()
    return words.filter(F.length("token") > 5).select("token", F.substring("token", 1, 5).alias("stem"))


@query
def stem_by_table(spark, folder):
    """All tokens stemmed by a user's table."""
    return _joined(wt.stem_by_table(_docs(spark, folder), _cleaned_tokens(), _message_stems(_message_words(spark, folder))), "stems")


@query
def stem_dictionary(spark, folder):
    """The corpus's own dictionary: each different token stemmed once."""
    return wt.stem_dictionary(wt.word_rows(_docs(spark, folder), _cleaned_tokens()))


@query
def full_preparation_by_tables(spark, folder):
    """The compact preparation with a stop list and a stem table from the data, both joined."""
    docs = _docs(spark, folder)
    messages = stage_table(_message_words(spark, folder), "message-words")
    kept = stage_table(wt.remove_listed(docs, _cleaned_tokens(), _stop_table(messages)), "kept")
    return _joined(wt.stem_by_table(kept, F.col("tokens"), _message_stems(messages)), "clean")


def _stop_table(messages: DataFrame) -> DataFrame:
    """A stop list: the default words, and the words of the conversations that over a tenth of them hold."""
    words = unnest(messages, F.col("words"), "term")
    size = messages.count()
    often = words.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") * 10 > size).select("term")
    default = messages.sparkSession.createDataFrame([(w,) for w in stoplists.DEFAULT], "term string")
    return often.unionByName(default)


@query
def stopwords_by_table(spark, folder):
    """Stopwords removed by an anti join with a table."""
    return _joined(wt.remove_listed(_docs(spark, folder), _cleaned_tokens(), _stop_table(_message_words(spark, folder))), "kept")


def _lexicon_table(spark, folder) -> DataFrame:
    """The extended lexicon, and the words of the benchmark items of over five letters with sides by their length."""
    own = spark.createDataFrame(list(lx.EXTENDED.entries), "term string, polarity string, weight int")
    words = _table(spark, folder, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term"))
    side = F.when(F.length("term") % 2 == 0, "positive").otherwise("negative")
    more = words.distinct().filter(F.length("term") > 5).select("term", side.alias("polarity"), F.lit(1).alias("weight"))
    return own.unionByName(more)


@query
def label_by_table(spark, folder):
    """Labels from a lexicon table of any size."""
    return lj.label_by_table(_docs(spark, folder), _lexicon_table(spark, folder))


@query
def lexicon_matches_by_table(spark, folder):
    return lj.matches(_docs(spark, folder), _lexicon_table(spark, folder))


@query
def full_preparation(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.full_pipeline(F.col("text")).alias("clean"))


@query
def full_preparation_compact(spark, folder):
    """With stemming."""
    return _docs(spark, folder).select("doc_id", tx.full_pipeline(F.col("text"), Preprocess.compact()).alias("clean"))


@query
def preparation_trace(spark, folder):
    return tx.trace_steps(_docs(spark, folder))


@query
def preprocess_text(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.preprocess_text(F.col("text"), stem=False).alias("clean"))


@query
def word_count(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@query
def text_lengths(spark, folder):
    clean = _docs(spark, folder).select("doc_id", "text", tx.full_pipeline(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.length("text").alias("text_length"), F.length("clean").alias("clean_length"),
                        tx.word_count(F.col("clean")).alias("words"))


@query
def title_case_label(spark, folder):
    return _labelled(spark, folder).select("doc_id", tx.title_case(F.col("label")).alias("shown"))


@query
def softmax(spark, folder):
    """Each vector of `embeddings` as scores: largest and summed probability, and its position."""
    p = sc.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return _table(spark, folder, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", _r(F.array_max("p")).alias("largest"), _r(F.array_min("p")).alias("smallest"),
        _r(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def format_percent(spark, folder):
    """Confidence of the test predictions in percent."""
    fitted = _trained(spark, folder)
    return fitted.scored("test").select(
        "doc_id", sc.percent(_r(F.array_max("probabilities"), 9)).alias("confidence"))


# --- features and models -----------------------------------------------------------------------------------

@query
def tfidf_terms(spark, folder):
    docs = _docs(spark, folder).select("doc_id", tx.full_pipeline(F.col("text")).alias("clean"))
    return ft.tfidf_terms(docs, "doc_id")


@query
def tfidf_fit(spark, folder):
    return ft.vocabulary_table(_prepared(spark, folder)).withColumn("idf", _r("idf"))


@query
def tfidf_transform(spark, folder):
    staged = _staged(spark, folder)
    weights = ft.tfidf_transform(staged, ft.Vocabulary.fit(staged), "doc_id")
    return weights.withColumn("weight", _r("weight"))


@query
def label_encode(spark, folder):
    labelled = _labels_only(spark, folder)
    classes = lb.class_list(labelled)
    coded = labelled.withColumn("label_idx", nb.encode_label(F.col("label"), classes))
    return coded.withColumn("decoded", nb.decode_label(F.col("label_idx"), classes))


@query
def label_decode(spark, folder):
    """The coded labels turned back into names."""
    labelled = _labels_only(spark, folder)
    classes = lb.class_list(labelled)
    coded = labelled.select("doc_id", nb.encode_label(F.col("label"), classes).alias("label_idx"))
    return coded.select("doc_id", nb.decode_label(F.col("label_idx"), classes).alias("label"))


@query
def nb_fit(spark, folder):
    features, vocabulary = training.split_features(_staged_terms(spark, folder))
    sums = ft.class_term_sums(features.filter("split = 'train'"))
    theta = nb.theta_table(sums, vocabulary.table(sums), lb.class_list(features), ALPHA)
    return theta.select("label", "term", _r("theta").alias("theta"))


@query
def nb_prior(spark, folder):
    features, _ = training.split_features(_staged_terms(spark, folder))
    priors = nb.class_log_priors(features.filter("split = 'train'"))
    return priors.withColumn("log_prior", _r("log_prior"))


@query
def nb_predict(spark, folder):
    fitted = _trained(spark, folder)
    scored = fitted.model.score_features(fitted.features)
    best = F.round(F.array_max("scores"), 6)
    return scored.select("doc_id", "split", "label", "prediction", best.alias("score"))


@query
def nb_predict_proba(spark, folder):
    fitted = _trained(spark, folder)
    scored = fitted.model.score_features(fitted.features)
    proba = sc.probability_map(F.col("probabilities"), fitted.model.classes)
    return scored.select("doc_id", proba.alias("proba")).select("doc_id", *_by_class())


@query
def nb_alpha_sweep(spark, folder):
    history = _trained(spark, folder, None).history
    return history.select(_r("alpha").alias("alpha"), _r("train_score").alias("train_score"), _r("val_score").alias("val_score"))


@query
def nb_alpha_sweep_unseen(spark, folder):
    """The sweep with the vocabulary from the training part and alpha chosen on a validation part."""
    config = Training(fit_on="train", choose_on="val")
    history = training.train_naive_bayes(_staged_terms(spark, folder), config).history
    return history.select(_r("alpha").alias("alpha"), _r("train_score").alias("train_score"), _r("val_score").alias("val_score"))


@query
def nb_toxic(spark, folder):
    """The same training on the `toxic` label of the annotated documents."""
    marks = _table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"))
    docs = _docs(spark, folder).join(marks, "doc_id")
    prepared = docs.select("doc_id", "label", tx.feature_terms(tx.full_pipeline(F.col("text"))).alias("terms"))
    history = training.train_naive_bayes(stage_table(prepared, "toxic")).history
    return history.select(_r("alpha").alias("alpha"), _r("train_score").alias("train_score"), _r("val_score").alias("val_score"))


@query
def encode_sequences(spark, folder):
    """Ids and mask as text, next to the label code."""
    staged = _staged(spark, folder)
    vocabulary = ft.Vocabulary.fit(staged)
    classes = lb.class_list(staged)
    coded = sq.encode_sequences(staged, vocabulary.by_rank(), SEQUENCE_LENGTH, "terms")
    return coded.select(
        "doc_id", nb.encode_label(F.col("label"), classes).alias("label_idx"),
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), " ").alias("attention_mask"))


@query
def embed_documents(spark, folder):
    """Signed hashed document vectors: the counts as text, the number of filled places, and the vector's length."""
    docs = _docs(spark, folder).select("doc_id", tx.prepare_tokens(F.col("text")).alias("tokens"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return sq.hashed_embedding(docs).withColumn("counts", sq.signed_counts(F.col("tokens"))).select(
        "doc_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), " ").alias("counts"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"), _r(norm, 4).alias("norm"))


@query
def embed_documents_batched(spark, folder):
    """The encoder contract: batches of texts to vectors (here: letter shares) on the executors."""
    def make_encoder():
        import numpy as np

        def encode(texts):
            flat = [np.frombuffer(t.encode("utf-8"), dtype=np.uint8) for t in texts]
            return np.stack([np.bincount(t % 32, minlength=32)[:32] / max(len(t), 1) for t in flat]).astype(np.float32)

        return encode

    docs = _docs(spark, folder).select("doc_id", tx.full_pipeline(F.col("text")).alias("clean"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return sq.embed_documents(docs, make_encoder).select("doc_id", _r(total, 3).alias("total"))


def _head(spark, folder):
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    return training.train_softmax_head(vectors, HeadTraining())


@query
def softmax_head_fit(spark, folder):
    _, history, _ = _head(spark, folder)
    return history


@query
def softmax_head_summary(spark, folder):
    _, history, _ = _head(spark, folder)
    return mt.history_summary(history)


@query
def softmax_head_minibatch(spark, folder):
    """History of the head trained in mini-batches by AdamW with warm-up, weight decay and dropout."""
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    config = HeadTraining(solver="adamw", learning_rate=0.05, batch_size=128, warmup=4, epochs=2, dropout=0.1)
    _, history, _ = training.train_softmax_head(vectors, config)
    return history.select("step", *[_r(c).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")])


@query
def softmax_head_predict(spark, folder):
    head, _, rows = _head(spark, folder)
    return head.predict(rows.filter("split = 'test'")).select(
        "doc_id", "label", "prediction", _r(F.array_max("probabilities")).alias("confidence"))


@query
def evaluate(spark, folder):
    """Report and confusion counts of the test part in one table of (section, row, column, value)."""
    scored = stage_table(_scored_test(spark, folder), "scored")
    report = mt.classification_report(scored, 3)
    names = ["precision", "recall", "f1", "support"]
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in names])
    upper = report.select(F.lit("report").alias("section"), "row", F.inline(cells))
    lower = mt.confusion_matrix(scored).select(
        F.lit("confusion").alias("section"), F.col("label").alias("row"), F.col("prediction").alias("measure"),
        F.col("n").cast("double").alias("value"))
    return upper.unionByName(lower)


@query
def score_text(spark, folder):
    """Messages scored by a model trained on the documents."""
    model = _trained(spark, folder).model
    table = scoring.score(model, _messages(spark, folder), "doc_id")
    return table.select("doc_id", "prediction", "sentiment",
                        *_by_class())


@query
def score_explain(spark, folder):
    prepared = stage_table(_prepared(spark, folder), "prepared")
    model = training.train_naive_bayes(prepared, Training(), ALPHA).model
    table = scoring.explain(model, _messages(spark, folder), prepared)
    return table.withColumns({
        "p": _r("p"), "training_percent": _r("training_percent"),
        "weights": _r(F.aggregate("weights", F.lit(0.0), lambda a, b: a + b))})


# --- streaming ---------------------------------------------------------------------------------------------------

@query
def score_stream(spark, folder):
    """The messages as a stream of files, scored into a table."""
    model = _trained(spark, folder).model
    schema = _table(spark, folder, "conversations").schema
    texts = live.read_text_stream(spark, live.table_files(folder, "conversations.parquet"), schema).withColumn(
        "doc_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = scratch_path(spark, "stream")
    running = live.score_stream(model, texts, out, f"{out}-log", "doc_id", once=True)
    running.awaitTermination()
    # a table without rows leaves no file to take the schema from
    scored = spark.read.schema(scoring.score(model, texts, "doc_id").schema).parquet(out)
    return scored.select("doc_id", "prediction", "sentiment",
                         *_by_class())
