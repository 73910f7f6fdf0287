"""Distributions, term and phrase statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.functions.words import chunks, cut_at_white_space, label_codes, row_of
from sentigrid.operators.phrases import base_rows, block_pairs, counted_bases, counted_pairs, counted_words, numbered, phrase_blocks
from sentigrid.session import stage_table, unnest

# --- fixed values: figures of the charts ------------------------------------------------
HISTOGRAM_BINS = 30
DENSITY_POINTS = 200
CLOUD_WORDS = 100
COLLOCATION_THRESHOLD = 30.0
PROBABILITY_FLOOR = 1e-10
KERNEL_RADIUS = 9.0
CLOUD_WORD = rf"[{tx.WORD}][{tx.WORD}']*"
# --- end of fixed values ----------------------------------------------------------------

# bytes of text whose words are counted at a time
COUNT_BYTES = 16 << 20


def word_count_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("word_count").alias("mean_words"),
        F.min("word_count").alias("min_words"),
        F.max("word_count").alias("max_words"),
    )


def length_counts(df: DataFrame) -> DataFrame:
    """(label, word_count, n): the only pass over the documents for histogram and density."""
    return df.groupBy("label", "word_count").agg(F.count("*").alias("n"))


def _ends(counts: DataFrame) -> tuple[float, float] | None:
    """Least and largest length over all labels; None for an empty table. One row reaches the driver."""
    low, high = counts.agg(F.min("word_count"), F.max("word_count")).first()
    return None if low is None else (float(low), float(high))


def _grid(labels: DataFrame, name: str, n: int) -> DataFrame:
    """Every label with the numbers 0 to n - 1."""
    return labels.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def word_count_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(label, bin, low, high, n) over equal-width bins shared by all labels, zeros included.

    A constant column is centred in a range of width one. The documents are counted by length once; the
    ends are one row, and the counted lengths stay spread over the tasks by (label, length).
    """
    counts = stage_table(length_counts(df), "lengths")
    low, high = _ends(counts) or (0.0, 0.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    slot = F.least(F.lit(bins - 1), F.floor((F.col("word_count") - low) * bins / (high - low))).cast("int")
    filled = counts.groupBy("label", slot.alias("bin")).agg(F.sum("n").alias("n"))
    width = (high - low) / bins
    every = _grid(counts.select("label").distinct(), "bin", bins)
    same = every["label"].eqNullSafe(filled["label"]) & (every["bin"] == filled["bin"])
    return every.join(filled, same, "left").select(
        every["label"], every["bin"], (low + every["bin"] * width).alias("low"),
        (low + (every["bin"] + 1) * width).alias("high"), F.coalesce(filled["n"], F.lit(0)).alias("n"))


def length_moments(counts: DataFrame) -> DataFrame:
    """(label, total, h) from counted lengths: rows and Scott's bandwidth, for labels whose lengths vary.

    Sums of whole numbers, so the variance is exact however the rows are spread.
    """
    n, x = (F.col(c).cast("decimal(18,0)") for c in ("n", "word_count"))
    sums = counts.groupBy("label").agg(
        F.sum("n").alias("total"), F.sum(n * x).cast("decimal(38,0)").alias("s1"), F.sum(n * x * x).cast("decimal(38,0)").alias("s2"))
    # sum of squared distances: (total * s2 - s1 * s1) / total
    whole, s1, s2 = (F.col(c).cast("double") for c in ("total", "s1", "s2"))
    variance = F.try_divide(s2 - s1 * s1 / whole, whole - 1)
    return sums.select("label", "total", (F.sqrt(variance) * F.pow(whole, F.lit(-0.2))).alias("h")).filter("h > 0")


def word_count_density(df: DataFrame, points: int = DENSITY_POINTS, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Gaussian kernel density per label on a shared grid: (label, point, x, density, curve).

    Scott's bandwidth; `curve` is the density scaled to the histogram's counts. Labels whose
    lengths do not vary have no density. Works on the counted lengths, so the grid
    multiplies distinct lengths and not documents; a length reaches the points within KERNEL_RADIUS bandwidths, beyond
    which the kernel is below 3e-18 of its peak. The counts stay spread by (label, length); what is joined to them has one row per label.
    """
    counts = stage_table(length_counts(df), "lengths")
    ends = _ends(counts)
    moments = stage_table(length_moments(counts), "moments")
    low, high = ends or (0.0, 0.0)
    step = (high - low) / (points - 1) or 1.0
    at, h = F.col("word_count").cast("double"), F.col("h")
    first = F.greatest(F.lit(0), F.ceil((at - low - KERNEL_RADIUS * h) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((at - low + KERNEL_RADIUS * h) / step)).cast("int")
    near = counts.join(F.broadcast(moments), "label").withColumn("first", first).withColumn("last", last)
    reached = near.filter("first <= last").withColumn("point", F.explode(F.sequence("first", "last")))
    kernel = F.col("n") * F.exp(-0.5 * F.pow((low + F.col("point") * step - at) / h, 2))
    mass = reached.groupBy("label", "point").agg(F.sum(kernel).alias("mass"))
    return (
        _grid(moments, "point", points).join(mass, ["label", "point"], "left")
        .withColumn("x", low + F.col("point") * step)
        .withColumn("density", F.coalesce("mass", F.lit(0.0)) / (F.col("total") * h * F.sqrt(F.lit(2.0) * F.pi())))
        .select("label", "point", "x", "density",
                (F.col("density") * F.col("total") * (high - low) / bins).alias("curve"))
    )


def _found_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLOUD_WORD), F.lit(0))


def _bare_word(word: Column) -> Column:
    """Without a possessive 's."""
    possessive = word.endswith("'s") | word.endswith("'S")
    return F.when(possessive, F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)


def _is_word(word: Column) -> Column:
    """Not a pure number."""
    return ~word.rlike(r"^\p{N}+$")


def _plural_base(word: Column) -> Column:
    plural = word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _merge_plurals(items: DataFrame, item: str) -> DataFrame:
    """(label, base, item, n) of (label, item, n): a plural is counted under its singular where both occur.

    Forms with one base are the base itself and base + 's', so counting the former tells which
    occur. All aggregates are numbers, which keeps this a hash aggregation combined map-side.
    """
    base = _plural_base(F.col(item))
    counted = items.groupBy("label", base.alias("base")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col(item) == base, F.col("n")).otherwise(0)).alias("n_singular"))
    form = F.when(F.col("n_singular") > 0, F.col("base")).otherwise(F.concat("base", F.lit("s")))
    return counted.select("label", "base", form.alias(item), "n")


_ASCII_WORD, _POSSESSIVE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_']*"), re.compile(r"'[sS]\Z")


def _ascii_words(word: str) -> list[str]:
    """The words in a piece of ASCII text, without possessive 's and pure numbers."""
    words = [_POSSESSIVE.sub("", w) for w in _ASCII_WORD.findall(word)]
    return [w for w in words if not w.isdigit()]


def _label_words(df: DataFrame) -> DataFrame:
    """(label, found, plain): `clean` where it is ASCII (`plain`), of any other text its words, without possessive 's and pure numbers, joined by spaces."""
    text = F.make_valid_utf8("clean")
    plain = F.octet_length(text) == F.length(text)
    listed = F.filter(F.transform(_found_words(F.col("clean")), _bare_word), _is_word)
    return df.select("label", F.when(plain, text).otherwise(F.array_join(listed, " ")).alias("found"), F.coalesce(plain, F.lit(False)).alias("plain"))


def _count_by_label(df: DataFrame, item: str, neighbours: bool, words: Sequence[str]) -> DataFrame:
    """(label, item, n) of the words, or the pairs of neighbours, that are no stopwords; a row per label, item and some megabytes of text."""
    dropped, most = sorted(words), COUNT_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, known, n, pairs in counted_words(batches, _ascii_words, dropped, most, neighbours):
            names = known
            if neighbours:
                first, second, n = pairs
                names = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), pa.scalar(" ", known.type))
            yield pa.RecordBatch.from_arrays(
                [label.take(pa.array(np.zeros(len(names), np.int64))), names.cast(pa.string()), pa.array(n)], names=["label", item, "n"])

    kind = df.schema["label"].dataType.simpleString()
    return _label_words(df).mapInArrow(count, f"label {kind}, {item} string, n bigint")


def term_counts_by_label(df: DataFrame, words: Sequence[str] = stoplists.ENGLISH) -> DataFrame:
    """(label, base, term, n) of the words of `clean` that are no stopwords."""
    return _merge_plurals(_count_by_label(df, "term", False, words), "term")


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms per label, relative to the most frequent one."""
    order = Window.partitionBy("label").orderBy(F.desc("n"), "term")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    peak = F.max("n").over(Window.partitionBy("label"))
    return top.select("label", "term", "n", (F.col("n") / peak).alias("relative"))


def term_frequency_by_label(df: DataFrame, k: int = CLOUD_WORDS,
                            words: Sequence[str] = stoplists.ENGLISH) -> DataFrame:
    """Single words of each class with count and relative frequency, the top k."""
    return _ranked(term_counts_by_label(df, words).select("label", "term", "n"), k)


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    floor = F.lit(PROBABILITY_FLOOR)
    return F.log(F.greatest(p, floor)) * k + F.log(F.greatest(1 - p, floor)) * (n - k)


def phrase_association(c12: Column, c1: Column, c2: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair; 0 where a word makes up the whole text."""
    p, p1 = c2 / total, F.try_divide(c12, c1)
    p2 = F.try_divide(c2 - c12, total - c1)
    ratio = (
        _log_likelihood(c12, c1, p) + _log_likelihood(c2 - c12, total - c1, p)
        - _log_likelihood(c12, c1, p1) - _log_likelihood(c2 - c12, total - c1, p2)
    )
    return F.when((total <= c1) | (total <= c2), F.lit(0.0)).otherwise(-2 * ratio)


def _may_pass(threshold: float):
    """Function from counts to the pairs whose score may be over the threshold: `phrase_association` but for its last digits."""
    def keep(c12: np.ndarray, c1: np.ndarray, c2: np.ndarray, total: int) -> np.ndarray:
        def log_likelihood(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.log(np.maximum(p, PROBABILITY_FLOOR)) * k + np.log(np.maximum(1 - p, PROBABILITY_FLOOR)) * (n - k)

        with np.errstate(all="ignore"):
            p, p1, p2 = c2 / total, c12 / c1, (c2 - c12) / (total - c1)
            ratio = (log_likelihood(c12, c1, p) + log_likelihood(c2 - c12, total - c1, p)
                     - log_likelihood(c12, c1, p1) - log_likelihood(c2 - c12, total - c1, p2))
        whole = (total <= c1) | (total <= c2)
        return whole | ~(-2 * ratio < threshold - 1e-3 - 1e-9 * total)

    return keep


def _phrases(df: DataFrame, threshold: float, words: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(label, term, n) of the words, and (label, phrase, word_1, word_2, c12, c1, c2, score) of the phrases over the threshold.

    Each text is cut into words once, for both. A word is counted under its base, and so is the second word of a phrase, as in `_merge_plurals`:
    for a phrase's ending is that of its second word.
    """
    blocks = stage_table(phrase_blocks(_label_words(df), _ascii_words, sorted(words)), "phrase-blocks")
    bases, bound = numbered(stage_table(counted_bases(blocks), "unigrams"))
    totals = stage_table(bases.groupBy("label").agg(F.sum("total").alias("total")), "totals")
    pairs = counted_pairs(block_pairs(blocks).join(totals, "label"), bases, bound, _may_pass(threshold))
    score = phrase_association(F.col("c12"), F.col("c1"), F.col("c2"), F.col("total"))
    strong = pairs.withColumn("score", score).filter(F.col("score") > threshold)
    unigrams = base_rows(bases)
    first = unigrams.select(F.col("id").alias("id_1"), "label", F.col("base").alias("base_1"), F.col("term").alias("word_1"))
    second = unigrams.select(F.col("id").alias("id_2"), F.col("base").alias("base_2"), F.col("term").alias("word_2"))
    phrase = F.concat("base_1", F.when(F.col("plural"), "s").otherwise(""), F.lit(" "), "base_2", F.when(F.col("singular"), "").otherwise("s"))
    named = strong.join(first, "id_1").join(second, "id_2").select(
        "label", phrase.alias("phrase"), "word_1", "word_2", "c12", "c1", "c2", "score")
    return unigrams.select("label", "term", "n"), named


def bigram_collocations(df: DataFrame, threshold: float = COLLOCATION_THRESHOLD,
                        words: Sequence[str] = stoplists.ENGLISH) -> DataFrame:
    """(label, phrase, n, c1, c2, score) of strongly associated neighbouring words."""
    return _phrases(df, threshold, words)[1].select("label", "phrase", F.col("c12").alias("n"), "c1", "c2", "score")


def word_cloud(df: DataFrame, k: int = CLOUD_WORDS, threshold: float = COLLOCATION_THRESHOLD,
               words: Sequence[str] = stoplists.ENGLISH) -> DataFrame:
    """Words and phrases together: an accepted phrase is taken off the counts of its two words."""
    unigrams, phrases = _phrases(df, threshold, words)
    accepted = stage_table(phrases, "phrases")
    changes = accepted.select("label", F.inline(F.array(
        F.struct(F.col("phrase").alias("term"), F.col("c12").alias("n")),
        F.struct(F.col("word_1").alias("term"), (-F.col("c12")).alias("n")),
        F.struct(F.col("word_2").alias("term"), (-F.col("c12")).alias("n")),
    )))
    merged = unigrams.unionByName(changes)
    return _ranked(merged.groupBy("label", "term").agg(F.sum("n").alias("n")).filter("n > 0"), k)


def distinct_words(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, term): the different whitespace-separated words of `clean` per document."""
    split = tx.non_empty(F.split("clean", f"[{tx.SPACE}]+"))
    return unnest(df, F.array_distinct(split), "term", *keys)


def _label_terms(df: DataFrame) -> DataFrame:
    """(label, term): the different whitespace-separated words of `clean` by label."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("clean"), COUNT_BYTES):
                labels, label = label_codes(batch.column("label").slice(at, len(texts)))
                at += len(texts)
                words, begins = cut_at_white_space(texts)
                coded = words.dictionary_encode()
                size = max(len(coded.dictionary), 1)
                cells = np.unique(label[row_of(begins)] * size + coded.indices.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [labels.take(pa.array(cells // size)), coded.dictionary.take(pa.array(cells % size)).cast(pa.string())],
                    names=["label", "term"])

    kind = df.schema["label"].dataType.simpleString()
    return df.select("label", F.make_valid_utf8("clean").alias("clean")).mapInArrow(distinct, f"label {kind}, term string").distinct()


def class_words(df: DataFrame) -> DataFrame:
    """(term, labels): each word with the sorted classes whose texts hold it."""
    return _label_terms(df).groupBy("term").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def class_vocab_overlap(inputs: DataFrame, training: DataFrame, show: int = 5,
                        id_col: str = "doc_id") -> DataFrame:
    """Per input text and class: number of its words known in that class, and the first few.

    `training` has label and clean. The class words form one row per word, so a frequent word
    meets a single partner, whatever its number of occurrences. At most `show` words of a text and class are collected.
    """
    matched = distinct_words(inputs, id_col).join(class_words(training), "term")
    pairs = matched.select(id_col, "term", F.explode("labels").alias("label"))
    mine = Window.partitionBy(id_col, "label")
    ranked = pairs.withColumns({
        "_place": F.row_number().over(mine.orderBy("term")), "_n": F.count("*").over(mine)})
    return ranked.filter(F.col("_place") <= show).groupBy(id_col, "label").agg(
        F.max("_n").alias("n_common"), F.array_join(F.sort_array(F.collect_list("term")), ", ").alias("words"))


def word_intersection(inputs: DataFrame, training: DataFrame) -> DataFrame:
    """Words that occur both in the inputs and in a class: (label, term)."""
    known = _label_terms(training)
    return known.join(distinct_words(inputs).distinct(), "term", "left_semi").select("label", "term")


def preview(df: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def random_sample(df: DataFrame, n: int = 1, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """n rows picked by a seeded hash of the key: the same rows on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)
