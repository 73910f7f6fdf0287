"""TF-IDF features: term counts, vocabulary, weights.

`terms` is an array of terms per document, or one text with a space between terms (`functions.text.term_text`): that moves as one value
a document between the JVM and the Arrow batches and into staged tables, where an array moves as one a term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentigrid.config import MAX_VOCABULARY
from sentigrid.functions.text import feature_terms
from sentigrid.functions.words import chunks, cut_words, label_codes, release, row_of
from sentigrid.session import unnest_structs


def with_terms(df: DataFrame, clean_col: str = "clean") -> DataFrame:
    """Adds `terms`, the feature terms of a prepared text in order of appearance."""
    return df.withColumn("terms", feature_terms(F.col(clean_col)))


def with_term_counts(df: DataFrame, terms_col: str = "terms") -> DataFrame:
    """Adds `counts`, array<struct<term, tf>> sorted by term.

    Counts inside the row: the sorted terms are cut where the term changes. A document lies
    in one row, so counting it needs neither an explode nor a shuffle.
    """
    ordered = df.withColumn("_sorted", F.sort_array(terms_col))
    cut = ordered.withColumn("_starts", F.expr(
        "filter(if(size(_sorted) > 0, sequence(0, size(_sorted) - 1), array()),"
        "       i -> i = 0 OR get(_sorted, i) <> get(_sorted, i - 1))"
    ))
    return cut.withColumn("counts", F.expr(
        "transform(_starts, (a, i) -> struct(get(_sorted, a) AS term,"
        "          CAST(coalesce(get(_starts, i + 1), size(_sorted)) - a AS BIGINT) AS tf))"
    )).drop("_sorted", "_starts")


def tfidf_terms(df: DataFrame, *keep: str, clean_col: str = "clean") -> DataFrame:
    """Long term counts: the kept columns, term, tf."""
    counted = with_term_counts(with_terms(df.select(*keep, clean_col), clean_col))
    return unnest_structs(counted, F.col("counts"), *keep)


# bytes of terms that are counted at a time
COUNT_BYTES = 8 << 20


def _counted(terms: pa.Array, begins: np.ndarray) -> pa.RecordBatch:
    """(term, df, total_tf) of texts whose terms lie one after the other, each text's from its place in `begins` on."""
    coded, rows = terms.dictionary_encode(), row_of(begins)
    del terms
    codes, size = coded.indices.fill_null(0).to_numpy(zero_copy_only=False), len(coded.dictionary)
    if coded.indices.null_count:
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        codes, rows = codes[known], rows[known]
    rows *= size
    rows += codes
    rows.sort()  # np.unique of numbers alone hashes them, which takes ten times as long
    held = rows[np.diff(rows, prepend=-1) > 0] % max(size, 1)
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.cast(pa.string()), pa.array(np.bincount(held, minlength=size)), pa.array(np.bincount(codes, minlength=size))],
        names=["term", "df", "total_tf"])


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, total_tf) of the texts of each batch."""
    for batch in batches:
        column = batch.column(0)
        if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
            lists = column.cast(pa.list_(pa.string()))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield _counted(lists.flatten(), np.concatenate([[0], np.cumsum(lengths)]))
        else:
            for texts in chunks(column, COUNT_BYTES):
                yield _counted(*cut_words(texts))
    release()


def document_frequency(df: DataFrame) -> DataFrame:
    """Per term: number of documents with it (df) and of occurrences (total_tf).

    `df` has one array of terms per document, or one text of them. Both counts are taken batch by batch and combined, so the
    shuffle carries one row per distinct term and task, however frequent a term is.
    """
    counted = df.select("terms").mapInArrow(_counted_terms, "term string, df bigint, total_tf bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def vocabulary_table(df: DataFrame, max_features: int = 5000) -> DataFrame:
    """(term, term_idx, df, total_tf, idf) of the most frequent terms.

    Ties at the cut go by term. The limit is a distributed top-k; the numbering that follows
    sees at most `max_features` rows.
    """
    if not 1 <= max_features <= MAX_VOCABULARY:
        raise ValueError(f"max_features must lie between 1 and {MAX_VOCABULARY}")
    top = document_frequency(df).orderBy(F.desc("total_tf"), "term").limit(max_features)
    n_docs = df.agg(F.count("*")).scalar()
    rank = Window.orderBy(F.desc("total_tf"), "term")
    return top.select(
        "term",
        (F.row_number().over(rank) - 1).alias("term_idx"),
        "df",
        "total_tf",
        (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"),
    )


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: bounded by MAX_VOCABULARY, so it may sit on the driver.

    Terms are in alphabetical order, and the position is the index in the vectors; `ranks` are
    the positions by frequency.
    """

    terms: list[str]
    idf: list[float]
    ranks: list[int]

    @classmethod
    def from_table(cls, table: DataFrame) -> "Vocabulary":
        """From (term, term_idx, idf), where term_idx is the rank by frequency."""
        rows = table.select("term", "term_idx", "idf").limit(MAX_VOCABULARY + 1).collect()
        if len(rows) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} terms")
        rows.sort(key=lambda r: r.term)
        return cls([r.term for r in rows], [float(r.idf) for r in rows], [int(r.term_idx) for r in rows])

    @classmethod
    def fit(cls, df: DataFrame, max_features: int = 5000) -> "Vocabulary":
        """Fit on a frame with a `terms` column."""
        return cls.from_table(vocabulary_table(df, max_features))

    def table(self, df: DataFrame) -> DataFrame:
        """(term, position, term_idx, idf) as a table in the session of `df`."""
        rows = list(zip(self.terms, range(len(self.terms)), self.ranks, self.idf))
        return df.sparkSession.createDataFrame(rows, "term string, position int, term_idx int, idf double")

    def by_rank(self) -> list[str]:
        """The terms, most frequent first."""
        return [term for _, term in sorted(zip(self.ranks, self.terms))]

    def term_at(self, position: Column) -> Column:
        """The term of a vector index, looked up in a constant array (terms hold no space)."""
        return F.get(F.split(F.lit(" ".join(self.terms)), " "), position)

    @cached_property
    def stages(self) -> list:
        """Feature stages: counts of known terms, times idf, scaled to length one.

        All three work row by row in the JVM; unknown terms are dropped.
        """
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        return [
            CountVectorizerModel.from_vocabulary(self.terms, inputCol="terms", outputCol="tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="tf", outputCol="tfidf"),
            Normalizer(p=2.0, inputCol="tfidf", outputCol="features"),
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the vectors `tf` (counts) and `features` (weights)."""
        if isinstance(df.schema["terms"].dataType, T.StringType):
            both = df.withColumn("_vectors", _vectors(F.col("terms"), self.terms, self.idf))
            return both.withColumns({c: F.col(f"_vectors.{c}") for c in ("tf", "features")}).drop("_vectors")
        for stage in self.stages:
            df = stage.transform(df)
        return df.drop("tfidf")


def _vectors(terms: Column, known: list[str], idf: list[float]) -> Column:
    """struct<tf, features> of a text of terms, the numbers that `Vocabulary.stages` give for an array of them; a null has no terms."""
    if not known:
        raise ValueError("the vocabulary is empty")
    places, weights = pa.array(known, pa.large_string()), np.asarray(idf, dtype=np.float64)
    kind = T.StructType([T.StructField(c, VectorUDT()) for c in ("tf", "features")])

    def sparse(begins: np.ndarray, places: np.ndarray, values: np.ndarray) -> pa.StructArray:
        rows, ends = len(begins) - 1, pa.array(begins, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, len(known), np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values))],
            names=["type", "size", "indices", "values"])

    @F.arrow_udf(kind)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for texts in chunks(batch):
                words, begins = cut_words(texts)
                coded = words.dictionary_encode()
                found = pc.index_in(coded.dictionary, value_set=places).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                place = found[coded.indices.to_numpy(zero_copy_only=False)]
                row = row_of(begins)
                cells, tf = np.unique((row * len(known) + place)[place >= 0], return_counts=True)
                row, place, tf = cells // len(known), cells % len(known), tf.astype(np.float64)
                weight = tf * weights[place]
                # added up in order, so that the length is that of the JVM's loop
                length = np.sqrt(np.bincount(row, weight * weight, len(texts)))
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                parts.append(pa.StructArray.from_arrays(
                    [sparse(ends, place, tf), sparse(ends, place, weight / length[row])], names=["tf", "features"]))
            yield pa.concat_arrays(parts) if parts else _no_vectors

    return count(terms)


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
_no_vectors = pa.array([], pa.struct([("tf", _SPARSE), ("features", _SPARSE)]))


def long_features(df: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, position, tf, weight) of the vectors made by Vocabulary.transform."""
    parts = df.select(*keep, F.unwrap_udt("tf").alias("_t"), F.unwrap_udt("features").alias("_w"))
    cells = F.arrays_zip(
        F.col("_t.indices").alias("position"),
        F.col("_t.values").alias("tf"),
        F.col("_w.values").alias("weight"),
    )
    return unnest_structs(parts, cells, *keep)


def tfidf_transform(df: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """Long TF-IDF weights with their terms: (kept columns, term, tf, weight)."""
    long = long_features(vocabulary.transform(df), *keep)
    names = F.broadcast(vocabulary.table(df).select("term", "position"))
    return long.join(names, "position").select(*keep, "term", F.col("tf").cast("bigint").alias("tf"), "weight")


def top_features(df: DataFrame, vocabulary: Vocabulary, k: int = 10) -> DataFrame:
    """Adds `top`, array<struct<term, weight>> of the k heaviest terms, ties by term.

    Sorted inside the row: vector positions are alphabetical, so no lookup or shuffle is needed
    before the cut.
    """
    vector = df.withColumn("_w", F.unwrap_udt("features"))
    cells = vector.withColumn("_cells", F.arrays_zip(
        F.col("_w.indices").alias("position"), F.col("_w.values").alias("weight")))
    keyed = F.transform("_cells", lambda c: F.struct(
        (-F.round(c["weight"], 9)).alias("order"), c["position"].alias("position"), c["weight"].alias("weight")))
    best = cells.withColumn("_best", F.slice(F.sort_array(keyed), 1, k))
    return best.withColumn("top", F.transform("_best", lambda c: F.struct(
        vocabulary.term_at(c["position"]).alias("term"), c["weight"].alias("weight")))).drop("_w", "_cells", "_best")


def _summed_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, position, weight_sum) of the vectors of each batch."""
    for batch in batches:
        labels, label = label_codes(batch.column("label"))
        lengths = batch.column("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        position = batch.column("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(position):
            continue
        size = int(position.max()) + 1
        cells, which = np.unique(np.repeat(label, lengths) * size + position, return_inverse=True)
        sums = np.bincount(which, batch.column("values").flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [labels.take(pa.array(cells // size)), pa.array((cells % size).astype(np.int32)), pa.array(sums)],
            names=["label", "position", "weight_sum"])


def class_term_sums(df: DataFrame) -> DataFrame:
    """Sum of the weights per class and term: (label, position, weight_sum).

    Summed batch by batch, so the shuffle carries one row per class, term and batch at most.
    """
    vector = F.unwrap_udt("features")
    rows = df.select("label", vector["indices"].alias("indices"), vector["values"].alias("values"))
    kind = df.schema["label"].dataType.simpleString()
    partial = rows.mapInArrow(_summed_weights, f"label {kind}, position int, weight_sum double")
    return partial.groupBy("label", "position").agg(F.sum("weight_sum").alias("weight_sum"))
