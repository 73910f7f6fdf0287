"""Labels from a lexicon table of any size.

Each term is indexed by its rarest q-gram in the corpus. A text's different q-grams meet the index by equality, and
the few candidates are verified with contains(). Terms shorter than a q-gram are indexed as a whole. The result is
the same as that of the literal lexicon in `functions.lexicon`. A table of at most IN_ROW rows needs no index: its terms go to
the tasks, which look for all of them in a text at once, and no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.functions.lexicon import label_of
from sentigrid.functions.words import term_positions
from sentigrid.operators.word_tables import meet, repeated_keys
from sentigrid.session import stage_table, unnest

GRAM = 3
# rows of a lexicon that go to the tasks as a whole
IN_ROW = 50_000


def grams(text: Column, size: int = GRAM) -> Column:
    """The different runs of `size` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def normal_lexicon(table: DataFrame) -> DataFrame:
    """(term, polarity, weight): lower-cased, one row per term and side; empty and null terms are left out."""
    rows = table.select(F.lower("term").alias("term"), "polarity", "weight").filter("length(term) > 0")
    return rows.groupBy("term", "polarity").agg(F.sum("weight").alias("weight"))


def matches(df: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, term, polarity, weight) for every term of the (term, polarity, weight) table that a text contains.

    Texts are compared lower-cased; a null text contains nothing. The key has to be unique.
    """
    lexicon = stage_table(normal_lexicon(table), "lexicon")
    if lexicon.limit(IN_ROW + 1).count() > IN_ROW:
        return _matches_by_index(df, lexicon, id_col, text_col)
    once, again = repeated_keys(df.select(id_col, text_col), id_col)
    found = _matches_in_row(once, lexicon, id_col, text_col)
    return found if again is None else found.unionByName(_matches_by_index(again, lexicon, id_col, text_col))


def _matches_in_row(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The matches of texts with different keys, text by text; a null key meets nothing."""
    terms = sorted(r[0] for r in lexicon.select("term").distinct().collect())
    place = {t: i for i, t in enumerate(terms)}
    entries = [(place[r.term], r.term, r.polarity, r.weight) for r in lexicon.collect()]
    kinds = {f.name: f.dataType.simpleString() for f in lexicon.schema.fields}
    named = df.sparkSession.createDataFrame(
        entries, f"_place int, term string, polarity {kinds['polarity']}, weight {kinds['weight']}")
    hits = term_positions(F.lower(F.col(text_col)), terms)
    places = unnest(df.filter(F.col(id_col).isNotNull()).select(id_col, hits.alias("_hits")), F.col("_hits"), "_place", id_col)
    return places.join(F.broadcast(named), "_place").select(id_col, "term", "polarity", "weight")


def _matches_by_index(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The matches with a lexicon of any size, through the rarest q-grams."""
    terms = lexicon.select("term").distinct()
    short = sorted(r[0] for r in terms.filter(F.length("term") < GRAM).select(F.length("term")).distinct().collect())
    whole = F.when(F.length("term") < GRAM, F.array("term")).otherwise(grams(F.col("term")))
    term_grams = stage_table(terms.select("term", F.explode(whole).alias("gram")), "term-grams")

    texts = df.select(id_col, F.lower(F.col(text_col)).alias("_text"))
    parts = F.flatten(F.array(*[grams(F.col("_text"), n) for n in (*short, GRAM)]))
    seen = unnest(texts.select(id_col, parts.alias("_grams")), F.col("_grams"), "gram", id_col)
    seen = stage_table(seen.join(term_grams.select("gram").distinct(), "gram", "left_semi"), "text-grams")

    frequency = seen.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = term_grams.join(frequency, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    # a term with a q-gram that no text has is in no text
    index = stage_table(rarest.filter("least.n > 0").select(F.col("least.gram").alias("gram"), "term"), "term-index")
    candidates = meet(seen, index, "gram", "inner").select(id_col, "term")
    held = candidates.join(texts, id_col).filter(F.col("_text").contains(F.col("term"))).select(id_col, "term")
    return held.join(lexicon, "term").select(id_col, "term", "polarity", "weight")


def label_by_table(df: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, positive_score, negative_score, label) of every text."""
    found = matches(df, table, id_col, text_col)
    sides = [F.sum(F.when(F.col("polarity") == s, F.col("weight")).otherwise(0)).alias(f"{s}_score")
             for s in ("positive", "negative")]
    scores = df.select(id_col).join(found.groupBy(id_col).agg(*sides), id_col, "left").na.fill(
        0, ["positive_score", "negative_score"])
    return scores.withColumn("label", label_of(F.col("positive_score"), F.col("negative_score")))
