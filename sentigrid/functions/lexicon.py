"""Weak labels from a weighted keyword lexicon.

A term counts once per text when it occurs anywhere in the lower-cased text, inside words
too. The larger side wins, a tie is neutral.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.config import MAX_WORD_LIST
from sentigrid.functions.words import term_positions

# --- fixed values: keyword lists (an entry given twice weighs two) ---------------------
COMPACT_NEGATIVE = [
    "#indonesiagelap", "#indonesiagelap2025", "#kaburajadulu", "#peringatandarurat",
    "buruk", "jelek", "kecewa", "marah", "benci", "sedih", "susah", "sulit",
    "gagal", "rusak", "hancur", "parah", "mengerikan", "tidak suka", "bosan",
]
COMPACT_POSITIVE = [
    "#positif", "#bahagia", "#sukses", "#syukur", "suka", "senang", "bagus",
    "hebat", "mantap", "keren", "amazing", "wonderful", "excellent", "good",
    "baik", "indah", "cantik", "ganteng", "love", "cinta", "sayang", "happy",
    "terima kasih", "thanks", "grateful", "puas", "berhasil", "menang",
]
EXTENDED_NEGATIVE = [
    "#indonesiagelap", "#indonesiagelap2025", "#kaburajadulu", "#peringatandarurat",
    "buruk", "jelek", "kecewa", "marah", "benci", "sedih", "susah", "sulit",
    "gagal", "rusak", "hancur", "parah", "mengerikan", "tidak suka", "bosan",
    "terrible", "awful", "bad", "worst", "hate", "angry", "disappointed", "sad",
    "difficult", "hard", "broken", "failed", "disaster", "horrible", "disgusting",
    "annoying", "frustrated", "upset", "worried", "scared", "afraid", "terrible",
    "jeburuk", "payah", "ampas", "zonk", "kecewa", "sebel", "kesel", "jengkel",
]
EXTENDED_POSITIVE = [
    "#positif", "#bahagia", "#sukses", "#syukur", "#blessed", "#happy", "#love",
    "suka", "senang", "bagus", "hebat", "mantap", "keren", "amazing", "wonderful",
    "excellent", "good", "baik", "indah", "cantik", "ganteng", "love", "cinta",
    "sayang", "happy", "terima kasih", "thanks", "grateful", "puas", "berhasil", "menang",
    "great", "awesome", "fantastic", "brilliant", "perfect", "beautiful", "nice",
    "super", "outstanding", "magnificent", "marvelous", "incredible", "impressive",
    "satisfied", "pleased", "delighted", "thrilled", "excited", "joyful", "cheerful",
    "oke", "okeh", "mantul", "kece", "asik", "asyik", "top", "joss", "juara",
    "recommended", "recommend", "worthit", "worth it", "terbaik", "terbagus",
]
# --- end of fixed values ----------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """Distinct terms with polarity ('positive' or 'negative') and weight."""

    entries: tuple[tuple[str, str, int], ...]

    def __post_init__(self) -> None:
        if len(self.entries) > MAX_WORD_LIST:
            raise ValueError(f"a lexicon holds at most {MAX_WORD_LIST} terms")
        if any(not term for term, _, _ in self.entries):
            raise ValueError("a lexicon term may not be empty")

    @classmethod
    def of(cls, positive: list[str], negative: list[str]) -> "Lexicon":
        sides = (("positive", positive), ("negative", negative))
        return cls(tuple((t.lower(), side, n) for side, ts in sides for t, n in Counter(ts).items()))

    @classmethod
    def from_table(cls, table: DataFrame) -> "Lexicon":
        """From a (term, polarity, weight) table; one larger than the bound is refused."""
        rows = table.select("term", "polarity", "weight").limit(MAX_WORD_LIST + 1).collect()
        return cls(tuple((r.term.lower(), r.polarity, int(r.weight)) for r in rows))

    def side(self, polarity: str) -> list[tuple[str, int]]:
        return [(t, w) for t, p, w in self.entries if p == polarity]

    def as_array(self) -> Column:
        """The entries as one constant array<struct<term, polarity, weight>>."""
        return F.array(*[
            F.struct(F.lit(t).alias("term"), F.lit(p).alias("polarity"), F.lit(w).alias("weight"))
            for t, p, w in self.entries
        ])


COMPACT = Lexicon.of(COMPACT_POSITIVE, COMPACT_NEGATIVE)
EXTENDED = Lexicon.of(EXTENDED_POSITIVE, EXTENDED_NEGATIVE)


def hit_positions(lowered: Column, lexicon: Lexicon, engine: str = "builtin") -> Column:
    """Positions (in lexicon order) of the terms that occur in `lowered`, as array<int>.

    engine 'words' looks the parts of each different word up once, in Arrow batches; 'builtin' tests each term with
    contains(), in the JVM; 'automaton' walks each text once and needs a package on the executors. All give the same array.
    """
    terms = [term for term, _, _ in lexicon.entries]
    if engine == "builtin":
        # plain tests, so that they are compiled; a lambda over the terms would be interpreted
        return F.array_compact(F.array(*[F.when(lowered.contains(t), i) for i, t in enumerate(terms)]))
    if engine == "words":
        return term_positions(lowered, terms)
    if engine != "automaton":
        raise ValueError("engine is 'words', 'automaton' or 'builtin'")
    return _automaton_udf(terms)(lowered)


def _automaton_udf(terms: list[str]):
    @F.pandas_udf("array<int>")
    def find_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        positions: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            positions.setdefault(term, []).append(i)
        machine = ahocorasick.Automaton()
        for term, where in positions.items():
            machine.add_word(term, where)
        machine.make_automaton()
        for batch in batches:
            yield pd.Series([
                [] if text is None else sorted({i for _, where in machine.iter(text) for i in where})
                for text in batch
            ], dtype=object)

    return find_terms


def side_score(hits: Column, lexicon: Lexicon, polarity: str) -> Column:
    """Sum of the weights of the hit terms of one polarity."""
    weights = F.array(*[F.lit(w if p == polarity else 0) for _, p, w in lexicon.entries])
    return F.aggregate(hits, F.lit(0), lambda total, i: total + F.get(weights, i))


def side_terms(hits: Column, lexicon: Lexicon, polarity: str) -> Column:
    """The hit terms of one polarity in lexicon order; a term of weight n stands n times."""
    entries = F.array(*[
        F.array_repeat(F.lit(t), w if p == polarity else 0) for t, p, w in lexicon.entries
    ])
    return F.flatten(F.transform(hits, lambda i: F.get(entries, i)))


def contained_terms(lowered: Column, lexicon: Lexicon, polarity: str) -> Column:
    """As `side_terms`, straight from the text by compiled contains() tests."""
    tests = [F.when(lowered.contains(t), t) for t, w in lexicon.side(polarity) for _ in range(w)]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def label_of(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive > negative, "positive")
        .when(negative > positive, "negative")
        .otherwise("neutral")
    )


def contains_score(lowered: Column, lexicon: Lexicon, polarity: str) -> Column:
    """Score of one side as a plain sum of contains() tests, for use in any expression."""
    tests = [F.when(lowered.contains(t), w).otherwise(0) for t, w in lexicon.side(polarity)]
    return F.coalesce(reduce(lambda a, b: a + b, tests, F.lit(0)), F.lit(0))


def with_scores(df: DataFrame, lexicon: Lexicon = EXTENDED, text_col: str = "text",
                engine: str = "builtin") -> DataFrame:
    """Adds `positive_score` and `negative_score`."""
    if engine == "builtin":
        lowered = df.withColumn("_lowered", F.lower(F.col(text_col)))
        return lowered.withColumns({
            f"{side}_score": contains_score(F.col("_lowered"), lexicon, side) for side in ("positive", "negative")
        }).drop("_lowered")
    terms = [term for term, _, _ in lexicon.entries]
    if engine == "words" and all(t.isascii() for t in terms):
        hits = term_positions(F.col(text_col), terms, fold=True)
    else:
        hits = hit_positions(F.lower(F.col(text_col)), lexicon, engine)
    return (
        df.withColumn("hits", hits)
        .withColumn("positive_score", side_score(F.col("hits"), lexicon, "positive"))
        .withColumn("negative_score", side_score(F.col("hits"), lexicon, "negative"))
        .drop("hits")
    )


def with_label(df: DataFrame, lexicon: Lexicon = EXTENDED, text_col: str = "text",
               engine: str = "words") -> DataFrame:
    """Adds `label`; blank and null text come out neutral because nothing is found in them."""
    scored = with_scores(df, lexicon, text_col, engine)
    return scored.withColumn("label", label_of(F.col("positive_score"), F.col("negative_score"))).drop(
        "positive_score", "negative_score"
    )
