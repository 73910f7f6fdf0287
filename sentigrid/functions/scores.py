"""Expressions on class scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentigrid.functions.binding import let

# Scores are compared to this many digits, so that sums taken in another order agree.
TIE_DIGITS = 9


def softmax(scores: Column) -> Column:
    """array<double> of scores to array<double> of probabilities."""
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(powers, lambda x: x / t))

    def powers(s: Column) -> Column:
        return let(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m)))

    return let(scores, lambda s: let(powers(s), shares))


def class_array(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def argmax_class(scores: Column, classes: list[str]) -> Column:
    """The class with the largest score, the first in class order on a tie."""
    rounded = F.transform(scores, lambda x: F.round(x, TIE_DIGITS))
    return F.get(class_array(classes), F.array_position(rounded, F.array_max(rounded)) - 1)


def probability_map(probabilities: Column, classes: list[str]) -> Column:
    return F.map_from_arrays(class_array(classes), probabilities)


def percent(share: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * share, digits)
