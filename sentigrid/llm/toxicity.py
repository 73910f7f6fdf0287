"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import SLICE, _arrow_schema, list_column, ragged, record_batch, text_of

BITS = 18
FACTORS = 8
# Labelled rows the machine is fitted on at most, half of them toxic at most: the bound that keeps
# the fit in one process. Chosen by a hash of the id.
FIT_ROWS = 8_000
EPOCHS = 6
# A small sample is gone through more often, for so many steps at least.
LEAST_STEPS = 400
BATCH = 64
RATE = 1.0
DECAY = 1e-4
LEAST_CHI2 = 11.0
# A pair of terms that is beyond chance although neither term is: there are some 10^8 pairs, so more is asked of one.
LEAST_PAIR_CHI2 = 45.0
PAIR_ROWS = 10
THRESHOLD = 0.7
_STRIP = b".,;:!?\"'()[]{}*#%&|$<>-_"
_MEMO = 200_000
# Lengths of the beginnings of a word that are terms of their own.
STEMS = (4, 5, 6, 7)


class _Slots(dict):
    """Hash slots of a word's terms, remembered: the word itself and its beginnings, which stand for its stem."""

    def __missing__(self, word: bytes) -> tuple:
        if len(self) >= _MEMO:
            self.clear()
        bare = word.strip(_STRIP)
        stem = bare.decode(errors="replace")
        terms = [bare] + [stem[:n].encode() + b"-" for n in STEMS if len(stem) >= n] if bare else []
        value = self[word] = tuple(zlib.crc32(t) & ((1 << BITS) - 1) for t in terms)
        return value


def features(text: bytes, slots: _Slots) -> np.ndarray:
    """Slots of the distinct lower-cased terms of a whole text."""
    found = set(chain.from_iterable(map(slots.__getitem__, set(text.lower().split()))))
    return np.fromiter(found, np.int64, len(found))


def word_slots(text: bytes, slots: _Slots) -> np.ndarray:
    """Slots of the distinct whole words of a text, without their beginnings."""
    found = {s[0] for s in map(slots.__getitem__, set(text.lower().split())) if s}
    return np.fromiter(found, np.int64, len(found))


def _pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of several rows in one array, and the row of each; an empty row has none."""
    sizes = [len(r) for r in rows]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return at, np.repeat(np.arange(len(rows)), sizes)


def margin(model: dict, at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Score before the sigmoid of each row, and its factor sums.

    Bias, weights of the terms, and the products of the factors of every pair of terms, by the square
    of their sum less the sum of their squares. Pair terms are averaged over the pairs, so long texts do not saturate.
    """
    v = model["v"][at]
    total = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v * v).sum(axis=1), n)
    size = np.maximum(np.bincount(row, minlength=n), 1)
    pairs = 0.5 * ((total ** 2).sum(axis=1) - squares) / size
    return model["b"] + np.bincount(row, model["w"][at], n) + pairs, total


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _chi2(a: np.ndarray, b: np.ndarray, toxic: float, n: int) -> np.ndarray:
    """Continuity-corrected chi-squared of what is in `a` toxic and `b` clean rows out of `toxic` and n - toxic."""
    c, d = toxic - a, n - toxic - b
    spread = (a + b) * (c + d) * toxic * (n - toxic)
    surplus = np.maximum(np.abs(a * d - b * c) - n / 2, 0)
    return np.where(spread > 0, n * surplus ** 2 / np.maximum(spread, 1), 0)


def alone(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chi-squared of each slot with the label, and the rows that have it."""
    at = np.concatenate([np.zeros(0, np.int64), *rows])
    y = np.repeat(labels, [len(r) for r in rows]) if rows else np.zeros(0)
    a, b = np.bincount(at, y, 1 << BITS), np.bincount(at, 1 - y, 1 << BITS)
    return _chi2(a, b, labels.sum(), len(labels)), a + b


def interacting(rows: list[np.ndarray], labels: np.ndarray, chi2: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slots of pairs that go with toxic rows beyond chance and beyond either of their terms.

    Such as an insult with a group mention, each neutral on its own. All pairs of terms that are neutral and in
    PAIR_ROWS rows at least are counted exactly, one term at a time with all its partners, so memory grows with the terms only.
    """
    n, toxic = len(labels), labels.sum()
    able = np.flatnonzero((chi2 < LEAST_CHI2) & (size >= PAIR_ROWS))
    out = np.zeros(1 << BITS, bool)
    if not len(able):
        return out
    place = np.full(1 << BITS, -1, np.int64)
    place[able] = np.arange(len(able))
    terms = [place[r][place[r] >= 0] for r in rows]
    lengths = np.array([len(t) for t in terms])
    starts, flat = np.cumsum(lengths) - lengths, np.concatenate(terms)
    # the rows of each term, clean ones first
    owner = np.repeat(np.arange(n), lengths)
    order = np.lexsort((labels[owner], flat))
    ends = np.searchsorted(flat[order], np.arange(len(able) + 1))
    own = chi2[able]
    # so many toxic rows has a pair that stands out even if no clean row holds it
    least = int(np.searchsorted(_chi2(np.arange(toxic + 1), np.zeros(int(toxic) + 1), toxic, n) >= LEAST_PAIR_CHI2, True))
    for a in range(len(able)):
        mine = owner[order[ends[a]:ends[a + 1]]]
        bad = labels[mine] == 1
        if bad.sum() < least:
            continue
        with_bad = np.bincount(flat[ragged(starts[mine[bad]], lengths[mine[bad]])], minlength=len(able))
        able_b = np.flatnonzero(with_bad >= least)
        able_b = able_b[able_b != a]
        if not len(able_b):
            continue
        good = mine[~bad]
        with_clean = np.bincount(flat[ragged(starts[good], lengths[good])], minlength=len(able))[able_b]
        found = _chi2(with_bad[able_b].astype(float), with_clean.astype(float), toxic, n)
        strong = able_b[found >= LEAST_PAIR_CHI2 + np.maximum(own[a], own[able_b])]
        if len(strong):
            out[able[strong]] = out[able[a]] = True
    return out


def informative(rows: list[np.ndarray], labels: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Slots that go with the label beyond chance, by themselves or, among whole words, together with a partner."""
    chi2, size = alone(rows, labels)
    return (chi2 >= LEAST_CHI2) | interacting(words, labels, chi2, size)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 0, toxic_share: float | None = None,
        words: list[np.ndarray] | None = None) -> dict:
    """Gradient descent on the log loss in small batches, over the informative slots; all others stay at zero.

    `toxic_share` is the share of toxic rows among all labelled ones: the rows of a sample that has another share are
    weighted by class, so that scores mean the same whatever the sample. `words` are the slots of the rows' whole
    words, whose pairs are looked at (all slots if not given).
    """
    toxic = labels.sum() / max(1, len(labels))
    known = toxic_share is not None and 0 < toxic < 1
    weight = np.where(labels == 1, toxic_share / toxic, (1 - toxic_share) / (1 - toxic)) if known else np.ones(len(labels))
    rng = np.random.default_rng(seed)
    slots = 1 << BITS
    keep = informative(rows, labels, rows if words is None else words)
    rows = [r[keep[r]] for r in rows]
    model = {"b": -2.0, "w": np.zeros(slots), "v": rng.normal(0, 0.01, (slots, FACTORS)) * keep[:, None], "keep": keep}
    batches = max(1, len(rows) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches)) if rows else 0):
        for part in np.array_split(rng.permutation(len(rows)), batches):
            n = len(part)
            at, row = _pack([rows[i] for i in part])
            z, total = margin(model, at, row, n)
            error = (sigmoid(z) - labels[part]) * weight[part]
            size = np.maximum(np.bincount(row, minlength=n), 1)
            used, where = np.unique(at, return_inverse=True)
            each = (error / size)[row][:, None] * (total[row] - model["v"][at])
            grad_w = np.bincount(where, error[row], len(used)) / n ** 0.5
            grad_v = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], axis=1) / n ** 0.5
            model["w"][used] -= RATE * (grad_w + DECAY * model["w"][used])
            model["v"][used] -= RATE * (grad_v + DECAY * model["v"][used])
            model["b"] -= RATE / 10 * float(error.mean())
    return model


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  fit_rows: int) -> DataFrame:
    """At most `fit_rows` labelled ids outside the held-out part, both classes, in hash order (ties by id)."""
    known = _known_labels(labels, id_col, label_col)
    order = F.xxhash64("_id")
    half = fit_rows // 2
    toxic = known.filter("y = 1").orderBy(order, "_id").limit(half)
    clean = known.filter("y = 0").orderBy(order, "_id").limit(fit_rows - half)
    chosen = toxic.unionByName(clean)
    joined = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("t")).join(chosen, F.col("id") == F.col("_id"))
    return joined.select("id", "t", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> dict:
    """The fitted machine. Texts become slots in the tasks; only slots of the bounded sample are gathered.

    Of an id with several texts one counts, the same on every run.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, fit_rows)
    target = "id bigint, y int, slots array<int>, words array<int>"
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], target).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            out = [(i.as_py(), y.as_py(), np.sort(features(t.as_py(), slots)).tolist(), np.sort(word_slots(t.as_py(), slots)).tolist())
                   for i, t, y in zip(*batch.columns)]
            if out:
                yield record_batch(out, schema)

    one = F.min(F.struct("slots", "words"))
    found = rows.mapInArrow(run, target).groupBy("id", "y").agg(one.alias("r")).select("id", "y", "r.slots", "r.words").toArrow()
    share = _known_labels(labels, id_col, label_col).agg(F.avg(F.col("y").cast("double"))).first()[0]
    # the same order whatever task was first
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    slots, words = (_rows_of(found[c], order) for c in ("slots", "words"))
    return fit(slots, found["y"].to_numpy()[order].astype(float), toxic_share=share, words=words)


def _rows_of(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    if not len(column):
        return []
    values, lengths = list_column(column.combine_chunks())
    parts = np.split(values.astype(np.int32), np.cumsum(lengths)[:-1])
    return [parts[i] for i in order]


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, in one pass over whole texts, no shuffle.

    A null or empty text gets the bias alone. Null ids count as not held out; repeated rows are scored alike; an
    empty table gives an empty result; other columns are ignored, clashing names included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32), "keep": model["keep"]})
    target = "doc_id bigint, held_out boolean, score double, predicted int"
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], target).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, known = _Slots(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = [features(t.as_py(), slots) for t in part.column(2)]
                at, row = _pack([r[known["keep"][r]] for r in rows])
                score = sigmoid(margin(known, at, row, len(rows))[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32))], schema=schema)

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"),
                         text_of(text_col).cast("binary").alias("t"))
    return picked.mapInArrow(run, target)
