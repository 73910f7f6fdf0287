"""Language identification by Bloom filters over character n-grams, one bit of a row per language.

A row of the filter is a bitmask of languages; an n-gram has HASHES rows, and the AND of their masks names all
languages that contain it at once. A text's n-grams are looked up together, the bits are counted per language, and
each count is corrected by the chance that the language's slice of the filter answers yes to a strange n-gram. The
largest corrected count decides.

N-grams of 2 to 4 characters are taken from runs of letters, lower-cased, with a blank at both ends. A language
contains an n-gram if its share among the language's n-grams of that length is at least LEAST_SHARE, which bounds a
slice's fill whatever the corpus, and at least FOREIGN of the highest share in any language, which keeps out what
quotations bring in. The filter has 2^LOG_ROWS rows of one byte per eight languages: its size depends on the number of
languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentigrid.session import stage_table

# labelled rows of a language that are read for its n-grams
FIT_ROWS = 5_000
LEAST_SHARE = 1e-4
FOREIGN = 1 / 16
ORDERS = (2, 3, 4)
LOG_ROWS = 18
HASHES = 3
# characters handled at once
PIECE = 1 << 19
# documents counted at once
GROUP = 256
UNKNOWN = "und"

_BLANK = 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = tuple(np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def held_out(doc_id: Column) -> Column:
    """Documents whose text is never learned from; a null key is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _stream(points: np.ndarray, owners: np.ndarray, open_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letters with one blank for each run of others; such a run at the start counts after an open word only."""
    letter = _letters()[points]
    before = np.concatenate(([open_word], letter[:-1]))
    keep = letter | before
    return np.where(letter, points, _BLANK)[keep].astype(np.uint64), owners[keep]


def _grams(points: np.ndarray, owners: np.ndarray, skip: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: the keys of the n-grams that end at `skip` or later, and the documents they belong to."""
    blank = points == _BLANK
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        inner = np.zeros(n, bool)
        key = np.full(n, order, np.uint64)
        for j in range(order):
            key = key * _STEP + points[j:j + n]
            if 0 < j < order - 1:
                inner |= blank[j:j + n]
        inner[:max(0, skip - order + 1)] = True
        whole = ~inner
        # the blank in front of a word belongs to the word's document
        yield order, key[whole], owners[1:1 + n][whole] if order > 1 else owners[:n][whole]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(stream, owners, skip) for groups of texts; a long text alone, piece by piece, with what reaches back."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PIECE:
            carry, tail = np.array([_BLANK], np.uint64), False
            for start in range(0, len(text), PIECE):
                points = _code_points(text[start:start + PIECE])
                kept, _ = _stream(points, np.zeros(len(points), np.int64), tail)
                stream = np.concatenate((carry, kept))
                yield stream, np.full(len(stream), i), len(carry)
                carry = stream[-(max(ORDERS) - 1):]
                tail = bool(_letters()[points[-1]])
            if tail:
                stream = np.append(carry, np.uint64(_BLANK))
                yield stream, np.full(len(stream), i), len(carry)
            continue
        group.append(i)
        size += len(text)
        if size > PIECE:
            yield _joined(texts, group)
            group, size = [], 0
    if group:
        yield _joined(texts, group)


def _joined(texts: list[str | None], group: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    parts = [_code_points(texts[i] + " ") for i in group]
    owners = np.repeat(group, [len(p) for p in parts])
    stream, owners = _stream(np.concatenate(parts), owners, False)
    return np.concatenate(([np.uint64(_BLANK)], stream)), np.concatenate((owners[:1], owners)), 0


def _rows(keys: np.ndarray) -> Iterator[np.ndarray]:
    mixed = keys ^ (keys >> np.uint64(29))
    for m in _SPREAD[:HASHES]:
        yield (mixed * m) >> np.uint64(64 - LOG_ROWS)


class LanguageFilter:
    """Learned languages, the filter's rows of bitmasks (rows x bytes), and the chance of a false yes per language."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        bits = np.unpackbits(masks, axis=1, bitorder="little")[:, :len(languages)]
        self.false_yes = bits.mean(axis=0) ** HASHES

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """The bitmask of languages of each n-gram."""
        found = None
        for rows in _rows(keys):
            mask = self.masks[rows]
            found = mask if found is None else found & mask
        return found

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        n = len(texts)
        seen = np.zeros(n, np.int64)
        yes = np.zeros((n, 8 * self.masks.shape[1]), np.int64)
        of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        for points, owners, skip in _blocks(texts):
            for _, keys, docs in _grams(points, owners, skip):
                found = self.contains(keys)
                seen += np.bincount(docs, minlength=n)
                for byte in range(found.shape[1]):
                    table = np.bincount(docs * 256 + found[:, byte], minlength=256 * n)
                    yes[:, 8 * byte:8 * byte + 8] += table.reshape(n, 256) @ of_byte
        counts = yes[:, :len(self.languages)]
        sure = np.maximum(0.0, (counts - seen[:, None] * self.false_yes) / (1 - self.false_yes + 1e-12))
        return [self._verdict(sure[i]) if seen[i] else (UNKNOWN, 0.0) for i in range(n)]

    def _verdict(self, sure: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        best = int(np.argmax(sure))  # the first of equals: languages are in order
        second = float(np.delete(sure, best).max(initial=0.0))
        total = float(sure[best]) + second
        return self.languages[best], float(sure[best]) / total if total else 0.0


def training_rows(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of the rows that are learned from: of each language the `fit_rows` of least hash."""
    able = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("at"))
    # a share of the hash range that holds somewhat more than wanted, so that few texts are moved
    share = F.least(F.lit(1.0), F.lit(1.5) * fit_rows / F.col("count") + F.lit(64.0) / F.col("count"))
    ends = able.groupBy("lang").count().select("lang", (share * 2.0 ** 64 - 2.0 ** 63).alias("end"))
    near = able.join(F.broadcast(ends), "lang").filter(F.col("at").cast("double") <= F.col("end"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    return near.withColumn("place", place).filter(F.col("place") <= fit_rows).select("lang", "text")


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over the rows, counted within each batch."""
    def run(batches):
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, mine in by_lang.items():
                for points, owners, skip in _blocks(mine):
                    for order, keys, _ in _grams(points, owners, skip):
                        grams, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), order, np.int32)),
                             pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "size", "gram", "n"])

    found = rows.mapInArrow(run, "lang string, size int, gram bigint, n bigint")
    return found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def contained_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram): the n-grams each language contains."""
    counts = stage_table(_gram_counts(rows), "gram-counts")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    top = F.max("share").over(Window.partitionBy("gram"))
    often = shares.withColumn("top", top).filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= F.col("top") * FOREIGN))
    return often.select("lang", "gram")


def fit_filter(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageFilter:
    """The filter learned from the rows with a language that are not held out.

    The masks are put together in the cluster, by a bitwise OR per row; only the filter itself reaches the driver.
    """
    contained = stage_table(contained_grams(training_rows(docs, fit_rows)), "grams")
    languages = sorted(r.lang for r in contained.select("lang").distinct().collect())
    masks = np.zeros((1 << LOG_ROWS, max(1, -(-len(languages) // 8))), np.uint8)
    numbers = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            langs, grams = batch.columns
            number = np.array([numbers[x] for x in langs.to_pylist()], np.int64)
            for rows in _rows(grams.to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.astype(np.int32)), pa.array((number // 8).astype(np.int32)),
                     pa.array((1 << (number % 8)).astype(np.int32))], names=["row", "byte", "bit"])

    if languages:
        bits = contained.mapInArrow(run, "row int, byte int, bit int").groupBy("row", "byte").agg(F.bit_or("bit").alias("mask"))
        found = bits.toArrow()
        masks[found["row"].to_numpy(), found["byte"].to_numpy()] = found["mask"].to_numpy()
    return LanguageFilter(languages, masks)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): every document with its language.

    Whole texts; a very long one is read piece by piece. A text that is null or has no letter is `und` with score 0.
    The score is the winner's corrected count against its own and the runner-up's; a text none of whose n-grams is
    known has the first language and score 0, as equal counts go to the first language by code point. Without any
    learned language all are `und`. Repeated rows are judged each; a null doc_id stays; an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.masks))

    def run(batches):
        judge = LanguageFilter(*shared.value).judge
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                ids, held, texts = batch.slice(start, GROUP).columns
                verdicts = judge(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array([v[0] for v in verdicts], pa.string()), pa.array([v[1] for v in verdicts], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`identify` by a filter fitted on the same table (doc_id, text, lang)."""
    return identify(docs, fit_filter(docs, fit_rows))
