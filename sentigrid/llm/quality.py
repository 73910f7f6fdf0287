"""Quality rules: word statistics and compression bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import WHITE, text_of

SYMBOLS = "#*$%&|<>"
LEVEL = 3
CHUNK = 4096
# (bytes up to, least ratio, largest ratio) of the compressed size to the size: short texts carry the frame's own bytes,
# so they have no upper limit; long ones find more to refer back to. Prose of any script stays below the upper limits,
# base64 and other noise in text form (0.75 and more) does not.
BANDS = ((128, 0.0, np.inf), (256, 0.30, np.inf), (1024, 0.28, 0.85), (4096, 0.25, 0.75),
         (16384, 0.22, 0.70), (np.inf, 0.20, 0.68))
CHUNK_BAND = (0.20, 0.72)
# A text goes if at least this share of its chunks lies outside CHUNK_BAND.
CHUNK_SHARE = 0.5
MIN_WORDS = 50

FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "n_bytes bigint, ratio double, n_chunks bigint, n_bad_chunks bigint, base_failed boolean, kept boolean")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which occurs at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # pairs get a dense number first, so that the window's number fits for a text of any length
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[which] > 1)
    mark = np.zeros(len(words), bool)
    for shift in range(3):
        mark[start + shift] = True
    return int(mark.sum())


def chunk_starts(n: int) -> list[int]:
    """Starts of the chunks of a text of n bytes: one after the other, the last one ending with the text.

    A text shorter than a chunk has none: its band as a whole says the same.
    """
    starts = list(range(0, n - CHUNK + 1, CHUNK))
    return starts + [n - CHUNK] if starts and n % CHUNK else starts


def in_band(n: int, ratio: float) -> bool:
    low, high = next((lo, hi) for upto, lo, hi in BANDS if n <= upto)
    return low <= ratio <= high


def measure(text: str, packer: zstandard.ZstdCompressor) -> tuple:
    words = text.encode().split()
    n = len(words)
    worded = [x for x in text.split("\n") if x.strip(WHITE)]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    raw = text.encode()
    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    starts = chunk_starts(len(raw))
    chunks, bad = len(starts), 0
    for start in starts:
        part = len(packer.compress(raw[start:start + CHUNK])) / CHUNK
        bad += not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
    good = bool(raw) and in_band(len(raw), ratio) and (not chunks or bad < CHUNK_SHARE * chunks)
    return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            len(worded) - len(set(worded)), repeats, len(raw), ratio, chunks, bad, failed, good and not failed)


def _measured(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pd.DataFrame([measure(t, packer) for t in texts], columns=names)

    # a filter on the verdict would otherwise run the function a second time
    return F.pandas_udf(run, FIELDS).asNondeterministic()(text)


def quality_metrics(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """Every row of `docs` with a struct `into` of word statistics, compression figures and the verdict `kept`.

    The zstandard ratio of the whole text must lie in the band of its length: below it the text repeats
    itself, above it is noise. Each 4,096-byte chunk has a band too, the last one reaching back from the end of the text,
    and half of them outside it are enough: no text can hide a junk half behind a good one. `base_failed` holds for texts of fewer than 50 words or
    with over half their words in repeated 3-word windows.

    A null text counts as empty: no words, ratio 0, not kept. Repeated rows are judged alike, one by one; an empty table
    stays empty; all other columns stay as they are, and a column named like `into` is replaced.
    """
    return docs.withColumn(into, _measured(text_of(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of `docs`."""
    mark = "_quality"
    while mark in docs.columns:
        mark += "_"
    return quality_metrics(docs, text_col, mark).filter(F.col(f"{mark}.kept")).drop(mark)
