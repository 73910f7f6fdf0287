"""Benchmark decontamination: word pairs as seeds, Smith-Waterman alignment as proof."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentigrid.llm.common import SLICE, _arrow_schema, list_column, map_rows, ragged, record_batch, text_of
from sentigrid.session import stage_table

# Hits of one passage lie at most so many words apart.
GAP = 48
MATCH, MISS, SKIP = 2, -1, -1
# An alignment counts from this share of the item's own score.
LEAST = 0.5
_FILTER_BITS = 23
_MEMO = 300_000
# bytes of text cut into words at once
_CUT_BYTES = 1 << 21
# no UTF-8 text has this byte
_MARK, _MARK_NUMBER = b"\xff", np.uint64(2**64 - 1)
# Letters, digits and all non-ASCII bytes stay; everything else parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SIGN = np.uint64(1 << 63)


class _Memo(dict):
    """Numbers of words; 0 for a word that is not in the table of the items' words, if there is one."""

    def __init__(self, table: np.ndarray | None = None):
        super().__init__()
        # as bytes: looked up word by word, without an array for each
        self.table = None if table is None else table.tobytes()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        if word == _MARK:
            value = self[word] = int(_MARK_NUMBER)
            return value
        value = xxh64_intdigest(word) or 1
        if self.table is not None:
            far = 64 - _FILTER_BITS
            if not (self.table[value >> far] and self.table[(value << _FILTER_BITS & 0xFFFFFFFFFFFFFFFF) >> far]):
                value = 0
        self[word] = value
        return value


def tokens(text: bytes, memo: _Memo) -> np.ndarray:
    """64-bit numbers of the lower-cased words."""
    words = text.translate(_TABLE).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of word pairs."""
    out = (left * np.uint64(0x9E3779B97F4A7C15) ^ right) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def pairs_needed(n: int, least: float) -> int:
    """How many of the n - 1 neighbour pairs of an item every accepted copy has, side by side or with one word between.

    Of a copy's steps from match to match, s need no edit, t insert one word, p leave out u >= p words of the item, the
    others insert two words or more. Its score is at most 2 + 2s + t + 2p - u, and s + t + p + u < n; so a
    score of 2 * least * n takes 1.5 s + 0.5 t >= 2 * least * n - (n + 3) / 2. At 0 or less pairs prove nothing.
    """
    return math.ceil((2 * least * n - (n + 3) / 2) / 1.5 - 1e-9)


def item_keys(ids: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Keys of an item and how many of them every accepted copy has: its neighbour pairs, or the words of a very short item."""
    need = pairs_needed(len(ids), least)
    if need > 0:
        return pairs(ids[:-1], ids[1:]), need
    return ids, max(1, math.ceil(least * len(ids) - 1e-9))


def text_keys(words: np.ndarray, owner: np.ndarray, with_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys that texts can share with an item, and the word each begins at.

    `words` are the words of several texts one after the other, 0 for those that no item has, `owner` the text of each.
    """
    keys, at = [], []
    for step in (1, 2):
        here = np.flatnonzero((words[:-step] != 0) & (words[step:] != 0) & (owner[:-step] == owner[step:]))
        keys.append(pairs(words[here], words[here + step]))
        at.append(here)
    if with_words:
        at.append(np.flatnonzero(words))
        keys.append(words[at[-1]])
    return np.concatenate(keys), np.concatenate(at)


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A fixed-size bit table with two bits for each key in `h`: at most 2^17 words of 64 bits reach the driver."""
    keys = keys.select(F.explode(F.array("h", F.call_function("shiftleft", F.col("h"), F.lit(_FILTER_BITS)))).alias("h"))
    cell = F.shiftrightunsigned("h", 64 - _FILTER_BITS)
    word = F.floor(cell / 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int"))
    rows = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for row in rows:
        table[row.w] = row.b
    return np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def _known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - _FILTER_BITS)
    at = np.flatnonzero(table[(h >> shift).astype(np.int64)])
    return at[table[((h[at] << np.uint64(_FILTER_BITS)) >> shift).astype(np.int64)]]


def _items(benchmark: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(no, item, words, keys, need): distinct items with the numbers of their words and keys."""
    memo = _Memo()

    def body(ids, texts):
        for i, t in zip(ids, texts):
            ids_ = tokens(t, memo)
            if len(ids_):
                keys, need = item_keys(ids_, least)
                yield i, _signed(ids_), _signed(keys), need

    picked = benchmark.select(F.col(id_col).cast("bigint").alias("item"), text_of(text_col).cast("binary").alias("t")).distinct()
    made = map_rows(picked, body, "item bigint, words array<bigint>, keys array<bigint>, need int")
    return made.withColumn("no", F.monotonically_increasing_id())


def _numbered(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc, words): the numbers of a document's words, 0 for those no item has; documents without the others leave no row.

    The only pass over the texts; texts are cut into words some megabytes at a time, with a mark between them that no text can hold.
    What is written is mostly zeros and few different numbers.
    """
    def cut(docs_: list, texts: list[bytes], memo: _Memo) -> Iterator[pa.RecordBatch]:
        words = (b" " + _MARK + b" ").join([t.translate(_TABLE) for t in texts]).split()
        numbers = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        marks = np.flatnonzero(numbers == _MARK_NUMBER)
        lengths = np.diff(np.concatenate(([-1], marks, [len(words)]))) - 1
        values = np.delete(numbers, marks)
        owner = np.repeat(np.arange(len(texts)), lengths)
        some = np.bincount(owner[values != 0], minlength=len(texts)) > 0
        ends = np.concatenate(([0], np.cumsum(lengths[some]))).astype(np.int32)
        if some.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, s in zip(docs_, some.tolist()) if s], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values[some[owner]].view(np.int64)))], names=["doc", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(table)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= _CUT_BYTES:
                    yield from cut(ids, texts, memo)
                    ids, texts, size = [], [], 0
            if ids:
                yield from cut(ids, texts, memo)

    return docs.mapInArrow(run, "doc bigint, words array<bigint>")


def _hits(words: pa.Array, table: np.ndarray, with_words: bool) -> tuple[np.ndarray, ...]:
    """(words, their texts, keys the table knows, their first words in order) of a list column of word numbers."""
    values, lengths = list_column(words)
    values, owner = values.view(np.uint64), np.repeat(np.arange(len(lengths)), lengths)
    keys, at = text_keys(values, owner, with_words)
    known = _known(keys, table)
    known = known[np.argsort(at[known], kind="stable")]
    return values, owner, keys[known], at[known]


def _frequencies(numbered: DataFrame, table: np.ndarray, with_words: bool) -> DataFrame:
    """(h, df) of the keys the table knows, over all documents; counts are combined in the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                _, owner, keys, at = _hits(batch.column(0).slice(start, SLICE), table, with_words)
                if not len(keys):
                    continue
                order = np.lexsort((owner[at], keys))
                h, text = keys[order], owner[at][order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
                found, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    part = numbered.select("words").mapInArrow(run, "h bigint, n bigint")
    return part.groupBy("h").agg(F.sum("n").alias("df"))


def _rare_seeds(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(h, no): the keys of each item without the need - 1 most frequent ones.

    An accepted copy has `need` keys of the item, so it has one of these; a key that is in no document meets nothing.
    """
    at = items.select("no", "need", F.size("keys").alias("n"), F.explode("keys").alias("h"))
    weighed = at.join(frequencies, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("no").orderBy("df", "h"))
    kept = weighed.withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - F.col("need") + 1) & (F.col("df") > 0))
    return kept.select("h", "no").distinct()


def _passages(numbered: DataFrame, table: np.ndarray, reach: int, with_words: bool) -> DataFrame:
    """(doc, start, words, hits): the surroundings of seed hits, as word numbers; documents without hits leave no row."""
    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                docs, words = (c.slice(begin, SLICE) for c in batch.columns)
                values, owner, keys, at = _hits(words, table, with_words)
                if not len(at):
                    continue
                text = owner[at]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > GAP) | (text[1:] != text[:-1]))))
                last = np.concatenate((first[1:], [len(at)])) - 1
                sizes = np.bincount(owner, minlength=len(docs))
                starts = np.cumsum(sizes) - sizes
                mine = text[first]
                lo = np.maximum(at[first] - reach, starts[mine])
                hi = np.minimum(at[last] + 1 + reach, starts[mine] + sizes[mine])
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(mine)), pa.array(lo - starts[mine]), lists(values[ragged(lo, hi - lo)], hi - lo),
                     lists(keys, last - first + 1)], names=["doc", "start", "words", "hits"])

    return numbered.mapInArrow(run, "doc bigint, start bigint, words array<bigint>, hits array<bigint>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and where it ends in the passage (exclusive)."""
    ramp = -SKIP * np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.where(passage == word, MATCH, MISS)
        fresh = np.maximum(np.maximum(row[:-1] + step, row[1:] + SKIP), 0)
        fresh = np.maximum.accumulate(fresh + ramp) - ramp  # gaps along the passage
        row[1:] = fresh
        top = int(fresh.argmax())
        if fresh[top] > best:
            best, end = int(fresh[top]), top + 1
    return best, end


def _with_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for a key of a row; two that meet by chance cost an alignment and lose nothing."""
    return pairs(row.astype(np.uint64) + np.uint64(1), keys)


def enough_keys(items: pa.Array, passages: pa.Array, least: float) -> np.ndarray:
    """Rows whose passage has as many keys of its item as every accepted copy has; all rows are tested together."""
    own, n = list_column(items)
    text, size = list_column(passages)
    own, text = own.view(np.uint64), text.view(np.uint64)
    item, row = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(size)), size)
    need = np.array([pairs_needed(int(k), least) for k in n])
    by_word = need <= 0
    need = np.where(by_word, np.maximum(1, np.ceil(least * n - 1e-9)), need)
    next_ = np.flatnonzero((item[:-1] == item[1:]) & ~by_word[item[:-1]])
    single = np.flatnonzero(by_word[item])
    wanted = np.concatenate((_with_row(pairs(own[next_], own[next_ + 1]), item[next_]), _with_row(own[single], item[single])))
    whose = np.concatenate((item[next_], item[single]))
    keys, at = text_keys(text, row, bool(by_word.any()))
    met = np.isin(wanted, _with_row(keys, row[at]))
    return np.flatnonzero(np.bincount(whose[met], minlength=len(n)) >= need)


def _aligned(pairs_: DataFrame, least: float) -> DataFrame:
    target = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"
    schema = _arrow_schema(pairs_.sparkSession.createDataFrame([], target).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                docs, items, starts, passages, owns = batch.slice(begin, SLICE).columns
                out = []
                for i in enough_keys(owns, passages, least).tolist():
                    a, b = (np.array(c[i].as_py(), np.int64) for c in (owns, passages))
                    score, end = align(a, b)
                    share = score / (MATCH * len(a))
                    if share >= least:
                        _, length = align(a[::-1], b[:end][::-1])
                        start = starts[i].as_py()
                        out.append((docs[i].as_py(), items[i].as_py(), share, start + end - length, start + end))
                if out:
                    yield record_batch(out, schema)

    return pairs_.mapInArrow(run, target)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold a copy of a benchmark item.

    One pass over the texts turns them into word numbers, 0 for words that no item has. Over these, the first pass counts
    in how many documents each pair of neighbour words of the items occurs, side by side or with one word between. A copy that the alignment accepts has a third of an item's pairs at least
    (`pairs_needed`), so all but the most frequent ones become seeds and no such copy is without a seed. The second pass
    cuts out the passages around seed hits, as wide as an accepted copy can be; these join the items by seed, and a
    Smith-Waterman alignment over words scores each pair: 2 for a match, -1 for an edit, as a share of the
    item's own score. From 0.5 on it is a leak, so edited, shortened and paraphrased copies count. One row per
    (document, item): the best alignment.

    What tasks get of the items is bit tables of fixed size; everything else is joined by equality, so items
    may be many. Items and documents without a word match nothing; null texts count as empty; repeated rows
    give one result row; null ids are kept as null. Empty tables give an empty result; other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc"), text_of(text_col).cast("binary").alias("t"))
    items = stage_table(_items(benchmark, item_id_col, item_text_col, least), "items")
    size = F.size("words")
    longest, with_words = items.agg(F.max(size), F.max(size == F.size("keys"))).first()
    # an accepted copy has at most n words of the item and 2 n (1 - least) inserted ones
    reach, with_words = math.ceil((longest or 0) * (3 - 2 * least)), bool(with_words)
    numbered = stage_table(_numbered(picked, _filter_of(items.select(F.explode("words").alias("h")))), "word-numbers")
    every = items.select(F.explode("keys").alias("h"))
    df = _frequencies(numbered, _filter_of(every), with_words)
    seeds = stage_table(_rare_seeds(items, df), "seeds")
    found = _passages(numbered, _filter_of(seeds), reach, with_words).withColumn("id", F.monotonically_increasing_id())
    found = stage_table(found, "passages")
    met = found.select("id", F.explode("hits").alias("h")).join(seeds, "h").select("id", "no").distinct()
    pairs_ = met.join(found.select("id", "doc", "start", "words"), "id")
    pairs_ = pairs_.join(items.select("no", "item", F.col("words").alias("own")), "no")
    scored = _aligned(pairs_.select("doc", "item", "start", "words", "own"), least)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    out = scored.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; rows of null id are judged together."""
    bad = leaks(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad["_leak"]), "left_anti")
