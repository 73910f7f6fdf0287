"""Counts of neighbouring words by blocks of texts.

A block is some megabytes of texts with one label: the list of its different words, their counts, and its different pairs as numbers into that
list. The lists are dealt out by a hash of the words' bases, so that each base's words meet in one place; there they are counted, and go back to the
blocks as numbers that hold for the whole table, with their counts. With these the pairs of a block are whole numbers; they too are dealt out by
a hash, so that no word's pairs lie together. All of it travels as packed arrays, a few for each block and task, and what is merged at a time is
a share of the words by the session's shuffle partitions, and of the pairs about PAIRS, however large the table.

A word's base is the word without the s of a plural (an s that follows no s), see `analysis`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.functions.words import Memo, chunks, coded_pieces, cut_words, label_codes, row_of

# bytes of text in a block, which a task holds at a time
BLOCK_BYTES = 8 << 20
# occurrences of pairs that are merged at a time, about
PAIRS = 2 << 20
# spreads keys over the groups that are merged
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LISTED = ["words string", "places binary", "n binary"]
_CODES = ["first", "second", "times"]
_KEYED = ["keys", "times", "c1", "c2"]
_PAIR = {"id_1": "bigint", "plural": "boolean", "id_2": "bigint", "singular": "boolean", "c12": "bigint", "c1": "bigint", "c2": "bigint", "total": "bigint"}


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(-1)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in pieces of about `most` bytes of `found`, however many a batch has."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for texts in chunks(batch.column("found"), most):
            held.append(batch.slice(at, len(texts)))
            at += len(texts)
            size += texts.nbytes
            if 2 * size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Small numbers as 16 bits, which are sorted fastest."""
    return values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values


def _different(cells: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones of numbers under `below`, of each number the place among these, and the counts."""
    if below > 4 * len(cells):
        return np.unique(cells, return_inverse=True, return_counts=True)
    counts = np.bincount(cells, minlength=below)
    held = np.flatnonzero(counts)
    return held, (np.cumsum(counts > 0) - 1)[cells], counts[held]


def counted_words(batches: Iterator[pa.RecordBatch], pieces: Callable[[str], list[str]], dropped: Sequence[str], most: int,
                  neighbours: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, tuple[np.ndarray, ...] | None]]:
    """(label, words, counts, pairs) of about `most` bytes of (label, found, plain) rows, by label, without the dropped words.

    The pairs of neighbours, if asked for: the places of the first and of the second words in `words`, in order, and the counts.
    """
    known_pieces = Memo(pieces)
    for rows in _gathered(batches, most):
        labels, label = label_codes(_whole(rows["label"]))
        known, codes, begins = coded_pieces(_whole(rows["found"]), rows["plain"].to_numpy(), known_pieces.__getitem__)
        row, size = row_of(begins), max(len(known), 1)
        kept = ~pc.is_in(known, value_set=pa.array(dropped, known.type)).to_numpy(zero_copy_only=False)[codes]
        cells = (label[row] * size + codes)[kept]
        held, place, counts = _different(cells, len(labels) * size)
        del codes, cells
        if neighbours:
            places = np.zeros(len(kept), np.int64)
            places[kept] = place
            near = np.flatnonzero(kept[:-1] & kept[1:] & (row[:-1] == row[1:]))
            del row, place
            pairs = places[near] * len(held)
            pairs += places[near + 1]
            del places, near
            pairs, times = np.unique(pairs, return_counts=True)
            first, second = np.divmod(pairs, max(len(held), 1))
        words = known.take(pa.array(held % size))
        del known
        begin = np.searchsorted(held, np.arange(len(labels) + 1) * size)
        for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
            if a == b:
                continue
            found = None
            if neighbours:
                own = slice(*np.searchsorted(first, [a, b]))
                found = first[own] - a, second[own] - a, times[own]
            yield labels.slice(i, 1), words.slice(a, b - a), counts[a:b], found


def _bases(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words' bases, and which words are plurals."""
    plural = pc.and_not(pc.ends_with(words, "s"), pc.ends_with(words, "ss"))
    return pc.if_else(plural, pc.utf8_slice_codeunits(words, 0, -1), words), plural.to_numpy(zero_copy_only=False)


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's bytes."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.uint64) if data else np.zeros(0, np.uint64)
    ends = ends - ends[0]
    lengths = np.diff(ends)
    powers = np.cumprod(np.full(lengths.max(initial=0), _MIX))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(ends[:-1], lengths)])])
    return _mixed(sums[ends[1:]] - sums[ends[:-1]])


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.uint64) * _MIX >> np.uint64(32)).astype(np.int64)


def _dealt(number: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different numbers, `order` by them, and where each one's places begin in that (one more than numbers)."""
    order = order[np.argsort(_narrow(number[order]), kind="stable")]
    different, begins = np.unique(number[order], return_index=True)
    return different, order, np.concatenate([begins, [len(order)]])


def phrase_blocks(df: DataFrame, pieces: Callable[[str], list[str]], dropped: Sequence[str]) -> DataFrame:
    """Blocks of (label, found, plain) rows, see `counted_words`: a row (block, label, first, second, times) with the pairs of each block, and
    rows (block, label, part, words, places, n) with its words by parts.

    A block's number depends on how the table was read, so the result has to be staged.
    """
    kind, parts, most = df.schema["label"].dataType.simpleString(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), BLOCK_BYTES
    columns = ["block bigint", f"label {kind}", "part bigint", *_LISTED, *(f"{c} binary" for c in _CODES)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for label, words, n, pairs in counted_words(batches, pieces, dropped, most, True):
            part, order, ends = _dealt(_hashes(_bases(words)[0]) % parts, np.arange(len(words)))
            size, lists = len(part), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(order)).cast(pa.string()))
            none = pa.nulls(1, pa.binary())
            values = [
                pa.array(np.full(size + 1, block)), label.take(pa.array(np.zeros(size + 1, np.int64))),
                pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(part)]),
                pa.concat_arrays([pa.nulls(1, pa.string()), pc.binary_join(lists, " ")]),
                *(pa.concat_arrays([none, pa.array([_packed(x) for x in _split(values[order], ends)], pa.binary())]) for values in (np.arange(len(words)), n)),
                *(pa.concat_arrays([pa.array([_packed(x)], pa.binary()), pa.nulls(size, pa.binary())]) for x in pairs)]
            yield pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in columns])
            block += 1

    return df.mapInArrow(cut, ", ".join(columns))


def _split(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, label, first, second, times) of `phrase_blocks`."""
    return blocks.filter(F.col("part").isNull()).select("block", "label", *_CODES)


def counted_bases(blocks: DataFrame) -> DataFrame:
    """A row for each label and part: its bases with their terms and counts (n), their number (size) and occurrences (total), and the words of the blocks as
    numbers, which are twice the place of the base and one more for a plural, with the counts of the bases.

    A base's term is the base where it occurs itself, else its plural. `place` has to be staged.
    """
    kind = blocks.schema["label"].dataType.simpleString()

    def count(rows: pa.Table) -> pa.Table:
        words, begins = cut_words(_whole(rows["words"]))
        n = np.concatenate([_unpacked(x.as_py()) for x in rows["n"]])
        bases, plural = _bases(words)
        coded = bases.dictionary_encode()
        known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.bincount(code, n, len(known)).astype(np.int64)
        single = np.bincount(code, n * ~plural, len(known)) > 0
        terms = pc.if_else(pa.array(single), known, pc.binary_join_element_wise(known, pa.scalar("s", known.type), pa.scalar("", known.type)))
        packed = [pa.array([_packed(x) for x in _split(values, begins)], pa.binary()) for values in (2 * code + plural, sums[code])]
        back = pa.StructArray.from_arrays([_whole(rows["block"]), _whole(rows["places"]), *packed], names=["of", "places", "codes", "c"])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                 for x in (known.cast(pa.string()), terms.cast(pa.string()), pa.array(sums), back)]
        return pa.Table.from_arrays(
            [_whole(rows["label"]).slice(0, 1), pa.array([len(known)]), pa.array([int(n.sum())]), *lists],
            names=["label", "size", "total", "bases", "terms", "n", "back"])

    listed = blocks.filter(F.col("part").isNotNull()).select("block", "label", "part", *(c.split()[0] for c in _LISTED))
    counted = listed.groupBy("label", "part").applyInArrow(
        count, f"label {kind}, size bigint, total bigint, bases array<string>, terms array<string>, n array<bigint>, "
               "back array<struct<of: bigint, places: binary, codes: binary, c: binary>>")
    return counted.withColumn("place", F.monotonically_increasing_id())


def numbered(bases: DataFrame) -> tuple[DataFrame, int]:
    """The staged rows of `counted_bases` with `start`, the number of the first base, and the number that all lie below. One row reaches the driver."""
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    tasks, rows, size = (x or 0 for x in bases.agg(F.max(task) + 1, F.max(row) + 1, F.max("size")).first())
    bound = max(tasks * rows * size, 1)
    if (2 * bound) ** 2 >= 1 << 63:
        raise ValueError("pairs of so many different words are beyond 64-bit keys")
    return bases.withColumn("start", (task * rows + row) * size), bound


def base_rows(bases: DataFrame) -> DataFrame:
    """(label, id, base, term, n) of the numbered bases."""
    listed = bases.select("label", "start", F.posexplode_outer(F.arrays_zip("bases", "terms", "n")).alias("at", "word"))
    return listed.select("label", (F.col("start") + F.col("at")).alias("id"), F.col("word.bases").alias("base"), F.col("word.terms").alias("term"),
                         F.col("word.n").alias("n"))


def counted_pairs(blocks: DataFrame, bases: DataFrame, bound: int, keep: Callable[..., np.ndarray]) -> DataFrame:
    """(id_1, plural, id_2, singular, c12, c1, c2, total): the different pairs of the whole table with their counts.

    `blocks` are those of `block_pairs` with their label's `total`, `bases` are numbered, below `bound`. A pair is the first word as it stands, `plural`
    or not, and the base of the second; `singular` says whether the second occurs as the base itself. `keep` says by (c12, c1, c2, total) which stay.
    """
    most = PAIRS

    def keyed(block: pa.Table, words: pa.Table) -> pa.Table:
        tasks, values = np.zeros(0, np.int64), []
        if block.num_rows and words.num_rows:
            at, c = (np.concatenate([_unpacked(x.as_py()) for x in words[y]]) for y in ("places", "c"))
            held = np.concatenate([2 * start.as_py() + _unpacked(x.as_py()) for start, x in zip(words["start"], words["codes"])])
            code, count = np.empty((2, len(at)), np.int64)
            code[at], count[at] = held, c
            first, second, times = (_unpacked(block[x][0].as_py()) for x in _CODES)
            keys = code[first] * (2 * bound) + code[second]
            tasks, order, ends = _dealt(_mixed(keys >> 1) % (block["total"][0].as_py() // most + 1), np.argsort(keys))
            values = [_split(x[order], ends) for x in (keys, times, count[first], count[second])]
        own = pa.array(np.zeros(len(tasks), np.int64))
        return pa.Table.from_arrays(
            [_whole(block["label"]).take(own), pa.array(tasks), _whole(block["total"]).take(own),
             *(pa.array([_packed(x) for x in parts], pa.binary()) for parts in values or [[]] * len(_KEYED))],
            names=["label", "task", "total", *_KEYED])

    def merged(parts: pa.Table) -> pa.Table:
        keys, times, c1, c2 = (np.concatenate([_unpacked(x.as_py()) for x in parts[c]]) for c in _KEYED)
        order = np.argsort(keys, kind="stable")
        both = keys[order] >> 1
        begins = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        first, second = np.divmod(both[begins], bound)
        one = order[begins]  # the singular comes before the plural
        total = parts["total"][0].as_py()
        c12, c1, c2 = np.add.reduceat(times[order], begins), c1[one], c2[one]
        kept = keep(c12, c1, c2, total)
        values = [first >> 1, first & 1 == 1, second, keys[one] & 1 == 0, c12, c1, c2, np.full(len(begins), total)]
        return pa.Table.from_arrays([pa.array(x[kept]) for x in values], names=list(_PAIR))

    kind = blocks.schema["label"].dataType.simpleString()
    left = blocks.select("block", "label", "total", *_CODES).groupBy("block")
    back = bases.select("start", F.explode("back").alias("back")).select("start", "back.*").groupBy("of")
    parts = left.cogroup(back).applyInArrow(
        keyed, f"label {kind}, task bigint, total bigint, {', '.join(f'{c} binary' for c in _KEYED)}")
    return parts.groupBy("label", "task").applyInArrow(merged, ", ".join(f"{c} {t}" for c, t in _PAIR.items()))
