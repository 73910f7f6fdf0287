"""Removal of repeated 100-byte strings by merged sparse suffix orders."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sentigrid.llm.common import SLICE, _arrow_schema, record_batch, text_of
from sentigrid.session import stage_table

LENGTH = 100
# Suffixes are kept at anchors: of 69 consecutive 32-byte grams, which a 100-byte string holds, the one of least hash.
GRAM = 32
REACH = LENGTH - GRAM + 1
_POS_BITS = 20
_BLOCK = 1 << 19
# Contexts of a shard, of a group that is merged in one task, and of an anchor beyond which its strings go one by one.
SHARD = 1024
GROUP = 8192
HEAVY = 4096
_LAST = (1 << 63) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place, by doubling."""
    h, size, factor = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start): every 100-byte string belongs to one anchor, chosen by its bytes alone.

    The anchor is the rightmost gram of least hash in the string; first and last start bound
    the strings that belong to it.
    """
    parts = []
    mask = np.uint64((1 << _POS_BITS) - 1)
    for base in range(0, len(raw) - LENGTH + 1, _BLOCK):
        h = _gram_hashes(raw[base:base + _BLOCK + LENGTH - 1])
        key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        low, size = key, 1
        while size * 2 <= REACH:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:len(low) - (REACH - size)], low[REACH - size:])
        place = (mask - (low & mask)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        parts.append((h[at].view(np.int64), at + base, first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4


_ANCHOR = "h bigint, ctx bigint, doc bigint, salt bigint, p bigint, spread int, more array<bigint>"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor and document: its hash, the digest of its context, and where it is.

    Later places of an equal context in the same document travel in `more`, so that a text that repeats one word does not
    fill a task with its one anchor.
    """
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], _ANCHOR).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for doc, salt, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    h, p, s, e = anchors(np.frombuffer(text, np.uint8))
                    if len(h):
                        view = memoryview(text)
                        ctx = [xxh3_64_intdigest(view[a:b], seed) for a, b, seed in
                               zip(s.tolist(), (e + LENGTH).tolist(), (p - s).tolist())]
                        rows.append((h, np.array(ctx, np.uint64).view(np.int64), np.full(len(h), doc),
                                     np.full(len(h), salt), p, (p - s) << 8 | (p - e)))
                if rows:
                    columns = [np.concatenate(c) for c in zip(*rows)]
                    keep, more = _within_documents(*columns)
                    arrays = [pa.array(c[keep], f.type) for c, f in zip(columns, schema)]
                    yield pa.RecordBatch.from_arrays([*arrays, more], schema=schema)

    return docs.select("doc", "salt", "t").mapInArrow(run, _ANCHOR)


def _within_documents(h, ctx, doc, salt, p, spread) -> tuple[np.ndarray, pa.Array]:
    """Rows that are the first of their context in a document, and the later places of each."""
    order = np.lexsort((p, ctx, h, salt, doc))
    same = np.ones(len(order), bool)
    same[0] = False
    for c in (h, ctx, doc, salt):
        same[1:] &= c[order][1:] == c[order][:-1]
    head = np.flatnonzero(~same)
    count = np.diff(np.concatenate([head, [len(order)]])) - 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    return order[head], pa.ListArray.from_arrays(offsets, pa.array(p[order[same]], pa.int64()))


def _shared(rows: DataFrame) -> DataFrame:
    """Anchors whose gram occurs more than once.

    `first` marks the earliest of all equal contexts; `mixed` grams have different contexts.
    """
    gram, same = Window.partitionBy("h"), Window.partitionBy("h", "ctx").orderBy("doc", "salt", "p")
    marked = rows.withColumns({
        "n": F.count("*").over(gram), "mixed": F.min("ctx").over(gram) != F.max("ctx").over(gram),
        "first": F.row_number().over(same) == 1})
    kept = marked.filter((F.col("n") > 1) & (~F.col("first") | F.col("mixed")) | (F.size("more") > 0))
    left = F.shiftright("spread", 8)
    return kept.select("h", "doc", "salt", "p", "first", "mixed", "more", left.alias("left"), F.col("spread").bitwiseAND(255).alias("skip"))


_CONTEXT = "h bigint, doc bigint, salt bigint, p bigint, left int, skip int, context binary"


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the strings that belong to the wanted anchors."""
    by_doc = wanted.groupBy("doc", "salt").agg(F.collect_list(F.struct("h", "p", "left", "skip")).alias("at"))
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], _CONTEXT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, salt, text, at in zip(*batch.columns):
                doc, salt, text = doc.as_py(), salt.as_py(), text.as_py()
                rows = [(a["h"], doc, salt, a["p"], a["left"], a["skip"],
                         text[a["p"] - a["left"]:a["p"] - a["skip"] + LENGTH]) for a in at.as_py()]
                yield record_batch(rows, schema)

    return docs.join(by_doc, ["doc", "salt"]).select("doc", "salt", "t", "at").mapInArrow(run, _CONTEXT)


def _words(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of big-endian 64-bit symbols, filled up with zeros."""
    padded = b"".join(t[:width].ljust(width, b"\0") for t in texts)
    return np.frombuffer(padded, ">u8").reshape(len(texts), width // 8).astype(np.uint64)


def shard_transform(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of a shard's strings, and its transform: the symbol before each, 0 before a whole string.

    Strings are rows of equal length of symbols above 0; each has an end, 0, behind it. Suffix k of string i has number
    i * (length + 1) + k; equal suffixes are in the strings' order. Ranks are doubled until they cover a string.
    """
    ended = np.pad(strings.astype(np.int64), ((0, 0), (0, 1)))
    rank, reach = ended, 1
    while reach < ended.shape[1]:
        beyond = np.pad(rank, ((0, 0), (0, reach)))[:, reach:]
        rank = np.unique(rank * (rank.max() + 1) + beyond, return_inverse=True)[1].reshape(ended.shape)
        reach *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    return order, np.roll(ended, 1, axis=1).ravel()[order]


def _placed(symbols: np.ndarray) -> np.ndarray:
    """Where a stable count by symbol takes each place's suffix from: 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    high = (symbols >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge_transforms(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of all shards, as places in the shards' orders one behind the other, and how many
    symbols a suffix shares with the one before it (-1: all).

    Iterative interleave refinement. What is refined is only which shard the suffix at each place comes from: at first shard
    by shard. A step reads the transforms in this interleave, each from its front; a suffix that follows symbol c stands for
    the one that begins with c, so counting the symbols gives the interleave that is right one symbol further. Ends stay
    shard by shard. No suffix is compared or sorted: the order within a shard is taken from its transform. Suffixes that
    part in a step share as many symbols as steps lie behind; blocks of those not parted are all that is kept of prefixes.
    """
    transform = np.concatenate(transforms)
    total = len(transform)
    shards = np.arange(len(transforms), dtype=np.uint16)
    interleave = np.repeat(shards, [len(t) for t in transforms])
    ends = np.repeat(shards, [int((t == 0).sum()) for t in transforms])
    head, shared, depth = np.arange(total) == 0, np.full(total, -1), 0
    while True:
        source = np.empty(total, np.int64)
        source[np.argsort(interleave, kind="stable")] = np.arange(total)
        symbol = transform[source]
        placed = _placed(symbol)
        refined = interleave[placed]
        refined[:len(ends)] = ends
        symbol, block = symbol[placed], np.cumsum(head)[placed]
        parted = head.copy()
        parted[1:] |= (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]) & (symbol[1:] != 0)
        fresh = parted & ~head
        if not fresh.any() and (refined == interleave).all():
            return source, shared
        shared[fresh] = depth
        interleave, head, depth = refined, parted, depth + 1


def merged_order(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and words, and the common prefix of neighbours in it (bytes; -1: other group).

    A row is the string of its group and its 64-bit words; shards of SHARD rows have a transform each, which are merged.
    """
    rank = np.unique(words, return_inverse=True)[1].reshape(words.shape) + 1
    strings = np.column_stack([rank.max() + 1 + group, rank])
    width, starts = strings.shape[1] + 1, range(0, len(strings), SHARD)
    made = [shard_transform(strings[a:a + SHARD]) for a in starts]
    source, shared = merge_transforms([transform for _, transform in made])
    suffix = np.concatenate([order + a * width for a, (order, _) in zip(starts, made)])[source]
    whole = suffix % width == 0
    order, shared = suffix[whole] // width, shared[whole]
    prefix = np.where(shared == 0, -1, 8 * words.shape[1])
    parted = np.flatnonzero(shared > 0)
    at = shared[parted] - 1
    differ = words[order[parted], at] ^ words[order[parted - 1], at]
    prefix[parted] = 8 * at + sum((differ >> np.uint64(64 - 8 * byte) == 0).astype(np.int64) for byte in range(1, 8))
    return order, prefix


def repeats(group: np.ndarray, contexts: list[bytes], left: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Which strings also start earlier: a row per context (in document order), a column per start before the anchor.

    Suffixes start at the anchors; the bytes before them are the transform's column, read backwards. A string that
    starts j bytes before the anchor occurs wherever the suffixes share 100 - j bytes, which are intervals of the merged order,
    and the j bytes before agree, which are intervals of the order of the reversed texts.
    """
    n = len(contexts)
    after = _words([c[k:] for c, k in zip(contexts, left.tolist())], 104)
    before = _words([c[:k][::-1] for c, k in zip(contexts, left.tolist())], 72)
    (right, right_prefix), (back, back_prefix) = merged_order(group, after), merged_order(group, before)
    found = np.zeros((n, REACH), bool)
    for j in range(REACH):
        rows = np.flatnonzero((left >= j) & (skip <= j))
        if len(rows) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[right] = np.cumsum(right_prefix < LENGTH - j)
        b[back] = np.cumsum(back_prefix < j)
        key = a[rows] * (n + 1) + b[rows]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        found[rows, j] = first[which] != np.arange(len(rows))
    return found


_SPAN = "doc bigint, salt bigint, a bigint, b bigint"


def _merged_spans(contexts: DataFrame, groups: int) -> DataFrame:
    """Bytes covered by strings that also start earlier, for anchors of up to HEAVY contexts."""
    schema = _arrow_schema(contexts.sparkSession.createDataFrame([], _SPAN).schema)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("salt", "ascending"), ("p", "ascending"), ("left", "descending")])
        column = lambda c: table[c].to_numpy()
        group = np.unique(column("h"), return_inverse=True)[1]
        found = repeats(group, table["context"].to_pylist(), column("left"), column("skip"))
        row, j = np.nonzero(found)
        start = column("p")[row] - j
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else row
        tail = np.concatenate([head[1:], [len(row)]]).astype(np.int64) - 1 if len(row) else row
        values = (column("doc")[row[head]], column("salt")[row[head]], start[head], start[tail] + LENGTH)
        return pa.table([pa.array(v, pa.int64()) for v in values], schema=schema)

    keyed = contexts.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(groups)))
    return keyed.groupBy("part").applyInArrow(run, _SPAN)


def _single_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: their strings are compared one by one, across tasks.

    The earliest start of each string is combined in the tasks before it moves, so a gram
    in a third of all documents does not gather anywhere.
    """
    made = "k1 bigint, k2 bigint, doc bigint, salt bigint, a bigint"
    schema = _arrow_schema(contexts.sparkSession.createDataFrame([], made).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for h, doc, salt, p, left, skip, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    for k in range(left - skip + 1):
                        d = xxh3_128_intdigest(text[k:k + LENGTH])
                        rows.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), doc, salt, p - left + k))
                if rows:
                    yield record_batch(rows, schema)

    strings = stage_table(contexts.mapInArrow(run, made), "strings")
    place = F.struct("doc", "salt", "a")
    least = strings.groupBy("k1", "k2").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1")
    again = strings.join(least, ["k1", "k2"]).filter(place != F.col("least"))
    return again.select("doc", "salt", "a", (F.col("a") + LENGTH).alias("b"))


def _span_union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row: texts without repeated 100-byte strings.

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller id, or before it in
    the same one. Strings are judged on the input. The suffixes that are sorted are those at
    anchors, of which every 100-byte string holds one, chosen by its bytes alone; grams that occur once are dropped
    first, equal contexts are settled by their earliest place, and the rest is merged group by group.

    A null text is empty; texts under 100 bytes lose nothing. Null ids come last in order. Rows that repeat id
    and text are one document and get one result each; rows that share an id only are ordered by their text's hash. An empty table gives an
    empty result; other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    unique = docs.groupBy(key.alias("k")).count().filter("count > 1").isEmpty()
    text = text_of(text_col)
    salt = F.lit(0).cast("bigint") if unique else F.xxhash64(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("doc"), salt.alias("salt"), text.cast("binary").alias("t"))
    source = rows.select("doc", "salt", "t")
    if not unique:
        source = source.dropDuplicates(["doc", "salt"])
    shared = stage_table(_shared(_anchor_rows(source)), "anchors")
    again = F.when(F.col("first"), F.col("more")).otherwise(F.concat("more", F.array("p")))
    again = shared.select("doc", "salt", "left", "skip", F.explode(again).alias("p"))
    spans = again.select("doc", "salt", (F.col("p") - F.col("left")).alias("a"), (F.col("p") - F.col("skip") + LENGTH).alias("b"))
    wanted = shared.filter("first and mixed")
    sizes = wanted.groupBy("h").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    if total[0]:
        contexts = stage_table(_contexts(source, wanted), "contexts")
        light = contexts
        if total[1] > HEAVY:
            big = sizes.filter(F.col("n") > HEAVY).select("h")
            spans = spans.unionByName(_single_spans(contexts.join(big, "h", "left_semi")))
            light = contexts.join(big, "h", "left_anti")
        spans = spans.unionByName(_merged_spans(light, -(-total[0] // GROUP)))
    by_doc = spans.groupBy("doc", "salt").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    target = _RESULT if with_kept else _RESULT.removesuffix(", kept binary")
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], target).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for doc, raw, found in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    cut = _span_union([(s["a"], s["b"]) for s in found or ()])
                    pieces, last = [], 0
                    for a, b in cut:
                        pieces.append(raw[last:a])
                        last = b
                    kept = b"".join([*pieces, raw[last:]])
                    row = (doc, len(raw), len(raw) - len(kept), len(cut), sha256(kept).hexdigest())
                    out.append((*row, kept) if with_kept else row)
                if out:
                    yield record_batch(out, schema)

    return rows.join(by_doc, ["doc", "salt"], "left").select("doc_id", "t", "spans").mapInArrow(run, target)
