"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes, a space and the text. Where a token of A and a token of B end together the text
is cut into groups, and the two tokens are linked. For every pair (A id, B id) the documents with a link form a
posting: per block of documents one bitmap for each binary digit of the number of links in a document (multiplicity
planes), stored as a list of 16-bit positions where sparse and as plain bits where dense. The OR of the planes
counted gives a pair's documents, the planes' counts weighted by their digit its links, summed over the blocks.
The postings then carry each pair's score back: a block's postings meet the scores and are unfolded into the
documents of that block.

A block has at most BLOCK_DOCS documents and about BLOCK_LINKS entries and never leaves a task, so no posting of a
whole corpus is ever in one place, however frequent its pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.session import stage_table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# documents of a block: positions fit 16 bits
BLOCK_DOCS = 1 << 14
# (pair, document) entries after which a block is closed
BLOCK_LINKS = 1 << 21
# a plane with more documents is stored as bits
SPARSE = BLOCK_DOCS // 16
# bytes of text that are cut into tokens at once
SLICE_BYTES = 1 << 19

# --- fixed values: the splitting pattern of the byte-level tokenizer ------------------------
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values ----------------------------------------------------------------------

Encoder = Callable[[list[str]], list[list[int]]]


def _byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_encoder(path: str = BYTE_BPE) -> tuple[Encoder, list[bytes]]:
    """Encoder and token bytes of a byte-level BPE file, special tokens left out.

    The file's merges in order are the ranks of the fast encoder; strings of special tokens are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = _byte_letters()
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ordered = [bytes([b]) for b in range(256)]
    ordered += [bytes(letters[c] for part in m for c in part) for m in merges]
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(ordered)}, special_tokens={})
    of_rank = np.array([ids[t] for t in ordered], np.int64)
    known = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        known[i] = token

    def encode(texts):
        return [of_rank[np.array(fast.encode_ordinary(" " + t), np.int64)] for t in texts]

    return encode, known


@lru_cache(maxsize=2)
def piece_encoder(path: str = PIECE_BPE) -> tuple[Encoder, list[bytes]]:
    """Encoder and token bytes of a sentence-piece file; it puts the space in front itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    known = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        known.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(texts):
        return [np.array(ids, np.int64) for ids in pieces.encode(list(texts), num_threads=1)]

    return encode, known


class _Side:
    """One tokenizer with its token bytes, their lengths, and its ids as decimals followed by a mark."""

    def __init__(self, encoder: tuple[Encoder, list[bytes]], inner: str, last: str):
        self.encode, self.known = encoder
        self.bytes = np.array(self.known + [None], dtype=object)[:-1]
        self.lengths = np.array([len(t) for t in self.known], np.int64)
        names = [[f"{i}{mark}" for i in range(len(self.known))] for mark in (inner, last)]
        self.names = np.array(names, dtype=object)

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(self.bytes[ids].tolist()) == raw


def align(a: _Side, b: _Side, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """(linked A ids, linked B ids, the groups written out) of one text's tokens.

    Every token has at least a byte, so just one token of each side ends at a common boundary.
    """
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    at_end = np.zeros(int(ends_a[-1]) + 1, bool)
    at_end[ends_a] = True
    last_b = at_end[ends_b]
    at_end[ends_a] = False
    at_end[ends_b] = True
    last_a = at_end[ends_a]
    # a group is written as its A tokens, then its B tokens
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    before_b = np.concatenate(([0], upto_b))
    out[np.arange(len(ids_a)) + before_b[group_a]] = a.names[last_a.astype(np.int8), ids_a]
    out[np.arange(len(ids_b)) + upto_a[group_b]] = b.names[last_b.astype(np.int8), ids_b]
    return ids_a[last_a], ids_b[last_b], "".join(out.tolist())[:-1]


_DOC = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string())])
_POSTING = pa.schema([
    ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("n", pa.int64()), ("n_docs", pa.int64()), ("docs", pa.binary())])
_ROW = pa.schema([("block", pa.int64()), ("pos", pa.int32()), *_DOC, *_POSTING])
_ROW_SQL = ("block bigint, pos int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "a int, b int, plane int, n bigint, n_docs bigint, docs binary")


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch of the common row layout; columns not named are null."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _ROW], schema=_ROW)


def _containers(positions: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of positions as binaries: 16-bit positions, or all bits of the block where dense."""
    starts = np.cumsum(sizes) - sizes
    dense = np.flatnonzero(sizes > SPARSE)
    lengths = np.where(sizes > SPARSE, BLOCK_DOCS // 16, sizes)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    data = np.empty(int(ends[-1]), np.uint16)
    run = np.repeat(np.arange(len(sizes)), sizes)
    sparse = sizes[run] <= SPARSE
    data[(ends[run] + np.arange(len(positions)) - starts[run])[sparse]] = positions[sparse]
    for i in dense:
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        bits[positions[starts[i]:starts[i] + sizes[i]]] = 1
        data[ends[i]:ends[i + 1]] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = pa.py_buffer((ends * 2).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(data.tobytes())])


def _unfold(sizes: np.ndarray, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, position) of every document in the containers."""
    sparse = np.flatnonzero(sizes <= SPARSE)
    runs = [np.repeat(sparse, sizes[sparse])]
    positions = [np.frombuffer(b"".join([docs[i] for i in sparse]), np.uint16).astype(np.int64)]
    for i in np.flatnonzero(sizes > SPARSE):
        positions.append(np.flatnonzero(np.unpackbits(np.frombuffer(docs[i], np.uint8), bitorder="little")))
        runs.append(np.full(len(positions[-1]), i))
    return np.concatenate(runs), np.concatenate(positions)


class _Block:
    """The documents of a block and their (pair, document) entries with the number of links."""

    def __init__(self, number: int):
        self.number, self.docs, self.keys, self.times, self.size = number, [], [], [], 0

    def add(self, doc, n_a, n_b, linked_a, linked_b, digest) -> None:
        links = len(linked_a)
        self.docs.append((doc, n_a, n_b, links, links, digest))
        if links:
            pairs, times = np.unique((linked_a << 32) | linked_b, return_counts=True)
            self.keys.append(np.stack((pairs, np.full(len(pairs), len(self.docs) - 1))))
            self.times.append(times)
            self.size += len(pairs)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.size >= BLOCK_LINKS

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        if not n:
            return
        columns = zip(*self.docs)
        yield _batch(n, block=pa.array(np.full(n, self.number)), pos=pa.array(np.arange(n, dtype=np.int32)),
                     **{f.name: pa.array(c, f.type) for f, c in zip(_DOC, columns)})
        if not self.size:
            return
        pairs, positions = np.concatenate(self.keys, axis=1)
        times = np.concatenate(self.times)
        order = np.lexsort((positions, pairs))
        pairs, positions, times = pairs[order], positions[order], times[order]
        for plane in range(int(times.max()).bit_length()):
            here = (times >> plane) & 1 == 1
            mine, spots = pairs[here], positions[here]
            if not len(mine):
                continue
            starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(mine)])))
            # a document counts in the plane of its lowest digit: their sum is the count of the planes' OR
            lowest = np.add.reduceat((times[here] & ((1 << plane) - 1) == 0).astype(np.int64), starts)
            keys = mine[starts]
            yield _batch(
                len(keys), block=pa.array(np.full(len(keys), self.number)), a=pa.array((keys >> 32).astype(np.int32)),
                b=pa.array((keys & 0xFFFFFFFF).astype(np.int32)), plane=pa.array(np.full(len(keys), plane, np.int32)),
                n=pa.array(sizes), n_docs=pa.array(lowest), docs=_containers(spots, sizes))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) some at a time, by bytes of text."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def postings(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """Documents (block, pos, doc_id, counts, digest) and postings (block, a, b, plane, n, n_docs, docs) in one pass."""
    def run(batches):
        a, b = _Side(byte_encoder(path_a), ",", "|"), _Side(piece_encoder(path_b), ",", ";")
        none = np.zeros(0, np.int64)
        first = TaskContext.get().partitionId() << 32
        block = _Block(first)
        for ids, texts in _slices(batches):
            whole = [t for t in texts if t]
            found = zip(a.encode(whole), b.encode(whole))
            for doc, text in zip(ids, texts):
                ids_a, ids_b = next(found) if text else (none, none)
                raw = b" " + text.encode("utf-8")
                if len(ids_a) and len(ids_b) and a.spells(ids_a, raw) and b.spells(ids_b, raw):
                    linked_a, linked_b, groups = align(a, b, ids_a, ids_b)
                    block.add(doc, len(ids_a), len(ids_b), linked_a, linked_b, hashlib.sha256(groups.encode()).hexdigest())
                else:
                    block.add(doc, 0, 0, none, none, "")
                if block.full():
                    yield from block.rows()
                    block = _Block(block.number + 1)
        yield from block.rows()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, _ROW_SQL)


def pair_scores(found: DataFrame) -> DataFrame:
    """(a, b, links, documents, best): how many links and documents hold each pair, and whether it is its B id's highest."""
    counts = found.filter(F.col("a").isNotNull()).groupBy("a", "b").agg(
        F.sum(F.expr("shiftleft(n, plane)")).alias("links"), F.sum("n_docs").alias("documents"))
    counts = stage_table(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("links").alias("top"))
    return counts.join(top, "b").select("a", "b", "links", "documents", (F.col("links") == F.col("top")).alias("best"))


def _returned(scored: DataFrame) -> DataFrame:
    """(block, pos, n_best, count_sum): what the postings of a block bring to its documents."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        runs, positions = _unfold(sizes, table["docs"].to_pylist())
        times = (np.int64(1) << table["plane"].to_numpy().astype(np.int64))[runs]
        best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        np.add.at(best, positions, times * table["best"].to_numpy(zero_copy_only=False)[runs])
        np.add.at(total, positions, times * table["links"].to_numpy()[runs])
        with_links = np.flatnonzero(total)
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array(np.full(len(with_links), block)), "pos": pa.array(with_links.astype(np.int32)),
                         "n_best": pa.array(best[with_links]), "count_sum": pa.array(total[with_links])})

    return scored.groupBy("block").applyInArrow(run, "block bigint, pos int, n_best bigint, count_sum bigint")


def align_corpus(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """The documents and the pairs of an aligned corpus.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most frequent, ties
    included), count_sum (links of the corpus with the same pair, summed over the links), groups_sha256. Pairs: a, b,
    links, documents, best.

    `docs` has doc_id and text; other columns are not read. A null or empty text, and one whose tokens of either side
    do not spell it byte for byte, has no tokens: zeros and an empty digest. Whole texts, very long ones too: one text
    is cut into tokens in one go. Repeated rows are documents of their own, a null doc_id stays, an empty table gives
    no rows.
    """
    found = stage_table(postings(docs, path_a, path_b), "postings")
    pairs = pair_scores(found)
    entries = found.filter(F.col("a").isNotNull()).select("block", "a", "b", "plane", "n", "docs")
    back = _returned(entries.join(pairs.select("a", "b", "links", "best"), ["a", "b"]).select(
        "block", "plane", "n", "docs", "links", "best"))
    rows = found.filter(F.col("pos").isNotNull()).select("block", "pos", *_DOC.names)
    whole = rows.join(back, ["block", "pos"], "left")
    zero = F.lit(0).cast("bigint")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"), pairs
