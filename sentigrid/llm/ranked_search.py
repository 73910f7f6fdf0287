"""Ranked lexical search: the best documents of every item by an integer score, found through norm buckets.

A document is a vector of term impacts, an item a vector of term weights, a score their inner product. Vectors are
ordered by length and cut into buckets. An item passes over a bucket whose longest vector cannot reach the item's
threshold (Cauchy-Schwarz); inside a bucket the largest coordinates of the item bound what a vector can reach; the
survivors are scored again in integers, so the result is exact. Thresholds start from the longest vectors of the whole
corpus and rise within every task.

Only the items' terms are kept of a document: other coordinates add nothing to a product.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentigrid.llm.common import map_rows, ragged
from sentigrid.session import stage_table

# (item, term) pairs of a block of items; a block's vocabulary is what travels to the tasks
BLOCK_PAIRS = 500_000
# vectors of a bucket
BUCKET = 4096
# share of the vectors, the longest ones, that set the first thresholds
SEED_SHARE = 0.01
# coordinates of an item that bound a vector before it is scored
FOCUS = 6
# bytes of a text that are cut into terms at once
PIECE = 1 << 20
# relative slack of the bounds, which are computed in doubles
SLACK = 1e-9

# --- fixed values: the ranking formula ----------------------------------------------------
# ASCII characters that are no digit and no letter part terms; A to Z become lower case
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WEIGHT_SCALE, IMPACT_SCALE = 1000, 1_000_000_000
LENGTH_SHARE, SATURATION = 90, 8
# --- end of fixed values --------------------------------------------------------------------

_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FOUND = "item int, score bigint, doc_id bigint"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time, so that a very long text costs no list of all its terms."""
    bare = raw.translate(_BYTES)
    start = 0
    while start < len(bare):
        end = bare.find(b" ", start + PIECE)
        end = len(bare) if end < 0 else end
        yield bare[start:end].split()
        start = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of the different terms of each item; rows of one item_id are one item."""
    def body(ids, texts):
        for item, raw in zip(ids, texts):
            for term in {t for piece in _pieces(raw or b"") for t in piece}:
                yield item, term

    kind = items.schema["item_id"].dataType.simpleString()
    return map_rows(items.select("item_id", F.col("text").cast("binary")), body,
                    f"item_id {kind}, term binary").distinct()


def _term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): number of terms, and the vocabulary's terms with their occurrences."""
    def body(ids, texts):
        known = vocabulary.get
        for doc, raw in zip(ids, texts):
            n, found = 0, Counter()
            for piece in _pieces(raw or b""):
                n += len(piece)
                found.update(map(known, piece))
            found.pop(None, None)
            places = sorted(found)
            yield doc, n, places, [found[p] for p in places]

    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), body,
                    "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>")


def _impacts(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, ids, impacts) of the documents with a term of the items, by falling length in a task."""
    length = (100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * n * {n_docs}L) div {n_terms}L")
    impact = F.expr(f"transform(tfs, t -> ({IMPACT_SCALE}L * t) div ({WEIGHT_SCALE}L * t + {SATURATION}L * m))")
    vectors = counts.filter(F.size("ids") > 0).withColumn("m", length).select("doc_id", "ids", impact.alias("impacts"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("doc_id", norm.alias("norm"), "ids", "impacts").filter("norm > 0").sortWithinPartitions(
        F.desc("norm"))


class _Bucket:
    """Vectors of similar length, by falling length, with one posting list per term."""

    def __init__(self, docs, norms, ends, ids, impacts):
        order = np.argsort(-norms, kind="stable")
        lengths = np.diff(ends)[order]
        spots = ragged(ends[:-1][order], lengths)
        self.docs, self.norms = [docs[i] for i in order], norms[order]
        self.ids, self.impacts = ids[spots], impacts[spots]
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        rows = np.repeat(np.arange(len(order)), lengths)
        by_term = np.argsort(self.ids, kind="stable")
        self.terms, self.rows = self.ids[by_term], rows[by_term]
        self.unit = (self.impacts / self.norms[rows])[by_term]

    def posting(self, term: int):
        """Vectors with the term, and the term's share of their length."""
        a, b = np.searchsorted(self.terms, (term, term + 1))
        return self.rows[a:b], self.unit[a:b]

    def survivors(self, item: "_Item", threshold: float) -> np.ndarray:
        """Vectors that may reach the threshold, judged by the item's largest coordinates."""
        low = threshold / (item.norm * self.norms[0])
        alive, share, seen, first = None, np.zeros(len(self.norms)), np.zeros(len(self.norms)), True
        for term, q in item.focus:
            rows, unit = self.posting(term)
            share[rows] += q * unit
            seen[rows] += unit * unit
            least = q * low - math.sqrt(max(0.0, (1 - low * low) * (1 - q * q)))
            if first and least > SLACK:  # no vector without this coordinate is near enough
                most = 1.0 if q > low else q * low + math.sqrt(max(0.0, (1 - low * low) * (1 - q * q)))
                alive = rows[(unit >= least - SLACK) & (unit <= most + SLACK)]
            first = False
        rest = item.rest * np.sqrt(np.maximum(0.0, 1 - seen))
        near = (share + rest) * item.norm * self.norms * (1 + SLACK) + SLACK >= threshold
        return np.flatnonzero(near) if alive is None else alive[near[alive]]

    def scores(self, item: "_Item", rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; `weights` is an empty array over the vocabulary, left empty again."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        spots = ragged(self.starts[rows], lengths)
        weights[item.ids] = item.weights
        parts = weights[self.ids[spots]] * self.impacts[spots]
        weights[item.ids] = 0
        return np.add.reduceat(parts, np.cumsum(lengths) - lengths)


class _Item:
    """An item's weights, their length, its largest coordinates and the length beyond them."""

    def __init__(self, ids: list[int], weights: list[int]):
        self.ids, self.weights = np.array(ids), np.array(weights, dtype=np.int64)
        self.norm = math.sqrt(sum(w * w for w in weights))
        unit = sorted(((w / self.norm, t) for t, w in zip(ids, weights)), reverse=True)
        self.focus = [(t, q) for q, t in unit[:FOCUS]]
        self.rest = math.sqrt(sum(q * q for q, _ in unit[FOCUS:]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bucket]:
    for batch in batches:
        for start in range(0, batch.num_rows, BUCKET):
            part = batch.slice(start, BUCKET)
            doc, norm, ids, impacts = part.columns
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield _Bucket(doc.to_pylist(), norm.to_numpy(), ends - ends[0],
                          ids.flatten().to_numpy().astype(np.int64), impacts.flatten().to_numpy().astype(np.int64))


def _best(vectors: DataFrame, queries: list[tuple[int, list[int], list[int]]], floors: dict[int, int], k: int,
          size: int) -> DataFrame:
    """(item, score, doc_id): per task the k best vectors of each item that reach its floor."""
    def run(batches):
        items = {number: _Item(ids, weights) for number, ids, weights in queries}
        bounds = {number: max(1, floors.get(number, 1)) for number in items}
        best = {number: [] for number in items}
        empty = np.zeros(size, dtype=np.int64)
        for bucket in _buckets(batches):
            longest = bucket.norms[0]
            for number, item in items.items():
                bound = bounds[number]
                if item.norm * longest * (1 + SLACK) < bound:  # Cauchy-Schwarz, for the whole bucket
                    continue
                rows = bucket.survivors(item, float(bound))
                if not len(rows):
                    continue
                scores = bucket.scores(item, rows, empty)
                good = np.flatnonzero(scores >= bound)
                if len(good) > k:  # all ties of the k-th stay for the order by document
                    least = np.partition(scores[good], len(good) - k)[len(good) - k]
                    good = good[scores[good] >= least]
                if not len(good):
                    continue
                mine = best[number] + [(int(scores[g]), bucket.docs[rows[g]]) for g in good]
                mine.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
                best[number] = mine[:k]
                if len(mine) >= k:
                    bounds[number] = max(bound, mine[k - 1][0])
        found = [(number, score, doc) for number, mine in best.items() for score, doc in mine]
        if found:
            columns = zip(*found)
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["item", "score", "doc_id"])

    return vectors.select("doc_id", "norm", "ids", "impacts").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """The ranked documents of one block of items, or None where nothing can score."""
    spark = docs.sparkSession
    rows = pairs.collect()  # at most about BLOCK_PAIRS
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    terms: dict = {}
    for r in rows:
        terms.setdefault(r.item_id, []).append(vocabulary[bytes(r.term)])
    counts = stage_table(_term_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not vocabulary:
        return None
    df = dict(counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
    weight = {t: math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    names = list(terms)
    queries = []
    for number, name in enumerate(names):
        ids = sorted(t for t in terms[name] if weight.get(t, 0) > 0)
        if ids:
            queries.append((number, ids, [weight[t] for t in ids]))
    if not queries:
        return None
    vectors = stage_table(_impacts(counts, n_docs, n_terms), "impacts")
    cut = vectors.agg(F.percentile_approx("norm", 1 - SEED_SHARE, 1000)).first()[0]
    seeds = stage_table(_ranked(_best(vectors.filter(F.col("norm") >= cut), queries, {}, k, len(vocabulary)), k), "seeds")
    floors = {r.item: r.score for r in seeds.filter(F.col("rank") == k).select("item", "score").collect()}
    others = _best(vectors.filter(F.col("norm") < cut), queries, floors, k, len(vocabulary))
    found = _ranked(seeds.drop("rank").unionByName(others), k)
    kind = pairs.schema["item_id"].dataType.simpleString()
    known = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return found.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, the best first.

    `docs` has doc_id and text, `items` item_id and text; other columns are not read. Items are taken in blocks of
    about BLOCK_PAIRS (item, term) pairs, each block against all documents. A null or empty text has no terms: such a
    document is never found and counts in no total, such an item finds nothing. Very long texts are cut into terms
    piece by piece. Equal scores go by ascending doc_id, a null doc_id last. Repeated document rows are documents of
    their own; rows of one item_id (null too) are one item with the terms of all. Empty tables give no rows.
    """
    pairs = stage_table(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(pairs.count() / BLOCK_PAIRS))
    place = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [_search_block(docs, pairs.filter(place == b) if blocks > 1 else pairs, k) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
