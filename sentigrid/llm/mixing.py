"""Mixing sources to target weights by pivotal rounding over a reduction tree."""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import WORD, text_of
from sentigrid.session import stage_table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
# Documents that meet in one group of the reduction tree.
FAN_IN = 4096
_SNAP = 1e-9


def _ranked(sources: DataFrame) -> DataFrame:
    """Row number of each source by code point, null last: a range sort, counts per part, offsets."""
    from pyspark.sql import Window

    order = [F.col("source").asc_nulls_last()]
    parts = stage_table(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    offsets, before = {}, 0
    for row in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per part
        offsets[row.part], before = before, before + row.n
    starts = F.array(*(F.lit(offsets.get(i, 0)).cast("bigint") for i in range(max(offsets, default=0) + 1)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("rank", inside + F.get(starts, F.col("part"))).drop("part")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total. A target stops at
    `most` times its source; the excess is shared again by weight until none is above. Only totals reach the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    base = stage_table(_ranked(sums).withColumn("w", weight).withColumn("limit", most * F.col("source_size")), "ranked")
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("limit") < F.lit(level) * F.col("w")
        row = base.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("limit"))),
                       F.sum(F.when(~full, F.col("w")))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], (total - (row[1] or 0.0)) / row[2]
    target = F.least(F.col("limit"), F.lit(float(level or 0.0)) * F.col("w"))
    return base.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def pivotal(sizes: list[int], parts: list[float], rng: random.Random) -> int | None:
    """Rounds `parts` in place to 0 or 1; the index that may stay fractional, or None.

    Two fractional entries meet: one gains what the other loses, in words, until one of them is 0 or 1. The
    direction is drawn so that each entry's expectation stays.
    """
    open_ = None
    for i, p in enumerate(parts):
        if p <= _SNAP or p >= 1 - _SNAP or not sizes[i]:
            parts[i] = float(round(p)) if sizes[i] else 0.0
            continue
        if open_ is None:
            open_ = i
            continue
        a, b, q = sizes[open_], sizes[i], parts[open_]
        up, down = min((1 - q) * a, p * b), min(q * a, (1 - p) * b)
        move = up if rng.random() * (up + down) < down else -down
        q, p = q + move / a, p - move / b
        parts[open_], parts[i] = q, p
        rest = []
        for k in (open_, i):
            if _SNAP < parts[k] < 1 - _SNAP:
                rest.append(k)
            else:
                parts[k] = float(round(parts[k]))
        open_ = rest[0] if rest else None
    return open_


_NODE = "source string, doc bigint, size bigint, whole bigint, part double, spread bigint, open boolean"
_KEPT = [c.split()[0] for c in _NODE.split(", ")]


def _round_group(seed: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # falling sizes: each meets one like it, so what stays open at the end is small
        rows = rows.select(_KEPT).sort_by([("size", "descending"), ("spread", "ascending"), ("doc", "ascending")])
        rng = random.Random(zlib.crc32(repr((seed, *(k.as_py() for k in key))).encode()))
        parts = rows["part"].to_pylist()
        left = pivotal(rows["size"].to_pylist(), parts, rng)
        still = [False] * len(parts)
        if left is not None:
            still[left] = not last
        rows = rows.set_column(_KEPT.index("part"), "part", pa.array(parts, pa.float64()))
        return rows.set_column(_KEPT.index("open"), "open", pa.array(still, pa.bool_()))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    A document of a source is due target / source_size copies: the whole number is given, the fraction is rounded by the
    pivotal method. Documents meet in groups of about 4,096 of one source; each group leaves at most one
    fractional document, and these meet again, level by level, until one is left per source, which is taken
    in part: `taken` then exceeds copies * size. The words taken from a source therefore meet its target to
    the word. Groups and draws follow from ids, sizes and the seed, so reruns agree.

    A null or empty text has size 0 and is taken 0 times; the null source is a source of its own, last in order; null ids
    and repeated rows are rows like others; an empty table gives an empty result. Other columns are ignored.
    """
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(source_col).cast("string").alias("source"),
                        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"))
    sized = stage_table(sized, "sizes")
    goals = stage_table(source_targets(sized, weights, most), "targets")
    goal = goals.select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    due = F.when(F.col("size") > 0, due).otherwise(0.0)
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("s")))
    spread = F.xxhash64("doc", "size", F.lit(seed))
    nodes = joined.select("source", "doc", "size", F.floor(due).alias("whole"), (due - F.floor(due)).alias("part"),
                          spread.alias("spread"), F.lit(True).alias("open"), F.col("n_docs").alias("n"))
    largest = goals.agg(F.max("n_docs")).first()[0] or 0
    done, level = [], 0
    while True:
        groups = F.ceil(F.col("n") / FAN_IN)
        group = F.pmod(F.xxhash64("spread", F.lit(level)), groups)
        last = largest <= FAN_IN
        keyed = nodes.withColumn("group", group)
        out = keyed.groupBy("source", F.col("group")).applyInArrow(_round_group(seed + level, last), _NODE)
        out = stage_table(out.withColumn("level", F.lit(level)), "rounded")
        done.append(out.filter(~F.col("open")))
        if last:
            break
        largest, level = -(-largest // FAN_IN), level + 1
        counts = out.filter("open").groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
        nodes = out.filter("open").drop("level").join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = F.col("whole") + F.floor("part")
    words = F.col("whole") * F.col("size") + F.round(F.col("part") * F.col("size")).cast("bigint")
    named = every.join(goal.drop("n_docs"), F.col("source").eqNullSafe(F.col("s")))
    return named.select(F.col("doc").alias("doc_id"), "source", "size", "source_size", "target",
                        copies.alias("copies"), words.alias("taken"))
