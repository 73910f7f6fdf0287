"""Repeatable splits by class.

Documents of a class are ordered by a seeded md5 of their key, and the first ones up to an
exact quota go to the test part, the next to the validation part. No class is ever sorted
as a whole: the position of a quota is found in a histogram of hash prefixes, the prefix in which it falls
is refined until it holds few rows, and only these are ranked. The split itself is then a comparison per row.

With more than MAX_CLASSES classes nothing per class reaches the driver: the quotas are a table, the places in the
order of remainders are worked out by ranges, and the rows of all classes but the largest meet the table in one
shuffle by class, in which they are ranked. Both ways give the same split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentigrid.config import MAX_CLASSES
from sentigrid.operators.labelling import class_counts
from sentigrid.operators.ranking import global_rank
from sentigrid.session import stage_table

# hex digits by which a prefix grows: a step's histogram has 16**3 rows per class and cut
STEP_DIGITS = 3
# rows that one task ranks for a cut
RANKED = 100_000
_KEY_DIGITS = 32
_CROSSING = "label string, no int, prefix string, need bigint"


def order_key(doc_id: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"))


def class_quotas(sizes: dict[str, int], share: float) -> dict[str, int]:
    """ceil(share * rows) rows in all, leaving at least one, spread over the classes by largest remainder.

    Equal remainders go by class name. The inner rounding hides binary fractions.
    """
    rows = sum(sizes.values())
    wanted = max(min(math.ceil(round(rows * share, 9)), rows - 1), 0)
    quota = {c: n * wanted // rows for c, n in sizes.items()} if rows else {}
    by_remainder = sorted(sizes, key=lambda c: (-(sizes[c] * wanted % rows), c)) if rows else []
    for c in by_remainder[:wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def cumulative_quotas(sizes: dict[str, int], shares: list[float]) -> list[dict[str, int]]:
    """Cut positions per class: each share is taken from what the previous ones left."""
    cuts, rest = [], dict(sizes)
    for share in shares:
        part = class_quotas(rest, share)
        rest = {c: n - part[c] for c, n in rest.items()}
        cuts.append({c: sizes[c] - n for c, n in rest.items()})
    return cuts


def _cut_keys(keyed: DataFrame, cuts: list[dict[str, int]]) -> DataFrame:
    """Per label, the (key, id) at each cut: (label, cut_0, cut_1, ...), null for an empty part.

    Only one row per class and cut reaches the driver in a step; classes are bounded.
    """
    spark = keyed.sparkSession
    crossing = [(c, no, "", n) for no, quota in enumerate(cuts) for c, n in quota.items() if n]
    digits = 0
    while True:
        at_prefix = F.broadcast(spark.createDataFrame(crossing, _CROSSING))
        inside = keyed.withColumn("prefix", F.substring("at.key", 1, digits)).join(at_prefix, ["label", "prefix"])
        digits += STEP_DIGITS
        finer = F.substring("at.key", 1, digits)
        histogram = inside.groupBy("label", "no", "need", finer.alias("finer")).agg(F.count("*").alias("n"))
        before = Window.partitionBy("label", "no").orderBy("finer")
        found = histogram.withColumn("upto", F.sum("n").over(before)).filter(
            (F.col("need") > F.col("upto") - F.col("n")) & (F.col("need") <= F.col("upto")))
        rows = found.select("label", "no", "finer", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n").collect()
        crossing = [(r.label, r.no, r.finer, r.need) for r in rows]
        if digits + STEP_DIGITS > _KEY_DIGITS or all(r.n <= RANKED for r in rows):
            break
    at_prefix = F.broadcast(spark.createDataFrame(crossing, _CROSSING))
    inside = keyed.withColumn("prefix", F.substring("at.key", 1, digits)).join(at_prefix, ["label", "prefix"])
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("label", "no").orderBy("at")))
    return (
        ranked.filter(F.col("rank") == F.col("need")).groupBy("label")
        .agg(*[F.max(F.when(F.col("no") == i, F.col("at"))).alias(f"cut_{i}") for i in range(len(cuts))])
    )


def quota_table(sizes: DataFrame, share: float, name: str) -> DataFrame:
    """Adds to (label, n, ...) the quota of each class, as `class_quotas` does: by largest remainder, ties by class name.

    Whole numbers of 38 digits; of all classes only three sums reach the driver.
    """
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = max(min(math.ceil(round(rows * share, 9)), rows - 1), 0)
    product = F.col("n").cast("decimal(19,0)") * F.lit(wanted).cast("decimal(19,0)")
    whole = sizes.withColumns({
        "_floor": F.expr(f"CAST(n AS DECIMAL(19,0)) * CAST({wanted} AS DECIMAL(19,0)) div CAST({max(rows, 1)} AS DECIMAL(19,0))"),
        "_rest": (product % F.lit(max(rows, 1)).cast("decimal(19,0)")).cast("bigint")})
    extra = wanted - (whole.agg(F.sum("_floor")).first()[0] or 0)
    ranked = global_rank(whole, F.desc("_rest"), F.asc("label"), name="_place")
    quota = F.col("_floor") + F.when(F.col("_place") <= extra, 1).otherwise(0)
    return ranked.withColumn(name, quota.cast("bigint")).drop("_floor", "_rest", "_place")


def cut_table(sizes: DataFrame, shares: list[float]) -> DataFrame:
    """(label, n, cut_0, cut_1, ...): as `cumulative_quotas`, each share taken from what the previous ones left."""
    table = sizes.select("label", F.col("n").alias("_all"), "n")
    for i, share in enumerate(shares):
        taken = quota_table(table, share, "_part")
        table = taken.withColumn("n", F.col("n") - F.col("_part")).withColumn(
            f"cut_{i}", F.col("_all") - F.col("n")).drop("_part")
    return stage_table(table.drop("n").withColumnRenamed("_all", "n"), "cuts")


def _split_few(df: DataFrame, sizes: dict[str, int], parts: list[str], shares: list[float], seed: int) -> DataFrame:
    """Cuts found in histograms of hash prefixes; the table of cuts is broadcast, one row per class."""
    cuts = cumulative_quotas(sizes, shares)
    keyed = df.select("label", F.struct(order_key(F.col("doc_id"), seed).alias("key"), "doc_id").alias("at"))
    at = F.struct(order_key(F.col("doc_id"), seed).alias("key"), "doc_id")
    joined = df.join(F.broadcast(_cut_keys(keyed, cuts)), "label", "left")
    part = F.lit("train")
    for i in reversed(range(len(parts))):
        part = F.when(at <= F.col(f"cut_{i}"), parts[i]).otherwise(part)
    return joined.withColumn("split", part).drop(*[f"cut_{i}" for i in range(len(parts))])


def _split_many(df: DataFrame, sizes: DataFrame, parts: list[str], shares: list[float], seed: int) -> DataFrame:
    """Classes of at most RANKED rows are ranked where they meet their cuts; the few larger ones are cut as above."""
    cuts = cut_table(sizes, shares)
    names = [f"cut_{i}" for i in range(len(parts))]
    large = cuts.filter(F.col("n") > RANKED).collect()  # at most rows / RANKED
    out = df.filter(F.col("label").isNull()).withColumn("split", F.lit("train"))
    rest = df.filter(F.col("label").isNotNull())
    if large:
        rows = [(r.label, *(r[c] for c in names)) for r in large]
        listed = F.broadcast(df.sparkSession.createDataFrame([(r[0],) for r in rows], "label string"))
        keyed = rest.join(listed, "label").select(
            "label", F.struct(order_key(F.col("doc_id"), seed).alias("key"), "doc_id").alias("at"))
        quotas = [{r[0]: r[1 + i] for r in rows} for i in range(len(parts))]
        at = F.struct(order_key(F.col("doc_id"), seed).alias("key"), "doc_id")
        cut = rest.join(listed, "label").join(F.broadcast(_cut_keys(keyed, quotas)), "label", "left")
        part = F.lit("train")
        for i in reversed(range(len(parts))):
            part = F.when(at <= F.col(f"cut_{i}"), parts[i]).otherwise(part)
        out = out.unionByName(cut.withColumn("split", part).select(*df.columns, "split"))
        rest = rest.join(listed, "label", "left_anti")
    place = F.row_number().over(Window.partitionBy("label").orderBy(order_key(F.col("doc_id"), seed), "doc_id"))
    ranked = rest.join(cuts.filter(F.col("n") <= RANKED).select("label", *names), "label").withColumn("_place", place)
    part = F.lit("train")
    for i in reversed(range(len(parts))):
        part = F.when(F.col("_place") <= F.col(names[i]), parts[i]).otherwise(part)
    return out.unionByName(ranked.withColumn("split", part).select(*df.columns, "split"))


def split_by_class(df: DataFrame, parts: list[str], shares: list[float], seed: int = 42,
                   sizes: dict[str, int] | None = None) -> DataFrame:
    """Adds `split` to a frame with doc_id and label; rows beyond the last cut, and rows without a label, are 'train'.

    Known class sizes save a pass.
    """
    if sizes is None:
        counted = stage_table(class_counts(df), "class-sizes")
        few = counted.limit(MAX_CLASSES + 1).collect()
        if len(few) > MAX_CLASSES:
            return _split_many(df, counted, parts, shares, seed)
        sizes = {r.label: r.n for r in sorted(few, key=lambda r: r.label)}
    return _split_few(df, sizes, parts, shares, seed)


def stratified_split(df: DataFrame, test_ratio: float = 0.2, seed: int = 42,
                     sizes: dict[str, int] | None = None) -> DataFrame:
    return split_by_class(df, ["test"], [test_ratio], seed, sizes)


def three_way_split(df: DataFrame, test_ratio: float = 0.2, validation_share: float = 0.1,
                    seed: int = 42, sizes: dict[str, int] | None = None) -> DataFrame:
    """Test first; then `validation_share` of all rows from the rest as validation part."""
    return split_by_class(df, ["test", "val"], [test_ratio, validation_share / (1 - test_ratio)], seed, sizes)
