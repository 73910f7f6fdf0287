"""Near duplicates by SimHash fingerprints and one-wildcard segment variants."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentigrid.llm.common import map_rows, text_of
from sentigrid.llm.components import connected_components
from sentigrid.session import stage_table

SEED = 42
# the operator's contract: words of a shingle, bits that may differ
SHINGLE, MAX_BITS = 3, 2
# Two segments of a 64-bit fingerprint; of a wide one, two shorter ones in each 64-bit word.
SEGMENT = 32
WIDE_SEGMENT = 28
# A bucket of more distinct fingerprints than this is linked without pairing its members.
HEAVY = 64
# Pivots of a bucket in one round: twice as many as in the round before, up to this number.
PIVOTS = 64
_BLOCK = 4096


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    n = max(1, len(words) - size + 1)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 hash bits derived from the first ones; lane 0 is the hash itself."""
    if lane == 0:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, words: int = 3, bits: int = 64) -> list[int]:
    """Signed 64-bit words of the fingerprint; bit i is set if it is set in over half the hashes."""
    tokens = text.lower().split()
    if not tokens:
        return [0] * (bits // 64)
    h = _hashes(tokens, words)
    out = []
    for lane in range(bits // 64):
        count = np.zeros(64, np.int64)
        for start in range(0, len(h), _BLOCK):
            part = _remix(h[start:start + _BLOCK], lane)
            raw = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += raw.sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(doc, fp) per row: one pass over the whole texts, no shuffle."""

    def body(ids, texts):
        for i, t in zip(ids, texts):
            yield i, fingerprint(t, words, bits)

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc"), text_of(text_col).cast("binary").alias("t"))
    return map_rows(picked, body, "doc bigint, fp array<bigint>")


def _distance(x: str, y: str, lanes: int):
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(lanes)), F.lit(0))


def _variants(classes: DataFrame, bits: int, width: int) -> DataFrame:
    """One row per segment variant: the whole segment, and it with each single bit left out.

    `key` names segment, left-out bit and what is left; `bit` is the value of the left-out bit
    (null for the whole segment).
    """
    per = width + 1
    i = F.col("i")
    segment, hole = F.floor(i / per).cast("int"), (i % per - 1).cast("int")
    word = F.get(F.col("fp"), F.floor(segment / 2).cast("int"))
    value = F.when(segment % 2 == 0, word).otherwise(F.shiftrightunsigned(word, width))
    value = value.bitwiseAND(F.lit((1 << width) - 1))
    spread = classes.select("cls", "fp", F.explode(F.sequence(F.lit(0), F.lit(bits // 32 * per - 1))).alias("i"))
    spread = spread.select("cls", "fp", "i", hole.alias("hole"), value.alias("v"))
    one = F.expr("shiftleft(1L, greatest(hole, 0))")
    keyed = F.when(F.col("hole") < 0, F.col("v")).otherwise(F.col("v").bitwiseAND(F.bitwise_not(one)))
    bit = F.when(F.col("hole") >= 0, F.expr("cast(shiftright(v, greatest(hole, 0)) & 1 as tinyint)"))
    return spread.select("cls", "fp", (i.cast("bigint") * (1 << SEGMENT) + keyed).alias("key"), bit.alias("bit"))


def _buckets(classes: DataFrame, bits: int, width: int) -> DataFrame:
    """Variants that at least two fingerprints share usefully, with the size `n` and the least class `hub` of their bucket.

    A bucket with a left-out bit is useful only if both values of that bit occur in it: two
    fingerprints with equal segments already meet in the bucket of the whole segment. Only key, class and bit travel,
    never the fingerprint.
    """
    from pyspark.sql import Window

    narrow = _variants(classes, bits, width).select("key", "cls", "bit")
    same = Window.partitionBy("key")
    sized = narrow.select("key", "cls", "bit", F.count("*").over(same).alias("n"), F.min("cls").over(same).alias("hub"),
                          F.min("bit").over(same).alias("lo"), F.max("bit").over(same).alias("hi"))
    kept = sized.filter((F.col("n") > 1) & (F.col("lo").isNull() | (F.col("lo") < F.col("hi"))))
    return kept.select("key", "cls", "bit", "n", "hub")


def _with_print(df: DataFrame, classes: DataFrame, lanes: int, cls: str, fp: str) -> DataFrame:
    """`df` with the fingerprint of the class in column `cls`; one of 64 bits is the class itself."""
    if lanes == 1:
        return df.withColumn(fp, F.array(cls))
    return df.join(classes.select(F.col("cls").alias(cls), F.col("fp").alias(fp)), cls)


def _hub_links(buckets: DataFrame, classes: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Links of the members of every bucket to its least class, where the distance allows them.

    A large group of copies meets in many buckets, mostly around the same hubs: each (class, hub) is verified once.
    """
    met = buckets.select("cls", "hub").filter("cls != hub").distinct()
    met = _with_print(_with_print(met, classes, lanes, "cls", "fp"), classes, lanes, "hub", "hub_fp")
    return (met.filter(_distance("fp", "hub_fp", lanes) <= max_bits)
            .select(F.col("hub").alias("a"), F.col("cls").alias("b")))


def _mixed(buckets: DataFrame, classes: DataFrame, parts: DataFrame, lanes: int) -> DataFrame:
    """The buckets in which classes of different parts meet, with part and fingerprint of each member.

    Within a part everything is linked already, so no other bucket can add a link that matters.
    """
    part = parts.select(F.col("node").alias("cls"), F.col("root").alias("part"))
    known = buckets.join(part, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    open_ = known.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    return _with_print(known.join(open_.select("key"), "key", "left_semi"), classes, lanes, "cls", "fp")


def _pair_links(light: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Pairs of different parts within buckets of at most HEAVY members, verified by their distance."""
    x, y = light.alias("x"), light.alias("y")
    ordered = F.when(F.col("x.bit").isNull(), F.col("x.cls") < F.col("y.cls")).otherwise(F.col("x.bit") < F.col("y.bit"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & ordered & (F.col("x.part") != F.col("y.part")))
    return (met.filter(_distance("x.fp", "y.fp", lanes) <= max_bits)
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")))


def _neighbour_links(heavy: DataFrame) -> DataFrame:
    """Exact links of 64-bit fingerprints at distance 2 or less, without pairing a bucket.

    Two fingerprints are that close exactly if one 64-bit value is within one bit of both. A value has at most
    65 such fingerprints, which are linked to the smallest of them, so rows grow with the
    fingerprints and never with their square.
    """
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.expr("cls").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p)))
    around = heavy.select("cls").distinct().select("cls", F.explode(F.concat(F.array("cls"), near)).alias("z"))
    met = around.groupBy("z").agg(F.collect_set("cls").alias("all")).filter(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a != b").distinct()


def _pivot_links(heavy: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Links of large buckets through pivots: what is linked to a pivot needs no link among itself.

    In each round some members not yet tied to a pivot, one in the first and twice as many in each further round,
    are compared with the whole bucket, until every member is tied. A pivot settles its group of near copies. Every member is linked to all
    pivots it is close to; two members of different pivots stay unlinked here if no pivot is close to both.
    """
    links, left, slots = [], heavy, 1
    while True:
        slot = F.pmod(F.xxhash64("cls", F.lit(slots)), F.lit(slots))
        pivots = left.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("cls", "fp")).alias("p"))
        slots = min(2 * slots, PIVOTS)
        met = heavy.join(pivots, "key").withColumn("pfp", F.col("p.fp"))
        met = met.filter(_distance("fp", "pfp", lanes) <= max_bits)
        met = stage_table(met.select("key", "cls", F.col("p.cls").alias("pivot")), "pivots")
        links.append(met.filter("cls != pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        left = stage_table(left.join(met.select("key", "cls"), ["key", "cls"], "left_anti"), "untied")
        if left.isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bits: int = 64, max_bits: int = 2, width: int = SEGMENT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: near duplicates share a component.

    Fingerprints are cut into segments of 32 bits. Of two 64-bit fingerprints at distance 2 or
    less, one segment differs in at most one bit, so they share a variant of that segment with one bit
    left out; variants are joined by equality and the distance verifies. Wider
    fingerprints (bits=512) have more segments, each of `width` bits, and take a larger distance: such pairs
    meet if any segment differs in at most one bit.

    Texts of equal fingerprint are one class before anything is joined, so copies never multiply.
    Each bucket first links its members to its least class. Only buckets in which different parts of the link graph still
    meet go on: of at most 64 classes, members of different parts are paired; larger ones are linked through common
    neighbours (64 bits) or pivots.

    A null or empty text has the fingerprint zero and is linked like any other. Repeated rows are
    kept. `component_id` is the smallest non-null id reachable, null if all are null. An empty table gives an
    empty result; other columns are ignored.
    """
    if bits % 64 or not 1 <= width <= SEGMENT or (bits == 64 and (max_bits > 3 or width < SEGMENT)):
        raise ValueError("bits is a multiple of 64, and two segments of 32 bits prove a distance of 3 at most")
    lanes = bits // 64
    cls = F.col("fp")[0] if lanes == 1 else F.xxhash64("fp")
    rows = stage_table(fingerprints(docs, id_col, text_col, words, bits).withColumn("cls", cls), "fingerprints")
    classes = stage_table(rows.groupBy("cls").agg(F.min("doc").alias("least"), F.first("fp").alias("fp")), "classes")
    buckets = stage_table(_buckets(classes, bits, width), "buckets")
    parts = stage_table(connected_components(_hub_links(buckets, classes, lanes, max_bits)), "parts")
    mixed = stage_table(_mixed(buckets, classes, parts, lanes), "mixed")
    light, heavy = mixed.filter(F.col("n") <= HEAVY), mixed.filter(F.col("n") > HEAVY)
    known = parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = known.unionByName(_pair_links(light, lanes, max_bits))
    if not heavy.isEmpty():
        close = _neighbour_links(heavy) if lanes == 1 and max_bits <= 2 else _pivot_links(heavy, lanes, max_bits)
        links = links.unionByName(close)
    roots = stage_table(connected_components(links), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "cls"), "cls").select("cls", "root", "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    member = rooted.join(named, "root").select("cls", "component")
    out = rows.join(classes.select("cls", "least"), "cls").join(member, "cls", "left")
    return out.select(F.col("doc").alias("doc_id"), "fp", F.coalesce("component", "least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
               bits: int = 512, max_bits: int = 82, width: int = WIDE_SEGMENT) -> DataFrame:
    """`docs` with one row of each group of near duplicates: that of the smallest id.

    By default five-word shingles and 512 bits, of which 82 may differ: a similarity of 0.8 leads to a share of
    0.15, or 78 bits, give or take 8. Only ids move; the texts are read again for the rows that stay. Of rows that
    repeat an id one stays at most. A row of null id is known by a hash of its text and stays only if its group has no id.
    """
    key, first = "_key", "_first"
    while {key, first} & set(docs.columns):
        key, first = key + "_", first + "_"
    unnamed = F.lit(1 << 62) + F.xxhash64(text_of(text_col)).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("bigint"), unnamed))
    found = near_duplicates(keyed, key, text_col, words, bits, max_bits, width)
    stays = found.select(F.col("component_id").alias(first)).distinct()
    return keyed.join(stays, F.col(key) == F.col(first), "left_semi").dropDuplicates([key]).drop(key)
