"""Boilerplate lines by their share of a site's pages. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.session import stage_table

# A line goes if more than this share of its host's pages contain it,
RATIO = 0.1
# and at least so many pages do, so that a chance repeat on a small host is no boilerplate.
MIN_PAGES_WITH = 3
# Digests up to which the hosts' lists travel to every task (at most 64 MB); beyond that the pages are salted.
BROADCAST_LINES = 1_000_000
SALTS = 64

_BLOCK = r"(?i)</?(?:address|article|aside|body|br|div|footer|form|h[1-6]|head|header|html|hr|li|main|nav|ol|p|section|table|td|th|title|tr|ul)\b[^>]*>"
_GONE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def url_host(url: Column) -> Column:
    """The lower-case host of an address; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text with one line per block element."""
    bare = F.regexp_replace(html, _GONE, "\n")
    return F.regexp_replace(F.regexp_replace(bare, _BLOCK, "\n"), r"<[^>]*>", "")


def _digest(line: Column) -> Column:
    """128 bits that stand for a line in the counts."""
    return F.md5(line.cast("binary"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, text: Column, host: Column, ratio: float = RATIO,
                least_pages: int = MIN_PAGES_WITH) -> DataFrame:
    """(host, lines): digests of each host's boilerplate lines.

    A page counts once for a line, however often it repeats it. Counts are combined in the
    tasks before they move, so a host with a third of all pages costs no more than others. A
    host has at most (lines of an average page / ratio) such lines, which bounds the list.
    """
    rows = pages.select(host.alias("host"), F.filter(_lines(text), _has_word).alias("lines"))
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", _digest))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    met = counted.join(total, counted["host"].eqNullSafe(total["host"]))
    common = met.filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy(counted["host"].alias("host")).agg(F.collect_list("line").alias("common_lines"))


def _with_lists(pages: DataFrame, known: DataFrame, host: str, own: str, salt: str) -> DataFrame:
    """`pages` with the row of `known` of their host, if there is one (hosts in `host` and `own`, null being a host).

    Pages are never dealt out by host: a list of a checked size is broadcast, a larger one is copied to every salt
    and the pages are dealt out by host and salt, so that a host with a third of all pages is SALTS parts.
    """
    list_ = [c for c in known.columns if c != own][0]
    if (known.agg(F.sum(F.size(list_))).first()[0] or 0) <= BROADCAST_LINES:
        return pages.join(F.broadcast(known), F.col(host).eqNullSafe(F.col(own)), "left")
    dealt = pages.withColumn(salt, F.monotonically_increasing_id() % SALTS)
    copies = known.withColumn(salt + "2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    same = F.col(host).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(salt + "2"))
    return dealt.join(copies, same, "left").drop(salt, salt + "2")


def drop_boilerplate(pages: DataFrame, text: Column, host: Column, ratio: float = RATIO,
                     into: str = "text", stats: bool = False, least_pages: int = MIN_PAGES_WITH) -> DataFrame:
    """`pages` with column `into`: the text without its host's boilerplate lines.

    Lines are cut at \\n and compared exactly; lines without a word always stay. With `stats` also
    n_lines, n_dropped. A null host is a site of its own; a null text stays null and is a
    page without lines; repeated rows are pages of their own. Lines on fewer than `least_pages` pages stay, and so does a line
    on just `ratio` of the pages; the size of a host plays no other part. Very long texts are whole rows like others, an empty
    table stays empty. Other columns stay; helper columns have names the table cannot hold.
    """
    spare = "_site"
    while any(c.startswith(spare) for c in pages.columns):
        spare += "_"
    key, list_, text_ = spare + "k", spare + "l", spare + "t"
    known = stage_table(boilerplate(pages, text, host, ratio, least_pages).select(
        F.col("host").alias(key + "2"), F.col("common_lines").alias(list_)), "site-lines")
    joined = _with_lists(pages.withColumn(text_, text).withColumn(key, host), known, key, key + "2", spare + "s")
    common = F.coalesce(F.col(list_), F.array().cast("array<string>"))
    kept = F.filter(_lines(F.col(text_)), lambda x: ~(_has_word(x) & F.array_contains(common, _digest(x))))
    slim = F.when(F.size(common) == 0, F.col(text_)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(into, slim)
    if stats:
        lines = F.when(F.col(text_).isNull(), 0).otherwise(F.size(_lines(F.col(text_))))
        left = F.when(F.size(common) == 0, lines).otherwise(F.when(F.col(text_).isNull(), 0).otherwise(F.size(kept)))
        out = out.withColumns({"n_lines": lines.cast("bigint"), "n_dropped": (lines - left).cast("bigint")})
    return out.drop(key, key + "2", list_, text_)
