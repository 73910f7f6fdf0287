"""The operators of this subpackage as queries over the given tables, and in SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentigrid.llm.chat import control_case, format_conversations, read_back
from sentigrid.llm.common import table
from sentigrid.llm.decontaminate import leaks
from sentigrid.llm.gru_lm import score_texts
from sentigrid.llm.language_id import identify_languages
from sentigrid.llm.mixing import mix
from sentigrid.llm.quality import quality_metrics
from sentigrid.llm.ranked_search import (
    IMPACT_SCALE, LENGTH_SHARE, SATURATION, TERM, WEIGHT_SCALE, ranked_search)
from sentigrid.llm.secrets import find_secrets
from sentigrid.llm.simhash import near_duplicates
from sentigrid.llm.site_lines import (
    _BLOCK, _GONE, MIN_PAGES_WITH, RATIO, drop_boilerplate, html_lines, url_host)
from sentigrid.llm.suffixes import remove_repeats
from sentigrid.llm.token_alignment import align_corpus
from sentigrid.llm.toxicity import score_toxicity, train


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(table(spark, folder, "documents"))
    hex_ = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return out.select("doc_id", hex_.alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), with_kept=False)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_toxicity(docs, train(docs, table(spark, folder, "labels")))


def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(control_case(spark))))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_layers", "n_oversize")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    q = quality_metrics(table(spark, folder, "documents").select("doc_id", "text"))
    return q.select("doc_id", *(f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio",
        "n_chunks", "n_bad_chunks")))


def op10_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    host = url_host(F.col("url"))
    out = drop_boilerplate(pages.select("page_id", "url", "html"), html_lines(F.col("html")), host, stats=True)
    return out.select("page_id", url_host(F.col("url")).alias("host"), "n_lines", "n_dropped",
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = align_corpus(table(spark, folder, "documents"))
    return documents


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_mix, op3_decontaminate, op4_suffixes, op5_toxicity, op6_language_model, op7_chat,
    op8_secrets, op9_quality, op10_site_lines, op11_ranked_search, op12_language_id, op13_token_alignment)}

# The two runs of page lines: as in site_lines, with the patterns as text.
_PAGE_LINES = f"""
page AS (
    SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
        string_split(regexp_replace(regexp_replace(regexp_replace(html, '{_GONE}', chr(10), 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls
    FROM pages
),
line AS (
    SELECT page_id, host, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM page
),
host_total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
common AS (
    SELECT line.host, l FROM line JOIN host_total t ON line.host IS NOT DISTINCT FROM t.host
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
    GROUP BY line.host, l, t.pages
    HAVING count(DISTINCT page_id) >= {MIN_PAGES_WITH} AND count(DISTINCT page_id) > {RATIO} * t.pages
)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')"

ORACLES: dict[str, str] = {
    "op10_site_lines": f"""
WITH {_PAGE_LINES},
kept AS (
    SELECT line.page_id, string_agg(CASE WHEN c.l IS NULL THEN line.l END, chr(10) ORDER BY i) AS body,
        count(*) AS n_lines, count(c.l) AS n_dropped
    FROM line LEFT JOIN common c ON line.host IS NOT DISTINCT FROM c.host AND line.l = c.l
    GROUP BY line.page_id
)
SELECT p.page_id, p.host, k.n_lines, k.n_dropped, md5(coalesce(body, '')) AS text_md5
FROM page p JOIN kept k USING (page_id)
""",
    "op11_ranked_search": f"""
WITH word AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
weight AS (
    SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, total GROUP BY term, docs
),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * (({IMPACT_SCALE} * tf) // ({WEIGHT_SCALE} * tf + {SATURATION} * (
        100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // words)))) AS BIGINT) AS score
    FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total
    GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank
    FROM scored WHERE score > 0)
WHERE rank <= 10
""",
}
