"""The queries of the catalog as plain SQL, written independently of the Spark plans.

Each statement is assembled from named common table expressions. Word lists, patterns and
parameters are shared with the Spark side, since they are inputs rather than logic.
"""

from __future__ import annotations

from sentigrid.catalog.queries import ALPHA, SEQUENCE_LENGTH
from sentigrid.config import Training
from sentigrid.functions import lexicon as lx
from sentigrid.functions import stemming as st
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.operators import abbreviations as ab
from sentigrid.operators import analysis as an
from sentigrid.sources.tables import NULL_TEXT

ORACLES: dict[str, str] = {}
_PARTS: dict[str, tuple[list[str], str]] = {}


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_lit(w) for w in words) + "]"


def _replace(expression: str, pattern: str, replacement: str) -> str:
    target = replacement.replace("$", "\\")
    return f"regexp_replace({expression}, {_lit(pattern)}, {_lit(target)}, 'g')"


def _part(name: str, needs: str, sql: str) -> None:
    _PARTS[name] = (needs.split(), sql)


def _sql(needs: str, select: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in _PARTS[name][0]:
                add(other)
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in order) + "\n" + select


def _oracle(name: str, needs: str, select: str) -> None:
    ORACLES[name] = _sql(needs, select)


# --- labels -------------------------------------------------------------------------------

def _score(lexicon: lx.Lexicon, side: str) -> str:
    return " + ".join(f"CASE WHEN contains(l, {_lit(t)}) THEN {w} ELSE 0 END" for t, w in lexicon.side(side))


def _matches(lexicon: lx.Lexicon, side: str) -> str:
    terms = [t for t, w in lexicon.side(side) for _ in range(w)]
    return f"array_to_string(list_filter({_list(terms)}, lambda t: contains(l, t)), ', ')"


_LABEL = "CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END"


def _label_parts(name: str, lexicon: lx.Lexicon) -> None:
    _part(f"{name}_scores", "", f"""
        SELECT doc_id, text, l, CAST({_score(lexicon, 'positive')} AS INT) AS pos,
               CAST({_score(lexicon, 'negative')} AS INT) AS neg
        FROM (SELECT doc_id, text, lower(text) AS l FROM documents)""")
    _part(name, f"{name}_scores", f"SELECT doc_id, text, {_LABEL} AS label FROM {name}_scores")


_label_parts("labelled", lx.EXTENDED)
_label_parts("compact", lx.COMPACT)

_NAME = ("CASE {0} WHEN 'negative' THEN 'Negative' WHEN 'neutral' THEN 'Neutral' "
         "WHEN 'positive' THEN 'Positive' ELSE 'Neutral' END")

# --- text ------------------------------------------------------------------------------------


def _clean(text: str) -> str:
    bare = _replace(_replace(text, tx.URL, ""), tx.MENTION_OR_HASHTAG, "")
    return f"trim({_replace(bare, tx.SPACE_OR_NON_ASCII, ' ')})"


def _tokens(text: str) -> str:
    spaced = f"concat({_replace(text, f'[{tx.ODD_SPACE}]', ' ')}, ' ')"
    for pattern, replacement in tx.OPENING_QUOTE_STEPS + tx.PLAIN_STEPS + tx.CLOSING_QUOTE_STEPS:
        spaced = _replace(spaced, pattern, replacement)
    return f"list_filter(string_split_regex({spaced}, ' +'), lambda t: t <> '')"


def _no_stopwords(tokens: str) -> str:
    return (f"list_filter({tokens}, lambda t: NOT list_contains({_list(stoplists.DEFAULT)}, t) "
            f"AND instr({_lit(tx.ASCII_PUNCTUATION)}, t) = 0)")


def _words_only(tokens: str, words) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({_list(words)}, t))"


def _count_words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, {_lit(f'[{tx.SPACE}]+')}), lambda t: t <> ''))"


def _text_parts(prefix: str, source: str) -> None:
    _part(f"{prefix}_cleaned", "", f"SELECT doc_id, text, {_clean('text')} AS cleaned FROM ({source})")
    _part(f"{prefix}_tokens", f"{prefix}_cleaned",
          f"SELECT doc_id, text, cleaned, {_tokens('lower(cleaned)')} AS tokens FROM {prefix}_cleaned")
    _part(f"{prefix}_kept", f"{prefix}_tokens",
          f"SELECT doc_id, text, cleaned, tokens, {_no_stopwords('tokens')} AS kept FROM {prefix}_tokens")
    _part(f"{prefix}_clean", f"{prefix}_kept",
          f"SELECT doc_id, text, array_to_string(kept, ' ') AS clean, len(kept) AS n_kept FROM {prefix}_kept")
    _part(f"{prefix}_tf", f"{prefix}_clean", f"""
        SELECT doc_id, term, count(*) AS tf FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(clean), {_lit(tx.FEATURE_TERM)})) AS term
            FROM {prefix}_clean) GROUP BY doc_id, term""")


_MESSAGES = "SELECT concat(conv_id, ':', turn) AS doc_id, text FROM conversations WHERE text IS NOT NULL"
_text_parts("d", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
_text_parts("m", _MESSAGES)
_part("prepared", "labelled d_clean",
      "SELECT doc_id, label, clean, n_kept FROM d_clean JOIN labelled USING (doc_id)")

# --- splits -------------------------------------------------------------------------------------


def _quotas(sizes: str, share: float) -> str:
    """(label, total, quota): rows of a part per class, by largest remainder, from (label, total)."""
    return f"""SELECT label, total, floor_n + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(floor_n) OVER ()
                      THEN 1 ELSE 0 END AS quota
        FROM (SELECT *, (total * wanted) // everything AS floor_n, (total * wanted) % everything AS rest FROM (
            SELECT *, CAST(greatest(least(ceil(round(everything * {share!r}, 9)), everything - 1), 0) AS BIGINT) AS wanted
            FROM (SELECT label, total, CAST(sum(total) OVER () AS BIGINT) AS everything FROM ({sizes}))))"""


def _split_parts(prefix: str, labels: str) -> None:
    config = Training()
    adjusted = config.validation_share / (1 - config.test_ratio)
    _part(f"{prefix}ranked", labels, f"""
        SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('{config.seed}:', doc_id)), doc_id) AS place
        FROM {labels}""")
    _part(f"{prefix}tested", labels, _quotas(f"SELECT label, count(*) AS total FROM {labels} GROUP BY label", config.test_ratio))
    _part(f"{prefix}checked", f"{prefix}tested",
          _quotas(f"SELECT label, CAST(total - quota AS BIGINT) AS total FROM {prefix}tested", adjusted))
    _part(f"{prefix}split", f"{prefix}ranked {prefix}tested", f"""
        SELECT doc_id, label, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
        FROM {prefix}ranked JOIN {prefix}tested USING (label)""")
    _part(f"{prefix}split3", f"{prefix}ranked {prefix}tested {prefix}checked", f"""
        SELECT doc_id, r.label, CASE WHEN place <= t.quota THEN 'test'
               WHEN place <= t.quota + v.quota THEN 'val' ELSE 'train' END AS split
        FROM {prefix}ranked r JOIN {prefix}tested t ON t.label = r.label JOIN {prefix}checked v ON v.label = r.label""")


_split_parts("", "labelled")

# --- features and model ---------------------------------------------------------------------------


def _model_parts(prefix: str, split: str, tf: str, fit_rows: str = "") -> None:
    """Vocabulary, weights, sums, classes, priors of a labelled set of term counts."""
    fit = f"SELECT * FROM {tf} WHERE doc_id IN (SELECT doc_id FROM {split} {fit_rows})"
    size = f"(SELECT count(*) FROM {split} {fit_rows})"
    _part(f"{prefix}vocab", f"{tf} {split}", f"""
        SELECT term, CAST(row_number() OVER (ORDER BY total_tf DESC, term) - 1 AS INT) AS term_idx, df, total_tf,
               ln((1 + {size}) / (1.0::DOUBLE + df)) + 1 AS idf
        FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM ({fit}) GROUP BY term)
        ORDER BY total_tf DESC, term LIMIT {Training().max_features}""")
    _part(f"{prefix}weights", f"{prefix}vocab {tf} {split}", f"""
        SELECT doc_id, label, split, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w
        FROM {tf} JOIN {prefix}vocab USING (term) JOIN {split} USING (doc_id)""")
    _part(f"{prefix}sums", f"{prefix}weights", f"""
        SELECT label, term, sum(w) AS s FROM {prefix}weights WHERE split = 'train' GROUP BY label, term""")
    _part(f"{prefix}prior", split, f"""
        SELECT label, ln(count(*) / (SELECT count(*)::DOUBLE FROM {split} WHERE split = 'train')) AS log_prior
        FROM {split} WHERE split = 'train' GROUP BY label""")
    _part(f"{prefix}grid", f"{prefix}vocab {prefix}prior {prefix}sums", f"""
        SELECT label, term, coalesce(s, 0.0) AS s, sum(coalesce(s, 0.0)) OVER (PARTITION BY label) AS total,
               count(*) OVER (PARTITION BY label) AS v
        FROM (SELECT label, term FROM {prefix}vocab, {prefix}prior) LEFT JOIN {prefix}sums USING (label, term)""")


def _score_parts(name: str, theta: str, prior: str, weights: str, docs: str) -> None:
    """Scores, probabilities and prediction per document, `docs` giving every doc_id."""
    _part(f"{name}_scores", f"{theta} {prior} {weights} {docs}", f"""
        SELECT doc_id, label AS class, log_prior + coalesce(x, 0.0) AS score
        FROM (SELECT doc_id, p.label, log_prior FROM {docs} d, {prior} p)
        LEFT JOIN (SELECT doc_id, t.label, sum(w * theta) AS x
                   FROM {weights} JOIN {theta} t USING (term) GROUP BY doc_id, t.label) USING (doc_id, label)""")
    _part(f"{name}_proba", f"{name}_scores", f"""
        SELECT doc_id, class, score, e / sum(e) OVER (PARTITION BY doc_id) AS p,
               row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, class) AS place
        FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM {name}_scores)""")


_model_parts("", "split", "d_tf")


def _theta(name: str, alpha: float, prefix: str = "") -> None:
    _part(name, f"{prefix}grid", f"""
        SELECT label, term, ln((s + {alpha!r}::DOUBLE) / (total + {alpha!r}::DOUBLE * v)) AS theta FROM {prefix}grid""")


_theta("theta", ALPHA)
_theta("theta2", 2.0)
_part("w_only", "weights", "SELECT doc_id, term, w FROM weights")
_score_parts("s", "theta", "prior", "w_only", "split")
_score_parts("s2", "theta2", "prior", "w_only", "split")
_part("predicted", "s_proba split", """
    SELECT doc_id, split, label, class AS prediction, score, p FROM s_proba JOIN split USING (doc_id) WHERE place = 1""")
_part("predicted2", "s2_proba split", """
    SELECT doc_id, split, label, class AS prediction FROM s2_proba JOIN split USING (doc_id) WHERE place = 1""")
_part("test_rows", "predicted", "SELECT doc_id, label, prediction FROM predicted WHERE split = 'test'")
_part("test_rows2", "predicted2", "SELECT doc_id, label, prediction FROM predicted2 WHERE split = 'test'")
_part("m_weights", "m_tf vocab", """
    SELECT doc_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w
    FROM m_tf JOIN vocab USING (term)""")
_part("m_docs", "m_clean", f"SELECT doc_id FROM m_clean WHERE {_replace('text', f'[{tx.SPACE}]+', '')} <> ''")
_score_parts("m", "theta", "prior", "m_weights", "m_docs")


def _sweep_parts(prefix: str, split: str, val: str) -> None:
    _part(f"{prefix}sweep", f"{prefix}grid {prefix}prior {prefix}weights {split}", f"""
        WITH alphas AS (SELECT round(i * 0.1, 10)::DOUBLE AS alpha FROM range(1, 21) r(i)),
        theta_all AS (SELECT alpha, label, term, ln((s + alpha) / (total + alpha * v)) AS theta FROM {prefix}grid, alphas),
        parts AS (SELECT doc_id, t.label, alpha, sum(w * theta) AS x FROM {prefix}weights JOIN theta_all t USING (term)
                  GROUP BY doc_id, t.label, alpha),
        scores AS (SELECT d.doc_id, d.split, d.label AS truth, p.label, a.alpha, log_prior + coalesce(x, 0.0) AS score
                   FROM (SELECT doc_id, split, label FROM {split}) d CROSS JOIN {prefix}prior p CROSS JOIN alphas a
                   LEFT JOIN parts ON parts.doc_id = d.doc_id AND parts.label = p.label AND parts.alpha = a.alpha),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER
                 (PARTITION BY doc_id, alpha ORDER BY round(score, 9) DESC, label) = 1)
        SELECT alpha, avg(CASE WHEN label = truth THEN 1.0::DOUBLE ELSE 0 END) FILTER (split = 'train') AS train_score,
               avg(CASE WHEN label = truth THEN 1.0::DOUBLE ELSE 0 END) FILTER (split = '{val}') AS val_score
        FROM best GROUP BY alpha""")


_sweep_parts("", "split", "test")
_model_parts("u_", "split3", "d_tf", "WHERE split = 'train'")
_sweep_parts("u_", "split3", "val")
_part("marks", "", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label FROM labels JOIN documents USING (doc_id)")
_split_parts("t_", "marks")
_model_parts("t_", "t_split", "d_tf", "")
_sweep_parts("t_", "t_split", "test")

# --- statistics of words ----------------------------------------------------------------------------

_BASE = "CASE WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"
_part("cloud", "prepared", f"""
    SELECT doc_id, label, list_filter(list_transform(regexp_extract_all(clean, {_lit(an.CLOUD_WORD)}),
           lambda w: regexp_replace(w, '''[sS]$', '')), lambda w: NOT regexp_matches(w, '^\\p{{N}}+$')) AS ws
    FROM prepared""")


def _merged(item: str, source: str) -> str:
    base = _BASE.format(item)
    return f"""SELECT label, base, coalesce(max(CASE WHEN {item} = base THEN {item} END), max({item})) AS {item}, count(*) AS n
        FROM (SELECT label, {item}, {base} AS base FROM ({source})) GROUP BY label, base"""


_part("uni", "cloud", _merged("term", f"SELECT label, unnest({_words_only('ws', stoplists.ENGLISH)}) AS term FROM cloud"))
_STOP = _list(stoplists.ENGLISH)
_part("pairs", "cloud", _merged("phrase", f"""
    SELECT label, concat(a, ' ', b) AS phrase FROM (
        SELECT label, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM cloud WHERE len(ws) > 0)
    WHERE b IS NOT NULL AND NOT list_contains({_STOP}, a) AND NOT list_contains({_STOP}, b)"""))


def _ll(k: str, n: str, p: str) -> str:
    floor = repr(an.PROBABILITY_FLOOR)
    return f"(ln(greatest({p}, {floor})) * {k} + ln(greatest(1 - {p}, {floor})) * ({n} - {k}))"


_part("assoc", "uni pairs", f"""
    SELECT *, CASE WHEN total <= c1 OR total <= c2 THEN 0.0 ELSE
        -2 * ({_ll('c12', 'c1', 'p')} + {_ll('(c2 - c12)', '(total - c1)', 'p')}
              - {_ll('c12', 'c1', 'p1')} - {_ll('(c2 - c12)', '(total - c1)', 'p2')}) END AS score
    FROM (SELECT k.label, k.phrase, k.n AS c12, u.n AS c1, v.n AS c2, u.term AS word_1, v.term AS word_2, total,
                 v.n::DOUBLE / total AS p, k.n::DOUBLE / u.n AS p1, (v.n - k.n)::DOUBLE / nullif(total - u.n, 0) AS p2
          FROM (SELECT *, split_part(phrase, ' ', 1) AS a, split_part(phrase, ' ', 2) AS b FROM pairs) k
          JOIN uni u ON u.label = k.label AND u.base = {_BASE.format('k.a')}
          JOIN uni v ON v.label = k.label AND v.base = {_BASE.format('k.b')}
          JOIN (SELECT label, sum(n)::BIGINT AS total FROM uni GROUP BY label) t ON t.label = k.label)""")


def _top_terms(source: str) -> str:
    return f"""SELECT label, term, n, round(n::DOUBLE / max(n) OVER (PARTITION BY label), 6) AS relative
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS place FROM ({source}))
        WHERE place <= {an.CLOUD_WORDS}"""


_SPLIT_WORDS = f"list_filter(string_split_regex(clean, {_lit(f'[{tx.SPACE}]+')}), lambda t: t <> '')"
_part("class_words", "prepared", f"SELECT DISTINCT label, unnest({_SPLIT_WORDS}) AS term FROM prepared")
_part("m_words", "m_clean", f"SELECT DISTINCT doc_id, unnest({_SPLIT_WORDS}) AS term FROM m_clean")
_part("overlap", "class_words m_words", """
    SELECT doc_id, label, count(*) AS n_common, array_to_string(list_sort(list(term))[1:5], ', ') AS words
    FROM m_words JOIN class_words USING (term) GROUP BY doc_id, label""")

# --- measures --------------------------------------------------------------------------------------------


def _measure_parts(name: str, rows: str) -> None:
    _part(f"{name}_class", rows, f"""
        SELECT c AS label, tp, actual AS support, precision, recall,
               coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
        FROM (SELECT c, tp, actual, coalesce(tp / nullif(predicted::DOUBLE, 0), 0) AS precision,
                     coalesce(tp / nullif(actual::DOUBLE, 0), 0) AS recall
              FROM (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp,
                           count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS predicted
                    FROM {rows}, (SELECT label AS c FROM {rows} UNION SELECT prediction FROM {rows}) GROUP BY c))""")
    _part(f"{name}_weighted", f"{name}_class", f"""
        SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, sum(precision * support) / sum(support) AS precision,
               sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM {name}_class""")


_measure_parts("q", "test_rows")
_measure_parts("q2", "test_rows2")


def _report(digits: int) -> str:
    r = [f"round({m}, {digits}) AS {m}" for m in ("precision", "recall", "f1")]
    return f"""SELECT label AS "row", {', '.join(r)}, support::DOUBLE AS support FROM q_class
        UNION ALL SELECT 'accuracy', round(accuracy, {digits}), round(accuracy, {digits}), round(accuracy, {digits}), round(accuracy, {digits}) FROM q_weighted
        UNION ALL SELECT 'macro avg', round(avg(precision), {digits}), round(avg(recall), {digits}), round(avg(f1), {digits}), sum(support)::DOUBLE FROM q_class
        UNION ALL SELECT 'weighted avg', round(precision, {digits}), round(recall, {digits}), round(f1, {digits}),
                  (SELECT sum(support)::DOUBLE FROM q_class) FROM q_weighted"""


_part("confusion", "test_rows", """
    SELECT a.c AS label, b.c AS prediction, count(r.doc_id) AS n
    FROM (SELECT label AS c FROM test_rows UNION SELECT prediction FROM test_rows) a
    CROSS JOIN (SELECT label AS c FROM test_rows UNION SELECT prediction FROM test_rows) b
    LEFT JOIN test_rows r ON r.label = a.c AND r.prediction = b.c GROUP BY a.c, b.c""")
_part("report3", "q_class q_weighted", _report(3))


def _melt(weighted: str, model: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{m}' AS metric, round({m}, 6) AS value FROM {weighted}"
        for m in ("accuracy", "precision", "recall", "f1"))


_part("two_models", "q_weighted q2_weighted", f"{_melt('q_weighted', 'alpha_half')} UNION ALL {_melt('q2_weighted', 'alpha_two')}")

# --- the statements -----------------------------------------------------------------------------------------

_oracle("scan_parquet", "", "SELECT doc_id, lang, source, n_chars, text FROM documents")
_oracle("scan_csv", "", """
    SELECT conv_id, turn, text, CASE WHEN turn % 4 = 2 THEN NULL ELSE role END AS role
    FROM conversations WHERE role <> 'assistant'""")
_oracle("scan_csv_encodings", "", "SELECT doc_id, lang, text FROM documents")
_oracle("stringify_columns", "", f"""
    SELECT doc_id, coalesce(text, '{NULL_TEXT}') AS text, coalesce(lang, '{NULL_TEXT}') AS lang,
           CASE WHEN lang <> 'en' THEN coalesce(source, '{NULL_TEXT}') ELSE '{NULL_TEXT}' END AS note FROM documents""")
_oracle("write_results", "prepared", f"""
    SELECT doc_id, label, clean, CAST({_count_words('clean')} AS INT) AS word_count, {_NAME.format('label')} AS sentiment FROM prepared""")
ORACLES["with_derived"] = ORACLES["write_results"]
_oracle("save_and_load_model", "test_rows", "SELECT * FROM test_rows")
_oracle("select_text", "", "SELECT doc_id, text FROM documents")
_oracle("drop_null_text", "", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
_oracle("blank_text", "", f"""
    SELECT doc_id, CAST({_replace('text', f'[{tx.SPACE}]+', '')} = '' AS INT) AS blank, 1 AS gaps_blank FROM documents""")
_oracle("filter_by_label", "labelled", "SELECT doc_id, label, text FROM labelled WHERE label = 'negative'")
_oracle("require_min_classes", "labelled", """
    SELECT count(*) AS n_classes, min(n) AS smallest, max(n) AS largest, CAST(count(*) >= 2 AS INT) AS accepted
    FROM (SELECT label, count(*) AS n FROM labelled GROUP BY label)""")

_entries = ", ".join(f"({_lit(t)}, '{p}', {w})" for t, p, w in lx.EXTENDED.entries)
_oracle("lexicon_matches", "labelled_scores", f"""
    SELECT doc_id, term, polarity, CAST(weight AS INT) AS weight
    FROM labelled_scores LEFT JOIN (VALUES {_entries}) x(term, polarity, weight) ON contains(l, term)""")
_oracle("map_sentiment_name", "labelled", f"""
    SELECT doc_id, {_NAME.format("CASE WHEN lang = 'es' THEN 'unknown' ELSE label END")} AS sentiment
    FROM labelled JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
_oracle("stopword_anti_join", "d_tokens", f"""
    SELECT d.doc_id, count(k.t) AS n_kept, count(DISTINCT k.t) AS n_different
    FROM d_tokens d LEFT JOIN (
        SELECT doc_id, t FROM (SELECT doc_id, unnest(tokens) AS t FROM d_tokens)
        WHERE t NOT IN (SELECT unnest({_list(stoplists.DEFAULT)}))) k USING (doc_id) GROUP BY d.doc_id""")
_oracle("vocab_join", "m_tf vocab", "SELECT doc_id, term, tf FROM m_tf JOIN vocab USING (term)")
_oracle("class_vocab_overlap", "overlap", "SELECT * FROM overlap")
_oracle("write_bucketed", "test_rows", "SELECT doc_id, label, prediction FROM test_rows")
_oracle("predictions_vs_truth", "test_rows", "SELECT * FROM test_rows")

_shares = "SELECT {0}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM {1} GROUP BY 1"
_oracle("label_distribution", "labelled", _shares.format("label", "labelled"))
_oracle("sentiment_distribution", "labelled", _shares.format(_NAME.format("label") + " AS sentiment", "labelled"))
_oracle("label_distribution_compact", "compact", _shares.format("label", "compact"))
_oracle("word_count_stats", "d_clean", """
    SELECT round(avg(n_kept), 6) AS mean_words, CAST(min(n_kept) AS INT) AS min_words, CAST(max(n_kept) AS INT) AS max_words FROM d_clean""")
_oracle("row_count", "split3", "SELECT split, count(*) AS n FROM split3 GROUP BY split")
_oracle("word_count_histogram", "prepared", f"""
    SELECT label, bin, round(lo + bin * (hi - lo) / {an.HISTOGRAM_BINS}, 6) AS low,
           round(lo + (bin + 1) * (hi - lo) / {an.HISTOGRAM_BINS}, 6) AS high, count(p.doc_id) AS n
    FROM (SELECT DISTINCT label FROM prepared) l CROSS JOIN (SELECT i::INT AS bin FROM range({an.HISTOGRAM_BINS}) r(i)) b
    CROSS JOIN (SELECT min(n_kept)::DOUBLE AS lo, max(n_kept)::DOUBLE AS hi FROM prepared) e
    LEFT JOIN (SELECT doc_id, label, least({an.HISTOGRAM_BINS - 1}, floor((n_kept - (SELECT min(n_kept) FROM prepared)) * {an.HISTOGRAM_BINS}.0::DOUBLE
                 / (SELECT max(n_kept) - min(n_kept) FROM prepared)))::INT AS bin FROM prepared) p USING (label, bin)
    GROUP BY label, bin, lo, hi""")
_oracle("word_count_kde", "prepared", f"""
    SELECT label, point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - n_kept) / h, 2))) / (total * h * sqrt(2 * pi())), 9) AS density,
           round(sum(exp(-0.5 * pow((x - n_kept) / h, 2))) / (h * sqrt(2 * pi())) * (hi - lo) / {an.HISTOGRAM_BINS}, 6) AS curve
    FROM prepared JOIN (SELECT label, count(*) AS total, stddev_samp(n_kept) * pow(count(*), -0.2) AS h FROM prepared GROUP BY label) USING (label)
    CROSS JOIN (SELECT i::INT AS point, lo, hi, lo + i * (hi - lo) / {an.DENSITY_POINTS - 1} AS x
                FROM range({an.DENSITY_POINTS}) r(i), (SELECT min(n_kept)::DOUBLE AS lo, max(n_kept)::DOUBLE AS hi FROM prepared))
    WHERE h > 0 GROUP BY label, point, x, h, total, lo, hi""")
_oracle("term_frequency_by_label", "uni", _top_terms("SELECT label, term, n FROM uni"))
_oracle("bigram_collocations", "assoc", f"""
    SELECT label, phrase, c12 AS n, c1, c2, round(score, 4) AS score FROM assoc WHERE score > {an.COLLOCATION_THRESHOLD}""")
_accepted = f"(SELECT * FROM assoc WHERE score > {an.COLLOCATION_THRESHOLD})"
_oracle("word_cloud", "uni assoc", _top_terms(f"""
    SELECT label, term, sum(n)::BIGINT AS n FROM (
        SELECT label, term, n FROM uni UNION ALL SELECT label, phrase, c12 FROM {_accepted}
        UNION ALL SELECT label, word_1, -c12 FROM {_accepted} UNION ALL SELECT label, word_2, -c12 FROM {_accepted})
    GROUP BY label, term HAVING sum(n) > 0"""))
_oracle("confusion_matrix", "confusion", "SELECT * FROM confusion")
_oracle("accuracy", "q_weighted", "SELECT round(accuracy, 6) AS accuracy FROM q_weighted")
_oracle("weighted_prf", "q_weighted", """
    SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q_weighted""")
_oracle("classification_report", "q_class q_weighted", _report(4))
_oracle("metric_union", "two_models", "SELECT model, metric, value FROM two_models")
_oracle("model_comparison", "two_models", """
    SELECT metric, max(value) FILTER (model = 'alpha_half') AS alpha_half, max(value) FILTER (model = 'alpha_two') AS alpha_two
    FROM two_models GROUP BY metric""")
_oracle("history_summary", "sweep", """
    SELECT round(1 - max_by(train_score, alpha), 6) AS final_train_loss, round(1 - max_by(val_score, alpha), 6) AS final_val_loss,
           round(max_by(val_score, alpha), 6) AS final_val_accuracy, round(max(val_score), 6) AS best_val_accuracy FROM sweep""")
_oracle("mean_loss", "s_proba split", """
    SELECT split, round(avg(-ln(p)), 6) AS loss FROM s_proba JOIN split USING (doc_id) WHERE class = label GROUP BY split""")
_oracle("document_frequency", "d_tf", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM d_tf GROUP BY term")
_oracle("class_term_sums", "sums", "SELECT label, term, round(s, 6) AS weight_sum FROM sums")
_oracle("stratified_split", "split", "SELECT * FROM split")
_oracle("three_way_split", "split3", "SELECT * FROM split3")
_oracle("top_features_per_doc", "weights", """
    SELECT doc_id, term, round(w, 6) AS weight, CAST(place AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS place FROM weights) WHERE place <= 10""")
_oracle("vocab_rank", "vocab", "SELECT term, term_idx, total_tf FROM vocab")
_oracle("percent_of_total", "", """
    SELECT lang, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent_of_all,
           round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::DOUBLE AS percent_of_lang
    FROM documents GROUP BY lang, source""")
_oracle("preview", "", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10")
_oracle("random_sample", "", "SELECT doc_id, text FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 1")
_oracle("argmax_alpha", "sweep", """
    SELECT alpha, round(train_score, 6) AS train_score, round(val_score, 6) AS val_score FROM sweep ORDER BY sweep.val_score DESC, alpha LIMIT 1""")
_oracle("argmax_class", "predicted", "SELECT doc_id, prediction FROM predicted")
_oracle("count_desc", "labelled", "SELECT label, count(*) AS n FROM labelled GROUP BY label")
_oracle("word_intersection", "class_words m_words", """
    SELECT label, term FROM class_words WHERE term IN (SELECT term FROM m_words)""")
_oracle("distinct_labels", "labelled", "SELECT DISTINCT label FROM labelled")
_oracle("auto_label_compact", "compact", "SELECT doc_id, label FROM compact")
_oracle("auto_label_extended", "labelled_scores", f"""
    SELECT doc_id, pos AS positive_score, neg AS negative_score, {_LABEL} AS label FROM labelled_scores""")
_oracle("auto_label_builtin", "labelled", "SELECT doc_id, label FROM labelled")
_oracle("explain_label", "labelled_scores", f"""
    SELECT doc_id, substring(text, 1, 100) AS preview, {_matches(lx.EXTENDED, 'positive')} AS positive_matches,
           {_matches(lx.EXTENDED, 'negative')} AS negative_matches, pos AS positive_score, neg AS negative_score, {_LABEL} AS label
    FROM labelled_scores""")
_oracle("clean_noise", "d_cleaned", "SELECT doc_id, cleaned AS clean FROM d_cleaned")
_oracle("decode_bytes", "", "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE concat(' ', text) END AS text FROM documents")
_oracle("case_fold", "", "SELECT doc_id, lower(text) AS folded FROM documents")
_oracle("tokenize", "d_tokens", "SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INT) AS n_tokens FROM d_tokens")
_oracle("remove_stopwords", "d_clean", "SELECT doc_id, clean AS kept FROM d_clean")
_oracle("full_preparation", "d_clean", "SELECT doc_id, clean FROM d_clean")
_oracle("preparation_trace", "d_kept", """
    SELECT doc_id, 0 AS step_no, 'original' AS step, text AS result FROM d_kept
    UNION ALL SELECT doc_id, 1, 'noise_cleaning', cleaned FROM d_kept
    UNION ALL SELECT doc_id, 2, 'case_folding', lower(cleaned) FROM d_kept
    UNION ALL SELECT doc_id, 3, 'tokenization', array_to_string(tokens, ' ') FROM d_kept
    UNION ALL SELECT doc_id, 4, 'stopword_removal', array_to_string(kept, ' ') FROM d_kept
    UNION ALL SELECT doc_id, 5, 'final', array_to_string(kept, ' ') FROM d_kept""")
_bare = f"translate(lower(text), {_lit(tx.ASCII_PUNCTUATION)}, '')"
_oracle("preprocess_text", "", f"""
    SELECT doc_id, array_to_string({_words_only(_tokens(_bare), stoplists.DEFAULT)}, ' ') AS clean FROM documents""")
_oracle("word_count", "", f"SELECT doc_id, CAST({_count_words('text')} AS INT) AS word_count FROM documents")
_oracle("text_lengths", "d_clean", """
    SELECT doc_id, CAST(length(text) AS INT) AS text_length, CAST(length(clean) AS INT) AS clean_length, CAST(n_kept AS INT) AS words FROM d_clean""")
_oracle("title_case_label", "labelled", "SELECT doc_id, concat(upper(label[1]), label[2:]) AS shown FROM labelled")
_oracle("softmax", "", """
    SELECT vec_id, round(max(e / total), 6) AS largest, round(min(e / total), 6) AS smallest, round(sum(e / total), 6) AS total
    FROM (SELECT vec_id, e, sum(e) OVER (PARTITION BY vec_id) AS total
          FROM (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e
                FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings))) GROUP BY vec_id""")
_oracle("format_percent", "predicted", """
    SELECT doc_id, round(100.0 * round(p, 9), 1) AS confidence FROM predicted WHERE split = 'test'""")
_oracle("tfidf_terms", "d_tf", "SELECT doc_id, term, tf FROM d_tf")
_oracle("tfidf_fit", "vocab", "SELECT term, term_idx, df, total_tf, round(idf, 6) AS idf FROM vocab")
_oracle("tfidf_transform", "weights", "SELECT doc_id, term, tf, round(w, 6) AS weight FROM weights")
_oracle("label_encode", "labelled", """
    SELECT doc_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS label_idx, label AS decoded FROM labelled""")
_oracle("label_decode", "labelled", "SELECT doc_id, label FROM labelled")
_oracle("nb_fit", "theta", "SELECT label, term, round(theta, 6) AS theta FROM theta")
_oracle("nb_prior", "prior", "SELECT label, round(log_prior, 6) AS log_prior FROM prior")
_oracle("nb_predict", "predicted", "SELECT doc_id, split, label, prediction, round(score, 6) AS score FROM predicted")
_by_class = ", ".join(f"round(max(p) FILTER (class = '{c}'), 6) AS p_{c}" for c in ("negative", "neutral", "positive"))
_oracle("nb_predict_proba", "s_proba", f"SELECT doc_id, {_by_class} FROM s_proba GROUP BY doc_id")
_rounded_history = "SELECT round(alpha, 6) AS alpha, round(train_score, 6) AS train_score, round(val_score, 6) AS val_score FROM {0}"
_oracle("nb_alpha_sweep", "sweep", _rounded_history.format("sweep"))
_oracle("nb_alpha_sweep_unseen", "u_sweep", _rounded_history.format("u_sweep"))
_oracle("nb_toxic", "t_sweep", _rounded_history.format("t_sweep"))
_oracle("encode_sequences", "d_clean vocab labelled", f"""
    SELECT doc_id, label_idx,
           array_to_string(list_concat([2], ids, [3], list_transform(range({SEQUENCE_LENGTH - 2} - len(ids)), lambda i: 0)), ' ') AS input_ids,
           array_to_string(list_concat(list_transform(range(len(ids) + 2), lambda i: 1),
                                       list_transform(range({SEQUENCE_LENGTH - 2} - len(ids)), lambda i: 0)), ' ') AS attention_mask
    FROM (SELECT l.doc_id, CAST(l.label_idx AS INT) AS label_idx, coalesce(ids, []::INT[])[1:{SEQUENCE_LENGTH - 2}] AS ids
          FROM (SELECT doc_id, dense_rank() OVER (ORDER BY label) - 1 AS label_idx FROM labelled) l
          LEFT JOIN (SELECT doc_id, list(coalesce(term_idx + 4, 1) ORDER BY seq) AS ids
                     FROM (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS seq
                           FROM (SELECT doc_id, regexp_extract_all(lower(clean), {_lit(tx.FEATURE_TERM)}) AS ts FROM d_clean))
                     LEFT JOIN vocab USING (term) GROUP BY doc_id) USING (doc_id))""")
_oracle("evaluate", "report3 confusion", " UNION ALL ".join(
    f"""SELECT 'report' AS section, "row", '{m}' AS measure, {m} AS value FROM report3""" for m in ("precision", "recall", "f1", "support"))
    + " UNION ALL SELECT 'confusion', label, prediction, n::DOUBLE FROM confusion")
_score_select = f"""
    SELECT m.doc_id, prediction, CASE WHEN prediction IS NOT NULL THEN {_NAME.format("prediction")} END AS sentiment, p_negative, p_neutral, p_positive
    FROM (SELECT concat(conv_id, ':', turn) AS doc_id FROM conversations) m
    LEFT JOIN (SELECT doc_id, max(class) FILTER (place = 1) AS prediction, {_by_class} FROM m_proba GROUP BY doc_id) USING (doc_id)"""
_oracle("score_text", "m_proba", _score_select)
_oracle("score_stream", "m_proba", _score_select)
_oracle("score_explain", "m_proba m_clean m_weights overlap labelled", """
    SELECT c.doc_id, p.class AS label, CAST(length(text) AS INT) AS text_length, CAST(length(clean) AS INT) AS clean_length,
           CAST(n_kept AS INT) AS words_in_text, b.prediction, round(p.p, 6) AS p, t.training_rows, round(t.training_percent, 6) AS training_percent, f.features, round(f.weights, 6) AS weights, o.n_common, o.words
    FROM m_clean c LEFT JOIN m_proba p USING (doc_id)
    LEFT JOIN (SELECT doc_id, class AS prediction FROM m_proba WHERE place = 1) b USING (doc_id)
    LEFT JOIN (SELECT label, count(*) AS training_rows, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS training_percent FROM labelled GROUP BY label) t ON t.label = p.class
    LEFT JOIN (SELECT doc_id, array_to_string(list(term ORDER BY place), ', ') AS features, sum(w) AS weights FROM (
                   SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS place FROM m_weights)
               WHERE place <= 10 GROUP BY doc_id) f USING (doc_id)
    LEFT JOIN overlap o ON o.doc_id = p.doc_id AND o.label = p.class""")

# --- word tables -----------------------------------------------------------------------------------------

_TYPE = _lit(tx.WORD_TYPE)
_part("abbreviated", "", "SELECT doc_id, replace(text, ' und ', ' u. ') AS text FROM documents WHERE text IS NOT NULL")
_part("types", "abbreviated", f"""
    SELECT regexp_extract(w, {_TYPE}, 1) AS term, CASE WHEN regexp_extract(w, {_TYPE}, 2) = '.' THEN 1 ELSE 0 END AS period
    FROM (SELECT regexp_extract(unnest(string_split_regex(lower(text), {_lit(f'[{tx.SPACE}]+')})), {_TYPE}, 0) AS w FROM abbreviated)
    WHERE regexp_matches(w, '\\p{{L}}')""")
_part("abbreviation_scores", "types", f"""
    SELECT term, n_with, n_without, 2 * (n_with * (ln({ab.PERIOD_RATE}::DOUBLE) - ln(rate))
               + n_without * (ln(1 - {ab.PERIOD_RATE}::DOUBLE) - ln(1 - rate)))
           * exp(-letters) * (length(term) - letters + 1) * pow(letters::DOUBLE, -n_without) AS score
    FROM (SELECT term, sum(period)::BIGINT AS n_with, sum(1 - period)::BIGINT AS n_without,
                 length(replace(term, '.', '')) AS letters FROM types GROUP BY term),
         (SELECT sum(period)::DOUBLE / count(*) AS rate FROM types)
    WHERE n_with > 0""")
_part("abbreviations", "abbreviation_scores", f"SELECT * FROM abbreviation_scores WHERE score >= {ab.THRESHOLD}")
_oracle("abbreviations", "abbreviations", "SELECT term, n_with, n_without, round(score, 6) AS score FROM abbreviations")
_oracle("tokenize_abbreviations", "abbreviations abbreviated", f"""
    SELECT doc_id, array_to_string(list_transform({_tokens('marked')}, lambda t: replace(t, chr(57344), '.')), ' ') AS tokens FROM (
        SELECT doc_id, array_to_string(list_transform(ws, lambda w, i: CASE
            WHEN i < len(ws) AND w LIKE '%.' AND list_contains(known, regexp_extract(w, {_TYPE}, 1))
            THEN concat(left(w, length(w) - 1), chr(57344)) ELSE w END), ' ') AS marked
        FROM (SELECT doc_id, string_split(lower({_clean('text')}), ' ') AS ws FROM abbreviated),
             (SELECT coalesce(list(term), []) AS known FROM abbreviations))""")
_part("message_stems", "m_tokens", """
    SELECT DISTINCT token, left(token, 5) AS stem FROM (SELECT unnest(tokens) AS token FROM m_tokens) WHERE length(token) > 5""")
_part("stop_table", "m_tokens", f"""
    SELECT term FROM (SELECT unnest(list_distinct(tokens)) AS term FROM m_tokens) GROUP BY term
    HAVING count(*) * 10 > (SELECT count(*) FROM m_tokens) UNION SELECT unnest({_list(stoplists.DEFAULT)})""")


def _reassembled(words: str, name: str) -> str:
    """The words of (doc_id, i, w) joined in order; texts without words stay."""
    return f"""SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS {name}
        FROM d_tokens d LEFT JOIN ({words}) x ON d.doc_id = x.doc_id GROUP BY d.doc_id"""


_part("d_words", "d_tokens", "SELECT doc_id, unnest(tokens) AS w, unnest(range(len(tokens))) AS i FROM d_tokens")
_part("d_unlisted", "d_words stop_table", f"""
    SELECT * FROM d_words WHERE w NOT IN (SELECT term FROM stop_table) AND instr({_lit(tx.ASCII_PUNCTUATION)}, w) = 0""")
_oracle("stem_by_table", "d_words message_stems", _reassembled(
    "SELECT doc_id, i, coalesce(stem, w) AS w FROM d_words LEFT JOIN message_stems ON w = token", "stems"))
_oracle("stopwords_by_table", "d_unlisted", _reassembled("SELECT * FROM d_unlisted", "kept"))
_oracle("full_preparation_by_tables", "d_unlisted message_stems", _reassembled(
    "SELECT doc_id, i, coalesce(stem, w) AS w FROM d_unlisted LEFT JOIN message_stems ON w = token", "clean"))
_entries = ", ".join(f"({_lit(t)}, {_lit(p)}, {w})" for t, p, w in lx.EXTENDED.entries)
_part("lexicon_table", "", f"""
    SELECT term, polarity, sum(weight)::BIGINT AS weight FROM (
        SELECT * FROM (VALUES {_entries}) e(term, polarity, weight) UNION ALL
        SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'positive' ELSE 'negative' END, 1
        FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS term FROM benchmark) WHERE length(term) > 5)
    GROUP BY term, polarity""")
_part("table_matches", "lexicon_table", """
    SELECT doc_id, term, polarity, weight FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL)
    JOIN lexicon_table ON contains(l, term)""")
_oracle("lexicon_matches_by_table", "table_matches", "SELECT * FROM table_matches")
_oracle("label_by_table", "table_matches", f"""
    SELECT doc_id, pos AS positive_score, neg AS negative_score, {_LABEL} AS label FROM (
        SELECT d.doc_id, coalesce(sum(weight) FILTER (polarity = 'positive'), 0)::BIGINT AS pos,
               coalesce(sum(weight) FILTER (polarity = 'negative'), 0)::BIGINT AS neg
        FROM documents d LEFT JOIN table_matches USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id)""")

# --- stems: the published rules step by step over the different tokens --------------------------------


def _shape(word: str) -> str:
    """V or C per letter; a y is V after C. Each round settles the first open y of a run."""
    shape = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    for _ in range(3):
        shape = f"regexp_replace(regexp_replace({shape}, 'Cy', 'CV', 'g'), '(^|V)y', '\\1C', 'g')"
    return shape


def _measure(word: str) -> str:
    return f"len(regexp_extract_all({_shape(word)}, 'V+C+'))"


def _closed(word: str) -> str:
    shape = _shape(word)
    return f"((ends_with({shape}, 'CVC') AND right({word}, 1) NOT IN ('w', 'x', 'y')) OR {shape} = 'VC')"


def _suffix_rules(word: str, spec: str) -> str:
    rules = sorted((tuple((item + ":").split(":")[:2]) for item in spec.split()), key=lambda r: -len(r[0]))
    cases = " ".join(
        f"WHEN ends_with({word}, '{old}') THEN CASE WHEN {_measure(f'left({word}, -{len(old)})')} > 0 "
        f"THEN concat(left({word}, -{len(old)}), '{new}') ELSE {word} END" for old, new in rules)
    return f"CASE {cases} ELSE {word} END"


def _after_suffix(stem: str, word: str) -> str:
    """What a removed -ed or -ing leaves."""
    doubled = f"(length({stem}) > 1 AND right({stem}, 1) = left(right({stem}, 2), 1) AND ends_with({_shape(stem)}, 'C'))"
    return f"""CASE WHEN NOT contains({_shape(stem)}, 'V') THEN {word}
        WHEN regexp_matches({stem}, '(at|bl|iz)$') THEN concat({stem}, 'e')
        WHEN {doubled} THEN CASE WHEN right({stem}, 1) IN ('l', 's', 'z') THEN {stem} ELSE left({stem}, -1) END
        WHEN {_measure(stem)} = 1 AND {_closed(stem)} THEN concat({stem}, 'e') ELSE {stem} END"""


_residue = " ".join(
    f"WHEN ends_with(w, '{x}') THEN CASE WHEN {_measure(f'left(w, -{len(x)})')} > 1"
    + (" AND regexp_matches(left(w, -3), '[st]$')" if x == "ion" else "") + f" THEN left(w, -{len(x)}) ELSE w END"
    for x in sorted(st.STEP_4.split(), key=lambda x: -len(x)))
_STEM_STEPS = [
    """CASE WHEN ends_with(w, 'ies') THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END
        WHEN ends_with(w, 'sses') THEN left(w, -2)
        WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END""",
    f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END
        WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END
        WHEN ends_with(w, 'ed') THEN {_after_suffix('left(w, -2)', 'w')}
        WHEN ends_with(w, 'ing') THEN {_after_suffix('left(w, -3)', 'w')} ELSE w END""",
    f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with(left({_shape('w')}, -1), 'C') THEN concat(left(w, -1), 'i') ELSE w END",
    f"CASE WHEN ends_with(w, 'alli') AND {_measure('left(w, -4)')} > 0 THEN left(w, -2) ELSE w END",
    f"""CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {_measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END
        ELSE {_suffix_rules('w', st.STEP_2)} END""",
    _suffix_rules("w", st.STEP_3),
    f"CASE {_residue} ELSE w END",
    f"""CASE WHEN ends_with(w, 'e') AND ({_measure('left(w, -1)')} > 1 OR ({_measure('left(w, -1)')} = 1 AND NOT {_closed('left(w, -1)')}))
        THEN left(w, -1) ELSE w END""",
    f"CASE WHEN ends_with(w, 'll') AND {_measure('left(w, -1)')} > 1 THEN left(w, -1) ELSE w END",
]
_stepped = "SELECT DISTINCT w AS token, lower(w) AS w FROM d_words"
for _step in _STEM_STEPS:
    _stepped = f"SELECT token, {_step} AS w FROM ({_stepped})"
_irregular = " ".join(f"WHEN {_lit(a)} THEN {_lit(b)}" for a, b in st.IRREGULAR.items())
_part("porter", "d_words", f"""
    SELECT token, CASE lower(token) {_irregular} ELSE CASE WHEN length(token) <= 2 THEN lower(token) ELSE w END END AS stem
    FROM ({_stepped})""")
_oracle("stem_dictionary", "porter", "SELECT token, stem FROM porter")
_oracle("stem", "d_words porter", _reassembled(
    "SELECT doc_id, i, stem AS w FROM d_words JOIN porter ON w = token", "stems"))
_oracle("full_preparation_compact", "d_words porter", _reassembled(f"""
    SELECT doc_id, i, stem AS w FROM d_words JOIN porter ON w = token
    WHERE w NOT IN (SELECT unnest({_list(stoplists.DEFAULT)})) AND instr({_lit(tx.ASCII_PUNCTUATION)}, w) = 0""", "clean"))
_part("hashed", "d_kept", """
    SELECT doc_id, place, sum(sign)::INT AS n FROM (
        SELECT doc_id, ('0x' || left(h, 7))::BIGINT % 64 AS place, CASE WHEN substr(h, 8, 1) < '8' THEN 1 ELSE -1 END AS sign
        FROM (SELECT doc_id, md5(unnest(kept)) AS h FROM d_kept)) GROUP BY doc_id, place""")
_oracle("embed_documents", "hashed d_kept", """
    SELECT d.doc_id, string_agg(coalesce(n, 0)::VARCHAR, ' ' ORDER BY i) AS counts, count(*) FILTER (n <> 0)::INT AS filled,
           CASE WHEN max(abs(n)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
    FROM d_kept d CROSS JOIN (SELECT i FROM range(64) r(i)) LEFT JOIN hashed h ON h.doc_id = d.doc_id AND h.place = i GROUP BY d.doc_id""")
