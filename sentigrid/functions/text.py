"""Text preparation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.config import Preprocess
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions.binding import let
from sentigrid.functions.stemming import porter_stem, stem_tokens
from sentigrid.functions.words import ascii_terms, word_steps, word_tokens

# --- fixed values: character classes and patterns ---------------------------------------
# Unicode whitespace and word characters are spelled out, because regex engines disagree
# on what \s and \w cover.
ODD_SPACE = (r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
             r"\x{202f}\x{205f}\x{3000}")
SPACE = rf"\x20{ODD_SPACE}"
WORD = r"\p{L}\p{N}_"
URL = rf"(?:http|www)[^{SPACE}]+"
MENTION_OR_HASHTAG = rf"[@#][{WORD}]+"
SPACE_OR_NON_ASCII = r"[\t-\r\x1c-\x20\x{80}-\x{10FFFF}]+"
FEATURE_TERM = rf"[{WORD}]{{2,}}"
# a word's last run of letters, digits and inner periods, and the period after it
WORD_TYPE = rf"([{WORD}][{WORD}.]*?)(\.?)[^{WORD}.]*$"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# --- end of fixed values ----------------------------------------------------------------


def decode_bytes(raw: Column) -> Column:
    """UTF-8 text of a binary column; bytes that are not valid UTF-8 are dropped.

    A genuine U+FFFD in the input is kept: it is escaped with U+E000 while the replacement marks of the
    invalid bytes are removed, and a genuine U+E000 is escaped first, so nothing is taken for an escape.
    """
    text = raw.cast("string")
    mark, escape = "\ufffd", "\ue000"
    for_mark, for_escape = F.lit(escape + "\ue001"), F.lit(escape + "\ue002")
    escaped = F.replace(F.replace(text, F.lit(escape), for_escape), F.lit(mark), for_mark)
    repaired = F.replace(F.make_valid_utf8(escaped), F.lit(mark), F.lit(""))
    restored = F.replace(F.replace(repaired, for_mark, F.lit(mark)), for_escape, F.lit(escape))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but whitespace."""
    return text.isNull() | ~text.rlike(f"[^{SPACE}]")


def _bare_text(text: Column) -> Column:
    """Without links, mentions and hashtags; a text that can have none is spared the regexes."""
    no_links = let(text, lambda t: F.when(
        t.contains("http") | t.contains("www"), F.regexp_replace(t, URL, "")).otherwise(t))
    return let(no_links, lambda t: F.when(
        t.contains("@") | t.contains("#"), F.regexp_replace(t, MENTION_OR_HASHTAG, "")).otherwise(t))


def clean_noise(text: Column) -> Column:
    """Drops links, mentions and hashtags; other non-ASCII and whitespace runs become one space."""
    return F.trim(F.regexp_replace(_bare_text(text), SPACE_OR_NON_ASCII, " "))


def case_fold(text: Column) -> Column:
    return F.lower(text)


# Penn Treebank tokenisation as (pattern, replacement) steps, in order. Each step is plain
# regular syntax (no look-around), so that SQL engines can run the same chain. A period counts
# as final before whitespace or the end of the text. The first and the last group can only
# match where a quotation mark is present.
OPENING_QUOTE_STEPS: list[tuple[str, str]] = [
    (r"([«“‘„]|`+)", r" $1 "),
    (r"(^|[ (\[{<])(?:\"|'')", r"$1 `` "),
    (r"'([a-ce-lo-ru-zA-CE-LO-RU-Z0-9_])\b", r"' $1"),
]
PLAIN_STEPS: list[tuple[str, str]] = [
    (r"([^. ])\.([\])}>\"'»”’]*)(\s|$)", r"$1 . $2$3"),
    (r"([:,])([^0-9]|$)", r" $1 $2"),
    (r"\.{2,}|--|[;@#$%&?!*\]\[(){}<>»”’]", r" $0 "),
    (r"(?i)\b(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta))\b", r" $1$3$5$7 $2$4$6$8 "),
]
CLOSING_QUOTE_STEPS: list[tuple[str, str]] = [
    (r"([^'])' ", r"$1 ' "),
    (r"\"|''", r" '' "),
    (r"([^' ])('[sSmMdD]|') ", r"$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"$1 $2 "),
    (r"(?i)\b(?:(d)('ye)|(more)('n))\b", r" $1$3 $2$4 "),
    (r"(?i) ('t)(is|was)\b", r" $1 $2 "),
]
ANY_QUOTE = r"[\"'`«“‘„]"


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _where_quoted(text: Column, steps: list[tuple[str, str]]) -> Column:
    """The steps for texts with a quotation mark; all others skip their regexes."""
    return let(text, lambda t: F.when(t.rlike(ANY_QUOTE), _apply(t, steps)).otherwise(t))


# stands for the period of an abbreviation while a text is tokenized
_KEPT_PERIOD = "\ue000"


def _keep_periods(text: Column, known: Column) -> Column:
    """The text with the final periods of known abbreviations marked, but for the last word."""
    def marked(words: Column) -> Column:
        def mark(word: Column, i: Column) -> Column:
            held = (i < F.size(words) - 1) & word.endswith(".") & F.array_contains(
                known, F.regexp_extract(F.lower(word), WORD_TYPE, 1))
            return F.when(held, F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit(_KEPT_PERIOD))).otherwise(word)

        return F.array_join(F.transform(words, mark), " ")

    return let(F.split(F.rtrim(text), " "), marked)


def tokenize(text: Column, plain_spaces: bool = False, abbreviations: Column | None = None) -> Column:
    """Word tokens: punctuation, clitics (n't, 's) and ellipses stand alone.

    `plain_spaces` says that the text holds no whitespace but the space (as after clean_noise). `abbreviations`, an
    array<string> of lower-cased words without their final period, names words whose period ends no sentence and stays.
    """
    if not plain_spaces:
        text = F.regexp_replace(text, f"[{ODD_SPACE}]", " ")
    if abbreviations is not None:
        text = F.when(F.size(abbreviations) > 0, _keep_periods(text, abbreviations)).otherwise(text)
    spaced = _where_quoted(F.concat(text, F.lit(" ")), OPENING_QUOTE_STEPS)
    spaced = _where_quoted(_apply(spaced, PLAIN_STEPS), CLOSING_QUOTE_STEPS)
    tokens = non_empty(F.split(spaced, " +"))
    if abbreviations is None:
        return tokens
    return F.transform(tokens, lambda t: F.replace(t, F.lit(_KEPT_PERIOD), F.lit(".")))


def non_empty(tokens: Column) -> Column:
    return F.array_remove(tokens, "")


def remove_stopwords(tokens: Column, words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """Drops stopwords, and tokens that are a piece of the ASCII punctuation string."""
    return F.filter(
        tokens, lambda t: ~t.isin(*words) & (F.instr(F.lit(ASCII_PUNCTUATION), t) == 0)
    )


def drop_words(tokens: Column, words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """Drops stopwords only."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def prepare_tokens(text: Column, options: Preprocess = Preprocess.extended(),
                   words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """Tokens after the switched-on steps: noise, case, tokens, stopwords, stems."""
    if options.clean:
        return _prepared_words(text, options, words, joined=False)
    tokens = tokenize(case_fold(text))
    if options.stopwords:
        tokens = remove_stopwords(tokens, words)
    return stem_tokens(tokens) if options.stem else tokens


def _prepared_words(text: Column, options: Preprocess, words: Sequence[str], joined: bool, terms: bool = False) -> Column:
    """The steps behind noise cleaning, which leaves ASCII words: each different word goes through them once."""
    steps = (*((p, r, True) for p, r in OPENING_QUOTE_STEPS), *((p, r, False) for p, r in PLAIN_STEPS),
             *((p, r, True) for p, r in CLOSING_QUOTE_STEPS))
    quote, dropped = ANY_QUOTE, (frozenset(words), ASCII_PUNCTUATION) if options.stopwords else None
    stem = porter_stem if options.stem else None
    return word_tokens(_bare_text(text), lambda: word_steps(steps, quote, dropped, stem, terms), joined)


def cleaned_tokens(text: Column) -> Column:
    """The lower-cased tokens of a text without its noise."""
    return prepare_tokens(text, Preprocess(clean=True, stopwords=False, stem=False))


def full_pipeline(text: Column, options: Preprocess = Preprocess.extended(),
                  words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """The prepared tokens joined by single spaces."""
    if options.clean:
        return _prepared_words(text, options, words, joined=True)
    return F.array_join(prepare_tokens(text, options, words), " ")


def preprocess_text(text: Column, stopwords: bool = True, stem: bool = True,
                    words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """The other preparation: lower, delete ASCII punctuation, tokens; null becomes ''."""
    bare = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    tokens = tokenize(bare)
    if stopwords:
        tokens = drop_words(tokens, words)
    if stem:
        tokens = stem_tokens(tokens)
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, 0 for empty text."""
    return F.size(non_empty(F.split(text, f"[{SPACE}]+")))


def feature_terms(clean: Column) -> Column:
    """The terms that become features: lower-cased runs of two or more word characters."""
    lowered = F.lower(clean)
    # in ASCII the pattern's words are those of \w; other texts have no runs there
    return F.coalesce(ascii_terms(lowered), F.regexp_extract_all(lowered, F.lit(FEATURE_TERM), F.lit(0)))


def term_text(text: Column, options: Preprocess = Preprocess.extended(),
              words: Sequence[str] = stoplists.DEFAULT) -> Column:
    """The feature terms of a raw text after the switched-on steps, joined by single spaces: one value a text instead of one a term."""
    if options.clean:
        return _prepared_words(text, options, words, joined=True, terms=True)
    return F.array_join(feature_terms(full_pipeline(text, options, words)), " ")


def title_case(label: Column) -> Column:
    return F.initcap(label)


def trace_steps(df: DataFrame, options: Preprocess = Preprocess.extended(),
                words: Sequence[str] = stoplists.DEFAULT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Result of every preparation step, long: (id, step_no, step, result).

    Switched-off steps are left out and the numbers stay consecutive. Token lists are shown
    joined by single spaces.
    """
    steps = [("original", F.col(text_col))]
    wide = df.select(id_col, F.col(text_col).alias("s0"))
    current = "s0"

    def push(frame: DataFrame, step: str, value: Column, shown=None) -> tuple[DataFrame, str]:
        name = f"s{len(steps)}"
        steps.append((step, (shown or (lambda c: c))(F.col(name))))
        return frame.withColumn(name, value), name

    def joined(tokens: Column) -> Column:
        return F.array_join(tokens, " ")

    if options.clean:
        wide, current = push(wide, "noise_cleaning", clean_noise(F.col(current)))
    wide, current = push(wide, "case_folding", case_fold(F.col(current)))
    wide, current = push(wide, "tokenization", tokenize(F.col(current), plain_spaces=options.clean), joined)
    if options.stopwords:
        wide, current = push(wide, "stopword_removal", remove_stopwords(F.col(current), words), joined)
    if options.stem:
        wide, current = push(wide, "stemming", stem_tokens(F.col(current)), joined)
    steps.append(("final", joined(F.col(current))))

    rows = F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                 (F.col("s0") if i == 0 else value).alias("result"))
        for i, (name, value) in enumerate(steps)
    ])
    return wide.select(id_col, F.inline(rows))
