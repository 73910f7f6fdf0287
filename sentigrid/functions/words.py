"""Word by word work on Arrow batches of texts.

The steps of the tokenizer look no further than a word and the spaces around it, so what they make of a word depends on the word
alone and, at the start of a text, on its having no space before it. Texts are cut at their spaces some megabytes at a time, in bulk;
of each such chunk's different words the plain ones pass, all others go through the steps once, and the results are taken by position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# words a task remembers at a time, and the longest that it remembers
MEMORY = 50_000
LONGEST = 64
# bytes of text that a task cuts into words at a time
CHUNK_BYTES = 1 << 20
# up to so many terms, texts without any of them are told apart in one go
FEW_TERMS = 500
# a step of the tokenizer puts these apart at the end of a word
_ENDS = frozenset(".,;:!?")
# words that a step of the tokenizer cuts in two
_CUT = frozenset(["cannot", "gimme", "lemme", "gonna", "wanna", "gotta"])


class Memo(dict):
    """Results by word, worked out when first asked for; emptied when it is full."""

    def __init__(self, make: Callable):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        made = self._make(key)
        if len(key) <= LONGEST:
            self[key] = made
        return made


def python_step(pattern: str, replacement: str) -> Callable[[str], str]:
    """A (pattern, replacement) step of ASCII text as the JVM runs it, where \\b, \\s and (?i) know ASCII only."""
    compiled, put = re.compile(pattern, re.ASCII), re.sub(r"\$(\d)", r"\\g<\1>", replacement)
    return lambda text: compiled.sub(put, text)


# of the bytes of a text: lower-cased letters, a space for white space and for the bytes of other characters than ASCII
_BARE = bytes(32 if c > 127 or c in b"\t\n\v\f\r\x1c\x1d\x1e\x1f" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c
              for c in range(256))


def chunks(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The texts in pieces of about `most` bytes (CHUNK_BYTES), one text at least."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (most or CHUNK_BYTES), "right")))
        yield texts.slice(start, stop - start)
        start = stop


def cut_words(texts: pa.Array, table: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of texts between spaces, one after the other, and where each text's words begin (one more than texts).

    `table` translates the bytes beforehand. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int64)
    raw = bytes(memoryview(data)[ends[0]:ends[-1]]) if data else b""
    raw = np.frombuffer(raw.translate(table) if table else raw, np.uint8)
    ends = ends - ends[0]
    solid = raw != 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(raw))]  # a text's end parts words as a space does
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[solid]))
    return words, np.searchsorted(starts, ends)


# white space beyond ASCII, and the bytes of a text with the white space of ASCII as spaces
_FAR_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACED = bytes(32 if c in b"\t\n\v\f\r\x1c\x1d\x1e\x1f" else c for c in range(256))


def cut_at_white_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As `cut_words`, between any white space."""
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, _FAR_SPACE, " ")
    return cut_words(texts, _SPACED)


def release() -> None:
    """Gives memory that is free back at the end of a task: Python workers stay, and others run beside them."""
    pa.default_memory_pool().release_unused()


def listed(words: pa.Array) -> list[str | None]:
    """The words as a list, several times as fast as by to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def row_of(begins: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(begins) - 1, dtype=np.int64), np.diff(begins))


def label_codes(labels: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different labels, null among them, and the position of each row's."""
    coded = labels.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] times, then from first[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def coded_pieces(texts: pa.Array, plain: np.ndarray, pieces: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces of the words of texts, all pieces in order as numbers into these, and where each text's begin.

    A word of ASCII letters and digits, not of digits alone, is its own piece; all others go through `pieces`, each different one once.
    Texts that are not `plain` are lists of pieces already, with spaces between them.
    """
    words, begins = cut_at_white_space(texts)
    coded = words.dictionary_encode()
    known, cells = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    whole = pc.and_not(pc.ascii_is_alnum(known), pc.ascii_is_decimal(known)).to_numpy(zero_copy_only=False)
    others = np.flatnonzero(~whole)
    made = [pieces(w) for w in listed(known.take(pa.array(others)))]
    more = np.fromiter(map(len, made), np.int64, len(made))
    # what the words stand for: first those of plain texts, then the same words in the other texts
    at, n = np.tile(np.arange(len(known)), 2), np.ones(2 * len(known), np.int64)
    at[others], n[others] = len(known) + np.cumsum(more) - more, more
    if not plain.all():
        cells = cells + np.where(plain, 0, len(known))[row_of(begins)]
    tokens = pa.concat_arrays([known, pa.array([t for ts in made for t in ts], known.type)]).dictionary_encode()
    counts = n[cells]
    found = tokens.indices.to_numpy(zero_copy_only=False)[_spread(at[cells], counts)]
    return tokens.dictionary, found, np.concatenate([[0], np.cumsum(counts)])[begins]


class WordSteps:
    """The tokens of a text from the steps (pattern, replacement, only for words with a `quote`).

    `dropped` says which tokens are left out, a set of words and a string whose pieces go; `stem` is put on the rest. With `terms`
    the runs of two or more letters, digits and underscores within the tokens are given in place of these.
    """

    def __init__(self, steps: Sequence[tuple[str, str, bool]], quote: str, dropped: tuple[frozenset[str], str] | None,
                 stem: Callable[[str], str] | None, terms: bool = False):
        self.steps = [(python_step(p, r), only) for p, r, only in steps]
        self.quote, self.runs = re.compile(quote), re.compile(r"\w{2,}", re.ASCII) if terms else None
        self.dropped, self.stem = dropped, stem
        self.special = _CUT | (dropped[0] if dropped else frozenset())
        self.first = Memo(lambda word: self.pieces(f"{word} "))
        self.inner = Memo(lambda word: self.pieces(f" {word} "))

    def pieces(self, spaced: str) -> list[str]:
        for step, only in self.steps:
            if not only or self.quote.search(spaced):
                spaced = step(spaced)
        tokens = spaced.split()
        if self.dropped:
            tokens = [t for t in tokens if t not in self.dropped[0] and t not in self.dropped[1]]
        tokens = [self.stem(t) for t in tokens] if self.stem else tokens
        return tokens if self.runs is None else [run for t in tokens for run in self.runs.findall(t)]

    def _without_mark(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The plain words among `words` that only a final mark, which is dropped, makes other than plain, without it, and which ones they are."""
        if self.stem is not None or (self.dropped is None and self.runs is None):
            return words.slice(0, 0), np.zeros(len(words), bool)
        bare = pc.ascii_rtrim(words, characters="".join(_ENDS))
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(bare)), 1)
        special = pc.is_in(bare, value_set=pa.array(sorted(self.special), pa.large_string()))
        marked = pc.and_(one, pc.and_not(pc.ascii_is_alnum(bare), special))
        return bare.filter(marked), marked.to_numpy(zero_copy_only=False)

    def _of_word(self, word: str) -> list[str]:
        if self.stem is None and word[-1] in _ENDS and (bare := word[:-1]).isalnum() and bare not in self.special:
            return [bare, word[-1]]
        return self.inner[word]

    def token_lists(self, texts: pa.Array) -> pa.Array:
        """list<string> of the tokens of the ASCII of texts, lower-cased; null stays null."""
        words, begins = cut_words(texts, _BARE)
        coded = words.dictionary_encode()
        known, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        plain = np.zeros(len(known), bool)
        if self.stem is None:
            special = pc.is_in(known, value_set=pa.array(sorted(self.special), pa.large_string()))
            plain = pc.and_not(pc.ascii_is_alnum(known), special).to_numpy(zero_copy_only=False)
        # results of the different words, of those without a final mark, then of the first words of the texts, which have no space before them
        begun = begins[:-1][begins[:-1] < begins[1:]]
        others = np.flatnonzero(~plain)
        bare, marked = self._without_mark(known.take(pa.array(others)))
        easy, others = others[marked], others[~marked]
        made = [self._of_word(w) for w in listed(known.take(pa.array(others)))]
        made += [self.first[w] for w in listed(words.take(pa.array(begun)))]
        more = np.fromiter(map(len, made), np.int64, len(made))
        places = len(known) + len(bare) + np.cumsum(more) - more
        at = np.concatenate([np.arange(len(known)), places[len(others):]])
        n = np.concatenate([np.ones(len(known), np.int64), more[len(others):]])
        if self.runs is not None:
            n[:len(known)] = pc.binary_length(known).to_numpy(zero_copy_only=False) > 1
        at[others], n[others] = places[:len(others)], more[:len(others)]
        at[easy] = len(known) + np.arange(len(bare))
        n[easy] = 1 if self.runs is None else pc.binary_length(bare).to_numpy(zero_copy_only=False) > 1
        tokens = pa.concat_arrays([known, bare, pa.array([t for ts in made for t in ts], pa.large_string())])
        codes = codes.astype(np.int64)
        codes[begun] = len(known) + np.arange(len(begun))
        counts = n[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])[begins]
        flat = tokens.take(pa.array(_spread(at[codes], counts))).cast(pa.string())
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=mask)


@lru_cache(maxsize=4)
def word_steps(steps: tuple[tuple[str, str, bool], ...], quote: str, dropped: tuple[frozenset[str], str] | None,
               stem: Callable[[str], str] | None, terms: bool) -> WordSteps:
    """The steps of a Python worker: it runs many tasks, which go on with the words that earlier ones have taken apart."""
    return WordSteps(steps, quote, dropped, stem, terms)


def word_tokens(text: Column, make: Callable[[], WordSteps], joined: bool) -> Column:
    """The tokens of a text as array<string>, or `joined` by spaces; null stays null."""
    kind = pa.string() if joined else pa.list_(pa.string())

    @F.arrow_udf("string" if joined else "array<string>")
    def prepare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        steps = make()

        def tokens(texts: pa.Array) -> pa.Array:
            lists = (steps.token_lists(chunk) for chunk in chunks(texts))
            parts = [pc.binary_join(x, " ") if joined else x for x in lists]
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        for texts in batches:
            yield tokens(texts)
        release()

    return prepare(F.make_valid_utf8(text))


def ascii_terms(text: Column) -> Column:
    """The runs of two or more letters, digits and underscores in an ASCII text, as array<string>; null for any other text."""
    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        runs = Memo(re.compile(r"\w{2,}", re.ASCII).findall)

        def terms(text: str) -> list[str]:
            out: list[str] = []
            for word in text.split():
                if not word.isalnum():
                    out += runs[word]
                elif len(word) > 1:
                    out.append(word)
            return out

        for texts in batches:
            yield pa.array((None if t is None or not t.isascii() else terms(t) for t in texts.to_pylist()), pa.list_(pa.string()))

    return find(F.make_valid_utf8(text))


def _finder(terms: Sequence[str]) -> Callable[[str], list[int]]:
    """Function from a text to the positions of the terms in it; the automaton's package is used where it is installed."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [i for i, term in enumerate(terms) if term in text]
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        places.setdefault(term, []).append(i)
    always = places.pop("", [])
    machine = ahocorasick.Automaton()
    for term, where in places.items():
        machine.add_word(term, where)
    if not places:
        return lambda text: list(always)
    machine.make_automaton()
    return lambda text: sorted({*always, *(i for _, where in machine.iter(text) for i in where)})


def _lowered(texts: pa.Array) -> pa.Array:
    """The texts lower-cased, those beyond ASCII one by one."""
    texts = texts.cast(pa.large_string())
    far = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
    one_by_one = pa.array([t.lower() for t in texts.filter(far).to_pylist()], pa.large_string())
    return pc.replace_with_mask(pc.ascii_lower(texts), far, one_by_one)


def term_positions(text: Column, terms: Sequence[str], fold: bool = False) -> Column:
    """Positions of the terms that occur anywhere in a text as array<int>, ascending; none in a null.

    `fold` lower-cases the text, for ASCII terms only: other letters may be folded by another table than that of the JVM.
    """
    if fold and not all(t.isascii() for t in terms):
        raise ValueError("only ASCII terms go with fold")
    terms = tuple(terms)

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder(terms)
        any_term = "|".join(map(re.escape, terms))
        def positions(texts: pa.Array) -> list[list[int]]:
            texts = _lowered(texts) if fold else texts
            if len(terms) <= FEW_TERMS:
                held = pc.fill_null(pc.match_substring_regex(texts, any_term), False).to_pylist()
            else:
                held = pc.is_valid(texts).to_pylist()
            return [finder(t.as_py()) if h else [] for t, h in zip(texts, held)]

        for batch in batches:
            yield pa.array([found for texts in chunks(batch) for found in positions(texts)], pa.list_(pa.int32()))
        release()

    return find(F.make_valid_utf8(text))
