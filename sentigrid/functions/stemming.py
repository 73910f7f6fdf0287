"""English suffix stripping (Porter, 1980) on Arrow batches of token lists.

The variant with the usual published extensions: a small list of irregular forms, words of
one or two letters left alone, and the later suffix corrections ('ies', 'ied', 'alli',
'fulli', 'logi', final y).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: irregular forms and suffix rules -------------------------------------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e "
    "ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble fulli:ful"
)
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
# --- end of fixed values ----------------------------------------------------------------


def _rules(spec: str) -> list[tuple[str, str]]:
    """'suffix:replacement' pairs, longest suffix first."""
    pairs = [tuple((item + ":").split(":")[:2]) for item in spec.split()]
    return sorted(pairs, key=lambda pair: -len(pair[0]))


_STEP_2, _STEP_3, _STEP_4 = _rules(STEP_2), _rules(STEP_3), _rules(STEP_4)


def _shape(word: str) -> str:
    """One 'v' or 'c' per letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(re.findall("v+c+", _shape(stem)))


def _closed_syllable(stem: str) -> bool:
    """Ends consonant-vowel-consonant (the last not w, x or y), or is a vowel plus a consonant."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed_syllable(stem) else stem
    return word


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        return word[:-1] + "i"
    return word


def _derivational(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derivational(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, _STEP_2)


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, replacement in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + replacement if _measure(stem) > 0 else word
    return word


def _residual(word: str) -> str:
    for suffix, _ in _STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if allowed else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _closed_syllable(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past_and_progressive, _final_y, _derivational):
        word = step(word)
    return _tidy(_residual(_swap(word, _STEP_3)))


def stem_tokens(tokens: Column) -> Column:
    """Stems an array<string> column; each distinct token of an Arrow batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def stem_lists(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([porter_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        flat = stems.take(coded.indices)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, flat, mask=lists.is_null())

    return stem_lists(tokens)
