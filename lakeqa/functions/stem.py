"""English suffix stripping (the published Porter rules with the usual extensions) as columns.

It is a vocabulary job: it runs once per distinct term, not once per token. ``stem_vocabulary`` does it
for a relation of terms, ``stem_words`` inside a task for the distinct words of a batch.
"""

import re
from functools import lru_cache

from pyspark.sql import DataFrame

# Irregular words and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Suffix rules; the first suffix that fits decides, whether or not it may be replaced.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
DOUBLE_SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
ENDINGS = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
REMOVED = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

# Letter groups. y is a vowel after a consonant. A word is [C](VC)^m[V].
_FIRST_VOWELS = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
_CONSONANTS = "[^aeiou][^aeiouy]*"
_VOWELS = "[aeiouy][aeiou]*"
HAS_VOWEL = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
MEASURE_OVER_0 = _FIRST_VOWELS + _CONSONANTS
MEASURE_OVER_1 = _FIRST_VOWELS + _CONSONANTS + _VOWELS + _CONSONANTS
MEASURE_IS_1 = _FIRST_VOWELS + _CONSONANTS + "(?:" + _VOWELS + ")?$"
SHORT = "^(?:[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]|[aeiou][^aeiou])$"


# The steps are SQL text over the column ``w`` (and ``rest``): one parse per step.


def _cut(word: str, num_letters: int) -> str:
    return f"left({word}, length({word}) - {num_letters})"


def _like(word: str, pattern: str) -> str:
    return f"{word} rlike r'{pattern}'"


def _rules(table, measure=None, also=None) -> str:
    """The first rule whose suffix fits: replaced if the rest is long enough, else kept as it is."""
    cases = []
    for suffix, replacement in table:
        rest = _cut("w", len(suffix))
        conditions = [_like(rest, p) for p in (measure, (also or {}).get(suffix)) if p]
        changed = f"concat({rest}, '{replacement}')"
        kept = f"if({' and '.join(conditions)}, {changed}, w)" if conditions else changed
        cases.append(f"when endswith(w, '{suffix}') then {kept}")
    return f"case {' '.join(cases)} else w end"


_PLURAL = f"case when endswith(w, 'ies') and length(w) = 4 then {_cut('w', 1)} else {_rules(PLURALS)} end"

# After -eed / -ied the word is settled; -ed / -ing words with a vowel before leave a rest to repair.
_SETTLED = f"""case
  when endswith(w, 'ied') then if(length(w) = 4, {_cut('w', 1)}, {_cut('w', 2)})
  when endswith(w, 'eed') then if({_like(_cut('w', 3), MEASURE_OVER_0)}, {_cut('w', 1)}, w) end"""
_REST = f"""case
  when endswith(w, 'ied') or endswith(w, 'eed') then null
  when endswith(w, 'ed') and {_like(_cut('w', 2), HAS_VOWEL)} then {_cut('w', 2)}
  when endswith(w, 'ing') and {_like(_cut('w', 3), HAS_VOWEL)} then {_cut('w', 3)} end"""
_REPAIRED = f"""case
  when rest is null then w
  when {_like('rest', '(?:at|bl|iz)$')} then concat(rest, 'e')
  when length(rest) >= 2 and right(rest, 1) = left(right(rest, 2), 1) and not {_like('rest', '[aeiouy]$')}
    then if({_like('rest', '[lsz]$')}, rest, {_cut('rest', 1)})
  when {_like('rest', MEASURE_IS_1)} and {_like('rest', SHORT)} then concat(rest, 'e')
  else rest end"""
_FINAL_Y = f"""if(length(w) > 2 and {_like('w', '[^aeiouy]y$|[aeiou]yy$')}, concat({_cut('w', 1)}, 'i'), w)"""
_ALLI = f"""if(endswith(w, 'alli') and {_like(_cut('w', 4), MEASURE_OVER_0)}, {_cut('w', 2)}, w)"""
_DOUBLE = f"""case
  when endswith(w, 'logi') then if({_like(_cut('w', 3), MEASURE_OVER_0)}, {_cut('w', 1)}, w)
  else {_rules(DOUBLE_SUFFIXES, MEASURE_OVER_0)} end"""
_ENDING = _rules(ENDINGS, MEASURE_OVER_0)
_REMOVALS = [(suffix, "") for suffix in REMOVED]
_BEFORE_REMOVED = {"ion": "[st]$"}
_REMOVED = _rules(_REMOVALS, MEASURE_OVER_1, _BEFORE_REMOVED)
_FINAL_E = f"""if(endswith(w, 'e') and ({_like(_cut('w', 1), MEASURE_OVER_1)} or
  ({_like(_cut('w', 1), MEASURE_IS_1)} and not {_like(_cut('w', 1), SHORT)})), {_cut('w', 1)}, w)"""
_FINAL_LL = f"""if(endswith(w, 'll') and {_like(_cut('w', 1), MEASURE_OVER_1)}, {_cut('w', 1)}, w)"""
_IRREGULAR = "case term " + " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR.items()) + " end"


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, normal)`` for a relation of distinct terms; each step is its own projection."""
    steps = terms.selectExpr("term", "lower(term) as w").selectExpr("term", f"{_PLURAL} as w")
    steps = steps.selectExpr("term", f"coalesce({_SETTLED}, w) as w", f"{_REST} as rest")
    steps = steps.selectExpr("term", f"{_REPAIRED} as w")
    for step in (_FINAL_Y, _ALLI, _DOUBLE, _ENDING, _REMOVED, _FINAL_E, _FINAL_LL):
        steps = steps.selectExpr("term", f"{step} as w")
    return steps.selectExpr(
        "term", f"coalesce({_IRREGULAR}, if(length(term) <= 2, lower(term), w)) as normal"
    )


@lru_cache(maxsize=256)
def _pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _has(word: str, pattern: str) -> bool:
    return _pattern(pattern).search(word) is not None


def _replace(word: str, table, measure=None, also=None) -> str:
    for suffix, replacement in table:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            wanted = (measure, (also or {}).get(suffix))
            return rest + replacement if all(_has(rest, p) for p in wanted if p) else word
    return word


def _repair(rest: str) -> str:
    """What is left of a word without -ed or -ing."""
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) >= 2 and rest[-1] == rest[-2] and rest[-1] not in "aeiouy":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _has(rest, MEASURE_IS_1) and _has(rest, SHORT) else rest


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _has(word[:-3], MEASURE_OVER_0) else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has(word[: -len(suffix)], HAS_VOWEL):
            return _repair(word[: -len(suffix)])
    return word


def _stem(term: str) -> str:
    if term in IRREGULAR:
        return IRREGULAR[term]
    word = term.lower()
    if len(term) <= 2:
        return word
    word = _past(word[:-1] if word.endswith("ies") and len(word) == 4 else _replace(word, PLURALS))
    if len(word) > 2 and _has(word, "[^aeiouy]y$|[aeiou]yy$"):
        word = word[:-1] + "i"
    if word.endswith("alli") and _has(word[:-4], MEASURE_OVER_0):
        word = word[:-2]
    if word.endswith("logi"):
        word = word[:-1] if _has(word[:-3], MEASURE_OVER_0) else word
    else:
        word = _replace(word, DOUBLE_SUFFIXES, MEASURE_OVER_0)
    word = _replace(word, ENDINGS, MEASURE_OVER_0)
    word = _replace(word, _REMOVALS, MEASURE_OVER_1, _BEFORE_REMOVED)
    if word.endswith("e"):
        rest = word[:-1]
        if _has(rest, MEASURE_OVER_1) or _has(rest, MEASURE_IS_1) and not _has(rest, SHORT):
            word = rest
    if word.endswith("ll") and _has(word[:-1], MEASURE_OVER_1):
        word = word[:-1]
    return word


def stem_words(words: list[str]) -> list[str]:
    """The normal form of each word, as ``stem_vocabulary`` gives it."""
    return [_stem(w) for w in words]
