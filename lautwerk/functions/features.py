"""Phonetic features of graphemes: table, distance, displacement, segmentation, syllables.

The table is built by rule from a chart (places and manners of consonants,
heights and depths of vowels) and from diacritics that add a feature.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The consonant chart, voiceless then voiced of each place; '-' where there is none.
PLACES = ("bilabial", "labiodental", "dental", "alveolar", "postalveolar", "retroflex", "palatal", "velar", "uvular", "pharyngeal", "glottal")
CHART = {
    "stop": "p b - - - - t d - - ʈ ɖ c ɟ k ɡ q ɢ - - ʔ -",
    "nasal": "- m - ɱ - - - n - - - ɳ - ɲ - ŋ - ɴ - - - -",
    "trill": "- ʙ - - - - - r - - - - - - - - - ʀ - - - -",
    "tap": "- - - ⱱ - - - ɾ - - - ɽ - - - - - - - - - -",
    "fricative": "ɸ β f v θ ð s z ʃ ʒ ʂ ʐ ç ʝ x ɣ χ ʁ ħ ʕ h ɦ",
    "approximant": "- - - ʋ - - - ɹ - - - ɻ - j - ɰ - - - - - -",
    "lateral": "- - - - - - - l - - - ɭ - ʎ - ʟ - - - - - -",
    "affricate": "- - pf - tθ dð ts dz tʃ dʒ ʈʂ ɖʐ tɕ dʑ kx - - - - - - -",
}
EXTRA = {"g": "ɡ", "w": ("approximant", "bilabial", "velar", "voiced"), "ɥ": ("approximant", "bilabial", "palatal", "voiced"), "ɬ": ("fricative", "lateral", "alveolar", "voiceless"), "ɮ": ("fricative", "lateral", "alveolar", "voiced"), "ɕ": ("fricative", "palatal", "sibilant", "voiceless"), "ʑ": ("fricative", "palatal", "sibilant", "voiced")}
# Vowels, front, central and back, unrounded then rounded, by height.
HEIGHTS = {
    "close": "i y ɨ ʉ ɯ u", "near_close": "ɪ ʏ - - - ʊ", "close_mid": "e ø ɘ ɵ ɤ o", "mid": "- - ə - - -",
    "open_mid": "ɛ œ ɜ ɞ ʌ ɔ", "near_open": "æ - ɐ - - -", "open": "a ɶ ä - ɑ ɒ",
}
# What a mark adds.
MARKS = {"ʰ": "aspirated", "ʷ": "labialized", "ʲ": "palatalized", "ˠ": "velarized", "ˤ": "pharyngealized", "ː": "long", "̃": "nasalized", "ⁿ": "prenasalized", "ʼ": "ejective", "̥": "devoiced", "̩": "syllabic", "̯": "nonsyllabic", "͡": ""}
TONES = frozenset("¹²³⁴⁵⁰⁶⁷⁸⁹˥˦˧˨˩")
#: Sonority by manner, loudest last.
SONORITY = (("stop", 1), ("affricate", 1), ("click", 1), ("implosive", 1), ("fricative", 2), ("nasal", 3), ("lateral", 4), ("trill", 4), ("tap", 4), ("approximant", 5), ("vowel", 6))
UNKNOWN = 3


@lru_cache(maxsize=1)
def table() -> dict[str, frozenset[str]]:
    out: dict[str, frozenset[str]] = {}
    for manner, row in CHART.items():
        for k, g in enumerate(row.split()):
            if g != "-":
                voice = "voiced" if k % 2 else "voiceless"
                sibilant = {"sibilant"} if manner in ("fricative", "affricate") and PLACES[k // 2] in ("alveolar", "postalveolar", "retroflex") else set()
                out[g] = frozenset({"consonant", manner, PLACES[k // 2], voice} | sibilant)
    for height, row in HEIGHTS.items():
        for k, g in enumerate(row.split()):
            if g != "-":
                out[g] = frozenset({"vowel", height, ("front", "central", "back")[k // 2], "rounded" if k % 2 else "unrounded", "voiced", "syllabic"})
    for g, kinds in EXTRA.items():
        out[g] = out[kinds] if isinstance(kinds, str) else frozenset({"consonant", *kinds})
    return out


@lru_cache(maxsize=65536)
def features(grapheme: str) -> frozenset[str]:
    """Features of a grapheme, marks included; none if its base is unknown."""
    base, added = "", set()
    for c in unicodedata.normalize("NFD", grapheme):
        if c in MARKS:
            added.add(MARKS[c])
        else:
            base += c
    known = table().get(unicodedata.normalize("NFC", base)) or table().get(base)
    if known is None:
        return frozenset()
    if "devoiced" in added:
        known = known - {"voiced"} | {"voiceless"}
    return frozenset(known | added) - {""}


@lru_cache(maxsize=262144)
def distance(a: str, b: str) -> float:
    """Share of features that two graphemes don't have in common: symmetric, 0 for the same one."""
    if a == b:
        return 0.0
    x, y = features(a), features(b)
    if not x or not y:
        return 1.0
    return len(x ^ y) / len(x | y)


def displacement(a: str, b: str) -> list[tuple[str, str, str]]:
    x, y = features(a), features(b)
    return [(f, "present", "absent") for f in sorted(x - y)] + [(f, "absent", "present") for f in sorted(y - x)]


def diagnose(grapheme: str) -> tuple[str, str, str]:
    """(status, longest readable prefix, first character that can't be read)."""
    if features(grapheme):
        return "ok", grapheme, ""
    for k in range(len(grapheme) - 1, 0, -1):
        if features(grapheme[:k]):
            return "partial", grapheme[:k], grapheme[k]
    return "unknown", "", grapheme[:1]


def segment(word: str) -> list[str]:
    """Graphemes of a word by longest match of the table, marks joined to what they follow; tie bars bind."""
    text, out, k = unicodedata.normalize("NFC", word), [], 0
    known = table()
    while k < len(text):
        tied = k + 2 < len(text) and text[k + 1] == "͡"
        size = 3 if tied else next((n for n in (3, 2, 1) if text[k : k + n] in known), 1)
        end = k + size
        while end < len(text) and (text[end] in MARKS or unicodedata.combining(text[end]) or text[end] in TONES):
            end += 1
        out.append(text[k:end])
        k = end
    return out


def segment_word(word: str) -> list[str]:
    """Graphemes of a word that may hold stress marks: cut at them, each piece segmented, the mark put on the piece's first vowel."""
    out: list[str] = []
    mark = ""
    for piece in re.split("([ˈˌ])", word):
        if piece in ("ˈ", "ˌ"):
            mark = piece
            continue
        own = segment(piece)
        if mark and own:
            at = next((k for k, g in enumerate(own) if "vowel" in features(g.rstrip("".join(TONES)))), 0)
            own[at] = mark + own[at]
            mark = ""
        out += own
    return out


def sonority(grapheme: str) -> int:
    """By manner: a lateral approximant is a liquid, a lateral fricative a fricative; 3 for what isn't known."""
    own = features(grapheme)
    if "lateral" in own and "fricative" in own:
        return 2
    return next((v for name, v in reversed(SONORITY) if name in own), UNKNOWN)


def is_syllabic(grapheme: str) -> bool:
    return "syllabic" in features(grapheme)


def nuclei(scores: list[int], syllabic: list[bool] | None = None) -> list[int]:
    """Syllabic segments, vowels, and strict peaks from liquids up; without any, the first of the loudest segments."""
    n = len(scores)
    out = []
    for k, s in enumerate(scores):
        peak = s >= 4 and (k == 0 or scores[k - 1] < s) and (k == n - 1 or scores[k + 1] < s)
        if s >= 6 or peak or (syllabic is not None and syllabic[k]):
            out.append(k)
    if not out and n:
        out = [max(range(n), key=lambda k: (scores[k], -k))]
    return out


def syllable_breaks(graphemes: list[str], given: list[int] | None = None) -> list[int]:
    """Indices that start a syllable after the first; those that are given, if any are.

    Else an onset is as large as sonority doesn't fall towards the nucleus.
    """
    if given:
        return sorted({b for b in given if 0 < b < len(graphemes)})
    scores = [sonority(g) for g in graphemes]
    tops = nuclei(scores, [is_syllabic(g) for g in graphemes])
    out = []
    for a, b in zip(tops, tops[1:]):
        at = b
        while at - 1 > a and (at == b or scores[at - 1] <= scores[at]):
            at -= 1
        out.append(at)
    return out
