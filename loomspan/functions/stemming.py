"""English words as full-text search takes them: the Snowball English ("Porter2") stemmer and its stop words."""

from __future__ import annotations

import functools
import re

# The stop words of English full-text search.
STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
# Words that the algorithm stems by themselves, or leaves.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL, _DOUBLE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_WORD = re.compile(r"\w+")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and after the next such."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = _REGION.search(w)
        start = m.end() if m else len(w)
    m = _REGION.search(w, start)
    return start, m.end() if m else len(w)


def _has_vowel(w: str) -> bool:
    return any(c in _VOWEL for c in w)


@functools.lru_cache(1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    # A y that is a consonant, at the start or after a vowel, is written Y.
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a: plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    w = _step1b(w, r1)
    # 1c: a last y after a consonant.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, put in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + put
            break
    for end, put in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + put
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _step1b(w: str, r1: int) -> str:
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        return w[:-n] + "ee" if len(w) - n >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            bare = w[: -len(end)]
            if not _has_vowel(bare):
                return w
            if bare.endswith(("at", "bl", "iz")):
                return bare + "e"
            if bare.endswith(_DOUBLE):
                return bare[:-1]
            if _SHORT_END.search(bare) and len(bare) <= r1:
                return bare + "e"
            return bare
    return w


def prefix(stemmed: str) -> str:
    """What every word of a stem begins with: suffixes change its last two letters at most, but for the words of SPECIAL."""
    if stemmed in ("die", "lie", "tie"):
        return stemmed[0]
    return stemmed[: max(1, len(stemmed) - (2 if len(stemmed) > 3 else 1))]


def lexemes(text: str) -> list[tuple[int, str]]:
    """(position, stem) of the words of a text that are no stop words; positions, from 1, count all words."""
    return [(n, stem(w)) for n, w in enumerate(_WORD.findall(text.lower()), 1) if w not in STOPWORDS]


class Wanted(dict):
    """Words to their stems, where these are among the wanted ones; other words, and stop words, to None. Fills itself."""

    def __init__(self, stems: set[str], most: int = 1 << 20):
        super().__init__()
        self.stems, self.most = stems, most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        found = None if word in STOPWORDS else stem(word)
        self[word] = found = found if found in self.stems else None
        return found

    def lexemes(self, text: str) -> tuple[list[tuple[int, str]], int]:
        """The wanted lexemes of a text by position, and the position of its last lexeme of any kind, or 0."""
        words = _WORD.findall(text.lower())
        last = next((n for n in range(len(words), 0, -1) if words[n - 1] not in STOPWORDS), 0)
        return [(n, t) for n, w in enumerate(words, 1) if (t := self[w])], last
