"""Core of problem 6: which characters stand in for others that look the same.

Compatibility forms that differ only in shape (full-width, mathematical
alphabets, ligatures), decomposed accents, accents written as separate signs,
letters of another alphabet inside a word, unusual spaces and invisible
characters.  Ordinary typography is left alone.
"""

from __future__ import annotations

import unicodedata

import regex

INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
SPACES = "   -   　"
#: Forms whose compatibility decomposition is the same letter in another shape.
FORMS = "！-～ﬀ-ﬆﬓ-ﬗ\U0001d400-\U0001d7ff℀-℁①-⑳Ⓐ-ⓩǄ-ǌǱ-ǳĲĳⅠ-ⅿ"
MARKS = "̀-ͯ"
#: Spacing accents after a vowel or consonant that takes them, inside a word.
ACCENT_SIGNS = {"´": "́", "ˊ": "́", "`": "̀", "ˋ": "̀", "¨": "̈", "˜": "̃", "~": "̃", "ˆ": "̂", "^": "̂", "¸": "̧", "ʹ": "́"}
# Letters that look the same in Latin, Cyrillic and Greek.
LATIN_OF_CYRILLIC = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХЅІЈԌҮӀ", "aeopcyxijsdhlqwABEKMHOPCTYXSIJGYI"))
LATIN_OF_GREEK = dict(zip("αινορτυχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivoptuxkABEZHIKMNOPTYX"))
CYRILLIC_OF_LATIN = {v: k for k, v in reversed(LATIN_OF_CYRILLIC.items())}
GREEK_OF_LATIN = dict(zip("aiovpuxkABEZHIKMNOPTYXt", "αιονρυχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧτ"))
CYRILLIC_OF_GREEK = dict(zip("αορκΑΒΕΚΜΗΟΡΤΧ", "аоркАВЕКМНОРТХ"))
GREEK_OF_CYRILLIC = {v: k for k, v in CYRILLIC_OF_GREEK.items()}
GREEK_OF_CYRILLIC |= dict(zip("уіхУІХЅеё", "υιχΥΙΧΣεε"))
GREEK_OF_LATIN |= {"u": "υ", "v": "ν", "n": "η", "w": "ω", "y": "γ"}

_CYR, _GRK, _LAT = "Ѐ-ԯ", "Ͱ-Ͽἀ-῿", "A-Za-zªºÀ-ÖØ-öø-ɏ"
_INVIS = regex.compile(f"[{INVISIBLE}]+")
_SPACE = regex.compile(f"[{SPACES}]")
_FORM = regex.compile(f"[{FORMS}]+")
_MARK = regex.compile(rf"\p{{L}}[{MARKS}]+")
_SIGN = regex.compile(r"(?<=\p{L})([aeiouAEIOUncNCIıі])([´ˊ`ˋ¨˜ˆ¸ʹ])(?=\p{Ll})|(?<![\p{L}])([aeiouAEIOU])([´ˊ¨])(?=\p{Ll}{2})")
#: Words that hold letters of several alphabets.
_MIXED = regex.compile(rf"(?:[{_LAT}]+[{_CYR}{_GRK}]|[{_CYR}]+[{_LAT}{_GRK}]|[{_GRK}]+[{_LAT}{_CYR}])[{_LAT}{_CYR}{_GRK}]*")
_L, _C, _G = regex.compile(f"[{_LAT}]"), regex.compile(f"[{_CYR}]"), regex.compile("[Ͱ-Ͽἀ-῿]")

#: Java regular expression: superset of the values that map_lookalikes changes.
PREFILTER = (
    f"[{INVISIBLE}{SPACES}]|[\\x{{ff01}}-\\x{{ff5e}}\\x{{fb00}}-\\x{{fb17}}\\x{{1d400}}-\\x{{1d7ff}}\\x{{2100}}\\x{{2101}}\\x{{2460}}-\\x{{2473}}\\x{{24b6}}-\\x{{24e9}}\\x{{01c4}}-\\x{{01cc}}\\x{{01f1}}-\\x{{01f3}}\\x{{0132}}\\x{{0133}}\\x{{2160}}-\\x{{217f}}]"
    f"|\\p{{L}}[{MARKS}]|[{_LAT}][{_CYR}{_GRK}]|[{_CYR}][{_LAT}{_GRK}]|[{_GRK}][{_LAT}{_CYR}]|\\p{{L}}[´ˊ`ˋ¨˜ˆ¸ʹ]\\p{{Ll}}"
)


def _one_alphabet(m: regex.Match) -> str:
    """A word of several alphabets in the one that most of its letters need, if all others have a look-alike there."""
    w = m.group()
    n = (len(_L.findall(w)), len(_C.findall(w)), len(_G.findall(w)))
    if sum(x > 0 for x in n) < 2:
        return w
    ways = (
        LATIN_OF_CYRILLIC | LATIN_OF_GREEK,
        CYRILLIC_OF_LATIN | CYRILLIC_OF_GREEK,
        GREEK_OF_LATIN | GREEK_OF_CYRILLIC,
    )
    own = (_L, _C, _G)
    best = None
    for k in range(3):
        if n[k] and all(own[k].match(c) or c in ways[k] for c in w):
            # letters that exist only in this alphabet speak for it, then the count
            only = sum(1 for c in w if own[k].match(c) and not any(c in ways[j] for j in range(3) if j != k))
            if best is None or (only, n[k]) > best[0]:
                best = ((only, n[k]), "".join(c if own[k].match(c) else ways[k][c] for c in w))
    if best is None or len(w) < 2:
        return w
    return best[1]


def _sign(m: regex.Match) -> str:
    base, sign = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
    base = {"ı": "i", "і": "i"}.get(base, base)
    new = unicodedata.normalize("NFC", base + ACCENT_SIGNS[sign])
    return new if len(new) == 1 else m.group()


def map_lookalikes(text: str) -> str:
    """The text in ordinary characters; itself when it has no stand-ins."""
    t = _INVIS.sub("", text)
    t = _SPACE.sub(" ", t)
    t = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    t = _SIGN.sub(_sign, t)
    t = _MARK.sub(lambda m: unicodedata.normalize("NFC", m.group()), t)
    return _MIXED.sub(_one_alphabet, t)
