"""Core of problem 4: undo decodings with a wrong character set.

Pure Python, applied by :mod:`foliospark.llm.encoding_repair` to the few values
a JVM prefilter lets through.  Two kinds of damage are undone:

* UTF-8 bytes read as a one-byte charset.  The characters are mapped back to the
  legacy bytes, a byte-structure automaton (the UTF-8 grammar as one regular
  expression over the byte image) finds the maximal well-formed multibyte
  spans, and only those spans are decoded.  Repeats for double encoding.
* Bytes of one one-byte charset read as another one (no multibyte structure);
  undone word by word when every foreign character becomes a letter or mark of
  the texts' own alphabets.

U+FFFD and C1 controls that stay after that are found but cannot be restored.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Charsets in which UTF-8 may have been read, most usual first.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "mac_cyrillic")
#: (written in, read as) pairs of one-byte charsets.
BYTE_PAIRS = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1253", "cp1252"),
    ("cp1251", "mac_roman"), ("koi8-r", "mac_roman"), ("cp1253", "mac_roman"), ("cp1251", "cp437"), ("cp1253", "cp437"), ("cp1251", "cp850"), ("iso8859-5", "cp1252"),
)

_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
#: What a decoded span may hold: Latin letters and signs, Greek, Cyrillic, punctuation, letter-like signs, arrows, maths, ligatures, full-width forms.
_PLAUSIBLE = re.compile("[ -ſƒˆ˜̀-̨΄-ώЀ-џ -⁯⁰-₟€℀-⅏←-⋿■-◿ﬀ-ﬆ﻿！-～　\U0001d400-\U0001d7ff�]+")
_LATIN = "áàâãäåæçéèêëíìîïñóòôõöøœúùûüýÿßÁÀÂÃÄÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØŒÚÙÛÜÝŸ"
_SIGNS = "’‘“”«»„–—•…§°ºª·¿¡€№²³×½±µ"


@lru_cache(None)
def _to_bytes(charset: str) -> dict[int, int]:
    """Character -> byte image (chr of the byte) for the upper half; undefined bytes stand for the C1 control."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # undefined positions, and latin-1 in place of cp1252
        table.setdefault(b, b)
    if charset == "cp1252":
        for b in range(0x80, 0x100):
            table.setdefault(b, b)
    for c in range(0x80, 0x100):  # not of this charset: outside the automaton's alphabet
        table.setdefault(c, 0x7F)
    return table


class _Image(dict):
    """translate() table: characters beyond the charset become DEL, so positions stay the same."""

    def __missing__(self, c: int) -> int:
        return c if c < 0x80 else 0x7F


@lru_cache(None)
def _image(charset: str) -> _Image:
    return _Image(_to_bytes(charset))


@lru_cache(None)
def _alphabets(charset: str) -> tuple[frozenset, frozenset]:
    """The characters that lead and continuation bytes of UTF-8 are in the charset."""
    table = _to_bytes(charset)
    return frozenset(chr(c) for c, b in table.items() if 0xC2 <= b <= 0xF4), frozenset(chr(c) for c, b in table.items() if 0x80 <= b <= 0xBF)


@lru_cache(None)
def _pair_pattern(charset: str) -> re.Pattern:
    """A lead byte and a continuation byte, as characters of the charset: what any span begins with."""
    table = _to_bytes(charset)
    lead = "".join(re.escape(chr(c)) for c, b in table.items() if 0xC2 <= b <= 0xF4)
    tail = "".join(re.escape(chr(c)) for c, b in table.items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{lead}][{tail}]")


def _spans(text: str, charset: str) -> list[tuple[int, int, str]]:
    out = []
    if not _pair_pattern(charset).search(text):
        return out
    for m in _UTF8.finditer(text.translate(_image(charset))):
        s = m.group().encode("latin-1").decode("utf-8")
        if _PLAUSIBLE.fullmatch(s):
            out.append((m.start(), m.end(), s))
    return out


def _weight(span: str, charset: str) -> float:
    """How far a span speaks for its charset: letters and usual signs one each, the rest a fifth."""
    good = sum(1.0 if c in _LATIN or c in _SIGNS or "Ѐ" <= c <= "џ" or "΄" <= c <= "ώ" or c == " " else 0.2 for c in span)
    return good


_CYRILLIC, _GREEK = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]")


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]])


def _undo_utf8(text: str) -> str | None:
    best, best_w = None, 0.9
    chars = set(text)
    for rank, charset in enumerate(UTF8_READ_AS):
        lead, tail = _alphabets(charset)
        if chars.isdisjoint(lead) or chars.isdisjoint(tail):
            continue
        spans = _spans(text, charset)
        if charset in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "cp1253", "iso8859-7"):
            # here single pairs occur in ordinary Cyrillic or Greek ("СССР»"): ask for a run, unless nothing else in the text is of that alphabet
            native = _GREEK if charset in ("cp1253", "iso8859-7") else _CYRILLIC
            if native.search(_without(text, spans)):
                spans = [x for x in spans if x[1] - x[0] >= 6 or (x[1] - x[0] >= 4 and charset in ("koi8-r", "cp866")) or x[2] in _LATIN + _SIGNS and not text[x[0] - 1 : x[0]].isupper() and len(x[2]) == 1 and x[1] - x[0] >= 3]
            else:
                spans = [x for x in spans if x[1] - x[0] >= 4 or x[2] in _LATIN + _SIGNS]
        if not spans:
            continue
        w = sum(_weight(s, charset) for _, _, s in spans) - 0.01 * rank
        if w > best_w:
            best, best_w = spans, w
    if not best:
        return None
    out, at = [], 0
    for a, b, s in best:
        out += (text[at:a], s)
        at = b
    return "".join(out) + text[at:]


#: Characters that belong to the eight languages' ordinary texts.
_NORMAL = "áàâãäçéèêëíìîïñóòôõöœúùûüßÁÀÂÃÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖŒÚÙÛÜ’‘“”«»„–—•…§°ºª·€№²³¹×½¼¾±µ©®™⁶ⁿ¿¡‹›†‡¬"
#: Not ordinary text, and not a look-alike form (those are problem 6): \u00a0, spaces, zero-width, combining, full-width, mathematical and ligature forms are left out.
_STRONG = "\x80-\x84\x86-\x9fŽžŠšŸƒˆ˜‰¢-¦¨¯´¸ÅåÐÞðþØøÆæÝýÿ÷√∞∫∂∆∏∑≈≠≤≥◊ˇ˘-˝ı⌐⌠⌡─-■₧\uf8ff"
_L = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
#: Where a token may hold a byte read in another one-byte charset.
_ODD = re.compile(
    f"[{_STRONG}]|[{_L}][·–—„‚“”†‡‰‹›¿¡ªº«»°§¶¬™®©±µ¼½²³¹…•×ⁿ€α-ωΑ-Ω]+[{_L}]|[a-zß-öø-ÿ][À-ÖØ-Þ]|(?<![{_L}])(?:[ñÑûïò¥])(?![{_L}])"
    f"|(?<![{_L}])[ldjnsmtcLDJNSMTC]í[aeiouhéèêàâ][a-zé]{{3}}"
    f"|(?<![{_L}])[ÛÄËÎÏÌÒÔ](?![{_L}])|(?<![{_L}])[ÛÒÌËÏÙÈ†‡][a-zß-öø-ÿ]|[ÒãÇ](?=[A-Z0-9]{{1,3}}-?[A-Z0-9]*[0-9])|(?<=[0-9])[ÒÓÈ]|Õ(?=[A-DF-ZÀ-Þ])"
    f"|[{_L}][‡‹„·≤≥]|[‡‹·][{_L}]|[α-ωΑ-Ω][{_L}]|[{_L}][α-ωΑ-Ω]"
)
_TOKEN = re.compile(r"\S+")
_FOREIGN = re.compile("[\x80-\uffff]")
_CYR_PAIRS = tuple(p for p in BYTE_PAIRS if p[0] in ("cp1251", "koi8-r", "cp866", "cp1253"))


@lru_cache(None)
def _pair(written: str, read: str) -> dict[int, str]:
    """Character as seen -> character as written; undefined bytes were read as C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            meant = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        try:
            seen = bytes([b]).decode(read)
        except UnicodeDecodeError:
            seen = chr(b)
        table.setdefault(ord(seen), meant)
        if read == "cp1252" and b < 0xA0:
            table.setdefault(b, meant)
    return table


_CASED = re.compile("[a-zß-öø-ÿœ][A-ZÀ-ÖØ-ÞŒ]|[A-ZÀ-ÖØ-ÞŒ][À-ÖØ-ÞŒ][a-zß-öø-ÿœ]")
_ENDS = re.compile("[^\\w’]+|[0-9_]+")


def _word_ok(token: str, cyrillic: bool) -> bool:
    """Ordinary after the change: one alphabet, no capital inside a word, no foreign sign."""
    if _ODD.search(token):
        return False
    if len(token) == 1 and token.isalpha() and token not in "àáâéèêíóôòúùyÀÁÉÈÍÓÚ" and not cyrillic:  # a letter alone, from another letter alone
        return False
    for w in _ENDS.split(token):
        for part in w.split("’"):
            if not part:
                continue
            if _CASED.search(part) or any(ord(c) > 126 and c not in _NORMAL and not "Ѐ" <= c <= "џ" and not "΄" <= c <= "ώ" for c in part):
                return False
            kinds = {"c" if "Ѐ" <= c <= "џ" else "g" if "΄" <= c <= "ώ" else "l" for c in part if c.isalpha()}
            if len(kinds) > 1 or not cyrillic and kinds & {"c", "g"} or cyrillic and "l" in kinds:
                return False
            if cyrillic and not (part.islower() or part.isupper() or part[1:].islower()):
                return False
    return True


def _all_ordinary(text: str, cyrillic: bool) -> bool:
    """Whether nothing in the text is foreign to the languages: then all of it was read in the other charset, signs included."""
    if any(ord(c) > 126 and c not in _NORMAL and not (cyrillic and ("Ѐ" <= c <= "џ" or "΄" <= c <= "ώ")) for c in set(text)):
        return False
    return all(_word_ok(t, cyrillic and not t.isascii() and bool(_CYRILLIC.search(t) or _GREEK.search(t))) for t in set(_TOKEN.findall(text)) if _FOREIGN.search(t))


def _undo_bytes(text: str) -> str:
    odd = [t for t in set(_TOKEN.findall(text)) if _ODD.search(t)]
    if not odd:
        return text
    best, best_n = None, 0.0
    for rank, (written, read) in enumerate(BYTE_PAIRS):
        table, cyr = _pair(written, read), (written, read) in _CYR_PAIRS
        n = 0.0
        for t in odd:
            new = t.translate(table)
            if new != t and _word_ok(new, cyr):
                n += sum(1.0 if y.isalpha() else 0.6 for x, y in zip(t, new) if x != y)
        if cyr and n < 3:
            n = 0
        if n - 0.01 * rank > best_n:
            best, best_n = (table, cyr), n - 0.01 * rank
    if not best:
        return text
    table, cyr = best
    whole = text.translate(table)
    if _all_ordinary(whole, cyr):
        return whole

    def fix(m: re.Match) -> str:
        t = m.group()
        if not _FOREIGN.search(t):
            return t
        new = t.translate(table)
        if _ODD.search(t):
            return new if _word_ok(new, cyr) else t
        if cyr and sum("À" <= c <= "ÿ" for c in t) > 0.6 * len(t) and _word_ok(new, cyr):
            return new
        return t

    return _TOKEN.sub(fix, text)


# The most frequent letter pairs of Russian.
_RUSSIAN_PAIRS = frozenset("ст но то на ен ов ни ра во ко пр ро ре ла ер ос ли по та ет ри ан ль ва ог ел ор ии де ие ка ат ле ле не го ол да ит ар аз за об".split())
_CYRILLIC_WORD = re.compile("[А-Яа-яЁё]{3,}")
#: Swapped Cyrillic charsets show as words in capitals, because the halves of the tables lie the other way round.
_CYRILLIC_CAPS = re.compile("[А-ЯЁ]{3,}")


def _russian(word: str) -> int:
    w = word.lower()
    return sum(w[i : i + 2] in _RUSSIAN_PAIRS for i in range(len(w) - 1))


def _undo_cyrillic(text: str) -> str:
    """Words read in another Cyrillic charset, where that gives far more of the language's letter pairs."""
    words = set(_CYRILLIC_CAPS.findall(text)) and set(_CYRILLIC_WORD.findall(text))
    if not words:
        return text
    for written, read in (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"), ("koi8-r", "iso8859-5"), ("cp866", "cp1251"), ("cp1251", "cp866")):
        table = _pair(written, read)
        # words in capitals that turn to the language's pairs in small letters
        bad = {w: n for w in words if (n := w.translate(table)) != w and n.isalpha() and (n.islower() or n[1:].islower()) and not w.islower() and _russian(n) > 2 * _russian(w) and _russian(n) * 4 >= len(n)}
        if sum(map(len, bad)) >= 8:
            whole = text.translate(table)
            new = _CYRILLIC_WORD_ANY.findall(whole)
            if _all_ordinary(whole, True) and sum(map(_russian, new)) > 2 * sum(map(_russian, _CYRILLIC_WORD_ANY.findall(text))):
                return whole
            # short words beside them go the same way
            return _CYRILLIC_WORD_ANY.sub(lambda m: bad.get(m.group()) or (m.group().translate(table) if m.group().isupper() and _russian(m.group().translate(table)) >= _russian(m.group()) else m.group()), text)
    return text


_CYRILLIC_WORD_ANY = re.compile("[А-Яа-яЁё]+")


#: Quotation marks of one charset read as letters of another.
LETTER_QUOTES = re.compile(r"(?<![^\W_])ì([A-Z0-9][\w-]*)î(?![^\W_])")


def restore(text: str) -> str:
    """The text with all restorable damage undone, however often it was done; itself when there is none.  Every round leaves fewer characters."""
    while (new := _undo_utf8(text)) is not None and len(new) < len(text):
        text = new
    return _undo_bytes(_undo_cyrillic(LETTER_QUOTES.sub(r"“\1”", text)))


#: What stays of damage that cannot be restored.
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]|[Ãâ][€¢‚©]|Ã[¡-¿]|Â[¡-¿\xa0]|â€")


#: Signs foreign to ordinary texts, at a letter: damage that no pair of charsets explains.
_FOREIGN_SIGN = re.compile(f"[{_STRONG}](?<=[{_L}].)|[{_STRONG}][{_L}]")


def garbled(text: str | None, restored: str | None = None) -> bool:
    """Whether the field holds characters from a wrong decoding (restorable or not)."""
    if not text:
        return False
    restored = restore(text) if restored is None else restored
    return restored != text or bool(_LOST.search(text) or _FOREIGN_SIGN.search(restored))


#: Superset of the texts that :func:`garbled` can hold for, as a Java regular expression.
PREFILTER = (
    "[\\x{fffd}\\x{80}-\\x{84}\\x{86}-\\x{9f}ŽžŠšŸƒˆ˜‰¢-¦¨¯´¸ÅåÐÞðþØøÆæÝýÿ÷√∞∫∂∆∏∑≈≠≤≥◊ˇ˘-˝ı⌐⌠⌡─-■₧\\x{f8ff}]"
    "|[ÂÃÎÏâãÑÌÍËÊÅ][\\x{80}-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[РСВГП][\\x{a0}-»‚-›Ђ-ЏЁђ-џё]{1}[РСВГ\\x{a0}-»‚-›Ђ-Џђ-џ]|[¬œ–—“”‘’‚‡·„ÀÃÕŒ€‹›ÿ][°-³§ß®©™´¨Æ∞Øµªºæøáàâäãåçéèêëíìîïñóòôõöúùûü†¢£•¶Ä-Ü]"
    "|Ô[Çé]|\\p{L}[·–—„‚“”†‡‰‹›¿¡ªº«»°§¶¬™®©±µ¼½²³¹…•×ⁿ]+\\p{L}|\\p{IsLatin}[‡‹›„·]|[‡‹„·]\\p{IsLatin}|[a-zß-öø-ÿ][À-ÖØ-Þ]|(?<!\\p{L})[ñÑûïò¥](?!\\p{L})|\\p{IsLatin}[α-ωΑ-Ω]|[α-ωΑ-Ω]\\p{IsLatin}|╨|╤|[╬╧╠]|[оп°-·п][─-╬]"
)
