"""Which texts need a closer look: a set of characters decides for nearly all, a pattern for the rest.

Texts whose characters all belong to the ordinary repertoire of the eight
languages can hold neither wrongly decoded nor stand-in characters; a search for
others costs a few microseconds, far less than a pattern with many branches.
"""

from __future__ import annotations

import re

from . import lookalike_chars, mojibake

_ASCII = "".join(map(chr, range(32, 127))) + "\t\n\r"
_LATIN = "áàâãäçéèêëíìîïñóòôõöœúùûüßÄÖÜÉÓÚÍÁÀÑÇÊ" + "’“”«»„–—•…§ªº€№©⁶½"
_CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "ёЁ"
_GREEK = "".join(map(chr, range(0x391, 0x3CA))) + "άέήίόύώϊϋΐΰΆΈΉΊΌΎΏ"
PLAIN = frozenset(_ASCII + _LATIN)
PLAIN_CYRILLIC = frozenset(_ASCII + _CYRILLIC + "’“”«»„–—•…§€№©⁶½")
PLAIN_GREEK = frozenset(_ASCII + _GREEK + "’“”«»„–—•…§€№©⁶½")
#: Ordinary characters that only certain neighbours make suspicious.
_TRIGGERS = frozenset("âãÄÖÜÉÓÚÍÁÀÑÇÊœ€«»„“”–—•…§ªº©ñûïò½")
_BRANCHES = (  # a rare character, and what stands around it
    ("À-ÖØ-Þ", "(?<=[a-zß-öø-ÿ].)"), ("âãÑÊ", "[\x80-¿€„…“”•–—œ™‚ƒ†‡ˆ‰Š‹ŒŽ‘’š›žŸ]"), ("–—„“”ªº«»§©…•€½", "(?<=[A-Za-zÀ-ÿ].)[A-Za-zÀ-ÿ–—„“”ªº«»§©…•€½]"),
    ("ñÑûïòÄ", "(?<![A-Za-zÀ-ÿ].)(?![A-Za-zÀ-ÿ])"), ("ãÇ", "(?=[A-Z0-9]{1,3}-?[A-Z0-9]*[0-9])"), ("ÓÒÈ", "(?<=[0-9].)"), ("œ–—“”’„ÀÃ€«»…Ä-Ü", "[§©ªºáàâäãçéèêëíìîïñóòôöõúùûü•Ä-Ü]"),
)
_PAIRS = re.compile(f"[{''.join(c for c, _ in _BRANCHES)}](?:{'|'.join(f'(?<=[{c}]){rest}' for c, rest in _BRANCHES)})")  # all rare characters first, which makes the search fast
_ELISION = re.compile("í(?<=[ldjnsmtcLDJNSMTC].)(?<![A-Za-zÀ-ÿ]..)[aeiouhéèêàâ][a-zé]{3}")


def _beside(pattern: str) -> re.Pattern:
    """A pattern whose first or second character is never ASCII; that is looked at before its many branches."""
    return re.compile(f"(?=[^\x00-\x7f]|.[^\x00-\x7f])(?:{pattern})")


_ENCODING = _beside(
    mojibake.PREFILTER.replace("\\x{fffd}", "�").replace("\\x{80}", "\x80").replace("\\x{84}", "\x84").replace("\\x{86}", "\x86").replace("\\x{9f}", "\x9f").replace("\\x{f8ff}", "")
    .replace("\\x{a0}", "\xa0").replace("\\p{IsLatin}", "[A-Za-zªºÀ-ÖØ-öø-ɏ]").replace("(?<!\\p{L})", "(?<![^\\W\\d_])").replace("(?!\\p{L})", "(?![^\\W\\d_])").replace("\\p{L}", "[^\\W\\d_]")
)
_ODD = _beside(mojibake._ODD.pattern)
_FORMS = re.compile(f"[{lookalike_chars.INVISIBLE}{lookalike_chars.SPACES}{lookalike_chars.FORMS}{lookalike_chars.MARKS}]")
_LAT, _CYR, _GRK = "A-Za-zªºÀ-ÖØ-öø-ɏ", "Ѐ-ԯ", "Ͱ-Ͽἀ-῿"
_MIXED = re.compile(f"[{_LAT}][{_CYR}{_GRK}]|[{_CYR}][{_LAT}{_GRK}]|[{_GRK}][{_LAT}{_CYR}]|[^\\W\\d_][´ˊ`ˋ¨˜ˆ¸ʹ][^\\W\\d_]")


#: Characters of problem 6; without them the rest of a text decides about wrong decoding.
_LOOKALIKE = frozenset(c for c in map(chr, [*range(0x80, 0x10000), *range(0x1D400, 0x1D800)]) if _FORMS.match(c))
#: Characters beyond each repertoire and problem 6.
_BEYOND, _BEYOND_CYRILLIC, _BEYOND_GREEK = (re.compile(f"[^{''.join(map(re.escape, sorted(x | _LOOKALIKE)))}]") for x in (PLAIN, PLAIN_CYRILLIC, PLAIN_GREEK))
_TRIGGER = re.compile(f"[{''.join(sorted(_TRIGGERS))}]")


def needs(text: str) -> tuple[bool, bool]:
    """(may be wrongly decoded, may hold stand-in characters)."""
    if text.isascii():
        return False, "`" in text
    if not _BEYOND.search(text):
        encoding = bool(_TRIGGER.search(text)) and bool(_PAIRS.search(text)) or "í" in text and bool(_ELISION.search(text)) or "ì" in text and bool(mojibake.LETTER_QUOTES.search(text))
        return encoding, encoding or "`" in text or bool(_FORMS.search(text))
    if not _BEYOND_CYRILLIC.search(text) or not _BEYOND_GREEK.search(text):
        mixed = bool(_MIXED.search(text))
        return mixed or bool(mojibake._CYRILLIC_CAPS.search(text)), mixed or bool(_FORMS.search(text))
    return True, True


def ordinary(text: str) -> bool:
    """Whether the text can hold neither kind of damage, by its characters alone."""
    return needs(text) == (False, False)


def encoding_suspect(text: str) -> bool:
    return needs(text)[0] and bool(_ENCODING.search(text) or _ODD.search(text) or mojibake._CYRILLIC_CAPS.search(text) or mojibake.LETTER_QUOTES.search(text))


def lookalike_suspect(text: str) -> bool:
    return bool(_FORMS.search(text) or _MIXED.search(text))


def restored(text: str) -> str:
    """Encoding damage undone."""
    return mojibake.restore(text) if encoding_suspect(text) else text


def plain(text: str) -> str:
    """Encoding damage undone and stand-in characters mapped."""
    encoding, lookalike = needs(text)
    if encoding and encoding_suspect(text):
        text = mojibake.restore(text)
    return lookalike_chars.map_lookalikes(text) if lookalike and lookalike_suspect(text) else text
