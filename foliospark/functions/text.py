"""Scalar text functions as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def sanitize(text: Column, lone_cr: str = "remove") -> Column:
    """Control characters out: CRLF to LF, NUL (with a following ETX) to a space, the rest dropped, spaces collapsed.

    ``lone_cr``: remove, space or newline.
    """
    t = F.regexp_replace(text, rf"\r{_CONTROL}*\n", "\n")
    t = F.regexp_replace(t, "\r", {"remove": "", "space": " ", "newline": "\n"}[lone_cr])
    t = F.regexp_replace(t, r"\x00\x03?", " ")
    t = F.regexp_replace(t, _CONTROL, "")
    return F.regexp_replace(t, r"(?<=[ \t]) +", "")


def sentences(text: Column) -> Column:
    """Sentences for packing: a break after . ! ? before a space (which goes), and at line feeds; trimmed, none empty."""
    marked = F.regexp_replace(text, r"([.!?]) |(\n)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def sentences_greedy(text: Column) -> Column:
    """Sentences by terminator alone: a break after every . ! ?; what is left over is appended to the last one."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]*[.!?]"), F.lit(0))
    rest = F.regexp_extract(text, r"(?s)([^.!?]*)$", 1)
    joined = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(parts, F.lit(-1)), rest)))
    return F.when(F.size(parts) == 0, F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(joined)


def token_estimate(text: Column) -> Column:
    """floor(words * 1.33) in single precision."""
    return F.floor(word_count(text).cast("float") * F.lit(1.33).cast("float")).cast("int")


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?]\z")


def positional_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal positions over the longer length; 1 for equal texts, 0 when one is empty."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return F.when(a == b, F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(same / F.greatest(F.length(a), F.length(b)))


def dehyphenate(text: Column) -> Column:
    """A hyphen at a line end goes, and the next non-empty line follows directly."""
    return F.regexp_replace(text, r"-[ \t]*\n\s*(?=\S)", "")


def roman(n: Column) -> Column:
    """Subtractive Roman numeral of a positive integer, upper case."""
    def digit(power: int, one: str, five: str, ten: str) -> Column:
        d = F.floor(n / power) % 10
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (d + 1).cast("int"))

    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    return F.concat(thousands, digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))


def letters(n: Column) -> Column:
    """Bijective base 26: 1 is a, 26 is z, 27 is aa; 0 is empty.  Six letters at most."""
    out, rest = F.lit(""), n
    for _ in range(6):
        out = F.when(rest > 0, F.concat(F.char(F.lit(97) + ((rest - 1) % 26)), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """Prefix and number in a style: decimal, roman, ROMAN, letters, LETTERS; other styles show the prefix alone."""
    shown = (
        F.when(style == "decimal", number.cast("string")).when(style == "roman", F.lower(roman(number))).when(style == "ROMAN", roman(number))
        .when(style == "letters", letters(number)).when(style == "LETTERS", F.upper(letters(number))).otherwise(F.lit(""))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), shown)


def page_range(spec: Column, pages: Column) -> Column:
    """0-based page indices of 'all', 'n', 'a-b' or 'n,m'; null for anything that isn't one, is out of bounds, or mixes both."""
    one = r"^\s*[1-9][0-9]*\s*$"
    span = F.split(spec, "-")
    a, b = F.expr("1"), F.expr("1")
    a, b = F.try_element_at(span, F.lit(1)).try_cast("int"), F.try_element_at(span, F.lit(2)).try_cast("int")
    listed = F.transform(F.split(spec, ","), lambda x: F.trim(x).try_cast("int"))
    return (
        F.when(F.lower(F.trim(spec)) == "all", F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>")))
        .when(spec.contains("-"), F.when((F.size(span) == 2) & (a >= 1) & (b >= a) & (b <= pages), F.sequence(a - 1, b - 1)))
        .when(spec.contains(","), F.when(F.forall(listed, lambda x: F.coalesce((x >= 1) & (x <= pages), F.lit(False))), F.transform(listed, lambda x: x - 1)))
        .when(spec.rlike(one) & (F.trim(spec).try_cast("int") <= pages), F.array(F.trim(spec).try_cast("int") - 1))
    )


def template_variables(template: Column) -> Column:
    """Distinct sorted names of {{ name.path }} placeholders."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}"), F.lit(1))))


def template_render(template: Column, context: Column) -> Column:
    """The template with its placeholders replaced from a map; null when a variable is unknown."""
    names = template_variables(template)
    known = F.forall(names, lambda k: F.map_contains_key(context, k))
    tight = F.regexp_replace(template, r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}", "{{$1}}")
    return F.when(known, F.aggregate(names, tight, lambda t, k: F.replace(t, F.concat(F.lit("{{"), k, F.lit("}}")), context[k])))


def chunk_id(full_text: Column, index: Column, doc_hash: Column | None = None) -> Column:
    """doc_hash, else the first 8 bytes of SHA-256 of the text in hex; a colon and the index."""
    h = F.substring(F.sha2(full_text, 256), 1, 16)
    return F.concat(F.coalesce(doc_hash, h) if doc_hash is not None else h, F.lit(":"), index.cast("string"))


def page_span(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("p. "), first, F.lit("–"), last))


def context_prefix(name: Column, author: Column, section: Column, span: Column) -> Column:
    """Labelled lines 'Document: ..' and 'Section: ..', the author only with a name, the page span at the last line; null with neither."""
    doc = F.when(name.isNotNull(), F.concat(F.lit("Document: "), name, F.coalesce(F.concat(F.lit(" by "), author), F.lit(""))))
    sec = F.when(section.isNotNull(), F.concat(F.lit("Section: "), section))
    lines = F.concat_ws("\n", doc, sec)
    return F.when(doc.isNotNull() | sec.isNotNull(), F.concat(lines, F.coalesce(F.concat(F.lit(" ("), span, F.lit(")")), F.lit(""))))


def is_list_item(text: Column) -> Column:
    return text.rlike(r"^(?U)\s*([-*•–—] |[0-9a-z][.)] |[0-9]{2}[.)] )")


def font_style(font_name: Column) -> Column:
    """(bold, italic) by parts of the font's name."""
    low = F.lower(font_name)
    return F.struct(F.coalesce(low.rlike("bold|black|heavy"), F.lit(False)).alias("bold"), F.coalesce(low.rlike("italic|oblique"), F.lit(False)).alias("italic"))


def strict_number(text: Column) -> Column:
    """The double a text spells without spaces or type suffix, else null."""
    return F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double")).when(F.lower(text).rlike(r"^[+-]?(?:nan)$"), F.lit(float("nan"))).when(
        F.lower(text).rlike(r"^[+-]?(?:inf|infinity)$"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )
