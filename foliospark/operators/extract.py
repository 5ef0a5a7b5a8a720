"""Fields of invoices, key-value pairs, contract facts and redaction; all as JVM expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .invoice_patterns import NEAR, NEAR_BONUS, PATTERNS


def amount_value(text: Column, comma_decimal: Column) -> Column:
    """The number of an amount: with a decimal comma the points go and the comma becomes one; else the commas go."""
    plain = F.regexp_replace(text, "[^0-9.,-]", "")
    return F.when(comma_decimal, F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit(""))).try_cast("double")


def amount_score(text: Column) -> Column:
    """Commas go, then: unreadable (also with a currency or two points) -0.50, negative -0.30, zero -0.20, two decimals +0.20, else +0.10."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    v = F.when(plain.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))
    return F.when(v.isNull(), -0.50).when(v < 0, -0.30).when(v == 0, -0.20).when(plain.rlike(r"\.[0-9]{2}$"), 0.20).otherwise(0.10)


def date_score(text: Column) -> Column:
    """+0.20 for a date, +0.10 for a day the month does not have, -0.50 otherwise.

    Year-month-day with dashes and two digits, or day and month with slashes or
    dashes: day first where that is possible, else month first; years under 100 are of this century.
    """
    iso, dm = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    a, b = part(dm, 1), part(dm, 2)
    day_first = a.between(1, 31) & b.between(1, 12)
    y = F.when(text.rlike(iso), part(iso, 1)).when(text.rlike(dm), F.when(part(dm, 3) < 100, part(dm, 3) + 2000).otherwise(part(dm, 3)))
    m = F.when(text.rlike(iso), part(iso, 2)).when(day_first, b).otherwise(a)
    d = F.when(text.rlike(iso), part(iso, 3)).when(day_first, a).otherwise(b)
    last = F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)), 29).when(m == 2, 28).otherwise(31)
    ok = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(~F.coalesce(ok, F.lit(False)), -0.50).when(d > last, 0.10).otherwise(0.20)


def number_score(text: Column) -> Column:
    """Letters and a separator +0.10, letters +0.08, digits only +0.05, under two bytes -0.30, else 0."""
    letters, sep = text.rlike(r"[\p{L}\p{Nl}]"), text.rlike("[-/_]")
    return F.when(F.octet_length(text) < 2, -0.30).when(letters & sep, 0.10).when(letters, 0.08).when(text.rlike("^[0-9]+$"), 0.05).otherwise(0.0)


def vat_score(text: Column) -> Column:
    """+0.15 for the British, Spanish, Italian and German forms, +0.05 for eight digits or more, -0.20 for nothing, else 0."""
    known = r"^(?:GB[0-9]{9,}|\p{L}[0-9]{8}.*|IT[0-9]{11}|DE[0-9]{9})$"
    return F.when(text == "", -0.20).when(text.rlike(known), 0.15).when(text.rlike("^[0-9]{8,}$"), 0.05).otherwise(0.0)


def field_score(field: Column, value: Column) -> Column:
    return (
        F.when(field.isin("invoice_date", "due_date"), date_score(value)).when(field.isin("net_amount", "tax_amount", "total_amount"), amount_score(value))
        .when(field == "invoice_number", number_score(value)).when(field == "vat_number", vat_score(value)).otherwise(F.lit(0.0))
    )


def near_bonus(field: Column, low: Column, at: Column) -> Column:
    """What the first of the field's words nearest to the value adds; ``low`` is the text in small letters, ``at`` the value's first place; distances are in bytes."""
    nearest = None
    for name, words in NEAR.items():
        distance = F.least(*[F.coalesce(F.abs(byte_place(F.lit(w), low) - at), F.lit(1 << 30)) for w in words])
        nearest = F.when(field == name, distance) if nearest is None else nearest.when(field == name, distance)
    bonus = F
    for most, add in NEAR_BONUS:
        bonus = bonus.when(nearest <= most, add)
    return bonus.otherwise(0.0)


def _heads(pattern: str) -> list[str]:
    """Letters one of which a match begins with, for patterns that begin with plain alternatives; else none.  Looking for them is far cheaper than the pattern."""
    group = re.match(r"\(\?:([^()]*)\)(?![?*])", pattern)
    heads = [re.match(r"[^\W\d_]*", a) for a in group[1].split("|")] if group else []
    out = [h[0][:-1] if h.string[h.end() : h.end() + 1] in ("?", "*") else h[0] for h in heads]
    return out if all(out) else []


def byte_place(part: Column, text: Column) -> Column:
    """The bytes before the first occurrence; null without one."""
    place = F.position(part, text)
    return F.when(place > 0, F.octet_length(F.left(text, place - 1)))


def invoice_fields(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", threshold: float = 0.7) -> DataFrame:
    """(key, field, value_str, value_num, confidence): the first match of each pattern of the document's language, from the threshold on.

    A match's confidence is the pattern's, with what its value and the nearest word
    of its kind add, between 0 and 1.  The patterns are an array literal, so each
    document is read once and nothing is joined.  Null texts have no fields.
    """
    la = F.lower(F.substring(F.coalesce(F.col(lang), F.lit("es")), 1, 2))
    def may(p: str) -> Column:
        """Whether the pattern is worth trying."""
        return reduce(or_, [F.contains("_text", F.lit(h)) for h in _heads(p)], F.lit(not _heads(p)))

    hits = [F.when((F.col("_l") == code) & may(p), F.struct(F.lit(f).alias("field"), F.regexp_extract("_text", f"(?d){p}", 1).alias("value_str"), F.lit(base).alias("base"))) for code, f, p, base in PATTERNS]
    read = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), la.alias("_l"))
    # no pattern matches with an empty value
    found = read.select(key, "_text", F.lower("_text").alias("_low"), "_l", F.explode(F.array(*hits)).alias("m")).where("m.value_str <> ''").select(key, "_text", "_low", "_l", "m.*")
    placed = found.withColumn("_at", byte_place(F.col("value_str"), F.col("_text")))
    score = F.col("base") + field_score(F.col("field"), F.col("value_str")) + near_bonus(F.col("field"), F.col("_low"), F.col("_at"))
    scored = placed.withColumn("confidence", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    money = F.col("field").isin("net_amount", "tax_amount", "total_amount")
    return (scored.where(F.col("confidence") >= threshold) if threshold > 0 else scored).select(
        key, "field", "value_str", F.when(money, amount_value(F.col("value_str"), F.col("_l") != "en")).alias("value_num"), "confidence"
    )


def colon_pairs(text: Column) -> Column:
    """Array of (key, value) of the lines 'key: value'."""
    rows = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[^:]+:\s*\S"))
    return F.transform(rows, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(s, r"^[^:]+:\s*(.+)$", 1)).alias("value")))


def tab_pairs(text: Column) -> Column:
    rows = F.filter(F.split(text, "\n"), lambda s: F.size(F.split(s, "\t")) == 2)
    return F.transform(rows, lambda s: F.struct(F.split(s, "\t")[0].alias("key"), F.split(s, "\t")[1].alias("value")))


_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# Dates, and what contracts name: numbers of agreements, parties, amounts (any case).
DATES = (
    rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b",
    rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{4}\b",
    r"\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b",
)
ORGANIZATION = r"\b([A-Z][A-Za-z\s&,\.]+(?:LLC|Ltd|Corp|Corporation|Inc|Company|Co\.)\b)"
MONEY = r"\$\s*[\d,]+(?:\.\d{2})?(?:\s*(?:million|thousand|M|K))?"
CONTRACT = (r"\b(?:Agreement|Contract)\s+(?:No\.?|Number)?\s*:?\s*([A-Z0-9\-/]+)", ORGANIZATION, MONEY)

#: What redaction covers by default.
REDACTED = {"date": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "code": r"\bREQ-[0-9]+\.[0-9]+\b"}


def key_info(text: Column) -> tuple[Column, Column, Column]:
    """(dates, monetary amounts, organizations) as arrays, empty where there are none; dates pattern by pattern."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.concat(*[every(f"(?Ui){p}") for p in DATES]), every(f"(?U){MONEY}"), every(f"(?U){ORGANIZATION}")


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """Each match replaced by its label in brackets; no patterns redact nothing."""
    for label, p in patterns.items():
        text = F.regexp_replace(text, p, f"[{label.upper()}]")
    return text
