"""Problem 10: pages of repeated keywords, links or tags.

Each text is cut into units (lines, or list items where a line holds many), and
each unit is reduced to a shape: its kind, the number of words, capitals,
separators, codes, prices and links.  Units are grouped by shape; a page is
flagged when a few non-sentence shapes hold most of its units and the words in
them repeat, when tags hold most of it, or when its sentences echo the same few
words.  A long run of words that no mark ends is no sentence.  Index entries,
contents lines, dated entries and labelled fields are shapes of their own and
never count as keyword shapes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words, and links without words, a page is judged by.
LEAST_WORDS = 12
#: Share of the units that the non-sentence shapes must hold, the number of shapes that may do so, and the most distinct words among theirs (more for links, and for pages of nothing else).
LIST_SHARE, TOP_SHAPES, DISTINCT, DISTINCT_LINKS, DISTINCT_ALL_LINKS = 0.5, 8, 0.6, 0.8, 0.9
#: Share of sentences with an echo, and share of the ten commonest longer words.
ECHO_SHARE, TOP_WORDS, LEAST_SENTENCES = 0.45, 0.45, 6

_URL = re.compile(r"\(?\b(?:https?://[^\s)]+|(?:[\w-]+\.)+[a-z]{2,}(?:/[^\s)]*)?)\)?")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{2,4}\b")
_PRICE = re.compile(r"\d[\d.,]*\s?(?:€|\$|£|EUR|USD)|[€$£]\s?\d[\d.,]*")
_INDEX = re.compile(r"(?:,\s*\d+)+\s*$|\.{3,}\s*\d+\s*$|^\s*(?:\d+\.)+\d*\s")
_CODE = re.compile(r"\S*\d\S*")
_DIGIT = re.compile(r"\d")
#: The code behind a tag's words.
_TAG_CODE = re.compile(r"[A-Z]{0,2}\d\w*")
_WORD = re.compile(r"[^\W\d_]+")
_INLINE = re.compile(r"\s*[,/|·•;*»–—]\s*|\s-\s")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_FIELD = re.compile(r"^[^:]{2,40}:\s|\t")
_PATH = re.compile(r"[/+_\-=?.&%#]+")


def _separators(x: str) -> int:
    """How many matches _INLINE has, by counting characters."""
    n = x.count
    return n(",") + n("/") + n("|") + n("·") + n("•") + n(";") + n("*") + n("»") + n("–") + n("—") + n(" - ")


def _linked(x: str) -> bool:
    """Whether _URL may match: it needs a dot within, or two slashes."""
    return -1 < x.find(".") < len(x) - 2 or "//" in x


def units(text: str) -> list[str]:
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    if not lines:
        return []
    out: list[str] = []
    # keyword lists wrapped at any word: the line ends mean nothing
    joined = _separators(text) > 3 * len(lines) and sum(x[-1] in ".!?" for x in lines) < 0.5 * len(lines)
    if joined and sum(bool(_INDEX.search(x) or _DATE.search(x)) for x in lines) < 0.3 * len(lines):
        lines = [" ".join(lines)]
    else:
        glued: list[str] = []
        for x in lines:  # a sentence that goes on in the next line
            if glued and x[0].islower() and len(glued[-1]) > 60 and glued[-1][-1] not in ".!?:;" and not (_linked(glued[-1]) and _URL.search(glued[-1])) and not _INDEX.search(glued[-1]):
                glued[-1] += " " + x
            else:
                glued.append(x)
        lines = glued
    for x in lines:
        if x.count("#") > 3:
            out += ["#" + y for y in x.split("#") if y.strip()]
            continue
        for y in _SENTENCE_END.split(x) if "." in x or "!" in x or "?" in x else (x,):
            if _separators(y) >= 6 and not _INDEX.search(y):
                parts = _INLINE.split(y)
                if len(parts) > 6 and sum(len(_WORD.findall(p)) for p in parts) <= 6 * len(parts):
                    out += [p for p in parts if p.strip()]
                    continue
            out.append(y)
    return out


def shape(unit: str) -> tuple[str, list[str]]:
    """(shape, words): the shape's first letter is its kind."""
    if unit[0] == "#":
        return "#", _WORD.findall(_TAG_CODE.sub("", unit).lower())
    links, bare = [], unit
    if _linked(unit) and (links := _URL.findall(unit)):
        bare = _URL.sub(" ", unit)
    dated = priced = indexed = False
    plain = bare
    if _DIGIT.search(bare):
        dated, priced = bool(_DATE.search(bare)), bool(_PRICE.search(bare))
        indexed = not links and bool(_INDEX.search(bare))
        plain = _CODE.sub(" ", _PRICE.sub(" ", bare) if priced else bare)
    if dated:
        return f"D{min(len(_WORD.findall(plain)), 6)}", []
    if links:
        words = _WORD.findall(plain.lower())
        path = [w for u in links for w in _WORD.findall(_PATH.sub(" ", u.split("//")[-1].partition("/")[2]).lower())]
        return f"L{min(len(words), 6)}", [w for w in words + path if w not in ("html", "htm", "php", "q")]
    if indexed:
        return f"I{min(len(_WORD.findall(plain)), 8)}", []
    lower = _WORD.findall(plain.lower())
    ended = bare.rstrip("\"'”»)] ").endswith((".", "!", "?", ";", "…"))
    if len(lower) > 9 and not ended:
        return f"R{min(len(lower) // 10, 9)}", lower
    if len(lower) >= 4 and ended:
        return f"S{min(len(lower) // 3, 8)}", lower
    if _FIELD.search(bare):
        return "F", []
    caps = sum(w[0].isupper() for w in _WORD.findall(plain))
    return f"K{min(len(lower), 9)}{'c' if caps == len(lower) else 'm' if caps else ''}{'p' if priced else ''}{'n' if plain is not bare and plain.strip() != bare.strip() else ''}", lower


def judge(text: str | None) -> dict[str, float]:
    """The figures a page is judged by, and ``spam``."""
    zero = {"units": 0, "list_share": 0.0, "distinct": 1.0, "echo": 0.0, "top": 0.0, "spam": False}
    if not text or not text.strip():
        return zero
    shaped = [shape(u) for u in units(text)]
    shaped = [x for x in shaped if x[1] or x[0][0] in "DIFL"]
    # a link without words counts as one word, the same in all such links
    total = sum(len(w) or s[0] == "L" for s, w in shaped)
    if not shaped or total < LEAST_WORDS:
        return zero | {"units": len(shaped)}
    groups: dict[str, int] = {}
    for s, w in shaped:
        groups[s] = groups.get(s, 0) + (len(w) or 6)
    weight = sum(groups.values())
    top_lists = sorted(((s, n) for s, n in groups.items() if s[0] in "KLR#"), key=lambda x: -x[1])[:TOP_SHAPES]
    listed = sum(n for _, n in top_lists)
    share = listed / weight
    keep = {s for s, _ in top_lists}
    kw = [x for s, w in shaped if s in keep for x in w or ("",)]
    n_kw = len(kw)
    links = sum(n for k, n in top_lists if k[0] == "L") / max(1, listed)
    tags = groups.get("#", 0) / weight
    distinct = len(set(kw)) / n_kw**0.85 if n_kw else 9.0
    sentences = [[x for x in w if len(x) > 3] for s, w in shaped if s[0] in "SR"]
    echo = top = 0.0
    if sentences:
        echo = sum(len(set(w)) < len(w) for w in sentences) / len(sentences)
        c = Counter(chain.from_iterable(sentences))
        top = sum(sorted(c.values(), reverse=True)[:10]) / max(1, sum(c.values()))
    s_share = sum(n for s, n in groups.items() if s[0] in "SR") / weight
    most = DISTINCT_ALL_LINKS if links * share > 0.95 else DISTINCT_LINKS if links + tags > 0.5 else DISTINCT
    spam = n_kw >= LEAST_WORDS and (share >= LIST_SHARE and distinct <= most or tags >= LIST_SHARE and sum(s == "#" for s, _ in shaped) >= LEAST_WORDS)
    spam = spam or (s_share + sum(n for s, n in top_lists if s[0] != "R") / weight >= 0.8 and s_share >= 0.3 and len(sentences) >= LEAST_SENTENCES and echo >= ECHO_SHARE and top >= TOP_WORDS)
    return {"units": len(shaped), "list_share": share, "distinct": distinct, "echo": echo, "top": top, "spam": bool(spam)}


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, units, list_share, distinct, echo, top) of the flagged pages.

    Row-local: no shuffle, and every text that isn't null is judged.  Null, blank and very short texts are never flagged.
    """
    read = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    figures = ("units", "list_share", "distinct", "echo", "top")
    out = read.select(key).schema.add("units", "long")
    for c in figures[1:]:
        out = out.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, j) for k, j in ((k, judge(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if j["spam"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], b.schema.field(0).type), *(pa.array([j[c] for _, j in rows], pa.int64() if c == "units" else pa.float64()) for c in figures)], names=[key, *figures]
            )

    return read.mapInArrow(run, out)
