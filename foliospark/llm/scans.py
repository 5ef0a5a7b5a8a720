"""Problem 7: repair text from scanned pages.

A noisy channel over the whole corpus: words and word pairs are counted in every
row, and a word is taken for a misreading when a word that the confusion table
turns into it is so much more frequent that the misreading explains it better.
Each line is decoded by Viterbi over the candidates of its words, with channel
probability times interpolated pair and word likelihood.  Words broken at a line
end are joined where the corpus knows the joined word; compounds and identifiers
broken at their own hyphen stay.  Page numbers and running heads go, and lines
are joined to paragraphs.

No count goes to the driver and none is left out: frequent words are turned into
what they may be read as, which an exact join with the counts narrows to the
doubtful words; a filter of fixed size (:mod:`sieve`) tells the workers which
texts hold one or a word broken at a line end, and just the counts those texts
ask for are joined to them.  How often each confusion occurs is estimated from
the doubtful words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gate
from .common import spool
from .sieve import Sieve, sieve

#: Flush of a worker's partial counts.
FLUSH = 300_000
# What a scanner reads for what (true, read, log probability).
CONFUSIONS = (
    ("e", "c"), ("i", "1"), ("o", "0"), ("s", "5"), ("t", "f"), ("l", "1"), ("u", "ii"), ("d", "cl"), ("g", "9"), ("m", "rn"),
    ("h", "b"), ("v", "y"), ("w", "vv"), ("li", "h"), ("ó", "6"), ("ó", "0"), ("é", "6"), ("é", "c"), ("í", "1"), ("l", "i"), ("n", "ri"), ("b", "6"), ("z", "2"),
    ("т", "г"), ("и", "н"), ("о", "0"), ("з", "3"), ("б", "6"), ("п", "л"), ("ш", "щ"), ("ο", "0"), ("ν", "v"), ("ι", "1"), ("ü", "ii"), ("ä", "a"), ("ö", "o"),
)
#: Confusions that look like ordinary variants of a word (inflection, lost accents) ask for more.
WEAK = {("l", "i"), ("и", "н"), ("п", "л"), ("ш", "щ"), ("ä", "a"), ("ö", "o"), ("v", "y"), ("n", "ri"), ("h", "b"), ("t", "f"), ("é", "c")}
LOG_CONFUSION, LOG_WEAK, LOG_SAME = math.log(1 / 60), math.log(1 / 300), math.log(0.97)
_COSTS = tuple((pair, LOG_WEAK if pair in WEAK else LOG_CONFUSION) for pair in CONFUSIONS)
_NEVER = (-1e9, ())
LEAST_COUNT = 4
#: Counts of words and of pairs from which they say anything: what is seen less often is as likely damage.
SEEN_WORD, SEEN_PAIR = 2, 3
#: How far a confusion's estimated rate may move its channel probability (log).
MOST_SHIFT = 1.0
#: Mark of the words in doubt among what a text asks for.
IN_DOUBT = "\x01"
#: Distinct words a worker remembers its answers for.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"^\W*(.*?)\W*$", re.S)
_BREAK = re.compile(r"([^\W\d_][^\W_]*)([-¬‐])[ \t]*_?[ \t]*\r?\n[ \t]*([^\W_]+)")
#: What breaks a word at a line end.
MARKS = ("-", "¬", "‐")
_CUT = re.compile(r"([^\W\d_]+)([-¬‐][ \t]*_?[ \t\r]*)$")
_FIRST = re.compile(r"[ \t]*([^\W_]+)")
#: An accent read as a quotation mark.
_TORN = re.compile(r"([aA])‘(?=[^\W\d_])")
_STRAY = re.compile(r"[ \t]+_[ \t]*(?=\r?\n)")
_PAGE = re.compile(r"^[\W_]*(?:(?:p|pp|pág|pag|page|página|pagina|seite|s|стр|σελ)\b\.?)?[\W_]*\d{1,5}[\W_]*$", re.I)


def count_words(chunks: DataFrame) -> DataFrame:
    """(w, n): counts of all lower-case words, and of pairs of neighbours as 'a b', over all rows as they are; damaged forms are words of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            w, n = [*c, *map(" ".join, pairs)], [*c.values(), *pairs.values()]
            c.clear(), pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                ws = _WORD.findall(t.lower())
                c.update(ws)
                pairs.update(zip(ws, ws[1:]))
            if len(c) + len(pairs) > FLUSH:
                yield flush()
        yield flush()

    return chunks.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _readings(w: str, turn: int = 0) -> dict[str, tuple[float, tuple[int, ...]]]:
    """{word: (channel log probability, confusions)} one confusion away, for longer words two: true words of a read one, or with turn 1 what a true word is read as."""
    out: dict[str, tuple[float, tuple[int, ...]]] = {}
    level: dict[str, tuple[float, tuple[int, ...]]] = {w: (0.0, ())}
    for _ in range(2 if len(w) > 5 else 1):
        found: dict[str, tuple[float, tuple[int, ...]]] = {}
        for s, (log, used) in level.items():
            for k, (pair, cost) in enumerate(_COSTS):
                new, old = pair[turn], pair[1 - turn]
                at = s.find(old)
                while at >= 0:
                    c, p = s[:at] + new + s[at + len(old) :], log + cost
                    if p > found.get(c, _NEVER)[0]:
                        found[c] = (p, (*used, k))
                    at = s.find(old, at + 1)
        for c, x in found.items():
            if c != w and x[0] > out.get(c, _NEVER)[0]:
                out[c] = x
        level = found
    return out


def _explains(m: float, p: float, n: float, c: str) -> bool:
    """Whether a true word c of count m explains all n occurrences of what it is read as with room to spare; a word seen once is no evidence for itself."""
    return m >= LEAST_COUNT and m * math.exp(p) > (2.0 * n if n >= SEEN_WORD else 0.0) + (0.0 if len(c) > 3 else 2.0)


class ScanModel:
    """Counts of words and pairs, all of them or those a text asks for, and the candidates of words, or of ``doubts`` only; shifts: what the estimated rate adds to a confusion's log probability."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], total: int | None = None, shifts: dict[int, float] | None = None, doubts: set[str] | None = None):
        self.doubts = doubts
        self.words, self.pairs, self.shifts = words, pairs, shifts or {}
        self.total = (sum(words.values()) if total is None else total) + 1
        self._known: dict[str, tuple[tuple[str, float], ...]] = {}
        self.plain = {w for w, n in words.items() if n >= 50 and w.isalpha() and not self.candidates(w)}

    def candidates(self, w: str) -> tuple[tuple[str, float], ...]:
        """Likelier true words for a read one, with their channel log probability."""
        if self.doubts is not None and w not in self.doubts:
            return ()
        if w not in self._known:
            self._known[w] = self._candidates(w)
        return self._known[w]

    def _candidates(self, w: str) -> tuple[tuple[str, float], ...]:
        n, get = self.words.get(w, 0), self.words.get
        out: dict[str, float] = {}
        if 2 <= len(w) <= 40 and any(x.isalpha() for x in w):
            for c, (p, used) in _readings(w).items():
                if _explains(get(c, 0), p, n, c) and c.isalpha():
                    out[c] = p + sum(self.shifts.get(k, 0.0) for k in used)
        return tuple(sorted(out.items(), key=lambda x: -x[1])[:6])

    def doubtful(self, text: str) -> bool:
        """Whether any word has a likelier reading."""
        return any(self.candidates(w) for w in set(_WORD.findall(text.lower())) - self.plain)

    def lm(self, before: str, w: str) -> float:
        uni = (self.words.get(w, 0) + 0.1) / self.total
        first = self.words.get(before, 0)
        return math.log(0.6 * (self.pairs.get(f"{before} {w}", 0) / first) + 0.4 * uni) if first else math.log(uni)

    def decode(self, ws: list[str]) -> list[str]:
        """The likeliest true words of a line."""
        paths = {"": (0.0, [])}
        for w in ws:
            options = [(w, LOG_SAME)] if w in self.plain else [(w, LOG_SAME), *self.candidates(w)]
            new: dict[str, tuple[float, list[str]]] = {}
            for c, p in options:
                new[c] = max(((s + p + self.lm(b, c), [*path, c]) for b, (s, path) in paths.items()), key=lambda x: x[0])
            paths = new
        return max(paths.values(), key=lambda x: x[0])[1]

    def broken(self, a: str, mark: str, b: str) -> bool:
        """Whether a line end cut one word: the corpus knows the joined word, or knows neither part."""
        x, y = a.lower(), b.lower()
        if any(c.isdigit() for c in x + y) and not (mark == "¬"):
            joined = self.candidates(x + y)
            return bool(joined) and self.words.get(x, 0) < 3
        if mark != "-":
            return True
        if b[:1].isupper() and not a.isupper():
            return False
        n, pair = self.words.get(x + y, 0), self.pairs.get(f"{x} {y}", 0)
        if n >= LEAST_COUNT and n * 20 > pair:
            return True
        if pair >= LEAST_COUNT and pair > n:
            return False
        rare = min(self.words.get(x, 0), self.words.get(y, 0))
        return bool(self.candidates(x + y)) or rare == 0 and n >= 2


def _identifier(core: str) -> bool:
    digit = any(c.isdigit() for c in core)
    if not digit:
        return len(core) >= 6 and core.isupper() and core.isascii() and not any(c in "AEIOUY" for c in core) or "_" in core or "://" in core or ".example" in core
    letters = [c for c in core if c.isalpha()]
    return not letters or sum(c.isupper() for c in letters) > 1 and sum(c.isdigit() for c in core) > 0 and not (len(letters) >= 5 and sum(c.isdigit() for c in core) <= 2 and core.isalnum()) or any(c in "/-_.@:#=+%" for c in core) or sum(c.isdigit() for c in core) > max(1, len(letters) // 2)


def _line_words(line: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans and lower-case words of a line that are decoded; identifiers and references aren't."""
    spans, ws = [], []
    for t in _TOKEN.finditer(line):
        core = _CORE.match(t.group())
        if core is None or _identifier(core.group(1)) or line[t.start() : t.start() + 1] in "[#":
            continue
        at = t.start() + core.start(1)
        for w in _WORD.finditer(core.group(1)):
            spans.append((at + w.start(), at + w.end()))
            ws.append(w.group().lower())
    return spans, ws


class Asker:
    """What counts a text asks for, by filters of the words that may be true ('f' and the word) and of the doubtful ones ('d')."""

    def __init__(self, known: Sieve, doubtful: Sieve):
        self.known, self.doubts = known, doubtful
        self.fine: set[str] = set()
        self.odd: set[str] = set()

    def doubtful(self, words: set[str]) -> set[str]:
        """Those of the words that are in doubt; answers are remembered."""
        new = words - self.fine
        for w in new - self.odd:
            # a word that no text holds as it is, only a mended one, has no count to tell
            (self.odd if "d" + w in self.doubts or "w" + w not in self.known and len(self.options(w)) > 1 else self.fine).add(w)
        if len(self.fine) > REMEMBERED:
            self.fine.clear()
        return new & self.odd

    def options(self, w: str) -> set[str]:
        return {w, *(c for c in _readings(w) if "f" + c in self.known)}

    def breaks(self, text: str) -> list[tuple[str, str]]:
        """The parts of words that a line end may have cut."""
        if "\n" not in text or not ("-" in text or "¬" in text or "‐" in text):
            return []
        found = [(x.group(1).lower(), x.group(3).lower()) for x in _BREAK.finditer(text)]
        lines = text.split("\n")
        for i, line in enumerate(lines[:-2]):
            if line.rstrip(" \t\r_")[-1:] in MARKS and (x := _CUT.search(line)):
                firsts = [_FIRST.match(y) for y in lines[i + 2 : i + 5]]
                found += [(x.group(1).lower(), y.group(1).lower()) for y in firsts if y and y.group(1)[:1].islower()]
        return found

    def __call__(self, text: str) -> list[str] | None:
        """Words, pairs as 'a b', and the words in doubt behind IN_DOUBT; None for texts that hold nothing in doubt."""
        if "_" in text:
            text = _STRAY.sub("-", text)
        text, torn = _TORN.subn(_with_accent, text) if "‘" in text else (text, 0)
        cut = self.breaks(text)
        odd = self.doubtful(set(_WORD.findall(text.lower())))
        if not cut and not odd:
            return [] if torn else None
        ask: set[str] = set()
        joined = {x + y for x, y in cut}
        for x, y in cut:
            ask |= {x, y, f"{x} {y}", *self.options(x + y)}
        forms = [text]
        if cut:
            forms.append(_BREAK.sub(lambda x: x.group(1) + x.group(3), text))
            joined |= set(_WORD.findall(forms[1].lower())) - set(_WORD.findall(text.lower()))
        kept: dict[str, set[str]] = {}

        def options(w: str) -> set[str]:
            if w not in kept:
                kept[w] = self.options(w) if w in joined or w in odd or self.doubtful({w}) else {w}
            return kept[w]

        for form in forms:
            for line in form.split("\n"):
                if not any(w in odd or w in joined for w in _WORD.findall(line.lower())):
                    continue
                _, ws = _line_words(line)
                for k, w in enumerate(ws):
                    if w in odd or w in joined:
                        before, here, after = options(ws[k - 1]) if k else set(), options(w), options(ws[k + 1]) if k + 1 < len(ws) else set()
                        ask |= before | here | after
                        ask |= {f"{a} {b}" for a in before for b in here} | {f"{a} {b}" for a in here for b in after}
        return sorted(ask | {IN_DOUBT + w for w in odd | joined})


def _with_accent(x: re.Match) -> str:
    return "á" if x.group(1) == "a" else "Á"


def examine(text: str, m: ScanModel) -> tuple[int, int, str]:
    """(broken words, misread words, text with both undone)."""
    if "_" in text:
        text = _STRAY.sub("-", text)
    text, misread = _TORN.subn(_with_accent, text)
    breaks = 0

    def join(x: re.Match) -> str:
        nonlocal breaks
        if m.broken(x.group(1), x.group(2), x.group(3)):
            breaks += 1
            return x.group(1) + x.group(3)
        return x.group()

    if "\n" in text and ("-" in text or "¬" in text or "‐" in text):
        text = _BREAK.sub(join, text)
        lines = text.split("\n")
        for i, line in enumerate(lines[:-2]):  # a head or page number between the parts
            x = _CUT.search(line) if line.rstrip(" \t\r_")[-1:] in MARKS else None
            if x:
                for j in range(i + 2, min(i + 5, len(lines))):
                    y = _FIRST.match(lines[j])
                    if y and y.group(1)[:1].islower() and m.words.get((x.group(1) + y.group(1)).lower(), 0) >= LEAST_COUNT and not m.words.get(f"{x.group(1)} {y.group(1)}".lower(), 0) > 20:
                        breaks += 1
                        lines[i], lines[j] = line[: x.start(2)] + y.group(1), lines[j][y.end() :].lstrip()
                        break
        text = "\n".join(lines)
    if not m.doubtful(text):
        return breaks, misread, text
    plain = m.plain
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if all(w in plain for w in _WORD.findall(line.lower())):
            continue
        spans, ws = _line_words(line)
        odd = [k for k, w in enumerate(ws) if w not in plain and m.candidates(w)]
        if not odd:
            continue
        best = m.decode(ws)
        for k in reversed(odd):
            if best[k] != ws[k]:
                a, b = spans[k]
                old, new = line[a:b], best[k]
                if old.isupper() and len(old) > 1:
                    new = new.upper()
                elif old[:1].isupper() or old[:1].isdigit() and k == 0:
                    new = new[:1].upper() + new[1:]
                line = line[:a] + new + line[b:]
                misread += 1
        lines[i] = line
    return breaks, misread, "\n".join(lines)


def paragraphs(text: str, document_name: str | None = None) -> str:
    """Without page numbers and running heads, lines joined to paragraphs; list items, rows and headings keep their lines."""
    name = set(_WORD.findall((document_name or "").lower()))
    out: list[str] = []
    open_ended = False
    for line in text.replace("\r\n", "\n").split("\n"):
        s = " ".join(line.split())
        words = _WORD.findall(s.lower())
        if _PAGE.match(s) and s:
            continue
        if name and words and len(words) <= len(name) + 6 and sum(w in name for w in set(words)) >= 0.6 * min(len(name), len(set(words))) and len(set(words) & name) >= 3 and open_ended:
            continue
        if not s:
            out.append("")
            open_ended = False
            continue
        goes_on = open_ended and bool(out and out[-1]) and not re.match(r"[-–•*]\s|\w{1,3}[.)]\s|.*\|", s)
        if goes_on:
            out[-1] += " " + s
        else:
            out.append(s)
        open_ended = s[-1] not in ".!?:;|" and len(s) > 25 and "|" not in s
    return "\n".join(out)


def _misreadings(words: DataFrame, known: Sieve) -> DataFrame:
    """(w, true, m, p, conf): words of the corpus that others may be read as by one or two confusions; conf is the confusion of a single one, else -1."""
    shared = words.sparkSession.sparkContext.broadcast(known)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            rows = []
            for c, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c.isalpha():
                    for w, (p, used) in _readings(c, turn=1).items():
                        if 2 <= len(w) <= 40 and (len(used) < 2 or len(w) > 5) and _explains(m, p, 0, c) and "w" + w in seen and any(x.isalpha() for x in w):
                            rows.append((w, c, m, p, used[0] if len(used) == 1 else -1))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32()))], names=["w", "true", "m", "p", "conf"])

    return words.where(F.col("n") >= LEAST_COUNT).select("w", "n").mapInArrow(run, "w string, true string, m long, p double, conf int")


def doubtful_words(counts: DataFrame, known: Sieve) -> DataFrame:
    """(w, n, true, m, conf): words that a far more frequent one explains, by exact join of its misreadings with the counts."""
    words = counts.where(~F.col("w").contains(" "))
    least = F.when(F.col("n") >= SEEN_WORD, 2 * F.col("n")).otherwise(0) + F.when(F.length("true") > 3, 0.0).otherwise(2.0)
    return _misreadings(words, known).join(words, "w").where(F.col("m") * F.exp("p") > least).drop("p")


def confusion_shifts(doubtful: DataFrame) -> dict[int, float]:
    """For each confusion how far its rate among the doubtful words is from the middle one, as log and held to MOST_SHIFT; a row for each entry of CONFUSIONS at most."""
    rows = doubtful.where("conf >= 0").groupBy("conf").agg((F.sum("n") / F.sum("m")).alias("rate"), F.sum("n").alias("n")).collect()
    rates = sorted(r.rate for r in rows if r.n >= 50)
    if not rates:
        return {}
    middle = rates[len(rates) // 2]
    return {r.conf: max(-MOST_SHIFT, min(MOST_SHIFT, math.log(r.rate / middle))) for r in rows if r.n >= 50}


def _asked(chunks: DataFrame, filters: tuple[Sieve, Sieve]) -> DataFrame:
    """(row_id, _d, _o, _t, _ask): non-null texts as they are and plain, with the counts they ask for, null for those that hold nothing in doubt."""
    shared = chunks.sparkSession.sparkContext.broadcast(filters)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Asker(*shared.value)
        for b in batches:
            plain = [gate.plain(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plain, pa.string()), pa.array(map(ask, plain), pa.list_(pa.string()))], names=["row_id", "_d", "_o", "_t", "_ask"])

    src = chunks.where(F.col("text").isNotNull()).select("row_id", F.col("metadata.document_name").alias("_d"), F.col("text").alias("_o"))
    return src.mapInArrow(run, f"row_id {chunks.schema['row_id'].dataType.simpleString()}, _d string, _o string, _t string, _ask array<string>")


def _answered(asked: DataFrame, counts: DataFrame, total: int, shifts: dict[int, float]) -> DataFrame:
    """(row_id, broken, misread, text) of the texts that ask for counts."""
    told = counts.where(F.col("n") >= F.when(F.col("w").contains(" "), SEEN_PAIR).otherwise(SEEN_WORD))
    found = asked.select("row_id", F.explode("_ask").alias("w")).where(~F.col("w").startswith(IN_DOUBT)).distinct().join(told, "w").groupBy("row_id").agg(F.collect_list(F.struct("w", "n")).alias("_n"))  # bounded by a text's words
    src = asked.join(found, "row_id", "left").select("row_id", "_d", "_o", "_t", "_n", "_ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, t, plain, got, ask in zip(*(c.to_pylist() for c in b.columns[1:])):
                n = {x["w"]: x["n"] for x in got or ()}
                m = ScanModel({w: k for w, k in n.items() if " " not in w}, {w: k for w, k in n.items() if " " in w}, total, shifts, {w[1:] for w in ask if w[0] == IN_DOUBT})
                broken, misread, new = examine(plain, m)
                rows.append((broken, misread, paragraphs(new, name) if broken or misread else t))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["row_id", "broken", "misread", "text"])

    return src.mapInArrow(run, f"row_id {asked.schema['row_id'].dataType.simpleString()}, broken int, misread int, text string")


def _model(chunks: DataFrame) -> tuple[DataFrame, tuple[Sieve, Sieve], int, dict[int, float]]:
    """All counts as a table, and what is bounded: the filters, the number of words, a shift for each confusion."""
    counts = spool(count_words(chunks))
    words = counts.where(~F.col("w").contains(" "))
    marks = F.when(F.col("n") >= LEAST_COUNT, F.array(F.lit("w"), F.lit("f"))).otherwise(F.array(F.lit("w")))
    known = sieve(words.select("w", F.explode(marks).alias("_k")).select(F.concat("_k", "w").alias("k")))
    doubtful = spool(doubtful_words(counts, known))
    doubts = sieve(doubtful.select(F.concat(F.lit("d"), "w").alias("k")).distinct())
    return counts, (known, doubts), words.agg(F.sum("n")).first()[0] or 0, confusion_shifts(doubtful)


def repair_scans(chunks: DataFrame) -> DataFrame:
    """(row_id, broken, misread, text): every non-null text, as continuous paragraphs where it carries scanning damage, else as it is."""
    counts, filters, total, shifts = _model(chunks)
    asked = spool(_asked(chunks, filters))
    fine = asked.where("_ask is null").select("row_id", F.lit(0).alias("broken"), F.lit(0).alias("misread"), F.col("_o").alias("text"))
    return fine.unionByName(_answered(asked.where("_ask is not null"), counts, total, shifts))


def damaged_rows(chunks: DataFrame) -> DataFrame:
    """(row_id): rows with a broken or misread word."""
    counts, filters, total, shifts = _model(chunks)
    asked = spool(_asked(chunks, filters).where("_ask is not null"))
    return _answered(asked, counts, total, shifts).where("broken > 0 or misread > 0").select("row_id")
