"""Problem 5: the language of each text and of each passage of a mixed one.

A model of character trigrams and words per language is fitted on a bounded
sample of labelled rows, wrong labels being weeded out by the model's own first
version.  Every text is then a mixture: expectation-maximisation over all
languages, for a batch of texts at once, estimates the proportions from the
words' likelihoods.  Languages with a proportion worth a few words are added to
the likeliest one as long as the penalised likelihood of the mixture grows; a
passage boundary costs as much as its evidence must outweigh (Viterbi over the
words within the chosen set).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gate
from .token_budget import LANGUAGE_NAMES, language_code

#: Bound of the training sample: rows a language, those of the lowest hash of their id.
SAMPLE_ROWS = 1000
#: A passage counts from this many words with a letter on; a text is judged from as many on.
LEAST_WORDS = 8
#: Log likelihood that a second language must win over LEAST_WORDS words, and the cost of changing the language.
GAIN, SWITCH = 9.0, 7.0
#: Rounds of expectation-maximisation; the proportion, in passages of LEAST_WORDS words, from which a language is tried; texts a round is run over at once.
ROUNDS, LEAST_PROPORTION, TOGETHER = 12, 0.4, 1_000
LANGUAGES = tuple(sorted(set(LANGUAGE_NAMES.values())))
_RUN = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"\d|://|^[A-Z]{6,}$|^\W*[A-Z0-9-]{2,}\W*$")
_WEIGHT_WORD, _FLOOR, _CLIP, _VOCABULARY = 0.5, 1e-4, 7.0, 40_000


class LanguageModel:
    """Word log likelihoods under each language; picklable, bounded by the sample."""

    def __init__(self, rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        self._fit(rows)
        kept = [(t, lab) for t, lab in rows if self.best(t) in (lab, None)]
        if kept:
            self._fit(kept)

    def _fit(self, rows: list[tuple[str, str]]) -> None:
        words: dict[str, Counter] = defaultdict(Counter)
        for text, label in rows:
            words[label].update(w.lower() for w in _RUN.findall(text))
        self.cache: dict[str, np.ndarray] = {}
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table, self.filled = np.zeros((0, len(self.languages))), 0
        self.tri, self.bi, self.word, self.total = {}, {}, {}, {}
        for lang in self.languages:
            tri, bi = Counter(), Counter()
            for w, n in words[lang].items():
                p, n = f"  {w} ", min(n, 200)
                for i in range(len(p) - 2):
                    tri[p[i : i + 3]] += n
                    bi[p[i : i + 2]] += n
            self.tri[lang], self.bi[lang] = dict(tri), dict(bi)
            self.word[lang] = dict(words[lang].most_common(_VOCABULARY))
            self.total[lang] = sum(words[lang].values()) + 1

    def vector(self, run: str) -> np.ndarray:
        """Log likelihood of one run of letters per language, relative to the best and clipped."""
        v = self.cache.get(run)
        if v is None:
            p, out = f"  {run} ", []
            for lang in self.languages:
                tri, bi = self.tri[lang], self.bi[lang]
                c = 0.0
                for i in range(len(p) - 2):
                    c += math.log(max(_FLOOR, tri.get(p[i : i + 3], 0) / (bi.get(p[i : i + 2], 0) + 2.0)))
                seen = self.word[lang].get(run, 0) / self.total[lang]
                out.append(math.log(_WEIGHT_WORD * seen + (1 - _WEIGHT_WORD) * math.exp(max(c, -300.0)) + 1e-140))
            v = np.array(out)
            v = np.maximum(v - v.max(), -_CLIP)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[run] = v
        return v

    def _row(self, w: str, upper: bool) -> int:
        """Index of a token's row in the table, -1 for a token without a letter; codes and links speak for no language."""
        runs = _RUN.findall(w)
        if not runs:
            i = -1
        else:
            if _CODE.search(w) and not upper and not (w.isupper() and w.isalpha() and len(w) < 6):
                v = np.zeros(len(self.languages))
            else:
                v = np.maximum(sum(self.vector(r.lower()) for r in runs), -_CLIP)
            i = len(self.rows)
            self.rows.append(v)
        if not upper:
            self.index[w] = i
        return i

    def words(self, text: str) -> tuple[int, np.ndarray]:
        """The number of the text's words with a letter, and a row of log likelihoods for each."""
        if len(self.rows) > 400_000:
            self.rows, self.index, self.table, self.filled = [], {}, np.zeros((0, len(self.languages))), 0
        upper = text.isupper()
        get = self.index.get
        ids = [get(w) for w in text.split()] if not upper else [self._row(w, True) for w in text.split()]
        if None in ids:
            ids = [self._row(w, False) if (i := get(w)) is None else i for w in text.split()]
        ids = [i for i in ids if i >= 0]
        if len(self.table) < len(self.rows) and ids and max(ids) >= len(self.table):
            grown = np.zeros((max(1024, 2 * len(self.rows)), len(self.languages)))
            grown[: len(self.rows)] = self.rows
            self.table, self.filled = grown, len(self.rows)
        elif self.filled < len(self.rows):
            self.table[self.filled : len(self.rows)] = self.rows[self.filled :]
            self.filled = len(self.rows)
        return len(ids), self.table[ids] if ids else np.zeros((0, len(self.languages)))

    def best(self, text: str) -> str | None:
        _, m = self.words(text)
        return self.languages[int(m.sum(0).argmax())] if len(m) else None


def proportions(ms: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each text's words the proportions of all languages, by expectation-maximisation over the texts at once."""
    sizes = np.array([len(m) for m in ms])
    if not sizes.sum():
        return [np.full(m.shape[1], 1.0 / m.shape[1]) for m in ms]
    some = np.flatnonzero(sizes)
    p = np.exp(np.concatenate([ms[i] for i in some]))
    of = np.repeat(np.arange(len(some)), sizes[some])
    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    pi = np.full((len(some), p.shape[1]), 1.0 / p.shape[1])
    for _ in range(rounds):
        joint = p * pi[of]
        joint /= joint.sum(1, keepdims=True) + 1e-300
        pi = np.add.reduceat(joint, starts, 0) / sizes[some][:, None]
    out = [np.full(p.shape[1], 1.0 / p.shape[1])] * len(ms)
    for i, x in zip(some, pi):
        out[i] = x
    return out


def mixture(m: np.ndarray, langs: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) of words ``m`` under the languages."""
    pi = proportions([m[:, langs]], rounds)[0]
    return pi, float(np.log((np.exp(m[:, langs]) * pi).sum(1) + 1e-300).sum())


def passages(m: np.ndarray, pi: np.ndarray | None = None) -> list[tuple[int, int, int, float, float]]:
    """(language, first word, end word, confidence, proportion of the language in the text) of the words' log likelihoods; pi: the text's proportions of all languages."""
    n = len(m)
    if not n:
        return []
    pi = proportions([m])[0] if pi is None else pi
    total = m.sum(0)
    first = int(total.argmax())
    others = [k for k in np.argsort(-pi, kind="stable") if k != first and pi[k] * n > LEAST_PROPORTION * LEAST_WORDS] if n >= 2 * LEAST_WORDS else []
    langs = [first]
    if others:
        # forward selection by penalised likelihood
        _, ll = mixture(m, langs)
        for k in others:
            _, more = mixture(m, [*langs, int(k)])
            if more - ll > GAIN / 2 + math.log(n):
                langs, ll = [*langs, int(k)], more
    if len(langs) == 1:
        return [(first, 0, n, _confidence(total, first), 1.0)]
    shares = dict(zip(langs, mixture(m, langs)[0]))
    # Viterbi over the words within the chosen set
    c = m[:, langs]
    score, back = c[0].copy(), np.zeros((n, len(langs)), np.int64)
    for i in range(1, n):
        top = int(score.argmax())
        stay = score >= score[top] - SWITCH
        back[i] = np.where(stay, np.arange(len(langs)), top)
        score = np.where(stay, score, score[top] - SWITCH) + c[i]
    path = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    spans = []
    at = 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[at]:
            spans.append([langs[path[at]], at, i])
            at = i
    # short passages go with the one before
    merged: list[list[int]] = []
    for s in spans:
        if merged and (s[2] - s[1] < LEAST_WORDS or s[0] == merged[-1][0]):
            merged[-1][2] = s[2]
        elif merged and merged[-1][2] - merged[-1][1] < LEAST_WORDS:
            merged[-1] = [s[0], merged[-1][1], s[2]]
        else:
            merged.append(s)
    return [(k, a, b, _confidence(m[a:b].sum(0), k), float(shares[k])) for k, a, b in merged]


def _confidence(total: np.ndarray, k: int) -> float:
    """Posterior of the language, evidence tempered because neighbouring words depend on each other."""
    e = np.exp((total - total.max()) / 3.0)
    return float(e[k] / e.sum())


def train(chunks: DataFrame, rows: int = SAMPLE_ROWS, names: dict[str, str] | None = None) -> LanguageModel:
    """Fitted on at most ``rows`` labelled rows a language; the window's limit is applied before its shuffle."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("row_id"), "row_id")
    sample = (
        chunks.select("row_id", "text", language_code(F.col("metadata.language"), names).alias("lang"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= rows)
        .select("text", "lang")
        .collect()
    )
    return LanguageModel([(gate.plain(r.text), r.lang) for r in sample], tuple(sorted(set((names or LANGUAGE_NAMES).values()))))


def segments(chunks: DataFrame, model: LanguageModel | None = None, extra: dict[str, Column] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """(row_id, ..., n_words, passages): passages is an array of (lang, first_word, end_word, confidence, proportion), in order.

    ``names``: the languages' codes by every spelling (:func:`token_budget.language_names`).

    Words are those with a letter.  Null texts and texts without such words have
    no passages.  Damaged text is repaired first, so it has the language it was written in.
    """
    model = model or train(chunks, names=names)
    extra = extra or {}
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_ROWS rows a language
    src = chunks.select("row_id", *(c.alias(n) for n, c in extra.items()), F.col("text").alias("_t"))
    keep = ["row_id", *extra]
    passage = "array<struct<lang:string,first_word:int,end_word:int,confidence:double,proportion:double>>"
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.select(*keep).schema) + f", n_words int, passages {passage}"
    columns = [*keep, "n_words", "passages"]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("confidence", pa.float64()), ("proportion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = shared.value
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), TOGETHER):
                b = whole.slice(at, TOGETHER)
                read = [lm.words(gate.plain(t) if t else "") for t in b.column(len(keep)).to_pylist()]
                found = [
                    [{"lang": lm.languages[k], "first_word": a, "end_word": e, "confidence": c, "proportion": s} for k, a, e, c, s in passages(m, pi)]
                    for (_, m), pi in zip(read, proportions([m for _, m in read]))
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([n for n, _ in read], pa.int32()), pa.array(found, kind)], names=columns)

    return src.mapInArrow(run, out)


def wrong_or_mixed(chunks: DataFrame, model: LanguageModel | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """(row_id, lang): a line per language of the texts of LEAST_WORDS words or more whose label is missing, wrong, or hides a mixture."""
    s = segments(chunks, model, {"label": language_code(F.col("metadata.language"), names)}, names)
    langs = F.array_distinct(F.col("passages.lang"))
    return (
        s.where(F.col("n_words") >= LEAST_WORDS)
        .select("row_id", "label", langs.alias("_l"))
        .where(F.col("label").isNull() | (F.size("_l") > 1) | (F.col("_l")[0] != F.col("label")))
        .select("row_id", F.explode("_l").alias("lang"))
    )
