"""Problem 1: tokens per source, language and country.

Texts are normalised into segments (words between Unicode white space).  A
segment costs one under the project's default counter, its byte-level BPE length
under a merge-based vocabulary, and its best-path length under a unigram
vocabulary: a double-array trie over the pieces drives a count-only Viterbi that
keeps scores and lengths, no back pointers.  Segment costs are remembered in
each worker, so a corpus pays for its distinct segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import tokenizer_path

SPACE = "▁"
CACHE_ENTRIES = 500_000
_SEGMENT = regex.compile(r"\P{White_Space}+")


class DoubleArrayTrie:
    """Pieces as UTF-8 bytes in base / check arrays; value[s] is the piece's index or -1."""

    def __init__(self, pieces: list[bytes]):
        keys = sorted((p, i) for i, p in enumerate(pieces) if p)
        base, check, value, taken = [0], [0], [-1], bytearray(1)
        free = top = 258  # the first slot that may be free (any byte reaches it); behind the last one taken

        def room(n: int) -> None:
            if n >= len(check):
                more = n + 4096 - len(check)
                base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more), taken.extend(bytes(more))

        room(top)
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            runs, at = [], lo
            while at < hi:
                b, end = keys[at][0][depth], at
                while end < hi and keys[end][0][depth] == b:
                    end += 1
                runs.append((b + 1, at, end))
                at = end
            first = runs[0][0]
            # one child takes the first hole; several look for room among the last slots, then behind them
            at = free if len(runs) == 1 else max(free, top - self.SEARCH)
            while True:
                room(at + 300)
                if at > first and not any(taken[at - first + c] for c, _, _ in runs):
                    break
                at += 1
            base[state] = at - first
            for c, a, e in runs:
                slot = at - first + c
                taken[slot], check[slot] = 1, state
                top = max(top, slot + 1)
                todo.append((slot, a, e, depth + 1))
            while taken[free]:
                free += 1
                room(free + 1)
        self.base, self.check, self.value = base, check, value

    #: How far back a branching node looks for room.
    SEARCH = 256


class UnigramCounter:
    """Length of the best segmentation of a segment under (piece, log probability) pairs.

    A character that no piece covers costs ``unknown`` and one token, or with
    ``byte_fallback`` one token a byte.  On equal scores the path whose last
    piece is longest is kept.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, unknown: float | None = None):
        self.trie = DoubleArrayTrie([p.encode() for p, _ in vocabulary])
        self.scores = [s for _, s in vocabulary]
        self.unknown = min(self.scores, default=0.0) - 10.0 if unknown is None else unknown
        self.byte_fallback = byte_fallback
        self.cache: dict[str, int] = {}

    def _viterbi(self, b: bytes) -> int:
        n = len(b)
        best, length = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, top = self.trie.base, self.trie.check, self.trie.value, self.scores, len(self.trie.check)
        for i in range(n):
            if b[i] & 0xC0 == 0x80:  # inside a character
                continue
            here, count = best[i], length[i]
            width = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            s, j, single = 0, i, False
            while j < n:
                t = base[s] + b[j] + 1
                if base[s] <= 0 or t >= top or check[t] != s:
                    break
                s, j = t, j + 1
                v = value[s]
                if v >= 0:
                    single |= j - i == width
                    x = here + scores[v]
                    if x > best[j]:
                        best[j], length[j] = x, count + 1
            if not single:
                j, x = min(n, i + width), here + self.unknown
                if x > best[j]:
                    best[j], length[j] = x, count + (width if self.byte_fallback else 1)
        return length[n]

    def segment(self, s: str) -> int:
        n = self.cache.get(s)
        if n is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            n = self.cache[s] = self._viterbi((SPACE + s).encode("utf-8", "replace"))
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.segment, _SEGMENT.findall(text))) if text else 0


@lru_cache(2)
def unigram_from_file(path: str) -> UnigramCounter:
    """Pieces of a .model file.  Where the file gives ranks instead of log probabilities, a piece of rank r gets -log(r + 2), as words of a language are distributed."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = [sp.get_score(i) for i in ids]
    ranked = all(s == round(s) for s in scores)
    return UnigramCounter([(sp.id_to_piece(i), -math.log(2 - s) if ranked else s) for i, s in zip(ids, scores)])


def language_names(codes: DataFrame) -> dict[str, str]:
    """The two-letter code by every lower-case code and name of lang_codes, a fixed table of one row a language."""
    return {v.lower(): r.lang for r in codes.select("lang", "code_t", "code_b", "name_en", "name_own").collect() for v in r if v}


def language_code(label: Column, names: dict[str, str] | None = None) -> Column:
    """Two-letter code of a label in one of the usual spellings (es-ES, spa, Spanish, español); null where it names no language."""
    of = F.create_map(*[F.lit(x) for pair in (names or LANGUAGE_NAMES).items() for x in pair])
    low = F.lower(F.trim(label))
    return F.coalesce(of[low], of[F.regexp_extract(low, r"^([a-z]{2,3})[-_]", 1)])


# Codes and names of the eight languages (table lang_codes).
LANGUAGE_NAMES = {
    "en": "en", "eng": "en", "english": "en",
    "es": "es", "spa": "es", "spanish": "es", "español": "es",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "it": "it", "ita": "it", "italian": "it", "italiano": "it",
    "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt",
    "ru": "ru", "rus": "ru", "russian": "ru", "русский": "ru",
    "el": "el", "ell": "el", "gre": "el", "greek": "el", "ελληνικά": "el",
}


def count_chunks(chunks: DataFrame, bpe_path: str | None = None, unigram_path: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Per row: n_words (default counter), n_bpe, n_unigram; 0 for null texts.  No text leaves the stage."""
    bpe_path, unigram_path = bpe_path or tokenizer_path("byte_bpe_50k.tiktoken"), unigram_path or tokenizer_path("piece_bpe_32k.model")
    kept = chunks.select(
        "row_id", "id", "ingested_at", F.col("metadata.document_name").alias("document_name"), language_code(F.col("metadata.language"), names).alias("language"),
        F.nullif(F.upper(F.trim("metadata.country")), F.lit("")).alias("country"), F.col("metadata.token_estimate").alias("token_estimate"), "text",
    )
    out = kept.drop("text").schema.add("n_words", "long").add("n_bpe", "long").add("n_unigram", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, uni = encoder(bpe_path).count, unigram_from_file(unigram_path)
        for b in batches:
            words, pieces, tokens = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                segments = _SEGMENT.findall(t or "")
                words.append(len(segments))
                pieces.append(bpe(t))
                tokens.append(sum(map(uni.segment, segments)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in (words, pieces, tokens))], names=out.names)

    return kept.mapInArrow(run, out)


def budget(chunks: DataFrame, names: dict[str, str] | None = None, **paths: str) -> DataFrame:
    """Totals by document_name, language and country, each chunk id once (its last delivery; ties: the higher row_id); a row without id is a chunk of its own.

    Null slices stay as null; wrong_estimates counts chunks whose stored estimate is null or isn't the number of words.
    """
    last = (
        count_chunks(chunks, names=names, **paths)
        .groupBy(F.coalesce("id", F.concat(F.lit("\x00"), F.col("row_id").cast("string"))))
        .agg(F.max_by(F.struct("document_name", "language", "country", "token_estimate", "n_words", "n_bpe", "n_unigram"), F.struct("ingested_at", "row_id")).alias("c"), F.count("*").alias("n"))
        .select("c.*", "n")
    )
    return last.groupBy("document_name", "language", "country").agg(
        F.count("*").alias("chunks"), F.sum("n").alias("deliveries"), F.sum("n_words").alias("words"), F.sum("n_bpe").alias("bpe_tokens"), F.sum("n_unigram").alias("unigram_tokens"),
        F.sum(F.coalesce("token_estimate", F.lit(0))).alias("stored_estimate"), F.sum((~F.col("token_estimate").eqNullSafe(F.col("n_words"))).cast("long")).alias("wrong_estimates"),
    )


def wrong_estimates(chunks: DataFrame) -> DataFrame:
    """(row_id): rows whose token_estimate is null or isn't the number of words that the operator counts (0 for null)."""
    return count_chunks(chunks).where(~F.col("token_estimate").eqNullSafe(F.col("n_words"))).select("row_id")
