"""Problem 3: cut oversized texts at natural boundaries, with overlap.

Words are runs between Unicode white space.  Every word end is a boundary with a
rank: paragraph, sentence, line, clause, plain word.  Each boundary is joined to
its farthest legal successor, legal being the boundaries of the best rank there is
between half the limit and the limit, of which the overlap carried over from the
piece before is a part.  The
successor table of a whole batch of texts is one array, so squaring it (pointer
doubling) derives all greedy cuts of all texts in a logarithmic number of
vectorised steps.  Only oversized texts reach this stage; the others pass by as
they are, counted in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

MAX_WORDS, OVERLAP = 512, 50
_WORD = regex.compile(r"\P{White_Space}+")
_SENTENCE = regex.compile(r"[.!?…。;·]+[\"'”’»)\]]*$")
#: A natural boundary counts from this share of the limit on, so pieces don't become tiny.
LEAST_FILL = 0.5


def _ranks(text: str, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word: 4 paragraph, 3 sentence, 2 line, 1 clause, 0 plain; of the boundary after it."""
    rank = np.zeros(len(ends), np.int8)
    for i in range(len(ends)):
        gap = text[ends[i] : starts[i + 1]] if i + 1 < len(ends) else "\n\n"
        breaks = gap.count("\n") or gap.count("\r")
        last = text[ends[i] - 1]
        if breaks > 1:
            rank[i] = 4
        elif last in ".!?…。\"'”’»)]" and _SENTENCE.search(text[max(starts[i], ends[i] - 8) : ends[i]]):
            rank[i] = 3
        elif breaks:
            rank[i] = 2
        elif last in ",:;–—":
            rank[i] = 1
    return rank


def successors(rank: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """succ[i]: the cut after cut i (word positions; cut 0 is the start); the last position is its own successor."""
    n = len(rank)
    succ = np.empty(n + 1, np.int64)
    best: list[np.ndarray] = []  # best[k][p]: the last cut position <= p of rank >= k + 1
    for k in (1, 2, 3, 4):
        at = np.where(rank >= k, np.arange(1, n + 1), 0)
        best.append(np.concatenate([[0], np.maximum.accumulate(at)]))
    i = np.arange(n + 1)
    carried = np.minimum(i, overlap)
    far = np.minimum(i + limit - carried, n)
    least = np.minimum(i + np.maximum(1, ((limit - carried) * LEAST_FILL).astype(np.int64)), n)
    succ[:] = far
    for k in range(4):
        p = best[k][far]
        succ = np.where((p >= least) & (far < n), p, succ)
    succ[n] = n
    return succ


def greedy_cuts(tables: list[np.ndarray]) -> list[np.ndarray]:
    """All cuts reached from 0 in each table, by squaring the joined table of all texts."""
    offsets = np.cumsum([0, *(len(t) for t in tables)])
    step = np.concatenate([t + o for t, o in zip(tables, offsets)])
    reached = np.zeros(len(step), bool)
    reached[offsets[:-1]] = True
    while True:
        now = reached.copy()
        now[step[reached]] = True
        if (now == reached).all() and (step[step] == step).all():
            break
        reached, step = now, step[step]
    return [np.flatnonzero(reached[a:b]) for a, b in zip(offsets, offsets[1:])]


def pieces_of(texts: list[str], limit: int = MAX_WORDS, overlap: int = OVERLAP) -> list[list[tuple[str, int, int]]]:
    """For each text its pieces as (text, first new word, end word)."""
    overlap = max(0, min(overlap, limit - 1))
    spans = [[m.span() for m in _WORD.finditer(t)] for t in texts]
    tables = []
    for t, s in zip(texts, spans):
        starts, ends = np.array([a for a, _ in s], np.int64), np.array([b for _, b in s], np.int64)
        tables.append(successors(_ranks(t, ends, starts), limit, overlap))
    out = []
    for t, s, cuts in zip(texts, spans, greedy_cuts(tables)):
        row = []
        for a, b in zip(cuts, cuts[1:]):
            first = max(0, a - overlap)
            row.append((t[s[first][0] : s[b - 1][1]], int(a), int(b)))
        out.append(row)
    return out


def split_oversized(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, piece, n_words, first_word): pieces of at most ``limit`` words.

    Texts within the limit, empty ones included, are one piece as they are; null
    texts give none.  piece_no counts from 1; each later piece begins with the
    last ``overlap`` words before its cut.
    """
    sized = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), word_count(F.col(text)).alias("_n"))
    small = sized.where(F.col("_n") <= limit).select(
        key, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.col("_t").alias("piece"), F.col("_n").cast("int").alias("n_words"), F.lit(0).alias("first_word")
    )
    return small.unionByName(split_large(sized.where(F.col("_n") > limit).select(key, F.col("_t").alias(text)), key, text, limit, overlap))


def split_large(df: DataFrame, key: str, text: str, limit: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of texts that are known to be over the limit."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, piece_no int, n_pieces int, piece string, n_words int, first_word int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [
                    (k, i + 1, len(ps), p, e - max(0, a - overlap), a)
                    for k, ps in zip(b.column(0).to_pylist(), pieces_of(b.column(1).to_pylist(), limit, overlap))
                    for i, (p, a, e) in enumerate(ps)
                ]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())))], names=[key, "piece_no", "n_pieces", "piece", "n_words", "first_word"])

    return df.select(key, text).mapInArrow(run, schema)


def oversized_rows(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = MAX_WORDS) -> DataFrame:
    """(key): rows that the splitter cuts into more than one piece."""
    large = df.select(key, text).where(F.col(text).isNotNull() & (word_count(F.col(text)) > limit))
    return split_large(large, key, text, limit).where("piece_no = 1 and n_pieces > 1").select(key)
