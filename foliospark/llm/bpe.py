"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Whether a merge happens at a place can depend on bytes to its right only through
a chain of merges, each of higher priority than the one before and standing at
the right operand of it.  The merge list therefore has a sufficient lookahead,
which is computed from it: once that many bytes behind a token's first are known,
nothing that follows can change the token.  The transducer keeps a window of a
few lookaheads, merges it, emits the tokens that are stable and drops their bytes;
its memory does not grow with the text.  Every pre-token goes through it, and
texts are cut into blocks where a pre-token begins.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

#: The published pre-token pattern of this vocabulary, with white space as Unicode's White_Space property.
_S = r"\p{White_Space}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?!(?!{_S})[\s\S])|{_S}+"
#: Characters of a text that are cut into pre-tokens at once, bytes of a pre-token that are fed at once, and lookaheads in a window.
BLOCK, FEED, WINDOW = 32_768, 4_096, 4
CACHE_ENTRIES = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the token's bytes, white space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes from a token's first on that decide about it, over all merges.

    A merge of x and y, at rank r, waits for the merges of lower rank that make x,
    make y, or take y away to the right; ``made`` and ``reach`` hold the farthest
    byte such merges look at, from the first byte of the token they make or start with.
    """
    made: dict[bytes, int] = {}
    reach: dict[bytes, int] = {}
    most = max(map(len, ranks), default=1)
    for token in sorted(ranks, key=ranks.__getitem__):
        rules = []
        for i in range(1, len(token)):
            x, y = token[:i], token[i:]
            if ranks.get(x, 1 << 60) < ranks[token] and ranks.get(y, 1 << 60) < ranks[token]:
                rules.append((x, max(i + max(len(y), reach.get(y, 0)), made.get(x, 0))))
        for x, far in rules:
            reach[x] = max(far, reach.get(x, 0))
            reach[token] = max(far, reach.get(token, 0))
            made[token] = max(far, made.get(token, 0))
            most = max(most, far)
    return most


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lookahead = sufficient_lookahead(ranks)
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {v: k for k, v in ranks.items()}

    def merge(self, b: bytes) -> list[bytes]:
        """The defining procedure: join the leftmost pair of lowest rank until none is left."""
        rank, n = self.ranks.get, len(b)
        if n > 48:
            return self._merge_by_heap(b)
        parts = [b[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_by_heap(self, b: bytes) -> list[bytes]:
        """The same, with the pairs in a heap and the parts in a linked list."""
        rank, n = self.ranks.get, len(b)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, e = heapq.heappop(heap)
            if end[i] != m or m >= n or end[m] != e:
                continue
            end[i], end[m] = e, -1
            if e < n:
                before[e] = i
                if (r := rank(b[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, e, end[e]))
            if (k := before[i]) >= 0 and (r := rank(b[k:e])) is not None:
                heapq.heappush(heap, (r, k, i, e))
        out, i = [], 0
        while i < n:
            out.append(b[i : end[i]])
            i = end[i]
        return out

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that arrives in pieces; never holds more than a window and a piece."""
        buf, ranks, ahead = b"", self.ranks, self.lookahead
        for piece in pieces:
            for at in range(0, len(piece), ahead * WINDOW):
                buf += piece[at : at + ahead * WINDOW]
                if len(buf) >= ahead * WINDOW:
                    done = 0
                    for t in self.merge(buf):
                        if done + ahead > len(buf):
                            break
                        yield ranks[t]
                        done += len(t)
                    buf = buf[done:]
        for t in self.merge(buf):
            yield ranks[t]

    def piece(self, p: str) -> tuple[int, ...]:
        """Ids of a pre-token; those of usual length are remembered."""
        ids = tuple(self.stream(p[i : i + FEED].encode("utf-8", "replace") for i in range(0, len(p), FEED)))
        if len(p) < 256:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[p] = ids
        return ids

    @staticmethod
    def blocks(text: str) -> Iterator[str]:
        """The text in blocks that begin where a pre-token does: at a blank between two characters that aren't white."""
        start, n = 0, len(text)
        while n - start > BLOCK:
            at = text.find(" ", start + BLOCK)
            while at > 0 and at + 1 < n and (text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0 or at + 1 >= n:
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; [] for null and empty."""
        out: list[int] = []
        if text:
            get, miss, extend = self.cache.get, self.piece, out.extend
            for block in self.blocks(text):
                for p in self.find(block):
                    extend(get(p) or miss(p))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, miss = self.cache.get, self.piece
        return sum(len(get(p) or miss(p)) for block in self.blocks(text) for p in self.find(block))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are whole characters: an incremental UTF-8 state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.bytes_of[i]):
                yield s
        if s := machine.decode(b"", True):
            yield s


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(load_ranks(path))
