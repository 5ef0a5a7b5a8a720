"""Chunkers: fixed windows of words, and budgets over elements or sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LOOK_BACK = 10


_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def window_spans(tokens: list[str], size: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, respected) of each window over the tokens, in time linear in them.

    A window ends after a token with a sentence mark when one lies among its last
    LOOK_BACK tokens, the last of them.  No tokens give no windows.
    """
    size = max(size, 1)
    overlap, n, start = min(overlap, size - 1), len(tokens), 0
    while start < n:
        end = full = min(start + size, n)
        respected = False
        if full < n:
            for i in range(full, max(full - LOOK_BACK, start + 2) - 1, -1):
                if tokens[i - 1][-1] in ".!?":
                    end, respected = i, True
                    break
        yield start, end, respected
        if end >= n:
            return
        start = end - overlap if end - overlap > start else end


#: Windows of a batch that leaves a worker, so that a very long text doesn't have to be there in all its windows.
OUT_ROWS = 4096


def fixed_windows(df: DataFrame, key: str, text: str, size: int, overlap: int, content: bool = True) -> DataFrame:
    """(key, chunk_index, content, n_tokens, start_token, respected): windows of ``size`` words; with ``content`` false the first two and the numbers only.

    Null and blank texts give none.  A text is cut into words once and its windows
    are slices of them; no row carries the words of its text.
    """
    schema = df.select(key).schema.add("chunk_index", "integer")
    if content:
        schema = schema.add("content", "string")
    schema = schema.add("n_tokens", "integer").add("start_token", "integer").add("respected", "boolean")
    types = [pa.int32(), *([pa.string()] if content else []), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows)) or [()] * len(types)
                made = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)
                at.clear(), rows.clear()
                return made

            for i, t in enumerate(b.column(1).to_pylist()):
                tokens = _WORD.findall(t)
                for k, (start, end, respected) in enumerate(window_spans(tokens, size, overlap)):
                    at.append(i)
                    rows.append((k, " ".join(tokens[start:end]), end - start, start, respected) if content else (k, end - start, start, respected))
                    if len(rows) >= OUT_ROWS:
                        yield out()
            yield out()

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def linked(chunks: DataFrame, doc: str, index: str, chunk_id: str = "chunk_id") -> DataFrame:
    """prev_chunk_id and next_chunk_id in document order."""
    w = Window.partitionBy(doc).orderBy(index)
    return chunks.withColumn("prev_chunk_id", F.lag(chunk_id).over(w)).withColumn("next_chunk_id", F.lead(chunk_id).over(w))


def pack_sentences(text: Column, max_words: int) -> Column:
    """Sentences packed greedily up to ``max_words``, joined by a space; a longer sentence stays whole; a blank text returns itself."""
    parts = T.sentences(text)
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        k = T.word_count(x)
        fits = s["cur"].isNotNull() & (s["n"] + k <= max_words)
        return F.struct(
            F.when(s["cur"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))).alias("done"),
            F.when(fits, F.concat(s["cur"], F.lit(" "), x)).otherwise(x).alias("cur"),
            F.when(fits, s["n"] + k).otherwise(k).alias("n"),
        )

    packed = F.aggregate(parts, init, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
    return F.when(F.size(parts) == 0, F.array(text)).otherwise(packed)


INLINE = ("paragraph", "list_item", "key_value")
SPLITTABLE = ("paragraph", "list_item")
WHOLE = ("title", "table", "image", "header", "footer")


def display_text(elem_type: Column, text: Column, kv_key: Column, kv_value: Column, cells: Column, alt: Column) -> Column:
    """What an element shows: rows of cells joined by ' | ' and line feeds, 'key: value', alt text, else its text."""
    rows = F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    return (
        F.when(elem_type == "table", F.coalesce(rows, F.lit(""))).when(elem_type == "key_value", F.concat(F.coalesce(kv_key, F.lit("")), F.lit(": "), F.coalesce(kv_value, F.lit(""))))
        .when(elem_type == "image", F.coalesce(alt, F.lit(""))).otherwise(F.coalesce(text, F.lit("")))
    )


def _sentences(t: str) -> list[str]:
    out, cur = [], ""
    for i, c in enumerate(t):
        if c == "\n":
            out.append(cur)
            cur = ""
        elif c == " " and i and t[i - 1] in ".!?":
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [s.strip() for s in [*out, cur] if s.strip()]


#: A token counter: any function of a text; sums over parts are taken for the whole.
TokenCounter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


def characters_over_four(text: str) -> int:
    """An estimate for texts of any language: four characters a token, rounded up."""
    return -(-len(text) // 4)


class HybridFold:
    """Chunks of a document's elements as they come in order, under a budget of words over the joined text; holds one chunk."""

    def __init__(self, max_tokens: int = 512, merge: bool = True, count: TokenCounter = count_words):
        self.max_tokens, self.merge, self.tokens = max_tokens, merge, count
        self.buf: list[dict] = []
        self.cost = 0

    def _chunk(self, items: list[dict], text: str, over: bool) -> dict:
        return {"text": text, "heading": items[0]["heading"], "n_elements": len(items), "tokens": self.tokens(text), "oversized": over, "first_seq": items[0]["seq"]}

    def end(self) -> Iterator[dict]:
        if self.buf:
            yield self._chunk(self.buf, "\n".join(x["text"] for x in self.buf), False)
        self.buf, self.cost = [], 0

    def push(self, e: dict) -> Iterator[dict]:
        n = self.tokens(e["text"])
        if self.merge and self.buf and self.buf[-1]["type"] in INLINE and e["type"] in INLINE and self.cost + n <= self.max_tokens:
            self.buf.append(e)
            self.cost += n
            return
        yield from self.end()
        if n <= self.max_tokens:
            self.buf, self.cost = [e], n
        elif e["type"] in SPLITTABLE:
            cur = ""
            for s in _sentences(e["text"]):
                if cur and self.tokens(cur) + self.tokens(s) > self.max_tokens:
                    yield self._chunk([e], cur, self.tokens(cur) > self.max_tokens)
                    cur = s
                else:
                    cur = f"{cur} {s}" if cur else s
            if cur:
                yield self._chunk([e], cur, self.tokens(cur) > self.max_tokens)
        else:
            yield self._chunk([e], e["text"], True)


_MARKED = re.compile(r"[^.!?]*[.!?]", re.S)


def greedy_sentences(text: str) -> list[str]:
    """Each sentence mark ends a sentence; what follows the last mark belongs to the last sentence."""
    out = [m.group().strip() for m in _MARKED.finditer(text)]
    rest = text[sum(m.end() - m.start() for m in _MARKED.finditer(text)) :].strip()
    if rest and out:
        out[-1] += " " + rest
    return out or ([rest] if rest else [])


class SemanticFold:
    """Greedy chunks by elements as they come in order; titles, tables, images, headers and footers are never split.

    After a chunk its trailing elements of up to ``overlap`` words are carried on.  They
    count against the budget of an element that is never split and of one that still
    fits, and no longer once another element has opened the next chunk.
    """

    def __init__(self, max_tokens: int = 512, overlap: int = 50, count: TokenCounter = count_words):
        self.max_tokens, self.overlap, self.tokens = max_tokens, overlap, count
        self.buf: list[tuple[str, int]] = []
        self.count = 0

    def _chunk(self, parts: list[str], over: bool = False) -> dict:
        text = "\n".join(parts)
        return {"text": text, "n_elements": len(parts), "tokens": self.tokens(text), "oversized": over}

    def _flush(self) -> Iterator[dict]:
        if not self.buf:
            return
        yield self._chunk([t for t, _ in self.buf])
        keep: list[tuple[str, int]] = []
        total = 0
        if self.overlap > 0:
            for t, n in reversed(self.buf):
                if keep and total + n > self.overlap:
                    break
                keep.append((t, n))
                total += n
        self.buf, self.count = keep[::-1], total

    def push(self, e: dict) -> Iterator[dict]:
        n = self.tokens(e["text"])
        if e["type"] in WHOLE:
            if self.count > 0 and self.count + n > self.max_tokens:
                yield from self._flush()
            if n > self.max_tokens and not self.buf:
                yield self._chunk([e["text"]], True)
            else:
                self.buf.append((e["text"], n))
                self.count += n
        elif self.count + n <= self.max_tokens:
            self.buf.append((e["text"], n))
            self.count += n
        elif n <= self.max_tokens:
            yield from self._flush()
            self.buf.append((e["text"], n))
            self.count = n
        else:
            yield from self._flush()
            cur, k = "", 0
            for s in greedy_sentences(e["text"]):
                m = self.tokens(s)
                if cur and k + m > self.max_tokens:
                    yield self._chunk([cur])
                    cur, k = "", 0
                cur = f"{cur} {s}" if cur else s
                k += m
            if cur:
                self.buf.append((cur, k))
                self.count = k

    def end(self) -> Iterator[dict]:
        if self.buf:
            yield self._chunk([t for t, _ in self.buf])
        self.buf, self.count = [], 0


def fold_documents(shown: DataFrame, make: Callable[[], HybridFold | SemanticFold], columns: dict[str, pa.DataType]) -> DataFrame:
    """Elements (doc_id, elem_seq, elem_type, heading, shown) to chunks (doc_id, chunk_index, ...columns).

    Documents lie together and in order within a partition and stream through the
    fold, so a worker holds one chunk of one document, however long that is.
    """
    names = ["doc_id", "chunk_index", *columns]
    spark_types = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    schema = f"doc_id {shown.schema['doc_id'].dataType.simpleString()}, chunk_index int, " + ", ".join(f"{c} {spark_types[t]}" for c, t in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, doc, index = make(), None, 0
        rows: list[tuple] = []

        def add(chunks: Iterator[dict]) -> None:
            nonlocal index
            for c in chunks:
                rows.append((doc, index, *(c[x] for x in columns)))
                index += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), pa.array(cols[1], pa.int32()), *(pa.array(c, t) for c, t in zip(cols[2:], columns.values()))], names=names)
            rows.clear()
            return made

        doc_type = pa.string()
        for b in batches:
            doc_type = b.schema.field(0).type
            for d, seq, kind, heading, text in zip(*(c.to_pylist() for c in b.columns)):
                if d != doc:
                    add(fold.end())
                    doc, index = d, 0
                add(fold.push({"seq": seq, "type": kind, "heading": heading, "text": text}))
            if len(rows) >= OUT_ROWS:
                yield out()
        add(fold.end())
        yield out()

    ordered = shown.repartition("doc_id").sortWithinPartitions("doc_id", "elem_seq")
    return ordered.mapInArrow(run, schema)


def _shown(elements: DataFrame) -> DataFrame:
    return elements.dropDuplicates(["doc_id", "elem_seq"]).select(
        "doc_id", F.col("elem_seq").cast("int").alias("elem_seq"), "elem_type", "parent_heading",
        display_text(F.col("elem_type"), F.col("text"), F.col("kv_key"), F.col("kv_value"), F.col("table_cells"), F.col("alt_text")).alias("shown"),
    )


def hybrid_chunks(elements: DataFrame, max_tokens: int = 512, merge: bool = True, count: TokenCounter = count_words) -> DataFrame:
    """Elements (doc_id, elem_seq, elem_type, text, ...) to chunks under a budget of tokens, words unless another counter is given, in document order."""
    columns = {"text": pa.string(), "heading": pa.string(), "n_elements": pa.int32(), "tokens": pa.int32(), "oversized": pa.bool_(), "first_seq": pa.int32()}
    return fold_documents(_shown(elements), lambda: HybridFold(max_tokens, merge, count), columns)


def semantic_chunks(elements: DataFrame, max_tokens: int = 512, overlap: int = 50, count: TokenCounter = count_words) -> DataFrame:
    columns = {"text": pa.string(), "n_elements": pa.int32(), "tokens": pa.int32(), "oversized": pa.bool_()}
    return fold_documents(_shown(elements), lambda: SemanticFold(max_tokens, overlap, count), columns)
