"""Heading paths, pairs and tables from positions, and the pipeline from elements to linked chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import hybrid_chunks, linked


def heading_paths(elements: DataFrame, size: str) -> DataFrame:
    """(doc_id, page_idx, elem_seq, path): the open titles above each element of a page, largest size first; a title closes those of its level and below.

    Sizes within 5 % are one level.  Paths restart on every page.  The page's
    elements are folded as one array in the JVM; a page bounds the array.
    """
    e = elements.dropDuplicates(["doc_id", "elem_seq"])
    item = F.struct("elem_seq", F.when(F.col("elem_type") == "title", F.col(size)).alias("size"), F.when(F.col("elem_type") == "title", F.col("text")).alias("title"))
    pages = e.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<struct<size:double,title:string>>")
    start = F.struct(none.alias("open"), F.array().cast("array<struct<elem_seq:int,path:array<string>>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        above = F.filter(s["open"], lambda o: o["size"] > x["size"] * 1.05)
        now = F.when(x["title"].isNotNull(), F.concat(above, F.array(F.struct(x["size"].cast("double").alias("size"), x["title"].alias("title"))))).otherwise(s["open"])
        return F.struct(now.alias("open"), F.concat(s["out"], F.array(F.struct(x["elem_seq"].alias("elem_seq"), F.transform(now, lambda o: o["title"]).alias("path")))).alias("out"))

    return pages.select("doc_id", "page_idx", F.inline(F.aggregate("items", start, step, lambda s: s["out"])))


def spatial_pairs(lines: DataFrame, gap: float = 20.0) -> DataFrame:
    """(doc_id, page_idx, line_id, key, value): lines of exactly two fragments that stand more than ``gap`` apart."""
    parts = F.array_sort(F.collect_list(F.struct("x", "width", "text")))
    two = lines.groupBy("doc_id", "page_idx", "line_id").agg(parts.alias("p")).where(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    return two.where(b["x"] - (a["x"] + a["width"]) > gap).select("doc_id", "page_idx", "line_id", a["text"].alias("key"), b["text"].alias("value"))


def nearest_cells(fragments: DataFrame, columns: DataFrame, tolerance: float) -> DataFrame:
    """Each fragment with its nearest column of the page (ties to the left), if within twice the tolerance.

    A range-free equi join on the page: a page's columns bound the group, and the nearest is kept by an aggregate, not a sort.
    """
    near = fragments.join(columns.select("doc_id", "page_idx", "col", F.col("x").alias("_cx")), ["doc_id", "page_idx"])
    return near.groupBy("doc_id", "page_idx", "seq").agg(F.min(F.struct(F.abs(F.col("x") - F.col("_cx")).alias("distance"), "col")).alias("m")).where(F.col("m.distance") <= 2 * tolerance).select("doc_id", "page_idx", "seq", "m.col", "m.distance")


def text_positions(fragments: DataFrame, separator: int = 1) -> DataFrame:
    """(doc_id, page_idx, seq, start, stop): offsets of the fragments in a page's joined text."""
    w = Window.partitionBy("doc_id", "page_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length("text")
    start = F.coalesce(F.sum(n + separator).over(w), F.lit(0))
    return fragments.select("doc_id", "page_idx", "seq", start.alias("start"), n.alias("n")).select("doc_id", "page_idx", "seq", "start", (F.col("start") + F.col("n")).alias("stop"))


@dataclass
class AnalysisPipeline:
    """What may be replaced: the strategy (elements to chunk rows), a labeller (a Column) and enrichers (name to Column), applied in order."""

    strategy: Callable[[DataFrame], DataFrame] = hybrid_chunks
    label: Column | None = None
    enrichers: dict[str, Column] = field(default_factory=dict)
    heading: bool = True

    def run(self, elements: DataFrame) -> DataFrame:
        """Linked chunks with full_text, ids, counts, flags and an ``extra`` map."""
        if self.label is not None:
            elements = elements.withColumn("class_label", self.label)
        c = self.strategy(elements)
        full = F.when(F.col("heading").isNull() | F.lit(not self.heading), F.col("text")).otherwise(F.concat("heading", F.lit("\n\n"), "text"))
        c = c.withColumn("full_text", full).withColumn("chunk_id", T.chunk_id(F.col("full_text"), F.col("chunk_index")))
        c = c.withColumns({"char_count": F.char_length("text"), "word_count": T.word_count(F.col("text")), "sentence_count": T.sentence_count(F.col("text"))})
        extra = [x for k, v in self.enrichers.items() for x in (F.lit(k), v.cast("string"))]
        return linked(c.withColumn("extra", F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")), "doc_id", "chunk_index")


def word_table(boxes: pd.DataFrame, tolerance: float = 5.0) -> list[list[str]]:
    """A grid from positions: rows by chained y, columns by chained x; empty where nothing stands."""

    def groups(values: list[float]) -> list[float]:
        out: list[list[float]] = []
        for v in sorted(values):
            if out and v - out[-1][-1] <= tolerance:
                out[-1].append(v)
            else:
                out.append([v])
        return [sum(g) / len(g) for g in out]

    rows, cols = groups(list(boxes.y))[::-1], groups(list(boxes.x))
    grid = [["" for _ in cols] for _ in rows]
    for x, y, t in zip(boxes.x, boxes.y, boxes.text):
        r, c = min(range(len(rows)), key=lambda i: abs(rows[i] - y)), min(range(len(cols)), key=lambda i: abs(cols[i] - x))
        grid[r][c] = f"{grid[r][c]} {t}".strip()
    return grid


def spatial_tables(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, rows, confidence): the grid of a page's fragments tagged as cells, at most one a page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = word_table(pdf.sort_values("seq"))
        cells = [c for r in g for c in r]
        confidence = min(1.0, sum(c != "" for c in cells) / max(1, len(cells)) + min((len(g) + len(g[0])) / 10.0, 0.2))
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "page_idx": [pdf.page_idx.iloc[0]], "rows": [g], "confidence": [confidence]})

    cells = fragments.where(F.col("struct_tag").isin("TD", "TH")).dropDuplicates(["doc_id", "page_idx", "seq"])
    return cells.select("doc_id", "page_idx", "seq", "x", "y", "text").groupBy("doc_id", "page_idx").applyInPandas(run, "doc_id string, page_idx int, rows array<array<string>>, confidence double")
