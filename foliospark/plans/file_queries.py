"""Paged files written from the tables and read back: what comes out must be what went in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources import pdf, pdf_writer
from .layout_queries import _ONCE
from .registry import query, table

#: Pages in a file.
PAGES = 3


def _page(height: float | None, texts: list[dict]) -> pdf_writer.Page:
    placed = [pdf_writer.Text(t["text"], t["x"] or 0.0, t["y"] or 0.0, t["font_size"] or 10.0, t["font_name"] or "Helvetica", t["mcid"], t["struct_tag"]) for t in texts]
    return pdf_writer.Page(placed, height=height or 842.0)


def fragment_files(fragments: DataFrame, damage: int | None = None) -> DataFrame:
    """(path, content): a file for every PAGES pages of a document, named doc_id/first page; ``damage``: the page of each file whose content is spoilt.

    A row holds PAGES pages at most, however long the document is.  Fragments without text are left out.
    """
    f = L.once(fragments).where(F.col("text").isNotNull() & (F.col("text") != ""))
    page = F.struct("seq", "text", "x", "y", "font_size", "font_name", "mcid", "struct_tag")
    pages = f.groupBy("doc_id", "page_idx").agg(F.max("page_height").alias("h"), F.array_sort(F.collect_list(page)).alias("texts"))
    first = (F.floor(F.col("page_idx") / PAGES) * PAGES).cast("int")
    files = pages.groupBy("doc_id", first.alias("first")).agg(F.array_sort(F.collect_list(F.struct("page_idx", "h", "texts"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents = [], []
            for doc, start, got in zip(*(c.to_pylist() for c in b.columns)):
                at = {p["page_idx"] - start: _page(p["h"], p["texts"]) for p in got}
                written = [at.get(i, pdf_writer.Page()) for i in range(max(at) + 1)]
                data = pdf_writer.write(written)
                if damage is not None and damage in at:
                    data = _spoil(data, damage)
                paths.append(f"{doc}/{start}"), contents.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return files.select("doc_id", "first", "pages").mapInArrow(run, "path string, content binary")


def _spoil(data: bytes, page: int) -> bytes:
    """The first bytes of a page's compressed content overwritten."""
    at = -1
    for _ in range(page + 1):
        at = data.index(b"stream\n", data.index(b"endstream", at) + 9 if at >= 0 else 0)
    return data[: at + 7] + b"\xff" * 4 + data[at + 11 :]


def _keyed(rows: DataFrame) -> DataFrame:
    page = F.element_at(F.split("path", "/"), -1).cast("int") + F.col("page_idx")
    return rows.withColumn("doc_id", F.regexp_replace("path", r"/[0-9]+\z", "")).withColumn("page_idx", page)


_TEXTS = f"(SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY seq) - 1 AS k FROM {_ONCE} WHERE text <> '')"


@query("file_fragments", f"SELECT doc_id, page_idx, CAST(k AS INT) AS k, text, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(nullif(font_size, 0), 10) AS font_size, mcid, CASE WHEN mcid IS NULL THEN struct_tag ELSE coalesce(struct_tag, 'Span') END AS tag FROM {_TEXTS}")
def file_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the fragments through a file and back: scan, page tree, fonts, character maps, content operators."""
    rows = _keyed(pdf.parse_files(fragment_files(table(spark, d, "fragments")))).where("text is not null")
    return rows.select("doc_id", "page_idx", F.col("seq").alias("k"), "text", "x", "y", "font_size", "mcid", F.nullif("struct_tag", F.lit("")).alias("tag"))


@query("file_text", f"SELECT doc_id, page_idx, string_agg(text, chr(10) ORDER BY seq) AS text FROM {_ONCE} WHERE text <> '' GROUP BY ALL")
def file_text(spark: SparkSession, d: str) -> DataFrame:
    """The plain text of every page of the files."""
    rows = _keyed(pdf.parse_files(fragment_files(table(spark, d, "fragments")))).where("text is not null")
    return rows.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "\n").alias("text"))


@query("file_recovery", f"SELECT doc_id, page_idx, count(*) AS texts FROM {_TEXTS} WHERE page_idx % {PAGES} <> 1 GROUP BY ALL")
def file_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The texts that stay when the second page of every file is damaged: all of the other pages."""
    rows = _keyed(pdf.parse_files(fragment_files(table(spark, d, "fragments"), damage=1), mode="DROPMALFORMED"))
    return rows.where("text is not null").groupBy("doc_id", "page_idx").agg(F.count("*").alias("texts"))


@query("file_damage", f"SELECT DISTINCT doc_id, page_idx FROM {_ONCE} WHERE text <> '' AND page_idx % {PAGES} = 1")
def file_damage(spark: SparkSession, d: str) -> DataFrame:
    """The damaged pages themselves, as error rows."""
    rows = _keyed(pdf.parse_files(fragment_files(table(spark, d, "fragments"), damage=1)))
    return rows.where("error is not null").select("doc_id", "page_idx")


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a file for each entry of the manifest, with its title, publisher and a linked page; by turns whole, cut off, encrypted and without header."""
    m = table(spark, d, "corpus_manifest").select("slug", "document_name", "publisher", "source_url", F.pmod(F.crc32(F.encode("slug", "UTF-8")), F.lit(4)).cast("int").alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = []
            for slug, title, author, url, turn in zip(*(c.to_pylist() for c in b.columns)):
                page = pdf_writer.Page([pdf_writer.Text(title or "", 50, 700)], links=[((50.0, 690.0, 250.0, 715.0), url or "")])
                info = {k: v for k, v in (("Title", title), ("Author", author), ("Producer", slug)) if v is not None}
                data = pdf_writer.write([page, pdf_writer.Page()], info)
                if turn == 1:
                    data = data[: data.index(b"xref")]
                elif turn == 2:
                    data = data.replace(b"/Info 4 0 R", b"/Info 4 0 R /Encrypt 9 0 R")
                elif turn == 3:
                    data = data[9:]
                contents.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary())], names=["path", "content"])

    return m.mapInArrow(run, "path string, content binary")


@query("file_metadata")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What each file says of itself, whether it is whole and whether it is encrypted."""
    return pdf.scan_metadata(manifest_files(spark, d)).select("path", "valid", "encrypted", "pages", "title", "author", F.col("error").isNotNull().alias("failed"))


@query("file_links")
def file_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of the files that can be read."""
    return pdf.scan_annotations(manifest_files(spark, d)).select("path", "page_idx", "kind", "x0", "y1", "uri")
