"""The token-efficient tabular form: a tab-separated row per chunk, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "chunk_id", "pages", "tokens", "content")


def encode_line(content: Column, *others: Column) -> Column:
    """Columns joined by tabs, the content last; quoted only where it holds a quote or a line break; null is empty."""
    quoted = F.when(content.rlike('["\\n\\r]'), F.concat(F.lit('"'), F.replace(content, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(content)
    return F.concat_ws("\t", *[F.coalesce(o.cast("string"), F.lit("")) for o in others], F.coalesce(quoted, F.lit("")))


def decode_line(line: Column) -> Column:
    """(id, chunk_id, pages, tokens, content) of a line; raises on a wrong number of columns or a dangling quote.  Tabs in content are raw."""
    parts = F.split(line, "\t", len(COLUMNS))
    content = F.element_at(parts, len(COLUMNS))
    inner = F.substring(content, F.lit(2), F.length(content) - 2)
    open_ = content.startswith('"')
    bare = F.replace(inner, F.lit('""'), F.lit(""))
    bad = (F.size(parts) != len(COLUMNS)) | (open_ & ((F.length(content) < 2) | ~content.endswith('"') | bare.contains('"')))
    value = F.when(open_, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(content)
    pages = F.filter(F.split(parts[2], ";"), lambda p: p != "")
    good = F.struct(parts[0].alias("id"), parts[1].alias("chunk_id"), F.transform(pages, lambda p: p.cast("int")).alias("pages"), F.nullif(parts[3], F.lit("")).cast("long").alias("tokens"), value.alias("content"))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), F.left(line, F.lit(80))))).otherwise(good)


def encode(chunks: DataFrame) -> DataFrame:
    m = lambda c: F.col(f"metadata.{c}")
    return chunks.select("row_id", encode_line(F.col("text"), F.col("id"), m("chunk_id"), F.array_join(m("page_numbers"), ";"), m("token_estimate")).alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    return lines.select("row_id", decode_line(F.col("line")).alias("c")).select("row_id", "c.*")
