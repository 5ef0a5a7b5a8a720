"""Fragments and elements: order, clusters, classes, statistics and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout as L
from .registry import query, sql_words, table

_ONCE = "(SELECT DISTINCT ON (doc_id, page_idx, seq) * FROM fragments)"
_ELEMS = "(SELECT DISTINCT ON (doc_id, elem_seq) * FROM elements)"


@query("reading_order", f"SELECT doc_id, page_idx, seq, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, x, seq) - 1 AS pos FROM {_ONCE}")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_idx").orderBy(F.desc("y"), "x", "seq")
    return L.once(table(spark, d, "fragments")).select("doc_id", "page_idx", "seq", (F.row_number().over(w) - 1).alias("pos"))


_LINES = f"""(SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, seq ROWS UNBOUNDED PRECEDING) AS line_id FROM
 (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, seq)) > 5 THEN 1 ELSE 0 END AS fresh FROM {_ONCE}))"""


@query("line_clusters", f"SELECT doc_id, page_idx, seq, CAST(line_id AS BIGINT) AS line_id, row_number() OVER (PARTITION BY doc_id, page_idx, line_id ORDER BY x, seq) - 1 AS pos FROM {_LINES}")
def line_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(table(spark, d, "fragments")).select("doc_id", "page_idx", "seq", "line_id", "pos")


@query("line_text", f"SELECT doc_id, page_idx, CAST(line_id AS BIGINT) AS line_id, string_agg(text, ' ' ORDER BY x, seq) AS line FROM {_LINES} GROUP BY ALL")
def line_text(spark: SparkSession, d: str) -> DataFrame:
    g = L.gap_groups(L.once(table(spark, d, "fragments")), ["doc_id", "page_idx"], "y", 5.0, "line_id", descending=True)
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    return g.groupBy("doc_id", "page_idx", "line_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line"))


@query("column_clusters", f"""
WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS col FROM
 (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq)) > 15 THEN 1 ELSE 0 END AS fresh FROM {_ONCE}))
SELECT doc_id, page_idx, CAST(col AS BIGINT) AS col, avg(x) AS x, greatest(max(width), 50) AS width, count(*) AS n FROM g GROUP BY ALL""")
def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = L.gap_groups(L.once(table(spark, d, "fragments")), ["doc_id", "page_idx"], "x", 15.0, "col")
    return g.groupBy("doc_id", "page_idx", "col").agg(F.avg("x").alias("x"), F.greatest(F.max("width"), F.lit(50.0)).alias("width"), F.count("*").alias("n"))


@query("row_batches", f"""
WITH g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page_idx ORDER BY seq) > greatest(0.5 * font_size, 2) THEN 1 ELSE 0 END AS jump FROM {_ONCE})
SELECT doc_id, page_idx, seq, CAST(sum(jump) OVER (PARTITION BY doc_id, page_idx ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch FROM g""")
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_idx").orderBy("seq")
    jump = F.when(F.col("y") - F.lag("y").over(w) > F.greatest(0.5 * F.col("font_size"), F.lit(2.0)), 1).otherwise(0)
    return L.once(table(spark, d, "fragments")).withColumn("jump", jump).select("doc_id", "page_idx", "seq", F.sum("jump").over(w).alias("batch"))


@query("regions", f"""
WITH m AS (SELECT doc_id, page_idx, median(height) AS h FROM {_ONCE} GROUP BY ALL),
g AS (SELECT f.*, sum(CASE WHEN prev - y > 2 * h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, seq ROWS UNBOUNDED PRECEDING) AS region
  FROM (SELECT o.*, m.h, lag(y) OVER (PARTITION BY o.doc_id, o.page_idx ORDER BY y DESC, seq) AS prev FROM {_ONCE} o JOIN m USING (doc_id, page_idx)) f)
SELECT doc_id, page_idx, CAST(region AS BIGINT) AS region, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 4""")
def regions(spark: SparkSession, d: str) -> DataFrame:
    f = L.once(table(spark, d, "fragments"))
    page = Window.partitionBy("doc_id", "page_idx")
    w = page.orderBy(F.desc("y"), "seq")
    g = f.withColumn("h", F.percentile("height", 0.5).over(page)).withColumn("new", F.when(F.lag("y").over(w) - F.col("y") > 2 * F.col("h"), 1).otherwise(0)).withColumn("region", F.sum("new").over(w))
    return g.groupBy("doc_id", "page_idx", "region").agg(F.count("*").alias("n")).where("n >= 4")


@query("body_font_size", f"""
WITH c AS (SELECT doc_id, page_idx, round(font_size * 2) / 2 AS s, count(*) AS n FROM {_ONCE} GROUP BY ALL)
SELECT DISTINCT ON (doc_id, page_idx) doc_id, page_idx, s AS body FROM c ORDER BY doc_id, page_idx, n DESC, s""")
def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    return L.body_font(table(spark, d, "fragments"))


_PROSE = "[" + ", ".join(f"'{w}'" for w in L.PROSE) + "]"


def sql_prose(key: str) -> str:
    """DuckDB: whether a key reads like a sentence."""
    w = f"list_filter(regexp_split_to_array(lower({key}), '[\\t-\\r ]+'), lambda w: w <> '')"
    return f"(coalesce(list_contains({_PROSE}, ({w})[1]), false) OR (len({w}) > 2 AND list_has_any(({w})[2:], {_PROSE})))"


def _partition_sql(ratio: float, zone: float) -> str:
    return f"""
WITH b AS (WITH c AS (SELECT doc_id, page_idx, round(font_size * 2) / 2 AS s, count(*) AS n FROM {_ONCE} GROUP BY ALL) SELECT DISTINCT ON (doc_id, page_idx) doc_id, page_idx, s AS body FROM c ORDER BY doc_id, page_idx, n DESC, s),
x AS (SELECT o.*, b.body, y - page_height * {1 - zone} AS top, page_height * {zone} - (y + height) AS bottom, coalesce(struct_tag IN ('P', 'Span', 'TD', 'TH', 'LBody'), false) AS body_tag, regexp_extract(text, '^([^:\\n]+):\\s*\\S', 1) AS k FROM {_ONCE} o JOIN b USING (doc_id, page_idx) WHERE trim(text) <> ''),
y AS (SELECT *, CASE WHEN struct_tag SIMILAR TO 'H[1-6]?|Title' THEN 'title' WHEN struct_tag IN ('LI', 'Lbl') THEN 'list_item' WHEN struct_tag = 'Artifact' THEN 'artifact'
  WHEN top >= 0 AND length(text) <= 100 AND NOT body_tag THEN 'header' WHEN bottom >= 0 AND length(text) <= 100 AND NOT body_tag THEN 'footer'
  WHEN k <> '' AND strlen(k) < 40 AND len({sql_words('k')}) <= 4 AND NOT contains(k, '.') AND NOT {sql_prose('k')} THEN 'key_value'
  WHEN font_size / body >= {ratio} OR (is_bold AND length(text) <= 120 AND NOT regexp_matches(text, '[.!?]$') AND NOT body_tag) THEN 'title'
  WHEN regexp_matches(text, '^[\\t\\n\\x0b\\f\\r ]*([-*•–—] |[0-9a-z][.)] |[0-9]{{2}}[.)] )') THEN 'list_item' ELSE 'paragraph' END AS elem_type FROM x)
SELECT doc_id, page_idx, seq, elem_type, text, CASE WHEN elem_type = 'header' THEN least(greatest(top / (page_height * {zone}), 0.5), 1.0) WHEN elem_type = 'footer' THEN least(greatest(bottom / (page_height * {zone}), 0.5), 1.0)
  WHEN elem_type = 'key_value' THEN least(greatest(1 - strlen(k) / 40.0 - 0.1 * greatest(len({sql_words('k')}) - 2, 0), 0.5), 1.0)
  WHEN elem_type = 'title' AND struct_tag IS NULL AND font_size / body >= {ratio} THEN least(greatest(0.5 + 0.5 * (font_size / body - {ratio}) / {ratio}, 0.5), 1.0) ELSE 1.0 END AS confidence FROM y"""


query("partition_elements", _partition_sql(1.3, 0.05))(lambda spark, d: L.classify(table(spark, d, "fragments")))
query("partition_elements_academic", _partition_sql(1.4, 0.08))(lambda spark, d: L.classify(table(spark, d, "fragments"), "academic"))
query("partition_elements_presentation", _partition_sql(1.2, 0.10))(lambda spark, d: L.classify(table(spark, d, "fragments"), "presentation"))


@query("reading_order_xy_cut")
def reading_order_xy_cut(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order_xy(table(spark, d, "fragments"))


@query("heading_graph", f"""
WITH e AS (SELECT *, CASE WHEN elem_type = 'title' THEN text ELSE parent_heading END AS heading FROM {_ELEMS})
SELECT doc_id, elem_seq, CASE WHEN elem_type <> 'title' AND heading IS NOT NULL THEN (SELECT max(t.elem_seq) FROM e t WHERE t.doc_id = e.doc_id AND t.elem_type = 'title' AND t.text = e.heading AND t.elem_seq < e.elem_seq) END AS parent_seq,
 lag(elem_seq) OVER (PARTITION BY doc_id ORDER BY elem_seq) AS prev_seq, lead(elem_seq) OVER (PARTITION BY doc_id ORDER BY elem_seq) AS next_seq FROM e""")
def heading_graph(spark: SparkSession, d: str) -> DataFrame:
    return L.heading_graph(table(spark, d, "elements"))


@query("section_children", f"""
WITH e AS (SELECT *, CASE WHEN elem_type = 'title' THEN text ELSE parent_heading END AS heading FROM {_ELEMS}),
g AS (SELECT doc_id, elem_seq, (SELECT max(t.elem_seq) FROM e t WHERE t.doc_id = e.doc_id AND t.elem_type = 'title' AND t.text = e.heading AND t.elem_seq < e.elem_seq) AS parent_seq FROM e WHERE elem_type <> 'title' AND heading IS NOT NULL)
SELECT doc_id, parent_seq, list(elem_seq ORDER BY elem_seq) AS children FROM g WHERE parent_seq IS NOT NULL GROUP BY ALL""")
def section_children(spark: SparkSession, d: str) -> DataFrame:
    g = L.heading_graph(table(spark, d, "elements")).where("parent_seq is not null")
    return g.groupBy("doc_id", "parent_seq").agg(F.array_sort(F.collect_list("elem_seq")).alias("children"))


@query("page_boxes", f"""
SELECT doc_id, page_idx, min(bbox.x) AS x, min(bbox.y) AS y, max(bbox.x + bbox.width) - min(bbox.x) AS width, max(bbox.y + bbox.height) - min(bbox.y) AS height, min(confidence) AS min_confidence, count(*) AS n FROM {_ELEMS} WHERE bbox IS NOT NULL GROUP BY ALL""")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y, w, h = (F.col(f"bbox.{c}") for c in ("x", "y", "width", "height"))
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where("bbox is not null")
    return e.groupBy("doc_id", "page_idx").agg(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("width"), (F.max(y + h) - F.min(y)).alias("height"), F.min("confidence").alias("min_confidence"), F.count("*").alias("n"))


@query("content_flags", f"""
SELECT doc_id, page_idx, bool_or(elem_type = 'table') AS has_table, bool_or(elem_type = 'list_item') AS has_list, bool_or(elem_type = 'code_block') AS has_code, bool_and(elem_type = 'title') AS heading_only FROM {_ELEMS} GROUP BY ALL""")
def content_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("elem_type")
    return table(spark, d, "elements").groupBy("doc_id", "page_idx").agg(F.bool_or(k == "table").alias("has_table"), F.bool_or(k == "list_item").alias("has_list"), F.bool_or(k == "code_block").alias("has_code"), F.bool_and(k == "title").alias("heading_only"))


@query("page_content", f"""
WITH p AS (SELECT doc_id, page_idx, sum(width * height) / (595.0 * max(page_height)) AS text_ratio, count(*) AS fragments, sum(length(text)) AS chars FROM {_ONCE} GROUP BY ALL)
SELECT *, CASE WHEN text_ratio > 0.7 THEN 'text' ELSE 'mixed' END AS kind, 1 - least(text_ratio, 1) AS blank_ratio FROM p""")
def page_content(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.sum(F.col("width") * F.col("height")) / (595.0 * F.max("page_height"))
    p = L.once(table(spark, d, "fragments")).groupBy("doc_id", "page_idx").agg(ratio.alias("text_ratio"), F.count("*").alias("fragments"), F.sum(F.char_length("text")).alias("chars"))
    return p.withColumn("kind", F.when(F.col("text_ratio") > 0.7, "text").otherwise("mixed")).withColumn("blank_ratio", 1 - F.least(F.col("text_ratio"), F.lit(1.0)))


@query("dominant_font", f"""
WITH w AS (SELECT doc_id, font_name, sum(length(text)) AS n, sum(CASE WHEN is_bold THEN length(text) ELSE 0 END) AS b FROM {_ONCE} GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n, sum(b) AS b FROM w GROUP BY 1), f AS (SELECT DISTINCT ON (doc_id) doc_id, font_name FROM w WHERE font_name IS NOT NULL ORDER BY doc_id, n DESC, font_name DESC)
SELECT t.doc_id, f.font_name, 2 * b > t.n AS is_bold FROM t LEFT JOIN f USING (doc_id)""")
def dominant_font(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    w = L.once(table(spark, d, "fragments")).groupBy("doc_id", "font_name").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("is_bold"), n).otherwise(0)).alias("b"))
    named = F.when(F.col("font_name").isNotNull(), F.struct("n", "font_name"))
    return w.groupBy("doc_id").agg(F.max(named).alias("f"), (2 * F.sum("b") > F.sum("n")).alias("is_bold")).select("doc_id", "f.font_name", "is_bold")


@query("boxes_overlap", f"""
SELECT a.doc_id, a.page_idx, a.elem_seq AS a, b.elem_seq AS b FROM {_ELEMS} a JOIN {_ELEMS} b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.elem_seq < b.elem_seq
WHERE a.bbox.x < b.bbox.x + b.bbox.width AND b.bbox.x < a.bbox.x + a.bbox.width AND a.bbox.y < b.bbox.y + b.bbox.height AND b.bbox.y < a.bbox.y + a.bbox.height""")
def boxes_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of a page: an equi join on the page, which bounds a group by a page's elements, and four inequalities."""
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where("bbox is not null").select("doc_id", "page_idx", "elem_seq", "bbox")
    a, b = e.select("doc_id", "page_idx", F.col("elem_seq").alias("a"), F.col("bbox").alias("p")), e.select("doc_id", "page_idx", F.col("elem_seq").alias("b"), F.col("bbox").alias("q"))
    meet = (F.col("p.x") < F.col("q.x") + F.col("q.width")) & (F.col("q.x") < F.col("p.x") + F.col("p.width")) & (F.col("p.y") < F.col("q.y") + F.col("q.height")) & (F.col("q.y") < F.col("p.y") + F.col("p.height"))
    return a.join(b, ["doc_id", "page_idx"]).where((F.col("a") < F.col("b")) & meet).select("doc_id", "page_idx", "a", "b")


_TABLES = f"(SELECT doc_id, page_idx, bbox AS t FROM {_ELEMS} WHERE elem_type = 'table' AND bbox IS NOT NULL)"


@query("fragment_claims", f"""
SELECT o.doc_id, o.page_idx, o.seq FROM {_ONCE} o WHERE EXISTS (SELECT 1 FROM {_TABLES} e WHERE e.doc_id = o.doc_id AND e.page_idx = o.page_idx AND o.x + o.width / 2 BETWEEN t.x AND t.x + t.width AND o.y + o.height / 2 BETWEEN t.y AND t.y + t.height)""")
def fragment_claims(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that a table claims: those whose middle lies in its box, one by one."""
    t = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where("elem_type = 'table' and bbox is not null").select("doc_id", "page_idx", "bbox")
    f = L.once(table(spark, d, "fragments"))
    mx, my = f["x"] + f["width"] / 2, f["y"] + f["height"] / 2
    inside = (f["doc_id"] == t["doc_id"]) & (f["page_idx"] == t["page_idx"]) & mx.between(t["bbox.x"], t["bbox.x"] + t["bbox.width"]) & my.between(t["bbox.y"], t["bbox.y"] + t["bbox.height"])
    return f.join(t, inside, "left_semi").select("doc_id", "page_idx", "seq")


_MD_ROW = "'| ' || array_to_string(list_transform({r}, lambda c: replace(coalesce(c, ''), '|', '\\|')), ' | ') || ' |'"
_MD = f"""CASE elem_type WHEN 'title' THEN '# ' || coalesce(text, '') WHEN 'list_item' THEN '- ' || coalesce(text, '') WHEN 'key_value' THEN '**' || coalesce(kv_key, '') || '**: ' || coalesce(kv_value, '')
 WHEN 'code_block' THEN '```' || chr(10) || coalesce(text, '') || chr(10) || '```' WHEN 'image' THEN '![' || coalesce(alt_text, '') || ']()' WHEN 'header' THEN NULL WHEN 'footer' THEN NULL
 WHEN 'table' THEN coalesce(array_to_string(list_concat([{_MD_ROW.format(r='table_cells[1]')}, '| ' || array_to_string(list_transform(table_cells[1], lambda c: '---'), ' | ') || ' |'], list_transform(table_cells[2:], lambda r: {_MD_ROW.format(r='r')})), chr(10)), '') ELSE coalesce(text, '') END"""


@query("element_markdown", f"SELECT doc_id, page_idx, string_agg({_MD}, chr(10) || chr(10) ORDER BY elem_seq) AS markdown FROM {_ELEMS} WHERE elem_type NOT IN ('header', 'footer') GROUP BY ALL")
def element_markdown(spark: SparkSession, d: str) -> DataFrame:
    return L.document_markdown(table(spark, d, "elements"))


@query("chunk_tsv", """
SELECT row_id, concat_ws(chr(9), id, coalesce(metadata.chunk_id, ''), coalesce(array_to_string(metadata.page_numbers, ';'), ''), coalesce(CAST(metadata.token_estimate AS VARCHAR), ''),
 CASE WHEN regexp_matches(text, '["\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS line FROM rag_chunks_sample""")
def chunk_tsv(spark: SparkSession, d: str) -> DataFrame:
    m = lambda c: F.coalesce(F.col(f"metadata.{c}").cast("string"), F.lit(""))
    quoted = F.when(F.col("text").rlike('["\\n\\r]'), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("text"))
    return table(spark, d, "rag_chunks_sample").select("row_id", F.concat_ws("\t", "id", m("chunk_id"), F.coalesce(F.array_join("metadata.page_numbers", ";"), F.lit("")), m("token_estimate"), quoted).alias("line"))


@query("document_json", """
SELECT doc_id, json_object('type', 'document', 'content', text, 'metadata', json_object('title', coalesce(title, ''), 'page_count', n_pages))::VARCHAR AS json FROM documents WHERE text IS NOT NULL AND n_pages IS NOT NULL""")
def document_json(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a text and a page count, whatever its characters."""
    t = table(spark, d, "documents").where("text is not null and n_pages is not null")
    meta = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.col("n_pages").alias("page_count"))
    return t.select("doc_id", F.to_json(F.struct(F.lit("document").alias("type"), F.col("text").alias("content"), meta.alias("metadata"))).alias("json"))


@query("document_markdown", """
SELECT doc_id, '---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(coalesce(title, ''), '[:#]') THEN '"' || title || '"' ELSE coalesce(title, '') END || chr(10) || 'pages: ' || coalesce(n_pages, 0) || chr(10) || '---' || chr(10) || chr(10) || '# Document' || chr(10) || chr(10) || text AS markdown FROM documents WHERE text IS NOT NULL""")
def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    shown = F.when(title.rlike("[:#]"), F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title)
    head = F.concat(F.lit("---\ntitle: "), shown, F.lit("\npages: "), F.coalesce("n_pages", F.lit(0)), F.lit("\n---\n\n# Document\n\n"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, "text").alias("markdown"))


@query("contextual_text", """
SELECT doc_id, 'This is a document titled "' || coalesce(title, 'Untitled') || '" with ' || coalesce(n_pages, 0) || CASE WHEN coalesce(n_pages, 0) = 1 THEN ' page' ELSE ' pages' END || ', written by ' || source || '.' || chr(10) || chr(10) || 'Content:' || chr(10) || chr(10) || text AS content FROM documents WHERE text IS NOT NULL""")
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce("n_pages", F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit('This is a document titled "'), F.coalesce("title", F.lit("Untitled")), F.lit('" with '), n, F.when(n == 1, " page").otherwise(" pages"), F.lit(", written by "), "source", F.lit(".\n\nContent:\n\n"), "text").alias("content"))
