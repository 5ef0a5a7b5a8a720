"""Exports by block, columns of a page, guards and masks, links between elements, jobs by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import layout as L
from .layout_queries import _ELEMS, _ONCE, sql_prose
from .registry import query, table


def _elems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"])


def _frags(spark: SparkSession, d: str) -> DataFrame:
    return L.once(table(spark, d, "fragments"))


# exports


@query("chunk_json", """
SELECT row_id, CAST(json_object('id', id, 'content', text, 'tokens', metadata.token_estimate, 'page_numbers', metadata.page_numbers, 'metadata', json_object('first_page', metadata.page_span.first, 'last_page', metadata.page_span.last)) AS VARCHAR) AS json FROM rag_chunks_sample""")
def chunk_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object a chunk, nulls kept: the lines of the chunk exports."""
    span = F.struct(F.col("metadata.page_span.first").alias("first_page"), F.col("metadata.page_span.last").alias("last_page"))
    chunk = F.struct("id", F.col("text").alias("content"), F.col("metadata.token_estimate").alias("tokens"), F.col("metadata.page_numbers").alias("page_numbers"), span.alias("metadata"))
    return table(spark, d, "rag_chunks_sample").select("row_id", F.to_json(chunk, {"ignoreNullFields": "false"}).alias("json"))


_PAGES_SQL = f"SELECT doc_id, page_idx + 1 AS block, string_agg(coalesce(text, ''), chr(10) ORDER BY elem_seq) AS t FROM {_ELEMS} GROUP BY ALL"


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")  # bounded by a page
    return _elems(spark, d).groupBy("doc_id", (F.col("page_idx") + 1).alias("block")).agg(body.alias("t"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, title, author, pages) of the documents of the manifest with elements."""
    pages = table(spark, d, "elements").groupBy("doc_id").agg(F.count_distinct("page_idx").alias("pages"))
    return pages.join(table(spark, d, "corpus_manifest").select(F.col("slug").alias("doc_id"), F.col("document_name").alias("title"), F.col("publisher").alias("author")), "doc_id")


_HEADS_SQL = "SELECT slug AS doc_id, document_name AS title, publisher AS author, p.pages FROM corpus_manifest JOIN (SELECT doc_id, count(DISTINCT page_idx) AS pages FROM elements GROUP BY 1) p ON p.doc_id = slug"


@query("markdown_document", f"""
WITH h AS ({_HEADS_SQL}), p AS ({_PAGES_SQL})
SELECT doc_id, 0 AS block, '---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(title, '[:#]') THEN '"' || replace(title, '"', '\\"') || '"' ELSE title END || chr(10) || 'pages: ' || pages || chr(10)
 || CASE WHEN author IS NULL THEN '' ELSE 'author: ' || CASE WHEN contains(author, ':') THEN '"' || replace(author, '"', '\\"') || '"' ELSE author END || chr(10) END || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) AS markdown FROM h
UNION ALL SELECT doc_id, block, CASE WHEN block > min(block) OVER (PARTITION BY doc_id) THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '**Page ' || block || '**' || chr(10) || chr(10) || t FROM p""")
def markdown_document(spark: SparkSession, d: str) -> DataFrame:
    """Front matter and pages of each document as blocks in order, so that no document has to fit one row."""
    quoted = lambda c, marks: F.when(F.col(c).rlike(marks), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col(c))
    author = F.when(F.col("author").isNull(), "").otherwise(F.concat(F.lit("author: "), quoted("author", ":"), F.lit("\n")))
    head = F.concat(F.lit("---\ntitle: "), quoted("title", "[:#]"), F.lit("\npages: "), "pages", F.lit("\n"), author, F.lit("---\n\n# "), "title", F.lit("\n\n"))
    pages = _page_texts(spark, d)
    first = pages.groupBy("doc_id").agg(F.min("block").alias("_f"))
    page = F.concat(F.when(F.col("block") > F.col("_f"), "\n\n---\n\n").otherwise(""), F.lit("**Page "), "block", F.lit("**\n\n"), "t")
    return _heads(spark, d).select("doc_id", F.lit(0).alias("block"), head.alias("markdown")).unionByName(pages.join(first, "doc_id").select("doc_id", "block", page.alias("markdown")))


@query("contextual_document", f"""
WITH h AS ({_HEADS_SQL}), p AS ({_PAGES_SQL})
SELECT doc_id, 0 AS block, 'This is a document titled "' || title || '" with ' || pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END || CASE WHEN author IS NULL THEN '' ELSE ', written by ' || author END || '.' || chr(10) || chr(10) || 'Content:' || chr(10) || chr(10) AS content FROM h
UNION ALL SELECT doc_id, block, 'On page ' || block || ':' || chr(10) || t || chr(10) || chr(10) FROM p""")
def contextual_document(spark: SparkSession, d: str) -> DataFrame:
    by = F.when(F.col("author").isNull(), "").otherwise(F.concat(F.lit(", written by "), "author"))
    head = F.concat(F.lit('This is a document titled "'), "title", F.lit('" with '), "pages", F.when(F.col("pages") == 1, " page").otherwise(" pages"), by, F.lit(".\n\nContent:\n\n"))
    page = F.concat(F.lit("On page "), "block", F.lit(":\n"), "t", F.lit("\n\n"))
    return _heads(spark, d).select("doc_id", F.lit(0).alias("block"), head.alias("content")).unionByName(_page_texts(spark, d).select("doc_id", "block", page.alias("content")))


@query("contextual_simple", "SELECT doc_id, 'Document content:' || chr(10) || chr(10) || text AS content FROM documents WHERE text IS NOT NULL")
def contextual_simple(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Document content:\n\n"), "text").alias("content"))


_HEAD2 = "array_to_string(list_transform(range(1, ncols + 1), lambda c: CASE WHEN coalesce(r1[c], '') = '' THEN coalesce(r2[c], '') WHEN coalesce(r2[c], '') IN ('', r1[c]) THEN r1[c] ELSE r1[c] || ' › ' || r2[c] END), ' | ')"


@query("two_level_headers", f"""
WITH t AS (SELECT doc_id, elem_seq, table_cells[1] AS r1, table_cells[2] AS r2, table_cells[3:] AS body, list_max(list_transform(table_cells, lambda r: len(r))) AS ncols FROM {_ELEMS} WHERE elem_type = 'table' AND len(table_cells) >= 2)
SELECT doc_id, elem_seq, array_to_string(list_concat(['| ' || {_HEAD2} || ' |', '| ' || array_to_string(list_transform(range(1, ncols + 1), lambda c: '---'), ' | ') || ' |'], list_transform(body, lambda r: '| ' || array_to_string(list_transform(r, lambda x: coalesce(x, '')), ' | ') || ' |')), chr(10)) AS markdown FROM t""")
def two_level_headers(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose first two rows are headers: texts of a column that differ are joined, empty ones left out."""
    e = _elems(spark, d).where("elem_type = 'table' and size(table_cells) >= 2")
    cell = lambda r, c: F.coalesce(F.get(F.get("table_cells", F.lit(r)), c), F.lit(""))
    ncols = F.array_max(F.transform("table_cells", lambda r: F.size(r)))

    def head(c: Column) -> Column:
        a, b = cell(0, c), cell(1, c)
        return F.when(a == "", b).when((b == "") | (b == a), a).otherwise(F.concat(a, F.lit(" › "), b))

    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.slice("table_cells", 3, F.size("table_cells")), lambda r: line(F.transform(r, lambda x: F.coalesce(x, F.lit("")))))
    top = F.array(line(F.transform(F.sequence(F.lit(0), ncols - 1), head)), line(F.array_repeat(F.lit("---"), ncols)))
    return e.select("doc_id", "elem_seq", F.array_join(F.concat(top, body), "\n").alias("markdown"))


@query("entity_json_ld", """
SELECT doc_id, page_idx, CAST(json_object('@context', 'https://schema.org', '@type', 'DigitalDocument', 'hasPart', list(json_object('@type', CASE elem_type WHEN 'title' THEN 'CreativeWork' WHEN 'table' THEN 'Table' WHEN 'image' THEN 'ImageObject' ELSE 'Thing' END, 'identifier', elem_seq, 'position', page_idx) ORDER BY elem_seq)) AS VARCHAR) AS json
FROM (SELECT DISTINCT ON (doc_id, elem_seq) * FROM elements) GROUP BY doc_id, page_idx""")
def entity_json_ld(spark: SparkSession, d: str) -> DataFrame:
    """The entities of each page as linked data."""
    kind = F.when(F.col("elem_type") == "title", "CreativeWork").when(F.col("elem_type") == "table", "Table").when(F.col("elem_type") == "image", "ImageObject").otherwise("Thing")
    part = F.struct(kind.alias("@type"), F.col("elem_seq").alias("identifier"), F.col("page_idx").alias("position"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", part.alias("p")))), lambda x: x["p"])  # bounded by a page
    g = _elems(spark, d).groupBy("doc_id", "page_idx").agg(parts.alias("hasPart"))
    return g.select("doc_id", "page_idx", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("DigitalDocument").alias("@type"), "hasPart")).alias("json"))


# predicates, masks and small parsers


@query("content_equal", "SELECT elem_type, md5(text) AS content, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT DISTINCT ON (doc_id, elem_seq) * FROM elements) WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def content_equal(spark: SparkSession, d: str) -> DataFrame:
    """Elements equal in type and content, whatever their metadata."""
    return _elems(spark, d).where("text is not null").groupBy("elem_type", F.md5("text").alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("font_style", """
SELECT DISTINCT font_name, regexp_matches(lower(font_name), 'bold|-b| b |( b$)') AS bold, regexp_matches(lower(font_name), 'italic|oblique|-i| i |( i$)') AS italic FROM fragments WHERE font_name IS NOT NULL""")
def font_style(spark: SparkSession, d: str) -> DataFrame:
    n = F.lower("font_name")
    return table(spark, d, "fragments").where("font_name is not null").select("font_name").distinct().select("font_name", n.rlike(r"bold|-b| b | b\z").alias("bold"), n.rlike(r"italic|oblique|-i| i | i\z").alias("italic"))


@query("nested_lookup", "SELECT row_id, CAST(metadata.page_span.first AS VARCHAR) AS first_page, CAST(metadata.content_types.has_table AS VARCHAR) AS has_table, CAST(NULL AS VARCHAR) AS missing FROM rag_chunks_sample")
def nested_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Values by dotted path in an object; a path that leads nowhere gives null."""
    context = F.to_json("metadata")
    at = lambda path: F.get_json_object(context, f"$.{path}")
    return table(spark, d, "rag_chunks_sample").select("row_id", at("page_span.first").alias("first_page"), at("content_types.has_table").alias("has_table"), at("page_span.none.deeper").alias("missing"))


@query("prose_guard", f"SELECT doc_id, elem_seq, {sql_prose('coalesce(kv_key, text)')} AS prose FROM {_ELEMS} WHERE coalesce(kv_key, text) IS NOT NULL")
def prose_guard(spark: SparkSession, d: str) -> DataFrame:
    return _elems(spark, d).where("coalesce(kv_key, text) is not null").select("doc_id", "elem_seq", L.prose_prefix(F.coalesce("kv_key", "text")).alias("prose"))


# Telephone numbers by country.
PHONES = {
    "us": r"^\(?[2-9][0-9]{2}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "uk": r"^\+?44\s?[0-9]{2}\s?[0-9]{4}\s?[0-9]{4}$",
    "eu": r"^\+?[0-9]{2,3}\s?[0-9]{2,4}\s?[0-9]{2,4}\s?[0-9]{2,4}$",
    "japan": r"^0[0-9]{1,4}-?[0-9]{1,4}-?[0-9]{4}$",
    "custom": r"^[0-9+\-\s\(\)]+$",
}
_PHONE = "regexp_replace(CAST(10000000000 + o_orderkey * 7919 AS VARCHAR), '^1', CASE o_orderkey % 3 WHEN 0 THEN '+44 ' WHEN 1 THEN '0' ELSE '' END)"


@query("phone_check", f"SELECT o_orderkey, phone, {', '.join(f'regexp_matches(phone, {chr(39)}{p}{chr(39)}) AS {k}' for k, p in PHONES.items())} FROM (SELECT o_orderkey, {_PHONE} AS phone FROM orders)")
def phone_check(spark: SparkSession, d: str) -> DataFrame:
    digits = (F.lit(10000000000) + F.col("o_orderkey") * 7919).cast("string")
    lead = F.when(F.col("o_orderkey") % 3 == 0, "+44 ").when(F.col("o_orderkey") % 3 == 1, "0").otherwise("")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(lead, F.substring(digits, 2, 20)).alias("phone"))
    return o.select("o_orderkey", "phone", *[F.col("phone").rlike(p).alias(k) for k, p in PHONES.items()])


@query("required_fields", """
SELECT doc_id, field, CASE WHEN field = 'invoice_number' THEN true WHEN field = 'tax_amount' THEN net IS NOT NULL WHEN field = 'vat_number' THEN coalesce(total > 500, false) ELSE false END AS required, coalesce(value_str, '') = '' AS empty
FROM (SELECT *, max(CASE WHEN field = 'net_amount' THEN value_str END) OVER (PARTITION BY doc_id) AS net, max(CASE WHEN field = 'total_amount' THEN value_num END) OVER (PARTITION BY doc_id) AS total FROM (SELECT DISTINCT ON (doc_id, field) * FROM invoice_fields))""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields required always, when another is not empty, or when another has a value; the conditions are evaluated."""
    f = table(spark, d, "invoice_fields").dropDuplicates(["doc_id", "field"])
    others = f.groupBy("doc_id").agg(F.max(F.when(F.col("field") == "net_amount", F.col("value_str"))).alias("net"), F.max(F.when(F.col("field") == "total_amount", F.col("value_num"))).alias("total"))
    rule = F.when(F.col("field") == "invoice_number", True).when(F.col("field") == "tax_amount", F.col("net").isNotNull()).when(F.col("field") == "vat_number", F.coalesce(F.col("total") > 500, F.lit(False))).otherwise(False)
    return f.join(others, "doc_id").select("doc_id", "field", rule.alias("required"), (F.coalesce("value_str", F.lit("")) == "").alias("empty"))


@query("chunk_type", """
SELECT doc_id, CASE WHEN starts_with(text, 'BT') OR (contains(text, 'T') AND contains(text, 'j')) OR text = 'T' THEN 'text' WHEN contains(text, 'm') OR contains(text, 'l') OR contains(text, 'c') THEN 'graphics' ELSE 'unknown' END AS kind FROM documents WHERE text IS NOT NULL""")
def chunk_type(spark: SparkSession, d: str) -> DataFrame:
    """What a piece of a content stream holds, by its bytes."""
    b = F.encode("text", "UTF-8")
    starts = lambda h: F.startswith(F.hex(F.substring(b, 1, 4)), F.lit(h))
    kind = F.when(starts("4254") | (F.contains("text", F.lit("T")) & F.contains("text", F.lit("j"))) | (F.col("text") == "T"), "text").when(starts("FFD8") | starts("89504E47"), "image")
    return table(spark, d, "documents").where("text is not null").select("doc_id", kind.when(F.col("text").rlike("[mlc]"), "graphics").otherwise("unknown").alias("kind"))


@query("time_mask", r"""
WITH t AS (SELECT row_id, CAST(strftime(ingested_at, '%H') AS INT) AS h, strftime(ingested_at, ':%M') AS m, strftime(ingested_at, ':%S') AS s FROM rag_chunks_sample WHERE ingested_at IS NOT NULL)
SELECT row_id, printf('%02d', h) || m AS hm, printf('%02d', h) || m || s AS hms, printf('%02d', CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || m || CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END AS hm_ampm FROM t""")
def time_mask(spark: SparkSession, d: str) -> DataFrame:
    """Times of the day from their digits, with 24 or 12 hours; fewer than four digits have none."""
    digits = F.regexp_replace(F.date_format("ingested_at", "HH:mm:ss"), "[^0-9]", "")
    h = F.substring(digits, 1, 2).try_cast("int")
    m, s = F.concat(F.lit(":"), F.substring(digits, 3, 2)), F.concat(F.lit(":"), F.substring(digits, 5, 2))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    noon = F.concat(two(F.when(h % 12 == 0, 12).otherwise(h % 12)), m, F.when(h < 12, " AM").otherwise(" PM"))
    return table(spark, d, "rag_chunks_sample").where("ingested_at is not null").where(F.length(digits) >= 4).select("row_id", F.concat(two(h), m).alias("hm"), F.concat(two(h), m, s).alias("hms"), noon.alias("hm_ampm"))


# Fixed value: what numbers a section.
SECTION = r"^([A-Z][0-9]+(\.[0-9]+)*(\.[a-z]\.?)?|[0-9]+(\.[0-9]+)*\.?|Section\s+[0-9]+:?|Chapter\s+[0-9]+:?|[IVX]+\.)\s+"


@query("section_stripped", f"SELECT row_id, regexp_replace(h, '{SECTION}', '') AS heading, regexp_matches(h, '{SECTION}') AS numbered FROM (SELECT row_id, metadata.heading_context AS h FROM rag_chunks_sample WHERE metadata.heading_context IS NOT NULL)")
def section_stripped(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("metadata.heading_context")
    return table(spark, d, "rag_chunks_sample").where(h.isNotNull()).select("row_id", F.regexp_replace(h, SECTION, "").alias("heading"), h.rlike(SECTION).alias("numbered"))


@query("character_confidence", f"SELECT doc_id, sum(confidence * length(text)) / sum(length(text)) AS mean FROM {_ELEMS} WHERE confidence IS NOT NULL AND length(text) > 0 GROUP BY doc_id")
def character_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of a document's characters."""
    n = F.char_length("text")
    return _elems(spark, d).where((n > 0) & F.col("confidence").isNotNull()).groupBy("doc_id").agg((F.sum(F.col("confidence") * n) / F.sum(n)).alias("mean"))


# columns and lines of a page


_BOUNDS = f"SELECT doc_id, page_idx, stop + gap / 2 AS mid, gap FROM (SELECT doc_id, page_idx, x + width AS stop, lead(x) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq) - (x + width) AS gap FROM {_ONCE}) WHERE gap >= 20"


def column_boundaries(frags: DataFrame, least: float = 20.0) -> DataFrame:
    """(doc_id, page_idx, mid, gap): the middle of each gap between neighbours in x order."""
    stop = F.col("x") + F.col("width")
    gap = F.lead("x").over(Window.partitionBy("doc_id", "page_idx").orderBy("x", "seq")) - stop
    return frags.select("doc_id", "page_idx", stop.alias("_stop"), gap.alias("gap")).where(F.col("gap") >= least).select("doc_id", "page_idx", (F.col("_stop") + F.col("gap") / 2).alias("mid"), "gap")


@query("column_boundaries", _BOUNDS)
def column_boundaries_query(spark: SparkSession, d: str) -> DataFrame:
    return column_boundaries(_frags(spark, d))


@query("column_sections", f"""
WITH b AS (SELECT doc_id, page_idx, list_sort(list(mid)) AS mids FROM ({_BOUNDS}) GROUP BY ALL),
     c AS (SELECT f.*, len(list_filter(coalesce(b.mids, []), lambda a: a <= f.x)) AS col FROM {_ONCE} f LEFT JOIN b USING (doc_id, page_idx))
SELECT doc_id, page_idx, col, string_agg(text, ' ' ORDER BY y DESC, x, seq) AS text, min(x) AS left_x, max(x + width) AS right_x FROM c GROUP BY ALL""")
def column_sections(spark: SparkSession, d: str) -> DataFrame:
    """The text of each column of a page from top to bottom; a page's boundaries are an array beside its fragments, no range join."""
    f = _frags(spark, d)
    b = column_boundaries(f).groupBy("doc_id", "page_idx").agg(F.collect_list("mid").alias("_mids"))  # bounded by a page
    col = F.size(F.filter(F.coalesce("_mids", F.array().cast("array<double>")), lambda a: a <= F.col("x")))
    placed = f.join(b, ["doc_id", "page_idx"], "left").withColumn("col", col)
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct((-F.col("y")).alias("y"), "x", "seq", "text"))))
    return placed.groupBy("doc_id", "page_idx", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x").alias("left_x"), F.max(F.col("x") + F.col("width")).alias("right_x"))


@query("page_text_rebuilt", f"""
WITH n AS (SELECT *, lead(font_name) OVER w AS next_font, lead(seq) OVER w AS next_seq FROM {_ONCE} WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY seq))
SELECT doc_id, page_idx, string_agg(coalesce(text, '') || CASE WHEN next_seq IS NULL THEN '' WHEN font_name = next_font THEN ' ' ELSE '  ' END, '' ORDER BY seq) AS text FROM n GROUP BY ALL""")
def page_text_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Fragments joined by one blank where the font stays, by two where it changes or is unknown."""
    w = Window.partitionBy("doc_id", "page_idx").orderBy("seq")
    gap = F.when(F.lead("seq").over(w).isNull(), "").when(F.col("font_name") == F.lead("font_name").over(w), " ").otherwise("  ")
    parts = _frags(spark, d).select("doc_id", "page_idx", "seq", F.concat(F.coalesce("text", F.lit("")), gap).alias("t"))
    return parts.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("text"))


@query("range_boxes", f"""
WITH p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS n FROM {_ONCE})
SELECT doc_id, page_idx, CAST(start // 200 AS BIGINT) AS chunk, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1, count(*) AS parts FROM p WHERE n > 0 GROUP BY ALL""")
def range_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle of each range of 200 characters of a page, by the fragments that begin in it: what highlighting draws."""
    w = Window.partitionBy("doc_id", "page_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    p = _frags(spark, d).withColumn("_start", F.coalesce(F.sum(F.char_length("text") + 1).over(w), F.lit(0))).where(F.char_length("text") > 0)
    return p.groupBy("doc_id", "page_idx", F.floor(F.col("_start") / 200).alias("chunk")).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.count("*").alias("parts")
    )


@query("grid_overlaps", f"""
WITH g AS (SELECT doc_id, page_idx, seq, CAST(floor(y / 20) AS BIGINT) AS r, CAST(floor(x / 50) AS BIGINT) AS a, CAST(floor(x / 50) + greatest(ceil(width / 50), 1) AS BIGINT) AS b FROM {_ONCE})
SELECT p.doc_id, p.page_idx, p.seq AS seq, q.seq AS other FROM g p JOIN g q ON p.doc_id = q.doc_id AND p.page_idx = q.page_idx AND p.r = q.r AND p.seq < q.seq AND p.a < q.b AND q.a < p.b""")
def grid_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one row of a page's grid that cover a column both: they meet in the columns they cover, not pair by pair."""
    a = F.floor(F.col("x") / 50)
    g = _frags(spark, d).select("doc_id", "page_idx", "seq", F.floor(F.col("y") / 20).alias("r"), F.explode(F.sequence(a, a + F.greatest(F.ceil(F.col("width") / 50), F.lit(1)) - 1)).alias("col"))
    return g.join(g.withColumnRenamed("seq", "other"), ["doc_id", "page_idx", "r", "col"]).where("seq < other").select("doc_id", "page_idx", "seq", "other").distinct()


@query("unclaimed_fragments", f"""
WITH t AS (SELECT doc_id, page_idx, bbox FROM {_ELEMS} WHERE elem_type = 'table' AND bbox IS NOT NULL)
SELECT doc_id, page_idx, seq FROM {_ONCE} f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = f.doc_id AND t.page_idx = f.page_idx AND f.x + f.width / 2 BETWEEN t.bbox.x AND t.bbox.x + t.bbox.width AND f.y + f.height / 2 BETWEEN t.bbox.y AND t.bbox.y + t.bbox.height)""")
def unclaimed_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Text conservation: only fragments whose middle lies in a table are claimed by it, all others of the page stay."""
    t = _elems(spark, d).where("elem_type = 'table' and bbox is not null").select("doc_id", "page_idx", "bbox")
    f = _frags(spark, d)
    mx, my = f["x"] + f["width"] / 2, f["y"] + f["height"] / 2
    inside = (f["doc_id"] == t["doc_id"]) & (f["page_idx"] == t["page_idx"]) & mx.between(t["bbox.x"], t["bbox.x"] + t["bbox.width"]) & my.between(t["bbox.y"], t["bbox.y"] + t["bbox.height"])
    return f.join(t, inside, "left_anti").select("doc_id", "page_idx", "seq")


_AREA = f"""
WITH i AS (SELECT doc_id, page_idx, sum(bbox.width * bbox.height) AS area FROM {_ELEMS} WHERE elem_type = 'image' AND bbox IS NOT NULL GROUP BY ALL),
     p AS (SELECT doc_id, page_idx, sum(length(coalesce(text, ''))) AS chars, sum(width * height) AS text_area, max(page_height) AS h, greatest(max(x + width), max(page_height) / sqrt(2)) AS w FROM {_ONCE} GROUP BY ALL),
     r AS (SELECT p.doc_id, p.page_idx, least(text_area / (w * h), 1.0) AS text_ratio, least(coalesce(area, 0) / (w * h), 1.0) AS image_ratio, chars FROM p LEFT JOIN i USING (doc_id, page_idx))"""


def page_areas(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page_idx, text_ratio, image_ratio, chars): shares of the page; a page is as wide as its text, at least as paper of its height."""
    i = _elems(spark, d).where("elem_type = 'image' and bbox is not null").groupBy("doc_id", "page_idx").agg(F.sum(F.col("bbox.width") * F.col("bbox.height")).alias("area"))
    p = _frags(spark, d).groupBy("doc_id", "page_idx").agg(
        F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(F.col("width") * F.col("height")).alias("text_area"), F.max("page_height").alias("h"),
        F.greatest(F.max(F.col("x") + F.col("width")), F.max("page_height") / F.sqrt(F.lit(2.0))).alias("w"),
    )
    page = F.col("w") * F.col("h")
    share = lambda c: F.least(c / page, F.lit(1.0))
    return p.join(i, ["doc_id", "page_idx"], "left").select("doc_id", "page_idx", share(F.col("text_area")).alias("text_ratio"), share(F.coalesce("area", F.lit(0.0))).alias("image_ratio"), "chars")


_KIND = "CASE WHEN image_ratio > 0.8 AND text_ratio < 0.1 THEN 'scanned' WHEN text_ratio > 0.7 AND image_ratio < 0.2 THEN 'text' ELSE 'mixed' END"


def _page_kind() -> Column:
    return F.when((F.col("image_ratio") > 0.8) & (F.col("text_ratio") < 0.1), "scanned").when((F.col("text_ratio") > 0.7) & (F.col("image_ratio") < 0.2), "text").otherwise("mixed")


@query("page_analysis", f"{_AREA} SELECT *, {_KIND} AS kind, greatest(text_ratio, image_ratio) AS dominant FROM r")
def page_analysis(spark: SparkSession, d: str) -> DataFrame:
    return page_areas(spark, d).select("*", _page_kind().alias("kind"), F.greatest("text_ratio", "image_ratio").alias("dominant"))


@query("document_analysis", f"{_AREA} SELECT doc_id, count(*) AS pages, sum(CASE WHEN {_KIND} = 'scanned' THEN 1 ELSE 0 END)::BIGINT AS scanned, sum(CASE WHEN {_KIND} = 'text' THEN 1 ELSE 0 END)::BIGINT AS textual, sum(chars)::BIGINT AS chars FROM r GROUP BY doc_id")
def document_analysis(spark: SparkSession, d: str) -> DataFrame:
    p = page_areas(spark, d).withColumn("kind", _page_kind())
    of = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), of("scanned").alias("scanned"), of("text").alias("textual"), F.sum("chars").alias("chars"))


@query("scanned_pages", f"{_AREA} SELECT doc_id, page_idx FROM r WHERE {_KIND} = 'scanned' AND page_idx < 10")
def scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages among selected ones, here the first ten of each document."""
    return page_areas(spark, d).where((_page_kind() == "scanned") & (F.col("page_idx") < 10)).select("doc_id", "page_idx")


# fragments folded in order


def _ordered(frags: DataFrame) -> DataFrame:
    """(doc_id, page_idx, items): the fragments of a page from top to bottom and left to right; a page bounds the array."""
    item = F.struct((-F.col("y")).alias("ny"), "x", "seq", "width", F.col("font_size").cast("double").alias("size"), "mcid", "text")
    return frags.where(F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(item)).alias("items"))


_IN_ORDER = f"(SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, x, seq) AS rn FROM {_ONCE} WHERE text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"


@query("anchored_lines", f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT * FROM {_IN_ORDER}),
r AS (SELECT doc_id, page_idx, seq, rn, y AS anchor, 0 AS line FROM o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.page_idx, o.seq, o.rn, CASE WHEN abs(o.y - r.anchor) <= 5 THEN r.anchor ELSE o.y END, CASE WHEN abs(o.y - r.anchor) <= 5 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_idx = r.page_idx AND o.rn = r.rn + 1)
SELECT doc_id, page_idx, seq, line FROM r""")
def anchored_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page, each held to the height of its first fragment: heights do not chain."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<struct<seq:int,line:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(F.abs(x["ny"] - s["anchor"]) <= 5, F.lit(False))
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(F.when(same, s["anchor"]).otherwise(x["ny"]).alias("anchor"), line.alias("line"), F.concat(s["out"], F.array(F.struct(x["seq"].alias("seq"), line.alias("line")))).alias("out"))

    return _ordered(_frags(spark, d)).select("doc_id", "page_idx", F.inline(F.aggregate("items", start, step, lambda s: s["out"])))


@query("glued_fragments", f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT * FROM {_IN_ORDER}),
r AS (SELECT doc_id, page_idx, rn, seq AS head, y, x + width AS stop, mcid, text, 1 AS parts FROM o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.page_idx, o.rn, CASE WHEN m THEN head ELSE o.seq END, CASE WHEN m THEN t.y ELSE o.y END, o.x + o.width, CASE WHEN m THEN t.mcid ELSE o.mcid END,
  CASE WHEN m THEN t.text || CASE WHEN o.x - t.stop > 0.3 * o.font_size THEN ' ' ELSE '' END || o.text ELSE o.text END, CASE WHEN m THEN parts + 1 ELSE 1 END
  FROM r t JOIN o ON o.doc_id = t.doc_id AND o.page_idx = t.page_idx AND o.rn = t.rn + 1, LATERAL (SELECT coalesce(abs(t.y - o.y) < 1 AND o.x - t.stop >= 0 AND o.x - t.stop < 0.5 * o.font_size AND t.mcid IS NOT DISTINCT FROM o.mcid, false) AS m) q)
SELECT doc_id, page_idx, head AS seq, arg_max(text, rn) AS text, max(parts) AS parts FROM r GROUP BY doc_id, page_idx, head""")
def glued_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that follow one another closer than half their size become one, with a blank where the gap is wide enough for one."""
    kind = "array<struct<seq:int,text:string,parts:int>>"
    start = F.struct(F.lit(None).cast("double").alias("ny"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("int").alias("mcid"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = x["x"] - s["stop"]
        near = F.coalesce((F.abs(x["ny"] - s["ny"]) < 1) & (gap >= 0) & (gap < 0.5 * x["size"]) & s["mcid"].eqNullSafe(x["mcid"]), F.lit(False))
        last = F.try_element_at(s["out"], F.lit(-1))
        glued = F.struct(last["seq"].alias("seq"), F.concat(last["text"], F.when(gap > 0.3 * x["size"], " ").otherwise(""), x["text"]).alias("text"), (last["parts"] + 1).alias("parts"))
        own = F.struct(x["seq"].alias("seq"), x["text"].alias("text"), F.lit(1).alias("parts"))
        done = F.when(near, F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(glued))).otherwise(F.concat(s["out"], F.array(own)))
        return F.struct(F.when(near, s["ny"]).otherwise(x["ny"]).alias("ny"), (x["x"] + x["width"]).alias("stop"), F.when(near, s["mcid"]).otherwise(x["mcid"]).alias("mcid"), done.alias("out"))

    return _ordered(_frags(spark, d)).select("doc_id", "page_idx", F.inline(F.aggregate("items", start, step, lambda s: s["out"])))


# links and lookups


@query("entity_relations", f"""
SELECT doc_id, elem_seq AS source, elem_seq + 1 AS target, 'precedes' AS relation FROM {_ELEMS} a WHERE EXISTS (SELECT 1 FROM elements b WHERE b.doc_id = a.doc_id AND b.elem_seq = a.elem_seq + 1)
UNION ALL SELECT c.doc_id, h.elem_seq, c.elem_seq, 'contains' FROM {_ELEMS} c JOIN (SELECT doc_id, text, min(elem_seq) AS elem_seq FROM elements WHERE elem_type = 'title' GROUP BY ALL) h ON c.doc_id = h.doc_id AND c.parent_heading = h.text AND c.elem_seq <> h.elem_seq""")
def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between elements: each precedes the next and belongs to its heading; joined on keys, no window over a document."""
    e = _elems(spark, d)
    nxt = e.select("doc_id", F.col("elem_seq").alias("target"))
    precedes = e.select("doc_id", F.col("elem_seq").alias("source"), (F.col("elem_seq") + 1).alias("target")).join(nxt, ["doc_id", "target"]).select("doc_id", "source", "target", F.lit("precedes").alias("relation"))
    heads = e.where("elem_type = 'title'").groupBy("doc_id", F.col("text").alias("parent_heading")).agg(F.min("elem_seq").alias("source"))
    contains = e.select("doc_id", "parent_heading", F.col("elem_seq").alias("target")).join(heads, ["doc_id", "parent_heading"]).where("source <> target")
    return precedes.unionByName(contains.select("doc_id", "source", "target", F.lit("contains").alias("relation")))


@query("source_autofill", """
SELECT row_id, coalesce(r.metadata.source_url, m.source_url) AS source_url, coalesce(nullif(upper(trim(r.metadata.country, ' ')), ''), upper(trim(m.country, ' '))) AS country, m.publisher AS publisher
FROM rag_chunks_sample r LEFT JOIN corpus_manifest m ON m.document_name = r.metadata.document_name""")
def source_autofill(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk says of its source wins; the document's own entry fills the gaps.  Manifest names are unique."""
    m = table(spark, d, "corpus_manifest").select("document_name", F.col("source_url").alias("_u"), F.upper(F.trim("country")).alias("_c"), "publisher")
    c = table(spark, d, "rag_chunks_sample").select("row_id", F.col("metadata.document_name").alias("document_name"), F.col("metadata.source_url").alias("source_url"), F.nullif(F.upper(F.trim("metadata.country")), F.lit("")).alias("country"))
    return c.join(m, "document_name", "left").select("row_id", F.coalesce("source_url", "_u").alias("source_url"), F.coalesce("country", "_c").alias("country"), "publisher")


@query("chunk_page_elements", """
WITH p AS (SELECT DISTINCT regexp_replace(id, '-[0-9]+$', '') AS slug, unnest(metadata.page_numbers) - 1 AS page_idx FROM rag_chunks_sample)
SELECT doc_id, elem_seq FROM (SELECT DISTINCT ON (doc_id, elem_seq) * FROM elements) e WHERE EXISTS (SELECT 1 FROM p WHERE p.slug = e.doc_id AND p.page_idx = e.page_idx)""")
def chunk_page_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements of the pages that chunks refer to, and of no others."""
    p = table(spark, d, "rag_chunks_sample").select(F.regexp_replace("id", r"-[0-9]+\z", "").alias("doc_id"), F.explode("metadata.page_numbers").alias("_p")).select("doc_id", (F.col("_p") - 1).alias("page_idx")).distinct()
    return _elems(spark, d).join(p, ["doc_id", "page_idx"], "left_semi").select("doc_id", "elem_seq")


@query("context_merge", """
SELECT job_id, list_sort(map_keys(params)) AS own, coalesce(params['output'], 'out') AS output, coalesce(params['pages'], 'all') AS pages, kind AS kind FROM batch_jobs""")
def context_merge(spark: SparkSession, d: str) -> DataFrame:
    """A job's own parameters over the defaults, the right side winning, then looked up by name."""
    defaults = F.create_map(F.lit("output"), F.lit("out"), F.lit("pages"), F.lit("all"))
    j = table(spark, d, "batch_jobs")
    both = F.map_from_entries(F.concat(F.map_entries(F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key("params", k), F.lit(False)) | F.col("params")[k].isNull())), F.map_entries(F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()))))
    return j.withColumn("_all", both).select("job_id", F.array_sort(F.map_keys("params")).alias("own"), F.col("_all")["output"].alias("output"), F.col("_all")["pages"].alias("pages"), "kind")


@query("value_position", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY NOT contains(coalesce(text, ''), '20'), seq) AS k FROM {_ONCE})
SELECT doc_id, page_idx, seq, x, y, width, height FROM f WHERE k = 1""")
def value_position(spark: SparkSession, d: str) -> DataFrame:
    """The box of a page's first fragment that holds a value, else of its first fragment."""
    rank = F.struct(~F.contains(F.coalesce("text", F.lit("")), F.lit("20")), "seq")
    return _frags(spark, d).groupBy("doc_id", "page_idx").agg(F.min_by(F.struct("seq", "x", "y", "width", "height"), rank).alias("b")).select("doc_id", "page_idx", "b.*")


def pattern_library(spark: SparkSession) -> DataFrame:
    """(language, field, pattern, base): the invoice patterns as a table; libraries merge by union, repeated entries stay."""
    return spark.createDataFrame(list(X.PATTERNS), "language string, field string, pattern string, base double")


@query("pattern_counts", "SELECT * FROM (VALUES " + ", ".join(f"('{la}', '{f}', {sum(2 if la == 'de' else 1 for a, b, _, _ in X.PATTERNS if (a, b) == (la, f))})" for la, f in dict.fromkeys((a, b) for a, b, _, _ in X.PATTERNS)) + ") t(language, field, n)")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """The default library of all languages merged with that of one."""
    lib = pattern_library(spark)
    return lib.unionAll(lib.where("language = 'de'")).groupBy("language", "field").agg(F.count("*").alias("n"))


# jobs


_NPAGES = "(SELECT doc_id, count(DISTINCT page_idx) AS pages FROM fragments GROUP BY 1)"


@query("split_jobs", f"SELECT job_id, i AS slug, part, part * 2 AS first_page, least(part * 2 + 1, pages - 1) AS last_page FROM (SELECT job_id, i, pages, unnest(range(0, CAST(ceil(pages / 2) AS BIGINT))) AS part FROM (SELECT job_id, unnest(inputs) AS i FROM batch_jobs WHERE kind = 'split') j JOIN {_NPAGES} p ON p.doc_id = j.i)")
def split_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of two pages of every input of the split jobs; inputs without pages have none."""
    pages = table(spark, d, "fragments").groupBy(F.col("doc_id").alias("slug")).agg(F.count_distinct("page_idx").alias("pages"))
    j = table(spark, d, "batch_jobs").where("kind = 'split'").select("job_id", F.explode("inputs").alias("slug")).join(pages, "slug")
    p = j.select("job_id", "slug", "pages", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / 2) - 1)).alias("part"))
    return p.select("job_id", "slug", "part", (F.col("part") * 2).alias("first_page"), F.least(F.col("part") * 2 + 1, F.col("pages") - 1).alias("last_page"))


@query("merge_jobs", f"SELECT job_id, count(*) AS files, sum(coalesce(pages, 0))::BIGINT AS pages, bool_and(pages IS NOT NULL) AS complete FROM (SELECT job_id, unnest(inputs) AS i FROM batch_jobs WHERE kind = 'merge') j LEFT JOIN {_NPAGES} p ON p.doc_id = j.i GROUP BY job_id")
def merge_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Pages of what each merge job writes, and whether all its inputs have any."""
    pages = table(spark, d, "fragments").groupBy(F.col("doc_id").alias("slug")).agg(F.count_distinct("page_idx").alias("pages"))
    j = table(spark, d, "batch_jobs").where("kind = 'merge'").select("job_id", F.explode("inputs").alias("slug")).join(pages, "slug", "left")
    return j.groupBy("job_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.bool_and(F.col("pages").isNotNull()).alias("complete"))


@query("batch_progress", """
SELECT kind, count(*) AS total, count(finished_at) AS done, 100.0 * count(finished_at) / count(*) AS percent, sum(epoch(finished_at - submitted_at)) AS elapsed, CASE WHEN count(finished_at) > 0 THEN sum(epoch(finished_at - submitted_at)) / count(finished_at) * (count(*) - count(finished_at)) END AS eta FROM batch_jobs GROUP BY kind""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    """Jobs done, the time they took, and the time the rest will take at that rate."""
    took = F.unix_micros("finished_at") / 1e6 - F.unix_micros("submitted_at") / 1e6
    j = table(spark, d, "batch_jobs").groupBy("kind").agg(F.count("*").alias("total"), F.count("finished_at").alias("done"), F.sum(took).alias("elapsed"))
    eta = F.when(F.col("done") > 0, F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")))
    return j.select("kind", "total", "done", (F.lit(100.0) * F.col("done") / F.col("total")).alias("percent"), "elapsed", eta.alias("eta"))


@query("slow_jobs", "SELECT job_id, kind FROM batch_jobs WHERE epoch(finished_at - submitted_at) > 600 OR len(inputs) > 3")
def slow_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs over a limit of time or size."""
    took = F.unix_micros("finished_at") / 1e6 - F.unix_micros("submitted_at") / 1e6
    return table(spark, d, "batch_jobs").where((took > 600) | (F.size("inputs") > 3)).select("job_id", "kind")


@query("work_balance", "SELECT CAST(min(n) AS DOUBLE) / max(n) AS balance FROM (SELECT kind, sum(len(inputs)) AS n FROM batch_jobs GROUP BY kind)")
def work_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_jobs").groupBy("kind").agg(F.sum(F.size("inputs")).alias("n")).agg((F.min("n").cast("double") / F.max("n")).alias("balance"))


@query("component_counts", f"SELECT doc_id, elem_type, count(*) AS n, count(bbox) AS placed FROM {_ELEMS} GROUP BY ALL")
def component_counts(spark: SparkSession, d: str) -> DataFrame:
    return _elems(spark, d).groupBy("doc_id", "elem_type").agg(F.count("*").alias("n"), F.count("bbox").alias("placed"))


@query("outline_visible", """
WITH h AS (SELECT doc_id, heading_path AS p FROM elements WHERE len(heading_path) > 0),
     i AS (SELECT DISTINCT doc_id, p[:k] AS item, k FROM h, unnest(range(1, len(p) + 1)) t(k) WHERE k <= len(p))
SELECT doc_id, count(*) AS total, sum(CASE WHEN k <= 2 THEN 1 ELSE 0 END)::BIGINT AS visible FROM i GROUP BY doc_id""")
def outline_visible(spark: SparkSession, d: str) -> DataFrame:
    """Items of each document's outline, and those that show when the first level is open."""
    h = table(spark, d, "elements").where(F.size("heading_path") > 0).select("doc_id", "heading_path", F.explode(F.sequence(F.lit(1), F.size("heading_path"))).alias("k"))
    items = h.select("doc_id", F.slice("heading_path", F.lit(1), F.col("k")).alias("item"), "k").distinct()
    return items.groupBy("doc_id").agg(F.count("*").alias("total"), F.sum((F.col("k") <= 2).cast("long")).alias("visible"))


@query("named_destinations", "SELECT e.doc_id, e.elem_seq, m.source_url || '#page=' || (e.page_idx + 1) AS destination FROM (SELECT DISTINCT ON (doc_id, elem_seq) * FROM elements) e JOIN corpus_manifest m ON m.slug = e.doc_id WHERE e.elem_type = 'title'")
def named_destinations(spark: SparkSession, d: str) -> DataFrame:
    """Where each heading leads, by the name of its document."""
    m = table(spark, d, "corpus_manifest").select(F.col("slug").alias("doc_id"), "source_url")
    return _elems(spark, d).where("elem_type = 'title'").join(m, "doc_id").select("doc_id", "elem_seq", F.concat("source_url", F.lit("#page="), F.col("page_idx") + 1).alias("destination"))


@query("manifest_open", "SELECT slug, coalesce(tier, 'none') AS tier, CASE WHEN tier IS NULL THEN 'assign a tier' WHEN language IS NULL THEN 'state the language' ELSE 'none' END AS finding FROM corpus_manifest WHERE tier IS NULL OR language IS NULL")
def manifest_open(spark: SparkSession, d: str) -> DataFrame:
    """Entries with something open, and what."""
    todo = F.when(F.col("tier").isNull(), "assign a tier").when(F.col("language").isNull(), "state the language").otherwise("none")
    return table(spark, d, "corpus_manifest").where("tier is null or language is null").select("slug", F.coalesce("tier", F.lit("none")).alias("tier"), todo.alias("finding"))
