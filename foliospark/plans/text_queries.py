"""Scalar text functions and chunkers over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from .registry import WS, query, sql_words, table

SQL_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{t}}, '([.!?]) |(\n)', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"


@query("text_counts", f"""
SELECT doc_id, length(text) AS chars, len({sql_words('text')}) AS words, len({SQL_SENTENCES.replace('{t}', 'text')}) AS sentences,
       CAST(floor(CAST(len({sql_words('text')}) AS FLOAT) * CAST(1.33 AS FLOAT)) AS INTEGER) AS token_estimate
FROM documents WHERE text IS NOT NULL""")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", F.char_length(t).alias("chars"), T.word_count(t).alias("words"), T.sentence_count(t).alias("sentences"), T.token_estimate(t).alias("token_estimate"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_DIRTY = "replace(replace(text, ' de ', chr(13) || ' ' || chr(3) || '  de '), '.', '.' || chr(7))"


def _sql_sanitize(lone: str) -> str:
    s = _DIRTY
    for pattern, to in ((rf"\r{_CTRL}*\n", "chr(10)"), (r"\r", lone), (_CTRL, "''"), (r"([ \t]) +", r"'\1'")):
        s = f"regexp_replace({s}, '{pattern}', {to}, 'g')"
    return s


for _name, _lone, _mode in (("text_sanitize", "''", "remove"), ("text_sanitize_cr_space", "' '", "space"), ("text_sanitize_cr_newline", "chr(10)", "newline")):

    def _sanitize(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        dirty = F.replace(F.replace(F.col("text"), F.lit(" de "), F.lit("\r \x03  de ")), F.lit("."), F.lit(".\x07"))
        return table(spark, d, "documents").where("text is not null").select("doc_id", T.sanitize(dirty, mode).alias("clean"))

    query(_name, f"SELECT doc_id, {_sql_sanitize(_lone)} AS clean FROM documents WHERE text IS NOT NULL")(_sanitize)


@query("sentence_split", f"SELECT doc_id, unnest({SQL_SENTENCES.replace('{t}', 'text')}) AS sentence FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query("sentence_split_greedy", r"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)[^.!?]*[.!?]') AS p, regexp_extract(text, '(?s)([^.!?]*)$', 1) AS r FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN len(p) = 0 THEN 1 ELSE len(p) END AS n, CASE WHEN len(p) = 0 THEN text ELSE p[len(p)] || r END AS last FROM s""")
def sentence_split_greedy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text <> ''").select("doc_id", T.sentences_greedy(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.element_at("s", -1).alias("last"))


@query("dehyphenate", r"SELECT row_id, regexp_replace(text, '-[ \t]*\n[\t\n\x0b\f\r ]*([^\t\n\x0b\f\r ])', '\1', 'g') AS text FROM rag_chunks_sample")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select("row_id", T.dehyphenate(F.col("text")).alias("text"))


@query("positional_similarity", """
SELECT row_id, CASE WHEN h = p THEN 1.0 WHEN least(length(h), length(p)) = 0 THEN 0.0
  ELSE len(list_filter(generate_series(1, least(length(h), length(p))), lambda i: substr(h, i, 1) = substr(p, i, 1))) / greatest(length(h), length(p)) END AS similarity
FROM (SELECT row_id, metadata.heading_context AS h, metadata.document_name AS p FROM rag_chunks_sample WHERE metadata.heading_context IS NOT NULL AND metadata.document_name IS NOT NULL)""")
def positional_similarity(spark: SparkSession, d: str) -> DataFrame:
    h, p = F.col("metadata.heading_context"), F.col("metadata.document_name")
    return table(spark, d, "rag_chunks_sample").where(h.isNotNull() & p.isNotNull()).select("row_id", T.positional_similarity(h, p).alias("similarity"))


@query("edit_distance", "SELECT row_id, levenshtein(lower(regexp_replace(metadata.heading_context, '[^ -~]', '', 'g')), lower(regexp_replace(metadata.document_name, '[^ -~]', '', 'g'))) AS distance FROM rag_chunks_sample WHERE metadata.heading_context IS NOT NULL")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = lambda c: F.lower(F.regexp_replace(c, "[^ -~]", ""))
    return table(spark, d, "rag_chunks_sample").where("metadata.heading_context is not null").select("row_id", F.levenshtein(ascii_only(F.col("metadata.heading_context")), ascii_only(F.col("metadata.document_name"))).alias("distance"))


@query("chunk_ids", "SELECT row_id, substr(sha256(text), 1, 16) || ':' || (row_id % 7) AS chunk_id FROM rag_chunks_sample")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select("row_id", T.chunk_id(F.col("text"), F.col("row_id") % 7).alias("chunk_id"))


@query("chunk_links", """
WITH once AS (SELECT metadata.document_name AS doc, id, min(CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)) AS n FROM rag_chunks_sample GROUP BY ALL)
SELECT doc, id, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id FROM once WINDOW w AS (PARTITION BY doc ORDER BY n, id)""")
def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "rag_chunks_sample").groupBy(F.col("metadata.document_name").alias("doc"), "id").agg(F.min(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")).alias("n"))
    return C.linked(once.withColumn("k", F.struct("n", "id")), "doc", "k", "id").drop("n", "k")


@query("context_prefix", """
SELECT row_id, CASE WHEN nm IS NULL AND sec IS NULL THEN NULL ELSE concat_ws(chr(10), 'Document: ' || nm || coalesce(' by ' || au, ''), 'Section: ' || sec)
  || coalesce(' (' || CASE WHEN a = b THEN 'p. ' || a ELSE 'p. ' || a || '–' || b END || ')', '') END AS prefix
FROM (SELECT row_id, metadata.document_name AS nm, metadata.country AS au, metadata.heading_context AS sec, metadata.page_span."first" AS a, metadata.page_span."last" AS b FROM rag_chunks_sample)""")
def context_prefix(spark: SparkSession, d: str) -> DataFrame:
    m = lambda c: F.col(f"metadata.{c}")
    span = T.page_span(m("page_span.first"), m("page_span.last"))
    return table(spark, d, "rag_chunks_sample").select("row_id", T.context_prefix(m("document_name"), m("country"), m("heading_context"), span).alias("prefix"))


@query("rag_full_text", "SELECT row_id, CASE WHEN metadata.heading_context IS NULL THEN text ELSE metadata.heading_context || chr(10) || chr(10) || text END AS full_text FROM rag_chunks_sample")
def rag_full_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select("row_id", F.when(F.col("metadata.heading_context").isNull(), F.col("text")).otherwise(F.concat("metadata.heading_context", F.lit("\n\n"), "text")).alias("full_text"))


_ROMAN = "repeat('M', n // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]"


@query("page_labels", f"""
WITH p AS (SELECT slug, CAST(u.unnest AS BIGINT) AS n FROM corpus_manifest, unnest(generate_series(1, 120)) u)
SELECT slug, n, {_ROMAN} AS roman,
  CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS letters,
  CASE WHEN n <= 6 THEN lower({_ROMAN}) ELSE 'P-' || (n - 6) END AS label FROM p""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "corpus_manifest").select("slug", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(120).cast("long"))).alias("n"))
    n = F.col("n")
    label = F.when(n <= 6, T.page_label(F.lit("roman"), F.lit(None).cast("string"), n)).otherwise(T.page_label(F.lit("decimal"), F.lit("P-"), n - 6))
    return p.select("slug", "n", T.roman(n).alias("roman"), T.letters(n).alias("letters"), label.alias("label"))


@query("page_label_lookup", """
WITH r AS (SELECT slug, s.unnest AS start, 'S' || s.unnest || '-' AS prefix FROM corpus_manifest, unnest([0, 4, 10]) s),
     p AS (SELECT slug, u.unnest AS page FROM corpus_manifest, unnest(generate_series(0, 20)) u)
SELECT p.slug, p.page, max_by(r.prefix, r.start) || (p.page - max(r.start) + 1) AS label FROM p JOIN r ON p.slug = r.slug AND r.start <= p.page GROUP BY p.slug, p.page""")
def page_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """As-of: the latest range that starts at or before the page, by one ordered window over both."""
    from pyspark.sql import Window

    m = table(spark, d, "corpus_manifest").select("slug")
    ranges = m.select("slug", F.explode(F.array(F.lit(0), F.lit(4), F.lit(10))).alias("page")).withColumn("start", F.col("page"))
    pages = m.select("slug", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("page")).withColumn("start", F.lit(None).cast("int"))
    w = Window.partitionBy("slug").orderBy("page", F.col("start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = ranges.withColumn("k", F.lit(0)).unionByName(pages.withColumn("k", F.lit(1))).withColumn("at", F.last("start", ignorenulls=True).over(w))
    return both.where("k = 1").select("slug", "page", F.concat(F.lit("S"), "at", F.lit("-"), F.col("page") - F.col("at") + 1).alias("label"))


@query("page_range_indices", """
WITH j AS (SELECT job_id, element_at(params, 'pages')[1] AS spec FROM batch_jobs WHERE params IS NOT NULL)
SELECT job_id, CAST(u.unnest AS INTEGER) AS page_idx FROM j, unnest(generate_series(CAST(split_part(spec, '-', 1) AS INTEGER) - 1, CAST(split_part(spec, '-', 2) AS INTEGER) - 1)) u
WHERE spec SIMILAR TO '[0-9]+-[0-9]+' AND CAST(split_part(spec, '-', 1) AS INTEGER) BETWEEN 1 AND CAST(split_part(spec, '-', 2) AS INTEGER)""".replace("element_at(params, 'pages')[1]", "params['pages']"))
def page_range_indices(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "batch_jobs").where(F.col("params.pages").rlike("^[0-9]+-[0-9]+$"))
    return j.select("job_id", F.explode(T.page_range(F.col("params.pages"), F.lit(1_000_000))).alias("page_idx"))


@query("template_render", """
SELECT slug, 'Source: ' || document_name || ' (' || country || '), ' || slug || ' / ' || document_name AS rendered, ['country', 'name', 'slug'] AS variables FROM corpus_manifest""")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    tpl = F.lit("Source: {{ name }} ({{country}}), {{ slug }} / {{name}}")
    ctx = F.create_map(F.lit("name"), "document_name", F.lit("country"), "country", F.lit("slug"), "slug")
    return table(spark, d, "corpus_manifest").select("slug", T.template_render(tpl, ctx).alias("rendered"), T.template_variables(tpl).alias("variables"))


@query("element_display_text", """
SELECT doc_id, elem_seq, CASE elem_type WHEN 'table' THEN coalesce(array_to_string(list_transform(table_cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10)), '')
  WHEN 'key_value' THEN coalesce(kv_key, '') || ': ' || coalesce(kv_value, '') WHEN 'image' THEN coalesce(alt_text, '') ELSE coalesce(text, '') END AS shown FROM elements""")
def element_display_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "elements").select("doc_id", "elem_seq", C.display_text(c("elem_type"), c("text"), c("kv_key"), c("kv_value"), c("table_cells"), c("alt_text")).alias("shown"))


@query("table_shape", "SELECT doc_id, elem_seq, len(table_cells) AS n_rows, len(table_cells[1]) AS n_cols, table_cells[2][1] AS cell_1_0 FROM elements WHERE elem_type = 'table'")
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("table_cells")
    first = F.try_element_at(t, F.lit(1))
    return table(spark, d, "elements").where("elem_type = 'table'").select(
        "doc_id", "elem_seq", F.when(t.isNotNull(), F.size(t)).alias("n_rows"), F.when(first.isNotNull(), F.size(first)).alias("n_cols"), F.try_element_at(F.try_element_at(t, F.lit(2)), F.lit(1)).alias("cell_1_0"))


@query("list_item_predicate", r"SELECT doc_id, page_idx, seq, text FROM fragments WHERE regexp_matches(text, '^[\t\n\x0b\f\r \x{85}\x{a0}]*([-*•–—] |[0-9a-z][.)] |[0-9]{2}[.)] )')")
def list_item_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments").where(T.is_list_item(F.col("text"))).select("doc_id", "page_idx", "seq", "text")


@query("struct_tag_class", """
SELECT doc_id, page_idx, seq, CASE WHEN struct_tag IN ('H', 'Title') OR struct_tag SIMILAR TO 'H[1-6]' THEN 'heading' WHEN struct_tag IN ('LI', 'Lbl', 'LBody') THEN 'list_item' WHEN struct_tag = 'L' THEN 'list' WHEN struct_tag = 'Artifact' THEN 'artifact' ELSE struct_tag END AS class FROM fragments""")
def struct_tag_class(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("struct_tag")
    c = F.when(t.rlike("^(H[1-6]?|Title)$"), "heading").when(t.isin("LI", "Lbl", "LBody"), "list_item").when(t == "L", "list").when(t == "Artifact", "artifact").otherwise(t)
    return table(spark, d, "fragments").select("doc_id", "page_idx", "seq", c.alias("class"))


@query("language_labels", """
SELECT r.row_id, l.lang FROM rag_chunks_sample r LEFT JOIN lang_codes l
  ON lower(trim(r.metadata.language)) IN (l.lang, l.code_t, l.code_b, lower(l.name_en), lower(l.name_own))""")
def language_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in several spellings to codes: the eight-row code table is turned into (spelling, code) and broadcast."""
    codes = table(spark, d, "lang_codes").select("lang", F.explode(F.array_distinct(F.array(F.lower("lang"), F.lower("code_t"), F.lower("code_b"), F.lower("name_en"), F.lower("name_own")))).alias("spelling"))
    return table(spark, d, "rag_chunks_sample").select("row_id", F.lower(F.trim("metadata.language")).alias("spelling")).join(F.broadcast(codes), "spelling", "left").select("row_id", "lang")


_CHUNK_SQL = f"""
WITH RECURSIVE tok AS (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
tk AS (SELECT doc_id, w, len(w) AS n, list_transform(w, lambda x: regexp_matches(x, '[.!?]$')) AS m FROM tok WHERE len(w) > 0),
ch AS (
  SELECT doc_id, 0 AS i, 0 AS s, CAST(NULL AS BIGINT) AS e, false AS r, false AS emitted FROM tk
  UNION ALL
  SELECT c.doc_id, CASE WHEN c.emitted THEN c.i + 1 ELSE 0 END, x.s, CASE WHEN x.full_end < x.n AND x.cut IS NOT NULL THEN x.cut ELSE x.full_end END, x.full_end < x.n AND x.cut IS NOT NULL, true
  FROM ch c JOIN LATERAL (
    SELECT y.s, y.n, y.full_end, list_max(list_filter(generate_series(greatest(y.full_end - 10, y.s + 2), y.full_end), lambda k: y.m[k])) AS cut
    FROM (SELECT t.n, t.m, least(t.n, z.s + {{size}}) AS full_end, z.s FROM tk t, (SELECT CASE WHEN NOT c.emitted THEN 0 WHEN c.e - {{ov}} > c.s THEN c.e - {{ov}} ELSE c.e END AS s) z WHERE t.doc_id = c.doc_id) y
  ) x ON true
  WHERE NOT c.emitted OR c.e < x.n)
SELECT ch.doc_id, ch.i AS chunk_index, array_to_string(tk.w[ch.s + 1 : ch.e], ' ') AS content, ch.e - ch.s AS n_tokens, ch.s AS start_token, ch.r AS respected FROM ch JOIN tk USING (doc_id) WHERE ch.emitted"""


def _fixed(size: int, overlap: int):
    return lambda spark, d: C.fixed_windows(table(spark, d, "documents"), "doc_id", "text", size, overlap)


query("fixed_window_chunks", _CHUNK_SQL.replace("{size}", "128").replace("{ov}", "16"))(_fixed(128, 16))
query("legacy_chunks", _CHUNK_SQL.replace("{size}", "100").replace("{ov}", "10"))(_fixed(100, 10))  # the overlap is a tenth of the target
query("fixed_window_chunks_512", _CHUNK_SQL.replace("{size}", "512").replace("{ov}", "50"))(_fixed(512, 50))


@query("chunks_by_language", f"WITH q AS ({_CHUNK_SQL.replace('{size}', '128').replace('{ov}', '16')}) SELECT lower(lang) AS lang, count(*) AS chunks, avg(n_tokens) AS mean_tokens, sum(CAST(respected AS INTEGER)) AS respected FROM q JOIN documents USING (doc_id) GROUP BY ALL")
def chunks_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lower("lang").alias("lang"), "text")
    spans = C.fixed_windows(docs, "lang", "text", 128, 16, content=False)
    return spans.groupBy("lang").agg(F.count("*").alias("chunks"), F.avg("n_tokens").alias("mean_tokens"), F.sum(F.col("respected").cast("int")).alias("respected"))


@query("chunk_byte_offsets", f"WITH q AS ({_CHUNK_SQL.replace('{size}', '128').replace('{ov}', '16')}) SELECT doc_id, chunk_index, coalesce(sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM q")
def chunk_byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running sum of the contents' byte lengths, as the reference counts offsets; overlap counts twice."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    sized = C.fixed_windows(table(spark, d, "documents"), "doc_id", "text", 128, 16).select("doc_id", "chunk_index", F.octet_length("content").alias("n"))
    return sized.select("doc_id", "chunk_index", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start_char"))


@query("sentence_packing")
def sentence_packing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.pack_sentences(F.col("text"), 64)).alias("piece_no", "piece"))


@query("hybrid_chunks")
def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.hybrid_chunks(table(spark, d, "elements"), 512)


@query("hybrid_chunks_by_characters")
def hybrid_chunks_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """The same with another token counter: four characters a token."""
    return C.hybrid_chunks(table(spark, d, "elements"), 512, count=C.characters_over_four)


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.semantic_chunks(table(spark, d, "elements"), 256, 40)
