"""Heading paths, positions, pairs, exports over groups, and the pipeline from elements to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import layout as L
from ..operators import structure as S
from ..sources import tabular
from .layout_queries import _ELEMS, _LINES, _ONCE
from .registry import query, table


@query("heading_paths")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.heading_paths(table(spark, d, "elements").withColumn("s", F.coalesce("bbox.height", F.lit(12.0)) + F.col("confidence")), "s")


@query("rag_chunks")
def rag_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = S.AnalysisPipeline(enrichers={"first": F.col("first_seq"), "upper": F.upper("heading")}, label=F.col("elem_type"))
    return p.run(table(spark, d, "elements"))


@query("kv_spatial", f"""
WITH l AS (SELECT doc_id, page_idx, line_id, list({{'x': x, 'w': width, 't': text}} ORDER BY x, width, text) AS p FROM {_LINES} GROUP BY ALL HAVING count(*) = 2)
SELECT doc_id, page_idx, CAST(line_id AS BIGINT) AS line_id, p[1].t AS key, p[2].t AS value FROM l WHERE p[2].x - (p[1].x + p[1].w) > 20""")
def kv_spatial(spark: SparkSession, d: str) -> DataFrame:
    return S.spatial_pairs(L.gap_groups(L.once(table(spark, d, "fragments")), ["doc_id", "page_idx"], "y", 5.0, "line_id", descending=True))


@query("spatial_tables")
def spatial_tables(spark: SparkSession, d: str) -> DataFrame:
    return S.spatial_tables(table(spark, d, "fragments"))


@query("nearest_columns", f"""
WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS col FROM
 (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq)) > 15 THEN 1 ELSE 0 END AS fresh FROM {_ONCE})),
c AS (SELECT doc_id, page_idx, CAST(col AS BIGINT) AS col, avg(x) AS cx FROM g GROUP BY ALL)
SELECT f.doc_id, f.page_idx, f.seq, arg_min(c.col, (abs(f.x - c.cx), c.col)) AS col, min(abs(f.x - c.cx)) AS distance FROM {_ONCE} f JOIN c ON f.doc_id = c.doc_id AND f.page_idx = c.page_idx GROUP BY ALL HAVING min(abs(f.x - c.cx)) <= 30""")
def nearest_columns(spark: SparkSession, d: str) -> DataFrame:
    f = L.once(table(spark, d, "fragments"))
    columns = L.gap_groups(f, ["doc_id", "page_idx"], "x", 15.0, "col").groupBy("doc_id", "page_idx", "col").agg(F.avg("x").alias("x"))
    return S.nearest_cells(f.select("doc_id", "page_idx", "seq", "x"), columns, 15.0)


_POS = f"(SELECT doc_id, page_idx, seq, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS n FROM {_ONCE})"


@query("text_positions", f"SELECT doc_id, page_idx, seq, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM {_POS}")
def text_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.text_positions(L.once(table(spark, d, "fragments")))


@query("range_to_fragments", f"SELECT doc_id, page_idx, CAST(r AS BIGINT) AS chunk, seq FROM (SELECT *, unnest(range(0, CAST((start + n) // 200 + 1 AS BIGINT))) AS r FROM {_POS}) WHERE start < (r + 1) * 200 AND start + n > r * 200")
def range_to_fragments(spark: SparkSession, d: str) -> DataFrame:
    """All character ranges of 200 to the fragments they overlap: each fragment names its ranges by arithmetic, no range join."""
    p = S.text_positions(L.once(table(spark, d, "fragments")))
    first, last = F.floor(F.col("start") / 200), F.ceil(F.col("stop") / 200) - 1
    spans = p.where("stop > start or start % 200 <> 0").withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last))))
    return spans.select("doc_id", "page_idx", "chunk", "seq")


@query("list_regions", f"""
WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS col FROM
 (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY doc_id, page_idx ORDER BY x, seq)) > 15 THEN 1 ELSE 0 END AS fresh FROM {_ONCE}))
SELECT doc_id, page_idx, max(col) = 1 AND avg(CASE WHEN col = 0 THEN length(text) END) <= 3 AS is_list FROM g GROUP BY ALL""")
def list_regions(spark: SparkSession, d: str) -> DataFrame:
    g = L.gap_groups(L.once(table(spark, d, "fragments")), ["doc_id", "page_idx"], "x", 15.0, "col")
    return g.groupBy("doc_id", "page_idx").agg(((F.max("col") == 1) & (F.avg(F.when(F.col("col") == 0, F.char_length("text"))) <= 3)).alias("is_list"))


@query("numeric_title", r"""
SELECT doc_id, page_idx, seq, text FROM fragments WHERE regexp_matches(text, '^(([A-Z]?[0-9]+(\.[0-9]+)+(\.[a-z])?\.?)|(Section|Chapter) [0-9]+|[IVXLC]+\.) [A-ZÀ-Ý]') AND length(text) <= 120 AND NOT contains(text, ',') AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 14 AND NOT regexp_matches(text, '[.!?]$')""")
def numeric_title(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    prefix = t.rlike(r"^(([A-Z]?[0-9]+(\.[0-9]+)+(\.[a-z])?\.?)|(Section|Chapter) [0-9]+|[IVXLC]+\.) [A-ZÀ-Ý]")
    words = F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    return table(spark, d, "fragments").where(prefix & (F.char_length(t) <= 120) & ~t.contains(",") & (words <= 14) & ~t.rlike(r"[.!?]\z")).select("doc_id", "page_idx", "seq", "text")


@query("line_break_auto", """
WITH l AS (SELECT row_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM rag_chunks_sample)
SELECT row_id, array_to_string(list_transform(l, lambda x, i: x || CASE WHEN i = len(l) THEN '' WHEN x <> '' AND right(x, 1) NOT IN ('.', '!', '?', ':') AND l[i + 1] <> '' THEN ' ' ELSE chr(10) END), '') AS text FROM l""")
def line_break_auto(spark: SparkSession, d: str) -> DataFrame:
    """A line goes on in the next one unless it ends a sentence or the next is empty."""
    t = F.replace("text", F.lit("\r"), F.lit(""))
    return table(spark, d, "rag_chunks_sample").select("row_id", F.regexp_replace(t, r"(?<=[^.!?:\n])\n(?=[^\n])", " ").alias("text"))


@query("pages_json", """
SELECT metadata.document_name AS doc, CAST(metadata.page_numbers[1] AS INTEGER) AS page, list(id ORDER BY id, row_id) AS ids, sum(length(text)) AS chars FROM rag_chunks_sample WHERE len(metadata.page_numbers) > 0 GROUP BY ALL""")
def pages_json(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each page, ordered: what the page-wise exports are rendered from."""
    page = F.try_element_at("metadata.page_numbers", F.lit(1))
    g = table(spark, d, "rag_chunks_sample").select(F.col("metadata.document_name").alias("doc"), page.alias("page"), "id", "row_id", "text").where("page is not null")
    return g.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "row_id"))), lambda x: x["id"]).alias("ids"), F.sum(F.char_length("text")).alias("chars"))


@query("pages_markdown", f"SELECT doc_id, page_idx, '**Page ' || (page_idx + 1) || '**' || chr(10) || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY elem_seq) AS block FROM {_ELEMS} GROUP BY doc_id, page_idx")
def pages_markdown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return e.groupBy("doc_id", "page_idx").agg(F.concat(F.lit("**Page "), F.col("page_idx") + 1, F.lit("**\n\n"), body).alias("block"))


@query("pages_contextual", f"SELECT doc_id, page_idx, 'On page ' || (page_idx + 1) || ':' || chr(10) || string_agg(coalesce(text, ''), ' ' ORDER BY elem_seq) || chr(10) || chr(10) AS block FROM {_ELEMS} GROUP BY doc_id, page_idx")
def pages_contextual(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    return e.groupBy("doc_id", "page_idx").agg(F.concat(F.lit("On page "), F.col("page_idx") + 1, F.lit(":\n"), body, F.lit("\n\n")).alias("block"))


@query("entity_map", f"SELECT doc_id, page_idx, list(elem_seq || ':' || elem_type ORDER BY elem_seq) AS entities FROM {_ELEMS} GROUP BY ALL")
def entity_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"])
    return e.groupBy("doc_id", "page_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", "elem_type"))), lambda x: F.concat(x["elem_seq"], F.lit(":"), x["elem_type"])).alias("entities"))


@query("prometheus", """SELECT 'operation_total{op="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit('operation_total{op="'), "event_type", F.lit('"} '), "n").alias("line"))


@query("tabular_round_trip", "SELECT row_id, id, metadata.chunk_id AS chunk_id, coalesce(metadata.page_numbers, []) AS pages, metadata.token_estimate AS tokens, text AS content FROM rag_chunks_sample WHERE metadata.chunk_id IS NOT NULL")
def tabular_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written and read back: the rows must come out as they went in."""
    return tabular.decode(tabular.encode(table(spark, d, "rag_chunks_sample").where("metadata.chunk_id is not null")))


@query("target_search", "SELECT row_id, list_filter(generate_series(1, length(text)), lambda i: lower(substr(text, i, 3)) = 'ana') AS positions FROM rag_chunks_sample WHERE contains(lower(text), 'ana')")
def target_search(spark: SparkSession, d: str) -> DataFrame:
    """All positions of a target, overlapping ones too, whatever the case."""
    at = F.filter(F.sequence(F.lit(1), F.char_length("text")), lambda i: F.lower(F.substring("text", i, F.lit(3))) == "ana")
    return table(spark, d, "rag_chunks_sample").where(F.lower("text").contains("ana")).select("row_id", F.transform(at, lambda i: i.cast("long")).alias("positions"))


# words and white space as Unicode has them, for an engine whose \\b and \\s are ASCII
_UNICODE = "regexp_replace(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\P{L}]|\\p{M}', '_', 'g'), '[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]', ' ', 'g'), '[^\\x00-\\x7F\\P{Nd}]', '0', 'g')"
_CN = [f"len(regexp_extract_all(t, '(?i){p}'))" for p in (*X.DATES, *X.CONTRACT)]
_DATES_SQL, _FACTS_SQL = (" + ".join(_CN[i : i + 4]) for i in (0, 4))


@query("contract_facts", f"""
WITH c AS (SELECT doc_id, {_DATES_SQL} AS dates, {_FACTS_SQL} AS facts FROM (SELECT doc_id, {_UNICODE} AS t FROM documents WHERE text IS NOT NULL))
SELECT doc_id, dates, facts, CASE WHEN dates + facts = 0 THEN 0.0 ELSE (0.9 * dates + 0.8 * facts) / (dates + facts) END AS confidence FROM c""")
def contract_facts(spark: SparkSession, d: str) -> DataFrame:
    """Dates, and numbers of agreements, parties and amounts, of every text; words are bounded as Unicode has them."""
    n = [F.regexp_count("text", F.lit(f"(?Ui){p}")) for p in (*X.DATES, *X.CONTRACT)]
    dates, facts = sum(n[1:4], n[0]), sum(n[5:], n[4])
    score = F.when(dates + facts == 0, 0.0).otherwise((0.9 * dates + 0.8 * facts) / (dates + facts))
    return table(spark, d, "documents").where("text is not null").select("doc_id", dates.alias("dates"), facts.alias("facts"), score.alias("confidence"))


@query("date_mask", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d.%m.%Y') AS eu, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_mask(spark: SparkSession, d: str) -> DataFrame:
    digits = F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd"), "[^0-9]", "")
    y, m, dd = F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("/", m, dd, y).alias("us"), F.concat_ws(".", dd, m, y).alias("eu"), F.concat_ws("-", y, m, dd).alias("iso"))


@query("color_scale", "SELECT c_custkey, CAST(round(255 * (c_acctbal - lo) / (hi - lo)) AS BIGINT) AS red FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def color_scale(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ends = F.broadcast(c.agg(F.min("c_acctbal").alias("_lo"), F.max("c_acctbal").alias("_hi")))  # one row
    return c.join(ends).select("c_custkey", F.round(255 * (F.col("c_acctbal") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("long").alias("red"))
