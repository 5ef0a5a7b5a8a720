"""Smaller helpers: page templates, sniffing, confidence filters, masks, batch runs, hierarchy counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .layout_queries import _ELEMS, _ONCE
from .registry import query, table


def page_template(template: str, values: dict[str, Column]) -> Column:
    """A header or footer with {{page_number}}, {{total_pages}} and custom values."""
    out: Column = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), v.cast("string"))
    return out


@query("header_template", f"SELECT doc_id, page_idx, 'Page ' || (page_idx + 1) || ' of ' || (max(page_idx) OVER (PARTITION BY doc_id) + 1) || ' – ' || doc_id AS header FROM (SELECT DISTINCT doc_id, page_idx FROM {_ONCE})")
def header_template(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "fragments").select("doc_id", "page_idx").distinct()
    total = F.max("page_idx").over(Window.partitionBy("doc_id")) + 1
    return p.withColumn("n", total).select("doc_id", "page_idx", page_template("Page {{page_number}} of {{total_pages}} – {{doc}}", {"page_number": F.col("page_idx") + 1, "total_pages": F.col("n"), "doc": F.col("doc_id")}).alias("header"))


@query("content_sniff", """
SELECT doc_id, CASE WHEN text LIKE '%PDF-%' AND starts_with(text, '%PDF-') THEN 'pdf' WHEN starts_with(text, '{') OR starts_with(text, '[') THEN 'structured' WHEN p > 0.8 THEN 'text' WHEN p > 0.4 THEN 'mixed' ELSE 'binary' END AS kind
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^ -~\\n\\r\\t]', '', 'g')) / length(text) AS p FROM documents WHERE text <> '')""")
def content_sniff(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    p = F.char_length(F.regexp_replace(t, r"[^ -~\n\r\t]", "")) / F.char_length(t)
    kind = F.when(t.startswith("%PDF-"), "pdf").when(t.startswith("{") | t.startswith("["), "structured").when(p > 0.8, "text").when(p > 0.4, "mixed").otherwise("binary")
    return table(spark, d, "documents").where(t != "").select("doc_id", kind.alias("kind"))


@query("confidence_filter", f"SELECT doc_id, elem_seq, elem_type, confidence FROM {_ELEMS} WHERE confidence < 0.9")
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where("confidence < 0.9").select("doc_id", "elem_seq", "elem_type", "confidence")


@query("average_confidence", f"SELECT doc_id, coalesce(avg(confidence), 0) AS mean, bool_or(confidence < 0.8) AS low FROM {_ELEMS} GROUP BY doc_id")
def average_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"), F.bool_or(F.col("confidence") < 0.8).alias("low"))


@query("elements_by_confidence", f"SELECT doc_id, list(elem_seq ORDER BY confidence, elem_seq) AS worst_first FROM {_ELEMS} WHERE confidence IS NOT NULL GROUP BY doc_id")
def elements_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where("confidence is not null")
    return e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("confidence", "elem_seq"))), lambda x: x["elem_seq"]).alias("worst_first"))


@query("fragments_in_region", f"SELECT doc_id, page_idx, seq FROM {_ONCE} WHERE x >= 40 AND x + width <= 320 AND y >= 100 AND y + height <= 500")
def fragments_in_region(spark: SparkSession, d: str) -> DataFrame:
    inside = (F.col("x") >= 40) & (F.col("x") + F.col("width") <= 320) & (F.col("y") >= 100) & (F.col("y") + F.col("height") <= 500)
    return table(spark, d, "fragments").dropDuplicates(["doc_id", "page_idx", "seq"]).where(inside).select("doc_id", "page_idx", "seq")


@query("point_in_box", f"SELECT doc_id, elem_seq FROM {_ELEMS} WHERE 100 BETWEEN bbox.x AND bbox.x + bbox.width AND 400 BETWEEN bbox.y AND bbox.y + bbox.height")
def point_in_box(spark: SparkSession, d: str) -> DataFrame:
    b = lambda c: F.col(f"bbox.{c}")
    return table(spark, d, "elements").dropDuplicates(["doc_id", "elem_seq"]).where(F.lit(100).between(b("x"), b("x") + b("width")) & F.lit(400).between(b("y"), b("y") + b("height"))).select("doc_id", "elem_seq")


@query("affine_map", f"SELECT doc_id, page_idx, seq, 2 * x + 10 AS tx, -1 * y + page_height AS ty FROM {_ONCE}")
def affine_map(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, dd, e, f = (2.0, 0.0, 0.0, -1.0, 10.0, F.col("page_height"))
    x, y = F.col("x"), F.col("y")
    return table(spark, d, "fragments").dropDuplicates(["doc_id", "page_idx", "seq"]).select("doc_id", "page_idx", "seq", (a * x + c * y + e).alias("tx"), (b * x + dd * y + f).alias("ty"))


@query("kpi_format", "SELECT c_custkey, printf('%.2f', c_acctbal) || ' €' AS currency, printf('%.1f', c_acctbal * 100) || '%' AS percent FROM customer")
def kpi_format(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.format_string("%.2f", v), F.lit(" €")).alias("currency"), F.concat(F.format_string("%.1f", v * 100), F.lit("%")).alias("percent"))


def fill_mask(value: Column, pattern: str, placeholder: str = "#") -> Column:
    """Placeholders filled from the value's characters in order; the result stops where the value ends."""
    out, used = F.lit(""), 0
    for c in pattern:
        if c == placeholder:
            used += 1
            out = F.concat(out, F.substring(value, used, 1))
        else:
            out = F.when(F.char_length(value) > used, F.concat(out, F.lit(c))).otherwise(out)
    return out


@query("custom_mask", "SELECT o_orderkey, k, substr(k, 1, 2) || CASE WHEN length(k) > 2 THEN '-' ELSE '' END || substr(k, 3, 2) || CASE WHEN length(k) > 4 THEN '/' ELSE '' END || substr(k, 5, 3) AS masked FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)")
def custom_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", k.alias("k"), fill_mask(k, "##-##/###").alias("masked"))


@query("font_diff", f"""
WITH a AS (SELECT DISTINCT font_name FROM {_ONCE} WHERE page_idx % 2 = 0 AND font_name IS NOT NULL), b AS (SELECT DISTINCT font_name FROM {_ONCE} WHERE page_idx % 2 = 1 AND font_name IS NOT NULL)
SELECT font_name, 'missing' AS difference FROM (FROM a EXCEPT FROM b) UNION ALL SELECT font_name, 'extra' FROM (FROM b EXCEPT FROM a)""")
def font_diff(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments").where("font_name is not null")
    sides = f.groupBy("font_name").agg(F.bool_or(F.col("page_idx") % 2 == 0).alias("a"), F.bool_or(F.col("page_idx") % 2 == 1).alias("b"))
    return sides.where("a <> b").select("font_name", F.when(F.col("a"), "missing").otherwise("extra").alias("difference"))


@query("outline_totals", """
WITH RECURSIVE i AS (SELECT DISTINCT doc_id, heading_path[:k] AS item, k FROM elements, unnest(range(1, len(heading_path) + 1)) t(k) WHERE k <= len(heading_path)),
t AS (SELECT doc_id, item AS root, item AS node, 1 AS depth FROM i WHERE k = 1 UNION ALL SELECT t.doc_id, t.root, i.item, t.depth + 1 FROM t JOIN i ON i.doc_id = t.doc_id AND i.k = len(t.node) + 1 AND i.item[:len(t.node)] = t.node)
SELECT doc_id, root[1] AS root, count(*) - 1 AS descendants, max(depth) AS depth FROM t GROUP BY doc_id, root""")
def outline_totals(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of each top heading in the outline of its document: every item of the heading paths, counted once, under its first heading."""
    h = table(spark, d, "elements").where(F.size("heading_path") > 0).select("doc_id", "heading_path", F.explode(F.sequence(F.lit(1), F.size("heading_path"))).alias("k"))
    items = h.select("doc_id", F.slice("heading_path", F.lit(1), F.col("k")).alias("item")).distinct()
    return items.groupBy("doc_id", F.element_at("item", 1).alias("root")).agg((F.count("*") - 1).alias("descendants"), F.max(F.size("item")).alias("depth"))


_JOB_PAGES = "(SELECT doc_id, count(DISTINCT page_idx) AS n FROM fragments GROUP BY 1)"


@query("batch_run", f"""
WITH i AS (SELECT job_id, kind, u.s AS slug, u.k AS k FROM batch_jobs, unnest(inputs) WITH ORDINALITY u(s, k)),
     w AS (SELECT i.*, p.n FROM i LEFT JOIN {_JOB_PAGES} p ON p.doc_id = i.slug)
SELECT b.job_id, coalesce(bool_and(n IS NOT NULL), false) AS ok, string_agg(CASE WHEN w.slug IS NOT NULL AND n IS NULL THEN w.slug END, ', ' ORDER BY k) AS missing,
 CASE b.kind WHEN 'split' THEN coalesce(sum(n), 0) WHEN 'merge' THEN CASE WHEN count(n) > 0 THEN 1 ELSE 0 END ELSE count(n) END::BIGINT AS outputs, coalesce(sum(n), 0)::BIGINT AS pages
FROM batch_jobs b LEFT JOIN w USING (job_id) GROUP BY b.job_id, b.kind""")
def batch_run(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, ok, missing, outputs, pages): every job done on the pages its inputs have.

    Splitting writes a file a page, merging one file, other kinds one for each input.
    An input without pages fails its job, not the others, and is named.
    """
    pages = table(spark, d, "fragments").groupBy(F.col("doc_id").alias("slug")).agg(F.count_distinct("page_idx").alias("n"))
    j = table(spark, d, "batch_jobs").select("job_id", "kind", F.posexplode_outer("inputs").alias("k", "slug")).join(pages, "slug", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("slug").isNotNull() & F.col("n").isNull(), F.struct("k", "slug"))))
    g = j.groupBy("job_id", "kind").agg(F.coalesce(F.bool_and(F.col("n").isNotNull()), F.lit(False)).alias("ok"), missing.alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.count("n").alias("done"))
    outputs = F.when(F.col("kind") == "split", F.col("pages")).when(F.col("kind") == "merge", F.least(F.col("done"), F.lit(1))).otherwise(F.col("done"))
    names = F.when(F.size("m") > 0, F.array_join(F.transform("m", lambda x: x["slug"]), ", "))
    return g.select("job_id", "ok", names.alias("missing"), outputs.alias("outputs"), "pages")


@query("sliding_events", """
WITH s AS (SELECT e.event_type, e.value, date_trunc('hour', ts) + k.unnest * INTERVAL 15 MINUTE - INTERVAL 45 MINUTE AS bucket, ts FROM events e, unnest(generate_series(0, 6)) k)
SELECT bucket, event_type, count(*) AS n FROM s WHERE ts >= bucket AND ts < bucket + INTERVAL 1 HOUR GROUP BY ALL""")
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").start.alias("bucket"), "event_type").agg(F.count("*").alias("n"))
