"""Records, pivots, statistics, validation, calculation, page operations and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import calculate as K
from .registry import query, table

# records: the numbers of lineitem as text, one in eleven not a number
_REC = "(SELECT l_returnflag AS region, CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS amount FROM lineitem)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    amount = F.when(F.col("l_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), amount.alias("amount"))


@query("record_totals", f"SELECT count(*) AS n, sum(TRY_CAST(amount AS DOUBLE)) AS total, avg(TRY_CAST(amount AS DOUBLE)) AS mean, min(TRY_CAST(amount AS DOUBLE)) AS least, max(TRY_CAST(amount AS DOUBLE)) AS most FROM {_REC}")
def record_totals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("amount")
    return _records(spark, d).agg(F.count(F.lit(1)).alias("n"), A.record_sum(v).alias("total"), A.record_avg(v).alias("mean"), A.record_min(v).alias("least"), A.record_max(v).alias("most"))


@query("record_group_by", f"SELECT region, count(*) AS n, sum(TRY_CAST(amount AS DOUBLE)) AS total, avg(TRY_CAST(amount AS DOUBLE)) AS mean, min(TRY_CAST(amount AS DOUBLE)) AS least, max(TRY_CAST(amount AS DOUBLE)) AS most FROM {_REC} GROUP BY region")
def record_group_by(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped(_records(spark, d), "region", "amount")


@query("record_filter", f"SELECT region, amount FROM {_REC} WHERE region = 'R' AND TRY_CAST(amount AS DOUBLE) > 45")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where((F.col("region") == "R") & (A.strict_number(F.col("amount")) > 45))


for _f in ("count", "sum", "avg", "min", "max"):

    def _pivot(spark: SparkSession, d: str, f: str = _f) -> DataFrame:
        return A.pivot(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", [str(i) for i in range(1, 8)], f, "l_quantity")

    _cells = ", ".join(f"{_f}(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS \"{i}\"" for i in range(1, 8))
    query(f"pivot_{_f}", f"SELECT l_returnflag, l_linestatus, {_cells}, {_f}(l_quantity) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(_pivot)


@query("pivot_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def pivot_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("field_functions", """
SELECT p_partkey, p_size + p_retailprice AS f_sum, (p_size + p_retailprice) / 2 AS f_average, least(p_size, p_retailprice) AS f_min, greatest(p_size, p_retailprice) AS f_max, p_size * p_retailprice AS f_product, 2.0 AS f_count FROM part""")
def field_functions(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col("p_size").cast("double"), F.col("p_retailprice")]
    return table(spark, d, "part").select("p_partkey", *[A.row_function(f, cols).alias(f"f_{f}") for f in ("sum", "average", "min", "max", "product", "count")])


@query("histogram_percentile", """
WITH b AS (SELECT event_type, value FROM events), e AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0, CAST('inf' AS DOUBLE)]) AS bound),
t AS (SELECT event_type, count(value) AS n FROM b GROUP BY 1), c AS (SELECT t.event_type, t.n, e.bound, count_if(b.value <= e.bound) AS k FROM t JOIN b USING (event_type), e GROUP BY ALL)
SELECT event_type, n, min(bound) AS bound FROM c WHERE k >= floor(n * 0.95) GROUP BY ALL""")
def histogram_percentile(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram_percentile(table(spark, d, "events"), ["event_type"], "value", 0.95)


@query("operation_stats", "SELECT event_type AS op, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, avg(value) AS mean FROM events GROUP BY 1")
def operation_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))


@query("worst_operation", "WITH s AS (SELECT event_type AS op, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT arg_max(op, mean) AS slowest, arg_max(op, n) AS most_frequent FROM s")
def worst_operation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return s.agg(F.max_by("op", "mean").alias("slowest"), F.max_by("op", "n").alias("most_frequent"))


@query("recent_operations", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_operations(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred, in chronological order: the limit is the feature."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).orderBy("ts", "event_id").select("event_id", "event_type")


@query("batch_summary", """
SELECT kind, count(*) AS total, count(finished_at) AS successful, count(*) - count(finished_at) AS unfinished, 100.0 * count(finished_at) / count(*) AS success_rate,
  avg(epoch(finished_at) - epoch(submitted_at)) AS mean_seconds, sum(len(inputs)) AS inputs FROM batch_jobs GROUP BY kind""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    sec = F.unix_micros("finished_at") / 1e6 - F.unix_micros("submitted_at") / 1e6
    n, ok = F.count(F.lit(1)), F.count("finished_at")
    return table(spark, d, "batch_jobs").groupBy("kind").agg(n.alias("total"), ok.alias("successful"), (n - ok).alias("unfinished"), (F.lit(100.0) * ok / n).alias("success_rate"), F.avg(sec).alias("mean_seconds"), F.sum(F.size("inputs")).alias("inputs"))


@query("batch_outputs", "SELECT kind, list_sort(list_distinct(flatten(list(inputs)))) AS slugs FROM batch_jobs GROUP BY kind")
def batch_outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_jobs").select("kind", F.explode("inputs").alias("s")).groupBy("kind").agg(F.array_sort(F.collect_set("s")).alias("slugs"))


@query("batch_errors", "SELECT job_id, kind || ': not finished' AS message FROM batch_jobs WHERE finished_at IS NULL")
def batch_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_jobs").where("finished_at is null").select("job_id", F.concat("kind", F.lit(": not finished")).alias("message"))


@query("job_complexity", "SELECT job_id, CASE kind WHEN 'merge' THEN 3 WHEN 'split' THEN 2 WHEN 'rotate' THEN 1 WHEN 'extract_text' THEN 4 WHEN 'rag_chunks' THEN 5 ELSE 1 END * len(inputs) AS weight FROM batch_jobs")
def job_complexity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kind")
    w = F.when(k == "merge", 3).when(k == "split", 2).when(k == "rotate", 1).when(k == "extract_text", 4).when(k == "rag_chunks", 5).otherwise(1)
    return table(spark, d, "batch_jobs").select("job_id", (w * F.size("inputs")).alias("weight"))


@query("job_documents", """
WITH j AS (SELECT job_id, unnest(inputs) AS slug FROM batch_jobs) SELECT j.job_id, j.slug, m.document_name FROM j JOIN corpus_manifest m USING (slug)""")
def job_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_jobs").select("job_id", F.explode("inputs").alias("slug")).join(table(spark, d, "corpus_manifest").select("slug", "document_name"), "slug")


@query("unreferenced_documents", "SELECT slug FROM corpus_manifest m WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(inputs) AS slug FROM batch_jobs) j WHERE j.slug = m.slug)")
def unreferenced_documents(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "batch_jobs").select(F.explode("inputs").alias("slug"))
    return table(spark, d, "corpus_manifest").select("slug").join(used, "slug", "left_anti")


@query("manifest_stats", "SELECT tier, country, count(*) AS n FROM corpus_manifest GROUP BY GROUPING SETS ((tier), (country), (tier, country), ())")
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_manifest").groupingSets([["tier"], ["country"], ["tier", "country"], []], "tier", "country").agg(F.count("*").alias("n"))


@query("manifest_by_section", "SELECT slug FROM corpus_manifest WHERE starts_with(slug, 'man-') AND tier = 't1'")
def manifest_by_section(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_manifest").where(F.col("slug").startswith("man-") & (F.col("tier") == "t1")).select("slug")


@query("compliance_stats", """
SELECT metadata.document_name AS doc, count_if(lvl = 0) AS l0, count_if(lvl = 1) AS l1, count_if(lvl = 2) AS l2, count_if(lvl = 3) AS l3, avg(lvl * 100.0 / 3) AS mean_percent
FROM (SELECT *, (CASE WHEN metadata.language IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN metadata.source_url IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN metadata.token_estimate IS NOT NULL THEN 1 ELSE 0 END) AS lvl FROM rag_chunks_sample) GROUP BY 1""")
def compliance_stats(spark: SparkSession, d: str) -> DataFrame:
    m = [F.col(f"metadata.{c}").isNotNull().cast("int") for c in ("language", "source_url", "token_estimate")]
    lvl = m[0] + m[1] + m[2]
    return table(spark, d, "rag_chunks_sample").select(F.col("metadata.document_name").alias("doc"), lvl.alias("lvl")).groupBy("doc").agg(*[F.count_if(F.col("lvl") == i).alias(f"l{i}") for i in range(4)], F.avg(F.col("lvl") * 100.0 / 3).alias("mean_percent"))


@query("similarity_score", """
SELECT doc_id, greatest(0.0, 1 - sum(CASE elem_type WHEN 'title' THEN 0.3 WHEN 'table' THEN 0.1 WHEN 'list_item' THEN 0.05 ELSE 0.01 END)) AS score FROM elements WHERE confidence < 0.95 GROUP BY doc_id""")
def similarity_score(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("elem_type")
    penalty = F.when(t == "title", 0.3).when(t == "table", 0.1).when(t == "list_item", 0.05).otherwise(0.01)
    return table(spark, d, "elements").where("confidence < 0.95").groupBy("doc_id").agg(F.greatest(F.lit(0.0), 1 - F.sum(penalty)).alias("score"))


@query("document_diff", """
WITH a AS (SELECT elem_type, count(*) AS n FROM elements WHERE page_idx % 2 = 0 GROUP BY 1), b AS (SELECT elem_type, count(*) AS n FROM elements WHERE page_idx % 2 = 1 GROUP BY 1)
SELECT coalesce(a.elem_type, b.elem_type) AS elem_type, a.n AS left_n, b.n AS right_n, CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS difference FROM a FULL JOIN b ON a.elem_type = b.elem_type""")
def document_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements")
    a = e.where("page_idx % 2 = 0").groupBy("elem_type").agg(F.count("*").alias("left_n"))
    b = e.where("page_idx % 2 = 1").groupBy("elem_type").agg(F.count("*").alias("right_n"))
    x, y = F.col("left_n"), F.col("right_n")
    return a.join(b, "elem_type", "full").withColumn("difference", F.when(x.isNull(), "extra").when(y.isNull(), "missing").when(x == y, "same").otherwise("changed"))


@query("calculated_fields", """
SELECT l_orderkey, l_linenumber, net, net * (1 + l_tax) AS gross, CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE net / l_discount END AS ratio, CASE WHEN l_linenumber - 1 = 0 THEN 0.0 ELSE l_quantity % (l_linenumber - 1) END AS rest, pow(l_linenumber, 2) + 1 AS sq
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)""")
def calculated_fields(spark: SparkSession, d: str) -> DataFrame:
    formulas = {"gross": "net * (1 + l_tax)", "ratio": "net / l_discount", "rest": "l_quantity % (l_linenumber - 1)", "net": "l_extendedprice * (1 - l_discount)", "sq": "l_linenumber ^ 2 + 1"}
    return K.recalculate(table(spark, d, "lineitem"), formulas).select("l_orderkey", "l_linenumber", "net", "gross", "ratio", "rest", "sq")


_PHONE = "lpad(CAST((CAST(c_custkey AS BIGINT) * 7919 + 2000000000) AS VARCHAR), 10, '2')"


@query("masks", rf"""
SELECT c_custkey, regexp_replace({_PHONE}, '^(\d{{3}})(\d{{3}})(\d{{4}})$', '(\1) \2-\3') AS phone, regexp_replace(substr({_PHONE}, 1, 9), '^(\d{{3}})(\d{{2}})(\d{{4}})$', '\1-\2-\3') AS ssn,
 substr({_PHONE}, 1, 5) || '-' || substr({_PHONE}, 6, 4) AS zip, substr({_PHONE}, 1, 4) || ' ' || substr({_PHONE}, 5, 4) || ' ' || substr({_PHONE}, 9, 2) AS card,
 CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.2f', c_acctbal) END AS shown FROM customer""")
def masks(spark: SparkSession, d: str) -> DataFrame:
    p = F.lpad((F.col("c_custkey").cast("long") * 7919 + F.lit(2000000000)).cast("string"), 10, "2")
    return table(spark, d, "customer").select("c_custkey", K.phone_mask(p).alias("phone"), K.ssn_mask(F.substring(p, 1, 9)).alias("ssn"), K.zip_mask(F.substring(p, 1, 9)).alias("zip"), K.card_mask(p).alias("card"), K.value_text(F.col("c_acctbal")).alias("shown"))


@query("validate_fields", r"""
SELECT slug, list_filter([CASE WHEN publisher IS NULL OR publisher = '' THEN 'required' END, CASE WHEN NOT coalesce(regexp_matches(source_url, '^https?://[^\s/$.?#][^\s]*$'), false) THEN 'url' END,
 CASE WHEN NOT coalesce(length(country) BETWEEN 2 AND 2, false) THEN 'length' END, CASE WHEN NOT coalesce(regexp_matches(language, '^[a-z]{2}$'), false) THEN 'pattern' END, CASE WHEN NOT coalesce(tier IN ('t1', 't2'), false) THEN 'range' END], lambda x: x IS NOT NULL) AS errors FROM corpus_manifest""")
def validate_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    checks = {"required": K.RULES["required"](c("publisher")), "url": K.RULES["url"](c("source_url")), "length": F.length("country").between(2, 2), "pattern": c("language").rlike("^[a-z]{2}$"), "range": c("tier").isin("t1", "t2")}
    return table(spark, d, "corpus_manifest").select("slug", K.errors(checks).alias("errors"))


@query("credit_card_check", """
WITH n AS (SELECT o_orderkey, CAST(4000000000000000 + CAST(o_orderkey AS BIGINT) * 7919 AS VARCHAR) AS card FROM orders)
SELECT o_orderkey FROM n WHERE list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(substr(card, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(card, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(card, i, 1) AS INTEGER) END ELSE CAST(substr(card, i, 1) AS INTEGER) END)) % 10 = 0""")
def credit_card_check(spark: SparkSession, d: str) -> DataFrame:
    card = (F.lit(4000000000000000).cast("long") + F.col("o_orderkey").cast("long") * 7919).cast("string")
    return table(spark, d, "orders").where(K.card_valid(card)).select("o_orderkey")


@query("pie_shares", """
WITH s AS (SELECT l_returnflag AS label, sum(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT label, 100 * v / sum(v) OVER () AS percent, coalesce(sum(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 360 / sum(v) OVER () AS start_angle FROM s""")
def pie_shares(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.sum("l_quantity").alias("v"))
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # one row a flag
    return s.select("label", (F.col("v") * 100 / F.sum("v").over(every)).alias("percent"), (F.coalesce(F.sum("v").over(before), F.lit(0.0)) * 360 / F.sum("v").over(every)).alias("start_angle"))


@query("chart_ranges", "SELECT least(min(c_acctbal), 0) - 0.1 * (greatest(max(c_acctbal), 0) - least(min(c_acctbal), 0)) AS low, greatest(max(c_acctbal), 0) + 0.1 * (greatest(max(c_acctbal), 0) - least(min(c_acctbal), 0)) AS high, min(c_acctbal) AS line_min, max(c_acctbal) AS line_max, sum(c_acctbal) AS total FROM customer")
def chart_ranges(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.least(F.min("c_acctbal"), F.lit(0.0)), F.greatest(F.max("c_acctbal"), F.lit(0.0))
    return table(spark, d, "customer").agg((lo - 0.1 * (hi - lo)).alias("low"), (hi + 0.1 * (hi - lo)).alias("high"), F.min("c_acctbal").alias("line_min"), F.max("c_acctbal").alias("line_max"), F.sum("c_acctbal").alias("total"))


@query("kpi_trend", """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT period, v, (v - lag(v) OVER w) * 100 / lag(v) OVER w AS change, CASE WHEN v > lag(v) OVER w THEN 'up' WHEN v < lag(v) OVER w THEN 'down' ELSE 'flat' END AS direction FROM m WINDOW w AS (ORDER BY period)""")
def kpi_trend(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    before = F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("period"))  # one row a month
    return m.select("period", "v", ((F.col("v") - before) * 100 / before).alias("change"), F.when(F.col("v") > before, "up").when(F.col("v") < before, "down").otherwise("flat").alias("direction"))


@query("dedupe_ratio", "SELECT 1 - count(DISTINCT sha256(text)) / count(*) AS ratio, count(*) AS n FROM rag_chunks_sample")
def dedupe_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").agg((1 - F.count_distinct(F.sha2("text", 256)) / F.count("*")).alias("ratio"), F.count("*").alias("n"))


@query("dedupe_resources", "SELECT arg_min(row_id, row_id) AS row_id, sha256(text) AS hash FROM rag_chunks_sample GROUP BY sha256(text)")
def dedupe_resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("row_id").alias("row_id"))


_PAGES = "(SELECT doc_id AS slug, page_idx, max(page_idx) OVER (PARTITION BY doc_id) AS last FROM (SELECT DISTINCT doc_id, page_idx FROM fragments))"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(slug, page_idx, last): the pages there are, and the last one of each document."""
    f = table(spark, d, "fragments").select(F.col("doc_id").alias("slug"), "page_idx").distinct()
    return f.join(f.groupBy("slug").agg(F.max("page_idx").alias("last")), "slug")


@query("merge_pages", f"SELECT slug, page_idx, row_number() OVER (ORDER BY slug, page_idx) - 1 AS new_idx FROM {_PAGES}")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents one after another: each takes the place after the pages of those before it, by a prefix sum over documents, not over pages."""
    p = _pages(spark, d)
    sizes = p.groupBy("slug").agg(F.count("*").alias("n"))
    base = sizes.select("slug", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slug").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("slug").orderBy("page_idx")) - 1
    return p.withColumn("_own", own).join(base, "slug").select("slug", "page_idx", (F.col("base") + F.col("_own")).alias("new_idx"))


@query("split_pages", f"SELECT slug, page_idx, page_idx // 6 AS part, page_idx % 6 AS new_idx FROM {_PAGES}")
def split_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("slug", "page_idx", F.floor(F.col("page_idx") / 6).alias("part"), (F.col("page_idx") % 6).alias("new_idx"))


def rotated(rotation: Column, by: Column) -> Column:
    """A rotation turned further; multiples of 90 between 0 and 270."""
    return F.pmod(rotation + by, F.lit(360))


@query("rotate_pages", f"SELECT slug, page_idx, (page_idx % 4 * 90 + CASE WHEN page_idx BETWEEN 2 AND 7 THEN 180 ELSE 0 END) % 360 AS rotation FROM {_PAGES}")
def rotate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a range turned by 180 degrees; a page's own rotation goes by its index."""
    p = F.col("page_idx")
    return _pages(spark, d).select("slug", "page_idx", rotated(p % 4 * 90, F.when(p.between(2, 7), 180).otherwise(0)).alias("rotation"))


@query("reorder_pages", f"SELECT p.slug, p.page_idx, o.pos AS new_idx FROM {_PAGES} p JOIN (SELECT unnest([4, 0, 2, 2]) AS page_idx, unnest([0, 1, 2, 3]) AS pos) o USING (page_idx)")
def reorder_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a list in its order; a page may come again, one that isn't there is left out."""
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (4, 0, 2, 2)))).alias("new_idx", "page_idx"))
    return _pages(spark, d).join(F.broadcast(wanted), "page_idx").select("slug", "page_idx", "new_idx")


@query("page_moves", f"SELECT slug, page_idx, last - page_idx AS reversed, CASE WHEN page_idx = 0 THEN last WHEN page_idx = last THEN 0 ELSE page_idx END AS swapped, CASE WHEN page_idx = 0 THEN least(2, last) WHEN page_idx <= 2 THEN page_idx - 1 ELSE page_idx END AS moved, page_idx % least(3, last + 1) AS overlay FROM {_PAGES}")
def page_moves(spark: SparkSession, d: str) -> DataFrame:
    """Where each page goes when a document is reversed, its ends are swapped, or its first page moves two on; and the page of a shorter document laid over it."""
    p, last = F.col("page_idx"), F.col("last")
    swapped = F.when(p == 0, last).when(p == last, 0).otherwise(p)
    moved = F.when(p == 0, F.least(F.lit(2), last)).when(p <= 2, p - 1).otherwise(p)
    return _pages(spark, d).select("slug", p, (last - p).alias("reversed"), swapped.alias("swapped"), moved.alias("moved"), F.pmod(p, F.least(F.lit(3), last + 1)).alias("overlay"))


@query("chunk_pages", "SELECT row_id, list_sort(list_distinct(list_transform(list_filter(metadata.page_numbers, lambda p: p > 0), lambda p: p - 1))) AS pages FROM rag_chunks_sample")
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = F.transform(F.filter("metadata.page_numbers", lambda p: p > 0), lambda p: p - 1)
    return table(spark, d, "rag_chunks_sample").select("row_id", F.array_sort(F.array_distinct(pages)).alias("pages"))


@query("windowed_events", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("session_events", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).drop("w")
