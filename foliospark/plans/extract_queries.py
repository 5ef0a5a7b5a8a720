"""Invoice fields, pairs, contract facts, redaction, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from .registry import query, table

_INV = "(SELECT DISTINCT ON (doc_id, field) * FROM invoice_fields)"


def _inv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoice_fields").dropDuplicates(["doc_id", "field"])


@query("invoice_confidence", f"SELECT doc_id, coalesce(avg(confidence), 0.0) AS confidence, count(*) AS fields FROM {_INV} GROUP BY doc_id")
def invoice_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _inv(spark, d).groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count("*").alias("fields"))


@query("invoice_filter", f"SELECT doc_id, field, value_str FROM {_INV} WHERE confidence >= 0.7")
def invoice_filter(spark: SparkSession, d: str) -> DataFrame:
    return _inv(spark, d).where("confidence >= 0.7").select("doc_id", "field", "value_str")


_FIELDS = ("invoice_number", "invoice_date", "net_amount", "tax_amount", "total_amount", "vat_number")


@query("invoice_pivot", f"SELECT doc_id, {', '.join(f'max(CASE WHEN field = {chr(39)}{f}{chr(39)} THEN value_str END) AS {f}' for f in _FIELDS)} FROM {_INV} GROUP BY doc_id")
def invoice_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _inv(spark, d).groupBy("doc_id").pivot("field", list(_FIELDS)).agg(F.max("value_str"))


_COMMA = r"regexp_matches(value_str, ',[0-9]{2}$')"


@query("amount_parse", f"""
SELECT doc_id, field, TRY_CAST(CASE WHEN {_COMMA} THEN replace(replace(value_str, '.', ''), ',', '.') ELSE replace(value_str, ',', '') END AS DOUBLE) AS amount FROM {_INV} WHERE field LIKE '%_amount'""")
def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value_str")
    return _inv(spark, d).where(F.col("field").endswith("_amount")).select("doc_id", "field", X.amount_value(v, v.rlike(",[0-9]{2}$")).alias("amount"))


def _score_sql(field: str, v: str) -> str:
    """The scores of the values of a field, column v."""
    iso, dm, p = f"'^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})$'", f"'^([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{2,4}})$'", f"replace({v}, ',', '')"
    part = lambda pat, i: f"TRY_CAST(regexp_extract({v}, {pat}, {i}) AS INT)"
    date = lambda y, m, d: (
        f"CASE WHEN NOT coalesce(({y}) BETWEEN 1900 AND 2100 AND ({m}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND 31, false) THEN -0.5 WHEN ({d}) > day(last_day(make_date({y}, {m}, 1))) THEN 0.1 ELSE 0.2 END"
    )
    year = f"({part(dm, 3)} + CASE WHEN {part(dm, 3)} < 100 THEN 2000 ELSE 0 END)"
    return rf"""CASE WHEN {field} IN ('invoice_date', 'due_date') THEN CASE WHEN regexp_matches({v}, {iso}) THEN {date(part(iso, 1), part(iso, 2), part(iso, 3))}
   WHEN {part(dm, 1)} BETWEEN 1 AND 31 AND {part(dm, 2)} BETWEEN 1 AND 12 THEN {date(year, part(dm, 2), part(dm, 1))} WHEN {part(dm, 1)} IS NOT NULL THEN {date(year, part(dm, 1), part(dm, 2))} ELSE -0.5 END
 WHEN {field} = 'invoice_number' THEN CASE WHEN strlen({v}) < 2 THEN -0.3 WHEN NOT regexp_matches({v}, '[\p{{L}}\p{{Nl}}]') THEN CASE WHEN regexp_full_match({v}, '[0-9]+') THEN 0.05 ELSE 0.0 END WHEN regexp_matches({v}, '[-/_]') THEN 0.1 ELSE 0.08 END
 WHEN {field} = 'vat_number' THEN CASE WHEN {v} = '' THEN -0.2 WHEN regexp_full_match({v}, 'GB[0-9]{{9,}}|\p{{L}}[0-9]{{8}}.*|IT[0-9]{{11}}|DE[0-9]{{9}}') THEN 0.15 WHEN regexp_full_match({v}, '[0-9]{{8,}}') THEN 0.05 ELSE 0.0 END
 WHEN {field} IN ('net_amount', 'tax_amount', 'total_amount') THEN CASE WHEN NOT regexp_full_match({p}, '-?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN -0.5 WHEN CAST({p} AS DOUBLE) < 0 THEN -0.3 WHEN CAST({p} AS DOUBLE) = 0 THEN -0.2 WHEN length(split_part({p}, '.', 2)) = 2 THEN 0.2 ELSE 0.1 END
 ELSE 0.0 END"""


@query("invoice_scores", f"SELECT doc_id, field, CAST({_score_sql('field', 'value_str')} AS DOUBLE) AS score FROM {_INV} WHERE value_str IS NOT NULL")
def invoice_scores(spark: SparkSession, d: str) -> DataFrame:
    return _inv(spark, d).where("value_str is not null").select("doc_id", "field", X.field_score(F.col("field"), F.col("value_str")).alias("score"))


# the pattern's own text, with the white space of the other engine
_HITS = ",".join(
    f"CASE WHEN l = '{la}' AND regexp_matches(text, '{q}') THEN {{'field': '{f}', 'value_str': regexp_extract(text, '{q}', 1), 'base': {base}}} END"
    for la, f, p, base in X.PATTERNS for q in [p.replace(r"[\s:]", r"[\s\x0b:]").replace(r"\s\.,", r"\s\x0b\.,").replace(r"\s+", r"[\s\x0b]+").replace(r"\s*", r"[\s\x0b]*")]
)
_FOUND = f"""
WITH h AS (SELECT doc_id, text, l, unnest(list_filter([{_HITS}], lambda x: x IS NOT NULL)) AS m FROM (SELECT doc_id, text, lower(substr(coalesce(lang, 'es'), 1, 2)) AS l FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, text, l, m.field AS field, m.value_str AS value_str, m.base AS base FROM h)"""


@query("invoice_extract", f"{_FOUND} SELECT doc_id, field, value_str FROM f")
def invoice_extract(spark: SparkSession, d: str) -> DataFrame:
    return X.invoice_fields(table(spark, d, "documents"), threshold=0.0).select("doc_id", "field", "value_str")


_AT = "CASE WHEN strpos({of}, {part}) > 0 THEN strlen(left({of}, strpos({of}, {part}) - 1)) END"
_NEAREST = " ".join(
    f"WHEN '{name}' THEN least({', '.join('coalesce(abs(' + _AT.format(of='lower(text)', part=repr(w)) + ' - ' + _AT.format(of='text', part='value_str') + '), 1000000000)' for w in words)})" for name, words in X.NEAR.items()
)


@query("invoice_extract_scored", f"""{_FOUND},
n AS (SELECT *, CASE field {_NEAREST} END AS far FROM f),
s AS (SELECT doc_id, field, value_str, l, least(greatest(CAST(base AS DOUBLE) + CAST({_score_sql('field', 'value_str')} AS DOUBLE) + CASE WHEN far <= 20 THEN 0.15 WHEN far <= 50 THEN 0.10 WHEN far <= 100 THEN 0.05 ELSE 0.0 END, 0.0), 1.0) AS confidence FROM n)
SELECT doc_id, field, value_str, confidence, CASE WHEN field LIKE '%_amount' THEN TRY_CAST(CASE WHEN l = 'en' THEN replace(value_str, ',', '') ELSE replace(replace(value_str, '.', ''), ',', '.') END AS DOUBLE) END AS value_num FROM s WHERE confidence >= 0.7""")
def invoice_extract_scored(spark: SparkSession, d: str) -> DataFrame:
    return X.invoice_fields(table(spark, d, "documents"))


@query("kv_colon", r"""
WITH s AS (SELECT row_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM rag_chunks_sample)
SELECT row_id, trim(regexp_extract(line, '^([^:]+):', 1), ' ') AS key, trim(regexp_extract(line, '^[^:]+:[\t\x0b\f ]*(.+)$', 1), ' ') AS value FROM s WHERE regexp_matches(line, '^[^:]+:[\t\x0b\f ]*[^\t\x0b\f ]')""")
def kv_colon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select("row_id", F.inline(X.colon_pairs(F.replace("text", F.lit("\r"), F.lit("")))))


@query("kv_tab", "WITH s AS (SELECT row_id, string_split(unnest(string_split(text, chr(10))), chr(9)) AS p FROM rag_chunks_sample) SELECT row_id, p[1] AS key, p[2] AS value FROM s WHERE len(p) = 2")
def kv_tab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select("row_id", F.inline(X.tab_pairs(F.col("text"))))


@query("kv_elements", "SELECT doc_id, elem_seq, kv_key, least(greatest(1 - strlen(kv_key) / 40.0 - 0.1 * greatest(len(string_split(kv_key, ' ')) - 2, 0), 0.5), 1.0) AS confidence FROM elements WHERE elem_type = 'key_value' AND kv_key IS NOT NULL")
def kv_elements(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.layout import kv_confidence

    return table(spark, d, "elements").where("elem_type = 'key_value' and kv_key is not null").select("doc_id", "elem_seq", "kv_key", kv_confidence(F.col("kv_key")).alias("confidence"))


@query("key_info", f"""
SELECT doc_id, list_concat(list_concat({', '.join(f"regexp_extract_all(text, '(?i){p}')" for p in X.DATES[:2])}), list_concat({', '.join(f"regexp_extract_all(text, '(?i){p}')" for p in X.DATES[2:])})) AS dates,
 regexp_extract_all(text, '{X.MONEY}') AS monetary_amounts, regexp_extract_all(text, '{X.ORGANIZATION}') AS organizations FROM documents WHERE text IS NOT NULL""")
def key_info(spark: SparkSession, d: str) -> DataFrame:
    dates, money, parties = X.key_info(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", dates.alias("dates"), money.alias("monetary_amounts"), parties.alias("organizations"))


@query("redaction", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{X.REDACTED['date']}', '[DATE]', 'g'), '{X.REDACTED['code']}', '[CODE]', 'g') AS redacted FROM documents WHERE text IS NOT NULL")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.redact(F.col("text"), X.REDACTED).alias("redacted"))


@query("redaction_report", f"SELECT metadata.document_name AS doc, list_sort(list_distinct(flatten(list(metadata.page_numbers)))) AS pages, count(*) AS n FROM rag_chunks_sample WHERE regexp_matches(text, '{X.REDACTED['code']}') GROUP BY 1")
def redaction_report(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "rag_chunks_sample").where(F.col("text").rlike(X.REDACTED["code"])).select(F.col("metadata.document_name").alias("doc"), "row_id", F.col("metadata.page_numbers").alias("p"))
    return hit.select("doc", "row_id", F.explode_outer("p").alias("page")).groupBy("doc").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count_distinct("row_id").alias("n"))


@query("pages_by_entity", "SELECT metadata.document_name AS doc, p.unnest AS page, count(DISTINCT id) AS chunks FROM rag_chunks_sample, unnest(metadata.page_numbers) p GROUP BY ALL")
def pages_by_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks_sample").select(F.col("metadata.document_name").alias("doc"), "id", F.explode("metadata.page_numbers").alias("page")).groupBy("doc", "page").agg(F.count_distinct("id").alias("chunks"))


# Classes of schema.org for entity types.
SCHEMA_ORG = {"title": "CreativeWork", "paragraph": "Text", "table": "Table", "image": "ImageObject", "list_item": "ListItem", "key_value": "PropertyValue", "code_block": "SoftwareSourceCode"}


@query("schema_org", f"SELECT doc_id, elem_seq, CASE elem_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in SCHEMA_ORG.items())} ELSE 'Thing' END AS class FROM elements")
def schema_org(spark: SparkSession, d: str) -> DataFrame:
    classes = F.create_map(*[F.lit(x) for kv in SCHEMA_ORG.items() for x in kv])
    return table(spark, d, "elements").select("doc_id", "elem_seq", F.coalesce(classes[F.col("elem_type")], F.lit("Thing")).alias("class"))


@query("chunk_language_vote", """
WITH v AS (SELECT metadata.document_name AS doc, lower(substr(trim(metadata.language), 1, 2)) AS lang, sum(length(text)) AS w FROM rag_chunks_sample WHERE metadata.language IS NOT NULL GROUP BY ALL)
SELECT DISTINCT ON (doc) doc, lang FROM v ORDER BY doc, w DESC, lang""")
def chunk_language_vote(spark: SparkSession, d: str) -> DataFrame:
    """Vote weighted by characters; ties to the smaller code."""
    v = table(spark, d, "rag_chunks_sample").where("metadata.language is not null").groupBy(F.col("metadata.document_name").alias("doc"), F.lower(F.substring(F.trim("metadata.language"), 1, 2)).alias("lang")).agg(F.sum(F.char_length("text")).alias("w"))
    return v.groupBy("doc").agg(F.max(F.struct("w")).alias("m"), F.collect_list(F.struct("w", "lang")).alias("all")).select("doc", F.array_min(F.transform(F.filter("all", lambda x: x["w"] == F.col("m.w")), lambda x: x["lang"])).alias("lang"))
