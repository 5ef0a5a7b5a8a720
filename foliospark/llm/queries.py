"""The queries of this subpackage, by name: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode_corpus, encoding_repair, languages, lookalikes, mixing, repeated_lines, scans, splitting, stuffing, token_budget
from .common import WHITE, chunks, fields, table


def _languages(spark: SparkSession, d: str) -> dict[str, str]:
    return token_budget.language_names(table(spark, d, "lang_codes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.wrong_estimates(chunks(spark, d))


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(chunks(spark, d), _languages(spark, d))


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    """The part of p1_budget that SQL can count."""
    return p1_budget(spark, d).drop("bpe_tokens", "unigram_tokens")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(chunks(spark, d))


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(chunks(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_rows(chunks(spark, d))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(chunks(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repair_encoding(chunks(spark, d)).select("row_id", "field")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repair_encoding(chunks(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_or_mixed(chunks(spark, d), names=_languages(spark, d))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    found = languages.segments(chunks(spark, d), names=_languages(spark, d))
    return found.select("row_id", F.posexplode("passages").alias("passage_no", "p")).select("row_id", "passage_no", "p.*")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify(chunks(spark, d)).select("row_id", "field")


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null field in its consistent form."""
    c = chunks(spark, d)
    changed = lookalikes.unify(c).select("row_id", "field", "canonical").dropDuplicates(["row_id", "field"])
    return fields(c).join(changed, ["row_id", "field"], "left").select("row_id", "field", F.coalesce("canonical", "value").alias("value"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damaged_rows(chunks(spark, d))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_scans(chunks(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus.encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text back from its ids."""
    return encode_corpus.decode_corpus(p8_ids(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = encode_corpus.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mix(mixing.spool(sized), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_budget p1_words p2_found p2_cleaned p3_found p3_pieces p4_found p4_restored p5_found p5_passages p6_found p6_canonical p7_found p7_repaired p8_ids p8_decoded p9_mix p9_shares p10_found"
    return {n: globals()[n] for n in names.split()}


_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{WHITE}]+'), lambda w: w <> ''))".replace("\\t", "\\x09").replace("\\n", "\\x0a").replace("\\f", "\\x0c").replace("\\r", "\\x0d")
for _code in ("85", "a0", "1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    _WORDS = _WORDS.replace(f"\\x{_code}" if len(_code) == 2 else f"\\u{_code}", f"\\x{{{_code}}}")


# the last delivery of each chunk, with its words, and its label's language by any spelling of lang_codes
_BUDGET = f"""
WITH named AS (SELECT lang, unnest([lang, code_t, code_b, lower(name_en), lower(name_own)]) AS name FROM lang_codes),
     codes AS (SELECT DISTINCT lang, name FROM named),
     labels AS (SELECT DISTINCT metadata.language AS label, lower(trim(metadata.language, ' ')) AS low FROM rag_chunks_sample),
     known AS (SELECT label, coalesce(a.lang, b.lang) AS language FROM labels LEFT JOIN codes a ON a.name = low LEFT JOIN codes b ON b.name = regexp_extract(low, '^([a-z]{{2,3}})[-_]', 1)),
     counted AS (
       SELECT row_id, coalesce(id, chr(0) || row_id) AS id, ingested_at, metadata.document_name AS document_name, metadata.language AS label, nullif(upper(trim(metadata.country, ' ')), '') AS country,
              metadata.token_estimate AS token_estimate, {_WORDS} AS n FROM rag_chunks_sample),
     last AS (SELECT *, count(*) OVER (PARTITION BY id) AS times FROM counted QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1)
SELECT document_name, language, country, count(*) AS chunks, CAST(sum(times) AS BIGINT) AS deliveries, CAST(sum(n) AS BIGINT) AS words, CAST(sum(coalesce(token_estimate, 0)) AS BIGINT) AS stored_estimate,
       CAST(sum(CASE WHEN token_estimate IS DISTINCT FROM n THEN 1 ELSE 0 END) AS BIGINT) AS wrong_estimates
FROM last LEFT JOIN known ON last.label IS NOT DISTINCT FROM known.label GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT row_id FROM rag_chunks_sample WHERE metadata.token_estimate IS DISTINCT FROM {_WORDS}",
        "p1_words": _BUDGET,
        "p3_found": f"SELECT row_id FROM rag_chunks_sample WHERE {_WORDS} > 512",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
