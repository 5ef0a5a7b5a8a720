"""The text operators on DataFrames: small cases, defined results for odd input, and the queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm import encode_corpus, encoding_repair, languages, lookalikes, mixing, queries, repeated_lines, scans, splitting, stuffing, token_budget
from foliospark.llm.common import chunks

META = "struct<source_url:string,document_name:string,country:string,language:string,heading_context:string,token_estimate:bigint,is_oversized:boolean>"
SCHEMA = f"row_id bigint, id string, text string, ingested_at timestamp, metadata {META}"


def row(i, text, doc="D", lang="en", heading=None, estimate=None, country=" es ", ident=None):
    import datetime

    return (i, ident or f"c-{i}", text, datetime.datetime(2024, 1, 1 + i % 28), (None, doc, country, lang, heading, estimate, None))


def frame(spark, rows):
    """With columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("_t", "n", "key", "field", "value", "doc", "w", "ids", "lang"):
        df = df.withColumn(c, F.lit("clash"))
    return df


LONG = "word " * 30_000
ODD = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG), row(5, "a b"), row(5, "a b"), row(6, "x", doc=None, lang=None, country=None), (7, None, None, None, None)]

ROW_OPERATORS = {
    "wrong_estimates": token_budget.wrong_estimates, "budget": token_budget.budget, "oversized": splitting.oversized_rows, "split": splitting.split_oversized, "encoding": encoding_repair.repair_encoding,
    "lookalikes": lookalikes.unify, "lines": repeated_lines.repeated_lines, "clean": repeated_lines.remove_repeated_lines, "scans": scans.repair_scans, "scans_found": scans.damaged_rows, "languages": languages.wrong_or_mixed, "passages": languages.segments,
}


@pytest.mark.parametrize("name", ROW_OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    op = ROW_OPERATORS[name]
    op(frame(spark, ODD)).collect()
    assert op(frame(spark, [])).count() == 0


def test_wrong_estimates(spark):
    rows = [row(1, "a b", estimate=2), row(2, "a b c", estimate=3), row(3, "a b", estimate=3), row(4, "a", estimate=None), row(5, None, estimate=0), row(6, None, estimate=1), row(7, "a\u001cb", estimate=1)]
    assert sorted(r.row_id for r in token_budget.wrong_estimates(frame(spark, rows)).collect()) == [3, 4, 6]


def test_budget_counts_each_chunk_once(spark):
    rows = [row(1, "a b c", ident="x", estimate=3), row(2, "a b c", ident="x", estimate=3), row(3, "d", lang="en-GB", country="ES")]
    b = token_budget.budget(frame(spark, rows)).collect()
    assert len(b) == 1 and (b[0].chunks, b[0].deliveries, b[0].words, b[0].language, b[0].country) == (2, 3, 4, "en", "ES")


def test_split_all_words_once(spark):
    p = splitting.split_oversized(frame(spark, ODD)).where("row_id = 4").collect()
    assert max(r.n_words for r in p) <= 512 and len(p) == p[0].n_pieces
    assert sum(r.n_words for r in p) - 50 * (len(p) - 1) == 30_000


def test_encoding_fields(spark):
    bad = "La formación".encode().decode("cp1252")
    got = encoding_repair.repair_encoding(frame(spark, [row(1, bad, heading="ok"), row(2, "ok", heading=bad), row(3, "d�p�t"), row(4, "ok niño é")])).collect()
    assert sorted((r.row_id, r.field, r.restored) for r in got) == [(1, "text", "La formación"), (2, "heading_context", "La formación"), (3, "text", "d�p�t")]


def test_lookalikes_join_one_class(spark):
    rows = [row(1, "plain", heading="Der Signaturdienst"), row(2, "plain", heading="Der Sіgnaturdienst"), row(3, "plain", heading="Der Signatur­dienst"), row(4, "plain", heading="Der Signaturdienst"), row(5, "Cafe\u0301", heading=None)]
    got = {(r.row_id, r.field): r.canonical for r in lookalikes.unify(frame(spark, rows)).collect()}
    assert got == {(2, "heading_context"): "Der Signaturdienst", (3, "heading_context"): "Der Signaturdienst", (4, "heading_context"): "Der Signaturdienst", (5, "text"): "Café"}


def test_repeated_lines_brute_force(spark):
    rows = []
    for i in range(40):
        lines = [f"own sentence number {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} of this chunk tells something else"]
        if i % 2 == 0:
            lines.insert(0, f"Document reference X{i}Z | version {i}.1" if i % 4 else f"DOCUMENT REFERENCE Y{i} | VERSION 2 .")
        if i in (1, 3, 5, 7, 9):
            lines.append("a line seen in five chunks only, so not often enough")
        if i % 3 == 0:
            lines.append(f"— {i} —")
        if i == 11:
            lines.append("Document refcrence Q7 | version 9.9")
        rows.append(row(i, "\n".join(lines)))
    got = {(r.row_id, r.line_no) for r in repeated_lines.repeated_lines(frame(spark, rows)).collect()}
    assert got == {(i, 1) for i in range(0, 40, 2)} | {(11, 2)}
    clean = {r.row_id: r.text for r in repeated_lines.remove_repeated_lines(frame(spark, rows)).collect()}
    assert "eference" not in "".join(clean.values()) and len(clean) == 40 and clean[1] == rows[1][2]


def test_repeated_delivery_counts_once(spark):
    rows = [row(i, "the same line in one chunk\nrest", ident="same") for i in range(12)]
    assert repeated_lines.repeated_lines(frame(spark, rows)).count() == 0


def test_encode_defined_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = encode_corpus.encode_corpus(df)
    assert [list(r.ids) for r in got.orderBy("doc_id").collect()][:2] == [[], []]
    assert [r.text for r in encode_corpus.decode_corpus(got).orderBy("doc_id").collect()] == ["", "", "a b", "a b"]
    assert encode_corpus.encode_corpus(df.limit(0)).count() == 0


def test_mix_reaches_shares(spark):
    docs = [(i, "big", 5 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 5 + i % 5) for i in range(300)] + [(20_000, "none", 0), (20_001, None, 9)]
    records = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 3.0, 2), ("m", "small", 1.0, 3), ("m", "none", 1.0, 2), ("m", "absent", 5.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    chosen, report = mixing.mix(records, targets)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "none", "absent"} and r["absent"].actual_tokens == 0
    assert abs(r["big"].actual_share - 0.75) < 0.01 and abs(r["small"].actual_share - 0.25) < 0.01
    assert r["small"].most_repeats <= 3 and r["big"].most_repeats <= 2
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mix(records.limit(0), targets)[1].count() == 4


def test_stuffed_pages(spark):
    df = spark.createDataFrame([(1, "best maps, buy leases, best maps, cheap seals, buy leases, best maps, cheap seals, best maps, buy leases"), (2, None), (3, ""), (4, "A sentence about the registry, which keeps the files.")], "doc_id bigint, text string").withColumn("units", F.lit(1))
    assert [r.doc_id for r in stuffing.stuffed_pages(df).collect()] == [1]
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_language_accuracy_on_held_out_labels(spark, sf):
    """The label of nearly all rows of two passages' length is right; the model must agree with most of them."""
    c = chunks(spark, sf)
    s = languages.segments(c, None, {"label": token_budget.language_code(F.col("metadata.language"))}).where("label is not null and n_words >= 16")
    agree = s.agg(F.avg((F.col("passages")[0]["lang"] == F.col("label")).cast("int")).alias("a")).first().a
    assert agree > 0.85
