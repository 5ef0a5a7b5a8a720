"""Scores of invoice values and extraction, against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import extract as X

SCORES = [
    ("invoice_date", "2025-01-20", 0.20), ("invoice_date", "2025-02-29", 0.10), ("invoice_date", "2024-02-29", 0.20), ("invoice_date", "2025-13-01", -0.50), ("invoice_date", "2025-01-32", -0.50),
    ("invoice_date", "25/03/2024", 0.20), ("invoice_date", "03/25/2024", 0.20), ("invoice_date", "20/01/25", 0.20), ("invoice_date", "99/99/9999", -0.50), ("invoice_date", "not-a-date", -0.50),
    ("invoice_date", "30/02/2024", 0.10), ("due_date", "1-1-2101", -0.50), ("invoice_date", "25.03.2024", -0.50), ("invoice_date", "31/12/199", -0.50),
    ("total_amount", "1,234.56", 0.20), ("total_amount", "1234", 0.10), ("total_amount", "1.234,56", 0.10), ("total_amount", "1.234.567,00", -0.50), ("total_amount", "€ 12.50", -0.50), ("total_amount", "-5.00", -0.30),
    ("total_amount", "0.00", -0.20), ("total_amount", "", -0.50), ("net_amount", "12.5", 0.10), ("tax_amount", "1-2", -0.50),
    ("invoice_number", "INV-2025-001", 0.10), ("invoice_number", "A_B", 0.10), ("invoice_number", "INV2025001", 0.08), ("invoice_number", "ABC", 0.08), ("invoice_number", "12345", 0.05), ("invoice_number", "1", -0.30), ("invoice_number", "12-34", 0.0),
    ("invoice_number", "Ñ/1", 0.10), ("vat_number", "", -0.20), ("vat_number", "GB123456789", 0.15), ("vat_number", "GB1234567890", 0.15), ("vat_number", "A12345678", 0.15), ("vat_number", "A12345678X", 0.15), ("vat_number", "IT12345678901", 0.15),
    ("vat_number", "DE123456789", 0.15), ("vat_number", "12345678901", 0.05), ("vat_number", "1234567", 0.0), ("vat_number", "ES12-34567890", 0.0), ("currency", "EUR", 0.0),
]


def test_scores(spark):
    df = spark.createDataFrame(SCORES, "field string, value string, want double").select("*", X.field_score(F.col("field"), F.col("value")).alias("got"))
    assert [(r.field, r.value, r.got) for r in df.collect() if abs(float(r.got) - r.want) > 1e-9] == []


def fields(spark, text, lang, threshold=0.7):
    df = spark.createDataFrame([(1, text, lang)], "doc_id bigint, text string, lang string")
    return {(r.field, r.value_str): (r.value_num, round(r.confidence, 6)) for r in X.invoice_fields(df, threshold=threshold).collect()}


def test_spanish_invoice(spark):
    got = fields(spark, "Factura Número 12\nSubtotal: 500,00\nIVA 21%: 105,00 €\nTotal: 605,00 €\nVencimiento: 01/02/2025\nCliente: Acme, S.L.", "es", 0.0)
    assert {(f, v): n for (f, v), (n, _) in got.items()} == {
        ("invoice_number", "12"): None, ("due_date", "01/02/2025"): None, ("total_amount", "605,00"): 605.0, ("tax_amount", "105,00"): 105.0, ("net_amount", "500,00"): 500.0,
        ("customer_name", "Acme, S.L."): None, ("currency", "€"): None,
    }


@pytest.mark.parametrize(("gap", "bonus"), [(0, 0.15), (30, 0.10), (80, 0.05), (200, 0.0)])
def test_nearness(spark, gap, bonus):
    df = spark.createDataFrame([("x" * gap + "Fecha", "1/2/2024")], "a string, v string").withColumn("t", F.concat("v", "a")).select(X.near_bonus(F.lit("invoice_date"), F.lower("t"), X.byte_place(F.col("v"), F.col("t"))).alias("b"))
    assert float(df.first().b) == bonus


def test_threshold_and_nulls(spark):
    assert fields(spark, "Rechnung Nr. R-1\nDatum: 01.02.2024", "DE") == {("invoice_number", "R-1"): (None, 1.0)}  # a dotted date scores too low
    assert fields(spark, None, "es") == {} and fields(spark, "", None) == {}
