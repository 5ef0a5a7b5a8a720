"""Queries that must cover every row, against brute force on small tables."""

import json
import re

from foliospark.operators import extract
from foliospark.plans import queries as core


TEXTS = ["plain", "La formación del público", "Реестр «гарантий»", "σελίδα\nδύο", 'quote " back \\ slash / tab\tend\r\n', "emoji 🙂   \x01", ""]


def documents(spark, folder, texts):
    rows = [(i, t, f"título {i}" if i % 2 else None, i + 1) for i, t in enumerate([*texts, None])]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, n_pages int").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_document_json_exports_every_text(spark, tmp_path):
    rows = documents(spark, tmp_path, TEXTS)
    got = {r.doc_id: json.loads(r.json) for r in core.queries()["document_json"](spark, str(tmp_path)).collect()}
    assert got == {i: {"type": "document", "content": t, "metadata": {"title": title or "", "page_count": n}} for i, t, title, n in rows if t is not None}


def test_contract_facts_reads_every_text(spark, tmp_path):
    texts = [*TEXTS, "Contract No: AB-12 of ABC Corp, signed 30 September 2016", "septembre 2016; September 30, 2016 é 2024-05-06", "$ 1,000.50 to XYZ LLC", "á1/2/2024 12-12-2024ñ", "agreement x\nпришёл 2024-01-02, $5M"]
    rows = documents(spark, tmp_path, texts)
    want = {}
    for i, t, *_ in rows:
        if t is not None:
            n, k = (sum(len(re.findall(f"(?i){p}", t)) for p in ps) for ps in (extract.DATES, extract.CONTRACT))
            want[i] = (n, k, round((0.9 * n + 0.8 * k) / (n + k), 9) if n + k else 0.0)
    got = {r.doc_id: (r.dates, r.facts, round(float(r.confidence), 9)) for r in core.queries()["contract_facts"](spark, str(tmp_path)).collect()}
    assert got == want and sum(x[0] for x in want.values()) == 4 and sum(x[1] for x in want.values()) == 6


def test_ranges_cover_the_whole_page(spark, tmp_path):
    texts = ["x" * n for n in (30, 450, 1, 700, 200, 90, 333)]
    spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], "doc_id bigint, page_idx int, seq int, text string").write.parquet(f"{tmp_path}/fragments.parquet")
    want, at = set(), 0
    for i, t in enumerate(texts):
        want |= {(p // 200, i) for p in range(at, at + len(t))}
        at += len(t) + 1
    got = [(r.chunk, r.seq) for r in core.queries()["range_to_fragments"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and max(want)[0] > 2


def test_line_break_auto_keeps_every_row(spark, tmp_path):
    texts = ["a\nb\nc", "One.\nx\n\ny\r\nz", "end\n\nnext\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string").write.parquet(f"{tmp_path}/rag_chunks_sample.parquet")
    got = {r.row_id: r.text for r in core.queries()["line_break_auto"](spark, str(tmp_path)).collect()}
    assert got == {0: "a b c", 1: "One.\nx\n\ny z", 2: "end\n\nnext\n", 3: "", 4: None}
