"""Files written, damaged and read back."""

import zlib

from pyspark.sql import functions as F

from foliospark.plans import file_queries as Q
from foliospark.plans import queries as core
from foliospark.sources import pdf, pdf_writer as W


def test_round_trip_of_odd_texts():
    texts = ["plain", "ñ «ж» Ω 漢", "a\tb\x01\n", "🙂 () <> \\ /", " "]
    pages = [W.Page([W.Text(t, 10 + i, 20.25, 9.5, "Noto Bold #1", i, "P") for i, t in enumerate(texts)]), W.Page()]
    for compress in (True, False):
        rows = pdf.parse(W.write(pages, compress=compress))
        assert [(r["text"], r["x"], r["y"], r["font_size"], r["mcid"], r["is_bold"]) for r in rows[:-1]] == [(t, 10.0 + i, 20.25, 9.5, i, True) for i, t in enumerate(texts)]
        assert rows[-1]["page_idx"] == 1 and rows[-1]["text"] is None


def test_parts_make_the_file():
    pages = [W.Page([W.Text("x", 1, 2)]) for _ in range(5)]
    assert b"".join(W.stream(iter(pages))) == W.write(pages)
    data = W.write(pages)
    start = int(data.split(b"startxref\n")[1].split()[0])
    table = data[start:].split(b"\n")[2:]
    assert all(data[int(row[:10]) :].startswith(b"%d 0 obj" % i) for i, row in enumerate(table) if row.endswith(b"n "))


def test_metadata_and_links():
    data = W.write([W.Page(links=[((1, 2, 3, 4), "https://é.example/ж")])], {"Title": "Título ж", "Author": "A (b)"})
    got = pdf.metadata(data)
    assert (got["title"], got["author"], got["pages"], got["valid"], got["encrypted"], got["version"], got["error"]) == ("Título ж", "A (b)", 1, True, False, "1.7", None)
    assert pdf.annotations(data) == [{"page_idx": 0, "kind": "Link", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "uri": "https://é.example/ж", "contents": None}]
    assert not pdf.metadata(b"nothing")["valid"] and pdf.annotations(b"nothing") == []


def test_decode_limit():
    doc = pdf.Document.parse(W.write([W.Page([W.Text("x" * 5000, 1, 2)])]))
    s = next(v for v in doc.objects.values() if isinstance(v, pdf.Stream))
    assert len(doc.decode(s)) > 5000
    try:
        doc.decode(s, 100)
        raise AssertionError("no limit")
    except ValueError:
        pass


def test_one_spoilt_page_leaves_the_others():
    data = W.write([W.Page([W.Text(f"page {i}", 1, 2)]) for i in range(3)])
    rows = pdf.parse(Q._spoil(data, 1))
    assert [(r["page_idx"], r["text"], bool(r["error"])) for r in rows] == [(0, "page 0", False), (1, None, True), (2, "page 2", False)]


def test_manifest_files(spark, sf):
    m = {r.slug: (zlib.crc32(r.slug.encode()) % 4, r.document_name, r.publisher, r.source_url) for r in spark.read.parquet(f"{sf}/corpus_manifest.parquet").collect()}
    got = {r.path: r for r in core.queries()["file_metadata"](spark, sf).collect()}
    assert set(got) == set(m)
    for slug, (turn, title, author, _) in m.items():
        r = got[slug]
        assert (r.valid, r.encrypted, r.failed) == {0: (True, False, False), 1: (False, False, False), 2: (False, True, True), 3: (False, False, True)}[turn]
        if turn == 0:
            assert (r.title, r.author, r.pages) == (title, author, 2)
    links = {(r.path, r.uri) for r in core.queries()["file_links"](spark, sf).collect()}
    assert links == {(s, u) for s, (turn, _, _, u) in m.items() if turn < 2}
    assert {r.turn for r in spark.createDataFrame([(s,) for s in m], "s string").select(F.pmod(F.crc32(F.encode("s", "UTF-8")), F.lit(4)).alias("turn")).distinct().collect()} <= {0, 1, 2, 3}
