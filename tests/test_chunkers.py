"""Chunkers that stream: folds by hand-worked cases, and a document's windows whatever the batches."""

import itertools

import pytest

from foliospark.operators import chunking as C


def folded(fold, rows):
    return [*itertools.chain.from_iterable(fold.push({"seq": i, "heading": None, "type": t, "text": x}) for i, (t, x) in enumerate(rows)), *fold.end()]


def texts(fold, rows):
    return [c["text"] for c in folded(fold, rows)]


def words(n, w="w"):
    return " ".join([w] * n)


def test_semantic_overlap_is_carried_and_forgotten():
    rows = [("paragraph", words(6, "a")), ("paragraph", words(6, "b")), ("paragraph", words(9, "c"))]
    # b is carried on in front of c, but no longer counts once c has opened the chunk
    assert texts(C.SemanticFold(12, 6), rows) == [f"{words(6, 'a')}\n{words(6, 'b')}", f"{words(6, 'b')}\n{words(9, 'c')}"]
    assert texts(C.SemanticFold(12, 0), rows) == [f"{words(6, 'a')}\n{words(6, 'b')}", words(9, "c")]


def test_semantic_overlap_counts_before_a_table():
    rows = [("paragraph", words(6, "a")), ("paragraph", words(6, "b")), ("table", words(5, "t")), ("table", words(2, "u"))]
    # after the flush six words are carried on and count: 6 + 5 = 11, then 13 > 12
    assert texts(C.SemanticFold(12, 6), rows) == [f"{words(6, 'a')}\n{words(6, 'b')}", f"{words(6, 'b')}\n{words(5, 't')}", f"{words(5, 't')}\n{words(2, 'u')}"]


def test_semantic_oversized():
    got = folded(C.SemanticFold(4, 0), [("table", words(9, "t")), ("title", "x")])
    assert [(c["oversized"], c["tokens"]) for c in got] == [(True, 9), (False, 1)]


def test_semantic_sentences():
    assert C.greedy_sentences("One. Two 3.5 end! rest") == ["One.", "Two 3.", "5 end! rest"]
    assert C.greedy_sentences("  no mark ") == ["no mark"] and C.greedy_sentences(" ") == []
    assert texts(C.SemanticFold(4, 0), [("paragraph", "a b c. d e. f g h i."), ("paragraph", "z")]) == ["a b c.", "d e.", "f g h i.", "z"]


def test_hybrid():
    assert texts(C.HybridFold(10), [("paragraph", words(4, "a")), ("list_item", words(4, "b")), ("title", "t"), ("paragraph", words(3, "c"))]) == [f"{words(4, 'a')}\n{words(4, 'b')}", "t", words(3, "c")]
    assert texts(C.HybridFold(4), [("paragraph", "a b c. d e f. g")]) == ["a b c.", "d e f. g"]
    assert folded(C.HybridFold(4), [("table", words(9))])[0]["oversized"]


def naive_windows(tokens, size, overlap):
    start, n = 0, len(tokens)
    while start < n:
        end, respected = min(start + size, n), False
        if end < n:
            marks = [i for i in range(max(end - C.LOOK_BACK, start + 2), end + 1) if tokens[i - 1].endswith((".", "!", "?"))]
            if marks:
                end, respected = marks[-1], True
        yield start, end, respected
        if end >= n:
            break
        start = end - overlap if end - overlap > start else end


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (2, 1), (12, 3), (30, 29), (128, 16)])
def test_windows(size, overlap):
    for n in (0, 1, 2, 29, 400):
        tokens = [f"w{i}." if i * i % 7 == 3 else f"w{i}" for i in range(n)]
        assert list(C.window_spans(tokens, size, overlap)) == list(naive_windows(tokens, size, overlap))


def test_one_very_long_text_and_odd_rows(spark):
    rows = [(1, words(200_000)), (2, None), (3, " \n "), (4, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = C.fixed_windows(df, "doc_id", "text", 100, 10).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: -(-(200_000 - 10) // 90), 4: 1}


def test_folds_on_frames(spark):
    rows = [(f"d{i % 3}", i // 3, "paragraph" if i % 4 else "title", f"w{i} x y z", None, None, None, None, None) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:9], "doc_id string, elem_seq int, elem_type string, text string, kv_key string, kv_value string, table_cells array<array<string>>, alt_text string, parent_heading string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for frame, fold in ((C.hybrid_chunks(df, 30), lambda: C.HybridFold(30)), (C.semantic_chunks(df, 30, 8), lambda: C.SemanticFold(30, 8))):
            got = {(r.doc_id, r.chunk_index): r.text for r in frame.collect()}
            want = {(f"d{d}", k): t for d in range(3) for k, t in enumerate(texts(fold(), [(r[2], r[3]) for r in rows if r[0] == f"d{d}"]))}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_another_counter():
    rows = [("paragraph", "abcdefgh"), ("paragraph", "ijkl"), ("paragraph", "mnopqrst")]
    assert texts(C.HybridFold(3, count=C.characters_over_four), rows) == ["abcdefgh\nijkl", "mnopqrst"]
    assert texts(C.SemanticFold(3, 0, count=C.characters_over_four), rows) == ["abcdefgh\nijkl", "mnopqrst"]
