import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import calculate as K
from foliospark.operators import chunking as C
from foliospark.operators import layout as L


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def test_fixed_window_examples(spark):
    text = " ".join(f"word{i}" for i in range(25))
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None), ("b", "  ")], "doc_id string, text string")
    rows = C.fixed_windows(df, "doc_id", "text", 10, 2).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.start_token, r.n_tokens) for r in rows] == [("d", 0, 10), ("d", 8, 10), ("d", 16, 9)]


def test_window_respects_sentence_end(spark):
    text = "a b c d e f g h. i j k l m n o p"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    first = C.fixed_windows(df, "doc_id", "text", 10, 0).orderBy("chunk_index").first()
    assert (first.content, first.respected) == ("a b c d e f g h.", True)


@pytest.mark.parametrize("dirty, clean", [("a\0\x03sergeant\0\x03and", "a sergeant and"), ("word\0another", "word another"), ("a\r\nb", "a\nb"), ("a\rb", "ab"), ("a  \t b", "a \tb")])
def test_sanitize(spark, dirty, clean):
    assert one(spark, T.sanitize, dirty) == clean


@pytest.mark.parametrize("n, r, a", [(1, "I", "a"), (4, "IV", "d"), (26, "XXVI", "z"), (27, "XXVII", "aa"), (1994, "MCMXCIV", "bxr")])
def test_numerals(spark, n, r, a):
    assert one(spark, T.roman, n, "long") == r
    assert one(spark, T.letters, n, "long") == a


@pytest.mark.parametrize("spec, want", [("all", [0, 1, 2, 3, 4]), ("3", [2]), ("2-4", [1, 2, 3]), ("3,1,3", [2, 0, 2]), ("1-3,5", None), ("0", None), ("4-2", None), ("9", None)])
def test_page_range(spark, spec, want):
    assert one(spark, lambda c: T.page_range(c, F.lit(5)), spec) == want


def test_sentences(spark):
    assert one(spark, T.sentences, "One. Two a.b! Three?\nFour \n\n") == ["One.", "Two a.b!", "Three?", "Four"]
    assert one(spark, T.sentences_greedy, "a.b! c") == ["a.", "b! c"]


def test_packing(spark):
    assert one(spark, lambda c: C.pack_sentences(c, 4), "a b. c d. e f g h i. j") == ["a b. c d.", "e f g h i.", "j"]
    assert one(spark, lambda c: C.pack_sentences(c, 4), " ") == [" "]


def test_calculation(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    row = K.recalculate(df, {"c": "d + 1", "d": "a * (3 - b)", "e": "a / b", "f": "a % b"}).first()
    assert (row.c, row.d, row.e, row.f) == (7.0, 6.0, float("inf"), 0.0)
    with pytest.raises(ValueError):
        K.order({"x": "y", "y": "x"})
    for bad in ("-1", "1 +", "(1", "a b", "a.b()"):
        with pytest.raises(ValueError):
            K.parse(bad)
    assert K.depends_on({"x": "y + 1", "y": "z"}, "x", "z")


def test_xy_cut_two_columns():
    import pandas as pd

    boxes = pd.DataFrame({"x": [50, 300, 50, 300], "y": [700, 700, 680, 680], "width": [100] * 4, "height": [10] * 4})
    assert L.xy_cut(boxes) == [0, 2, 1, 3]
