"""That rows take the way of the named method, and that the parts it rests on hold."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import languages, lookalikes, sieve
from foliospark.llm.bpe import ByteBpe, encoder, sufficient_lookahead
from foliospark.llm.common import tokenizer_path

from .test_text_operators import frame, row


def test_every_pretoken_goes_through_the_transducer(monkeypatch):
    e = ByteBpe(encoder(tokenizer_path("byte_bpe_50k.tiktoken")).ranks)
    streamed = []
    real = ByteBpe.stream
    monkeypatch.setattr(ByteBpe, "stream", lambda self, pieces: (streamed.append(1), real(self, pieces))[1])
    text = "one two one " + "x" * 300 + " two"
    e.encode(text)
    assert len(streamed) == len({*e.find(text)}) == 4  # 'one' and ' one' differ; repeats are remembered


def test_stable_tokens_do_not_depend_on_what_follows():
    e = encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    assert 128 < e.lookahead < 1000
    rng = random.Random(5)
    tokens = [t for t in e.ranks if t.isalpha()]
    for _ in range(30):
        whole = b"".join(rng.choice(tokens) for _ in range(400))
        want = [e.ranks[t] for t in e.merge(whole)]
        cuts = sorted(rng.sample(range(1, len(whole)), 20))
        assert list(e.stream(whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)]))) == want


def test_lookahead_of_a_small_merge_list():
    # 'ab' waits for 'bc', which waits for 'cd': three letters beyond the first
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"cd": 4, b"bc": 5, b"ab": 6}
    assert sufficient_lookahead(ranks) == 4
    e = ByteBpe(ranks)
    assert e.merge(b"abcd") == [b"ab", b"cd"] and e.merge(b"abc") == [b"a", b"bc"]


def test_heap_and_plain_merges_agree():
    e = encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    for _ in range(200):
        b = bytes(rng.choice(b"abcdefgh aeiou") for _ in range(rng.randint(2, 48)))
        assert e.merge(b) == e._merge_by_heap(b)


def test_proportions_of_every_text():
    m = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10))
    a, b, c = languages.proportions([m, np.zeros((0, 2)), m[:30]])
    assert abs(a[0] - 0.75) < 0.15 and abs(a.sum() - 1) < 1e-9 and list(b) == [0.5, 0.5] and c[0] > 0.95
    found = languages.passages(np.clip(m * 5, -7, 0), languages.proportions([np.clip(m * 5, -7, 0)])[0])
    assert [x[:3] for x in found] == [(0, 0, 30), (1, 30, 40)] and abs(sum(x[4] for x in found) - 1) < 1e-6


def test_a_class_holds_its_ordinary_spelling(spark):
    texts = ["The Register of plans", "The Register of plans", "The Rеgister of plans", "The Register of plans", "another text", "café rest", "café rest"]
    df = frame(spark, [row(i, t) for i, t in enumerate(texts)])
    got = {r.row_id: r.canonical for r in lookalikes.unify(df).where("field = 'text'").collect()}
    assert got == {2: texts[0], 3: texts[0], 5: "café rest"}
    members = lookalikes.class_members(df, lookalikes.spool(lookalikes.mapped_fields(df))).groupBy("class").agg(F.sum("n").alias("n"), F.max("ordinary").alias("o")).collect()
    assert sorted((r.n, r.o) for r in members) == [(2, True), (4, True)]


def test_the_filter_loses_nothing(spark):
    words = [f"w{i}" for i in range(5000)]
    s = sieve.sieve(spark.createDataFrame([(w,) for w in words] + [(None,)], "k string"))
    assert all(w in s for w in words) and sum(f"v{i}" in s for i in range(5000)) < 5
    hashes = np.array([hash((i, "x")) for i in range(5000)], np.int64)
    h = sieve.sieve(spark.createDataFrame([(int(x),) for x in hashes], "k long"))
    assert h.hits(hashes).all() and h.hits(hashes + 1).sum() < 5
    assert "x" not in sieve.sieve(spark.createDataFrame([], "k string"))
