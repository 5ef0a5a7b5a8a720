"""Pages that must reach the rules whatever their length."""

import itertools
import string

from foliospark.llm import stuffing


def words(n, letters=5, skip=0):
    return ["".join(x) for x in itertools.islice(itertools.product(string.ascii_lowercase[:12], repeat=letters), skip, skip + n)]


def flagged(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    return {r.doc_id for r in stuffing.stuffed_pages(df).collect()}


def test_long_pages_of_many_words_are_judged(spark):
    own = words(170)
    prose = "\n".join(" ".join(own[i % 170] for i in range(k, k + 10)).capitalize() + "." for k in range(0, 300, 10))
    keys = words(150, 4)
    listed = "\n".join(f"{keys[i % 150]} {keys[(i + 1) % 150]}" for i in range(350))
    topics, hosts = words(100, 3), words(500, 6)
    linked = "\n".join(f"{topics[i % 100]} https://{h}.example" for i, h in enumerate(hosts))
    pages = [f"{prose}\n{listed}", linked]
    assert all(stuffing.judge(p)["spam"] for p in pages)
    assert flagged(spark, pages) == {0, 1}


def test_links_without_words_count():
    hosts = "\n".join(f"scan-list{i}.example" for i in range(40))
    paths = "\n".join(f"https://a.example/{12345 + i}" for i in range(40))
    prose = " ".join(f"The {w} of the registry is kept in another drawer." for w in words(3))
    assert all(stuffing.judge(p)["spam"] for p in (hosts, paths, f"{prose}\n{hosts}"))
    few = "\n".join(hosts.split("\n")[:5])
    assert not stuffing.judge(few)["spam"]
    long = " ".join(f"The {a} board reads {b} in {c}." for a, b, c in zip(words(40), words(40, 6), words(40, 7)))
    assert not stuffing.judge(f"{long}\n{few}")["spam"]


def test_running_keywords_and_tags():
    keys = ["archive boxes", "paper shredder deals", "rent a copier", "label printer offer"]
    run = " ".join(keys[(i * i + i // 3) % 4] for i in range(60))
    wrapped = "\n".join(run[i : i + 70] for i in range(0, len(run), 70))
    tags = " ".join(f"#{a}{b}" for a, b in zip(words(20), words(20, 6)))
    assert all(stuffing.judge(p)["spam"] for p in (run, wrapped, tags))
    unmarked = " ".join(words(200, 5))  # no mark, but no repetition either
    assert not stuffing.judge(unmarked)["spam"]


def test_separators_are_counted_as_the_pattern_finds_them():
    for t in ("a, b/c |d - e – f·g;h*i»", "-a - b -c", ", – ; a", "", " - - "):
        assert stuffing._separators(t) == len(stuffing._INLINE.findall(t)), t
