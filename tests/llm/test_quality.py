"""How much of self-made damage is undone, on the tables' own texts."""

import os
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from foliospark.llm import gate, mojibake, scans

FOLDER = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.01")


@pytest.fixture(scope="module")
def texts():
    return [t for t in pq.read_table(f"{FOLDER}/rag_chunks_sample.parquet", columns=["text"])["text"].to_pylist() if t]


CHAINS = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"),) * 2, (("utf-8", "cp1252"),) * 6, (("cp1252", "mac_roman"),), (("utf-8", "cp1251"),), (("cp1251", "koi8-r"),)]


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_wrong_decodings_are_undone(texts, chain):
    done = tried = 0
    for t in texts:
        cyrillic = "koi8-r" in chain[0]  # a lone sign says too little about that pair of charsets
        if t.isascii() or not gate.ordinary(t) or len(t) > 2000 or cyrillic and not mojibake._CYRILLIC.search(t):
            continue
        damaged = t
        try:
            for written, read in chain:
                damaged = damaged.encode(written).decode(read)
        except UnicodeError:
            continue
        if damaged == t:
            continue
        tried += 1
        done += mojibake.restore(damaged) == t
        if tried == 200:
            break
    assert tried >= 20 and done / tried > 0.85, (done, tried)


def test_misread_words_are_repaired(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        ws = scans._WORD.findall(t.lower())
        words.update(ws), pairs.update(f"{a} {b}" for a, b in zip(ws, ws[1:]))
    m = scans.ScanModel({w: n for w, n in words.items() if n >= scans.SEEN_WORD}, {p: n for p, n in pairs.items() if n >= scans.SEEN_PAIR}, sum(words.values()))
    rng = random.Random(7)
    repaired = damaged = changed = kept = 0
    for t in texts:
        if m.doubtful(t) or "-" in t or "¬" in t or len(t) > 1500 or not gate.ordinary(t):
            continue
        ws = t.split(" ")
        at = [i for i, w in enumerate(ws) if w.isalpha() and w.islower() and len(w) > 5 and words[w] >= 100]
        if len(ws) < 12 or not at:
            continue
        i = rng.choice(at)
        forms = [w for w, (_, used) in scans._readings(ws[i], turn=1).items() if len(used) == 1 and words[w] == 0]
        if not forms:
            continue
        bad = ws[:i] + [rng.choice(forms)] + ws[i + 1 :]
        got = scans.examine(" ".join(bad), m)[2].split(" ")
        damaged += 1
        repaired += got[i] == ws[i]
        changed += sum(a != b for k, (a, b) in enumerate(zip(got, ws)) if k != i)
        kept += len(ws) - 1
        if damaged == 300:
            break
    assert damaged >= 100 and repaired / damaged > 0.95 and changed / kept < 0.001, (repaired, damaged, changed, kept)
