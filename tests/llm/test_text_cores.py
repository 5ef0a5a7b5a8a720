"""The parts of the text operators that need no cluster, against brute force and round trips."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import gate, lookalike_chars, mojibake, repeated_lines, scans, splitting, stuffing
from foliospark.llm.bpe import ByteBpe, encoder
from foliospark.llm.common import tokenizer_path
from foliospark.llm.languages import LanguageModel, passages
from foliospark.llm.token_budget import SPACE, DoubleArrayTrie, UnigramCounter

BPE = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder(BPE).ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_reference_and_round_trips(text):
    import public_tokenizers as P
    import tiktoken

    e = encoder(BPE)
    enc = getattr(test_bpe_equals_reference_and_round_trips, "enc", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    test_bpe_equals_reference_and_round_trips.enc = enc
    text = text.encode("utf-8", "ignore").decode()
    ids = e.encode(text)
    assert ids == enc.encode_ordinary(text)
    assert "".join(e.decode_stream(ids)) == text
    assert e.count(text) == len(ids)


def test_bpe_streams_long_pieces(reference):
    e, rnd = encoder(BPE), random.Random(1)
    for _ in range(20):
        s = "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(100, 1500)))
        b = s.encode()
        assert list(e.stream([b[i : i + 13] for i in range(0, len(b), 13)])) == reference.encode_ordinary(s)


def test_bpe_defined_results():
    e = encoder(BPE)
    assert e.encode(None) == e.encode("") == [] and e.count(None) == 0
    assert e.encode("<|endoftext|>") != [50256]
    tiny = ByteBpe({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257})
    assert tiny.merge(b"abcab") == [b"abc", b"ab"]


def _brute_unigram(word, vocab, unknown):
    best = {0: (0.0, 0)}
    s = SPACE + word
    for i in range(len(s)):
        if i not in best:
            continue
        for j in range(i + 1, len(s) + 1):
            score = vocab.get(s[i:j], unknown if j == i + 1 else None)
            if score is not None and (j not in best or best[i][0] + score > best[j][0] + 1e-12):
                best[j] = (best[i][0] + score, best[i][1] + 1)
    return best[len(s)][0]


def test_unigram_viterbi_against_library_and_brute_force():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rnd = random.Random(3)
    pieces = {SPACE: -6.0} | {c: -5.0 - rnd.random() for c in "abcdé"}
    while len(pieces) < 60:
        pieces["".join(rnd.choice(SPACE + "abcdé" if k == 0 else "abcdé") for k in range(rnd.randint(2, 5)))] = -3.0 - 4 * rnd.random()
    vocab = [("<unk>", -30.0), *pieces.items()]
    t = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=False))
    mine = UnigramCounter(list(pieces.items()), byte_fallback=False)
    for _ in range(300):
        w = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 14)))
        assert mine.segment(w) == len(t.encode(SPACE + w).tokens)
        assert math.isfinite(_brute_unigram(w, pieces, -40.0))


def test_double_array_trie_holds_every_piece():
    words = [w.encode() for w in ("a", "ab", "abc", "b", "é", "ée", "日本")]
    t = DoubleArrayTrie(words)
    for i, w in enumerate(words):
        s = 0
        for c in w:
            n = t.base[s] + c + 1
            assert t.check[n] == s
            s = n
        assert t.value[s] == i


def _brute_cuts(succ):
    at, out = 0, [0]
    while succ[at] != at:
        at = int(succ[at])
        out.append(at)
    return out


def test_pointer_doubling_equals_walking():
    import numpy as np

    rnd = random.Random(2)
    tables = [splitting.successors(np.array([rnd.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(rnd.randint(1, 400))], np.int8), rnd.randint(2, 60), rnd.randint(0, 1)) for _ in range(40)]
    assert [list(c) for c in splitting.greedy_cuts(tables)] == [_brute_cuts(t) for t in tables]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "x\n", "para\n\n", "a,"]), min_size=1, max_size=300), st.integers(2, 40), st.integers(0, 10))
def test_pieces_keep_limit_overlap_and_all_words(words, limit, overlap):
    text = " ".join(words)
    pieces = splitting.pieces_of([text], limit, overlap)[0]
    overlap = min(overlap, limit - 1)
    every = text.split()
    at = 0
    for i, (p, a, b) in enumerate(pieces):
        w = p.split()
        assert len(w) <= limit and a == at and b > a
        assert w == every[max(0, a - overlap) if i else 0 : b]
        at = b
    assert at == len(every)


CASES = ["La formación del público añade más años a la señal.", "Der Prüfungsausschuss kürzt die Übersicht der Maßnahmen.", "L’élève a reçu « la clé » à l’âge – voilà…", "Реестр гарантий хранилища документов", "Το βιβλίο διακομιστών “δοκιμή”"]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_utf8_read_as_another_charset_is_restored(text, charset):
    seen = "".join(bytes([b]).decode(charset) if _defined(b, charset) else chr(b) for b in text.encode())
    if seen != text:
        assert mojibake.garbled(seen)
        assert mojibake.restore(seen) == text


def _defined(b, charset):
    try:
        bytes([b]).decode(charset)
        return True
    except UnicodeDecodeError:
        return False


def test_double_encoding_partial_and_single_bytes():
    twice = "página".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.restore(f"la {twice} y la página") == "la página y la página"
    assert mojibake.restore("clŽs de la catŽgorie, d\x8ep\x99t") == "clés de la catégorie, dépôt"
    assert mojibake.restore("la p·gina del servicio p˙blico") == "la página del servicio público"
    assert mojibake.garbled("d�p�t")
    assert not mojibake.garbled(None) and not mojibake.garbled("")


@pytest.mark.parametrize("text", [*CASES, "SECÇÃO DE PUBLICAÇÃO, NÃO É", "«É» – „X“ ‘a’ 12 m² 10⁶ ½ № 4 000 €", "CONTRÔLES À L’ÂGE", "a · b · c ›"])
def test_ordinary_text_is_left_alone(text):
    assert not mojibake.garbled(text)
    assert gate.plain(text) == text


@pytest.mark.parametrize("odd, plain", [("ｆｕｌｌ", "full"), ("е​nd оf", "еnd of"), ("re\xadport\xa0a", "report a"), ("café", "café"), ("oﬃce", "office"), ("officе", "office"), ("Rеgіster", "Register"), ("𝐝𝐨𝐬𝐢𝐞𝐫", "dosier"), ("перечень aктивов", "перечень активов")])
def test_lookalikes_map_to_one_form(odd, plain):
    if odd.startswith("е​"):
        assert lookalike_chars.map_lookalikes(odd).endswith("nd of")
    else:
        assert lookalike_chars.map_lookalikes(odd) == plain
        assert lookalike_chars.map_lookalikes(plain) == plain


def test_gate_is_a_superset():
    for odd in ("ｆｕｌｌ", "re\xadport", "café", "oﬃce", "officе", "página".encode().decode("cp1252"), "d�p�t", "clŽs"):
        assert not gate.ordinary(odd)


def test_gate_searches_decide_as_sets_do():
    """Sets of characters, and patterns without what makes their search fast."""
    rng = random.Random(4)
    latin, cyrillic, greek, other = sorted(gate.PLAIN), sorted(gate.PLAIN_CYRILLIC), sorted(gate.PLAIN_GREEK), sorted(gate._LOOKALIKE) + list("·ÃÂ¬µ×‡‹¢ÿ√�\x80ı")
    seen = set()
    for _ in range(30_000):
        main, rest = rng.choice([latin, cyrillic, greek, list("aeAZ09 íìîâãñÓ–“ª«")]), rng.choice([latin, cyrillic, greek, other])
        t = "".join(rng.choice(main if rng.random() < 0.8 else rest) for _ in range(rng.randrange(1, 12))) + rng.choice("éжω")
        chars = set(t) - gate._LOOKALIKE
        kind = "latin" if chars <= gate.PLAIN else "other" if chars <= gate.PLAIN_CYRILLIC or chars <= gate.PLAIN_GREEK else "beyond"
        assert kind != "beyond" or gate.needs(t) == (True, True)
        near = any(re.search(f"[{c}]{around}", t) for c, around in gate._BRANCHES)
        assert near == bool(gate._PAIRS.search(t)) and bool(mojibake._ODD.search(t)) == bool(gate._ODD.search(t))
        if kind == "latin":
            encoding = bool(chars & gate._TRIGGERS) and near or "í" in t and bool(gate._ELISION.search(t)) or "ì" in t and bool(mojibake.LETTER_QUOTES.search(t))
            assert gate.needs(t) == (encoding, encoding or len(chars) < len(set(t)) or "`" in t)
        if kind == "other":
            mixed = bool(gate._MIXED.search(t))
            assert gate.needs(t) == (mixed or bool(mojibake._CYRILLIC_CAPS.search(t)), mixed or len(chars) < len(set(t)))
        seen.add((kind, *gate.needs(t)))
    assert {("other", False, False), ("other", False, True), ("other", True, True), ("latin", False, False), ("latin", False, True), ("latin", True, True), ("beyond", True, True)} <= seen


def test_line_keys():
    k = repeated_lines.line_key
    assert k("Document  reference E8H3EGZQ | version 7.1 | 15/02/2022") == k("DOCUMENT REFERENCE 5Z9 | VERSION 8 | 1.1.2020 .")
    assert k("p. 47") == k("— 45 —") == k("Seite 4 von 9") == k("") == k("***") == ""
    assert k("Archive Rules H9-1W 2011 – page 10 of 34") != ""


def test_language_mixture():
    rows = [("the board of the register approves the annual report and the summary of the cables", "en")] * 5 + [("la comisión de seguimiento aprueba el registro anual y el resumen de los cables", "es")] * 5
    m = LanguageModel(rows, ("en", "es"))
    both = "the board approves the annual report of the register and the summary " + "la comisión aprueba el registro anual de los cables y el resumen de seguimiento"
    n, table = m.words(both)
    assert [m.languages[k] for k, *_ in passages(table)] == ["en", "es"]
    assert m.best("el resumen de los cables") == "es" and m.best("") is None
    assert passages(m.words("")[1]) == []


def _scan_model():
    words = {"document": 900, "register": 800, "the": 5000, "of": 4000, "legal": 300, "legaladvice": 0, "administrative": 300, "approves": 200, "custodian": 200}
    return scans.ScanModel({k: v for k, v in words.items() if v}, {"the register": 500, "the document": 400, "legal administrative": 90})


def test_scan_noise_is_undone():
    m = _scan_model()
    assert scans.examine("the docu-\nment of the rcgister", m) == (1, 1, "the document of the register")
    assert scans.examine("the docu¬\n ment", m)[0] == 1
    assert scans.examine("legal-\nadministrative register REQ-\n18 [op.5r]", m)[:2] == (0, 0)
    assert scans.examine("", m) == (0, 0, "")
    assert scans.examine("la bita‘cora ‘a’ bc", m) == (0, 1, "la bitácora ‘a’ bc")  # a torn accent is the scanner's, not a look-alike
    assert scans.paragraphs("The docu\nment goes on\n— 45 —\nto the end of the line.\n\nNext", None).endswith("Next")


SPAM = ["best maps, buy leases, best maps, cheap seals, buy leases, best maps, cheap seals, best maps, buy leases, cheap seals, best maps", "\n".join(f"quality register {i} {i},50 €" for i in range(12)), "#map #lease #map #seal #map #lease #seal #map #seal #lease #map #seal #map"]
REAL = ["The report of the board.\nBest maps are drawn by the registry every year, as section 4 states.", "Index\n" + "\n".join(f"the {a} of the {b}, {i}, {i + 9}" for i, (a, b) in enumerate((x, y) for x in ("plan", "file", "key", "note") for y in ("office", "store", "network"))), None, "", "  \n "]


@pytest.mark.parametrize("text", SPAM)
def test_stuffed(text):
    assert stuffing.judge(text)["spam"]


@pytest.mark.parametrize("text", REAL)
def test_not_stuffed(text):
    assert not stuffing.judge(text)["spam"]
