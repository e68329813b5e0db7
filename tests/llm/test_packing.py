import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrystone.llm import packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, tokenizer, size, padding=0):
    """``docs``: (doc_id, text), ids unique.  Every id lies in exactly one piece and sequences are gapless and full."""
    want = {d: ids_of(tokenizer, t) for d, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(ids) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        assert [a for a, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1].tolist()
        assert sum(n for _, n in pieces) == len(want[d])
    for pieces in by_sequence.values():
        pieces.sort()
        assert [a for a, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
        used = sum(n for _, n in pieces)
        assert used <= size
        assert used & (used - 1) == 0


def test_pack_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given_rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(packing.pack(docs).collect(), given_rows, tokenizer, 1024)
    check(packing.pack(docs.repartition(3), size=64, shard=50).collect(), given_rows, tokenizer, 64)


def test_odd_rows(spark, tokenizer):
    texts = [None, "", " ", "a", "word " * 3000, "<|endoftext|> and <|endoftext|>", "x" * 5000, "é　日本 \n\n\t z", "a\x00b"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1, "e") for d, t in docs], "doc_id long, text string, shard int, rest string")
    check(packing.pack(df).collect(), docs, tokenizer, 1024)
    assert packing.pack(df.limit(0)).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "one two"), (None, "one two")], "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == 2 * len(ids_of(tokenizer, "one two"))


def test_long_texts_are_cut_between_words(monkeypatch, tokenizer):
    text = "It's  a   long\n\n text, isn't it? 12345   end  " * 40
    whole = packing.tokenised(text.encode(), None, 64)
    for stretch in (1, 7, 50):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        got = packing.tokenised(text.encode(), None, 64)
        assert (got[0], got[1].tolist(), got[2]) == (whole[0], whole[1].tolist(), whole[2])
    assert whole[0] == len(ids_of(tokenizer, text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sl ll\t\n  12é日.!<|endoftext|> 　"), max_size=40))
def test_words_are_tokenised_as_whole_texts(text):
    words = packing.words_of(None)
    assert np.frombuffer(words.ids(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "It's", "don't", "12é", "日本", ",", "x\ty", "<|endoftext|>", "w" * 70, "\x1c", "\u00a0z"]), max_size=12), st.lists(st.sampled_from([" ", "\n", " ", "  ", "\n ", ""]), min_size=13, max_size=13))
def test_texts_are_parted_where_words_begin(parts, between):
    text = between[-1] + "".join(p + b for p, b in zip(parts, between))
    words = packing.words_of(None)
    assert np.frombuffer(words.ids(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_texts_need_no_pattern(monkeypatch, tokenizer):
    words = packing.words_of(None)
    monkeypatch.setattr(words, "find", None)
    text = "It's a text, isn't it?\nTwo lines of it, 12345 words.\n" + "x" * 100
    assert np.frombuffer(words.ids(text), words.kind).tolist() == ids_of(tokenizer, text)[:-1]
    assert "x" * 100 not in words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31), max_size=60))
def test_assign(lengths):
    rooms = packing.capacities(sum(lengths), 32)
    assert sum(rooms) == sum(lengths)
    out = packing.assign(lengths, rooms)
    for i, n in enumerate(lengths):
        assert sorted(k for j, a, m, _, _ in out if j == i for k in range(a, a + m)) == list(range(n))
    for s, room in enumerate(rooms):
        assert sorted(k for _, _, m, t, o in out if t == s for k in range(o, o + m)) == list(range(room))


def test_costs_are_balanced():
    """Descending order and the cheapest sequence: no sequence gets all the long documents."""
    lengths = [900] * 40 + [100] * 40 + [24] * 40
    rooms = packing.capacities(sum(lengths), 1024)
    costs = np.zeros(len(rooms))
    for _, _, n, s, _ in packing.assign(lengths, rooms):
        costs[s] += n * (1 + n / packing.PIVOT)
    assert costs[np.array(rooms) == 1024].std() < 1e-9


def test_letters_are_known_without_their_marks(tokenizer, monkeypatch):
    """Plain words never go through the whole tokenizer, whatever marks follow them; all others do, and ids are the same."""
    asked, words = [], packing.Words(None)
    encode = words.encoded
    monkeypatch.setattr(words, "encoded", lambda word: asked.append(word) or encode(word))
    plain = "haen, haen. haen!? Éa éananoi; Straße ſatz ŉx"
    assert words.ids(plain) == np.array(tokenizer.encode(plain, add_special_tokens=False).ids, words.kind).tobytes()
    assert not any(w.strip(".,;:!?").isalpha() for w in asked)
    assert {"haen", "haen.", "éananoi"} <= set(words.spaced)
    for odd in ("it's 'sabc \"'s l'eau x's,y a.b ...a 12ab ab12, a1 ñ日 é ǅ ɐ ª", "don't\n'll we'LL _a,- a,,b", "a b, c　d"):
        assert words.ids(odd) == np.array(tokenizer.encode(odd, add_special_tokens=False).ids, words.kind).tobytes()


def test_a_tokenizer_that_does_more_is_asked_for_whole_words(tmp_path):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import normalizers

    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "lower.json"))
    words = packing.Words(str(tmp_path / "lower.json"))
    assert words.model is None
    assert words.ids("One TWO, three") == np.array(other.encode("One TWO, three", add_special_tokens=False).ids, words.kind).tobytes()
