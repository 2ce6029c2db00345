import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import huffman
from cairn.llm.common import fresh_folder
from cairn.llm.tokens import Encoder, encoder

from .conftest import words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(9, 18))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip(ids, bits):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=301)
    lengths = huffman.code_lengths(counts, bits)
    assert lengths.max(initial=0) <= bits
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    data, offsets = huffman.pack(ids, huffman.canonical_codes(lengths), lengths)
    assert huffman.unpack(data, offsets, len(ids), lengths).tolist() == ids.tolist()


def test_lengths_are_optimal():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 200)
    heap = counts.tolist()
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        best += a
        heapq.heappush(heap, a)
    assert (huffman.code_lengths(counts, 18) * counts).sum() == best
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(1 << np.arange(40), 6).max() == 6


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_cached_words_give_the_same_ids(text):
    e = encoder(PATH)
    assert np.frombuffer(e.ids(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(["a", "Word", "don't", "9", "²", "\u00a0", "\x85", "\x1c", "\u3000", "—", "日本", "é", "«", "!", "'s", " ", "  ", "\n", "\t", "\u200b", "\ufeff", "I'Ll"]), max_size=14))
@settings(max_examples=600, deadline=None)
def test_cuts_at_spaces_change_nothing(parts):
    e = encoder(PATH)
    for text in (" ".join(parts), "".join(parts)):
        assert np.frombuffer(e.ids(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_small_caches_give_the_same_ids(monkeypatch, rng):
    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 7)
    e = Encoder(PATH)
    for _ in range(50):
        text = words(rng, 40)
        assert np.frombuffer(e.ids(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def same_in_groups(e, texts, end_id=7):
    ids, ends = e.all_ids(texts, end_id)
    assert len(ends) == len(texts) and ends[-1] == len(ids)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, end_id], text


PARTS = ["a", "Word", "don't", "9", "²", "\u00a0", "\x85", "\x1c", "日本", "’", "é", "«", "!", "'", "'s", "'re", "'ve", "'ll", "l", "e", "r", " ", "  ", "\n", "\t", "\u2003", "I'Ll", "<|endoftext|>", "\x00"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_texts_encoded_together_are_those_encoded_alone(texts):
    same_in_groups(encoder(PATH), texts)


def test_pairs_of_characters_encoded_together():
    same_in_groups(encoder(PATH), [f"a{chr(i)}{chr(j)} {chr(j)}9{chr(i)}'{chr(i)}{chr(j)}" for i in range(256) for j in range(0, 256, 17)])


def test_a_group_asks_the_library_once_for_its_new_words(monkeypatch, rng):
    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 7)
    e, calls = Encoder(PATH), []
    asked = e.words.find_all
    e.words.find_all = lambda words: calls.append(len(words)) or asked(words)
    for _ in range(5):
        same_in_groups(e, [f"{words(rng, 40).encode('latin-1', 'ignore').decode('latin-1')} x{rng.random()}y's" for _ in range(50)])
    assert len(calls) == 5 and min(calls) > 50


def test_groups_are_bounded_and_keep_the_order(monkeypatch, rng):
    import pyarrow as pa

    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "GROUP_CHARS", 300)
    monkeypatch.setattr(tokens, "GROUP_TEXTS", 5)
    texts = [words(rng, rng.choice([0, 1, 10, 200])) for _ in range(150)]
    e = Encoder(PATH)
    groups = list(e.encoded([pa.record_batch({"key": pa.array(range(a, a + 75)), "text": pa.array(texts[a : a + 75])}) for a in (0, 75)], 7))
    assert [k for keys, _, _ in groups for k in keys] == list(range(150))
    assert all(len(keys) == 1 or (len(keys) <= 5 and sum(len(texts[k]) for k in keys) <= 300) for keys, _, _ in groups)
    assert [i for _, ids, _ in groups for i in ids.tolist()] == [i for t in texts for i in [*e.tokenizer.encode(t, add_special_tokens=False).ids, 7]]
    assert list(e.encoded([], 7)) == []


def test_special_strings_and_latin_pairs():
    e = Encoder(PATH)
    texts = ["a<|endoftext|>b", "it's  they'll\u00a0x \x85y\r\n z", "9²³ ½¾ ªº µ×÷"] + [f"a{chr(i)}{chr(j)} {chr(j)}9{chr(i)}" for i in range(256) for j in range(0, 256, 17)]
    for t in texts:
        assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_files_give_the_ids_back(spark, docs, rng, monkeypatch):
    rows = [(i * 7 % 50, words(rng, rng.randrange(60))) for i in range(50)]
    rows += [(90, None), (91, ""), (92, "word " * 5000), (None, "no id"), (None, "nor here"), (7, rows[1][1]), (7, "other")]
    folder = fresh_folder(spark, "t")
    df = docs(rows, extra=True).repartition(5)
    got = huffman.read_ids(huffman.write_ids(df, folder, PATH), 3, folder).collect()
    tok = encoder(PATH).tokenizer
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got[len(known) :]] == [None, None]


def test_no_documents(spark, docs):
    folder = fresh_folder(spark, "t")
    assert huffman.read_ids(huffman.write_ids(docs([]), folder, PATH), 1, folder).count() == 0
