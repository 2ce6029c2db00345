import zlib

import numpy as np
import pytest

from cairn.llm import packing
from cairn.llm.tokens import encoder

from .conftest import words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def check(rows, got):
    tok = encoder(PATH).tokenizer
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        assert sum(p.length for p in own) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            (whole,) = ids[i]
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(whole) and p.length > 0
                assert p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
                at += p.length
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_every_id_is_in_one_piece(spark, docs, rng):
    rows = [(i, words(rng, rng.choice([0, 1, 30, 200, 900]))) for i in range(60)] + [(100, None), (101, "w " * 9000), (None, "no id"), (5, "again five"), (5, "again five")]
    check(rows, packing.packed(docs(rows, extra=True).repartition(3), PATH).collect())


def test_neighbours_share_windows(spark, docs, rng):
    """Documents of two vocabularies: windows are mostly of one of them."""
    kinds = [" ".join(rng.choice([f"{w}{k}" for w in ("kiwi", "lemon", "mango", "olive", "peach")]) + rng.choice("abc") for _ in range(220)) for k in [0] * 40 + [7777] * 40]
    got = packing.packed(docs(list(enumerate(kinds))), PATH).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.sequence_id, []).append((r.doc_id < 40, r.length))
    pure = sum(max(sum(n for k, n in s if k == side) for side in (True, False)) for s in whole.values())
    assert pure / sum(n for s in whole.values() for _, n in s) > 0.9


def test_no_documents(docs):
    assert packing.packed(docs([]), PATH).count() == 0


def test_neighbours_are_those_of_bm25(rng):
    """Every term of the seed counts, and no number of neighbours is set but by the room."""
    ids = [np.array([rng.randrange(60) for _ in range(rng.choice([1, 5, 40]))], np.uint16) for _ in range(150)]
    holding = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=60)
    idf, mean = np.log(1 + (len(ids) - holding + 0.5) / (holding + 0.5)), 20.0

    def score(seed, doc):
        tf = np.bincount(ids[doc], minlength=60)
        part = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[doc]) / mean))
        return part[np.unique(ids[seed])].sum()

    shard = packing.Shard(ids, idf, mean)
    gone = set()
    for seed in range(0, 150, 7):
        want = sorted((k for k in range(150) if k != seed and k not in gone and score(seed, k) > 0), key=lambda k: (-score(seed, k), k))
        assert sorted(shard.neighbours(seed, 10**9)) == sorted(want)
        few = shard.neighbours(seed, 100)
        assert np.allclose([score(seed, k) for k in few], [score(seed, k) for k in want[: len(few)]], rtol=1e-5)
        assert sum(len(ids[k]) for k in few) >= 100 or len(few) == len(want)
        for k in want[:6]:
            gone.add(k)
            shard.left[k] = 0
            shard.used += 1


def test_short_documents_meet_their_like(spark, docs, rng):
    texts = [" ".join(f"{rng.choice(['kiwi', 'lemon', 'mango'])}{k}" for _ in range(20)) for k in [0] * 300 + [7777] * 300]
    rows = list(enumerate(texts))
    got = packing.packed(docs(rows), PATH).collect()
    check(rows, got)
    whole = {}
    for r in got:
        whole.setdefault(r.sequence_id, []).append((r.doc_id < 300, r.length))
    pure = sum(max(sum(n for k, n in s if k == side) for side in (True, False)) for s in whole.values())
    assert pure / sum(n for s in whole.values() for _, n in s) > 0.9


def test_cuts_ask_the_library_once_a_group_and_count_documents(spark, rng, monkeypatch):
    import pyarrow as pa
    import zstandard

    from cairn.llm.tokens import Encoder

    class Table:
        """Runs what is mapped over its batches here."""

        def select(self, *_):
            return self

        withColumn = select

        def mapInArrow(self, run, _):
            self.out = [row for batch in run(iter(self.batches)) for row in batch.to_pylist()]
            return self

    e, calls = Encoder(PATH), []
    asked = e.words.find_all
    e.words.find_all = lambda new: calls.append(len(new)) or asked(new)
    monkeypatch.setattr(packing, "encoder", lambda _: e)
    texts = [f"{rng.random()} {rng.random()}x again again " * (1 + 150 * (i % 3)) for i in range(40)]
    table = Table()
    table.batches = [pa.record_batch({"id": pa.array(range(a, a + 20)), "text": pa.array(texts[a : a + 20])}) for a in (0, 20)]
    out = packing.cut(table, PATH, 1, "id", "text").out
    assert len(calls) == 1 and calls[0] > 80
    ids = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [(r["id"], r["start"], r["length"], r["total"]) for r in out[:-1]] == [(k, s, min(2048, len(x) - s), len(x)) for k, x in enumerate(ids) for s in range(0, len(x), 2048)]
    holding = np.frombuffer(zstandard.ZstdDecompressor().decompress(out[-1]["counts"]), np.int64)
    assert holding.tolist() == sum(np.bincount(list(set(x)), minlength=len(holding)) for x in ids).tolist()
