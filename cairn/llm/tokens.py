"""Token ids of whole texts by the tokenizers library, with a cache of words, and their counts."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Letters, numbers and blanks among the characters below U+0100, as the byte-level pre-tokenizer's pattern has them.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\t-\r \x85\xa0"
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Byte-level BPE spells bytes that are not visible Latin-1 characters by characters from U+0100 on.
_HIDDEN = [b for b in range(256) if b <= 32 or 127 <= b <= 160 or b == 173]
_BYTE_LETTERS = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
#: What each character below U+0100 is to the pattern; the mark between texts is a kind of its own.
_BLANKS, _LETTERS, _NUMBERS, _OTHERS, _MARK = range(5)
_KINDS = bytes(next(k for k, of in enumerate((_BLANK, _LETTER, _NUMBER, "\0-\xff")) if re.match(f"[{of}]", chr(c))) for c in range(256))
#: Pieces that a worker keeps at most in each of two generations; of pre-tokens twice as many. About 170 bytes each.
CACHE_WORDS = 300_000
#: Longer words are encoded but not kept.
CACHE_CHARS = 64
#: Characters and texts that are encoded at once (but for a longer text).
GROUP_CHARS, GROUP_TEXTS = 1 << 21, 4096


def _latin(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def word_starts(raw: bytes, marks: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of Latin-1 texts begin, as the pattern splits each text; a mark at each of these places follows a text."""
    kind = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8)
    kind[marks] = _MARK
    data, first = np.frombuffer(raw, np.uint8), np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[marks] = True
    last = np.flatnonzero((kind[:-1] == _BLANKS) & first[1:] & (kind[1:] != _MARK))  # the last blank before another character
    first[last] = True
    first[last + 1] = data[last] != ord(" ")
    at = np.flatnonzero((data == ord("'")) & first & (kind != _MARK))
    at = at[kind[at + 1] == _LETTERS]
    one, two = data[at + 1], data[at + 2]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    long = long[kind[long + 2] == _LETTERS]
    first[short + 1] = first[long + 1] = False
    first[short + 2] = first[long + 3] = True
    return np.flatnonzero(first)


class _Kept(dict):
    """A cache of find_all(keys), in two generations: when the new one is full, the old one goes."""

    def __init__(self, find_all, times: int = 1):
        super().__init__()
        self.find_all, self.old, self.most = find_all, {}, times * CACHE_WORDS

    def _keep(self, key: str, value) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key: str):
        value = self.old.get(key, self)
        if value is self:
            (value,) = self.find_all([key])
        self._keep(key, value)
        return value

    def all(self, keys: list[str]) -> list:
        """The values of different keys, none of which is None; what isn't known is found at once."""
        values = list(map(self.get, keys))
        older = [k for k, value in enumerate(values) if value is None]
        for k in older:
            values[k] = self.old.get(keys[k])
        unknown = [k for k in older if values[k] is None]
        for k, value in zip(unknown, self.find_all([keys[k] for k in unknown]) if unknown else ()):
            values[k] = value
        for k in older:
            self._keep(keys[k], values[k])
        return values


class Encoder:
    """ids(text): the ids of Tokenizer.encode(text, add_special_tokens=False), as bytes of `dtype`; all_ids(): those of many texts.

    A byte-level BPE without normalizer encodes each pre-token on its own. all_ids() finds the pre-tokens of Latin-1 texts by their
    bytes' kinds, all texts at once, and looks each different one up; the library's model splits those not met before. Texts beyond
    Latin-1 are cut at spaces between two characters that are not blank, which no pre-token reaches over, and the library itself
    encodes pieces beyond Latin-1, and texts with special tokens or, beyond Latin-1, with blanks beside a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        pre, model = plan.get("pre_tokenizer") or {}, plan["model"]
        self.special = [t["content"] for t in plan.get("added_tokens", [])]
        self.by_word = not any(plan.get(k) for k in ("normalizer", "truncation", "padding")) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
        self.by_word = self.by_word and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and set(_BYTE_LETTERS) <= vocabulary.keys()
        self.words, self.pieces = _Kept(self._words, 2), _Kept(lambda pieces: list(map(self._piece, pieces)))
        self.spelt = Tokenizer(self.tokenizer.model)  # of pre-tokens that are spelt by byte letters, with spaces between them
        self.spelt.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = np.zeros(self.vocabulary, np.int64)
        self.letters[list(vocabulary.values())] = list(map(len, vocabulary))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens in Latin-1: the model's for all, told apart by the letters that each id stands for."""
        spelt = [codecs.charmap_decode(w.encode(), "strict", _BYTE_LETTERS)[0] for w in words]
        ids = np.array(self.spelt.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum(list(map(len, spelt)))) + 1
        raw, size = ids.tobytes(), self.dtype.itemsize
        ends = [0, *(ends * size).tolist()]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _cut(self, text: str) -> bytes:
        """The ids of a text without special tokens, not cut at spaces."""
        if not _latin(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece after a space; None: it begins or ends with what may be a blank, so that the space is no safe cut."""
        if piece.isalpha() and _latin(piece):
            return self._words([" " + piece])[0]
        if not piece or not all(c.isalnum() or "!" <= c <= "~" for c in (piece[0], piece[-1])):
            return None
        if not _latin(piece):
            return self._whole(" " + piece)
        first, *rest = _SPLIT.findall(" " + piece)
        if not rest:
            return self._words([first])[0]
        known = self.pieces[first[1:]]
        return b"".join([self.words[first] if known is None else known, *map(self.words.__getitem__, rest)])

    def ids(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        found = list(map(self.pieces.__getitem__, rest))
        if None in found or (rest and self.pieces[first] is None):
            return self._cut(text)
        return self._cut(first) + b"".join(found)

    def all_ids(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each text's, and where each text's end."""
        end = np.array([end_id], self.dtype).tobytes()
        plain = [t if self.by_word and _latin(t) and not any(s in t for s in self.special) else None for t in texts]
        raw = "\n".join([*(t or "" for t in plain), ""]).encode("latin-1")
        marks = np.cumsum([len(t or "") + 1 for t in plain]) - 1
        starts = word_starts(raw, marks)
        places = np.append(starts, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        _, places, once = found.dictionary.buffers()
        once = once.to_pybytes().decode("latin-1")
        places = np.frombuffer(places, np.int32)[: len(found.dictionary) + 1].tolist()
        values = self.words.all([once[a:b] for a, b in zip(places, places[1:])])
        at, words = np.searchsorted(starts, marks), found.indices.to_numpy().copy()
        words[at] = len(values)  # a mark stands for the end, and for all of a text that is not plain
        values.append(end)
        for k, t in enumerate(plain):
            if t is None:
                words[at[k]] = len(values)
                values.append(self.ids(texts[k]) + end)
        sizes = np.array(list(map(len, values))) // self.dtype.itemsize
        begins, sizes = (np.cumsum(sizes) - sizes)[words], sizes[words]
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(values), self.dtype)[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, ends[at]

    def encoded(self, batches, end_id: int):
        """For groups of rows (key, text): their keys, all_ids() of their texts."""
        keys, texts, held = [], [], 0
        for batch in batches:
            for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if texts and (held + len(text) > GROUP_CHARS or len(texts) >= GROUP_TEXTS):
                        yield keys, *self.all_ids(texts, end_id)
                        keys, texts, held = [], [], 0
                    keys.append(key)
                    texts.append(text)
                    held += len(text)
        if texts:
            yield keys, *self.all_ids(texts, end_id)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
