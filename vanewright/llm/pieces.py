"""Byte-level BPE of whole texts, with reuse of pieces that always are encoded alike.

A byte-level vocabulary cuts a text by its pattern (contractions; a space before letters, digits or other marks; runs
of white space) and merges bytes within what the pattern cuts out. Some places are ends of such parts whatever stands
around them: before white space that follows an ASCII mark, letter or digit; before a space between a wide character
and an ASCII one; and between an ASCII letter and an ASCII mark after it. Texts are cut there into pieces, each distinct piece of a slice is
looked up in a worker's memory of bounded size or encoded by the library, and tokens are put together from pieces.

A text that holds the string of a special token is encoded whole, as is every text where the vocabulary has another
pattern or a normalizer.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import kernels as K
from .bpe import tokenizer

#: Bytes of pieces and tokens that a worker keeps, with what Python needs for each piece.
MEMORY_BYTES, ENTRY_BYTES = 128 << 20, 160
#: Pieces that the library encodes as one text, where each begins with white space and ends with an ASCII mark, letter or
#: digit: between such pieces parts end, whatever they are.
JOINED = 64
#: Bytes of text that are cut into pieces at a time (a longer text is taken alone).
SLICE_BYTES = 4 << 20

#: What a byte is: 1 white space, 2 letter, 3 digit, 4 other printable mark, 5 part of a wide character, 0 control.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 3
_KIND[65:91] = _KIND[97:123] = 2
_KIND[128:] = 5
_KINDS = _KIND.tobytes()


def piece_starts(buf: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each row's start, and at the ends of parts described above."""
    n = len(buf)
    at = np.zeros(n + 1, bool)
    if n > 1:
        kind = _KIND[buf]
        left, here = kind[:-1], kind[1:]
        printable = (left >= 2) & (left <= 4)
        at[1:n] = (printable & (here == 1)) | ((left == 2) & (here == 4))
        after = np.concatenate((kind[2:], [0]))
        at[1:n] |= (left == 5) & (buf[1:] == 32) & (after >= 2) & (after <= 4)
    at[where] = True
    return np.flatnonzero(at[:n])


def whole_only(made) -> bool:
    """Whether this vocabulary's pattern isn't the one that pieces rely on."""
    parts = json.loads(made.to_str())
    pre = parts.get("pre_tokenizer") or {}
    known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    strict = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in parts.get("added_tokens", ()))
    return not known or strict or parts.get("normalizer") is not None or parts.get("post_processor") is not None


class PieceEncoder:
    """Tokens of texts; what is kept of pieces starts anew when it is full."""

    def __init__(self, path: str, most_bytes: int = MEMORY_BYTES):
        self.made, self.most_bytes = tokenizer(path), most_bytes
        self.whole = whole_only(self.made)
        self.special = [t.content.encode() for t in self.made.get_added_tokens_decoder().values()]
        token = [self.made.id_to_token(i) for i in range(self.made.get_vocab_size())]
        self.token_bytes = np.array([len(x or "") for x in token], np.int64)  # a byte is a character of a token's name
        self.kept: dict[bytes, bytes] = {}
        self.bytes = 0

    def by_library(self, texts: list[bytes]) -> list[bytes]:
        """Tokens of each text as 32-bit integers."""
        ids = [x.ids for x in self.made.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def by_joining(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Tokens of distinct pieces, many encoded as one text; alone where their ends shouldn't be ends of tokens."""
        apart = [p for p in pieces if _KINDS[p[0]] == 1 and 2 <= _KINDS[p[-1]] <= 4]
        groups = [apart[i : i + JOINED] for i in range(0, len(apart), JOINED)]
        texts = [b"".join(g) for g in groups]
        found = {}
        for group, text, ids in zip(groups, texts, self.by_library(texts)):
            ends = np.cumsum(self.token_bytes[np.frombuffer(ids, "<u4")])
            want = list(itertools.accumulate(map(len, group)))
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all() and not any(s in text for s in self.special):
                to = (4 * at + 4).tolist()
                found.update(zip(group, (ids[a:b] for a, b in zip([0, *to], to))))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self.by_library(rest)))
        return found

    def tokens_of(self, pieces: list[bytes]) -> list[bytes]:
        new = [p for p in pieces if p not in self.kept]
        if new:
            if self.bytes > self.most_bytes:
                self.kept, self.bytes, new = {}, 0, pieces
            found = self.by_joining(new)
            self.kept.update(found)
            self.bytes += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        return [self.kept[p] for p in pieces]

    def encoded(self, buf: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a slice's rows end to end, and where each row's begin (one more entry than rows)."""
        data = buf.tobytes()
        if self.whole or any(s in data for s in self.special):
            rows = [data[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
            each = self.by_library(rows)
            return np.frombuffer(b"".join(each), "<u4"), np.concatenate(([0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)))
        starts = piece_starts(buf, where)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(where), np.int64)
        ends = np.concatenate((starts, [len(buf)]))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        each = self.tokens_of(coded.dictionary.to_pylist())
        length = np.array([len(x) // 4 for x in each], np.int64)
        begin = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(each), "<u4")
        which = coded.indices.to_numpy()
        n = length[which]
        total = np.concatenate(([0], np.cumsum(n)))
        return flat[K.ragged(begin[which], n)], total[np.searchsorted(starts, where)]


@lru_cache(2)
def encoder_of(path: str) -> PieceEncoder:
    """A worker's encoder, which outlives its tasks."""
    return PieceEncoder(path)
