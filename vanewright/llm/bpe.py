"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut into chunks where a rolling hash over its last words meets a condition, so that passages shared by
documents fall into the same chunks wherever they stand. A worker encodes each distinct chunk once, as a whole, and
keeps its tokens and decoded text in a memory of bounded size, by the chunk's bytes, over all slices and tasks that it
runs. Where the vocabulary never looks over ASCII white space, a new chunk is put together from its distinct words, which
a second memory keeps; else it is encoded as one text. Documents are put together from their chunks. At every join the
words that meet are encoded together: where that differs from what the two chunks give there, the chunks are merged,
encoded as one, and the joins of the merged chunk are looked at in turn, until all agree (at the latest when the text is
one chunk).

Chunks are cut at ASCII white space. Sharing is within a worker (bounded memory, nothing shuffled): sending tokens of
chunks between executors would move more bytes than the texts hold.

Defined results: a null or empty text, or one of white space alone, has no tokens and decodes to an empty string; rows
that repeat, and rows of one id or of a null id, are each encoded; there are no ties; an empty table gives an empty
result; other columns are ignored. A text of one very long word is one chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .tables import text_of

#: Words of a chunk on average (a power of two), words that the rolling hash looks at, and bytes kept in memory (each
#: chunk's text, tokens and decoded text; as many again for joins and words, by number).
CHUNK_WORDS, HASH_WORDS, MEMORY_BYTES, MEMORY_JOINS = 64, 4, 96 << 20, 400_000
#: Bytes of words and their tokens that a worker keeps, with what Python needs for each word.
WORD_BYTES, ENTRY_BYTES = 80 << 20, 160
VOCABULARY = "word_bpe_49k.json"
#: The pattern of vocabularies whose parts hold no white space.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _MARK = np.zeros((2, 256), bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def words_apart(made) -> bool:
    """Whether words between ASCII white space are encoded alike whatever stands around them: parts of text hold no
    white space, the normalizer changes single characters (or composes them, never with white space), and tokens are
    decoded with a space between them."""
    parts = json.loads(made.to_str())
    steps = (parts.get("normalizer") or {}).get("normalizers", [])
    known = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for n in steps)
    split = {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    known = known and parts.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [split, level]}
    known = known and parts["model"].get("type") == "BPE" and parts["model"].get("dropout") is None and parts.get("decoder") is None and parts.get("post_processor") is None
    if not known or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in parts.get("added_tokens", ())):
        return False
    ids = lambda text: made.encode(text, add_special_tokens=False).ids
    every = range(made.get_vocab_size())
    if made.decode(list(every), skip_special_tokens=False) != " ".join(map(made.id_to_token, every)):
        return False
    return all(ids(f"{x}{chr(gap)}{x}") == 2 * ids(x) for gap in np.flatnonzero(K.SEPARATORS) for x in ("a", "1", "!", "'"))


class Memory:
    """Tokens and decoded text of chunks and of words, and what is known of joins; each part starts anew when it is full."""

    def __init__(self, path: str, most_bytes: int = MEMORY_BYTES, most_joins: int = MEMORY_JOINS, most_word_bytes: int = WORD_BYTES):
        self.tok, self.most_bytes, self.most_joins, self.most_word_bytes = tokenizer(path), most_bytes, most_joins, most_word_bytes
        self.apart = words_apart(self.tok)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        tokens = [f"{self.tok.id_to_token(i)} ".encode() for i in range(self.tok.get_vocab_size())] if self.apart else []
        self.token_bytes, self.token_ends = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        self.forget_words()
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.joins: dict[tuple[bytes, bytes, bytes], bytes | None] = {}
        self.bytes = 0

    def encoded(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(tokens as 32-bit integers, decoded text) of each."""
        ids = [x.ids for x in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        decoded = self.tok.decode_batch(ids, skip_special_tokens=False)
        return [(np.array(i, "<u4").tobytes(), d.encode()) for i, d in zip(ids, decoded)]

    def forget_words(self) -> None:
        """Numbers of words; the tokens of word i are ids[ends[i] : ends[i + 1]]."""
        self.number: dict[bytes, int] = {}
        self.ids, self.ends, self.word_bytes = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of these distinct words; new ones are encoded."""
        if self.word_bytes > self.most_word_bytes:
            self.forget_words()
        new = [w for w in words if w not in self.number]
        if new:
            ids = [x.ids for x in self.tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(lengths.sum()))))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.word_bytes += sum(map(len, new)) + 4 * int(lengths.sum()) + ENTRY_BYTES * len(new)
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))

    def encoded_by_words(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """What encoded() gives, each text put together from its words, which are cut once more where a mark follows a
        letter. A text with the string of a special token is encoded as one."""
        data = b"".join(texts)
        if any(x in data for x in self.special):
            whole = [t for t in texts if any(x in t for x in self.special)]
            if whole:
                found = dict(zip(whole, self.encoded(whole)))
                rest = [t for t in texts if t not in found]
                found.update(zip(rest, self.encoded_by_words(rest)))
                return [found[t] for t in texts]
        buf = np.frombuffer(data, np.uint8)
        where = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        s, e, _ = K.words(buf, where)
        if not len(s):
            return [(b"", b"")] * len(texts)
        cut = np.flatnonzero(_LETTER[buf[:-1]] & _MARK[buf[1:]]) + 1
        start, end = np.zeros((2, len(buf) + 1), bool)
        start[s] = start[cut] = end[e] = end[cut] = True
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        # words and what is between them lie end to end; every second one is a word
        bounds = np.stack((s, e), 1).ravel().astype(np.int64)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = spans.take(pa.array(np.arange(0, len(bounds), 2))).dictionary_encode()
        word = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self.ends[word + 1] - self.ends[word]
        ids = self.ids[K.ragged(self.ends[word], n)]
        size = self.token_ends[ids + 1] - self.token_ends[ids]
        decoded = self.token_bytes[K.ragged(self.token_ends[ids], size)].tobytes()
        at = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(s, where)]
        to = np.concatenate(([0], np.cumsum(size)))[at].tolist()
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [(raw[a:b], decoded[c : max(c, d - 1)]) for a, b, c, d in zip(at, at[1:], to, to[1:])]

    def learn(self, texts: list[bytes]) -> None:
        """See to it that all these chunks are kept."""
        new = [t for t in dict.fromkeys(texts) if t not in self.chunks]
        if new and self.bytes > self.most_bytes:
            self.chunks, self.bytes, new = {}, 0, list(dict.fromkeys(texts))
        for t, (ids, decoded) in zip(new, (self.encoded_by_words if self.apart else self.encoded)(new) if new else ()):
            self.chunks[t] = ids, decoded
            self.bytes += len(t) + len(ids) + len(decoded)

    def learn_joins(self, keys: list[tuple[bytes, bytes, bytes]]) -> None:
        """For (word, gap, word): what stands between their decoded texts, or None where they are not encoded and
        decoded together as they are alone."""
        if len(self.joins) + len(self.words) > self.most_joins:
            self.joins, self.words = {}, {}
        new = [k for k in dict.fromkeys(keys) if k not in self.joins]
        if not new:
            return
        words = [w for w in dict.fromkeys(w for a, _, b in new for w in (a, b)) if w not in self.words]
        self.words.update(zip(words, self.encoded(words)))
        for k, (ids, decoded) in zip(new, self.encoded([b"".join(k) for k in new])):
            (i, x), (j, y) = self.words[k[0]], self.words[k[2]]
            between = next((m for m in (b" ", b"") if decoded == x + m + y), None)
            self.joins[k] = between if i and j and ids == i + j else None

    def between(self, left: bytes, key: tuple[bytes, bytes, bytes], right: bytes) -> bytes | None:
        """What stands between the decoded texts of two chunks that meet at this join; None where it doesn't hold."""
        found = self.joins[key]
        holds = found is not None and self.chunks[left][0].endswith(self.words[key[0]][0]) and self.chunks[right][0].startswith(self.words[key[2]][0])
        return found if holds else None


@lru_cache(2)
def memory_of(path: str) -> Memory:
    """A worker's memory, which outlives its tasks."""
    return Memory(path)


def chunk_ends(codes: np.ndarray, first: np.ndarray, chunk_words: int) -> np.ndarray:
    """True at each word that ends a chunk: by the rolling hash of the last words, and at a row's last word."""
    n = len(codes)
    cut = np.zeros(n, bool)
    grams = K.rolling_codes(codes, HASH_WORDS)
    cut[HASH_WORDS - 1 :] = (grams >> K.U64(40)) & K.U64(chunk_words - 1) == 0 if len(grams) else False
    last = first[1:][np.diff(first) > 0] - 1
    cut[last] = True
    return cut


def settled(memory: Memory, data: bytes, spans: list[tuple[int, int, int, int]]) -> tuple[list[bytes], list[bytes]]:
    """Token bytes and decoded bytes of one text, from chunks (first word's start and end, last word's start and end).
    Chunks whose join doesn't hold are merged until all joins do."""
    while True:
        texts = [data[a:d] for a, _, _, d in spans]
        memory.learn(texts)
        keys = [(data[x[2] : x[3]], data[x[3] : y[0]], data[y[0] : y[1]]) for x, y in zip(spans, spans[1:])]
        memory.learn_joins(keys)
        marks = [memory.between(x, k, y) for x, k, y in zip(texts, keys, texts[1:])]
        if None not in marks:
            break
        whole = [spans[0]]
        for span, mark in zip(spans[1:], marks):
            if mark is None:
                whole[-1] = (*whole[-1][:2], *span[2:])
            else:
                whole.append(span)
        spans = whole
    found = [memory.chunks[t] for t in texts]
    return [i for i, _ in found], [part for (_, d), m in zip(found, [*marks, b""]) for part in (d, m)]


def encode_slice(memory: Memory, buf: np.ndarray, where: np.ndarray, chunk_words: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each row of a slice, the token bytes and decoded bytes of its chunks in order."""
    s, e, first = K.words(buf, where)
    last = np.flatnonzero(chunk_ends(K.word_codes(buf, s, e), first, chunk_words))
    begin = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    data = buf.tobytes()
    spans = list(zip(*(x.tolist() for x in (s[begin], e[begin], s[last], e[last]))))
    bounds = np.searchsorted(begin, first).tolist()
    # all chunks and joins of the slice are encoded in one batch each; then rows are put together
    memory.learn([data[a:d] for a, _, _, d in spans])
    memory.learn_joins([(data[x[2] : x[3]], data[x[3] : y[0]], data[y[0] : y[1]]) for i, j in zip(bounds, bounds[1:]) for x, y in zip(spans[i:j], spans[i + 1 : j])])
    for i, j in zip(bounds, bounds[1:]):
        yield settled(memory, data, spans[i:j]) if j > i else ([], [])


def _rows(batches: Iterator[pa.RecordBatch], path: str, chunk_words: int):
    memory = memory_of(path)
    for batch in batches:
        for i, j, buf, where in K.text_slices(batch.column("text")):
            yield batch.column("doc_id")[i:j], encode_slice(memory, buf, where, chunk_words)


def encode(docs: DataFrame, path: str | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids array<long>, decoded) of every text."""
    path = path or vocabulary_path()

    def run(batches):
        for doc_id, rows in _rows(batches, path, chunk_words):
            ids, texts = [], []
            for tokens, decoded in rows:
                ids.append(np.frombuffer(b"".join(tokens), "<u4").astype(np.int64))
                texts.append(b"".join(decoded).decode())
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(lengths, flat), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() returns, as digests that are made where the
    tokens are."""
    path = path or vocabulary_path()

    def run(batches):
        for doc_id, rows in _rows(batches, path, chunk_words):
            n, a, b = [], [], []
            for tokens, decoded in rows:
                raw = b"".join(tokens)
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(b"".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
