"""Language identification of mixed-language texts by Viterbi over per-word scores.

A word's letters name its script by ranges of code points. Scripts narrow the languages that a word can be in to those
whose training texts use the script. The candidates' scores are sums of log likelihoods of the word's byte trigrams
(with the spaces around it) and of the word itself. A path of one language per word maximises the sum of scores less
a penalty for every switch; runs of one language along it are the labelled spans. A document's language is the one
whose spans hold most letters, and its score their share.

The counts are taken over all training texts, in tasks, and added up in rounds; the model has two tables of fixed size
for each language.

Defined results: a letter is a character of a Unicode category L; a null text, or one without a letter (digits, marks
and symbols of any script alone), is `und` with score 0 and no spans; words without letters take the language around
them; rows with a null id are not held out, so they are learned from as others are, and labelled; without training rows every text is `und`; ties go to the first language by name; rows that
repeat an id are each labelled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import text_of, written
from .toxicity import held_out

TABLE_BITS, PENALTY, SMOOTHING, LEAST_SCRIPT = 16, 6.0, 0.5, 0.01
SLICE = 4 << 20
#: Scripts by ranges of code points.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF), ("han", 0x3005, 0x3007), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x323AF), ("latin", 0xAA, 0xAA), ("latin", 0xBA, 0xBA), ("greek", 0xB5, 0xB5), ("latin", 0xFF21, 0xFF3A), ("latin", 0xFF41, 0xFF5A), ("kana", 0xFF66, 0xFF9D),
)
NAMES = ("none", *dict.fromkeys(s for s, _, _ in SCRIPTS), "other")


#: No letter has a code point from here on.
END_OF_LETTERS = 0x33480


@lru_cache(1)
def script_table() -> np.ndarray:
    """Script by code point; 0 for what is no letter by its Unicode category."""
    out = np.zeros(END_OF_LETTERS + 1, np.uint8)
    for point in range(END_OF_LETTERS):
        if unicodedata.category(chr(point))[0] == "L":
            out[point] = NAMES.index("other")
    for name, low, high in SCRIPTS:
        own = out[low : high + 1]
        own[own > 0] = NAMES.index(name)
    return out


def scripts_of(buf: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte of UTF-8; 0 at other bytes and for what is no letter."""
    table = script_table()
    out = np.where(buf < 128, table[:256][buf], np.uint8(0))
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        first = buf[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            own = size > k
            point[own] = point[own] << 6 | buf[lead[own] + k] & 0x3F
        out[lead] = table[np.minimum(point, END_OF_LETTERS)]
    return out


class Pieces:
    """Words of a slice, their trigrams' cells, cells of their own, letters and scripts."""

    def __init__(self, buf: np.ndarray, where: np.ndarray):
        self.s, self.e, self.first = K.words(buf, where)
        low = K.LOWER[buf]
        padded = np.full(len(buf) + 2, 32, np.uint8)
        padded[1:-1] = np.where(K.SEPARATORS[low], np.uint8(32), low)
        x = padded.astype(np.uint32)
        gram = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else x[:0]
        # place i of gram: the byte before i, i and the byte after; across documents there are no bytes between
        gram = self.edges(gram, padded, where)
        self.gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
        self.word = (K.word_codes(low, self.s, self.e) >> K.U64(64 - TABLE_BITS)).astype(np.int64)
        script = scripts_of(buf)
        self.letters = np.zeros((len(self.s), len(NAMES)), np.int32)
        where_script = np.flatnonzero(script)
        if len(where_script):
            at = np.searchsorted(self.s, where_script, "right") - 1
            flat = np.bincount(at * len(NAMES) + script[where_script], minlength=self.letters.size)
            self.letters = flat.reshape(self.letters.shape).astype(np.int32)

    @staticmethod
    def edges(gram: np.ndarray, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
        n = len(gram)
        inner = where[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        if len(inner):
            x = padded.astype(np.uint32)
            after, before = x[1:-1][np.minimum(inner + 1, n - 1)], x[1:-1][np.maximum(inner - 2, 0)]
            gram[inner] = 32 << 16 | x[1:-1][inner] << 8 | after
            gram[inner - 1] = before << 16 | x[1:-1][inner - 1] << 8 | 32
        return gram

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of a table over each word's trigrams."""
        if not len(self.s):
            return np.zeros(0)
        total = np.concatenate(([0.0], np.cumsum(table[self.gram], dtype=np.float64)))
        return total[self.e] - total[self.s]


KINDS = {"gram": 1 << TABLE_BITS, "word": 1 << TABLE_BITS, "script": len(NAMES)}
COUNTS = "lang string, kind string, part int, counts binary"


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> one table per language and kind for each task."""
    tables: dict[tuple[str, str], np.ndarray] = {}
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        for i, j, buf, where in K.text_slices(batch.column("text"), SLICE):
            p = Pieces(buf, where)
            names = sorted(set(lang[i:j]))
            own = np.array([names.index(x) for x in lang[i:j]])
            inside = np.zeros(len(buf) + 1, np.int32)
            inside[p.s] += 1
            np.subtract.at(inside, p.e, 1)
            inside = np.cumsum(inside[:-1]) > 0
            by_byte, by_word = np.repeat(own, np.diff(where)), np.repeat(own, np.diff(p.first))
            for k, name in enumerate(names):
                for kind, counts in (
                    ("gram", np.bincount(p.gram[inside & (by_byte == k)], minlength=KINDS["gram"])),
                    ("word", np.bincount(p.word[by_word == k], minlength=KINDS["word"])),
                    ("script", p.letters[by_word == k].sum(0)),
                ):
                    have = tables.setdefault((name, kind), np.zeros(KINDS[kind], np.int64))
                    have += counts
    part = TaskContext.get().partitionId()
    for (name, kind), counts in tables.items():
        yield count_batch(name, kind, part, counts)


def count_batch(name: str, kind: str, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([kind]), pa.array([part], pa.int32()), pa.array([zlib.compress(counts.astype("<i8").tobytes(), 1)], pa.binary())], ["lang", "kind", "part", "counts"])


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, kind, part) to one for each."""
    have, total = None, None
    for batch in batches:
        for *key, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "kind", "part", "counts"))):
            counts = np.frombuffer(zlib.decompress(raw), "<i8")
            if key != have:
                if have is not None:
                    yield count_batch(*have, total)
                have, total = key, counts.copy()
            else:
                total += counts
    if have is not None:
        yield count_batch(*have, total)


class Model:
    """Log likelihoods by language; scripts that each language uses."""

    def __init__(self, rows: list):
        tables = {(r["lang"], r["kind"]): np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in rows}
        self.langs = sorted({r["lang"] for r in rows})
        logs = {kind: [np.log((tables[x, kind] + SMOOTHING) / (tables[x, kind].sum() + SMOOTHING * KINDS[kind])) for x in self.langs] for kind in ("gram", "word")}
        self.gram, self.word = ([t.astype(np.float32) for t in logs[k]] for k in ("gram", "word"))
        script = np.array([tables[x, "script"] for x in self.langs], float).reshape(len(self.langs), len(NAMES))
        self.uses = script >= LEAST_SCRIPT * np.maximum(script.sum(1, keepdims=True), 1)

    def scores(self, p: Pieces) -> np.ndarray:
        """Words by languages; 0 for words without letters, very low outside the candidates of a word's script."""
        out = np.stack([p.sums(g) + w[p.word] for g, w in zip(self.gram, self.word)], 1)
        script = p.letters.argmax(1)
        open_to = self.uses[:, script].T
        open_to[~open_to.any(1)] = True
        out = np.where(open_to, out, -1e6)
        out[p.letters.sum(1) == 0] = 0
        return out

    def path(self, p: Pieces, penalty: float) -> np.ndarray:
        """Each word's language along the best path of its document. All documents of the slice advance together,
        the longest first, so those that have ended drop off the end."""
        score = self.scores(p)
        n = np.diff(p.first)
        order = np.argsort(-n, kind="stable")
        begin, length = p.first[:-1][order], n[order]
        active = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0), "left")
        out = np.zeros(len(score), np.int64)
        if not len(active):
            return out
        stay, best = np.ones(score.shape, bool), np.zeros(len(score), np.int32)
        value = score[begin[: active[0]]]
        last = np.zeros(len(order), np.int64)
        last[: active[0]] = 0
        final = np.zeros((len(order), score.shape[1]))
        for t in range(1, len(active)):
            ended = active[t]
            final[ended : active[t - 1]] = value[ended:]
            value = value[:ended]
            top = value.argmax(1)
            switched = value[np.arange(ended), top][:, None] - penalty
            word = begin[:ended] + t
            keeps = value >= switched
            stay[word], best[word] = keeps, top
            value = np.where(keeps, value, switched) + score[word]
        final[: len(value)] = value
        state = final.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            word = begin[: active[t]] + t
            now = state[: active[t]]
            out[word] = now
            if t:
                state[: active[t]] = np.where(stay[word, now], now, best[word])
        return out

    def label(self, buf: np.ndarray, where: np.ndarray, penalty: float) -> tuple[list, np.ndarray, list]:
        """For each row its language, the share of letters in it, and spans (start byte, end byte, language)."""
        p = Pieces(buf, where)
        state = self.path(p, penalty)
        letters = p.letters.sum(1)
        row = np.repeat(np.arange(len(where) - 1), np.diff(p.first))
        width = len(self.langs)
        share = np.bincount(row * width + state, letters, minlength=(len(where) - 1) * width).reshape(-1, width)
        total = share.sum(1)
        top = share.argmax(1)
        langs = [self.langs[k] if t > 0 else "und" for k, t in zip(top.tolist(), total.tolist())]
        score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
        lettered = np.flatnonzero(letters > 0)
        r, st = row[lettered], state[lettered]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (st[1:] != st[:-1]))) if len(lettered) else np.zeros(0, bool)
        end = np.concatenate((new[1:], [True])) if len(lettered) else new
        a, b = p.s[lettered][new] - where[r[new]], p.e[lettered][end] - where[r[end]]
        bounds = np.searchsorted(r[new], np.arange(len(where)))
        spans = list(zip(a.tolist(), b.tolist(), [self.langs[k] for k in st[new].tolist()]))
        return langs, score, [spans[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def fit(docs: DataFrame, fan_in: int = 64) -> Model:
    """A model from all rows (text, lang) given; leave out what is to be held out."""
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    left = rows.rdd.getNumPartitions()
    counts = rows.mapInArrow(count_rows, COUNTS)
    while True:
        last = left <= fan_in
        counts = counts.withColumn("part", F.lit(0) if last else F.floor(F.col("part") / fan_in).cast("int"))
        counts = counts.repartition("lang", "kind", "part").sortWithinPartitions("lang", "kind", "part").mapInArrow(add_counts, COUNTS)
        if last:
            break
        left = -(-left // fan_in)
    return Model(written(counts, "language-counts").collect())  # three tables of fixed size for each language


LABELS = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans); spans are in bytes of the text."""
    texts = text_of(docs)
    if not model.langs:
        return texts.selectExpr("doc_id", "'und' lang_pred", "0D score", "cast(array() as array<struct<start:int,end:int,lang:string>>) spans")
    held = texts.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            for i, j, buf, where in K.text_slices(batch.column("text"), SLICE):
                langs, score, spans = held.value.label(buf, where, penalty)
                spans = [[{"start": a, "end": b, "lang": x} for a, b, x in own] for own in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(langs), pa.array(score), pa.array(spans, spans_type)], ["doc_id", "lang_pred", "score", "spans"])

    return texts.mapInArrow(run, LABELS)


def identified(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans), learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out(4, 2)))
    return label(docs, model, penalty).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "spans")
