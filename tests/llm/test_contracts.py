"""Texts made so that weak fingerprints take them for equal, letters by category, long paragraphs, repeatable fits."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.llm import bpe, decontam, fingerprints, jaccard, langid, secrets, substring, suffix, toxicity, urls
from vanewright.llm import kernels as K


def thue_morse(n, a="a", b="b"):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


def twins(n, sep=""):
    """A Thue-Morse word and its complement: equal under every polynomial hash modulo a power of two."""
    return sep.join(thue_morse(n)), sep.join(thue_morse(n, "b", "a"))


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_fingerprints_tell_twins_apart(n):
    x, y = twins(n)
    buf = np.frombuffer((x + y).encode(), np.uint8)
    for lane in (0, 1):
        a, b = K.span_codes(buf, np.array([0, n]), np.array([n, 2 * n]), lane)
        assert a != b
    values = np.frombuffer((x + y).encode(), np.uint8).astype(np.uint64)
    grams = K.gram_codes(values, n)
    assert grams[0] != grams[n] and len(set(K.gram_codes(np.frombuffer((x + x).encode(), np.uint8).astype(np.uint64), n)[[0, n]].tolist())) == 1


@pytest.fixture(scope="module")
def twin_docs(spark):
    words = [w for n in (1024, 4096) for w in twins(n)]
    texts = list(words) + [" ".join([w] + [f"x{i}" for i in range(14)]) for w in words]
    for n in (1024, 2048):
        texts += [" ".join(thue_morse(n, "cat", "dog")), " ".join(thue_morse(n, "dog", "cat"))]
    return texts


def test_operators_tell_twins_apart(spark, twin_docs):
    frame = frame_of(spark, twin_docs)
    split = [t.split() for t in twin_docs]
    # op5
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in split]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = rows_of(jaccard.similar_components(frame))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(sets))] == [(len(s), r) for s, r in zip(sets, root)]
    # op7
    first, seen = {}, Counter(t[p : p + 200] for t in twin_docs for p in range(len(t) - 199))
    got = rows_of(suffix.repeat_digests(frame))
    for i, t in enumerate(twin_docs):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        assert got[i]["kept_sha256"] == hashlib.sha256(bytes(ord(c) for c, g in zip(t, gone) if not g)).hexdigest()
    # op10
    got = rows_of(substring.repeat_digests(frame))
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    # op9 and op4
    tok, digests, prints = bpe.tokenizer(bpe.vocabulary_path()), rows_of(bpe.encode_digests(frame)), rows_of(fingerprints.fingerprints(frame))
    for i, t in enumerate(twin_docs):
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert len({p["fingerprint"] for p in prints.values()}) == len(set(twin_docs))
    # op8
    bench = spark.createDataFrame([(0, twin_docs[0]), (1, twin_docs[9])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame, bench).collect()}
    assert (0, 0) in found and (1, 0) not in found and (9, 1) in found


def test_letters_by_category():
    texts = ["😀😀", "٣٤", "१२३", "﻿", "�", "́", "12 !?", "Ａｂ", "々", "ª", "µ", "ё", "𠀀", "á", "中1"]
    for t in texts:
        p = langid.Pieces(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert int(p.letters.sum()) == sum(c.isalpha() for c in t), t


def test_language_of_texts_without_letters(spark):
    rows = [(i, "das ist ein text", "de") for i in range(20)] + [(100, "😀 ٣٤ ́", None), (101, "µ", None), (102, "x" * 200_000, None)]
    got = rows_of(langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got[100]["lang_pred"] == "und" and got[100]["score"] == 0 and got[101]["lang_pred"] == "de" and got[102]["score"] == 1


def likeness(a, b):
    parts = []
    for t in (a, b):
        raw = t.encode()
        start, end = fingerprints.paragraphs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if raw else ([], [])
        parts.append(Counter(raw[x:y] for x, y in zip(start, end)))
        assert sum(len(k) * n for k, n in parts[-1].items()) == len(raw)
    size = lambda c: sum(len(k) * n for k, n in c.items())
    both = size(parts[0]) + size(parts[1])
    return 1 - (size(parts[0] - parts[1]) + size(parts[1] - parts[0])) / both if both else 1.0


def test_likeness_is_the_share_of_equal_paragraphs(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40)))
    shared = [line() for _ in range(30)]
    texts = ["\n".join(rng.choice(shared) if rng.random() < 0.7 else line() for _ in range(rng.randrange(0, 25))) for _ in range(40)]
    texts += ["z" * 150_000, "z" * 150_001, "y" + "z" * 149_999, "same\n" * 50, "same\n" * 60, "", ""]
    frame = spark.createDataFrame([(3 * i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, range string, key int").repartition(5)
    got = rows_of(fingerprints.fingerprints(frame))
    for i, (t, u) in enumerate(zip(texts, texts[1:] + texts[:1])):
        assert got[3 * i]["near_next"] == pytest.approx(likeness(t, u)), i
        assert got[3 * i]["near_edited"] == pytest.approx(likeness(t, fingerprints.edited_text(t, u))), i


def test_equal_keys_in_one_text_end():
    keys = np.array([70_000, 70_000, 131_077, 5 << 16 | 9], np.uint64)
    first = np.array([0, 3, 4])
    assert fingerprints.differing_bytes(keys, first, np.array([0]), np.array([1])).tolist() == [int((keys & np.uint64(0xFFFF)).sum())]
    assert fingerprints.listed_difference(keys[:2], keys[:1]) == 70_000 & 0xFFFF


def test_bounds_below(spark):
    bounds = [-5, 0, 7, 7 + 2**40]
    frame = spark.createDataFrame([(k,) for k in (-9, -5, -4, 0, 1, 7, 8, 2**50)], "k long")
    got = {r["k"]: r["n"] for r in frame.select("k", fingerprints.bounds_below(F.col("k"), bounds).alias("n")).collect()}
    assert got == {k: sum(b < k for b in bounds) for k in got}
    assert frame.select(fingerprints.bounds_below(F.col("k"), []).alias("n")).distinct().collect()[0]["n"] == 0


def test_toxicity_is_repeatable_and_sees_stars(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" " + rng.choice(["f*ck", "you idiot", "m0ron", "sh**"]) if i % 3 == 0 else "")) for i in range(300)]
    frame, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.scored(f, labels).collect()} for f in (frame.repartition(7), frame.repartition(2)))
    assert one == two
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    at = toxicity.FEATURES.index("masked")
    for t, n in (("what the f*ck", 1), ("sh** now", 1), ("1d1ot m0ron", 2), ("a * b", 0), ("nice w*rds", 0)):
        assert lexicon.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0, at] == n, t
    few = toxicity.fit(frame.limit(30), labels)
    assert few.isotonic is not None


def test_sites_and_suffixes(spark):
    pages = [(1, "http://user@www.shop.co.uk:8080/x"), (2, "http://10.0.0.1:80/"), (3, "https://a.b.example.com/"), (4, "http://[::1]:8/"), (5, None)]
    got = {r["page_id"]: tuple(r)[3:] for r in urls.with_parts(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got == {1: ("www.shop.co.uk", "shop.co.uk", "co.uk"), 2: ("10.0.0.1", "10.0.0.1", ""), 3: ("a.b.example.com", "example.com", "com"), 4: ("[::1]", "[::1]", ""), 5: ("", "", "")}


def test_empty_inputs_of_filters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (secrets.masked(empty, secrets.secret_scan(empty)), jaccard.one_of_each(empty), toxicity.without_toxic(empty, labels), decontam.without_leaks(empty, bench)):
        assert out.count() == 0 and out.columns == empty.columns


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "one two three four five six " * 5, "a", 1, 2)] * 3 + [(2, "x", "b", 1, 2), (None, "one two", "c", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, item_id int, range int")
    bench = spark.createDataFrame([(1, "one two three four five six one two three four five six", 5)], "item_id long, text string, doc_id int")
    assert [r["doc_id"] for r in decontam.leaks(frame, bench).collect()] == [1]
    assert fingerprints.fingerprints(frame).count() == bpe.encode_digests(frame).count() == langid.identified(frame.withColumn("lang", F.lit("en"))).count() == 5
