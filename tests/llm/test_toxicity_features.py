"""Every feature of a text against its definition, written out one word at a time; and the learned lexicon whole."""

import math
import random
import re

import numpy as np
import pytest

from vanewright.llm import kernels as K
from vanewright.llm import toxicity as T

LEARNED = {"grobian": 1.5, "troll": -0.25, "ähre": 0.75, "w7": 2.0}
# bytes are looked at one by one, so a text is read as latin-1
WORD, LOOSE = re.compile("[0-9A-Za-z\x80-\xff]+"), re.compile("[0-9A-Za-z\x80-\xff@$!*]+")
SIGNS = "0134 57@$!*".replace(" ", "")
PLAIN = str.maketrans("013457@$!", "oieastasi")


def lowered(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def as_bytes(word):
    return word.encode().decode("latin-1")


WEIGHTS = {as_bytes(w): v for w, v in LEARNED.items()}
BAD = set(T.INSULTS) | set(WEIGHTS)
HIDDEN = BAD | {w[:i] + "*" * (j - i) + w[j:] for w in T.INSULTS if len(w) > 3 for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)}


def by_definition(text):
    t = as_bytes(text or "")
    found = WORD.findall(t)
    words = [lowered(w) for w in found]
    n, size = len(words), max(len(words), 1)
    hits = [i for i, w in enumerate(words) if w in BAD]
    weights = [WEIGHTS.get(words[i], 0.0) for i in hits]
    near = sum(any(w in T.SECOND_PERSON for w in words[max(i - T.NEAR, 0) : i + T.NEAR + 1]) for i in hits)
    capitals, letters = sum("A" <= c <= "Z" for c in t), sum("a" <= c.lower() <= "z" for c in t if c.isascii())
    mixed = [w for w in LOOSE.findall(t) if len(w) > 2 and any(c.isascii() and c.isalpha() for c in w) and any(c in SIGNS for c in w[:-1])]
    masked = sum(lowered(w).translate(PLAIN) in HIDDEN for w in mixed)
    total = max(len(t), 1)
    return [
        math.log1p(n), len(hits), len(hits) / size, len({words[i] for i in hits}), sum(w in T.INSULTS for w in words), near,
        sum(weights), max([0.0, *weights]), capitals / max(letters, 1), sum(len(w) > 1 and all("A" <= c <= "Z" for c in w) for w in found) / size,
        sum(33 <= ord(c) < 127 and not c.isalnum() for c in t) / total, t.count("!") / total, masked, len(mixed) / size,
    ]


@pytest.fixture(scope="module")
def lexicon():
    codes = np.array([T.codes_of([w])[0] for w in LEARNED], np.uint64)
    return T.Lexicon(codes, np.array(list(LEARNED.values())))


def made(lexicon, texts):
    raw = [t.encode() for t in texts]
    return lexicon.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def odd_texts(seed=5):
    rng = random.Random(seed)
    pool = ["you", "YOU", "u", "idiot", "IDIOT", "Moron", "1d1ot", "id**t", "i***t", "$tupid", "stup!d", "grobian", "GROBIAN", "troll", "Ähre", "ähre", "w7",
            "plain", "word", "The", "été", "日本語", "a1", "42", "!!!", "a!", "@b", "***", "don't", "x", "I", "OK", "...", "idiot!", "f*ck", "　", "\x00"]
    texts = ["", " ", "!", "idiot", "you idiot", "idiot " + "x " * 5 + "you", "idiot " + "x " * 4 + "you", "ÄHRE", "idiot\nyou", "youidiot", "A", "AB", "1", "aaa1", "1aaa", "a*"]
    return texts + [rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_every_feature_is_its_definition(lexicon):
    texts = odd_texts()
    got = made(lexicon, texts)
    assert got.shape == (len(texts), len(T.FEATURES))
    for text, row in zip(texts, got):
        assert row == pytest.approx(by_definition(text), abs=1e-9), text
    # all features take several values here, so none is tested on nothing
    assert all(len(np.unique(got[:, i])) > 3 for i in range(len(T.FEATURES)))


def test_rows_do_not_reach_into_each_other(lexicon):
    texts = ["you", "idiot", "", "x idiot", "you you", "", "idi", "ot you"]
    assert np.array_equal(made(lexicon, texts), np.concatenate([made(lexicon, [t]) for t in texts]))
    assert made(lexicon, []).shape == (0, len(T.FEATURES))


def test_a_very_long_text(lexicon):
    rng = random.Random(8)
    text = " ".join(rng.choice(["you", "plain", "IDIOT", "1d1ot", "grobian", "word%d" % rng.randrange(50_000)]) for _ in range(300_000))
    assert len(text) > K.SLICE_BYTES
    assert made(lexicon, ["short", text])[1] == pytest.approx(by_definition(text))


def test_no_word_of_the_learned_lexicon_is_lost(spark):
    marks = ["bad%d" % i for i in range(7000)]
    rows = [(" ".join([*marks, "of", "n%d" % i]), 1) for i in range(40)] + [(f"of the {i}", 0) for i in range(40)]
    learned = T.learned_lexicon(spark.createDataFrame(rows * 2, "text string, toxic int"))
    assert np.array_equal(learned.learned, T.codes_of(marks))
    assert learned.weights == pytest.approx(math.log(40.5 / 41) - math.log(0.5 / 41))
