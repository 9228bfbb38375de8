"""How near SimHash keeps windows that are similar enough: what the radius is taken from."""

import random
from collections import Counter

import numpy as np

from vanewright.llm import decontam
from vanewright.llm import kernels as K


def similar(a, b):
    x, y = (Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4)) for w in (a, b))
    low = sum((x & y).values())
    return 100 * low >= 75 * (sum(x.values()) + sum(y.values()) - low)


def test_edited_windows_stay_within_the_radius():
    rng = random.Random(11)
    code = {}
    prints = lambda words: decontam.simhash(np.array([code.setdefault(w, rng.getrandbits(64)) for w in words], np.uint64))
    tried = near = 0
    while tried < 3000:
        vocabulary = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice((40, 400)))]
        item = [rng.choice(vocabulary) for _ in range(rng.randint(12, 200))]
        text = list(item)
        for _ in range(rng.randint(1, 5)):
            kind, at = rng.randrange(4), rng.randrange(len(text))
            if kind == 0:
                text[at] = "other"
            elif kind == 1:
                text = (text[:at] + text[at + 1 :] + ["after"])[: len(item)]
            elif kind == 2:
                text = (text[:at] + ["more"] + text[at:])[: len(item)]
            else:
                text = text[: max(5, len(text) - rng.randint(0, len(text) // 8))]
        if not similar(text, item):
            continue
        tried += 1
        near += (prints(text) ^ prints(item)).bit_count() <= decontam.RADIUS
    assert near == tried


def test_many_blocks_give_what_one_does(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(rng.choice((12, 30, 55)))) for i in range(40)]
    docs = [(i, f"{text(20)} {items[i % 40][1]} {text(20)}") for i in range(60)] + [(99, "a" * 30_000), (100, text(20_000))]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one, many = (sorted(map(tuple, decontam.leaks(frame, bench, size).collect())) for size in (1 << 24, 2000))
    assert one == many and {(d, i) for d, i, *_ in one} >= {(d, d % 40) for d in range(60)}


def test_prints_of_lanes_differ():
    buf = np.frombuffer(b"some words", np.uint8)
    s, e = np.array([0, 5]), np.array([4, 10])
    assert (K.word_codes(buf, s, e, 0) != K.word_codes(buf, s, e, 1)).all()
