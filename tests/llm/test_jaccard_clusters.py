"""Clusters of copies with few and many edits, a line that texts share, and frequent tokens: components by brute force."""

import random

import pytest

from vanewright.llm import jaccard


def shingles(text):
    words = (text or "").lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = root(i), root(j)
                up[max(u, v)] = min(u, v)
    return {i: root(i) for i, _ in sets}


@pytest.mark.parametrize("often, block", [(64, 512), (4, 7)])
def test_components_of_clusters(spark, monkeypatch, often, block):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    bases = [[pick.choice(words) for _ in range(n)] for n in (30, 60, 60, 100)]
    line = [pick.choice(words) for _ in range(15)]
    docs = []
    for i in range(420):
        text = list(pick.choice(bases)) if i % 3 else [pick.choice(words) for _ in range(40)]
        for _ in range(pick.choice([0, 1, 1, 2, 3])):
            text[pick.randrange(len(text))] = pick.choice(words[:6])
        docs.append((i, " ".join(text + line * (i % 5 == 0))))
    docs += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (1, docs[1][1])]
    want = brute_components(docs)
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)
