"""Texts shorter than every item of the benchmark."""

import random

import pytest

from vanewright.llm import decontam


@pytest.mark.parametrize("size", [15, 200])
def test_truncated_copies_leak_items_of_one_size(spark, size):
    rng = random.Random(size)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for _ in range(3)]
    lengths = range(5, size + 1)
    docs = [(1000 * k + n, " ".join(item.split()[:n])) for k, item in enumerate(items) for n in lengths]
    want = {(1000 * k + n, k, round((n - 4) / (size - 4), 6)) for k in range(len(items)) for n in lengths if (n - 4) / (size - 4) >= 0.75}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in found} == want
