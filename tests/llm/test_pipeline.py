"""The pipeline's stages: contracts, decisions, and that each works on what the one before kept."""

import hashlib
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from vanewright.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with toxic ones, a group of copies, a leak and a secret among clean ones."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = text(rng.randint(20, 60))
        if i % 5 == 0:
            t += " idiot you moron idiot"
        rows.append((i, t))
        labels.append((i, int(i % 5 == 0)))
    item = text(30)
    rows += [(1000, base := text(80)), (1001, base), (1002, base.replace("w1 ", "w2 ", 1) + " end"), (1003, f"{text(20)} {item} {text(20)}"), (1004, f'{text(20)} token = "abcdef123456" {text(5)}'), (1005, None), (1006, "")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_order(spark, tables, tmp_path):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(path := os.path.join(tmp_path, name))
        out = spark.read.parquet(path)
        if name != "bpe":
            assert out.columns == COLUMNS
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert not any(i % 5 == 0 for i in kept["toxicity"] if i < 400) and len(kept["toxicity"]) == 320 + 7
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {1001, 1002}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1003}
    assert set(kept["secrets"]) == set(kept["decontamination"])
    masked = kept["secrets"][1004]
    assert "[SECRET]" in masked["text"] and "abcdef123456" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert kept["secrets"][1005]["text"] is None
    tok = bpe.tokenizer(bpe.vocabulary_path())
    for i, r in kept["bpe"].items():
        ids = tok.encode(kept["secrets"][i]["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert {i: r["ids_sha256"] for i, r in whole.items()} == {i: r["ids_sha256"] for i, r in kept["bpe"].items()}
