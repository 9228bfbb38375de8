"""Centroid clusters, the conversation trie and token files, held against brute force and on odd tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vanewright.llm import clustering as C
from vanewright.llm import conversation_trie as T
from vanewright.llm import oracles, pieces, token_files
from vanewright.llm import kernels as K
from vanewright.llm.bpe import tokenizer, vocabulary_path
from vanewright.sources.shared import new_path

VOCABULARY = vocabulary_path(token_files.VOCABULARY)


# clusters


def lloyd(rows, k=8, rounds=10, seed=3):
    """By definition, from (vec_id, whole components)."""
    x = np.array([v for _, v in rows], np.int64)
    start = sorted((i for i, (r, _) in enumerate(rows) if r is not None), key=lambda i: (hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    c = x[start]
    nearest = lambda: np.stack([((x - q) ** 2).sum(1) for q in c], 1)
    for _ in range(rounds):
        label = nearest().argmin(1)
        c = np.array([[int(s) // int((label == j).sum()) for s in x[label == j].sum(0)] if (label == j).any() else c[j] for j in range(len(c))])
    d = nearest()
    label, d = d.argmin(1), d.min(1)
    sha = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in c.tolist()]
    return sorted(((r, int(j), int(e), int(d[label == j].sum()), int(d.sum()), sha[j]) for (r, _), j, e in zip(rows, label, d)), key=str)


def clusters_of(frame, **kw):
    return sorted((tuple(r) for r in C.cluster_digests(frame, **kw).collect()), key=str)


def test_clusters_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(0, 1, (12, 64))
    some = [(int(i), (middles[i % 12] + rng.normal(0, 0.3 + (i % 3) / 4, 64)).astype(np.float32).tolist()) for i in range(3000)]
    some += some[:50] + [(None, some[0][1]), (None, some[1][1])] + [(5000 + i, [float(i % 2)] * 64) for i in range(40)]
    odd = [(9001, None), (9002, [1.0] * 63), (9003, [1.0] * 65), (9004, [1.0] * 63 + [None]), (9005, [1.0] * 63 + [float("nan")]), (9006, [float("-inf")] + [1.0] * 63), (9007, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in some + odd], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    whole = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64).tolist()) for i, v in some]
    assert clusters_of(frame) == lloyd(whole)
    done = C.clustering(frame)
    assert done.scanned[0] == len(some) and sum(done.scanned[1:]) < len(some) * (len(done.scanned) - 1)


def test_clusters_of_few_and_of_large_vectors(spark):
    big = [(1, [3e7] * 64), (2, [-3e7] * 64), (3, [1.5, -2.5] * 32), (4, [1.5, -2.5] * 32), (4, [0.0] * 64)]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    whole = [(i, np.clip(np.floor(1024 * np.array(v)), -C.LIMIT, C.LIMIT).astype(np.int64).tolist()) for i, v in big]
    assert clusters_of(frame) == lloyd(whole)
    assert clusters_of(frame, k=2, rounds=3, seed=9) == lloyd(whole, 2, 3, 9)
    assert clusters_of(frame.limit(0)) == [] and clusters_of(frame.filter("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long"))) == []


def test_clusters_equal_their_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, rng.normal(0, 0.1 + (i % 4), 64).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    assert sorted(con.execute(oracles.centroid_clusters()).fetchall(), key=str) == clusters_of(frame)


def test_loss_bounds_every_point_of_a_sphere_and_is_below_drift():
    rng = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        d = int(rng.integers(2, 6))
        old = rng.integers(-2000, 2000, (4, d))
        new = old + rng.integers(-600, 600, (4, d))
        radius = rng.uniform(0, 2500, 4)
        loss = C.tightened_loss(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loss <= drift * (1 + 2 * C.MARGIN)).all()
        less += int((loss < 0.9 * drift).sum())
        for i in range(4):
            way = rng.normal(size=(400, d))
            x = old[i] + radius[i] * way / np.linalg.norm(way, axis=1)[:, None] * rng.uniform(0, 1, (400, 1)) ** (1 / d)
            for j in range(4):
                assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= loss[i, j] + 1e-6
    assert less > 500


def test_rounds_join_without_a_shuffle(spark):
    from vanewright.sources.shared import bucketed

    a, b = (bucketed(spark.range(100).select(F.col("id").alias("block"), F.lit(b"x").alias(n)).repartition(4, "block"), n, "block", 4) for n in ("x", "y"))
    assert "Exchange" not in a.join(b.hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()


# conversations


def nodes_by_definition(rows):
    code = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, code(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in turns.items()}
    conv = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        conv[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + mine[h:]
    members, kids, below = defaultdict(list), defaultdict(list), {}
    for c, ts in conv.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below[k] = sum(below[q][0] for q in kids[k]) or 1, saved + sum(below[q][1] for q in kids[k])
    ended = {k: ",".join(str(c) for c in sorted(m) if len(conv[c]) == len(k)) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *below[k], hashlib.sha256(ended[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def nodes_of(frame, chunk):
    return sorted((tuple(r) for r in T.conversation_nodes(frame, chunk).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = np.random.default_rng(11)
    rows = []
    for c in range(-40, 400):
        n = int(rng.integers(0, 12))
        for t in range(n):
            # a few texts only, so that prefixes meet; a third of all share their first turns
            text = "hello" if c % 3 == 0 and t < 4 else "äß"[: int(rng.integers(0, 3))] * int(rng.integers(1, 3))
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [(c, t, "user", f"long {t}") for c in (1000, 1001, 1005) for t in range(300)] + [(1005, 300, "user", None)]
    rows += [(c, t, "user", "same") for c in range(2000, 2090) for t in range(12)]
    rows += [(None, 1, "user", "x"), (3000, None, "b", "late"), (3000, None, None, None), (3000, 2, "a", "t"), (3000, 2, "a", "t"), (3000, 2, "a", "s"), (3001, 5, None, "x" * 50_000)]
    return rows


@pytest.mark.parametrize("chunk", [5, 64, T.CHUNK])
def test_trie_nodes_are_those_of_the_definition(spark, chunk):
    rows = conversations()
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TURNS + ", depth int").repartition(6)
    assert nodes_of(frame, chunk) == nodes_by_definition(rows)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert nodes_of(empty, T.CHUNK) == []
    assert nodes_of(spark.createDataFrame([(None, 1, "user", "x")], TURNS), T.CHUNK) == []
    one = [(7, None, None, None)]
    assert nodes_of(spark.createDataFrame(one, TURNS), T.CHUNK) == nodes_by_definition(one)


def test_trie_equals_its_sql(spark, tmp_path):
    rows = [r for r in conversations() if r[0] is None or not 1000 <= r[0] < 2000]
    frame = spark.createDataFrame(rows, TURNS)
    frame.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(con.execute(oracles.conversation_trie()).fetchall(), key=str) == nodes_of(frame, 64)


def test_ids_that_end_together_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    frame = spark.createDataFrame([(i * 7919 % 1000 - 300, b"k" if i % 3 else b"q") for i in range(500)], "conv_id long, key binary")
    got = {bytes(r["key"]): r["ends_sha256"] for r in T.end_digests(frame.repartition(5)).collect()}
    for k in (b"k", b"q"):
        ids = sorted(r["conv_id"] for r in frame.collect() if bytes(r["key"]) == k)
        assert got[k] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# token files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1,.' \t\n\r\x0b\x00é  　字!s'(-"), max_size=40), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts_do(texts):
    encoder = pieces.encoder_of(VOCABULARY)
    data = [t.encode() for t in texts]
    where = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, first = encoder.encoded(np.frombuffer(b"".join(data), np.uint8), where)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == tokenizer(VOCABULARY).encode(t, add_special_tokens=False).ids


def test_piece_memory_starts_anew_and_special_strings_are_whole():
    encoder = pieces.PieceEncoder(VOCABULARY, most_bytes=300)
    for t in ["one two, three. " * 3, "four <|endoftext|> five", "six seven eight's", "", "one two"]:
        ids, first = encoder.encoded(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert ids.tolist() == tokenizer(VOCABULARY).encode(t, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]


def expected_files(rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        ids = tokenizer(VOCABULARY).encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@pytest.fixture(scope="module")
def filed(spark):
    rows = [(i * 37 % 1009, f"Document {i}, it's number {i * i}.\nÉté  — {'字' * (i % 5)} " * (i % 7)) for i in range(900)]
    rows += [(5, "twice"), (5, "again"), (5, "twice"), (None, "no id"), (None, None), (2000, None), (2001, ""), (2002, "word " * 300_000), (2003, "x" * 30_000)] + [(None, "hot")] * 300
    frame = spark.createDataFrame([(i, t, 0, "y") for i, t in rows], "doc_id long, text string, start int, part string").repartition(7)
    folder = new_path(spark, "files")
    return rows, frame, folder, token_files.token_digests(frame, folder).collect()


def test_token_files_hold_all_documents_in_order(spark, filed):
    rows, _, folder, got = filed
    assert ordered(got) == expected_files(rows)
    read = token_files.read_token_files(spark, folder).collect()
    assert sorted((r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in read) == [w[1:] for w in expected_files(rows)]


def test_token_files_are_pruned_by_document(spark, filed):
    rows, _, folder, _ = filed
    want = [w for w in expected_files(rows) if w[0] in (5, 74, 2001)]
    some = token_files.read_token_files(spark, folder, doc_ids=[5, 74, 2001])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    assert ordered(some.select("doc_id", "start", "n_tokens").collect()) == [w[:3] for w in want]
    span = token_files.read_token_files(spark, folder, least=100, most=120).select("doc_id", "start", "n_tokens")
    assert ordered(span.collect()) == [w[:3] for w in expected_files(rows) if w[0] is not None and 100 <= w[0] <= 120]


def test_token_files_have_row_indexes_and_bloom_filters(spark, filed):
    _, _, folder, _ = filed
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/tokens")
    files = [f.getPath() for f in path.getFileSystem(conf).listStatus(path) if f.getPath().getName().endswith(".orc")]
    kinds, stripes = set(), 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.ROW_INDEX
        for stripe in reader.getStripes():
            stripes += 1
            kinds |= {s.getKind().toString() for s in reader.rows().readStripeFooter(stripe).getStreamsList()}
    assert stripes >= len(files) > 0
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_parts_are_joined_by_shuffle(spark, filed, monkeypatch):
    rows, frame, _, _ = filed
    monkeypatch.setattr(token_files, "SENT_PARTS", 0)
    assert ordered(token_files.token_digests(frame).collect()) == expected_files(rows)
