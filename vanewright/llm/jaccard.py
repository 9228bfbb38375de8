"""Exact n-gram Jaccard join with a token-group matrix.

A document's tokens are its distinct word shingles. Documents with equal sets are one class, and one of each stands for
it from then on. Classes are partitioned into groups by the least of their tokens that other classes have as well (by
the least frequent-listed one, where those are much of the set), so that what an edit adds to a copy does not move it
to a group of its own. The matrix holds, for every token, the groups whose members have it. For a query and a group,
the number of the query's tokens in the matrix's column bounds its overlap with every member from above, and tokens
whose holders in the group are all too small or too large for the query do not count; only groups whose bound reaches
what the similarity needs are opened, and members of opened groups are compared exactly.

The matrix needs prefixes alone: with tokens in one order for all, two sets that overlap in t tokens share l tokens
within their first |A| - t + l and |B| - t + l. Tokens that a count-min sketch shows to occur once come first in that
order (no partner has them, so they need no entry), so sets with many tokens of their own have few entries or none.
The most frequent tokens, a list of bounded length, come last, so a passage that many documents share brings together
only those that are little else. Any order gives the same links; what a list or sketch gets wrong costs time alone. The grouping, too, only decides what is compared.

Comparisons run in two steps. First the leader of each group, the member with the largest share of tokens that others
have (a text rather than an edited copy of it), is held against the matrix and compared with all groups that it
qualifies for, which links most copies of a text. Then follow those queries that lie outside the main component of
their group, and the members of groups that meet a group of another main component, no smaller, in enough tokens: of
two similar sets in different components, one at least is such a query. So what is looked up in the matrix grows with leaders and
unsettled queries, not with the copies of a text times the groups that these fall into. Large groups and their queries are dealt in blocks, so no task holds a whole one, and what tasks
return are spanning edges, not all pairs.

Tokens are 64-bit fingerprints of words and of joined words without a structure that texts could be made to meet; sets
are told apart by 128 bits. Two different texts are counted as alike only if a chance collision of 64 bits falls within
one compared pair.

Defined results: a null or empty text (or one of white space alone) has no tokens, is linked with nothing and is its
own component; a text of fewer words than a shingle is one token; rows that repeat an id are each returned; a null id
has component null where its set is alone, and never names a component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies, sketches
from . import kernels as K
from .components import components
from .tables import text_of, written

SHINGLE = 5
#: Similarity as a fraction; classes and queries of a block; a prefix shares 1 + n / EXTRA tokens.
NUMERATOR, DENOMINATOR, BLOCK, EXTRA = 75, 100, 512, 16
SKETCH_DEPTH, SKETCH_BITS = 3, 27
#: Sets with a token in their prefix from which it counts as frequent, and the most that are listed.
OFTEN, MOST_FREQUENT = 64, 200_000
#: A set of which one counted token in so many is frequent joins a group by those alone. Prefixes, which the list is
#: made from, have some three tenths of a set, so this is less than half of what a copy of a common text has.
MOSTLY = 8


def shingle_sets(buf: np.ndarray, where: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of each row, end to end, and where each row's begin."""
    s, e, first = K.words(buf, where)
    codes = K.word_codes(K.LOWER[buf], s, e)
    counts = np.diff(first)
    grams = K.gram_codes(codes, k)
    grams = grams[K.starts_within(first, len(codes), k)]
    size = np.maximum(counts - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(size)))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([K.gram_codes(codes[first[r] : first[r + 1]], int(counts[r]))[0] for r in short], K.U64)
        grams = np.insert(grams, bounds[short], whole)
        size[short] = 1
        bounds = np.concatenate(([0], np.cumsum(size)))
    ends = bounds.tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[bounds[:-1][size > 0]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return grams[new], total[bounds]


def set_codes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes of each row's set, independent of each other: sums of its tokens, scrambled in two ways."""
    out = []
    for lane in K.LANES:
        total = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix(tokens * K.PAIR + lane), dtype=K.U64)))
        out.append(K.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(K.U64)))
    return out[0], out[1]


def least_overlap(n):
    """Tokens that any partner of a set of n tokens shares with it: the similarity times n, rounded up."""
    return (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, where in K.text_slices(batch.column("text")):
            tokens, first = shingle_sets(buf, where)
            a, b = set_codes(tokens, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(first)), pa.array(K.signed(a)), pa.array(K.signed(b))], ["doc_id", "n", "sig", "sig2"])


def standing_for_classes(batch: pa.RecordBatch, chosen) -> pa.RecordBatch:
    return batch.filter(pa.array(sketches.contains(chosen.value, batch.column("doc_id").to_numpy().view(np.uint64))))


def sketch_keys(chosen):
    """Every second token (by its lowest bit): half the sketch, and still enough tokens known to occur once."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, buf, where in K.text_slices(standing_for_classes(batch, chosen).column("text")):
            tokens, _ = shingle_sets(buf, where)
            yield tokens[tokens & K.U64(1) == 0]

    return run


def frequent_tokens(postings: DataFrame) -> np.ndarray:
    """Codes of the most frequent tokens, sorted; at most MOST_FREQUENT."""
    often = postings.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > OFTEN)
    rows = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def posting_rows(chosen, planes, frequent=None):
    """(token, cid, gkey, n, common) for the tokens of each set's prefix that others may have; common: how many in a
    thousand of the set's tokens others have, of those that were counted."""

    def run(batches):
        for batch in batches:
            batch = standing_for_classes(batch, chosen)
            ids = batch.column("doc_id").to_numpy()
            for i, j, buf, where in K.text_slices(batch.column("text")):
                tokens, first = shingle_sets(buf, where)
                n = np.diff(first)
                cid = ids[i:j]
                row = np.repeat(np.arange(len(n)), n)
                counted = tokens & K.U64(1) == 0
                single = counted.copy()
                single[counted] = ~sketches.contains(planes.value, tokens[counted])
                group = tokens[np.minimum(first[:-1], max(len(tokens) - 1, 0))] if len(tokens) else np.zeros(len(n), K.U64)
                again = np.flatnonzero(counted & ~single)
                with_again, least = np.unique(row[again], return_index=True)
                group[with_again] = tokens[again[least]]
                total = np.bincount(row[counted], minlength=len(n))
                if frequent is not None and len(frequent.value) and len(again):
                    spot = np.minimum(np.searchsorted(frequent.value, tokens[again]), len(frequent.value) - 1)
                    often = again[frequent.value[spot] == tokens[again]]
                    much = MOSTLY * np.bincount(row[often], minlength=len(n)) >= total
                    often = often[much[row[often]]]
                    with_often, least = np.unique(row[often], return_index=True)
                    group[with_often] = tokens[often[least]]
                common = 1000 * np.bincount(row[again], minlength=len(n)) // np.maximum(total, 1)
                prefix = n - least_overlap(n) + 1 + n // EXTRA
                left = prefix - np.bincount(row[single], minlength=len(n))
                others = np.flatnonzero(~single)
                if frequent is not None and len(frequent.value) and len(others):
                    spot = np.minimum(np.searchsorted(frequent.value, tokens[others]), len(frequent.value) - 1)
                    last = frequent.value[spot] == tokens[others]
                    others = others[np.lexsort((last, row[others]))]
                own = row[others]
                rank = np.arange(len(others)) - np.searchsorted(own, own)
                use = others[rank < left[own]]
                if len(use):
                    r = row[use]
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(tokens[use])), pa.array(cid[r]), pa.array(K.signed(group[r])), pa.array(n[r]), pa.array(common[r])], ["token", "cid", "gkey", "n", "common"])

    return run


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, tokens) of the texts whose set is the wanted one."""
    for batch in batches:
        sig, sig2, cid = (batch.column(c).to_numpy() for c in ("sig", "sig2", "cid"))
        for i, j, buf, where in K.text_slices(batch.column("text")):
            tokens, first = shingle_sets(buf, where)
            a, b = set_codes(tokens, first)
            ok = np.flatnonzero((K.signed(a) == sig[i:j]) & (K.signed(b) == sig2[i:j])).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cid[i:j][ok]), pa.array([tokens[first[r] : first[r + 1]].tobytes() for r in ok], pa.binary())], ["cid", "tokens"])


def qualifying(c: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Whether a set of n tokens with c of them in a group's union can have a partner there, the group's smallest
    member having `least` tokens: |A and B| >= s (|A| + |B|) / (1 + s)."""
    partner = np.maximum(least_overlap(n), least)
    return c * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n + partner)


def opened(queries: list[np.ndarray], members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) that are similar enough, by exact overlap counts. Only queries whose bound over the
    members' token union qualifies are compared."""
    size = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    n = np.array([len(q) for q in queries])
    tokens, asks = np.concatenate(queries), np.repeat(np.arange(len(queries)), n)
    a, b = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
    bound = np.bincount(asks[b > a], minlength=len(n))
    good = qualifying(bound, n, int(size.min()))
    none = np.zeros(0, np.int64)
    if not good.any():
        return none, none
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q in np.flatnonzero(good).tolist():
        own = slice(int(n[:q].sum()), int(n[: q + 1].sum()))
        both = np.bincount(owner[K.ragged(a[own], b[own] - a[own])], minlength=len(members))
        hit = np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (n[q] + size - both))
        found.append((np.full(len(hit), q), hit))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of these pairs, those that join parts not joined before."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def unit_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gkey, gblock, qblock, role, cid, tokens) sorted by unit -> spanning edges between similar classes."""

    def solve(queries, members):
        if not queries or not members:
            return None
        q, m = opened([np.frombuffer(t, np.uint64) for _, t in queries], [np.frombuffer(t, np.uint64) for _, t in members])
        edges = spanning((queries[x][0], members[y][0]) for x, y in zip(q.tolist(), m.tolist()))
        if edges:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])

    unit, held = None, ([], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("gkey", "gblock", "qblock", "role", "cid", "tokens")]
        for g, gb, qb, role, cid, tokens in zip(*columns):
            if (g, gb, qb) != unit:
                if (out := solve(held[1], held[0])) is not None:
                    yield out
                unit, held = (g, gb, qb), ([], [])
            held[role].append((cid, tokens))
    if (out := solve(held[1], held[0])) is not None:
        yield out


def compare(asked: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """asked (cid, gkey), members (gkey, cid) -> spanning edges (a, b). Members and queries of a group are dealt in
    blocks; every query block meets every member block. All sides are written tables, so that adaptive execution can
    split the rows of a large group while they are dealt."""
    block = lambda total: F.pmod(F.xxhash64("cid"), F.ceil(F.col(total) / BLOCK)).cast("int")
    sizes = members.groupBy("gkey").agg(F.count("*").alias("nm"))
    totals = written(asked.groupBy("gkey").agg(F.count("*").alias("nq")).join(sizes.hint("merge"), "gkey"), "group-sizes")
    every = lambda total: F.explode(F.sequence(F.lit(0), F.ceil(F.col(total) / BLOCK).cast("int") - 1))
    ask = asked.join(totals.hint("merge"), "gkey").select("gkey", every("nm").alias("gblock"), block("nq").alias("qblock"), F.lit(1).alias("role"), "cid")
    own = members.join(totals.hint("merge"), "gkey").select("gkey", block("nm").alias("gblock"), every("nq").alias("qblock"), F.lit(0).alias("role"), "cid")
    units = ask.unionByName(own).join(sets.hint("merge"), "cid").select("gkey", "gblock", "qblock", "role", "cid", "tokens")
    dealt = units.repartition("gkey", "gblock", "qblock").sortWithinPartitions("gkey", "gblock", "qblock")
    return dealt.mapInArrow(unit_edges, "a long, b long")


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    texts = text_of(docs)
    rows = written(texts.mapInArrow(class_rows, "doc_id long, n long, sig long, sig2 long"), "shingle-sets")
    classes = written(rows.filter("n > 0 and doc_id is not null").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("cid")), "set-classes")

    share = texts.sparkSession.sparkContext.broadcast
    known = texts.filter("doc_id is not null")
    chosen = share(copies.filter_of(classes, "cid"))
    sketch = sketches.merged(sketches.sketch_tasks(known, sketch_keys(chosen), SKETCH_DEPTH, SKETCH_BITS))
    planes = share(sketches.collected(sketch, "twice", SKETCH_DEPTH, SKETCH_BITS))
    schema = "token long, cid long, gkey long, n long, common long"
    frequent = share(frequent_tokens(known.mapInArrow(posting_rows(chosen, planes), schema).select("token")))
    postings = written(known.mapInArrow(posting_rows(chosen, planes, frequent), schema).distinct(), "postings")

    # the token-group matrix, of tokens that two classes hold and of classes with enough of those to have a partner
    need = lambda n: 1 + F.floor(F.ceil(F.col(n) * NUMERATOR / DENOMINATOR) / EXTRA)
    several = postings.groupBy("token").agg(F.min("cid").alias("c1"), F.max("cid").alias("c2")).filter("c1 <> c2").select("token")
    held = postings.join(several.hint("merge"), "token", "left_semi")
    partnered = held.groupBy("cid").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= need("n")).select("cid")
    postings = written(held.join(partnered.hint("merge"), "cid", "left_semi"), "postings-held")
    matrix = postings.groupBy("token", F.col("gkey").alias("group")).agg(F.min("cid").alias("c1"), F.max("cid").alias("c2"), F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = written(matrix, "matrix")
    members = written(postings.select("gkey", "cid", "n", "common").distinct(), "members")
    leaders = members.groupBy("gkey").agg(F.max_by("cid", F.struct("common", -F.col("cid"))).alias("cid"), F.count("*").alias("size"), F.min("n").alias("shortest"))
    leaders = written(leaders, "leaders")

    wanted = members.select("cid").join(classes.hint("merge"), "cid").withColumnRenamed("cid", "doc_id")
    texts_wanted = texts.join(wanted.select("doc_id", "sig", "sig2").hint("shuffle_hash"), "doc_id").withColumnRenamed("doc_id", "cid")
    sets = written(texts_wanted.mapInArrow(set_rows, "cid long, tokens binary").dropDuplicates(["cid"]), "token-sets")

    # sets of which one has less than the similarity's share of the other's tokens can't be similar
    fit = (DENOMINATOR * F.col("most") >= NUMERATOR * F.col("n")) & (NUMERATOR * F.col("least") <= DENOMINATOR * F.col("n"))

    def qualified(shared: DataFrame) -> DataFrame:
        """Rows (cid, n, group), one for each token that a query finds in a group -> (cid, gkey) whose bound qualifies."""
        bounds = shared.groupBy("cid", F.col("group").alias("gkey")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
        return bounds.filter(F.col("c") >= need("n")).select("cid", "gkey")

    def ask_all(queries: DataFrame) -> DataFrame:
        """What the given queries (cid) ask of all groups, their own included."""
        own = postings.join(queries.hint("merge"), "cid", "left_semi")
        return qualified(own.join(matrix.hint("merge"), "token").filter(fit & ((F.col("gkey") != F.col("group")) | (F.col("c1") != F.col("c2")))))

    first = written(ask_all(leaders.select("cid")).unionByName(leaders.select("cid", "gkey")).distinct(), "asked-by-leaders")
    edges = written(compare(first, members, sets), "edges")
    joined = components(edges)
    rooted = members.join(joined.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("gkey", "cid", F.coalesce("root", "cid").alias("root"))
    rooted = written(rooted, "rooted-members")
    main = rooted.groupBy("gkey", "root").agg(F.count("*").alias("n")).groupBy("gkey").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    main = written(main, "main-components")
    alone = rooted.join(main.hint("merge"), "gkey").filter("root <> main").select("cid").join(leaders.select("cid").hint("merge"), "cid", "left_anti")
    alone = written(alone, "queries-apart")

    # pairs of groups with different main components: told from the matrix alone, a group's shortest member and its
    # tokens together bounding what any member shares, so that members are looked at only where groups qualify. The
    # smaller group asks the larger; a group of one has asked all by its leader
    several = leaders.filter("size > 1").select(F.col("gkey").alias("group"), "size", "shortest")
    # a table of its own: a join of two read sides is one that adaptive execution splits where a group has many tokens
    several = written(several.join(main.withColumnRenamed("gkey", "group").hint("merge"), "group"), "groups-of-several")
    lines = matrix.join(several.hint("merge"), "group")
    mixed = lines.groupBy("token").agg(F.min("main").alias("m1"), F.max("main").alias("m2")).filter("m1 <> m2").select("token")
    lines = written(lines.join(mixed.hint("merge"), "token", "left_semi").select("token", "group", "least", "most", "main", "size", "shortest"), "matrix-apart")
    asking = lines.select("token", *(F.col(c).alias(f"own_{c}") for c in ("group", "least", "most", "main", "size", "shortest")))
    some_fit = (DENOMINATOR * F.col("most") >= NUMERATOR * F.col("own_least")) & (NUMERATOR * F.col("least") <= DENOMINATOR * F.col("own_most"))
    smaller = F.struct("own_size", "own_group") < F.struct("size", "group")
    meet = asking.join(lines.hint("merge"), "token").filter(some_fit & smaller & (F.col("own_main") != F.col("main")))
    meet = written(meet.select("token", F.col("own_group").alias("own"), "own_shortest", "group", "least", "most"), "groups-meeting")
    apart = meet.groupBy("own", "group", "own_shortest").agg(F.count("*").alias("c")).filter(F.col("c") >= need("own_shortest")).select("own", "group")
    between = meet.join(apart.hint("merge"), ["own", "group"], "left_semi").join(postings.withColumnRenamed("gkey", "own").hint("merge"), ["token", "own"]).filter(fit)
    rest = ask_all(alone).unionByName(qualified(between)).distinct()
    rest = written(rest.join(first.hint("merge"), ["cid", "gkey"], "left_anti"), "asked")
    if not rest.isEmpty():
        joined = components(edges.unionByName(compare(rest, members, sets)))

    roots = classes.join(joined.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("sig", "sig2", F.coalesce("root", "cid").alias("root"))
    out = rows.join(roots.hint("merge"), ["sig", "sig2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of the input that are the first of their component (by id); rows with a null id stay."""
    kept = similar_components(docs).filter("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    joined = docs.join(kept.hint("shuffle_hash"), docs["doc_id"] == kept["_kept"], "left")
    return joined.filter(F.col("_kept").isNotNull() | docs["doc_id"].isNull()).select(*(docs[c] for c in docs.columns))
