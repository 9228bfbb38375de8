"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every historical version of a file is a blob named by the SHA-256 of its text. The ledger records which
(blob, rule version) pairs have been scanned and what was found there. A scan addresses its input, takes
only the pairs that the ledger lacks, scans one copy of each such blob, and joins all findings back to
every path (here: document) that holds the blob.

Defined results: a null text is an empty one and has no findings; equal texts share one scan; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_of, written


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case, alike in every regular-expression engine."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"(?:{KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A key's first line, and then its lines up to the last one (with a few header lines, or line ends as \\n); where that one
#: is missing, the lines that follow and can be a key's.
PEM_BODY = "[A-Za-z0-9+/=\\x20\\x09-\\x0D:,\\\\]*"
PEM = f"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{PEM_BODY}(?:-[A-Za-z0-9]{PEM_BODY}){{0,16}}-----END [A-Z ]*PRIVATE KEY-----|(?:[\\x0A\\x0D]+[A-Za-z0-9+/=]+){{0,200}})"
#: name, pattern, text that must occur for a match ("": any), least length of the whole match, least length of the
#: value group. A run of too few characters can't hold a match for `access` and `hex`, so their least length stands
#: in the pattern; for `assign` it must not, since a short match still uses up its characters.
RULES = (
    ("assign", ASSIGN, "", 0, 6),
    ("access", "AKIA[A-Z0-9]{16,}", "AKIA", 20, 0),
    ("hex", "[0-9a-f]{24,}", "", 24, 0),
    ("pem", PEM, "-----BEGIN ", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", "eyJ", 0, 0),
    ("forge", "gh[opsu]_[A-Za-z0-9]{36,}", "gh", 0, 0),
)
RULE_VERSION = "2024-2"
BASE_KINDS = ("assign", "access", "hex")
FINDING = "array<struct<start:int,kind:int,end:int>>"
#: Matches that are folded together; arrays grow within such a block alone, so a text's time grows with its matches.
FOLD = 256


def bound(x: Column, use) -> Column:
    """use(x), with x evaluated once however often it is used."""
    return F.transform(F.array(x), use)[0]


def blocks_of(items: Column) -> Column:
    """A (not empty) array in blocks of FOLD."""
    return bound(items, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / FOLD).cast("int")), lambda i: F.slice(s, i * FOLD + 1, F.lit(FOLD))))


def matches(text: Column, rule: tuple, kind: int) -> Column:
    """Spans of a rule's matches. The pieces between matches and the matches alternate, so running sums of their
    lengths give the places (in code points)."""
    _, pattern, needs, whole, value = rule
    found = F.regexp_extract_all(text, F.lit(f"(?:{pattern})" if not value else pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if value else found
    pieces = F.split(text, pattern, -1)
    step = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FINDING})").alias("out"))

    def fold(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        keep = (F.length(x["hit"]) >= whole) & (F.length(x["value"]) >= value)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # spans within each block, then shifted by the lengths of the blocks before
    within = F.transform(blocks_of(step), lambda b: F.aggregate(b, start, fold))
    none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{FINDING}>)").alias("out"))

    def shifted(acc, x):
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    spans = F.when(text.rlike(pattern), F.aggregate(within, none, shifted, lambda acc: F.flatten(acc["out"])))
    if needs:
        spans = F.when(text.contains(needs), spans)
    return F.coalesce(spans, F.expr(f"cast(array() as {FINDING})"))


def scan(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(blob, text) -> (blob, findings sorted by start, then kind)."""
    every = F.concat(*(matches(F.col("text"), rule, k) for k, rule in enumerate(rules)))
    return blobs.select("blob", F.array_sort(every).alias("findings"))


def addressed(docs: DataFrame) -> DataFrame:
    return text_of(docs).select("doc_id", "text", F.sha2("text", 256).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """A copy of every blob that has no ledger entry under this rule version. Only ids and addresses are
    grouped; texts move once, to meet the id of the copy that is to be scanned. (Rows that repeat an id with
    its text give a blob twice; the ledger keeps one entry.)"""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id")
    named = addressed(docs).select(key, "text", "blob")
    chosen = named.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        chosen = chosen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob").hint("merge"), "blob", "left_anti")
    return named.join(chosen.hint("shuffle_hash"), ["doc_id", "blob"]).select("blob", "text")


def ledger_entries(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, findings), to be appended to the ledger; also for blobs without findings."""
    found = scan(unseen(docs, ledger, rule_version), rules).dropDuplicates(["blob"])
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def findings_by_path(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, findings) for every document; an empty array where its blob has none."""
    entries = ledger.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    named = addressed(docs).select("doc_id", "blob")
    joined = named.join(entries.hint("merge"), "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDING})")).alias("findings"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what is new, add it to the ledger, and return (doc_id, blob, findings) for every document."""
    new = written(ledger_entries(docs, ledger, rules, rule_version), "blob-ledger")
    return findings_by_path(docs, new if ledger is None else ledger.unionByName(new), rule_version)


def span_list(findings: Column, rules: tuple = RULES, kinds: tuple | None = None) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*(F.lit(r[0]) for r in rules))
    kept = findings if kinds is None else F.filter(findings, lambda x: F.element_at(names, x["kind"] + 1).isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple = RULES) -> DataFrame:
    names = [r[0] for r in rules]
    count = lambda name: F.size(F.filter("findings", lambda x: x["kind"] == names.index(name))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_list(F.col("findings"), rules, BASE_KINDS), 256).alias("base_sha256"),
        span_list(F.col("findings"), rules).alias("spans"),
    )


def masked(docs: DataFrame, found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The input with every found span of its text replaced by a mask; columns and null texts stay as they are.
    Overlapping spans become one mask. Rows with a null id stay as they are; rows that repeat an id are taken to
    repeat its text."""
    some = found.filter((F.size("findings") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_found_id"), F.col("findings").alias("_findings")).dropDuplicates(["_found_id"])
    # each block of findings, with the place that those before it reach, masks its own part of the text
    begun = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<at:int,own:{FINDING}>>)").alias("out"))
    reach = lambda b: F.array_max(F.transform(b, lambda x: x["end"]))
    placed = F.aggregate(blocks_of(F.col("_findings")), begun, lambda acc, b: F.struct(F.greatest(acc["at"], reach(b)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("own")))).alias("out")))

    def part(block):
        """The block's text from where it begins to its reach, masked."""
        chunk = F.substring(docs["text"], block["at"] + 1, F.greatest(block["at"], reach(block["own"])) - block["at"])
        start = F.struct(block["at"].alias("at"), F.lit("").alias("out"))

        def fold(acc, x, text):
            gap = F.substring(text, acc["at"] - block["at"] + 1, x["start"] - acc["at"])
            out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

        return bound(chunk, lambda text: F.aggregate(block["own"], start, lambda acc, x: fold(acc, x, text), lambda acc: acc["out"]))

    clean = bound(placed, lambda p: F.concat(F.array_join(F.transform(p["out"], part), ""), F.substring(docs["text"], p["at"] + 1, F.lit(2147483647))))
    joined = docs.join(some.hint("shuffle_hash"), docs["doc_id"] == some["_found_id"], "left")
    return joined.select(*(F.when(F.col("_findings").isNotNull(), clean).otherwise(docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns))
