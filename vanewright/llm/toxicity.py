"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: counts and densities of words from a lexicon (a fixed one of common insults, and one learned from
labels), how many of them stand near a second-person pronoun, the weights of learned words, rates of capitals, of
words all in capitals, of punctuation and exclamation marks, and of obfuscated words (letters written as digits or
symbols). They are made in Arrow tasks; trees and calibration are fitted and applied by Spark.

The model is fitted on a bounded sample of labelled rows: the `most_rows` with the least hash of their ids. Four
fifths grow the trees, one fifth calibrates them (all rows do, where that fifth has fewer than LEAST_HELD of either
kind). Rows are taken in order of ids into one partition, so that every run fits the same trees. The learned lexicon
holds every word that marks toxic texts of the sample. Such a word is in at least LEAST_TEXTS of them and in the share
LEAST_SHARE of them, so there are at most 1 / LEAST_SHARE times as many (50) as a toxic text has distinct words on
average: a bound that follows from the sample's texts and not from their number.

Defined results: a null text is an empty one, and empty texts have a score too; very long texts are taken whole, each
alone in its slice; where hashes of ids tie at the edge of the sample, smaller ids are in it; without labels of both kinds the score
is the share of toxic labels (0 without any); several labels of one document count as toxic if one is; rows that repeat
an id are each scored; null ids are scored and never learned from; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import text_of, written

MOST_ROWS, TREES, DEPTH, STEP, SEED = 20_000, 20, 4, 0.3, 7
#: Texts of either kind that the calibrating fifth has at least.
LEAST_HELD = 10
#: A learned word is in so many toxic texts (a number, and a share of them), and its share of toxic ones has this lower bound.
LEAST_TEXTS, LEAST_SHARE, LEAST_BOUND = 5, 0.02, 0.5
#: Words between a hit and a pronoun near it.
NEAR = 5
#: Common insults and threats.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass trash garbage scum loser losers clown clowns pathetic worthless disgusting "
    "imbecile retard retarded jerk bastard bitch asshole shit shitty fuck fucking crap filth filthy vermin pig swine ugly "
    "hate kill die shut freak creep coward liar fool foolish braindead subhuman "
    "dumm dumme dummkopf arschloch scheisse idiota imbecil estupido estupida basura mierda puta connard salope merde debile"
).split()
#: Second-person pronouns.
SECOND_PERSON = "you your yours yourself u ur youre tu te toi ton vous votre du dich dir dein ihr euch usted tus ti vosotros".split()
#: Letters that digits and symbols stand for.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}

FEATURES = "words hits density kinds insults near weight most_weight capitals shouted marks exclaims masked mixed".split()

APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
APART_LOOSE = APART.copy()
APART_LOOSE[[ord(c) for c in "@$!*"]] = False
UNMASK = K.LOWER.copy()
for _sign, _letter in LOOKALIKES.items():
    UNMASK[ord(_sign)] = ord(_letter)
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in LOOKALIKES]] = 1
CAPITAL, LETTER, MARK = (np.zeros(256, np.int64) for _ in range(3))
CAPITAL[65:91] = 1
LETTER[65:91] = LETTER[97:123] = 1
MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1


def codes_of(words: list[str]) -> np.ndarray:
    """Codes of words as the kernels give them, sorted."""
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = K.words(buf, np.array([0, len(buf)]))
    return np.unique(K.word_codes(buf, s, e))


def starred(words: list[str]) -> list[str]:
    """The words with any run of letters after the first one written as stars."""
    return [w[:i] + "*" * (j - i) + w[j:] for w in words if len(w) > 3 for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)]


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def lexical_words(buf: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = K.words(buf, where, APART)
    return K.word_codes(K.LOWER[buf], s, e), s, e, first


def per_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[first])


class Lexicon:
    """Codes of insults and pronouns, and learned codes with weights."""

    def __init__(self, learned: np.ndarray, weights: np.ndarray):
        order = np.argsort(learned)
        self.learned, self.weights = learned[order], weights[order]
        self.insults, self.you = codes_of(INSULTS), codes_of(SECOND_PERSON)
        self.bad = np.unique(np.concatenate((self.insults, self.learned)))
        #: as they look once signs are letters again; a star may be any letter of an insult
        self.hidden = np.unique(np.concatenate((self.bad, codes_of(starred(INSULTS)))))

    def features(self, buf: np.ndarray, where: np.ndarray) -> np.ndarray:
        """One row of FEATURES per text."""
        rows = len(where) - 1
        code, s, e, first = lexical_words(buf, where)
        n = np.diff(first)
        size = np.maximum(n, 1)
        hit = among(code, self.bad)
        at = np.flatnonzero(hit)
        row = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(np.stack((row.astype(np.uint64), code[at])), axis=1)[0].astype(np.int64) if len(at) else row
        weight = np.zeros(len(code))
        if len(self.learned) and len(at):
            spot = np.minimum(np.searchsorted(self.learned, code[at]), len(self.learned) - 1)
            weight[at] = np.where(self.learned[spot] == code[at], self.weights[spot], 0)
        most = np.zeros(rows)
        np.maximum.at(most, row, weight[at])
        you = np.concatenate(([0], np.cumsum(among(code, self.you))))
        low = np.maximum(at - NEAR, first[row]) if len(at) else at
        high = np.minimum(at + NEAR + 1, first[row + 1]) if len(at) else at
        near = np.bincount(row[you[high] > you[low]], minlength=rows)
        total = np.maximum(np.diff(where), 1)
        caps, letters = per_row(where, CAPITAL[buf]), per_row(where, LETTER[buf])
        cap = np.concatenate(([0], np.cumsum(CAPITAL[buf])))
        shouted = (e - s > 1) & (cap[e] - cap[s] == e - s)
        # words whose letters are partly written as signs, and those of them that are in the lexicon once rewritten
        ls, le, lfirst = K.words(buf, where, APART_LOOSE)
        sign = np.concatenate(([0], np.cumsum(SYMBOL[buf])))
        letter = np.concatenate(([0], np.cumsum(LETTER[buf])))
        inner = (le - ls > 2) & (letter[le] > letter[ls])
        inner[inner] = sign[le[inner] - 1] > sign[ls[inner]]
        mixed = np.flatnonzero(inner)
        masked = np.zeros(len(ls), bool)
        if len(mixed):
            masked[mixed] = among(K.word_codes(UNMASK[buf], ls[mixed], le[mixed]), self.hidden)
        columns = (
            np.log1p(n), per_row(first, hit), per_row(first, hit) / size, np.bincount(pairs, minlength=rows), per_row(first, among(code, self.insults)),
            near, per_row(first, weight), most, caps / np.maximum(letters, 1), per_row(first, shouted) / size,
            per_row(where, MARK[buf]) / total, per_row(where, buf == 33) / total, per_row(lfirst, masked), per_row(lfirst, inner) / size,
        )
        return np.stack([np.asarray(c, float) for c in columns], 1)


def feature_rows(lexicon, kept: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, where in K.text_slices(batch.column("text")):
                values = lexicon.value.features(buf, where)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in kept), *map(pa.array, values.T.copy())], [*kept, *FEATURES])

    return run


SCHEMA = ", ".join(f"{c} double" for c in FEATURES)


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for i, j, buf, where in K.text_slices(batch.column("text")):
            code, _, _, first = lexical_words(buf, where)
            row = np.repeat(np.arange(j - i), np.diff(first)).astype(np.uint64)
            row, code = np.unique(np.stack((row, code)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(code)), pa.array(toxic[i:j][row.astype(np.int64)])], ["code", "toxic"])


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words that mark toxic texts, from (text, toxic) rows; equal texts count once. What comes to the driver is bounded
    as said above, since a word has to be in a share of all toxic texts."""
    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n, t = texts.agg(F.count("*"), F.sum("toxic")).first()
    t = t or 0
    counts = texts.mapInArrow(distinct_words, "code long, toxic int").groupBy("code").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    share, z = F.col("t") / F.col("n"), 1.96
    bound = (share + z * z / (2 * F.col("n")) - z * F.sqrt((share * (1 - share) + z * z / (4 * F.col("n"))) / F.col("n"))) / (1 + z * z / F.col("n"))
    rows = counts.filter((F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * t)) & (bound >= LEAST_BOUND)).orderBy(F.desc("t"), "code").collect()
    code = np.array([r["code"] for r in rows], np.int64).view(np.uint64)
    bad, good = np.array([r["t"] for r in rows], float), np.array([r["n"] - r["t"] for r in rows], float)
    return Lexicon(code, np.log((bad + 0.5) / (t + 1)) - np.log((good + 0.5) / (n - t + 1)))


class Scorer:
    """A fitted model; score() adds its calibrated probability."""

    def __init__(self, lexicon: Lexicon, trees, isotonic, prior: float):
        self.lexicon, self.trees, self.isotonic, self.prior = lexicon, trees, isotonic, prior

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score)."""
        texts = text_of(docs)
        if self.trees is None:
            return texts.select("doc_id", F.lit(self.prior).alias("score"))
        lexicon = texts.sparkSession.sparkContext.broadcast(self.lexicon)
        made = texts.mapInArrow(feature_rows(lexicon), f"doc_id long, {SCHEMA}")
        made = self.trees.transform(assembler().transform(made)).select("doc_id", raw_probability().alias("raw"))
        made = self.isotonic.transform(made)
        return made.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))


# Spark's estimators are imported where they are used: tasks import this module too and don't need them
def assembler():
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def raw_probability() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Scorer:
    """A model from the labels (doc_id, toxic) given; leave out of them what is to be held out."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.withColumn("_order", F.xxhash64("doc_id", F.lit(SEED))).orderBy("_order", "doc_id").limit(most_rows).select("doc_id", "toxic")
    # at most most_rows ids and labels, so the texts need not move
    sample = written(text_of(docs).join(F.broadcast(marks), "doc_id"), "labelled-texts")
    n, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return Scorer(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(bad or 0) / max(n, 1))
    lexicon = learned_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = sample.mapInArrow(feature_rows(shared, ("doc_id", "toxic")), f"doc_id long, toxic int, {SCHEMA}")
    # most_rows rows of a few numbers each
    rows = rows.coalesce(1).sortWithinPartitions("doc_id", "toxic", *FEATURES)
    rows = written(assembler().transform(rows).select("doc_id", "features", F.col("toxic").cast("double").alias("label")), "labelled-features")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)) == 0
    grow, hold = rows.filter(~fifth), rows.filter(fifth)
    if grow.select("label").distinct().count() < 2:
        grow = rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(grow)
    m, bad_held = hold.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    held = hold if min(bad_held, m - bad_held) >= LEAST_HELD else rows
    raw = trees.transform(held).select("label", raw_probability().alias("raw"))
    return Scorer(lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw), float(bad) / n)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the rows that are not held out."""
    model = fit(docs, labels.filter(~held_out(5, 0)), most_rows)
    return model.score(docs).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of the input whose text scores below the threshold. Rows of one id are told apart by nothing else, so
    they go together if one of them does; rows with a null id stay."""
    bad = fit(docs, labels, most_rows).score(docs).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("_toxic")).filter("_toxic is not null").distinct()
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"] == bad["_toxic"], "left_anti")
