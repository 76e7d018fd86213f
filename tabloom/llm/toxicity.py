"""Toxicity (2): gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The trees are fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`), two thirds for the trees and a third for the
calibration; scoring covers all rows. The lexicon is a seed list plus words that toxic texts use and clean texts don't,
learned from the trees' two thirds alone, so that the calibration sees features as they are on unseen texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, drop_ids

#: Labelled rows that the lexicon, the trees and the calibration are fitted on, at most (in expectation).
SAMPLE_ROWS = 12_000
TREES, DEPTH = 20, 3
#: A learned word: at least this many of the sample's toxic texts, this log odds ratio, so many words at most.
LEAST_TOXIC_TEXTS, LEAST_LOG_ODDS, MOST_WORDS = 5, 3.0, 200
SEED_LEXICON = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns imbecile fool fools jerk jerks vermin filth garbage hate shutup bastard bitch crap damn".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre tu toi vous votre vos te ton ta tes du dich dir dein deine sie ihr euch usted ustedes ti tus su vosotros".split())
FEATURES = ("lexicon", "lexicon_log", "learned", "learned_log", "hidden", "near_you", "you", "capitals", "marks", "obfuscated", "stretched", "log_words", "distinct")
#: Signs that stand for letters in obfuscated words.
_LEET = str.maketrans("013457@$!|", "oieastasii")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$~|-_/\\…«»“”„"
_LETTERS = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Bytes of texts whose words are judged together.
AT_ONCE = 2_000_000
#: Words on either side within which a second person counts as near.
NEAR = 4


class _Kinds(dict):
    """word without edges -> (number, kind); starts anew after `bound` words, so that memory stays bounded."""

    bound = 60_000

    def __init__(self, learned: frozenset[str]):
        super().__init__()
        self.learned = learned
        self.numbers: dict[str, int] = {}

    def __missing__(self, word: str) -> tuple[int, int]:
        w = word.strip(_EDGE)
        self[word] = found = self.numbers.setdefault(w, len(self.numbers)), self._kind(w)
        return found

    def _kind(self, w: str) -> int:
        if w in SEED_LEXICON:
            return SEED
        if w in self.learned:
            return LEARNED
        if w in SECOND_PERSON:
            return YOU
        if w and not w.isalpha():
            plain = "".join(_LETTERS.findall(w.translate(_LEET)))
            return ODD_HIDDEN if plain in SEED_LEXICON or plain in self.learned else ODD
        if len(w) > 3 and _STRETCHED.search(w):
            plain = _STRETCHED.sub(r"\1", w)
            return STRETCHED_HIDDEN if plain in SEED_LEXICON or plain in self.learned else STRETCHED
        return PLAIN


#: What a word is.
PLAIN, SEED, LEARNED, YOU, ODD, ODD_HIDDEN, STRETCHED, STRETCHED_HIDDEN = range(8)


def features(texts: list[str | None] | pa.Array, kinds: _Kinds) -> np.ndarray:
    """A row of dense features for each whole text; null, empty and wordless texts have zeros.

    Arrow cuts the texts and finds the distinct words; each of these is judged once."""
    column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    n = len(column)
    cut_words = pc.utf8_split_whitespace(pc.utf8_lower(column))
    offsets = np.asarray(cut_words.offsets)
    coded = cut_words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    if len(kinds) > kinds.bound:
        kinds.clear()
        kinds.numbers.clear()
    distinct = coded.dictionary.to_pylist()
    judged = np.array([kinds[w] if w else (-1, -1) for w in distinct], np.int64).reshape(-1, 2)
    number, kind = judged[np.asarray(coded.indices)].T if len(coded) else np.empty((2, 0), np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    real = number >= 0  # ends of texts leave empty words
    number, kind, doc = number[real], kind[real], doc[real]
    count = lambda *which: np.bincount(doc[np.isin(kind, which)], minlength=n).astype(np.float64)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    place = np.arange(len(doc)) + doc * (2 * NEAR + 1)  # words of two texts are never near
    rude = np.isin(kind, (SEED, LEARNED, ODD_HIDDEN, STRETCHED_HIDDEN))
    hit, you = place[rude], place[kind == YOU]
    close = np.zeros(len(hit), bool)
    if len(you):
        at = np.searchsorted(you, hit - NEAR)
        close = (at < len(you)) & (you[np.minimum(at, len(you) - 1)] <= hit + NEAR)
    near = np.bincount(doc[rude][close], minlength=n).astype(np.float64)
    pairs = np.unique(doc * (int(number.max()) + 1 if len(number) else 1) + number)
    different = np.bincount(pairs // (int(number.max()) + 1), minlength=n) if len(number) else np.zeros(n)
    hits, hidden, seeds = count(SEED, ODD_HIDDEN, STRETCHED_HIDDEN), count(ODD_HIDDEN, STRETCHED_HIDDEN), count(SEED, LEARNED)
    length = np.maximum(np.asarray(pc.utf8_length(column)), 1)
    signs = lambda pattern: np.asarray(pc.count_substring_regex(column, pattern))
    some = np.maximum(words, 1)
    made = (
        100 * hits / some, np.log1p(hits), 100 * seeds / some, np.log1p(seeds), 100 * hidden / some, 100 * near / some, 100 * count(YOU) / some, signs(r"\p{Lu}") / length,
        signs("[!?]") / length, count(ODD, ODD_HIDDEN) / some, count(STRETCHED, STRETCHED_HIDDEN) / some, np.log1p(words), different / some,
    )
    return np.where(words[:, None] > 0, np.column_stack(made), 0.0)


def _feature_batches(batches: Iterator[pa.RecordBatch], learned: frozenset[str]) -> Iterator[pa.RecordBatch]:
    kinds = _Kinds(learned)
    for batch in batches:
        text, rows = batch.column("text"), []
        lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0))
        lo = 0
        while lo < len(lengths):  # texts of AT_ONCE bytes together, or one
            hi = lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]), AT_ONCE)))
            rows.append(features(text.slice(lo, hi - lo), kinds))
            lo = hi
        flat = pa.array(np.concatenate([np.empty((0, len(FEATURES))), *rows]).reshape(-1))
        made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [made], [*batch.schema.names[:-1], "f"])


def with_features(rows: DataFrame, keep: list[str], learned: frozenset[str]) -> DataFrame:
    """keep and f, the features of column text."""
    kept = ", ".join(f"{c} {t}" for c, t in rows.select(keep).dtypes)
    return rows.select(*keep, "text").mapInArrow(partial(_feature_batches, learned=learned), f"{kept}, f array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class ToxicityModel:
    learned: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each row: doc_id, score (0 to 1). Null texts count as empty. Without a fitted model: 0."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(0.0).alias("score"))
        made = with_features(rows, ["doc_id"], self.learned).withColumn("features", array_to_vector("f"))
        found = self.calibration.transform(_raw(self.trees.transform(made)))
        # where the calibration is flat, the trees still order the rows
        score = F.least(F.greatest(0.999 * F.col("calibrated") + 0.001 * F.col("p"), F.lit(0.0)), F.lit(1.0))
        return found.select("doc_id", score.alias("score"))


def _raw(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1])


def _learn_words(sample: DataFrame) -> frozenset[str]:
    """Words of toxic texts that clean texts lack; equal texts count once."""
    once = sample.dropDuplicates(["text"])
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    counts = once.select("toxic", word.alias("word")).where(F.length("word").between(3, 40))
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return frozenset()
    by = counts.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (totals[1] + 1)) - F.log((F.col("good") + 0.5) / (totals[0] + 1))
    best = by.where(F.col("bad") >= LEAST_TOXIC_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    return frozenset(r["word"] for r in best.orderBy(F.desc("odds"), "word").limit(MOST_WORDS).collect())


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled documents outside held_out. Labels other than 0 and 1, null ids and null texts teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return ToxicityModel(frozenset(), None, None)
    share = int(min(1.0, SAMPLE_ROWS / total) * 10**6)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(10**6)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = cut(texts.join(known, "doc_id"), "labelled")
    third = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0  # for the calibration: neither words nor trees see it
    learned = _learn_words(sample.where(~third))
    made = with_features(sample, ["doc_id", "toxic"], learned).withColumn("label", F.col("toxic").cast("double"))
    made = cut(made, "features").withColumn("features", array_to_vector("f"))
    classes = {r[0] for r in made.where(~third).select("label").distinct().collect()}
    if len(classes) < 2:
        return ToxicityModel(learned, None, None)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7, checkpointInterval=-1).fit(made.where(~third).select("features", "label"))
    rest = made.where(third)
    rest = made if rest.isEmpty() else rest
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(_raw(trees.transform(rest)).select("p", "label"))
    return ToxicityModel(learned, trees, calibration)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Labels teach and are no inputs of a score; texts without words have features of zero and a score like any other.
    Repeated rows and null ids are scored too. Without labels of both classes the score is 0. An empty table gives an
    empty table.
    """
    out = fit(docs, labels).score(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns unchanged. Rows with a null id stay."""
    return drop_ids(docs, toxicity(docs, labels).where("predicted = 1").select("doc_id"))
