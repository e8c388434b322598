"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import batches, pin

SAMPLE_ROWS = 20_000  # labelled documents learned from, at most
LEXICON_ROWS = 4_000  # entries of the learned lexicon, at most
LEXICON_DOCS = 5  # toxic documents an entry must occur in
LEXICON_ODDS = 6.0  # times as frequent in toxic documents as in others
STEMS = (4, 5, 6)  # words also count by their first so many letters
NEAR = 6  # words between an insult and a second person

# fixed values: insults and second persons of the languages at hand
INSULTS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb".split())
SECOND = frozenset("you your yours u du dich dir dein ihr sie tu te toi vous votre usted ti tus vosotros".split())
LEET = str.maketrans("013457@$", "oieastas")

_EDGE = re.compile(r"^\W+|\W+$")
_INSIDE = re.compile(r"[^\W\d_][\d@$*#%&!.\-_]+[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_CAPITAL = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]+")
_MARK = re.compile(r"[^\w\s]+")
_SAME = re.compile(r"(.)\1\1")


def forms(word: str) -> tuple[str, str]:
    """A word in lower case without marks at its ends, and with disguises undone."""
    plain = _EDGE.sub("", word.lower())
    shown = plain if plain.isalpha() else "".join(c for c in plain.translate(LEET) if c.isalpha())
    return plain, shown


def entries(word: str) -> list[str]:
    """What a word can match in the lexicon: itself and, marked by a star, its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Dense features of a whole text; zeros for a null or blank one.

    Lexicon densities (learned, fixed, strongest, disguised), proximity to a second
    person, rates of capitals, punctuation, repeated letters and disguise, and length.
    """
    words = (text or "").split()
    if not words:
        return [0.0] * 12
    weights: dict[str, tuple[float, bool, bool, bool]] = {}
    learned = fixed = hidden = strongest = 0.0
    hits, persons = [], []
    for at, word in enumerate(words):
        known = weights.get(word)
        if known is None:
            plain, shown = forms(word)
            weight = max((lexicon.get(e, 0.0) for e in entries(shown)), default=0.0)
            known = weights[word] = (weight, shown in INSULTS, shown != plain, plain in SECOND)
        weight, insult, disguised, person = known
        if weight or insult:
            hits.append(at)
            learned += weight
            fixed += insult
            hidden += disguised
            strongest = max(strongest, weight)
        if person:
            persons.append(at)
    near, k = 0, 0
    for at in hits:
        while k < len(persons) and persons[k] < at - NEAR:
            k += 1
        near += k < len(persons) and persons[k] <= at + NEAR
    n, chars = len(words), len(text)
    only = _OTHER.sub("", text)
    letters = max(1, len(only))
    capitals = letters - len(_CAPITAL.sub("", only))
    marks = chars - len(_MARK.sub("", text))
    return [learned / n, float(len(hits)), fixed / n, strongest, hidden / n, near / n, len(persons) / n,
            capitals / letters, marks / chars, text.count("!") / chars,
            len(_SAME.findall(text)) / chars + len(_INSIDE.findall(text)) / n, float(n)]


def _entry_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shown = {forms(w)[1] for w in set((text or "").split())}
            counts[toxic].update({e for w in shown if w for e in entries(w)})
        names = sorted(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][e] for e in names], pa.int64()),
             pa.array([counts[0][e] for e in names], pa.int64())], names=["entry", "toxic", "other"])


def _features(rows: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        at = batch.schema.get_field_index("text")
        made = [features(t, lexicon.value) for t in batch.column(at).to_pylist()]
        kept = [k for k in range(batch.num_columns) if k != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), pa.array(made, pa.list_(pa.float64()))],
            names=[*(batch.schema.names[k] for k in kept), "dense"])


class Scorer:
    """A fitted lexicon, boosted trees and calibration; a constant where labels do not suffice."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None,
                 calibration: IsotonicRegressionModel | None, constant: float):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, documents: DataFrame) -> DataFrame:
        """One row per document: ``doc_id``, ``score`` and its ``dense`` features; only texts are looked at."""
        lexicon = documents.sparkSession.sparkContext.broadcast(self.lexicon)  # LEXICON_ROWS entries at most
        made = batches(documents.select("doc_id", "text")).mapInArrow(
            partial(_features, lexicon=lexicon), "doc_id bigint, dense array<double>")
        if self.trees is None:
            return made.select("doc_id", F.lit(self.constant).alias("score"), "dense")
        return self._calibrated(made).select("doc_id", "score", "dense")

    def _raw(self, made: DataFrame) -> DataFrame:
        scored = self.trees.transform(made.withColumn("features", array_to_vector("dense")))
        return scored.withColumn("raw", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    def _calibrated(self, made: DataFrame) -> DataFrame:
        return self.calibration.transform(self._raw(made)).withColumn(
            "score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))


def fit(documents: DataFrame, labels: DataFrame, fold, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn from at most ``sample_rows`` labelled documents, chosen by a hash of their id.

    ``fold`` is a column over doc_id: folds 1 and 2 give the lexicon, 3 the trees and 4
    the calibration, so that none is fitted on what the one before has seen; 0 is left
    out. If a fold lacks one of the labels, all learn from all. Labels that are null
    are left out, and a document with several counts as toxic if one says so.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").withColumn("fold", fold).where("fold > 0")
              .groupBy("doc_id", "fold").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    chosen = pin(chosen)
    sizes = {(r[0], r[1]): r[2] for r in chosen.groupBy("fold", "toxic").count().collect()}
    of = lambda toxic, *folds: sum(sizes.get((f, toxic), 0) for f in folds)
    folds = {"lexicon": (1, 2), "trees": (3,), "calibration": (4,)}
    if not all(of(t, *f) for f in folds.values() for t in (0, 1)):
        folds = dict.fromkeys(folds, (1, 2, 3, 4))
    bad, good = of(1, 1, 2, 3, 4), of(0, 1, 2, 3, 4)
    sample = batches(documents.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")  # sample_rows at most
    counted = (sample.where(F.col("fold").isin(*folds["lexicon"])).select("text", "toxic")
               .mapInArrow(_entry_counts, "entry string, toxic long, other long")
               .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    bad_docs, good_docs = of(1, *folds["lexicon"]), of(0, *folds["lexicon"])
    odds = ((F.col("toxic") + 0.5) / (bad_docs + 1)) / ((F.col("other") + 0.5) / (good_docs + 1))
    top = (counted.where(F.col("toxic") >= LEXICON_DOCS).select("entry", F.log(odds).alias("weight"))
           .where(F.col("weight") >= math.log(LEXICON_ODDS)).orderBy(F.desc("weight"), "entry").limit(LEXICON_ROWS).collect())
    lexicon = {r[0]: r[1] for r in top}
    if not bad or not good:
        return Scorer(lexicon, None, None, bad / (bad + good) if bad + good else 0.0)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    made = pin(sample.select("toxic", "fold", "text").mapInArrow(
        partial(_features, lexicon=shared), "toxic int, fold int, dense array<double>").coalesce(4))
    grown = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=4, stepSize=0.2, seed=42).fit(
        made.where(F.col("fold").isin(*folds["trees"])).withColumn("features", array_to_vector("dense")))
    scorer = Scorer(lexicon, grown, None, 0.0)
    raw = scorer._raw(made.where(F.col("fold").isin(*folds["calibration"])))
    scorer.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(
        raw.withColumn("toxic", F.col("toxic").cast("double")))
    return scorer
