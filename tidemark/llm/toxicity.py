"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Labelled rows are split by crc32(doc_id) mod 5. 0 is held out and never learnt from;
1 and 2 give a lexicon, the words and word beginnings that toxic texts have far more
often; 3 trains the trees on features, the lexicon's densities among them; 4 calibrates
the trees' probabilities. So no stage learns from what the one before has already seen,
and all documents are scored on the features that trees and curve were fitted to.
MOST_LABELLED bounds the labelled doc_ids used; all others are scored only. Learning also
needs some rows of either kind: without them the share of toxic labels is every score.

Defined results: null and empty texts have zero features and the score of those; several
labels of a doc_id count as toxic if one is; repeated rows each give a row, with one
score; a null doc_id is not held out and has no label; equal texts have equal scores; an
empty table gives none; other columns are ignored, labels, lang and source among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import texts, written
from tidemark.llm.words import release

MOST_LABELLED = 60_000
LEAST_TOXIC_DOCS = 3
LEAST_LOG_ODDS = 2.0
STEMS = (4, 5)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 3
FEATURES = (
    "words", "hits", "hit_density", "weight_density", "heaviest", "kinds", "near_second_person", "second_person", "capitals", "shouting", "exclamations",
    "punctuation", "obfuscated", "stretched", "mean_length",
)
_WORD = re.compile(r"\w+")
_HIDDEN = re.compile(r"[A-Za-z][@$*0-9!#]+[A-Za-z]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_UPPER, _MARKS = bytes(range(65, 91)), bytes(b for b in range(33, 127) if not chr(b).isalnum())


def terms(word: str) -> list[str]:
    """A word, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """(text, toxic) to the log odds of the terms that tell toxic texts. Bounded by the labelled sample: a term is in LEAST_TOXIC_DOCS of its toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                count: dict[str, list[int]] = {}
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for term in {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}:
                        count.setdefault(term, [0, 0])[toxic] += 1
                if count:
                    yield pa.record_batch([pa.array(list(count)), pa.array([c[1] for c in count.values()], pa.int64()), pa.array([c[0] for c in count.values()], pa.int64())], ["term", "toxic", "clean"])

    size = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(size.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(size.get(0, 0) + 1.0))
    found = (
        labelled.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_TOXIC_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    )
    return {r["term"]: r["odds"] for r in found.select("term", "odds").collect()}


class _Weights(dict):
    """Word to its weight: above 0 in the lexicon, -1 for the second person. Remembers words up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        found = [self.lexicon[t] for t in terms(word) if t in self.lexicon]
        self[word] = value = max(found) if found else -1.0 if word in SECOND_PERSON else 0.0
        return value


def features(text: str, weights: _Weights) -> list[float]:
    raw, own = text.encode(), _WORD.findall(text.lower())
    n = max(1, len(own))
    w = np.fromiter(map(weights.__getitem__, own), np.float64, len(own))
    hit, you = np.flatnonzero(w > 0), np.flatnonzero(w < 0)
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.minimum(at, len(you) - 1)]), np.abs(hit - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    size = max(1, len(raw))
    return [
        float(np.log1p(len(own))), float(np.log1p(len(hit))), len(hit) / n, float(w[hit].sum()) / n, float(w[hit].max(initial=0.0)), float(len({own[i] for i in hit.tolist()})),
        near / n, len(you) / n, (len(raw) - len(raw.translate(None, _UPPER))) / size, len(_SHOUT.findall(text)) / n, (text.count("!") + text.count("?")) / size,
        (len(raw) - len(raw.translate(None, _MARKS))) / size, len(_HIDDEN.findall(text)) / n, len(_STRETCHED.findall(text)) / n, sum(map(len, own)) / n,
    ]


def feature_rows(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """docs with the feature vector x instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names).withColumn("x", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = [features(t or "", weights) for t in part.column("text").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])
        release()

    return docs.mapInArrow(run, schema)


def fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = texts(df, key, text)
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where("toxic in (0, 1)").withColumn("fold", fold("doc_id")).where("fold > 0")
    share = min(1.0, most / max(1, known.count()))
    known = written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    # about most rows of three numbers: small enough to send to each executor, so that no text is shuffled
    labelled = docs.join(F.broadcast(known), "doc_id")
    words = lexicon(labelled.where("fold in (1, 2)"))
    learn = written(feature_rows(labelled.where("fold in (3, 4)"), words)).coalesce(4).withColumn("features", array_to_vector("x")).withColumn("label", F.col("toxic").cast("double"))
    kinds = {(r["fold"], r["toxic"]): r["n"] for r in learn.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    if not all(kinds.get((f, t)) for f in (3, 4) for t in (0, 1)):
        base = sum(n for (_, t), n in kinds.items() if t) / max(1, sum(kinds.values()))
        scored = rows.select("doc_id", "held_out", F.lit(float(base)).alias("score"))
    else:
        trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=11, cacheNodeIds=False).fit(learn.where("fold = 3"))
        chance = lambda d: trees.transform(d).withColumn("chance", vector_to_array("probability")[1])
        curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(chance(learn.where("fold = 4")).select("chance", "label"))
        x = feature_rows(rows, words).withColumn("features", array_to_vector("x"))
        scored = curve.transform(chance(x).select("doc_id", "held_out", "chance")).select("doc_id", "held_out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
