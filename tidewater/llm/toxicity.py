"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is; only documents have labels."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches

#: A sentence ends at one of these.
SENTENCE_END = re.compile(r"[.!?\n]+")
#: What stands around a word and is no part of it.
EDGE = " \t\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|-_"
PREFIXES = (4, 5, 6)
SENTENCES = "array<struct<sentence:int,start:int,length:int,probability:double>>"


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the classifier is fitted on, and of the model: labelled documents of each class, chosen
    by hash, and features (of chi-square `evidence` at least). The sample goes to the driver; nothing else does.
    """

    per_class: int = 1500
    features: int = 4096
    evidence: float = 12.0
    rounds: int = 300
    rate: float = 0.1
    decay: float = 1e-4


@dataclass(frozen=True)
class SentenceModel:
    """Weights of words and word beginnings; a sentence's probability is the logistic of the sum over its different words."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word)) if self.weights else 0.0


class Scorer:
    """A model with the weights of the words it has met."""

    def __init__(self, model: SentenceModel, memory: int = 150_000):
        self.model, self.memory = model, memory
        self.words: dict[str, float] = {}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, length and logit of each sentence that has a word."""
        if len(self.words) > self.memory:
            self.words.clear()
        words, found, start = self.words, [], 0
        for end, following in [*((m.start(), m.end()) for m in SENTENCE_END.finditer(text)), (len(text), 0)]:
            total, some = self.model.bias, False
            for word in dict.fromkeys(text[start:end].split()):
                some = True
                weight = words.get(word)
                if weight is None:
                    weight = words[word] = self.model.word_weight(word)
                total += weight
            if some:
                found.append((start, end - start, total))
            start = following
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and the sentences with their probabilities."""
        found = self.sentences(text)
        if not found:
            return 0.0, []
        logits = np.array([z for _, _, z in found])
        score = -np.expm1(-np.logaddexp(0.0, logits).sum())
        return float(score), found


def features_of(word: str) -> list[str]:
    """The word without case and edges, and its beginnings, which inflected words share."""
    bare = word.strip(EDGE).lower()
    if not bare:
        return []
    return [bare, *(f"{bare[:k]}*" for k in PREFIXES if len(bare) > k)]


def fit(texts: list[str], labels: list[int], training: Training) -> SentenceModel:
    """Noisy-or likelihood of the document labels, by Adam over all sentences that have a chosen feature.

    Chosen are the features whose presence in documents tells the classes apart best (chi-square). With one class only
    there is nothing to learn, and every score is 0.
    """
    target = np.array(labels, dtype=np.float64)
    if not len(target) or target.min() == target.max():
        return SentenceModel()
    positive, negative = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        seen = {f for word in set(text.split()) for f in features_of(word)}
        (positive if label else negative).update(seen)
    with_label, without = target.sum(), len(target) - target.sum()
    gain = {}
    for feature, a in positive.items():
        b = negative.get(feature, 0)
        if a >= 3 and a / with_label > b / without:
            spread = (a + b) * (len(target) - a - b + 1) * with_label * without
            gain[feature] = len(target) * (a * (without - b) - b * (with_label - a)) ** 2 / spread
    chosen = sorted((f for f in gain if gain[f] >= training.evidence), key=lambda f: (-gain[f], f))[: training.features]
    number = {f: k for k, f in enumerate(chosen)}
    where, what, document, empty = [], [], [], np.zeros(len(texts))
    for k, text in enumerate(texts):
        for sentence in SENTENCE_END.split(text):
            own = [number[f] for word in sorted(set(sentence.split())) for f in features_of(word) if f in number]
            if own:
                what += own
                where += [len(document)] * len(own)
                document.append(k)
            elif sentence.split():
                empty[k] += 1
    what, where, document = (np.array(x, dtype=np.int64) for x in (what, where, document))
    weights, bias = np.zeros(len(chosen)), -4.0
    moments = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, training.rounds + 1):
        logits = bias + np.bincount(where, weights=weights[what], minlength=len(document))
        hidden = np.bincount(document, weights=np.logaddexp(0, logits), minlength=len(texts)) + empty * np.logaddexp(0, bias)
        odds = 1 / np.maximum(np.expm1(np.minimum(hidden, 50)), 1e-9)
        slope = (1 - target) - target * odds
        inner = slope[document] / (1 + np.exp(-logits))
        gradient = np.bincount(what, weights=inner[where], minlength=len(chosen)) / len(texts) + training.decay * weights
        base = (inner.sum() + (slope * empty).sum() / (1 + np.exp(-bias))) / len(texts)
        full = np.append(gradient, base)
        moments = [0.9 * moments[0] + 0.1 * full, 0.99 * moments[1] + 0.01 * full**2]
        move = training.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return SentenceModel({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-3}, float(bias))


def train(documents: DataFrame, labels: DataFrame, training: Training = Training(), text: str = "text", identifier: str = "doc_id") -> SentenceModel:
    """Fit on `labels` (identifier, label 0/1) joined with documents: per class, the identifiers of smallest hash.

    The identifiers are chosen from the labels alone, so at most twice per_class rows meet the documents. Labels without
    a document, null labels and null identifiers are left out; of repeated labels the largest counts, of repeated
    documents the smallest text.
    """
    rows = documents.select(F.col(identifier).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    clean = labels.select(F.col(identifier).alias("_id"), F.col("label").cast("int").alias("label")).dropna()
    single = clean.groupBy("_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = single.where("label <> 0").orderBy(*order).limit(training.per_class).unionByName(
        single.where("label = 0").orderBy(*order).limit(training.per_class)
    )
    sample = (
        rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("_text").alias("_text")).collect()
    )
    sample.sort(key=lambda r: r["_id"])
    return fit([r["_text"] for r in sample], [int(r["label"] != 0) for r in sample], training)


def score_column(spark: SparkSession, model: SentenceModel, text: Column, offending: float = 0.5) -> Column:
    """struct<score double, offending array<struct<sentence, start, length, probability>>> for whole texts.

    Offending are the sentences whose own probability is at least `offending`; start and length are code points.
    Null texts and texts without a word have no sentence and score 0. Long texts are scored sentence by sentence.
    """
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = T._parse_datatype_string(f"score double, offending {SENTENCES}")

    @F.arrow_udf(kind)
    def per_batch(texts: pa.Array) -> pa.Array:
        scorer = _scorer(sent)
        rows = []
        for value in texts:
            score, found = scorer.score(value.as_py() or "")
            marked = []
            for number, (start, length, logit) in enumerate(found):
                probability = 1 / (1 + float(np.exp(-max(logit, -700.0))))
                if probability >= offending:
                    marked.append({"sentence": number, "start": start, "length": length, "probability": probability})
            rows.append({"score": score, "offending": marked})
        return pa.array(rows, _ARROW)

    return per_batch(F.coalesce(text, F.lit("")))


def drop_toxic(df: DataFrame, model: SentenceModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of `df` that score below the threshold, with its columns; null and empty texts score 0 and stay."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("_text"))
    scored = packed.withColumn("_score", score_column(df.sparkSession, model, F.col("_text"))["score"])
    return scored.where(F.col("_score") < threshold).select("row.*")


_ARROW = pa.struct(
    [
        ("score", pa.float64()),
        (
            "offending",
            pa.list_(
                pa.struct(
                    [("sentence", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]
                )
            ),
        ),
    ]
)


@lru_cache(maxsize=1)
def _scorer(sent: Broadcast) -> Scorer:
    return Scorer(sent.value)
