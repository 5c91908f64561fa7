"""Toxicity scores from weak supervision.

Voters are lexicon entries (words and word beginnings, found by their log-odds
in labelled documents) and writing patterns. A generative label model estimates
how often each voter fires for toxic and for clean documents, and how strongly
voters depend on each other, so that a word and its beginning do not count
twice; the human label takes part as one more, fallible voter. A linear
classifier is then trained on the model's posterior labels and scores whole
texts.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

#: Labelled rows that the model is fitted on, at most; those of least hash are taken.
FIT_ROWS = 20_000
#: Features of the classifier, and voters of the label model, at most.
VOCABULARY, VOTERS = 4096, 96
LEAST_DOCS, LEAST_Z, LEAST_VOTER_Z = 6, 2.0, 3.5
BEGINNINGS = (4, 5, 6)
FOLDS, SEED = 5, 17
ITERATIONS = 30
#: Score at most of texts that no model could be fitted for.
NOTHING_LEARNT = 0.4
#: Documents whose features a task holds at once.
SLICE = 64
_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: shouted words, repeated marks, words with masked letters, insult address.
_PATTERNS = {
    "~shout": re.compile(r"\b[A-Z]{4,}\b"),
    "~marks": re.compile(r"[!?]{3,}"),
    "~masked": re.compile(r"\b\w+[*@#$%]+\w+\b"),
    "~address": re.compile(r"\b(?:you|du|tu|vous|usted)\s+(?:are|bist|es|êtes|eres)\b", re.IGNORECASE),
}


def features(text: str | None, wanted=None) -> list[str]:
    """Distinct features of a text: words, word beginnings (``-``) and patterns (``~``).

    ``x2`` marks a feature that occurs at least twice. With ``wanted`` only those
    features are looked for. Null and empty texts have none.
    """
    text = text or ""
    seen: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        if wanted is None or word in wanted:
            seen[word] += n
        for k in BEGINNINGS:
            if len(word) >= k:
                start = word[:k] + "-"
                if wanted is None or start in wanted:
                    seen[start] += n
    for name, pattern in _PATTERNS.items():
        if wanted is None or name in wanted:
            first = pattern.search(text)
            if first:
                seen[name] += 1 + (pattern.search(text, first.end()) is not None)
    found = list(seen)
    found += [name + "x2" for name, n in seen.items() if n > 1]
    return found


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``limit`` labelled documents of the learning folds.

    One row per ID: of several labels the larger counts, of several texts the least.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)
    )
    # At most ``limit`` rows of 12 bytes, so the broadcast is bounded.
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _with_features(rows: DataFrame, wanted=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pa.array([features(t.as_py(), wanted) for t in part["text"]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], found], names=["doc_id", "toxic", "features"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, features array<string>")


def lexicon(featured: DataFrame, size: int = VOCABULARY) -> list[tuple[str, float]]:
    """``(feature, z)`` of the features that tell toxic from clean documents best."""
    total, toxic = featured.agg(F.count("*"), F.sum("toxic")).first()
    if not total or not toxic or toxic == total:
        return []
    a, b = F.col("in_toxic"), F.col("n") - F.col("in_toxic")
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (total - toxic - b + 0.5))
    counted = (
        featured.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("in_toxic"))
        .filter(F.col("n") >= LEAST_DOCS)
        .select("feature", (odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("z"))
        .filter(F.abs("z") >= LEAST_Z)
    )
    best = counted.orderBy(F.abs("z").desc(), "feature").limit(size).collect()
    return [(r["feature"], r["z"]) for r in best]


@dataclass(frozen=True)
class LabelModel:
    """Rates at which voters fire in either class, and how far each one counts."""

    voters: tuple[str, ...]
    prior: float
    fires: np.ndarray  # (2, voters): clean, toxic
    counts: np.ndarray  # (voters,): 1 for an independent voter, less in company
    annotator: tuple[float, float]  # how often the label is 1 for clean, for toxic

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0]) * self.counts
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.counts
        clean, toxic = self.annotator
        total = math.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        total += np.where(labels == 1, math.log(toxic / clean), math.log((1 - toxic) / (1 - clean)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_label_model(voters: tuple[str, ...], votes: np.ndarray, labels: np.ndarray) -> LabelModel:
    """Expectation-maximisation with correlations.

    Within each class the correlation of every pair of voters is estimated from
    the posterior; a voter's evidence is divided by one plus the sum of its
    correlations with the others.
    """
    p = np.where(labels == 1, 0.9, 0.05)
    model = None
    for _ in range(ITERATIONS):
        weight = np.stack([1 - p, p])
        mass = weight.sum(axis=1)
        fires = (weight @ votes + 0.5) / (mass[:, None] + 1.0)
        spread = np.zeros((votes.shape[1], votes.shape[1]))
        for c in (0, 1):
            apart = votes - fires[c]
            spread += (apart * weight[c][:, None]).T @ apart
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        together = np.clip(spread / np.outer(scale, scale), 0, 1)
        counts = 1 / together.sum(axis=1).clip(1)
        seen = (weight @ (labels == 1) + 0.5) / (mass + 1.0)
        annotator = (min(max(seen[0], 0.005), 0.45), min(max(seen[1], 0.55), 0.995))
        prior = min(max(mass[1] / len(p), 0.001), 0.999)
        model = LabelModel(voters, prior, fires, counts, annotator)
        p = model.posterior(votes, labels)
    return model


@dataclass(frozen=True)
class LinearModel:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        total = self.intercept + sum(self.weights[f] for f in features(text, self.weights) if f in self.weights)
        return 1 / (1 + math.exp(-min(max(total, -40.0), 40.0)))


def _votes(featured: DataFrame, voters: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Vote matrix of the bounded sample, at most ``FIT_ROWS`` by ``VOTERS`` bits."""
    places = F.array(*(F.lit(v) for v in voters))
    rows = featured.select("toxic", F.transform(F.array_intersect("features", places), lambda f: F.array_position(places, f)).alias("on")).collect()
    votes = np.zeros((len(rows), len(voters)))
    for i, row in enumerate(rows):
        votes[i, [k - 1 for k in row["on"]]] = 1
    return votes, np.array([row["toxic"] for row in rows])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> LinearModel:
    """The linear model.

    Where the labels name fewer than two classes, or no feature tells them apart,
    it is a constant below a half: nothing is called toxic.
    """
    # Here, so that tasks which only score need not load them.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    run = RunFolder(docs.sparkSession, "toxicity")
    featured = run.keep(_with_features(training_rows(docs, labels, limit)), "featured")
    entries = lexicon(featured)
    if not entries:
        total, toxic = featured.agg(F.count("*"), F.sum("toxic")).first()
        share = min(((toxic or 0) + 0.5) / (total + 1), NOTHING_LEARNT)
        return LinearModel({}, math.log(share / (1 - share)))
    voters = tuple(f for f, z in entries if z >= LEAST_VOTER_Z or f in _PATTERNS)[:VOTERS]
    votes, given = _votes(featured, voters)
    model = fit_label_model(voters, votes, given)

    known = {f for f, _ in entries}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {v: i for i, v in enumerate(model.voters)}
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                found = part["features"].to_pylist()
                votes = np.zeros((len(found), len(at)))
                for i, names in enumerate(found):
                    votes[i, [at[f] for f in names if f in at]] = 1
                p = model.posterior(votes, part["toxic"].to_numpy(zero_copy_only=False))
                told = pa.array([[f for f in names if f in known] for names in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([told, pa.array(p)], names=["features", "p"])

    vocabulary = [f for f, _ in entries]
    labelled = featured.mapInArrow(label, "features array<string>, p double")
    both = labelled.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )).alias("one")).select("features", "one.*")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "features", "vector", binary=True)
    learner = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=0.001, maxIter=60, standardization=False)
    linear = learner.fit(counter.transform(run.keep(both, "labelled")))
    weights = linear.coefficients.toArray()
    return LinearModel({f: float(w) for f, w in zip(vocabulary, weights) if w}, float(linear.intercept))


def score_texts(docs: DataFrame, model: LinearModel, text: str = "text") -> DataFrame:
    """``(row, score)``: every row of ``docs`` whole, with the score of its whole text.

    Null texts score as empty ones do. The model is at most ``VOCABULARY`` weights.
    """
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("_text"))
    kind = named.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch["_text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["row"], scores], names=["row", "score"])

    return named.mapInArrow(run, f"row {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score a half or more."""
    scored = score_texts(docs, fit(docs, labels))
    kept = scored.filter(F.col("score") < 0.5)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out fold are never seen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_texts(docs, fit(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        (F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
