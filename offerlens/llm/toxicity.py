"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier on the words of a text is trained from confirmed toxic examples and unlabelled
text. With the class prior p, the risk of calling text clean is estimated as the loss on unlabelled
text minus p times that loss on toxic examples; where this estimate falls below zero, which it
cannot in truth, the step goes up its slope instead (the non-negative correction).

Unlabelled text is all training text, labelled or not, as the estimate of the risk takes it to be
a picture of the whole. Features are chosen by their counts over all of it. Several classifiers are
trained side by side, each in one Spark task on its own bounded sample, and their weights are
averaged. Only these samples are bounded: every text is counted and scored whole.

Defined results: null and empty texts have no words and get the score of the intercept; where no
toxic example is known every score is the class prior; rows without a doc_id are scored, and never
learnt from; of several labels of one document the largest counts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.text import Memo, encoded, leaves_nothing
from offerlens.sources.scratch import materialise

MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\"


@dataclass(frozen=True)
class Learning:
    """`toxic` bounds the toxic examples, which all classifiers share, `unlabelled` each one's own other texts.

    A feature takes part if at least `least` toxic examples have it and its shares among toxic
    examples and among all training texts differ by `deviations` standard errors.
    """

    classifiers: int = 4
    toxic: int = 4000
    unlabelled: int = 6000
    least: int = 4
    deviations: float = 5.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


def words_of(text: bytes, feature: Memo) -> list[int]:
    """The distinct features of the lower-case words of a text, without marks around them."""
    return sorted({feature[word] for word in set(text.lower().split())})


def word_features() -> Memo:
    """63-bit hashes, so that no rare word shares the feature of a frequent one."""
    return Memo(lambda word: xxhash.xxh64_intdigest(word.strip(MARKS)) >> 1, 50_000)


def log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def train(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, learning: Learning) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam steps over all rows."""
    size = toxic.shape[1]
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)

    def slope(rows: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        return np.append(per_row @ rows, per_row.sum()) / len(rows)

    for step in range(1, learning.steps + 1):
        z_toxic = toxic @ theta[:-1] + theta[-1]
        z_free = unlabelled @ theta[:-1] + theta[-1]
        clean_risk = log_loss(-z_free).mean() - prior * log_loss(-z_toxic).mean()
        # slope of log_loss(-z) is sigmoid(z), of log_loss(z) it is -sigmoid(-z)
        clean_slope = slope(unlabelled, sigmoid(z_free)) - prior * slope(toxic, sigmoid(z_toxic))
        if clean_risk >= 0:
            gradient = clean_slope - prior * slope(toxic, sigmoid(-z_toxic))
        else:
            gradient = -clean_slope
        gradient[:-1] += learning.decay * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= learning.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    # corrected steps push the intercept about: set it so that the unlabelled scores average to the prior
    z_free = unlabelled @ theta[:-1]
    low, high = -50.0 - z_free.max(), 50.0 - z_free.min()
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(z_free + middle).mean() < prior else (low, middle)
    return theta[:-1], float(low)


def _telling(toxic: dict[int, int], n_toxic: int, free: dict[int, int], n_free: int, deviations: float) -> np.ndarray:
    """Features, sorted, whose shares differ between the two sides by more than chance; counts by feature."""
    features = np.array(sorted(toxic), np.int64)
    a, b = (np.array([counts.get(x, 0) for x in features.tolist()], float) for counts in (toxic, free))
    share = (a + b + 1) / (n_toxic + n_free + 2)
    error = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_free))
    return features[np.abs(a / n_toxic - b / n_free) >= deviations * error]


def _document_counts(docs: DataFrame, features: frozenset[int]) -> dict[int, int]:
    """In how many texts each of the features is, and at -1 the number of texts; added up per task first."""

    @leaves_nothing
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, counts = word_features(), dict.fromkeys(features, 0) | {-1: 0}
        for batch in batches:
            for text in encoded(batch.column("text")):
                counts[-1] += 1
                for found in features.intersection({feature[word] for word in set(text.lower().split())}):
                    counts[found] += 1
        seen = {x: n for x, n in counts.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    parts = docs.select("text").mapInArrow(counted, "feature bigint, n bigint")
    # no more rows than features
    return {row["feature"]: row["n"] for row in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}


def _dense(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    table = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        table[i, np.isin(features, row, assume_unique=True)] = 1
    return table


def fit(docs: DataFrame, labels: DataFrame, training: Column, learning: Learning = Learning()) -> tuple[dict[int, float], float]:
    """Weights by feature, and the intercept. `training` tells which doc_ids may be learnt from.

    Samples are the rows of least hash of the doc_id; only ids are sorted, and the texts of the
    sampled ids are read. The ids sent to the tasks are as many as the samples' bounds at most.
    """
    known = labels.filter(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    prior_row = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    prior = min(max(prior_row or 0.0, 1e-4), 0.5)
    learnt = docs.filter(training & F.col("doc_id").isNotNull())
    free = learnt.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()

    def sampled(ids: DataFrame, size: int, toxic: bool) -> DataFrame:
        order = F.xxhash64("doc_id", F.lit(int(toxic)))
        least = ids.select("doc_id", order.alias("order")).orderBy("order", "doc_id").limit(size)
        every = F.sequence(F.lit(0), F.lit(learning.classifiers - 1)).cast("array<bigint>")
        own = F.array(F.pmod("order", F.lit(learning.classifiers).cast("bigint")))
        return least.select("doc_id", F.lit(toxic).alias("is_toxic"), (every if toxic else own).alias("classifiers"))

    rows = sampled(known.filter("toxic"), learning.toxic, True).union(
        sampled(free, learning.classifiers * learning.unlabelled, False)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")

    @leaves_nothing
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = word_features()
        for batch in batches:
            found = [words_of(text, feature) for text in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("classifiers"), batch.column("is_toxic"), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "classifiers", "is_toxic", "found"],
            )

    samples = materialise(texts.mapInArrow(featured, "doc_id bigint, classifiers array<bigint>, is_toxic boolean, found array<bigint>"))

    examples = samples.filter("is_toxic")
    n_toxic = examples.count()
    common = examples.select(F.explode("found").alias("feature")).groupBy("feature").count().filter(F.col("count") >= learning.least)
    # bounded by the words of the toxic sample, each in `least` of its texts
    in_toxic = {row["feature"]: row["count"] for row in common.collect()}
    telling = np.zeros(0, np.int64)
    if n_toxic:
        everywhere = _document_counts(learnt, frozenset(in_toxic))
        telling = _telling(in_toxic, n_toxic, everywhere, everywhere[-1], learning.deviations)

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["is_toxic", "doc_id"])
        toxic, free = ([np.asarray(x, np.int64) for x in rows["found"][rows["is_toxic"] == flag]] for flag in (True, False))
        features, weights, intercept = np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
        if toxic and free:
            features = telling
            weights, intercept = train(_dense(toxic, features), _dense(free, features), prior, learning)
        return pd.DataFrame({"feature": np.append(features, -1), "weight": np.append(weights, intercept)})

    parts = samples.withColumn("classifier", F.explode("classifiers")).groupBy("classifier").applyInPandas(trained, "feature bigint, weight double")
    # no more rows than features
    summed = parts.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    by_feature = {row["feature"]: row for row in summed}
    if -1 not in by_feature:
        return {}, float(np.log(prior / (1 - prior)))
    n = by_feature[-1]["n"]
    weights = {feature: row["weight"] / n for feature, row in by_feature.items() if feature >= 0}
    return weights, by_feature[-1]["weight"] / n


def score(text: Column, weights: dict[int, float], intercept: float) -> Column:
    """The probability that a text is toxic."""

    @leaves_nothing
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        feature = word_features()
        weight = Memo(lambda word: (feature[word], weights[feature[word]]) if feature[word] in weights else (), 50_000)
        for batch in batches:
            sums = []
            for text in encoded(batch):
                found = {weight[word] for word in set(text.lower().split())}
                sums.append(sum(sorted(pair[1] for pair in found if pair), intercept))
            yield pa.array(sigmoid(np.array(sums, float)), pa.float64())

    return F.arrow_udf(scored, "double")(text)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, learning: Learning = Learning()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    training = ~held_out(F.col("doc_id"))
    weights, intercept = fit(docs, labels, training, learning)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), weights, intercept).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, learning: Learning = Learning()) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    weights, intercept = fit(docs, labels, ~held_out(F.col("doc_id")), learning)
    return docs.filter(score(docs["text"], weights, intercept) < threshold)
