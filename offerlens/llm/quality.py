"""Quality scores by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs without white space. Two views of them give the features: the words themselves, in
lower case and without marks around them, and their shapes, in which runs of capitals, small
letters and digits shrink to one sign, marks stay, and a word equal to the one before it is `=`.
Runs of up to `longest` shapes and single words and pairs are hashed into 2**bits places; a place
with c of the n runs of a text has the value sqrt(c / n), so every text has length 1.

Several learners are trained side by side, each in one Spark task on its own bounded sample of
labelled rows, text by text with per-place steps and an L1 penalty (FTRL-Proximal); their weights
are averaged. Only the samples are bounded: every text is scored whole, as a sparse dot product.

Defined results: null, empty and blank texts have no runs and get the score of the intercept; with
no labelled row to learn from every score is 0.5; rows without a doc_id are scored, and neither
learnt from nor held out; of several labels of one document the least counts; repeated rows are
scored each; other columns are ignored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.text import Memo, encoded, mix

MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\"
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shapes of longer words are found anew each time, so that the memory stays small.
REMEMBERED_BYTES = 64


@dataclass(frozen=True)
class Learning:
    """`learners` times `rows` labelled documents are learnt from at most, `passes` times each."""

    learners: int = 4
    rows: int = 3000
    passes: int = 4
    bits: int = 20
    longest: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1


def _classes() -> bytes:
    """Signs of bytes in a shape: A, a and 9; bytes of letters beyond ASCII count as small letters."""
    kinds = bytearray(range(256))
    for sign, members in ((b"A", range(65, 91)), (b"a", (*range(97, 123), *range(128, 256))), (b"9", range(48, 58))):
        for byte in members:
            kinds[byte] = sign[0]
    return bytes(kinds)


_KINDS = _classes()
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """The word with each run of equal signs cut to one."""
    return _AGAIN.sub(rb"\1", word.translate(_KINDS))


class Features:
    """Places and values of texts."""

    def __init__(self, learning: Learning):
        self.learning = learning
        self.same = xxhash.xxh64_intdigest(b"=", 1)
        # of words whose signs are known; there are far fewer of these than words
        self.shapes = Memo(lambda signs: xxhash.xxh64_intdigest(_AGAIN.sub(rb"\1", signs), 1), 20_000)

    def _shape(self, signs: bytes) -> int:
        return self.shapes[signs] if len(signs) <= REMEMBERED_BYTES else self.shapes.function(signs)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        n = len(words)
        plain = np.fromiter((xxhash.xxh64_intdigest(word.strip(MARKS)) for word in text.lower().split()), np.uint64, n)
        shapes = np.fromiter(map(self._shape, text.translate(_KINDS).split()), np.uint64, n)
        again = np.fromiter(map(bytes.__eq__, words[1:], words), bool, n - 1)
        shapes[1:][again] = self.same
        runs = [run for view, longest in ((plain, 2), (shapes, self.learning.longest)) for run in _runs(view, longest)]
        places = np.sort((np.concatenate(runs) >> np.uint64(64 - self.learning.bits)).astype(np.uint32))
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        counts = np.diff(np.append(starts, len(places)))
        return places[starts].astype(np.int64), np.sqrt(counts / len(places))


def _runs(hashes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of one to `longest` items."""
    code = np.zeros(len(hashes), np.uint64)
    for length in range(1, min(longest, len(hashes)) + 1):
        code = mix(code[: len(hashes) - length + 1] * STEP + hashes[length - 1 :])
        yield code


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], learning: Learning, seed: int) -> np.ndarray:
    """Weights of all places, the intercept last. The intercept has no penalty."""
    size = 1 << learning.bits
    z, squares = np.zeros(size + 1), np.zeros(size + 1)

    def weights(z: np.ndarray, squares: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        beyond = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -beyond / ((learning.beta + np.sqrt(squares)) / learning.alpha + learning.l2)

    order = np.random.default_rng(seed)
    for _ in range(learning.passes):
        for i in order.permutation(len(texts)):
            places = np.append(texts[i][0], size)
            values = np.append(texts[i][1], 1.0)
            penalty = np.append(np.full(len(places) - 1, learning.l1), 0.0)
            own_z, own_squares = z[places], squares[places]
            w = weights(own_z, own_squares, penalty)
            slope = (sigmoid(w @ values) - labels[i]) * values
            grown = own_squares + slope * slope
            z[places] = own_z + slope - (np.sqrt(grown) - np.sqrt(own_squares)) / learning.alpha * w
            squares[places] = grown
    return weights(z, squares, np.append(np.full(size, learning.l1), 0.0))


def fit(docs: DataFrame, labels: DataFrame, training: Column, learning: Learning = Learning()) -> np.ndarray | None:
    """Averaged weights, the intercept last; None where nothing is labelled.

    `training` tells which doc_ids may be learnt from. The sample is the rows of least hash of the
    doc_id; its ids are broadcast, as many as its bound at most, and only its texts are shuffled.
    """
    known = labels.filter(training & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    drawn = known.select("*", order.alias("draw")).orderBy("draw", "doc_id").limit(learning.learners * learning.rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    dealt = texts.withColumn("learner", F.pmod("draw", F.lit(learning.learners).cast("bigint")))

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        features = Features(learning)
        found = [features((text or "").encode()) for text in rows["text"]]
        weights = train(found, rows["label"].tolist(), learning, int(rows["learner"].iloc[0]))
        kept = np.union1d(np.flatnonzero(weights), [len(weights) - 1])
        return pd.DataFrame({"place": kept, "weight": weights[kept]})

    # no more rows than places, each summed in the order of the learners
    parts = dealt.groupBy("learner").applyInPandas(lambda key, rows: trained(rows).assign(learner=key[0]), "place long, weight double, learner long")
    summed = parts.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("learner", "weight"))).alias("own")).toArrow()
    total = np.zeros((1 << learning.bits) + 1)
    learners: set[int] = set()
    for place, own in zip(summed.column("place").to_pylist(), summed.column("own").to_pylist()):
        total[place] = sum(part["weight"] for part in own)
        learners |= {part["learner"] for part in own}
    return total / len(learners) if learners else None


def score(text: Column, weights: np.ndarray | None, learning: Learning = Learning()) -> Column:
    """The probability that a text is of high quality."""
    if weights is None:
        return F.lit(0.5)
    held = weights.astype(np.float32)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(learning)
        for batch in batches:
            sums = []
            for own in encoded(batch):
                places, values = features(own)
                sums.append(held[places] @ values + held[-1])
            yield pa.array(sigmoid(np.array(sums, float)), pa.float64())

    return F.arrow_udf(scored, "double")(text)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, learning: Learning = Learning()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights = fit(docs, labels, ~held_out(F.col("doc_id")), learning)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), weights, learning).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
