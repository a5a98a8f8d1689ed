"""Quality rules on repeated text, by a suffix array over the words of each document.

The suffixes of a document are sorted by prefix doubling. The longest common prefixes of
neighbours in that order give the LCP intervals; every interval is a maximal repeated run of words.
The union of their spans is measured, with the longest run. Many documents share one numpy pass:
the document is part of a suffix's first rank, so suffixes of different documents never compare
equal.

Defined results: a null text is an empty one; documents without words have zeros throughout and
fail the base rules; copies of a row get equal results; occurrences that overlap count.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm.text import WHITE_SPACE, encoded, leaves_nothing, slices

SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 3
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50
CHUNK_BYTES = 1 << 20

SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
PROFILE = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
    + [T.StructField("spans", SPAN)]
)


@dataclass(frozen=True)
class Limits:
    """A run of at least `min_words` that occurs again counts as a repeat.

    A document stays while repeats cover at most `max_percent` of its words and none is longer
    than `max_words`.
    """

    min_words: int = 8
    max_percent: int = 30
    max_words: int = 100


def match_lengths(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run from it that its document holds again.

    `codes` are word codes, each document followed by one code that is found nowhere else in it;
    `docs` are ascending document numbers. A word's length is the larger of the two LCP values
    beside its suffix, i.e. the value of the deepest LCP interval that holds the suffix.
    """
    size = len(codes)
    key = docs.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank = np.empty(size, np.int32)
    first, repeated = _runs(key[order])
    rank[order] = first
    levels, open_, step = [rank], order[repeated], 1
    while len(open_):
        head = rank[open_]
        key = head.astype(np.int64) * size + rank[open_ + step]
        order = np.argsort(key, kind="stable")
        open_, head = open_[order], head[order]
        first, repeated = _runs(key[order])
        group, _ = _runs(head)
        rank = rank.copy()
        rank[open_] = head + (first - group)
        levels.append(rank)
        open_, step = open_[repeated], 2 * step
    suffixes = np.empty(size, np.int64)
    suffixes[rank] = np.arange(size)
    same = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    left, right = suffixes[same], suffixes[same + 1]
    common = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common += (levels[k][left + common] == levels[k][right + common]).astype(np.int64) << k
    length = np.zeros(size, np.int64)
    np.maximum.at(length, left, common)
    np.maximum.at(length, right, common)
    return length


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of equal values starts that each value is in, and whether the run is longer than 1."""
    size = len(ordered)
    starts = np.ones(size, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=starts[1:])
    first = np.maximum.accumulate(np.where(starts, np.arange(size), 0)).astype(np.int32)
    alone = starts & np.append(starts[1:], True)
    return first, ~alone


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words the union of all repeats of at least so many words holds."""
    edges = np.zeros(len(length) + 1, np.int32)
    at = np.flatnonzero(length >= least)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length[at], -1)
    return np.cumsum(edges[:-1]) > 0


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(WHITE_SPACE)]
    return len(lines) - len(set(lines))


def _profiles(texts: list[bytes], min_words: int) -> tuple:
    words = [text.split() for text in texts]
    ids: dict[bytes, int] = {}
    counts = np.array([len(of) for of in words], np.int64)
    ends = np.cumsum(counts + 1) - 1
    codes = np.empty(int(ends[-1]) + 1, np.int64)
    for of, end in zip(words, ends.tolist()):
        codes[end - len(of) : end] = [ids.setdefault(word, len(ids)) for word in of]
    codes[ends] = len(ids)
    docs = np.repeat(np.arange(len(texts)), counts + 1)
    length = match_lengths(codes, docs)
    starts = ends - counts
    base, long = covered(length, BASE_WINDOW), covered(length, min_words)
    longest = np.maximum.reduceat(length, starts)
    edges = np.diff(np.concatenate(([0], long.view(np.int8), [0])))
    first, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans = pa.ListArray.from_arrays(
        pa.array(np.append(np.searchsorted(first, starts), len(first)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array((x - starts[docs[first]]).astype(np.int32)) for x in (first, after - 1)],
            ["first", "last"],
        ),
    )
    columns = (
        counts,
        [len(t.decode()) - (len(t) - len(t.translate(None, WHITE_SPACE))) for t in texts],
        [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        [_duplicate_lines(t) for t in texts],
        np.add.reduceat(base, starts, dtype=np.int64),
        np.add.reduceat(long, starts, dtype=np.int64),
        np.where(longest >= min_words, longest, 0),
    )
    return tuple(pa.array(column, pa.int64()) for column in columns) + (spans,)


def profile(text: Column, min_words: int = Limits.min_words) -> Column:
    """The counts and spans of repeats of each text, as one struct."""

    @leaves_nothing
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = PROFILE.fieldNames()
        kinds = [pa.int64()] * 7 + [pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
        empty = pa.StructArray.from_arrays([pa.array([], kind) for kind in kinds], names)
        for batch in batches:
            texts = encoded(batch)
            parts = [
                pa.StructArray.from_arrays(list(_profiles(texts[part], min_words)), names)
                for part in slices([len(t) for t in texts], CHUNK_BYTES)
            ]
            yield pa.concat_arrays(parts) if parts else empty

    # the hints of the nested function are the ones Spark reads
    return F.arrow_udf(measured, PROFILE)(text)


def base_failed(stats: Column) -> Column:
    n, repeated = stats["n_words"], stats["n_repeat_words"]
    return (n < BASE_MIN_WORDS) | (100 * repeated > BASE_REPEAT_PERCENT * n)


def within(stats: Column, limits: Limits) -> Column:
    """The verdict of the repeat rules alone."""
    return (100 * stats["covered_words"] <= limits.max_percent * stats["n_words"]) & (stats["longest_repeat"] <= limits.max_words)


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document its profile and whether the base rules and the repeat rules keep it."""
    stats = docs.select("doc_id", profile(F.col("text"), limits.min_words).alias("stats"))
    failed = base_failed(F.col("stats"))
    return stats.select(
        "doc_id", "stats.*", failed.alias("base_failed"), (~failed & within(F.col("stats"), limits)).alias("kept")
    )


def keep_varied(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, with all their columns, that both sets of rules keep."""
    stats = profile(docs["text"], limits.min_words)
    judged = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"), stats.alias("stats"))
    kept = judged.filter(~base_failed(F.col("stats")) & within(F.col("stats"), limits))
    return kept.select("row.*")
