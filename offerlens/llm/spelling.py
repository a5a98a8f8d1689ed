"""Spelling variants: words at edit distance one, each pointed to the variant that is far more frequent.

1. Words are counted over all documents, combined per task before the shuffle.
2. The vocabulary is put into blocked Bloom filters, one shard per word length: a word sets a few
   bits of one 64-bit block. The blocks are or-ed in Spark and broadcast. A round holds the words
   of one hash class, `round_words` of them on average, so the broadcast has a bound whatever the
   vocabulary: there are as many rounds as that takes.
3. Every word generates its edits and probes them: all texts with one character taken out in the
   shard below its own, and with one replaced by a larger one in its own. A pair that differs by an
   inserted character is found from its longer word, one that differs by a replaced character from
   its smaller word, so each pair is probed once. Hashes are polynomial, so an edit costs one
   multiplication whatever the length of the word, and edits are probed as arrays.
4. Only positive edits become strings. They are shuffled to an exact join with the vocabulary,
   which removes the false ones.
5. The form of a word is its most frequent neighbour, if that is `ratio` times as frequent. Roots
   follow the forms by pointer jumping: frequencies grow by the ratio at every step, so the number
   of rounds is the logarithm of a logarithm.

Nothing is capped. The edits of a word number its length times the alphabet, which also bounds
its neighbours, and with them any key of the joins.

Defined results: null and empty texts have no words; a row without a doc_id is read like one whose
id is the empty text; repeated rows count each; without words the result is empty; other columns
are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.text import mix
from offerlens.sources.scratch import materialise

BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH = 0xD1342543DE82EF95

#: Lengths from this one on share a shard; the hash tells their lengths apart.
LONG = 64
#: A word sets this many bits of its block; a shard has so many bits a word, and so many blocks at least.
BITS, BITS_A_WORD, LEAST_BLOCKS = 5, 24, 1024
#: Words a task counts before it hands them on; words a task probes; edits held at once.
COUNTED, PROBED, EDITS = 200_000, 20_000, 1 << 20

Misprint = Callable[[str, int], str]


@dataclass(frozen=True)
class Spelling:
    least_length: int = 5
    least_n: int = 3
    ratio: int = 2
    #: Words of one round, of 3 bytes in the filter and 16 bytes on their way to it.
    round_words: int = 8_000_000


def misprint(run: str, hash_: int) -> str:
    """One run in 97 loses the character that its hash names."""
    if hash_ % 97:
        return run
    at = hash_ % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, spelling: Spelling, changed: Misprint | None = None) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    `changed` may replace a run, given the unsigned CRC-32 of `<doc_id>:<run>`.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % spelling.least_length)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(runs.findall((text or "").encode().lower().decode()))
                if changed is None:
                    counts.update(found)
                else:
                    start = zlib.crc32(f"{doc_id or ''}:".encode())
                    for run, n in found.items():
                        counts[changed(run, zlib.crc32(run.encode(), start))] += n
                if len(counts) > COUNTED:
                    yield _rows(counts)
                    counts.clear()
        yield _rows(counts)

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(counted, "word string, n bigint")
    # a changed run may have become too short
    long_ = parts.filter(F.length("word") >= spelling.least_length)
    return long_.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= spelling.least_n)


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _powers(length: int) -> np.ndarray:
    """Weights of the characters in the hash of a word of this length."""
    return np.cumprod(np.append(np.uint64(1), np.full(max(length - 1, 0), BASE)))[::-1][:length]


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums ^ np.uint64(length * LENGTH & 0xFFFFFFFFFFFFFFFF))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places in the list, and a row of code points per word."""
    lengths = np.array([len(word) for word in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield at, codes.reshape(len(at), length).astype(np.uint64)


def hashes(codes: np.ndarray) -> np.ndarray:
    return _finished((codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64), codes.shape[1])


@dataclass(frozen=True)
class Shards:
    """Where each shard starts in a row of blocks, and which hashes belong to the round."""

    starts: np.ndarray
    rounds: int
    round: int

    @classmethod
    def of(cls, words: dict[int, int], rounds: int, round_: int) -> "Shards":
        """`words` has the number of words of each shard, over all rounds."""
        sizes = [max(LEAST_BLOCKS, -(-words.get(shard, 0) * BITS_A_WORD // (64 * rounds))) for shard in range(LONG + 1)]
        return cls(np.cumsum([0, *sizes]), rounds, round_)

    def here(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes) % np.uint64(self.rounds) == self.round

    def blocks(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LONG)
        size = self.starts[shard + 1] - self.starts[shard]
        return self.starts[shard] + ((hashes >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _bit(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))


def bloom(vocabulary: DataFrame, shards: Shards) -> np.ndarray:
    """All blocks of a round. Tasks and Spark combine them; the driver gets one row per block that is set."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, codes in by_length(batch.column("word").to_pylist()):
                own = hashes(codes)
                own = own[shards.here(own)]
                blocks.append(shards.blocks(own, codes.shape[1]))
                masks.append(np.bitwise_or.reduce([_bit(own, k) for k in range(BITS)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(np.concatenate(masks).view(np.int64))], ["block", "mask"])

    rows = vocabulary.select("word").mapInArrow(filled, "block bigint, mask bigint")
    rows = rows.groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    blocks = np.zeros(shards.starts[-1], np.uint64)
    blocks[rows.column("block").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return blocks


def _positive(hashes: np.ndarray, length: int, blocks: np.ndarray, shards: Shards) -> np.ndarray:
    """Places of the hashes that the filter holds. Most fall out at the first bit."""
    at = np.arange(len(hashes)) if shards.rounds == 1 else np.flatnonzero(shards.here(hashes))
    found = blocks[shards.blocks(hashes[at], length)]
    for k in range(BITS):
        hit = found & _bit(hashes[at], k) != 0
        at, found = at[hit], found[hit]
    return at


def _texts(codes: np.ndarray) -> list[str]:
    return [row.tobytes().decode("utf-32-le") for row in codes.astype(np.uint32)]


def deletions(codes: np.ndarray, blocks: np.ndarray, shards: Shards) -> tuple[np.ndarray, list[str]]:
    """Rows, and their texts without one character, that may be words. Of equal neighbours only the first is taken out."""
    n, length = codes.shape
    powers = _powers(length)
    before = np.zeros_like(codes)
    np.cumsum((codes[:, :-1] * powers[1:]), axis=1, out=before[:, 1:])
    terms = codes * powers
    after = terms[:, ::-1].cumsum(axis=1)[:, ::-1] - terms
    first = np.ones((n, length), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(first)
    hit = _positive(_finished((before + after)[row, place], length - 1), length - 1, blocks, shards)
    row, place = row[hit], place[hit]
    left = codes[row][np.arange(length) != place[:, None]].reshape(len(row), length - 1)
    return row, _texts(left)


def replacements(codes: np.ndarray, alphabet: np.ndarray, blocks: np.ndarray, shards: Shards) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows, and their texts with one character replaced by a larger one, that may be words."""
    n, length = codes.shape
    powers = _powers(length)
    sums = (codes * powers).sum(axis=1, dtype=np.uint64)
    width = max(1, EDITS // (n * len(alphabet)))
    for start in range(0, length, width):
        own = codes[:, start : start + width]
        row, place, sign = np.nonzero(alphabet > own[:, :, None])
        new = alphabet[sign]
        place += start
        hit = _positive(_finished(sums[row] + (new - codes[row, place]) * powers[place], length), length, blocks, shards)
        row, place, new = row[hit], place[hit], new[hit]
        edited = codes[row]
        edited[np.arange(len(row)), place] = new
        yield row, _texts(edited)


def candidates(vocabulary: DataFrame, alphabet: np.ndarray, sent: Broadcast, shards: Shards, least_length: int) -> DataFrame:
    """(edit, word, n): edits of words that may be words of the round."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for at, codes in by_length(words):
                step = max(1, EDITS // (codes.shape[1] * len(alphabet)))
                for start in range(0, len(at), step):
                    part = codes[start : start + step]
                    found = list(replacements(part, alphabet, blocks, shards))
                    if part.shape[1] > least_length:
                        found.append(deletions(part, blocks, shards))
                    for row, edits in found:
                        own = at[start + row]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(edits, pa.string()), pa.array([words[i] for i in own], pa.string()), pa.array(counts[own])], ["edit", "word", "n"]
                        )

    return vocabulary.mapInArrow(probed, "edit string, word string, n bigint")


def near_words(vocabulary: DataFrame, spelling: Spelling = Spelling()) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words that one edit takes into each other."""
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(LONG))
    # no more rows than shards
    sizes = {row[0]: row[1] for row in vocabulary.groupBy(shard).count().collect()}
    total = sum(sizes.values())
    rounds = max(1, -(-total // spelling.round_words))
    # no more rows than letters of the pattern
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(row["letter"]) for row in letters), np.uint64)
    dealt = vocabulary.repartition(max(1, -(-total // PROBED)), "word")
    found = None
    for round_ in range(rounds):
        shards = Shards.of(sizes, rounds, round_)
        sent = spark.sparkContext.broadcast(bloom(vocabulary, shards))
        own = candidates(dealt, alphabet, sent, shards, spelling.least_length)
        found = own if found is None else found.union(own)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    names = ("word", "n", "near", "near_n")

    def pair(*columns: str) -> Column:
        return F.struct(*(F.col(column).alias(name) for column, name in zip(columns, names)))

    both = F.array(pair("word", "n", "edit", "edit_n"), pair("edit", "edit_n", "word", "n"))
    return found.join(known, "edit").select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, from (word, form). Each round halves what is left of the chains."""
    found = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = materialise(found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, spelling: Spelling = Spelling(), changed: Misprint | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that is long and frequent enough."""
    vocabulary = materialise(word_counts(docs, spelling, changed))
    # the least of (-n, word) is the most frequent one, the smallest in code-point order among equals
    best = near_words(vocabulary, spelling).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    )
    best_n = -F.col("best.minus_n")
    far = best_n >= spelling.ratio * F.col("n")
    words = materialise(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(far, F.col("best.near")).alias("form"),
            F.when(far, best_n).alias("form_n"),
        )
    )
    found = roots(words.filter(F.col("form").isNotNull()))
    return words.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
