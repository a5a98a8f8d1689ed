"""Phrase collocations from depth-truncated suffix trees of word sequences, partitioned by prefix (ERA).

Counts of all phrases of two to `longest` words that occur `least` times or more, per language, and
of their parts:

1. Words are counted. Frequent ones have a number of `bits` bits, and the texts are stored once as
   runs of these numbers; see `Numbering`.
2. Vertical partitioning. Pairs of frequent words, and longer runs whose parts without the last and
   without the first word are frequent, are counted by hash, in a scan of the runs for each length
   below `longest`. A pair is a prefix if it fits the memory budget of a group; more frequent ones
   are continued to three words, and so on. Infrequent prefixes are dropped with all that they start.
3. Prefixes are packed into groups of the budget, by slots of their hash.
4. Each position whose prefix has a group sends the words from there on, as far as they are
   frequent. Equal sequences are combined per task.
5. Each group sorts its word sequences into a suffix tree cut at that depth, apart from all others.
   Leaves have the totals of equal sequences; a node's count is the sum of its leaves.

Words are counted by their text and a pair's hash is a bijection of its two numbers, so the counts of
step 1 and 2 are exact for them: neither is sent to the trees, which hold what has three words or
more. Those counts come from the trees alone, by numbers, so they are exact too; two prefixes of one
hash would only make more sequences travel. What is sent to every task is bounded: the bits of
frequent prefixes, in a table of fixed size whose false positives do no more than that either; the
hashes of prefixes beyond the budget, tokens / budget of each length at most; the slots; the words
whose number is not their hash's. The budget grows with the corpus beyond 10**6 groups' worth of tokens.

Phrases are then scored by their weakest cut, and those inside a longer candidate that is as
frequent are dropped; see `collocations`.

Defined results: null and empty texts have no words, a null language is `und`, an empty one is a
language of its own; repeated rows count each; rows without a doc_id count too; without words, or
without frequent phrases, the result is empty; other columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.text import encoded, mix, slices, unmix
from offerlens.sources.scratch import materialise

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a piece become this one, which no word holds.
BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", BREAK * 10)

#: The table of frequent prefixes: 2**20 lanes of 64 bits.
LANE_BITS = 20
CHUNK_BYTES = 1 << 20
#: Words from which on a task forgets them, sequences and prefixes from which on it hands them on.
KNOWN, COMBINED, COUNTED = 300_000, 500_000, 2_000_000
#: Numbers in a stored row of runs, but for a longer run.
ROW = 2048
NODES = "codes array<bigint>, f bigint"


@dataclass(frozen=True)
class Phrases:
    longest: int = 5
    least: int = 100
    #: Sequences that a group holds at most; it grows where a corpus would need more than 10**6 groups.
    budget: int = 200_000
    #: Of a word's number, 32 at most; fewer make more words share one.
    bits: int = 32


@dataclass
class Numbering:
    """Numbers of the frequent words: the first bits of their hashes.

    Words whose number another word has too, or is below `reserved`, are numbered from 1 if they are
    frequent, else 0. So no two frequent words have one number, and none has that of another word.
    """

    bits: int = 32
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    special: dict[tuple[str, bytes], int] = field(default_factory=dict)

    @property
    def reserved(self) -> int:
        return 1 << self.bits - self.bits // 4

    def of(self, lang: str, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        codes = (hashes >> np.uint64(64 - self.bits)).astype(np.uint32)
        for i in np.flatnonzero((codes < self.reserved) | np.isin(codes, self.shared)).tolist():
            codes[i] = self.special.get((lang, words[i]), 0)
        return codes


@dataclass
class Partition:
    """What tasks know of the words and prefixes."""

    numbering: Numbering
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(1 << LANE_BITS, np.uint64))
    #: By length, the sorted hashes of prefixes beyond the budget.
    hot: dict[int, np.ndarray] = field(default_factory=dict)
    #: The group of each slot.
    groups: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def is_frequent(self, hashes: np.ndarray) -> np.ndarray:
        lanes = self.frequent[(hashes >> np.uint64(64 - LANE_BITS)).astype(np.int64)]
        return lanes >> (hashes >> np.uint64(58 - LANE_BITS) & np.uint64(63)) & np.uint64(1) != 0

    def is_hot(self, hashes: np.ndarray, length: int) -> np.ndarray:
        known = self.hot.get(length, np.zeros(0, np.uint64))
        if not len(known):
            return np.zeros(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all pieces of all texts, with a break after each piece."""
    return (BREAK.join(texts) + BREAK).translate(_BREAKS).lower().replace(BREAK, b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of runs of texts of one language, in bounded memory but for a single long text."""
    for batch in batches:
        texts = encoded(batch.column("text"))
        for part in slices([len(text) for text in texts], CHUNK_BYTES):
            own: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang")[part].to_pylist(), texts[part]):
                own.setdefault(lang, []).append(text)
            for lang, of in own.items():
                yield lang, words_of(of)


def word_hash(lang: str, word: bytes) -> int:
    """As Spark's xxhash64 of both."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(BREAK, None)
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for lang, words in _by_language(batches):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > KNOWN:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)

    parts = docs.mapInArrow(counted, "lang string, word string, n bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, phrases: Phrases) -> tuple[DataFrame, Numbering]:
    """(lang, word, n, hash, code) of the frequent words, and how tasks number them."""
    spark = words.sparkSession
    numbering = Numbering(phrases.bits)
    hashed = words.withColumn("hash", F.xxhash64("lang", "word"))
    hashed = hashed.withColumn("code", F.shiftrightunsigned("hash", 64 - phrases.bits))
    frequent = hashed.filter(F.col("n") >= phrases.least)
    of_code = hashed.groupBy("code").agg(F.count("*").alias("words"), F.max("n").alias("n"))
    shared = of_code.filter((F.col("words") > 1) & (F.col("n") >= phrases.least)).select("code").toArrow()
    numbering.shared = np.sort(shared.column("code").to_numpy().astype(np.uint32))
    is_shared = F.broadcast(spark.createDataFrame(shared).withColumn("is_shared", F.lit(True)))
    is_special = F.col("is_shared").isNotNull() | (F.col("code") < numbering.reserved)
    special = frequent.join(is_shared, "code", "left").filter(is_special).orderBy("lang", "word").select("lang", "word").toArrow()
    if len(special) >= numbering.reserved:
        raise ValueError("so many words need numbers of more bits")
    special = special.append_column("own", pa.array(range(1, len(special) + 1), pa.int64()))
    numbering.special = {(row["lang"], row["word"].encode()): row["own"] for row in special.to_pylist()}
    own = frequent.join(F.broadcast(spark.createDataFrame(special)), ["lang", "word"], "left")
    return own.select("lang", "word", "n", "hash", F.coalesce("own", "code").alias("code")), numbering


def coded(docs: DataFrame, partition: Broadcast) -> DataFrame:
    """(codes): runs of two frequent words or more as 32-bit numbers, each run closed by a 0."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Partition = partition.value
        by_lang: dict[str, dict[bytes, int]] = {}
        for lang, words in _by_language(batches):
            own = by_lang.setdefault(lang, {BREAK: 0})
            new = [word for word in set(words) if word not in own]
            if new:
                hashes = np.fromiter((word_hash(lang, word) for word in new), np.uint64, len(new))
                own |= dict.fromkeys(new, 0)
                kept = np.flatnonzero(known.is_frequent(hashes))
                new = [new[i] for i in kept.tolist()]
                own |= zip(new, known.numbering.of(lang, new, hashes[kept]).tolist())
            codes = np.fromiter(map(own.__getitem__, words), np.uint32, len(words))
            if sum(map(len, by_lang.values())) > KNOWN:
                by_lang.clear()
            inside = np.zeros(len(codes), bool)
            pairs = (codes[:-1] > 0) & (codes[1:] > 0)
            inside[:-1] |= pairs
            inside[1:] |= pairs
            closes = np.append(False, inside[:-1]) & ~inside
            codes = np.where(inside, codes, np.uint32(0))[inside | closes]
            ends = np.flatnonzero(codes == 0)
            ends = ends[np.append(ends[1:] // ROW > ends[:-1] // ROW, True)[: len(ends)]] + 1
            rows = [codes[start:end].tobytes() for start, end in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["codes"])

    return docs.mapInArrow(found, "codes binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of many rows at a time, in bounded memory but for a single long run."""
    for batch in batches:
        rows = batch.column("codes").to_pylist()
        for part in slices([len(row) for row in rows], 4 * CHUNK_BYTES):
            yield np.frombuffer(b"".join(rows[part]), np.uint32).astype(np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first << np.uint64(32) | second)


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """The two numbers of each pair, from its hash."""
    both = unmix(hashes)
    return np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)], axis=1)


def prefixes(codes: np.ndarray, known: Partition, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from two on, the positions that begin so many words, and their hashes.

    Longer ones are those whose parts without the last and without the first word are frequent.
    """
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    hashes = pair_hashes(codes[at], codes[at + 1])
    yield at, hashes
    for length in range(3, longest + 1):
        frequent = known.is_frequent(hashes)
        at, hashes = at[frequent], hashes[frequent]
        goes_on = np.zeros(len(codes) + 1, bool)
        goes_on[at] = True
        longer = goes_on[at + 1]
        at = at[longer]
        hashes = mix(hashes[longer] * STEP + codes[at + length - 1])
        yield at, hashes


def prefix_counts(runs: DataFrame, partition: Broadcast, length: int, hot: bool = False) -> DataFrame:
    """(hash, n) of what may be a frequent prefix of a length; with `hot` only if it continues one beyond the budget."""

    def rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Partition = partition.value
        held: list[np.ndarray] = []
        for codes in _runs(batches):
            *shorter, (at, hashes) = prefixes(codes, known, length)
            if hot:
                before, its = shorter[-1]
                hashes = hashes[np.isin(at, before[known.is_hot(its, length - 1)])]
            held.append(hashes)
            if sum(map(len, held)) > COUNTED:
                yield rows(*np.unique(np.concatenate(held), return_counts=True))
                held = []
        if held:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))

    parts = runs.mapInArrow(counted, "hash bigint, n bigint")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"))


class Combined:
    """Equal sequences with their totals. Each has the group and the depth of its prefix."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.new = 0

    def add(self, rows: np.ndarray, depth: int, groups: np.ndarray) -> None:
        wide = np.zeros((len(rows), 6), np.uint64)
        wide[:, : rows.shape[1]] = rows
        # the depth tells the totals of a prefix from a sequence that ends with it
        wide[:, 5] = depth
        self.held.append((*(wide[:, ::2] << np.uint64(32) | wide[:, 1::2]).T, groups, np.ones(len(rows), np.int64)))
        self.new += len(rows)
        if self.new > COMBINED:
            self.combine()

    def combine(self) -> None:
        columns = [np.concatenate(parts) for parts in zip(*self.held)]
        order = np.lexsort(columns[:3])
        *keys, groups, n = (column[order] for column in columns)
        starts = np.flatnonzero(np.append(True, np.any([key[1:] != key[:-1] for key in keys], axis=0)))
        self.held = [(*(key[starts] for key in keys), groups[starts], np.add.reduceat(n, starts))]
        self.new = 0

    def full(self) -> bool:
        return bool(self.held) and len(self.held[0][0]) > COMBINED

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, in batches."""
        if not sum(len(part[0]) for part in self.held):
            return
        self.combine()
        for start in range(0, len(self.held[0][0]), 50_000):
            *keys, groups, n = (column[start : start + 50_000] for column in self.held[0])
            columns = [groups, *(key.view(np.int64) for key in keys), n]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column)) for column in columns], ["own_group", "first", "middle", "last", "n"])
        self.held = []


def sequences(runs: DataFrame, partition: Broadcast, longest: int) -> DataFrame:
    """(own_group, first, middle, last, n): sequences of three words or more, two numbers a column, the depth of their prefix last.

    Prefixes of three words or more beyond the budget are sequences of their own that nothing follows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Partition = partition.value
        combined = Combined()

        def group(hashes: np.ndarray) -> np.ndarray:
            return known.groups[(hashes & np.uint64(len(known.groups) - 1)).astype(np.int64)]

        for codes in _runs(batches):
            reach = np.zeros(len(codes), np.int64)
            hashes = np.zeros((longest + 1, len(codes)), np.uint64)
            for length, (at, own) in enumerate(prefixes(codes, known, longest), 2):
                kept = np.full(len(at), True) if length == longest else known.is_frequent(own)
                reach[at[kept]] = length
                hashes[length, at] = own
            at = np.flatnonzero(reach > 2)
            rows = np.zeros((len(at), longest), np.uint64)
            for k in range(longest):
                inside = k < reach[at]
                rows[inside, k] = codes[at[inside] + k]
            for length in range(2, longest + 1):
                own = hashes[length, at]
                hot = known.is_hot(own, length)
                # pairs have their counts: nodes begin with three words
                combined.add(rows[~hot], max(length, 3), group(own[~hot]))
                if not hot.any():
                    break
                if length > 2:
                    combined.add(rows[hot, :length], length, group(own[hot]))
                longer = hot & (reach[at] > length)
                rows, at = rows[longer], at[longer]
            if combined.full():
                yield from combined.rows()
        yield from combined.rows()

    return runs.mapInArrow(found, "own_group bigint, first bigint, middle bigint, last bigint, n bigint")


def subtree(rows: pa.Table, longest: int, least: int) -> pa.Table:
    """Frequent nodes of one group, from its word sequences sorted into a tree; no node is above its prefix."""
    halves = []
    for name in ("first", "middle", "last"):
        both = rows.column(name).to_numpy().view(np.uint64)
        halves += [both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)]
    *words, depth = (half.astype(np.int64) for half in halves)
    tree = np.stack([depth, *words[:longest]], axis=1)
    order = np.lexsort(tree.T[::-1])
    tree, n, depth = tree[order], rows.column("n").to_numpy()[order], depth[order]
    starts_at = np.full(len(tree), longest + 1)
    for column in range(longest, -1, -1):
        starts_at[1:][tree[1:, column] != tree[:-1, column]] = column
    starts_at[:1] = 0
    codes: list[list[int]] = []
    found: list[np.ndarray] = [np.zeros(0, np.int64)]
    for length in range(1, longest + 1):
        starts = np.flatnonzero(starts_at <= length)
        totals = np.add.reduceat(n, starts)
        nodes = (totals >= least) & (tree[starts, length] > 0) & (depth[starts] <= length)
        codes += tree[starts[nodes], 1 : length + 1].tolist()
        found.append(totals[nodes])
    return pa.table([pa.array(codes, pa.list_(pa.int64())), pa.array(np.concatenate(found))], ["codes", "f"])


def named(nodes: DataFrame, vocabulary: DataFrame, bound: int) -> DataFrame:
    """(lang, phrase, n_words, f) of nodes whose numbers are all of frequent words.

    Words of a frequency beyond the bound are broadcast; a lighter one is in n / least nodes of each length and place at most.
    """
    placed = nodes.select("codes", "f", F.posexplode("codes").alias("at", "code"))
    heavy = F.broadcast(vocabulary.filter(F.col("n") > bound).select("code", "lang", "word"))
    light = vocabulary.filter(F.col("n") <= bound).select("code", "lang", "word")
    found = placed.join(heavy, "code").unionByName(placed.join(heavy, "code", "left_anti").join(light, "code"))
    words = F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")
    whole = found.groupBy("codes", "f").agg(F.first("lang").alias("lang"), words).filter(F.size("words") == F.size("codes"))
    return whole.select("lang", F.array_join("words.word", " ").alias("phrase"), F.size("words").alias("n_words"), "f")


def packed(weights: np.ndarray, budget: int) -> np.ndarray:
    """A group for each slot: heaviest first into the group at hand, then the next."""
    groups, order = np.zeros(len(weights), np.int64), np.argsort(-weights, kind="stable")
    group = held = 0
    for slot in order.tolist():
        if held and held + weights[slot] > budget:
            group, held = group + 1, 0
        groups[slot] = group
        held += weights[slot]
    return groups


def _marked(frequent: np.ndarray, level: DataFrame) -> None:
    """Add a level's frequent prefixes to the table: one row per lane comes to the driver."""
    lane = F.shiftrightunsigned("hash", 64 - LANE_BITS)
    bit = F.shiftrightunsigned("hash", 58 - LANE_BITS).bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    rows = level.groupBy(lane.alias("lane")).agg(F.bit_or(mask).alias("mask")).toArrow()
    frequent[rows.column("lane").to_numpy()] |= rows.column("mask").to_numpy().view(np.uint64)


def phrase_counts(docs: DataFrame, phrases: Phrases = Phrases()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all frequent phrases and words, and (lang, n) with all words of a language."""
    if not 1 < phrases.longest <= 5:
        raise ValueError("a phrase has two to five words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = materialise(word_counts(texts))
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")))
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    vocabulary, numbering = numbered(words, phrases)
    vocabulary = materialise(vocabulary)
    budget = max(phrases.budget, tokens // 10**6)
    partition, weights = Partition(numbering), np.zeros(1 << max(12, (4 * tokens // budget).bit_length()), np.int64)
    _marked(partition.frequent, vocabulary)
    runs = materialise(coded(texts, spark.sparkContext.broadcast(partition)), compression="zstd")

    def learn(level: DataFrame) -> None:
        """The prefixes of a level, and the sequences that their slots may hold: one row per slot."""
        _marked(partition.frequent, level)
        slot = F.col("hash").bitwiseAND(F.lit(len(weights) - 1)).alias("slot")
        own = level.groupBy(slot).agg(F.sum(F.least(F.col("n"), F.lit(budget))).alias("n")).toArrow()
        weights[own.column("slot").to_numpy()] += own.column("n").to_numpy()

    levels: list[DataFrame] = []
    for length in range(2, phrases.longest + 1):
        last = 2 < length == phrases.longest
        # the trees alone count the longest, but their groups need to know those that go on from a hot prefix
        if last and not len(partition.hot[length - 1]):
            break
        own = prefix_counts(runs, spark.sparkContext.broadcast(partition), length, hot=last)
        levels.append(materialise(own.filter(F.col("n") >= phrases.least)))
        learn(levels[-1])
        if length < phrases.longest:
            # at most tokens / budget rows
            hot = levels[-1].filter(F.col("n") > budget).select("hash").toArrow().column("hash").to_numpy()
            partition.hot[length] = np.unique(hot.view(np.uint64))
    partition.groups = packed(weights, budget)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pairs_of(batch.column("hash").to_numpy().view(np.uint64)).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.list_(pa.int64())), batch.column("n")], ["codes", "f"])

    found = sequences(runs, spark.sparkContext.broadcast(partition), phrases.longest)
    trees = found.groupBy("own_group").applyInArrow(lambda rows: subtree(rows, phrases.longest, phrases.least), NODES)
    nodes = materialise(levels[0].mapInArrow(pairs, NODES).unionByName(trees))
    single = vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), F.col("n").alias("f"))
    return materialise(single.unionByName(named(nodes, vocabulary, _bound(tokens, phrases)))), totals


def collocations(docs: DataFrame, phrases: Phrases = Phrases(), top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A phrase of frequency a in n words, cut into parts of frequencies l and r, scores
    floor(1000 a n / (l r)); its lowest-scoring cut counts, of equal ones the first. A phrase is
    dropped if a longer candidate around it has at least its frequency.
    """
    counts, totals = phrase_counts(docs, phrases)
    words = F.split("phrase", " ")
    candidates = counts.filter("n_words > 1").withColumn("words", words)
    sized = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = sized.select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("rest"),
    )
    heavy = _heavy(counts, totals, phrases)
    cuts = _looked_up(_looked_up(cuts, "first", "l", counts, heavy), "rest", "r", counts, heavy).join(totals, "lang")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    scored = weakest.select("lang", "phrase", *(f"cut.{name}" for name in ("a", "l", "r", "n", "score")))
    return _best(scored.join(_inside(candidates), ["lang", "phrase"], "left").filter("around IS NULL OR around < a").drop("around"), top)


def _bound(tokens: int, phrases: Phrases) -> int:
    return max(phrases.least, tokens // 10**5)


def _heavy(counts: DataFrame, totals: DataFrame, phrases: Phrases) -> tuple[DataFrame, int]:
    """Phrases that may be parts of many others, and the frequency from which they are.

    Those of one length in one language share its words: 10**5 each at most. A lighter phrase is
    part of f / least others of each length and side at most.
    """
    bound = _bound(totals.agg(F.sum("n")).first()[0] or 0, phrases)
    return counts.filter(F.col("f") > bound), bound


def _looked_up(rows: DataFrame, key: str, name: str, counts: DataFrame, heavy: tuple[DataFrame, int]) -> DataFrame:
    """The frequency of a part: of heavy phrases from a broadcast, of the others by a shuffle."""
    sent, bound = heavy
    known = F.broadcast(sent.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)))
    others = counts.filter(F.col("f") <= bound).select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    light = rows.join(known, ["lang", key], "left_anti").join(others, ["lang", key])
    return rows.join(known, ["lang", key]).unionByName(light)


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, around): for what lies in longer candidates the largest frequency of these."""
    longer = candidates.filter("n_words > 2").select("lang", "f", "words", "n_words")
    sized = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    placed = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    inner = F.array_join(F.slice("words", F.col("at"), F.col("size")), " ")
    return placed.groupBy("lang", inner.alias("phrase")).agg(F.max("f").alias("around"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; parts of a language are cut before they come together."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    cut = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = cut.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
