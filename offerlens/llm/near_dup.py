"""Near duplicates: circulant MinHash, banding, and exact Jaccard similarity of whole shingle sets.

1. Every text becomes its set of word shingles. Documents with equal sets are one class, stood for
   by its smallest doc_id, before anything else is done; repeated rows count once from there on.
2. Two permutations of the 64-bit numbers give all signature coordinates: the first spreads the
   set, the second is shifted circularly by one more place for each coordinate (C-MinHash).
   Bands of coordinates are bucket keys.
3. In each bucket all members are compared with two centres, its smallest and its largest member:
   linear in the bucket, whatever its size.
4. Where a bucket still holds several components, members outside the largest one are compared
   with all members of other components, block by block, so no link is lost; blocks are bounded by
   the shingles in them, not by their number.
5. Components are found by star steps over the confirmed links.

Defined results: null and white-space texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle; rows of one doc_id are one document; rows without a
doc_id belong to no component and are kept.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.components import connected_components
from offerlens.llm.text import WordHashes, encoded, leaves_nothing, mix, shingle_hashes
from offerlens.sources.scratch import materialise

SPREAD, PERMUTE = np.uint64(0x8BADF00D5EED1234), np.uint64(0x1234DEADBEEF4321)
BLOCK_SHINGLES = 200_000
#: Ids that a broadcast may hold, at 8 bytes each.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Sketch:
    """Two texts are linked if 100 * intersection >= percent * union.

    At 85 percent 16 bands of 4 rows miss a link with a probability below 1 in 100,000. A pair
    skips the exact comparison of step 4 if fewer than `least_equal` of the 64 coordinates are
    equal, which befalls a link less than once in 10 million.
    """

    width: int = 3
    percent: int = 85
    bands: int = 16
    rows: int = 4
    least_equal: int = 36


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: for each shift k the least place of the set under the shifted permutation."""
    least = np.full(size, np.iinfo(np.uint64).max)
    shifts = np.arange(1, size + 1, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        spread = mix(shingles[start : start + 1024] ^ SPREAD)
        places = mix((spread[:, None] + shifts[None, :]) ^ PERMUTE)
        np.minimum(least, places.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, sketch: Sketch) -> np.ndarray:
    code = np.arange(1, sketch.bands + 1, dtype=np.uint64)
    for row in signature.reshape(sketch.bands, sketch.rows).T:
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + row)
    return code.view(np.int64)


def _shingled(batch: pa.RecordBatch, width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in encoded(batch.column("text")):
        yield shingle_hashes(hashes(text.lower().split()), width)


def _sketches(docs: DataFrame, sketch: Sketch) -> DataFrame:
    @leaves_nothing
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, bands, signatures = [], [], [], []
            for shingles in _shingled(batch, sketch.width, hashes):
                sizes.append(len(shingles))
                keys.append(xxhash.xxh128_digest(shingles.tobytes()))
                signs = signature(shingles, sketch.bands * sketch.rows)
                found = band_keys(signs, sketch)
                bands.append(found if len(shingles) else found[:0])
                signatures.append(signs.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    schema = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, schema)


def _sets(docs: DataFrame, ids: DataFrame, sketch: Sketch) -> DataFrame:
    """Whole shingle sets of the named documents, stored; rows of equal sets and ids once."""

    @leaves_nothing
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [s.tobytes() for s in _shingled(batch, sketch.width, hashes)]
            keys = [xxhash.xxh128_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(keys, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())],
                ["rep", "set_key", "size", "shingles"],
            )

    # the number of ids is known, so a broadcast is bounded; more of them are joined by a shuffle
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(wanted, "rep", "left_semi")
    sets = materialise(texts.mapInArrow(of, "rep bigint, set_key binary, size bigint, shingles binary"))
    # only the sets of repeated rows are shuffled to make them one
    key = ["rep", "set_key"]
    repeated = materialise(sets.groupBy(*key).count().filter("count > 1").select(*key))
    if repeated.isEmpty():
        return sets
    once = sets.join(repeated, key, "left_semi").dropDuplicates(key)
    return materialise(sets.join(repeated, key, "left_anti").union(once.select(*sets.columns)))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""

    @leaves_nothing
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(
                [
                    _alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(left.to_pylist(), right.to_pylist())
                ],
                pa.bool_(),
            )

    def side(name: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), F.col("size").alias(f"{name}_size"), F.col("shingles").alias(f"{name}_set"))

    compared = pairs.join(side("a"), "a").join(side("b"), "b")
    possible = compared.filter(
        100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    )
    return possible.filter(F.arrow_udf(alike, "boolean")("a_set", "b_set")).select("a", "b")


def _in_blocks(members: DataFrame, sets: DataFrame, signatures: DataFrame, sketch: Sketch) -> DataFrame:
    """Links between members of different components of one bucket.

    `members` has key, band, rep, component. Members of the bucket's largest component need no
    comparison with each other; the rest are compared with all members, in pairs of blocks.
    """
    counts = members.groupBy("key", "component").count()
    largest = counts.groupBy("key").agg(
        F.max("count").alias("most"), F.count("*").alias("components")
    ).filter("components > 1")
    largest = (
        counts.join(largest, "key").filter("count = most").groupBy("key").agg(F.min("component").alias("main"))
    )
    signed = sets.join(signatures, ["rep", "set_key"]).drop("set_key")
    rows = materialise(members.join(largest, "key").join(signed, "rep"))
    outside = F.col("component") != F.col("main")
    blocks = rows.groupBy("key").agg(
        F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("all_blocks"),
        F.ceil(F.sum(F.when(outside, F.col("size"))) / BLOCK_SHINGLES).cast("int").alias("out_blocks"),
    )
    placed = rows.join(blocks, "key").withColumn("spot", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)))
    held = ["key", "band", "rep", "component", "shingles", "signature"]

    def dealt(rows: DataFrame, own: str, other: str, out: bool) -> DataFrame:
        block = (F.col("spot") % F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        names = ("out_block", "all_block") if out else ("all_block", "out_block")
        return rows.select(*held, F.lit(out).alias("out"), block.alias(names[0]), every.alias(names[1]))

    halves = dealt(placed.filter(outside), "out", "all", True).unionByName(
        dealt(placed, "all", "out", False)
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["out"]], rows[~rows["out"]]
        found = []
        if len(left) and len(right):
            right_signs = np.stack([np.frombuffer(s, np.uint32) for s in right["signature"]])
            right_sets = [np.frombuffer(s, np.uint64) for s in right["shingles"]]
            right_reps, components = right["rep"].to_numpy(), right["component"].to_numpy()
            band = int(rows["band"].iloc[0])
            for rep, component, signs, shingles in zip(left["rep"], left["component"], left["signature"], left["shingles"]):
                equal = right_signs == np.frombuffer(signs, np.uint32)
                shared = equal.reshape(-1, sketch.bands, sketch.rows).all(axis=2)
                # a pair is compared in the first bucket that both are in
                wanted = (components != component) & (shared.argmax(axis=1) == band) & (equal.sum(axis=1) >= sketch.least_equal)
                own = np.frombuffer(shingles, np.uint64)
                found += [(rep, right_reps[i]) for i in np.flatnonzero(wanted) if _alike(own, right_sets[i], sketch.percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return halves.groupBy("key", "out_block", "all_block").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    sketches = materialise(_sketches(docs, sketch))
    filled = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    # repeated rows of a representative count once
    reps = filled.join(classes, "set_key").filter("doc_id = rep").drop("doc_id").dropDuplicates(["rep", "set_key"])
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    centres = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    members = materialise(buckets.join(centres.filter("low <> high"), "key").distinct())
    pairs = (
        members.select("rep", F.explode(F.array("low", "high")).alias("centre"))
        .filter("rep <> centre")
        .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        .distinct()
    )
    sets = _sets(docs, members.select("rep").distinct(), sketch)
    links = materialise(_confirmed(pairs, sets, sketch.percent))
    found = connected_components(links)
    named = members.select("key", "band", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    more = materialise(_in_blocks(named, sets, reps.select("rep", "set_key", "signature"), sketch))
    if not more.isEmpty():
        found = connected_components(links.union(more))
    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("linked")
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("linked", "doc_id")).otherwise(F.col("doc_id"))
    return sketches.join(labels, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """The documents, with all their columns, that stand for their component."""
    found = near_duplicates(docs, sketch).filter(~F.col("kept"))
    dropped = materialise(found.select(F.col("doc_id").alias("_dropped")).distinct())
    # only a known number of ids is broadcast, so that texts stay where they are
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(side, docs["doc_id"] == side["_dropped"], "left_anti")
