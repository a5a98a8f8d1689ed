"""Chat formatting of logged conversations, with DataFrame functions only.

A log holds a conversation again after each turn, so most entries are prefixes of longer ones. Each
turn has a hash of its place, role and text; the exclusive or of the hashes up to a turn is the
rolling hash of that prefix, 128 bits wide. A conversation whose full hash is the hash of a proper
prefix of another is dropped by an anti-join; of equal conversations the smallest conv_id stays.
Only hashes are shuffled until the maximal conversations are known; their turns alone are rendered.

Equal conversations and equal prefixes are each made one row per task before any shuffle, so copies
do not gather. A conversation becomes one row, so its own turns meet in one task, as hashes first.

Defined results: repeated rows of a turn count once; turns with one number are ordered by role,
then by the hash of the text; a null number comes first; a null text is an empty one in the output,
and a null role is `none`, but both differ from the empty string when prefixes are compared; rows
without a conv_id are one conversation.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.sources.scratch import materialise


@dataclass(frozen=True)
class Template:
    before_role: str = "<|im_start|>"
    before_text: str = "\n"
    after_text: str = "<|im_end|>\n"


def _hash(seed: int, *columns: Column) -> Column:
    """Nulls have a hash of their own."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n, hash_1, hash_2 of the first n turns, for every n, and whether they are all."""
    text = F.col("text")
    brief = turns.select(
        F.col("conv_id").alias("conv_id"), "turn", "role", _hash(1, text).alias("text_1"), _hash(2, text).alias("text_2")
    )
    # repeated rows are made one per task, then dealt by all columns, so that no conversation gathers its copies
    unique = brief.distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_1", "text_2")
    placed = unique.select(
        "*", F.row_number().over(order).alias("n"), F.lead(F.lit(False), 1, True).over(order).alias("whole")
    )
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolled(name: str, seed: int) -> Column:
        return F.bit_xor(_hash(seed, F.col("n"), F.col("role"), F.col(name))).over(rolling)

    return placed.select(
        "conv_id", "n", rolled("text_1", 3).alias("hash_1"), rolled("text_2", 4).alias("hash_2"), "whole"
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_logged of the conversations that no other one goes on from.

    n_logged counts the logged conversations that are a prefix of it, itself and its copies
    included.
    """
    key = ["n", "hash_1", "hash_2"]
    seen = materialise(prefixes(turns))
    classes = materialise(
        seen.filter("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    )
    longer = seen.filter("NOT whole").select(*key).distinct()
    kept = classes.join(longer, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))
    same = F.col("seen.conv_id").eqNullSafe(F.col("kept.conv_id"))
    own = seen.alias("seen").join(kept.alias("kept"), same).select("kept.*", *[f"seen.{name}" for name in key])
    return own.join(classes.select(*key, "copies"), key).groupBy("conv_id", "n_turns").agg(
        F.sum("copies").alias("n_logged")
    )


def render(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id and the text of all its turns."""
    text = F.col("text")
    turn = F.struct("turn", "role", _hash(1, text).alias("text_1"), _hash(2, text).alias("text_2"), "text")
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))

    def written(one: Column) -> Column:
        return F.concat(
            F.lit(template.before_role),
            F.coalesce(one["role"], F.lit("none")),
            F.lit(template.before_text),
            F.coalesce(one["text"], F.lit("")),
            F.lit(template.after_text),
        )

    return ordered.select("conv_id", F.array_join(F.transform("turns", written), "").alias("text"))


def collapsed_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, n_logged, text of every maximal conversation."""
    kept = materialise(maximal(turns))
    same = F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))
    theirs = turns.select("conv_id", "turn", "role", "text").alias("t")
    rows = theirs.join(kept.select("conv_id").alias("k"), same, "left_semi")
    texts = render(rows, template).alias("t")
    return kept.alias("k").join(texts, same).select("k.*", "t.text")
