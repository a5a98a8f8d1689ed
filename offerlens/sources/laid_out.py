"""Tables laid out for how they are read: by pair for lists of pairs, by run for joins on runs."""

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from offerlens.operators.model_input import KEYS, restrict_to_pairs
from offerlens.sources.tables import TableInfo, read_table, write_table

GROUP, NAME = KEYS
PART = "name_part"
#: Folders per group over which its names are dealt.
PARTS = 16
#: Least number of buckets of a table.
BUCKETS = 16


def _part(name: Column) -> Column:
    return F.pmod(F.crc32(name), F.lit(PARTS)).cast("int")


def save_by_pair(rows: DataFrame, path: str) -> TableInfo:
    """Store rows in a folder per group and part of its names, sorted by name within the files.

    Rows are dealt by ranges of (group, part, name, content), so that a pair with very many rows is
    written by several tasks. Rows without a group or a name are kept, in folders of their own; an
    empty group is stored as none.
    """
    part = F.coalesce(_part(F.col(NAME)), F.lit(-1)).alias(PART)
    spread = F.xxhash64(*rows.columns).alias("_spread")
    placed = rows.select("*", part, spread)
    dealt = placed.repartitionByRange(GROUP, PART, NAME, "_spread").sortWithinPartitions(GROUP, PART, NAME).drop("_spread")
    return write_table(dealt, path, partition_by=[GROUP, PART])


def load_pairs(spark: SparkSession, path: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of the listed pairs, read from their folders only.

    The list becomes IN-conditions: on the folders, which leaves whole files unread, and on the
    name, which Parquet checks per row group. Exact pairs are then joined. A NULL is no pair.
    """
    listed = sorted({pair for pair in pairs if None not in pair})
    # groups are text, whatever the names of their folders look like
    kinds = [StructField(GROUP, StringType()) if field.name == GROUP else field for field in read_table(spark, path).schema]
    stored = spark.read.schema(StructType(kinds)).parquet(path)
    groups, names = ({pair[i] for pair in listed} for i in (0, 1))
    wanted = stored.filter(
        F.col(GROUP).isin(sorted(groups)) & F.col(PART).isin(sorted({zlib.crc32(name.encode()) % PARTS for name in names})) & F.col(NAME).isin(sorted(names))
    )
    exact = spark.createDataFrame(listed, ", ".join(f"{key} string" for key in KEYS))
    return restrict_to_pairs(wanted, exact).drop(PART)


def save_bucketed(rows: DataFrame, table: str, path: str, key: str = "play_id", buckets: int | None = None) -> DataFrame:
    """Store rows as a catalog table at `path`, dealt into buckets of the key and sorted by it.

    Tables with equal buckets of one key are joined and aggregated by it without a shuffle. There are
    as many buckets as shuffle partitions, `BUCKETS` at least, as one task sorts a bucket.
    """
    if buckets is None:
        buckets = max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)
