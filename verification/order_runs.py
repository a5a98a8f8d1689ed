"""Run records derived from order tables: an order is a run, its lines are the choices.

Gives the whole engine a deterministic nested input of any size. Field formulas use only integer
arithmetic on keys and plain comparisons, so another engine can state them too.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns used of each table. Declared, so that no job is spent on finding them.
_TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderpriority string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
}

# One line. Its first six fields fix the order of the lines.
_LINE = """
struct(
  l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate,
  struct(
    CASE WHEN (l_partkey + l_suppkey) % 101 <> 0 THEN double(l_linenumber * 4) END AS floor,
    CASE WHEN l_returnflag = 'N' THEN 'SKIP'
      ELSE concat(p_brand, CASE WHEN l_linestatus = 'O' THEN '+1' ELSE '' END) END AS picked,
    array(concat('Brand#', l_partkey % 25 + 1), concat('Brand#', l_suppkey % 25 + 1)) AS not_picked
  ) AS choice,
  struct(double(l_linenumber * 5) AS floor, p_brand AS key) AS relic,
  substr('ME?T$R', int(floor(l_quantity) % 6) + 1, 1) AS code,
  l_linestatus = 'O' AS is_relic,
  l_tax > 0.04D AS is_potion
) AS line
"""

_HP_LENGTH = "int(greatest(o_orderkey % 61 - o_custkey % 4 * 5, 1))"

_RUN = (
    "string(o_orderkey) AS play_id",
    "c_mktsegment AS character_chosen",
    "o_orderkey % 21 AS ascension_level",
    "o_totalprice > 250000D AS victory",
    "o_orderkey % 61 AS floor_reached",
    "o_orderkey % 50 = 0 AS is_endless",
    "o_orderkey % 50 = 1 AS is_daily",
    "CASE WHEN o_orderkey % 50 <> 4 THEN o_orderkey % 50 = 3 END AS is_trial",
    "o_orderkey % 50 = 2 AS chose_seed",
    "lines.choice AS card_choices",
    f"transform(sequence(1, {_HP_LENGTH}), i -> (o_orderkey * 7 + i * 13) % 80) "
    "AS current_hp_per_floor",
    f"array_repeat(CASE WHEN o_orderkey % 97 = 0 THEN 0L ELSE 80L END, {_HP_LENGTH}) "
    "AS max_hp_per_floor",
    "lines.relic AS relics_obtained",
    "filter(lines, line -> line.is_relic).relic.key AS relics",
    # an order has as many boss choices as its customer's remainder says, none included
    """transform(slice(array(0, 1, 2, 3), 1, int(o_custkey % 5)), tier -> struct(
      CASE WHEN (o_orderkey + tier) % 4 <> 0
        THEN concat('Relic#', (o_orderkey + tier * 7) % 30) END AS picked,
      array(concat('Relic#', (o_orderkey + tier * 11 + 1) % 30),
        concat('Relic#', (o_orderkey + tier * 13 + 2) % 30)) AS not_picked)) AS boss_relics""",
    "lines.code AS path_taken",
    "filter(lines, line -> line.is_potion).relic AS potions_obtained",
    "floor(o_totalprice) AS score",
    "o_orderkey * 31 % 7200 AS playtime",
    "o_custkey % 400 AS gold",
    "o_custkey % 7 AS campfire_rested",
    "o_orderkey % 5 AS campfire_upgraded",
    "o_orderpriority AS neow_bonus",
    "o_orderstatus AS neow_cost",
    "CASE WHEN NOT o_totalprice > 250000D THEN o_orderpriority END AS killed_by",
    "o_custkey AS player_experience",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as one sorted array.

    Flat lines are shuffled and nested afterwards: collecting lists before the shuffle would not
    make it smaller. The joins and aggregates that follow keep this partitioning.
    """
    return (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .repartition("l_orderkey")
        .selectExpr("l_orderkey AS o_orderkey", _LINE)
        .groupBy("o_orderkey")
        .agg(F.expr("sort_array(collect_list(line)) AS lines"))
    )


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested run per order, shaped like an ingested run record."""
    return (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(_lines(spark, sf_dir), "o_orderkey", "left")
        .selectExpr(*_RUN)
    )
