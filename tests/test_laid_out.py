"""Tables laid out by pair and by run: rows, and what the plans read and move."""

from rows import choice, run, runs

from offerlens.operators.model_input import KEYS
from offerlens.operators.picks import pick_events
from offerlens.operators.summary import run_summary
from offerlens.operators.tiers import tier_offers
from offerlens.sources.laid_out import load_pairs, save_bucketed, save_by_pair
from offerlens.sources.tables import read_table


def plan(df):
    return df._jdf.queryExecution().toString()


def files_read(df):
    """Number of files that the scans of a plan open when it runs."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ran = df.select("*")
    ran.collect()
    leaves = ran._jdf.queryExecution().executedPlan().collectLeaves()
    spark.conf.unset("spark.sql.adaptive.enabled")
    nodes = [leaves.apply(i) for i in range(leaves.size())]
    return sum(node.metrics().apply("numFiles").value() for node in nodes if node.nodeName().startswith("Scan parquet"))


def pair_rows(spark):
    rows = [(group, f"card {i % 40}", i, i % 3 == 0) for group in ("RED", "BLUE", "07") for i in range(400)]
    rows += [("RED", "hot", i, True) for i in range(2000)] + [(None, "card 1", 1, True), ("RED", None, 2, True), ("RED", "", 3, True)]
    return spark.createDataFrame(rows, f"{KEYS[0]} string, {KEYS[1]} string, floor int, was_picked boolean")


def test_a_list_of_pairs_reads_its_own_files(spark, tmp_path):
    rows = pair_rows(spark)
    path = str(tmp_path / "pairs")
    assert save_by_pair(rows, path).row_count == rows.count()
    every = files_read(read_table(spark, path))
    files = []
    for pairs in ([("RED", "hot")], [("RED", "hot"), ("07", "card 3"), ("RED", "card 3"), ("BLUE", "nothing"), (None, "card 1")]):
        got = load_pairs(spark, path, pairs)
        expected = [tuple(r) for r in rows.collect() if (r[0], r[1]) in pairs and r[0] is not None]
        assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(expected)
        files.append(files_read(got))
        shown = plan(got)
        assert "PartitionFilters: [" in shown and f"{KEYS[0]}#" in shown.split("PartitionFilters: [")[1][:200]
        assert "PushedFilters: [" in shown and f"({KEYS[1]}" in shown.split("PushedFilters: [")[1][:200]
    assert files[0] < files[1] < every
    assert load_pairs(spark, path, []).count() == 0
    assert {r[0] for r in load_pairs(spark, path, [("07", "card 3"), ("RED", "")]).select(KEYS[0]).collect()} == {"07", "RED"}


def test_a_hot_pair_is_written_by_several_tasks(spark, tmp_path):
    rows = pair_rows(spark)
    path = str(tmp_path / "pairs")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    save_by_pair(rows, path)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert files_read(load_pairs(spark, path, [("RED", "hot")])) > 1


def test_joins_of_bucketed_tables_move_no_rows(spark, tmp_path):
    records = [
        run(play_id=str(i), card_choices=[choice(5.0), choice(9.0, picked="SKIP")] if i % 3 else None, boss_relics=[{"picked": "R", "not_picked": ["S"]}])
        for i in range(60)
    ]
    plain = runs(spark, *records)
    stored = save_bucketed(plain, "bucketed_runs", str(tmp_path / "runs"), buckets=4)
    picked = save_bucketed(pick_events(stored), "bucketed_picks", str(tmp_path / "picks"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for operator in (run_summary, tier_offers):
            joined = operator(stored, picked)
            assert "Exchange" not in plan(joined).split("== Physical Plan ==")[1]
            assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, operator(plain).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_runs")
        spark.sql("DROP TABLE bucketed_picks")


def test_a_table_has_as_many_buckets_as_a_shuffle_has_partitions(spark, tmp_path):
    rows = spark.range(100).selectExpr("string(id) AS play_id")
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in (4, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            stored = save_bucketed(rows, f"dealt_{partitions}", str(tmp_path / f"dealt_{partitions}"))
            described = spark.sql(f"DESCRIBE EXTENDED dealt_{partitions}").filter("col_name = 'Num Buckets'").first()
            found.append((int(described.data_type), stored.count()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_before)
        for partitions in (4, 24):
            spark.sql(f"DROP TABLE IF EXISTS dealt_{partitions}")
    assert found == [(16, 100), (24, 100)]
