"""Reading and writing records and tables."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from rows import choice, run, runs

from offerlens.operators.model_input import load_model_rows, save_model_rows
from offerlens.operators.offers import offers
from offerlens.operators.picks import pick_events
from offerlens.plans.build import build_tables, load_table
from offerlens.sources.records import (
    decode_nested,
    encode_nested,
    flatten_structs,
    ingest_runs,
    read_records,
    unreadable_records,
    unwrap_records,
    with_run_types,
)
from offerlens.sources.scratch import materialise, scratch_dir
from offerlens.sources.tables import export_csv, read_table, write_table


@pytest.fixture()
def landing(tmp_path):
    """A rollup holding two runs, and a dated folder that repeats one of them and adds another."""
    folder = tmp_path / "landing"
    (folder / "2020" / "11").mkdir(parents=True)

    def record(**fields):
        return {"event": run(**fields)}

    (folder / "november.json").write_text(
        json.dumps([record(), record(play_id="b", card_choices=[choice(7)])], indent=2)
    )
    (folder / "2020" / "11" / "a.json").write_text(json.dumps(record(), indent=2))
    with gzip.open(folder / "2020" / "11" / "c.json.gz", "wt") as out:
        json.dump([record(play_id="c", surprise=1)], out)
    return str(folder)


@pytest.mark.parametrize("infer", [False, True])
def test_ingest_reads_the_tree_and_keeps_one_copy(spark, landing, infer):
    rows = {r.play_id: r for r in ingest_runs(spark, landing, infer=infer).collect()}
    assert sorted(rows) == ["a", "b", "c"]
    assert rows["a"]._source_file.endswith("2020/11/a.json")
    assert rows["b"].card_choices[0].floor == 7.0
    if infer:
        assert rows["c"].surprise == 1
    else:
        assert [json.loads(rows[k]._other) if rows[k]._other else None for k in "abc"] == [None, None, {"surprise": "1"}]


def test_records_without_the_wrapper_are_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"play_id": "a"}))
    for infer in (False, True):
        with pytest.raises(ValueError, match="event.*play_id"):
            read_records(spark, str(tmp_path), infer=infer)


def test_whole_numbers_may_be_written_as_decimals(spark, tmp_path):
    fields = {"floor_reached": 50.0, "score": 1e3, "current_hp_per_floor": [7.0, 8]}
    records = [{"event": run(**fields)}, {"event": run(play_id="b")}]
    (tmp_path / "x.json").write_text(json.dumps(records))
    rows = {r.play_id: r for r in ingest_runs(spark, str(tmp_path)).collect()}
    assert (rows["a"].floor_reached, rows["a"].score) == (50, 1000)
    assert rows["a"].current_hp_per_floor == [7, 8]
    assert rows["b"].floor_reached == 50 and isinstance(rows["b"].floor_reached, int)


def test_whole_numbers_are_exact_and_fractions_are_not_cut(spark, tmp_path):
    fields = {"score": 9007199254740993, "gold": 7.5, "gold_per_floor": [9007199254740993, 1.5, None]}
    (tmp_path / "x.json").write_text(json.dumps({"event": run(**fields)}))
    row = ingest_runs(spark, str(tmp_path)).first()
    assert (row.score, row.gold) == (9007199254740993, None)
    assert row.gold_per_floor == [9007199254740993, None, None]


def test_undeclared_fields_are_kept_with_their_texts(spark, tmp_path):
    extra = {"big": 9007199254740993, "nested": {"a": [1, None]}, "none": None, "text": "x"}
    (tmp_path / "x.json").write_text(json.dumps({"event": run(**extra)}))
    kept = json.loads(ingest_runs(spark, str(tmp_path)).first()._other)
    assert kept == {"big": "9007199254740993", "nested": '{"a":[1,null]}', "none": None, "text": "x"}


def test_unreadable_records_are_refused_or_set_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"event": run()}))
    (tmp_path / "broken.json").write_text('{"event": {"play_id": ')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        ingest_runs(spark, str(tmp_path)).collect()
    assert [r.play_id for r in ingest_runs(spark, str(tmp_path), unreadable="skip").collect()] == ["a"]
    broken = unreadable_records(spark, str(tmp_path)).collect()
    assert [r._source_file.endswith("broken.json") for r in broken] == [True]


def test_nested_floors_may_be_written_either_way(spark, landing):
    picks = pick_events(with_run_types(unwrap_records(read_records(spark, landing))))
    assert {r.choice_floor for r in picks.collect()} == {7, 10}


def test_flatten_joins_names_and_keeps_arrays(spark):
    df = spark.sql("SELECT named_struct('x', 1, 'y', named_struct('z.w', array(2))) AS a, 3 AS b")
    flat = flatten_structs(df)
    assert flat.columns == ["a.x", "a.y.z.w", "b"]
    assert tuple(flat.first()) == (1, [2], 3)
    assert flatten_structs(df, sep="_").columns == ["a_x", "a_y_z.w", "b"]


def test_nested_columns_survive_json_encoding(spark):
    df = runs(spark, run(card_choices=[choice(1.0, None), choice(None)]), run(card_choices=None))
    encoded = encode_nested(df)
    assert dict(encoded.dtypes)["card_choices"] == "string"
    types = {f.name: f.dataType for f in df.schema.fields if "array" in f.dataType.simpleString()}
    assert decode_nested(encoded, types).collect() == df.collect()


def test_write_replaces_rows_and_schema_and_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_table(spark.range(5), path).row_count == 5
    info = write_table(spark.range(3).select(F.col("id").alias("other")), path)
    assert (info.path, info.row_count) == (path, 3)
    assert read_table(spark, path).columns == ["other"]


def test_partitioned_write_prunes(spark, tmp_path):
    df = offers(pick_events(runs(spark, run(), run(play_id="b", character_chosen="BLUE"))))
    path = write_table(df, str(tmp_path / "t"), partition_by="character_chosen").path
    blue = read_table(spark, path).filter("character_chosen = 'BLUE'")
    assert blue.count() == 3
    assert len(blue.inputFiles()) >= 1 and all("BLUE" in f or "RED" in f for f in blue.inputFiles())
    plan = blue._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(character_chosen" in plan


def test_a_table_cannot_overwrite_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    with pytest.raises(ValueError, match="cannot overwrite"):
        write_table(read_table(spark, path), path)
    assert read_table(spark, path).count() == 5


def test_csv_export_has_a_header(spark, tmp_path):
    path = tmp_path / "csv"
    export_csv(spark.sql("SELECT 'a' AS x, 1 AS n"), str(path), single_file=True)
    files = list(path.glob("*.csv"))
    assert len(files) == 1 and files[0].read_text() == "x,n\na,1\n"


def test_scratch_needs_a_folder(spark, monkeypatch):
    monkeypatch.setattr("offerlens.sources.scratch._base", lambda session: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(spark)


def test_scratch_follows_the_session_setting(spark, tmp_path):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = materialise(spark.range(4).withColumn("p", F.lit("007")), partition_by="p")
    assert {tuple(r) for r in df.collect()} == {(i, "007") for i in range(4)}


def test_stored_model_rows_keep_raw_columns_and_derive_the_ratio(spark, tmp_path):
    hp = {"current_hp_per_floor": [40] * 50, "max_hp_per_floor": [80] * 49 + [0]}
    hp["relics_obtained"] = []
    df = offers(pick_events(runs(spark, run(card_choices=[choice(10.0), choice(50.0)], **hp))))
    info = save_model_rows(df, str(tmp_path / "rows"))
    assert info.row_count == 6
    assert "hp_ratio" not in read_table(spark, info.path).columns
    loaded = load_model_rows(spark, info.path)
    assert [r.hp_ratio for r in loaded.collect()] == [0.5] * 3
    assert not {"current_hp", "max_hp"} & set(loaded.columns)


def test_build_makes_all_tables_or_the_named_ones(spark, landing, tmp_path):
    warehouse = str(tmp_path / "warehouse")
    built = build_tables(spark, landing, warehouse)
    assert {name: info.row_count for name, info in built.items()} == {
        "bronze_runs": 3,
        "silver_picks": 3,
        "silver_card_offers": 9,
        "gold_run_summary": 3,
        "gold_relic_offers": 0,
    }
    again = build_tables(spark, landing, warehouse, only=["gold_run_summary"])
    assert list(again) == ["gold_run_summary"]
    assert load_table(spark, warehouse, "gold_card_choice_events").count() == 9
    with pytest.raises(ValueError, match="nonsense"):
        build_tables(spark, landing, warehouse, only=["nonsense"])
