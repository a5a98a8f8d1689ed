"""The landing folder of the queries, and which of its files a deduplication moves."""

from rows import run, runs

from offerlens.operators import runs as run_operators
from offerlens.operators.runs import drop_duplicate_runs
from offerlens.sources.records import ingest_runs
from verification import queries


def test_the_landing_repeats_every_record_in_compressed_files(spark, tmp_path, monkeypatch):
    made = []

    def order_runs(session, sf_dir):
        made.append(sf_dir)
        return runs(session, run(), run(play_id="b", neow_bonus='line\nend "quoted"\r'), run(play_id=None))

    monkeypatch.setattr(queries, "order_runs", order_runs)
    landing = queries._landing(spark, "tables")
    assert made == ["tables"]
    daily, rollup = (spark.read.text(f"{landing}/{folder}") for folder in ("daily", "rollup"))
    assert sorted(daily.collect()) == sorted(rollup.collect()) and daily.count() == 3
    assert all(file.endswith(".gz") for read in (daily, rollup) for file in read.inputFiles())
    assert {r.neow_bonus for r in ingest_runs(spark, landing, multi_line=False).collect()} == {"gold", 'line\nend "quoted"\r'}


def copies(spark):
    found = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), (None, "z"), ("c", None), ("c", "y"), ("d", "y"), ("d", "y")]
    records = [run(play_id=key, gold=i) | {"_source_file": file} for i, (key, file) in enumerate(found)]
    own = runs(spark, *records).schema.add("_source_file", "string")
    return spark.createDataFrame([tuple(r.get(name) for name in own.names) for r in records], own)


def test_files_that_only_repeat_others_are_left_out(spark):
    repeated = copies(spark).filter("_source_file <> 'z' OR play_id = 'b'")
    kept = drop_duplicate_runs(repeated)
    shown = kept._jdf.queryExecution().analyzed().toString()
    wanted = shown.split("_source_file", 1)[1].split(" IN (")[1].split(")")[0]
    assert sorted(wanted.split(",")) == ["x", "y"]
    assert sorted((r.play_id, r._source_file) for r in kept.collect()) == [("a", "x"), ("b", "y"), ("c", "y"), ("d", "y")]


def test_the_kept_copies_do_not_depend_on_the_list_of_files(spark, monkeypatch):
    rows = copies(spark)
    listed = sorted(map(tuple, drop_duplicate_runs(rows).collect()), key=repr)
    monkeypatch.setattr(run_operators, "MANY_FILES", 0)
    assert sorted(map(tuple, drop_duplicate_runs(rows).collect()), key=repr) == listed
    assert {(r[0], r[-1]) for r in listed} == {("a", "x"), ("b", "y"), (None, "z"), ("c", None), ("d", "y")}


def test_rows_of_files_without_repeats_are_not_sorted_or_moved(spark):
    # every key comes once in the files x and y; z only repeats them
    found = [("a", "x"), ("b", "x"), ("c", "y"), (None, "y"), ("a", "z"), ("c", "z"), (None, "z")]
    records = [run(play_id=key, gold=i) | {"_source_file": file} for i, (key, file) in enumerate(found)]
    own = runs(spark, *records).schema.add("_source_file", "string")
    rows = spark.createDataFrame([tuple(r.get(name) for name in own.names) for r in records], own)
    kept = drop_duplicate_runs(rows)
    assert "Aggregate" not in kept._jdf.queryExecution().analyzed().toString()
    assert {(r.play_id, r.gold, r._source_file) for r in kept.collect()} == {("a", 0, "x"), ("b", 1, "x"), ("c", 2, "y"), (None, 3, "y")}
    # a second copy within a needed file, of the null key too, is left out as before
    twice = drop_duplicate_runs(rows.unionByName(rows.filter("_source_file = 'y'")))
    assert sorted((r.play_id or "", r.gold) for r in twice.collect()) == [("", 3), ("a", 0), ("b", 1), ("c", 2)]
