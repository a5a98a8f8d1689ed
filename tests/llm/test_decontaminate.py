import random
import re

from llm.tables import documents, odd_texts, shown, text

from offerlens.llm import decontaminate as dec

QUESTION = "If Anna buys 12 apples and gives 5 kg of them to Ben, how many apples does Anna have left when Ben returns 12 apples?"
OTHER = "if Maria buys 40 apples and gives 9 lb of them to John, how many apples does Maria have left when John returns 40 apples?"
BROKEN = "If Maria buys 40 apples and gives 9 kg of them to John, how many apples does Peter have left when Lucy returns 17 apples?"


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, size int")


def windows(t, folded):
    words = re.findall(r"[0-9]+(?:[.,:/-][0-9]+)*|[^\W\d_]+", t or "")
    number = [w[0].isdigit() for w in words]
    kinds = [
        "0" if number[i] else "1" if i and number[i - 1] and w.lower() in dec.UNITS
        else w.upper().lower() if folded else "2" if w != w.lower() else w.lower()
        for i, w in enumerate(words)
    ]
    return [(i, tuple(kinds[i : i + 5]), [w.lower() for w in words[i : i + 5]]) for i in range(len(words) - 4)]


def leaked(text, item, folded):
    theirs = [w for w in windows(item, folded) if sum(k not in ("0", "1", "2") for k in w[1]) >= 3]
    size = len({w[1] for w in theirs})
    runs = {}
    for i, kinds, values in theirs:
        for j, kinds_2, values_2 in windows(text, folded):
            if kinds == kinds_2:
                runs.setdefault(j - i, []).append((kinds, values, values_2))
    found = set()
    for aligned in runs.values():
        slots = {(k, v, o) for kinds, vs, os in aligned for k, v, o in zip(kinds, vs, os) if k in ("0", "1", "2")}
        if len(slots) == len({s[:2] for s in slots}):
            found |= {kinds for kinds, _, _ in aligned}
    return bool(size) and 100 * len(found) >= 80 * size


def plain(rows, items):
    out = []
    for doc_id, t in rows:
        own = [{w[1] for w in windows(t, folded)} for folded in (False, True)]
        held = [
            item_id
            for item_id, item in set(items)
            if any(own[folded] & {w[1] for w in windows(item, folded)} and leaked(t, item, folded) for folded in (False, True))
        ]
        out.append((doc_id, len(held), min((i for i in held if i is not None), default=None), not held))
    return sorted(out, key=repr)


def test_reparameterised_questions_are_caught_and_inconsistent_ones_are_not(spark):
    rng = random.Random(7)
    pad = lambda t: f"{text(rng, 40)}. {t} {text(rng, 40)}"
    passage = text(rng, 60)
    items = [(1, QUESTION), (2, passage), (3, "too short"), (4, "Anna Ben 12 Carl 5 Dora 9"), (5, None), (2, passage), (None, text(rng, 12))]
    rows = [
        (1, pad(QUESTION)), (2, pad(OTHER)), (3, pad(BROKEN)), (4, pad(passage)), (5, pad(passage[: len(passage) // 2])),
        (6, pad(passage.replace(" ", "  \n").upper())), (7, f"{OTHER} {BROKEN} {passage}"), (8, "too short"), (9, items[-1][1]),
    ] + [(i and i + 100, t) for i, t in odd_texts()] + [(300 + i, pad(QUESTION)) for i in range(20)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]
    got = shown(dec.contamination(documents(spark, rows, clashing=True), benchmark(spark, items)), "doc_id", "n_items", "first_item", "kept")
    assert got == plain(rows, items)
    kept = {row[0]: row[3] for row in got}
    assert not kept[1] and not kept[2] and kept[3] and not kept[4] and kept[5] and not kept[6] and not kept[7] and kept[8]


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    rows = [(1, QUESTION), (2, OTHER), (3, BROKEN), (4, None)]
    got = shown(dec.contamination(documents(spark, rows), benchmark(spark, [(1, QUESTION)])), "doc_id", "kept")
    assert got == [(1, False), (2, False), (3, True), (4, True)]


def test_stage_keeps_columns_and_empty_tables_work(spark):
    df = documents(spark, odd_texts() + [(1, OTHER)], clashing=True)
    kept = dec.keep_uncontaminated(df, benchmark(spark, [(1, QUESTION)]))
    assert kept.columns == df.columns and kept.count() == len(odd_texts())
    assert dec.keep_uncontaminated(df, benchmark(spark, [])).count() == len(odd_texts()) + 1
    assert dec.contamination(df.limit(0), benchmark(spark, [(1, QUESTION)])).count() == 0


def test_no_python_runs_on_the_main_path(spark):
    plan = dec.contamination(documents(spark, [(1, QUESTION)]), benchmark(spark, [(1, QUESTION)]))
    shown_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", shown_plan)


def test_recased_copies_are_caught(spark):
    rng = random.Random(9)
    named = f"Über die große Straße sagte Anna Weiß: {text(rng, 20)} in Berlin {text(rng, 20)} for 12 km"
    copies = [(1, named), (2, named.upper()), (3, named.lower()), (4, f"{text(rng, 30)} {named.swapcase()}"), (5, QUESTION.upper()), (6, OTHER)]
    others = [(7, text(rng, 60)), (8, BROKEN), (9, named[: len(named) // 2].upper()), (10, None)]
    df, items = documents(spark, copies + others), benchmark(spark, [(1, named), (2, QUESTION)])
    got = shown(dec.contamination(df, items), "doc_id", "n_items", "first_item", "kept")
    leaked = [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 2), (6, 1, 2)]
    assert got == sorted([(*row, False) for row in leaked] + [(i, 0, None, True) for i, _ in others], key=repr)
    by_names_only = shown(dec.contamination(df, items, recased=False).filter("NOT kept"), "doc_id")
    assert {(1,), (6,)} <= set(by_names_only) and (2,) not in by_names_only
    assert shown(dec.keep_uncontaminated(df, items), "doc_id") == sorted([(i,) for i, _ in others], key=repr)
    plan = dec.keep_uncontaminated(df, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
