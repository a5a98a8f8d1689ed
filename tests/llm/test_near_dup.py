import random

import numpy as np
from llm.tables import documents, odd_texts, shown, text, words

from offerlens.llm import near_dup
from offerlens.llm.components import connected_components


def plain(rows, width=3, percent=85):
    """Components by all pairs."""
    sets, ids = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        found = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.append(found)
        ids.append(i)
    label = {i: i for i in ids if i is not None}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                x, y = ids[a], ids[b]
                if None in (x, y) or not sets[a] or not sets[b] or label[x] == label[y]:
                    continue
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return [(i, len(s), label[i] if i is not None else None, i is None or label[i] == i) for i, s in zip(ids, sets)]


def family(rng, first_id, size, length):
    """Copies of one text, each with up to a fifth of its words changed, so that some link and some do not."""
    base = words(rng, length)
    rows = []
    for k in range(size):
        own = list(base)
        for _ in range(rng.randrange(length // 8)):
            own[rng.randrange(length)] = words(rng, 1)[0]
        rows.append((first_id + k, " ".join(own)))
    return rows


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 900)  # many blocks
    rng = random.Random(5)
    rows = family(rng, 100, 60, 90) + family(rng, 300, 6, 400) + odd_texts() + [(i, text(rng, 50)) for i in range(500, 520)]
    rows += [(600 + i, rows[0][1].upper()) for i in range(20)]
    rng.shuffle(rows)
    got = shown(near_dup.near_duplicates(documents(spark, rows, clashing=True)), *COLUMNS)
    assert got == sorted(plain(rows), key=repr)


def test_stage_keeps_one_of_each_and_all_columns(spark):
    rng = random.Random(6)
    rows = [(k, t) for k, (_, t) in enumerate(family(rng, 0, 8, 120))] + [(50, None), (51, ""), (None, "a b c d")]
    df = documents(spark, rows, clashing=True)
    kept = near_dup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert shown(kept, "doc_id") == sorted(((r[0],) for r in plain(rows) if r[3]), key=repr)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        cut = int(600 * 2 * share / (1 + share))
        a, b = base, np.concatenate((base[:cut], rng.integers(0, 2**63, 600 - cut, dtype=np.uint64)))
        equal = np.mean(near_dup.signature(a, 1024) == near_dup.signature(b, 1024))
        assert abs(equal - cut / (1200 - cut)) < 0.06


def test_star_steps_reach_chains_and_hubs(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(200, 260)]
    links = chain + hub + [(5, 5)]
    rng.shuffle(links)
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    labels = {r.node: r.component for r in got.collect()}
    assert labels == {i: 100 for i in range(100, 161)} | {1: 1} | {i: 1 for i in range(200, 260)}
    assert got.count() == len(labels)


def test_repeated_rows_are_one_set(spark):
    """What is compared does not grow with the repeats of a row."""
    rng = random.Random(9)
    base = words(rng, 120)
    pair = [(1, " ".join(base)), (2, " ".join(base[:-2]))]
    got = {}
    for repeats in (1, 100):
        df = documents(spark, pair * repeats).repartition(5)
        ids = spark.createDataFrame([(1,), (2,)], "rep bigint")
        got[repeats] = shown(near_dup._sets(df, ids, near_dup.Sketch()), "rep", "size")
        found = near_dup.near_duplicates(df)
        assert found.count() == 2 * repeats
        assert shown(found.distinct(), *COLUMNS) == [(1, 118, 1, True), (2, 116, 1, False)]
    assert got[1] == got[100] == [(1, 118), (2, 116)]


def test_a_doc_id_with_two_texts_links_by_either(spark):
    rng = random.Random(10)
    one, two = words(rng, 90), words(rng, 90)
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one[:-2])), (3, " ".join(two[2:]))]
    got = near_dup.near_duplicates(documents(spark, rows))
    assert {r.component_id for r in got.collect()} == {1}


def test_the_pipeline_s_rule_equals_all_pairs(spark):
    """Five words and 80 percent."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = family(rng, 100, 25, 90) + family(rng, 300, 8, 300) + odd_texts()
    got = shown(near_dup.near_duplicates(documents(spark, rows), corpus_pipeline.NEAR), *COLUMNS)
    assert got == sorted(plain(rows, 5, 80), key=repr)
