import random
import zlib

import numpy as np
from llm.tables import documents, odd_texts, shown, words

from offerlens.llm import toxicity as tox

BAD = "vilest wretch filthy scoundrel".split()


def world(n=900, seed=3):
    """Texts of which a tenth hold bad words; a third of them are labelled."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        own = words(rng, rng.randrange(30, 80))
        truth[i] = int(rng.random() < 0.12)
        for _ in range(3 * truth[i]):
            own.insert(rng.randrange(len(own)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(own)))
    labels = [(i, 1, truth[i]) for i in truth if rng.random() < 0.4]
    return rows, labels, truth


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark):
    rows, labels, truth = world()
    got = tox.toxicity(documents(spark, rows, clashing=True), labelled(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    assert np.mean([truth[r.doc_id] == 1 for r in held if r.predicted]) > 0.9


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels, _ = world(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    df = documents(spark, rows)
    scores = [shown(tox.toxicity(df, labelled(spark, x)), "doc_id", "score") for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_odd_rows_no_labels_and_empty_tables(spark):
    df = documents(spark, odd_texts(), clashing=True)
    rows, labels, _ = world(300)
    both = documents(spark, rows + odd_texts()[:0] + [(i and i + 10_000, t) for i, t in odd_texts()])
    got = tox.toxicity(both, labelled(spark, labels + [(None, 1, 1), (5, None, None), (7, 1, 1), (7, 1, 0)]))
    assert got.count() == len(rows) + len(odd_texts())
    empty = {r.score for r in got.filter("doc_id IN (10011, 10012, 10013)").collect()}
    assert len(empty) == 1
    assert got.filter("doc_id IS NULL AND NOT held_out").count() == 2
    nothing = tox.toxicity(df, labelled(spark, []))
    assert nothing.count() == len(odd_texts()) and nothing.filter("predicted = 1").count() == 0
    assert tox.toxicity(df.limit(0), labelled(spark, labels)).count() == 0
    kept = tox.keep_clean(df, labelled(spark, []))
    assert kept.columns == df.columns and kept.count() == len(odd_texts())


def test_the_risk_is_corrected_where_it_falls_below_zero():
    """A prior that is too high for the unlabelled rows would push the plain estimate below zero."""
    rng = np.random.default_rng(2)
    toxic = (rng.random((200, 3)) < [0.9, 0.5, 0.5]).astype(np.float32)
    free = (rng.random((800, 3)) < [0.05, 0.5, 0.5]).astype(np.float32)
    weights, intercept = tox.train(toxic, free, 0.3, tox.Learning())
    assert np.all(np.isfinite(weights)) and weights[0] > 2 > abs(weights[1])
    assert abs(tox.sigmoid(free @ weights + intercept).mean() - 0.3) < 1e-6


def test_counts_of_features_cover_all_training_text(spark):
    rows, _, _ = world(200)
    word = tox.word_features()
    wanted = {word[w.encode()] for w in BAD}
    got = tox._document_counts(documents(spark, rows + odd_texts()).repartition(7), frozenset(wanted))
    plain = {-1: len(rows) + len(odd_texts())}
    for _, text in rows + odd_texts():
        for feature in wanted.intersection(tox.words_of((text or "").encode(), tox.word_features())):
            plain[feature] = plain.get(feature, 0) + 1
    assert got == plain and len(got) == len(BAD) + 1


def test_every_text_labelled(spark):
    """Without a row that has no label, all training text still is the unlabelled side."""
    rows, _, truth = world(500)
    got = tox.toxicity(documents(spark, rows), labelled(spark, [(i, 1, t) for i, t in truth.items()])).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
