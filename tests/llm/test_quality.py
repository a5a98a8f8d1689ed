import random
import zlib

import numpy as np
from llm.tables import documents, odd_texts, shown, words

from offerlens.llm import quality as ql


def world(n=700, seed=5):
    """Prose, and three kinds of junk made of the same words; a part of them is labelled."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        own = words(rng, rng.randrange(30, 80))
        kind = rng.choice(["prose"] * 4 + ["shout", "marks", "same"])
        if kind == "shout":
            own = [word.upper() + "!!" for word in own]
        elif kind == "marks":
            own = [word + rng.choice(["###", "%%%"]) for word in own]
        elif kind == "same":
            own = [word for word in own[:5] for _ in range(12)]
        truth[i] = int(kind == "prose")
        rows.append((i, " ".join(own)))
    return rows, [(i, truth[i], 0) for i in truth if rng.random() < 0.7], truth


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark):
    rows, labels, truth = world()
    got = ql.quality(documents(spark, rows, clashing=True).drop("label"), labelled(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_labels_of_the_held_out_fold_other_columns_and_order_do_not_matter(spark):
    rows, labels, _ = world(400)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t) for i, q, t in labels]
    one = ql.quality(documents(spark, rows), labelled(spark, labels))
    other = ql.quality(documents(spark, rows[::-1], clashing=True).repartition(5).drop("lang", "source"), labelled(spark, flipped[::-1]))
    assert shown(one, "doc_id", "score") == shown(other, "doc_id", "score")


def test_odd_rows_no_labels_and_empty_tables(spark):
    rows, labels, _ = world(300)
    both = documents(spark, rows + [(i and i + 10_000, text) for i, text in odd_texts()])
    odd_labels = [(None, 0, 1), (5, None, None), (7, 1, 1), (7, 0, 0), (10_011, 1, 0), (10_012, 0, 0), (10_014, 1, 0)]
    got = ql.quality(both, labelled(spark, labels + odd_labels))
    assert got.count() == len(rows) + len(odd_texts()) and got.filter("score IS NULL").count() == 0
    assert len({r.score for r in got.filter("doc_id IN (10011, 10012, 10013)").collect()}) == 1
    assert got.filter("doc_id IS NULL AND NOT held_out").count() == 2
    nothing = ql.quality(both, labelled(spark, []))
    assert {(r.score, r.predicted) for r in nothing.collect()} == {(0.5, 1)}
    one_class = ql.quality(both, labelled(spark, [(i, 1, 0) for i, _ in rows]))
    assert one_class.filter("predicted = 0").count() == 0
    assert ql.quality(both.limit(0), labelled(spark, labels)).count() == 0


def test_the_sample_is_bounded_and_every_text_is_scored(spark):
    rows, labels, _ = world(300)
    few = ql.Learning(learners=2, rows=40)
    got = ql.quality(documents(spark, rows), labelled(spark, labels), learning=few)
    assert got.count() == 300 and got.select("score").distinct().count() > 200


def plain_train(texts, labels, learning, seed):
    """The update rules written place by place."""
    z, n, weights = {}, {}, {}
    order = np.random.default_rng(seed)
    for _ in range(learning.passes):
        for i in order.permutation(len(texts)):
            items = [*zip(texts[i][0].tolist(), texts[i][1].tolist()), (1 << learning.bits, 1.0)]
            for place, _ in items:
                own, l1 = z.get(place, 0.0), 0.0 if place == 1 << learning.bits else learning.l1
                step = (learning.beta + n.get(place, 0.0) ** 0.5) / learning.alpha + learning.l2
                weights[place] = 0.0 if abs(own) <= l1 else -(own - np.sign(own) * l1) / step
            error = 1 / (1 + np.exp(-sum(weights[place] * value for place, value in items))) - labels[i]
            for place, value in items:
                g, old = error * value, n.get(place, 0.0)
                sigma = ((old + g * g) ** 0.5 - old**0.5) / learning.alpha
                z[place] = z.get(place, 0.0) + g - sigma * weights[place]
                n[place] = old + g * g
    for place in z:
        l1 = 0.0 if place == 1 << learning.bits else learning.l1
        step = (learning.beta + n[place] ** 0.5) / learning.alpha + learning.l2
        weights[place] = 0.0 if abs(z[place]) <= l1 else -(z[place] - np.sign(z[place]) * l1) / step
    return weights


def test_training_equals_the_rules_written_out():
    rows, _, truth = world(60)
    learning = ql.Learning(bits=12, passes=2)
    features = ql.Features(learning)
    texts = [features(text.encode()) for _, text in rows]
    got = ql.train(texts, list(truth.values()), learning, 3)
    expected = plain_train(texts, list(truth.values()), learning, 3)
    assert np.allclose([got[place] for place in expected], list(expected.values()), atol=1e-9)
    assert np.count_nonzero(got) == sum(1 for weight in expected.values() if weight) < len(expected)


def test_shapes_and_lengths():
    assert ql.shape(b"THEA,!!") == b"A,!" and ql.shape("Éa12-bC".encode()) == b"a9-aA" and ql.shape(b"|") == b"|"
    features = ql.Features(ql.Learning())
    for text in (b"", b" \n", b"one", b"a b c d " * 50):
        places, values = features(text)
        assert len(np.unique(places)) == len(places) and (not text.split() or abs((values**2).sum() - 1) < 1e-12)
