import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.tables import documents, odd_texts

from offerlens.llm import collocation as co

SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL_LETTERS)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    return f, totals


def plain(rows, least, top):
    f, totals = plain_counts(rows)
    f = {key: n for key, n in f.items() if n >= least}
    around = Counter()
    for (lang, words), n in f.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                around[inner] = max(around[inner], n)
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and around[lang, words] < a:
            n = totals[lang]
            score, k = min((1000 * a * n // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            row = (-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]])
            found.setdefault(lang, []).append(row)
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1)
    )


def chatter(seed, n, lang):
    """A few very common words, common phrases, and rare words in between."""
    rng = random.Random(seed)
    phrases = ["of the", "in the end", "A b c D e f", "the the", "é ß", "of the time", "x\ty"]
    rare = [f"w{i}" for i in range(300)]
    return [(lang, " ".join(rng.choice(rng.choice([phrases, ["the"], rare])) + rng.choice(["", "", ".", "\n", " ,"]) for _ in range(n))) for _ in range(8)]


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, "s", "x", "y") for i, (lang, text) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, source string, n string, phrase string")


@pytest.mark.parametrize("budget", (10, 60, 400, 500_000))
def test_equals_plain_counts(spark, budget):
    rows = chatter(1, 200, "en") + chatter(2, 150, "de") + chatter(3, 100, None)
    got = co.collocations(table(spark, rows), co.Phrases(least=5, budget=budget), top=30).collect()
    expected = plain(rows, 5, 30)
    assert sorted(map(tuple, got)) == expected
    assert len(expected) > 60 and {len(row[2].split()) for row in expected} >= {2, 3, 5}


def test_counts_of_all_frequent_phrases(spark):
    """A repeated word, and a hot prefix of every length down to the deepest."""
    rows = [("en", "go " * 900), ("en", "a b c d e f g. " * 300), ("de", "go go"), ("en", "go on")]
    counts, totals = co.phrase_counts(table(spark, rows), co.Phrases(least=3, budget=20))
    f, n = plain_counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {key: x for key, x in f.items() if x >= 3}
    assert counts.filter("n_words <> size(split(phrase, ' '))").count() == 0 and counts.count() == len({k for k, x in f.items() if x >= 3})
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_odd_rows_and_empty_tables(spark):
    odd = odd_texts()
    rows = [("en", text) for _, text in odd] + [(None, text) for _, text in odd] + [("", "x y z " * 9), ("en", "." * 50), ("en", "\x1c \x1c " * 9)]
    got = co.collocations(table(spark, rows), co.Phrases(least=3, budget=50)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 2000)
    nothing = table(spark, [("en", None), (None, ""), ("de", "a b")])
    assert co.collocations(nothing).count() == 0
    result = co.collocations(nothing.limit(0))
    assert result.count() == 0 and result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    clashing = documents(spark, [(i, "one two three " * 5) for i in range(9)], clashing=True)
    assert co.collocations(clashing, co.Phrases(least=9)).first()["phrase"]


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2**63 where the counts are those of a large corpus."""
    counts = spark.createDataFrame(
        [("en", "p", 1, 9 * 10**11), ("en", "q", 1, 8 * 10**11), ("en", "p q", 2, 7 * 10**11)], "lang string, phrase string, n_words int, f bigint"
    )
    totals = spark.createDataFrame([("en", 31 * 10**12)], "lang string, n bigint")
    real, co.phrase_counts = co.phrase_counts, lambda docs, phrases: (counts, totals)
    try:
        [row] = co.collocations(counts).collect()
    finally:
        co.phrase_counts = real
    assert row.score == 1000 * 7 * 10**11 * 31 * 10**12 // (9 * 8 * 10**22)


def test_slots_are_packed_by_the_budget():
    weights = np.array([70, 10, 0, 45, 45, 300, 20, 10], np.int64)
    groups = co.packed(weights, 100)
    sums = np.bincount(groups, weights)
    assert all(total <= 100 or (groups == group).sum() == 1 or weights[groups == group].max() <= 100 for group, total in enumerate(sums))
    assert sums[groups[5]] == 300 and sums.sum() == weights.sum()


def test_only_what_goes_on_is_sent_to_the_trees(spark, monkeypatch):
    """Words and pairs have their own counts, and a sequence ends where four words are infrequent."""
    sent, real = [], co.sequences
    monkeypatch.setattr(co, "sequences", lambda *args: sent.append(real(*args)) or sent[-1])
    pairs = ["".join(f"v{i} v{k}." for i in range(9) for k in range(9)) for _ in range(5)]
    fours = ["".join(f"{first} y z t{i}." for first in "xq" for i in range(40)) for _ in range(4)]
    rows = [("en", text) for text in pairs + fours]
    counts, _ = co.phrase_counts(table(spark, rows).coalesce(1), co.Phrases(least=5))
    f, _ = plain_counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {key: n for key, n in f.items() if n >= 5}
    # x y z, q y z, and y z with each t
    assert sent[0].count() == 42


def test_words_that_share_a_number(spark):
    rows = chatter(1, 200, "en") + chatter(2, 150, "de") + chatter(3, 100, None)
    words = co.word_counts(table(spark, [(lang or "und", text) for lang, text in rows])).collect()
    numbers = [co.word_hash(r.lang, r.word.encode()) >> 52 for r in words]
    assert len(set(numbers)) < len(numbers) - 20 and any(number < 512 for number in numbers)
    got = co.collocations(table(spark, rows), co.Phrases(least=5, budget=60, bits=12), top=30).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, 30)


def test_hashes_are_those_of_spark_and_pairs_come_back(spark):
    words = [(lang, "é" * n + "x" * k) for lang in ("en", "", "ß") for n in range(3) for k in range(0, 80, 7)]
    got = spark.createDataFrame(words, "lang string, word string").selectExpr("lang", "word", "xxhash64(lang, word) AS hash").collect()
    assert all(r.hash % 2**64 == co.word_hash(r.lang, r.word.encode()) for r in got)
    first, second = np.random.default_rng(1).integers(0, 2**32, (2, 1000), np.uint64)
    assert (co.pairs_of(co.pair_hashes(first, second)) == np.stack([first, second], axis=1)).all()
