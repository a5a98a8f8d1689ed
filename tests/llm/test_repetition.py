from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm.tables import documents, odd_texts, shown

from offerlens.llm import repetition as rep

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept")


def covered(words, size):
    runs = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return {i + k for i in range(len(words) - size + 1) if runs[tuple(words[i : i + size])] > 1 for k in range(size)}


def plain(text, limits=rep.Limits()):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    repeat, long = len(covered(words, 3)), len(covered(words, limits.min_words))
    failed = n < 50 or 100 * repeat > 50 * n
    too_long = bool(covered(words, limits.max_words + 1))
    kept = not failed and 100 * long <= limits.max_percent * n and not too_long
    chars = sum(len(w.decode()) for w in words)
    return (n, chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, long, failed, kept)


def test_profiles_equal_counting_windows(spark):
    rows = odd_texts()
    base = rows[0][1].split()
    rows += [(30, " ".join(base[:60] + base[:12] + base[60:])), (31, " ".join(base + base[:40])), (32, " ".join(base * 2))]
    got = shown(rep.repetition_rules(documents(spark, rows, clashing=True)), *COLUMNS)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert {row[0]: row[-1] for row in got}[30] and not {row[0]: row[-1] for row in got}[32]


def test_empty_table_and_kept_columns(spark):
    df = documents(spark, odd_texts(), clashing=True)
    kept = rep.keep_varied(df)
    assert kept.columns == df.columns
    assert shown(kept, "doc_id", "text") == sorted(((i, t) for i, t in odd_texts() if plain(t)[-1]), key=repr)
    assert rep.repetition_rules(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=4), st.integers(1, 4))
def test_spans_and_longest_runs(docs, least):
    columns = rep._profiles([" ".join(words).encode() for words in docs], least)
    for i, words in enumerate(docs):
        expected = covered(words, least)
        spans = columns[7][i].as_py()
        assert {p for span in spans for p in range(span["first"], span["last"] + 1)} == expected
        longest = max((size for size in range(1, len(words) + 1) if covered(words, size)), default=0)
        assert columns[6][i].as_py() == (longest if longest >= least else 0)


def test_a_long_single_run_is_linear_enough():
    codes = np.append(np.zeros(200_000, np.int64), 1)
    assert rep.match_lengths(codes, np.zeros(len(codes), np.int64))[0] == 199_999
