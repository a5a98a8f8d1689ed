import hashlib
import random
import struct

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm.tables import documents, odd_texts, shown
from tokenizers import Tokenizer

from offerlens.llm import bpe, token_budget
from offerlens.llm.perfect_hash import PerfectHash
from offerlens.llm.text import Memo

RANKS, WORDS = public.path("byte_bpe_50k.tiktoken"), public.path("word_bpe_49k.json")
ALPHABET = list("abcXYZ019 \n\t  \r.,!'’sđñé中文😀́  \x1c\x85Σςİ½²_<|>　") + [
    "'ll", "<|endoftext|>", "<|startoftext|>", "the ", "tion", "  ",
]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)
MANY = settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), public.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_budget.PrefixCounter(*token_budget.read_settings(WORDS))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@MANY
@given(text=TEXTS)
def test_byte_pairs_equal_the_library_and_go_back(encoder, library, text):
    packed = encoder.encode(text)
    assert ids(packed) == library.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


def test_a_small_memory_gives_the_same_ids(library):
    small = bpe.Encoder(bpe.read_ranks(RANKS), public.PATTERN, 16)
    for i in range(40):
        text = f"w{i} the cat{i}, x{i}y\nsat " * 3
        assert ids(small.encode(text)) == library.encode_ordinary(text)
    assert all(len(memo) <= 12 and len(memo.old) <= 12 for memo in (small.pre_tokens, small.plain, small.spaced))


def test_merges_of_whole_words_and_long_runs(encoder, library):
    for text in ("a" * 3000, "ab" * 2000, "!?" * 999, "\n" * 50, " " * 77 + "x"):
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_exact():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(5000)}
    values = {key: i for i, key in enumerate(keys)}
    table = PerfectHash(values)
    assert len(table.keys) == len(keys) and set(table.keys) == keys
    assert all(table.get(key) == i for key, i in values.items())
    assert all(table.get(key + b"~~~~~~~~~") is None for key in keys)


def test_memory_for_pieces_is_bounded():
    memo = Memo(len, 10)
    assert [memo["x" * (i % 37)] for i in range(500)] == [i % 37 for i in range(500)]
    assert len(memo) <= 10 and len(memo.old) <= 10
    brief = Memo(len, 10, longest=5)
    assert [brief["x" * i] for i in range(9)] == list(range(9)) and max(map(len, brief)) == 5


@MANY
@given(text=TEXTS)
def test_counts_equal_the_library_at_every_prefix(counter, word_library, text):
    expected = [len(word_library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert list(counter.prefixes(text)) == expected
    assert counter.count(text) == expected[-1]
    for limit in (0, 2, 5):
        assert counter.fit_chars(text, limit) == max(i for i, n in enumerate(expected) if n <= limit)


def test_pieces_without_spaces_take_linear_time(counter, word_library):
    """Marks, decomposed letters and special strings in one long piece: prefixes add up over its parts."""
    unspaced = ["ภาษาไทยเป็นภาษาที่มีวรรณยุกต์" * 4, "éa´1" * 9, "ab<|endoftext|>cd<|endof" * 3, "—" * 60, "가각ᆨ" * 5]
    for text in unspaced:
        expected = [len(word_library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert list(counter.table(text)) == expected
    long = "ภาษาไทยเป็นภาษาที่มีวรรณยุกต์" * 1000
    parts = list(token_budget._parts(long))
    assert "".join(parts) == long and max(map(len, parts)) < 20
    assert counter.prefixes(long)[-1] == len(word_library.encode(long, add_special_tokens=False).ids)


def test_batches_learn_what_single_texts_give(word_library):
    texts = ["the cat sat, the cats", "", "cat\ncatalogue don't <|endoftext|>x", "éa ภาษา " + "x" * 100]
    learned = token_budget.PrefixCounter(*token_budget.read_settings(WORDS))
    learned.learn(texts)
    assert [learned.count(t) for t in texts] == [len(word_library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_rows_of_both_tables(spark, library, word_library):
    rows = odd_texts()
    df = documents(spark, rows, clashing=True)
    got = shown(bpe.digests(bpe.byte_pairs(df, RANKS, public.PATTERN)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = []
    for i, t in rows:
        found = library.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(found)}I", *found)
        expected.append((i, len(found), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    got = shown(token_budget.token_budgets(df, WORDS, 2048), "doc_id", "n_bytes", "n_tokens", "over_limit")
    counts = [len(word_library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, counts)), key=repr)
    assert bpe.byte_pairs(df.limit(0), RANKS, public.PATTERN).count() == 0
    assert token_budget.token_budgets(df.limit(0), WORDS, 5).count() == 0
    short = df.filter("doc_id IN (15, 16, 20)")
    tables = short.select("text", token_budget.prefix_counts(short["text"], WORDS).alias("p")).collect()
    for row in tables:
        assert row.p == [len(word_library.encode(row.text[:i], add_special_tokens=False).ids) for i in range(len(row.text) + 1)]
