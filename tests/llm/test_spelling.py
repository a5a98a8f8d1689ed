import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.tables import documents, odd_texts, shown

from offerlens.llm import spelling as sp

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, changed=None):
    """All rules by sets of written-out edits."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL_LETTERS)
            hash_ = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[changed(run, hash_) if changed else run] += 1
    words = {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}

    def near(word):
        places = range(len(word) + 1)
        edits = {word[:i] + word[i + 1 :] for i in places}
        edits |= {word[:i] + c + word[i + k :] for i in places for c in LETTERS for k in (0, 1)}
        return [edit for edit in edits if edit in words and edit != word]

    forms, found = {}, {word: near(word) for word in words}
    for word, others in found.items():
        best = min(others, key=lambda other: (-words[other], other), default=None)
        if best and words[best] >= 2 * words[word]:
            forms[word] = best

    def root(word):
        return root(forms[word]) if word in forms else word

    return sorted(((w, forms.get(w), root(w), n, len(found[w]), words.get(forms.get(w))) for w, n in words.items()), key=repr)


def variants(rng, n):
    """Words, misspelt words, and words misspelt twice."""
    out = []
    for _ in range(n):
        word = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(4, 9)))
        for times in (24, 9, 4, 3):
            out += [word] * times
            at, letter = rng.randrange(len(word)), rng.choice("abcdeéÿ")
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
    rng.shuffle(out)
    return [(i, " ".join(out[i::40])) for i in range(40)]


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_equals_written_out_edits(spark):
    rows = variants(random.Random(4), 120)
    expected = plain(rows)
    assert max(row[4] for row in expected) > 4 and any(row[1] not in (None, row[2]) for row in expected)
    assert shown(sp.spelling_variants(documents(spark, rows, clashing=True).drop("words")), *COLUMNS) == expected


def test_several_rounds_give_the_same(spark):
    rows = variants(random.Random(5), 60)
    some = sp.Spelling(round_words=50)
    assert shown(sp.spelling_variants(documents(spark, rows), some), *COLUMNS) == plain(rows)


def test_misprints_and_odd_rows(spark):
    rng = random.Random(6)
    long_ = "".join(rng.choice("abc") for _ in range(3000))
    rows = odd_texts() + variants(rng, 30) + [
        (70, f"{long_} {long_} {long_}"), (71, " ".join([long_[:1500] + "x" + long_[1500:]] * 6)), (72, " ".join(["aaaaaa", "aaaaa", "aaaaaaa"] * 5)),
        (73, "ÄRGER ärger Ärger " * 4), (74, "x×÷yz " * 3), (75, "i̇stan " * 9),
    ]
    expected = plain(rows, sp.misprint)
    assert expected != plain(rows)
    assert shown(sp.spelling_variants(documents(spark, rows), changed=sp.misprint), *COLUMNS) == expected
    empty = documents(spark, [(1, None), (2, ""), (3, "a b c")])
    assert sp.spelling_variants(empty).count() == 0
    assert sp.spelling_variants(empty.limit(0)).count() == 0


@pytest.mark.parametrize("length", (5, 6, 40, 64, 200))
def test_hashes_of_edits_are_those_of_their_texts(length):
    """With filters in which every bit is set, each edit comes out once, under the hash of its text."""
    rng = random.Random(length)
    words = ["".join(rng.choice("abz") for _ in range(length)) for _ in range(5)]
    [(_, codes)] = sp.by_length(words)
    alphabet = np.array(sorted(map(ord, "abcz")), np.uint64)
    whole = sp.Shards.of({}, 1, 0)
    every = np.full(whole.starts[-1], np.uint64(2**64 - 1))
    changed = [(words[row], text) for rows, texts in sp.replacements(codes, alphabet, every, whole) for row, text in zip(rows, texts)]
    expected = {(w, w[:i] + c + w[i + 1 :]) for w in words for i in range(length) for c in "abcz" if c > w[i]}
    assert set(changed) == expected
    rows, texts = sp.deletions(codes, every, whole)
    assert len(set(words)) < 5 or sorted(zip(rows, texts)) == sorted({(k, w[:i] + w[i + 1 :]) for k, w in enumerate(words) for i in range(length)})
    # only what is in the filter comes out, so the hashes must be those of the texts
    only = sorted({text for _, text in changed})[::7]
    blocks = np.zeros(whole.starts[-1], np.uint64)
    for _, own in sp.by_length(only):
        found = sp.hashes(own)
        for k in range(sp.BITS):
            np.bitwise_or.at(blocks, whole.blocks(found, length), sp._bit(found, k))
    hit = {text for _, texts in sp.replacements(codes, alphabet, blocks, whole) for text in texts}
    assert set(only) <= hit and len(hit) <= len(only) + len(expected) // 20
