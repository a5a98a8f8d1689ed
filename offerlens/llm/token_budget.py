"""Exact token counts of every prefix of a text, by dynamic programming over word pieces.

The tokenizer lower-cases, drops white space, cuts words by a pattern and merges each word's bytes,
the last of which carries a word end. For a word, `last[i]` is the last token of its first i
bytes: the token t that ends there whose left neighbour is `last[i - len(t)]` and that the merges
do not join or cut otherwise. One token more than at its left end is the count at i. As each
prefix may itself be the end of a cut text, the count with a word end is kept for every i.

Counts of a text's prefixes are sums over its pieces, so whole texts, truncations and budgets
need no second encoding.

Defined results: a null text is an empty one with 0 tokens. A special string of the tokenizer
inside a text is one token, as is the library's default. Texts with other normal forms get the
counts of their normalised prefixes.
"""

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm.text import Memo, kept_model, slices

REMEMBERED = 300_000
CHUNK_BYTES = 4 << 20
BUDGET = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


class PrefixCounter:
    def __init__(self, merges: tuple[tuple[str, str], ...], pattern: str, end: str, special: tuple[str, ...]):
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.letters = byte_letters()
        # the two parts of each merged token, and the rank of the merge
        self.parts = {a + b: (a, b, rank) for rank, (a, b) in enumerate(merges)}
        whole = {*self.letters, *(letter + end for letter in self.letters), *self.parts}
        self.open = {token for token in whole if not token.endswith(end)}
        self.closing = {token[: -len(end)]: token for token in whole if token.endswith(end)}
        self.longest = max(map(len, whole))
        self.end = end
        self.pattern = regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fit = Memo(self._fit, REMEMBERED)
        # the word worked out last, and for each of its prefixes the last token, the tokens, the token's size
        self.path = "", [""], [0], [0]
        self.words = Memo(self._word, REMEMBERED // 8)
        self.ends = Memo(self._end, REMEMBERED)
        self.totals = Memo(self._total, 2 * REMEMBERED)

    def _fit(self, pair: tuple[str, str]) -> bool:
        """Whether the merges keep these two tokens apart.

        Goes back in time from the finished tokens: the one merged last is taken apart, and what
        then stands at the border must not have been joined by an earlier merge. Of two equal
        merges the left one is first.
        """
        left, right = pair
        parts, ranks, limit = self.parts, self.ranks, len(self.ranks)
        a, b = parts.get(left), parts.get(right)
        while True:
            if ranks.get((left, right), limit) < limit:
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] > b[2]:
                left, limit = a[1], a[2]
                a = parts.get(left)
            else:
                right, limit = b[0], b[2] + 1
                b = parts.get(right)

    def _steps(self, letters: str) -> tuple[list[int], list[int]]:
        """For each prefix of a word its tokens and the length of its last one.

        The prefixes are open: the word goes on after them. `closed` gives their tokens as ends.
        What the word shares with the one before is taken from there, so words in order and
        prefixes in turn cost their new letters only.
        """
        vocabulary, fit, longest = self.open, self.fit, self.longest
        before, last, counts, sizes = self.path
        same = _shared(before, letters)
        for steps in (last, counts, sizes):
            del steps[same + 1 :]
        self.path = letters, last, counts, sizes
        for i in range(same + 1, len(letters) + 1):
            for j in range(max(0, i - longest), i):
                token = letters[j:i]
                if token in vocabulary and (not j or fit[last[j], token]):
                    last.append(token)
                    counts.append(counts[j] + 1)
                    sizes.append(i - j)
                    break
        return counts, sizes

    def _end(self, letters: str) -> int:
        """Tokens of a whole word."""
        return self._closed(letters, *self._steps(letters), len(letters))

    def _word(self, letters: str) -> tuple[array, bytes]:
        """`_steps` in a form that lasts."""
        counts, sizes = self._steps(letters)
        return array("i", counts), bytes(sizes)

    def _closed(self, letters: str, counts: Sequence[int], sizes: Sequence[int], i: int) -> int:
        """Tokens of the first i letters as if the word ended there."""
        for j in range(max(0, i - self.longest), i):
            token = self.closing.get(letters[j:i])
            if token and (not j or self.fit[letters[j - sizes[j] : j], token]):
                return counts[j] + 1
        return 0

    def closed(self, letters: str) -> list[int]:
        """Tokens of each prefix of a word as if the word ended there."""
        counts, sizes = self.words[letters]
        return [self._closed(letters, counts, sizes, i) for i in range(len(letters) + 1)]

    def _letters(self, word: str) -> str:
        # printable ASCII stands for itself
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.letters.__getitem__, word.encode()))

    def _total(self, piece: str) -> int:
        """Tokens of a piece as a whole text, special strings included."""
        if self.special and (found := len(self.special.findall(piece))):
            return found + sum(self._total(part) for part in self.special.split(piece))
        return sum(map(self.ends.__getitem__, self._cut(piece)))

    def _cut(self, piece: str) -> list[str]:
        """The words of a piece without special strings, a letter for each byte."""
        normal = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        return list(map(self._letters, self.pattern.findall(_lower(normal))))

    def table(self, piece: str) -> array:
        """Tokens of each prefix, by code points, of a piece without spaces and line ends.

        A special string ends what stands before it; until it is whole it is plain text.
        """
        counts, before, at = array("i", [0]), 0, 0
        for match in self.special.finditer(piece) if self.special else ():
            counts.extend([before + n for n in self._plain_table(piece[at : match.start()])[1:]])
            counts.extend([before + self._total(piece[at:i]) for i in range(match.start() + 1, match.end())])
            before += self._total(piece[at : match.end()])
            counts.append(before)
            at = match.end()
        counts.extend([before + n for n in self._plain_table(piece[at:])[1:]])
        return counts

    def _plain_table(self, piece: str) -> array:
        """`table` without special strings: parts that are changed by normal forms are taken apart."""
        if not _changed(piece):
            return self._even_table(piece)
        counts, before = array("i", [0]), 0
        for part in _parts(piece):
            if _changed(part):
                added = [self._total(part[:i]) for i in range(1, len(part) + 1)]
            else:
                added = self._even_table(part)[1:]
            counts.extend([before + n for n in added])
            before = counts[-1]
        return counts

    def _even_table(self, piece: str) -> array:
        lowered = _lower(piece)
        counts, before = array("i", bytes(4 * (len(piece) + 1))), 0
        at = 0
        for match in self.pattern.finditer(lowered):
            for i in range(at, match.start() + 1):
                counts[i] = before
            at = match.start()
            if "'" in match[0] or match[0].isascii() is False and not match[0].isalpha():
                # cut contractions and marks may be words of another kind: take them as they stand
                for i in range(at + 1, match.end() + 1):
                    counts[i] = before + self._total(lowered[at:i])
            else:
                closed, byte = self.closed(self._letters(match[0])), 0
                for i, letter in enumerate(match[0], at + 1):
                    byte += len(letter.encode())
                    counts[i] = before + closed[byte]
            at = match.end()
            before = counts[at]
        for i in range(at, len(piece) + 1):
            counts[i] = before
        return counts

    def learn(self, texts: list[str]) -> None:
        """Work out the new pieces of these texts, their words in order so that prefixes are shared."""
        unseen = set()
        for text in texts:
            unseen.update(text.replace("\n", " ").split(" "))
        totals, ends = self.totals, self.ends
        cuts = {
            piece: self._cut(piece)
            for piece in unseen
            if piece not in totals and piece not in totals.old and len(piece) <= totals.longest
            and not (self.special and self.special.search(piece))
        }
        tokens = {letters: ends[letters] for letters in sorted({letters for cut in cuts.values() for letters in cut})}
        for piece, cut in cuts.items():
            totals.keep(piece, sum([tokens[letters] for letters in cut]))

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, text.replace("\n", " ").split(" ")))

    def fit_chars(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most so many tokens."""
        best = at = before = 0
        for piece in text.replace("\n", " ").split(" "):
            total = self.totals[piece]
            if before + total <= budget:
                best = at + len(piece)
            else:
                best = max([best] + [at + i for i, n in enumerate(self.table(piece)) if before + n <= budget])
            before += total
            at += len(piece) + 1
            if before > budget:
                break
            best = min(at, len(text))
        return best

    def prefixes(self, text: str) -> array:
        """Tokens of every prefix of the text, the empty one first."""
        found, before = array("i", [0]), 0
        for k, piece in enumerate(text.replace("\n", " ").split(" ")):
            counts = self.table(piece)
            found.extend([before + n for n in (counts if k else counts[1:])])
            before += counts[-1]
        return found


def _shared(one: str, other: str) -> int:
    """Letters at the start that two words have in common."""
    size = min(len(one), len(other))
    if one[:size] == other[:size]:
        return size
    return next(i for i in range(size) if one[i] != other[i])


def _changed(piece: str) -> bool:
    """Whether normal forms or lower case may count another number of code points in a piece or a prefix."""
    return not piece.isascii() and (
        unicodedata.normalize("NFC", piece) != piece
        or len(_lower(piece)) != len(piece)
        or any(map(unicodedata.combining, piece))
    )


def _kind(letter: str) -> str:
    """What the word pattern tells apart: letters, numbers, and all else."""
    return category if (category := unicodedata.category(letter)[0]) in "LN" else "-"


def _joins(letter: str) -> bool:
    """Whether a code point may become one with those before it: marks and the parts of syllables."""
    return unicodedata.category(letter)[0] == "M" or "\u1100" <= letter <= "\u11ff" or letter >= "\U00016d63"


def _parts(piece: str) -> Iterator[str]:
    """Cuts where neither a normal form nor a word goes on, so tokens of the parts add up.

    There a code point that joins nothing before it follows one of another kind in normal form. No
    cut follows an apostrophe, which may begin a word of letters.
    """
    start = base = 0
    for i in range(1, len(piece)):
        if not _joins(piece[i]):
            end = _lower(unicodedata.normalize("NFC", piece[base:i]))[-1]
            if end != "'" and _kind(end) != _kind(_lower(unicodedata.normalize("NFC", piece[i]))[0]):
                yield piece[start:i]
                start = i
            base = i
    yield piece[start:]


def _lower(text: str) -> str:
    """Each character by itself, as the tokenizer does; a final sigma has no form of its own."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def _counter(*settings) -> PrefixCounter:
    return kept_model(("prefix counts", *settings), lambda: PrefixCounter(*settings))


def read_settings(path: str) -> tuple:
    """Merges, word pattern, word end and special strings of a tokenizer file of the kind described above."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = tuple(tuple(pair) if isinstance(pair, list) else tuple(pair.split(" ")) for pair in spec["model"]["merges"])
    split = next(step for step in spec["pre_tokenizer"]["pretokenizers"] if step["type"] == "Split")
    special = tuple(token["content"] for token in spec["added_tokens"])
    return merges, split["pattern"]["Regex"], spec["model"]["end_of_word_suffix"], special


def budget(text: Column, path: str, limit: int) -> Column:
    """Per text its tokens and the code points of its longest prefix of at most `limit` tokens."""
    settings = read_settings(path)

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(*settings)
        for batch in batches:
            totals, fits = [], []
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            for rows in slices(sizes, CHUNK_BYTES):
                texts = [text or "" for text in batch.slice(rows.start, rows.stop - rows.start).to_pylist()]
                counter.learn(texts)
                for text in texts:
                    n = counter.count(text)
                    totals.append(n)
                    fits.append(len(text) if n <= limit else counter.fit_chars(text, limit))
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], ["n_tokens", "fit_chars"])

    return F.arrow_udf(counted, BUDGET)(text)


def prefix_counts(text: Column, path: str) -> Column:
    """The token count at every prefix of each text, by code points."""
    settings = read_settings(path)

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(*settings)
        for batch in batches:
            yield pa.array([counter.prefixes(text or "") for text in batch.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(counted, T.ArrayType(T.IntegerType()))(text)


def token_budgets(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, fit_chars, over_limit."""
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), budget(F.col("text"), path, limit).alias("b"))
    return counted.select("doc_id", "n_bytes", "b.*", (F.col("b.n_tokens") > limit).alias("over_limit"))
