"""Byte-level byte-pair encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. A minimal perfect hash finds the id of a
pre-token that is in the vocabulary as a whole. Others are merged from their bytes: the parts are a
linked list, and a heap holds the rank of every adjacent pair that can be joined.

No match of the pattern goes on from a non-space character over a single space or line end that
another non-space character follows, so texts are cut there first and pieces that were seen
before are looked up; the memory for them is bounded.

Defined results: a null text is an empty one, which has no ids; special strings are plain text.
"""

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.perfect_hash import PerfectHash
from offerlens.llm.text import Memo, kept_model, slices

REMEMBERED = 400_000
CHUNK_BYTES = 2 << 20

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        self.packed = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.whole = PerfectHash(self.packed)
        self.pattern = regex.compile(pattern)
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        # a word is merged once, whatever marks it comes with
        self.pre_tokens = Memo(self._looked_up, remembered // 4)
        self.plain = Memo(self._packed, remembered // 8)
        self.spaced = Memo(lambda piece: self._packed(" " + piece), remembered * 3 // 4)
        self.line_end = self._packed("\n")

    def _looked_up(self, pre_token: str) -> bytes:
        token = pre_token.encode()
        return self.whole.get(token) or self.merged(token)

    def _packed(self, piece: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.pattern.findall(piece)))

    def merged(self, token: bytes) -> bytes:
        """Join the adjacent parts of lowest rank, the leftmost first, until none can be joined."""
        ranks, packed, size = self.ranks, self.packed, len(token)
        after = list(range(1, size + 1))  # where the part that starts here ends; 0: joined away
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            rank = ranks.get(token[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, left, end = heapq.heappop(heap)
            middle = after[left]
            if not middle or middle >= size or after[middle] != end:
                continue  # one of the two has been joined with another since
            after[left], after[middle] = end, 0
            if end < size:
                before[end] = left
                joined = ranks.get(token[left : after[end]])
                if joined is not None:
                    heapq.heappush(heap, (joined, left, after[end]))
            previous = before[left]
            if previous >= 0:
                joined = ranks.get(token[previous:end])
                if joined is not None:
                    heapq.heappush(heap, (joined, previous, end))
        ids, start = [], 0
        while start < size:
            ids.append(packed[token[start : after[start]]])
            start = after[start]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        flat = text.replace("\n", " ")
        if flat.split() != flat.split(" "):  # white space that is not single spaces and line ends inside
            first, *rest = _SINGLE_SPACE.split(text)
            return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.plain[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.line_end.join(lines)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(ranks: tuple[bytes, ...], pattern: str, remembered: int) -> Encoder:
    """One per Python worker: tasks that follow find the pieces that earlier ones looked up."""
    key = ("byte pairs", ranks, pattern, remembered)
    return kept_model(key, lambda: Encoder({token: rank for rank, token in enumerate(ranks)}, pattern, remembered))


def byte_pairs(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (packed), decoded (the bytes that they stand for).

    The vocabulary file is read by the driver and goes out with the function, so only the driver
    needs it; its size does not depend on the data. Results leave a task in batches of bounded
    size, as ids take more room than their text. A worker remembers the ids of `remembered` pieces,
    which is a matter of time and memory only.
    """
    ranks = read_ranks(path)
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be the numbers from 0 on")
    tokens = tuple(sorted(ranks, key=ranks.__getitem__))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokens, pattern, remembered)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for part in slices(sizes, CHUNK_BYTES):
                size = part.stop - part.start
                ids = [encoder.encode(text) if text else b"" for text in texts.slice(part.start, size).to_pylist()]
                decoded = [encoder.decode(packed) for packed in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, size),
                        pa.array([len(packed) // 4 for packed in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(decoded, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    schema = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encoded, schema)


def digests(pairs: DataFrame, *more: str) -> DataFrame:
    """Per document of `byte_pairs` the SHA-256 of its packed ids and of its decoded bytes, and more of its columns."""
    return pairs.select(
        "doc_id", "n_tokens", *more, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
