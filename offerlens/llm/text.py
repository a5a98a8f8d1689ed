"""Words, chunks and word hashes that several operators share."""

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

# Word ends are the six ASCII white-space bytes, which are also what bytes.split() takes.
WHITE_SPACE = b" \t\n\v\f\r"


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [text or b"" for text in texts.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Runs of rows whose sizes add up to the limit, or one row that is larger."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class Memo(dict):
    """Values of a pure function by key, with a bound on what stays in memory.

    Two generations: when the young one is full it becomes the old one, so keys in use survive.
    Values of keys longer than `longest` are worked out each time, so the bytes are bounded too.
    """

    def __init__(self, function, size: int, longest: int = 64):
        super().__init__()
        self.function, self.size, self.longest, self.old = function, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > self.longest:
                return value
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


_model: dict[Hashable, Any] = {}


def kept_model(key: Hashable, make: Callable[[], Any]) -> Any:
    """A model that stays in this Python worker for the tasks that follow, until another one comes."""
    if key not in _model:
        _model.clear()
        _give_back()
        _model[key] = make()
    return _model[key]


def _give_back() -> None:
    """Freed memory back to the system, also what operators without a model have left."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop_model() -> None:
    """For tasks of operators that keep no model: give back the memory of the operators before them.

    Python workers outlive a stage, so without this each would hold what all earlier stages kept.
    """
    if _model:
        _model.clear()
        _give_back()


def leaves_nothing(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For tasks of operators that keep no model: begin without one, and end with what the task freed given back.

    An idle worker would else hold the largest batch that it has seen while the next stage runs.
    """

    @wraps(function)
    def task(batches):
        drop_model()
        yield from function(batches)
        _trim()

    return task


class WordHashes:
    """64-bit hashes of words, the same in every task."""

    def __init__(self, size: int = 60_000):
        self.memo = Memo(xxhash.xxh64_intdigest, size)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The numbers that `mix` makes into these."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of `width` words; fewer words are one run."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    rows = len(hashes) - width_here + 1
    code = np.full(rows, width_here, np.uint64)
    for k in range(width_here):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + rows])
    return np.unique(code)
