"""A minimal perfect hash of byte strings: as many slots as keys, none shared."""

from collections import defaultdict

import xxhash

_digest = xxhash.xxh64_intdigest


class PerfectHash:
    """Hash and displace: a first hash gives a bucket, the bucket's seed gives each key its slot.

    Buckets with several keys take the first seed that sends all of them to free slots, the largest
    buckets first. Buckets with one key then name a free slot outright, as a negative number.
    """

    def __init__(self, values: dict[bytes, int]):
        self.size = size = len(values)
        buckets = defaultdict(list)
        for key in values:
            buckets[_digest(key) % size].append(key)
        self.seeds = [0] * size
        self.keys: list[bytes | None] = [None] * size
        single = []
        for bucket, keys in sorted(buckets.items(), key=lambda item: -len(item[1])):
            if len(keys) == 1:
                single.append((bucket, keys[0]))
                continue
            seed = 1
            while True:
                slots = [_digest(key, seed) % size for key in keys]
                if len(set(slots)) == len(slots) and all(self.keys[slot] is None for slot in slots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for slot, key in zip(slots, keys):
                self.keys[slot] = key
        free = (slot for slot in range(size) if self.keys[slot] is None)
        for (bucket, key), slot in zip(single, free):
            self.seeds[bucket] = -slot - 1
            self.keys[slot] = key
        self.values = [values[key] for key in self.keys]

    def get(self, key: bytes) -> int | None:
        seed = self.seeds[_digest(key) % self.size]
        slot = -seed - 1 if seed < 0 else _digest(key, seed) % self.size
        return self.values[slot] if self.keys[slot] == key else None
