"""Five-word shingles as 64-bit numbers, min-hash signatures, and the forest of signature tries over them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import xxhash

WORDS = 5
SIMILARITY = 0.8
CACHE = 300_000
#: Tries of the forest, how deep they are, and the shortest prefix that a query may match.
TREES, DEPTH, LEAST = 28, 6, 4
#: Wanted share of the pairs at exactly the least similarity that meet in a bucket.
RECALL = 0.99999
_ODD = np.random.default_rng(5).integers(1 << 30, 1 << 31, (TREES * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 32, (TREES * DEPTH, 1), dtype=np.uint32)
_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The shingles of texts; hashes of words met before are kept, up to CACHE of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The different shingles, ascending. A text of one to four words is one shingle; without words there is none."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        h = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w) | 1) for w in words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        total = np.full(n, len(h) if len(h) < WORDS else 0, np.uint64)
        for k in range(min(WORDS, len(h))):
            total += h[k : k + n] * _STEP[k]
        return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes, 32 bits each, of a set that isn't empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_ODD), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(out, (short[at : at + 512] * _ODD + _ADD).min(axis=1), out=out)
    return out


def prefixes(sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each trie the prefix of LEAST min-hashes as one number, salted by the trie, and the min-hashes below it as another."""
    rows = sign.astype(np.uint64).reshape(TREES, DEPTH)
    out = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(LEAST):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out, rows[:, LEAST] << np.uint64(32) | rows[:, LEAST + 1]


def shortened(crowds: dict[int, dict[int, int]], similarity: float = SIMILARITY, recall: float = RECALL) -> dict[int, int]:
    """How deep a query's prefixes are matched, by trie, for the tries in which it has neighbours.

    crowds: by trie and depth how many documents have the query's prefix. All prefixes begin at DEPTH; the one whose
    next shorter node is the least crowded is shortened, again and again, until a neighbour at the least similarity is
    met in some trie with the wanted probability (it agrees on d min-hashes with probability similarity ** d). Tries
    without neighbours below LEAST are matched down to it, which costs nothing.
    """
    miss = {d: math.log1p(-(similarity**d)) for d in range(LEAST, DEPTH + 1)}
    out = dict.fromkeys(crowds, DEPTH)
    total = (TREES - len(crowds)) * miss[LEAST] + len(crowds) * miss[DEPTH]
    wanted = math.log1p(-recall)
    steps = [(n, t, d) for t, by in crowds.items() for d, n in by.items() if d == DEPTH - 1]
    heapq.heapify(steps)
    while total > wanted and steps:
        _, t, d = heapq.heappop(steps)
        total += miss[d] - miss[d + 1]
        out[t] = d
        if d > LEAST:
            heapq.heappush(steps, (crowds[t][d - 1], t, d - 1))
    return out


assert TREES * math.log1p(-(SIMILARITY**LEAST)) <= math.log1p(-RECALL)  # the shortest prefixes meet the recall
assert DEPTH == LEAST + 2  # what prefixes() packs
