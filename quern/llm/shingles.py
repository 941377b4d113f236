"""Sets of hashed word shingles of whole texts, and their parity sketches.

Words are runs of bytes other than space and 0x09 to 0x0D; A-Z count as a-z. A
set has the distinct runs of ``WORDS`` words; a shorter text has its whole
sequence as one; a text without words has the empty set. A shingle stands as a
64-bit hash.

Every shingle falls, by its hash's upper bits, into one of m buckets. A bucket's
sketch is the XOR of its shingles' (re-mixed) hashes: 64 parity bits, which
differ between two sets wherever the sets do. As a differing shingle spoils one
bucket at most, two sets with D differing shingles have equal sketches in all
but D buckets (pigeonhole). Bit sketches of the whole set count each shingle's
parity at one bit; their Hamming distance is a lower bound of D.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Two sets are similar if NEED[1] * intersection >= NEED[0] * union.
NEED = (3, 4)
#: A set may leave out one join key for so many shingles.
SPARE = 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP, _BACK = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, step in enumerate((_STEP, _BACK)):
            steps = np.full(size, U(step))
            steps[0] = U(1)
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: one-to-one, every input bit moves every output bit."""
    x = x + U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word, from differences of one running sum."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a whole text: sorted distinct hashes."""
    if not text:
        return np.zeros(0, U)
    w = word_hashes(text.encode("utf-8", "replace").lower())
    if not len(w):
        return np.zeros(0, U)
    n = min(words, len(w))
    runs = np.full(len(w) - n + 1, U(n))
    for k in range(n):
        runs = mix(runs, 1) + w[k : len(w) - n + 1 + k]
    runs = mix(runs, 2)
    runs.sort()
    return runs[np.r_[True, runs[1:] != runs[:-1]]]


def most_different(n: int) -> int:
    """The most shingles in which a set of n can differ from a similar one: that has 4n/3 shingles at most."""
    p, q = NEED
    return ((q - p) * (n + n * q // p)) // (q + p)


def may_differ(a: int, b: int) -> int:
    p, q = NEED
    return (q - p) * (a + b) // (q + p)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    common = len(x) + len(y) - len(np.union1d(x, y))
    return NEED[1] * common >= NEED[0] * (len(x) + len(y) - common)


def band(n: int) -> int:
    """Sets of up to 64 shingles, then up to 256, 1024, ..."""
    j = 3
    while 4**j < n:
        j += 1
    return j


def buckets(j: int) -> int:
    return 256 if j == 3 else int(4**j / 1.6)


def bits(n: int) -> int:
    """Bits of the sketch of a set of n: a power of two, six to twelve for each shingle, so that few differences hide each other."""
    return max(256, 1 << (6 * n - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of the whole set."""
    at = (mix(s, 3) & U(bits(len(s)) - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits(len(s))) & 1).tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    """A longer sketch brought to ``size`` bytes: shingles fall to the same bits modulo the shorter size."""
    x = np.frombuffer(a, np.uint8)
    # bit k of a sketch is bit k modulo the shorter length of the shorter one, so equal stretches are XORed
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def distance(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def spare(n: int) -> int:
    """Join keys that a set of n may leave out, by its own choice, without losing a similar set."""
    return n // SPARE


def parts(s: np.ndarray) -> np.ndarray:
    """Join keys of a non-empty set: two similar sets share one, also after each left out ``spare`` of its even keys.

    In the set's band, and in the next one if a similar set may lie there, the
    sketches of its first buckets that hold a shingle: as many as the set can
    differ in, and one, and those that the two sets may leave out. For two
    similar sets take the one whose buckets end first: enough of its buckets
    have an equal twin, which the other emits too. A set with too few such
    buckets emits them all, and, for others like it, the prefix of its shingles
    in another order by the prefix-filter bound; these keys are odd.
    """
    n = len(s)
    most = n * NEED[1] // NEED[0]
    need, out, short = most_different(n) + 1 + spare(n) + spare(most), [], False
    j = band(n)
    for k in (j, j + 1) if most > 4**j else (j,):
        bucket = ((s >> U(32)) * U(buckets(k))) >> U(32)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        value = np.bitwise_xor.reduceat(mix(s, 4), first)[:need]
        short |= len(first) < need
        out.append(mix(value ^ mix(bucket[first[:need]] + U(k << 40), 5), 6) & ~U(1))
    if short:
        overlap = -(-NEED[0] * n // NEED[1])
        out.append(mix(np.sort(mix(s, 7))[: n - overlap + 1], 8) | U(1))
    return np.concatenate(out)
