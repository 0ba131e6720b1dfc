"""Vectorised word splitting and rolling hashes over a batch of texts (numpy only, no Spark).

The texts of a batch are laid end to end with one line feed between them, so one pass of numpy
covers many documents.  Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``.
Words are hashed by XXH64; windows of words and strings of bytes have polynomial hashes modulo 2**64
with odd bases, finished with an avalanche mix.  Long texts are hashed a stretch at a time.
"""

from __future__ import annotations

import numpy as np
import xxhash

CHUNK = 1 << 20  # bytes that are hashed at a time
_MEMO = 1 << 15  # words whose hashes a process remembers: the frequent ones; each takes over 150 bytes as long as the process lives
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: All ASCII but letters and digits; bytes of longer characters belong to words.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

# Odd bases of the rolling hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls in a process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Sums of value[j] * base**j over j < i, for i = 0 .. n."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, powers(BASES[which], len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Position-free hash of values[start:end] from prefix(); not yet mixed."""
    return (sums[ends] - sums[starts]) * powers(_INVERSES[which], len(sums))[starts]


def rolling(values: np.ndarray, width: int, which: int) -> np.ndarray:
    """Mixed hash of values[i:i + width] for every i, with few temporary arrays."""
    sums = prefix(values, which)
    h = sums[width:] - sums[:-width]
    del sums
    h *= powers(_INVERSES[which], len(h))
    return mix(h)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """spans_hash() of values (bytes) between rising starts and their ends, a stretch of bytes at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    long = ends - starts > CHUNK
    for i in np.flatnonzero(long).tolist():
        out[i] = _long_hash(values, int(starts[i]), int(ends[i]), which)
    short = np.flatnonzero(~long)
    a = 0
    while a < len(short):
        b = int(np.searchsorted(starts[short], starts[short[a]] + CHUNK, side="right"))
        some = short[a:b]
        low, high = int(starts[some[0]]), int(ends[some].max())
        out[some] = spans_hash(prefix(values[low:high] + np.uint8(1), which), starts[some] - low, ends[some] - low, which)  # UTF-8 has no byte 255
        a = b
    return out


def _long_hash(values: np.ndarray, start: int, end: int, which: int) -> int:
    base, total = BASES[which], 0
    for at in range(start, end, CHUNK):
        part = values[at : min(end, at + CHUNK)].astype(np.uint64) + np.uint64(1)
        total += int((part * powers(base, len(part))).sum(dtype=np.uint64)) * pow(base, at - start, 1 << 64)
    return total % (1 << 64)


class _Memo(dict):
    """Word -> XXH64, remembered."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) < 64:
            self[word] = h
        return h


_memos: dict[int, _Memo] = {}


class Words:
    """The words of a batch: byte spans, and for each text the range of its words."""

    def __init__(self, texts: list[bytes], space: np.ndarray = _SPACE):
        self.table = bytes(32 if space[i] else i for i in range(256))
        self.joined = b"\n".join(texts)
        self.bytes = np.frombuffer(self.joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)].astype(np.int64)
        self.text_ends = self.text_starts + lengths
        solid = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        solid[1:-1] = ~space[self.bytes]
        edges = np.flatnonzero(np.diff(solid))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)  # first word of each text
        self.last = np.append(self.first[1:], len(self.starts)) if len(texts) else self.first

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first

    def hashes(self, which: int = 0, joined: bytes | None = None) -> np.ndarray:
        """64-bit hash of each word; joined replaces the bytes (for example lower-cased)."""
        joined = self.joined if joined is None else joined
        known = _memos.setdefault(which, _Memo(which))
        out = np.empty(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + CHUNK, side="right")))
            words = joined[self.starts[a] : self.ends[b - 1]].translate(self.table).split()
            out[a:b] = np.fromiter(map(known.__getitem__, words), np.uint64, b - a)
            a = b
        return out

    def quick_hashes(self, which: int = 0) -> np.ndarray:
        """Polynomial hash of each word, faster than hashes(); different words can be made to collide."""
        return mix(hash_spans(self.bytes, self.starts, self.ends, which) + (self.ends - self.starts).astype(np.uint64))

    def normal(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each word starts; at the end, where the next would."""
        keep = np.append(np.frombuffer(self.table, np.uint8)[self.bytes] != 32, False)
        keep[self.ends] = True
        padded = np.append(self.bytes, np.uint8(32))
        padded[self.ends] = 32
        return padded[keep].tobytes(), np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])

    def window_starts(self, k: int) -> np.ndarray:
        """Index of the first word of every window of k words that lies in one text."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.int64)
        ok = np.zeros(len(self.starts) + 1, dtype=np.int32)
        n = np.maximum(self.counts - k + 1, 0)
        has = n > 0
        np.add.at(ok, self.first[has], 1)
        np.add.at(ok, (self.first + n)[has], -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def window_hashes(word_hash: np.ndarray, starts: np.ndarray, k: int, which: int) -> np.ndarray:
    """64-bit hash of the k word hashes from each start."""
    sums = prefix(word_hash, which)
    return mix(spans_hash(sums, starts, starts + k, which))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: bytes) -> bytes:
    return text.translate(_LOWER)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Flags of n positions that some [start, start + width) covers."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0
