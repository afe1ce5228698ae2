"""Hashed word shingles of whole texts, in numpy over slices of many texts."""

from __future__ import annotations

import hashlib

import numpy as np

from .base import mix

#: Bytes that part words, and A-Z to a-z.
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTES = 6


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base))])
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts in order, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = _upto(len(buf) + 1)
    blank = _BLANK[buf]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero((edge == 1))
    ends = ends[ends > 0] if len(ends) and ends[0] == 0 else ends
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * up[: len(buf)])])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([0] + [len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(starts, firsts))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (48 bits, as int64) of each text; a text of fewer words is one shingle."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
    rolled = (mix(rolled) >> np.uint64(16)).astype(np.int64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            digest = hashlib.blake2b(words[at : at + n].tobytes(), digest_size=8).digest()
            out.append(np.array([int.from_bytes(digest, "little") >> 16], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<i8").ravel()
