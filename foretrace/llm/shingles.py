"""Distinct word shingles of a text as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from foretrace.session import ship_by_value

ship_by_value(__name__)

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Bytes that are hashed at a time; parts end at white space.
PART_BYTES = 1 << 18
# Multipliers of byte places in a word; further places repeat them with another factor.
PLACES = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor, shift and multiply)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


MULTIPLIERS = mixed(np.arange(1, PLACES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
# A word's hash is a polynomial in an odd base over values of its bytes, modulo 2**64, scrambled.
BASE, INVERSE_BASE = 0x9FB21C651E98DF27, pow(0x9FB21C651E98DF27, -1, 1 << 64)
BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    factors = np.full(count, base, U64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=U64)


POWERS, INVERSE_POWERS = powers(BASE, 2 * PART_BYTES), powers(INVERSE_BASE, 2 * PART_BYTES)


def word_parts(data: bytes) -> Iterator[bytes]:
    """Parts of bounded size that end where a word ends."""
    start = 0
    while len(data) - start > PART_BYTES:
        cut = min((c for c in (data.find(s, start + PART_BYTES) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c >= 0), default=-1)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


def hashed_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order.

    Running sums of byte values times powers of the base give every word's
    polynomial as a difference, moved to the word's start by an inverse power.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, U64)
    space = IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate(([0] * (not space[0]), edges, [len(raw)] * (not space[-1]))).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    up, down = (POWERS, INVERSE_POWERS) if len(raw) <= len(POWERS) else (powers(BASE, len(raw)), powers(INVERSE_BASE, len(raw)))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUES[raw] * up[:len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words (fewer words: of the whole sequence), A-Z lower-cased."""
    parts = [hashed_words(p) for p in word_parts(text.encode().lower())]
    words = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    found = words[:count] * MULTIPLIERS[0]
    for k in range(1, width):
        found += words[k:count + k] * MULTIPLIERS[k]
    found = np.sort(mixed(found + U64(width)))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that name a set: equal sets, equal keys."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
