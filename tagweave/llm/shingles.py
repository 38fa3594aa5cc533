"""Word shingles of texts as 64-bit hashes, and MinHash signatures of their sets."""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

from tagweave.llm.common import Recent, on_leave

WORD = re.compile(r"[^\W_]+")
SIZE = 5

_KNOWN = Recent(200_000)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the ones seen lately are kept."""
    new = _KNOWN.missing(set(words))
    _KNOWN.young.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(_KNOWN.young.__getitem__, words), np.uint64, len(words))


def _forget() -> None:
    global _KNOWN
    _KNOWN = Recent(200_000)


on_leave("shingles", _forget)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and shift)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@functools.cache
def _constants(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of ASCII text with blanks for those that stand in no word.
_BLANKED = bytes(ord(c) if WORD.fullmatch(c) else 32 for c in map(chr, range(128))) + bytes(128)


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():  # cut without the pattern
        return text.encode().translate(_BLANKED).decode().split()
    return WORD.findall(text)


def shingle_hashes(words: list[str], size: int = SIZE) -> np.ndarray:
    """A hash for each place where `size` words follow one another; fewer words make one shingle."""
    hashes = word_hashes(words)
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    factors = _constants(64, 11)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total += hashes[k:len(hashes) - size + 1 + k] * factors[k]
    return mix(total + np.uint64(size))


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), size))


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """One row of `hashes` 16-bit MinHash values per set; sets must not be empty."""
    out = np.empty((len(sets), hashes), np.uint16)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    factors = _constants(2 * hashes, 5).astype(np.uint32)
    for k in range(hashes):
        least = np.minimum.reduceat(low * factors[2 * k] + high * factors[2 * k + 1], starts)
        out[:, k] = mix(least.astype(np.uint64) + np.uint64(k << 32)) & np.uint64(0xFFFF)
    return out


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes that stand for a whole set."""
    raw = xxhash.xxh3_128_digest(values.tobytes())
    return tuple(np.frombuffer(raw, np.int64).tolist())

