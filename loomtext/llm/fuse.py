"""Static binary-fuse filters (three-wise) over 64-bit keys, built and probed with numpy.

A key sets three slots in consecutive segments; the exclusive or of their contents is the key's
fingerprint.  Built keys are always found; any other key is found with probability 2^-16."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U = np.uint64


@dataclass
class Filter:
    seed: int
    segment: int
    segments: int
    slots: np.ndarray  # uint16


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):  # 64-bit finaliser of murmur, wrapping on purpose
        h = keys + U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> U(33))) * U(factor)
        return h ^ (h >> U(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    first = ((h >> U(32)) * U(segments * segment)) >> U(32)
    low = U(segment - 1)
    second = (first + U(segment)) ^ ((h >> U(18)) & low)
    third = (first + U(2 * segment)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(16))).astype(np.uint16)


def build(keys: np.ndarray, tries: int = 100) -> Filter:
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-round(n * factor) // segment) - 2)
    for seed in range(1, tries + 1):
        if seed % 10 == 0:  # tiny sets may need more room
            segments += 1
        h = _mix(keys, seed)
        rounds = _peel(_places(h, segment, segments), n, (segments + 2) * segment)
        if rounds is not None:
            slots = np.zeros((segments + 2) * segment, np.uint16)
            prints, places = _print(h), _places(h, segment, segments)
            for key, slot in reversed(rounds):  # the key's own slot is still zero
                x = places[:, key]
                slots[slot] = prints[key] ^ slots[x[0]] ^ slots[x[1]] ^ slots[x[2]]
            return Filter(seed, segment, segments, slots)
    raise RuntimeError(f"no binary-fuse layout for {n} keys in {tries} tries")


def _peel(places: np.ndarray, n: int, size: int):
    """Rounds of (keys, their own slots) that take away every key; None if a core remains."""
    count = np.bincount(places.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    numbers = np.broadcast_to(np.arange(n), places.shape)
    np.bitwise_xor.at(held, places.ravel(), numbers.ravel())
    rounds, left = [], n
    slot = np.flatnonzero(count == 1)
    while len(slot):
        key, first = np.unique(held[slot], return_index=True)
        slot = slot[first]
        rounds.append((key, slot))
        left -= len(key)
        touched = places[:, key].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.broadcast_to(key, (3, len(key))).ravel())
        slot = np.unique(touched)
        slot = slot[count[slot] == 1]
    return rounds if left == 0 else None


def contains(f: Filter, keys: np.ndarray) -> np.ndarray:
    h = _mix(keys.astype(np.uint64), f.seed)
    x = _places(h, f.segment, f.segments)
    return _print(h) == f.slots[x[0]] ^ f.slots[x[1]] ^ f.slots[x[2]]
