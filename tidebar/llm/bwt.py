"""Burrows-Wheeler transforms of small shards and their merge by iterative interleave refinement.

A shard holds strings over integer letters (1 and up); letter 0 ends a string. A shard's transform lists, in suffix
order, the letter before each suffix. Merging starts from the shards laid end to end and refines the interleave: one
pass moves every entry by a stable counting sort of its letter, after which the interleave is in order of one more
letter. Where neighbours part in pass d, their common prefix has d - 1 letters. No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Transform of the strings letters[bounds[i]:bounds[i + 1]]; `at` is the letter position of each suffix (-1: an end mark)."""

    def __init__(self, letters: np.ndarray, bounds: np.ndarray, depth: int):
        n_str = len(bounds) - 1
        n = len(letters)
        lens = np.diff(bounds)
        owner = np.repeat(np.arange(n_str), lens)
        text = np.zeros(n + n_str, np.int64)
        pos = np.arange(n) + owner
        text[pos] = letters
        ends = bounds[1:] + np.arange(n_str)
        place = np.full(n + n_str, -1, np.int64)
        place[pos] = np.arange(n)
        rank = text + n_str
        rank[ends] = np.arange(n_str)
        step, size = 1, len(text)
        while step < depth:
            nxt = np.zeros(size, np.int64)
            nxt[: max(size - step, 0)] = rank[step:] + 1
            nxt[ends] = 0
            found, rank = np.unique(rank * (int(nxt.max(initial=0)) + 1) + nxt, return_inverse=True)
            step *= 2
            if len(found) == size:
                break
        order = np.argsort(rank)  # suffixes that agree in `depth` letters may stand in any order
        self.at = place[order]
        before = np.zeros(size, np.int64)
        before[1:] = text[:-1]
        before[bounds[:-1] + np.arange(n_str)] = 0
        self.bwt = before[order]
        self.n_str = n_str


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the shards' transforms until suffixes are in order of their first `depth` letters.

    Returns the interleave (the shard of each suffix in order; a shard's own suffixes keep their order) and the common
    prefix of each suffix with the one before, `depth` where it is as long or longer."""
    small = max((int(s.bwt.max()) for s in shards if len(s.bwt)), default=0) < 65536
    bwt = np.concatenate([s.bwt for s in shards]).astype(np.uint16 if small else np.int64)
    n, n_str = len(bwt), sum(s.n_str for s in shards)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16 if len(shards) < 65536 else np.int64), [len(s.bwt) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=z.dtype), [s.n_str for s in shards])
    part = np.zeros(n, bool)  # True: a new interval begins here
    part[:1] = True
    prefix = np.full(n, depth, np.int16)
    letters = np.empty_like(bwt)
    for done in range(depth):
        letters[np.argsort(z, kind="stable")] = bwt
        to = np.argsort(letters, kind="stable")
        sorted_letters, block = letters[to], np.cumsum(part)[to]
        z = z[to]
        part = np.empty(n, bool)
        part[:1] = True
        part[1:] = (sorted_letters[1:] != sorted_letters[:-1]) | (block[1:] != block[:-1])
        z[:n_str] = ends  # end marks keep their fixed order and are intervals of their own
        part[: n_str + 1] = True
        prefix[part & (prefix == depth)] = done
        if part.all():
            break
    return z, prefix


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """A number from 1 for the `width` bytes at each position (a multiple of 8; zeros beyond the end), by doubling."""
    def both(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros(len(data), np.int64)
        later[: max(len(data) - shift, 0)] = b[shift:]
        return np.unique(a * (int(b.max(initial=0)) + 1) + later, return_inverse=True)[1] + 1

    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(data)].astype(np.uint64)
    power, size = np.unique(word, return_inverse=True)[1] + 1, 8
    out, have = None, 0
    while have < width:
        if width & size:
            out, have = (power, size) if out is None else (both(power, out, size), have + size)
        if have < width:
            power, size = both(power, power, size), 2 * size
    return out


def repeated_windows(strings: list[bytes], owned: np.ndarray, window: int, shard_letters: int = 8192, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string, which of its first owned[i] windows of `window` bytes also start at another place in the strings.

    weight: how often each string counts. A string is read as one string of letters for each alignment, a letter being
    a fifth of a window (or 8 bytes, where that is no multiple of 8), so that few passes suffice."""
    step = window // 5 if window % 40 == 0 else 8
    depth = window // step
    assert depth * step == window and step % 8 == 0
    data = np.frombuffer(b"".join(strings), np.uint8)
    lens = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate(([0], np.cumsum(lens)))
    code = _codes(data, step)
    aligned = np.clip(lens - window + 1, 0, step)
    of = np.repeat(np.arange(len(strings)), aligned)  # a string for each alignment
    first = np.arange(len(of)) - np.repeat(np.cumsum(aligned) - aligned, aligned)
    count = (lens[of] - step - first) // step + 1
    end = np.cumsum(count)
    at = np.repeat(base[of] + first, count) + step * (np.arange(end[-1] if len(end) else 0) - np.repeat(end - count, count))
    shard = (end - count) // shard_letters
    shards, places = [], []
    for lo, hi in zip(*(np.flatnonzero(np.concatenate(x)) for x in (([len(shard) > 0], shard[1:] != shard[:-1]), (shard[1:] != shard[:-1], [len(shard) > 0])))):
        a, b = end[lo] - count[lo], end[hi]
        shards.append(Shard(code[at[a:b]], np.concatenate(([0], end[lo : hi + 1] - a)), depth))
        places.append(np.append(at[a:b], -1)[shards[-1].at])
    hit = np.zeros(len(data), bool)
    if shards:
        z, prefix = merge(shards, depth)
        place = np.empty(len(z), np.int64)
        place[np.argsort(z, kind="stable")] = np.concatenate(places)
        same = prefix >= depth  # as the suffix before
        twice = same.copy()
        twice[:-1] |= same[1:]
        if weight is not None:
            twice |= np.repeat(weight, lens)[place] > 1
        hit[place[twice & (place >= 0)]] = True
    return [hit[base[i] : base[i] + owned[i]] for i in range(len(strings))]
