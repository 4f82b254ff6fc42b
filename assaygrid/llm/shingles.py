"""Hashed words and shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
BLOCK = 1 << 20  # bytes hashed at once


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mixed((np.arange(256, dtype=np.uint64) + U(1)) * STEP)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTE[SPACE] = 0


def powers(n: int) -> np.ndarray:
    """Odd multipliers for the places in a word."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * STEP) | U(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lowered, and the number of words of each text."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # a text ends in a space, so starts and ends alternate
    hashes = np.empty(len(start), np.uint64)
    power = powers(int(min((end - start).max(), BLOCK))) if len(start) else None
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        low = int(start[at])
        if to == at + 1 and end[at] - low > BLOCK:  # a word beyond the block: by pieces, the number of the piece mixed in
            pieces = [flat[x : min(x + BLOCK, int(end[at]))] for x in range(low, int(end[at]), BLOCK)]
            total = np.array([(BYTE[p] * power[: len(p)]).sum(dtype=np.uint64) for p in pieces])
            hashes[at] = mixed(total + powers(len(pieces))).sum(dtype=np.uint64)
        else:
            part = flat[low : int(end[to - 1])]
            begins = start[at:to] - low
            place = np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part))))
            hashes[at:to] = np.add.reduceat(BYTE[part] * power[np.minimum(place, len(power) - 1)], begins, dtype=np.uint64)
        at = to
    hashes = mixed(hashes + (end - start).astype(np.uint64) * STEP)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, sorted; fewer words make one shingle, none an empty set."""
    hashes, n_words = word_hashes(texts)
    n = len(hashes)
    run = np.zeros(n, np.uint64)
    for j in range(width):
        m = max(n - j, 0)
        run[:m] = mixed((run[:m] ^ hashes[n - m :]) + STEP)
    out = []
    for at, k in zip(np.cumsum(n_words) - n_words, n_words):
        if k >= width:
            out.append(np.unique(run[at : at + k - width + 1]))
            continue
        short = np.zeros(min(k, 1), np.uint64)
        for j in range(k):
            short = mixed((short ^ hashes[at + j]) + STEP)
        out.append(short)
    return out
