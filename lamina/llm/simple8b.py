"""Simple-8b: whole numbers packed into 64-bit words, in blocks of BLOCK numbers.

The top four bits of a word select how many numbers of how many bits its other 60 hold;
each word takes as many of the next numbers as fit. Selector 1 is a run of 120 zeros.
Selector 0 is an escape: the word holds the place of a number of more than 60 bits in a
list beside the words. A block begins with a word of its own, and the first word of each
block is known, so that any block is decoded without those before it, and many blocks at
once: all words of one selector are shifted and masked together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Numbers and bits of the selectors.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
_PLAIN = (1 << 60) - 1
#: Zeros after each block, which any selector may run into: what a selector says beyond its block's end isn't read.
_STRIDE = BLOCK + int(COUNTS.max())


_LENGTHS = np.zeros(1 << 17, np.uint8)
for _b in range(17):
    _LENGTHS[1 << _b :] = _b + 1


def _bits(values: np.ndarray) -> np.ndarray:
    """The bit length of each number, 61 for those of more than 60 bits."""
    if int(values.max(initial=0)) < len(_LENGTHS):
        return _LENGTHS[values]
    lengths = (np.maximum(values.astype(np.float64).view(np.int64) >> 52, 1022) - 1022).astype(np.uint8)
    large = lengths > 52  # a double may round these up
    if large.any():
        lengths[large] = np.where(values[large] > np.uint64(_PLAIN), 61, np.minimum(lengths[large], 60))
    return lengths


def _choices(bits: np.ndarray) -> np.ndarray:
    """The selector that takes the most numbers from each place on; 0 where even one number is too long.

    Where a selector fits, all of fewer numbers and more bits do, so the one to take follows from how many fit.
    """
    longest = {1: bits}  # the largest of the next n bit lengths, by n
    fitting = (bits <= BITS[-1]).view(np.uint8).copy()
    for n, most in zip(COUNTS[-2:ESCAPE:-1].tolist(), BITS[-2:ESCAPE:-1].tolist(), strict=True):
        first = max(longest)
        rest = min(x for x in longest if first + x >= n)
        own = longest[first].copy()
        np.maximum(longest[first][: len(bits) - (n - rest)], longest[rest][n - rest :], out=own[: len(bits) - (n - rest)])
        longest[n] = own
        fitting += (own <= most).view(np.uint8)
    return np.where(fitting > 0, np.uint8(len(COUNTS)) - fitting, np.uint8(ESCAPE)).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escaped numbers, first word of each block)."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    laid = np.zeros((blocks, _STRIDE), np.uint64)
    laid[: n // BLOCK, :BLOCK] = values[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    if n % BLOCK:
        laid[-1, : n % BLOCK] = values[n // BLOCK * BLOCK :]
    laid = laid.reshape(-1)
    choice = _choices(_bits(laid))
    counts = np.take(COUNTS.astype(np.uint8), choice)
    # a step in all blocks at once: the places where their words begin
    at = np.arange(blocks) * _STRIDE
    ends = at + BLOCK
    ends[-1] = at[-1] + n - (blocks - 1) * BLOCK
    begun = []
    while len(at):
        begun.append(at)
        at = at + counts[at]
        going = at < ends
        at, ends = at[going], ends[going]
    starts = np.sort(np.concatenate(begun))
    chosen = choice[starts]
    words, escapes = np.zeros(len(starts), np.uint64), laid[starts[chosen == ESCAPE]]
    for s in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[of] = np.arange(len(of), dtype=np.uint64)
            continue
        own, first = np.full(len(of), s << 60, np.uint64), starts[of]
        for k in range(COUNTS[s] if BITS[s] else 0):
            own |= laid[first + k] << np.uint64(BITS[s] * k)
        words[of] = own
    return words, escapes, np.searchsorted(starts, np.arange(blocks) * _STRIDE).astype(np.uint32)


def decode(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of consecutive blocks; offsets: the first word of each block, from 0; the last block may be shorter than the others."""
    chosen = (words >> np.uint64(60)).astype(np.int8)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    blocks = len(offsets)
    of_block = np.repeat(np.arange(blocks), np.diff(np.append(offsets, len(words)).astype(np.int64)))
    place = before - before[offsets[of_block]] + of_block * _STRIDE if blocks else before
    out = np.zeros(blocks * _STRIDE, np.uint64)
    for s in np.unique(chosen).tolist():
        at, own = place[chosen == s], words[chosen == s]
        if s == ESCAPE:
            out[at] = escapes[(own & np.uint64(_PLAIN)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s] if BITS[s] else 0):
            out[at + k] = (own >> np.uint64(BITS[s] * k)) & mask
    return out.reshape(blocks, _STRIDE)[:, :BLOCK].reshape(-1)[:n]
