"""Content-defined phrases of byte strings.

The trigger of a window is the leftmost position of minimal rolling hash among its first `reach`
positions, so equal windows have equal triggers at equal offsets, whatever stands around them, and
no phrase is longer than `reach`, however repetitive the text.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the rolling hash sees.
ROLL = 16


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def rolling(data: bytes) -> np.ndarray:
    """A hash of the ROLL bytes from each position, as integers that aren't negative."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(data, "<u8", (n - k + 7) // 8, k)
    with np.errstate(over="ignore"):
        both = mix(words[:-8]) * np.uint64(0x9E3779B97F4A7C15) + words[8:]
    return (mix(both) >> np.uint64(1)).astype(np.int64)


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of x[i : i + width], for every i."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.int64).max)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    at = np.arange(blocks * width).reshape(blocks, width)
    # leftmost minimum of each block's beginnings and ends
    running = np.minimum.accumulate(grid, 1)
    fresh = np.concatenate([np.ones((blocks, 1), bool), running[:, 1:] < running[:, :-1]], 1)
    head = np.maximum.accumulate(np.where(fresh, at, -1), 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)
    tied = grid[:, ::-1] == back
    # a later (further left) tie or a lower value renews the place
    last = np.maximum.accumulate(np.where(tied, np.arange(width), -1), 1)
    tail = np.take_along_axis(at[:, ::-1], last, 1)[:, ::-1].ravel()
    i = np.arange(n)
    left, right = tail[i], head[i + width - 1]
    same = i // width == (i + width - 1) // width
    return np.where(same | (padded[left] <= padded[right]), left, right)


def triggers(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window) for the runs of windows of `size` bytes with one trigger, of windows
    that lie in one of the stretches data[starts:ends], which are in order and don't overlap."""
    long = ends - starts >= size
    starts, counts = starts[long], (ends - starts)[long] - size + 1
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none
    of = sliding_argmin(rolling(data), reach)
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    of = of[at]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(of) - 1]])
    return of[first], at[first], at[last]
