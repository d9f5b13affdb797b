"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows common prefixes.

A run is a sorted sequence of different strings. It travels front-coded: of
each string only its length in common with the one before and the bytes after
that. The tree keeps for every loser how much it has in common with the string
that beat it, so two strings are compared from there on only, and where these
lengths differ, not at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Bytes laid side by side when neighbours are compared.
MATRIX_BYTES = 1 << 22
#: Rows of a block: (common prefix, string, value).
Item = tuple[int, bytes, int]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    end = min(len(a), len(b))
    step = 8
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    if known >= end:
        return end
    low, high = known, min(known + step, end)  # they differ somewhere before high, or one ends there
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def neighbour_prefixes(strings: Sequence[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before it; 0 for the first."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros(len(strings), np.int64)
    at = 1
    while at < len(strings):
        stop = min(len(strings), at + 256)
        width = int(sizes[at - 1 : stop].max(initial=1)) or 1
        stop = min(stop, at + max(1, MATRIX_BYTES // width))
        grid = np.array(strings[at - 1 : stop], dtype=f"S{width}").view(np.uint8).reshape(stop - at + 1, width)
        differs = grid[1:] != grid[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[at:stop] = np.minimum(first, np.minimum(sizes[at - 1 : stop - 1], sizes[at:stop]))
        at = stop
    return out


def front_code(strings: Sequence[bytes], values: Sequence[int] | None = None) -> bytes:
    """One compressed block of a sorted run, with a number per string."""
    import zstandard

    shared = neighbour_prefixes(strings)
    tails = [s[n:] for s, n in zip(strings, shared.tolist(), strict=True)]
    numbers = np.asarray(values if values is not None else np.zeros(len(strings)), np.int64)
    sizes = np.fromiter(map(len, tails), np.uint32, len(tails))
    head = struct.pack("<q", len(strings))
    return zstandard.ZstdCompressor(level=1).compress(head + shared.astype(np.uint32).tobytes() + sizes.tobytes() + numbers.tobytes() + b"".join(tails))


def decode(block: bytes) -> Iterator[Item]:
    """The items of a block, in order."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(block)
    (count,) = struct.unpack_from("<q", whole)
    shared = np.frombuffer(whole, np.uint32, count, 8).tolist()
    sizes = np.frombuffer(whole, np.uint32, count, 8 + 4 * count).tolist()
    numbers = np.frombuffer(whole, np.int64, count, 8 + 8 * count).tolist()
    at, last = 8 + 16 * count, b""
    for common, size, number in zip(shared, sizes, numbers, strict=True):
        last = last[:common] + whole[at : at + size]
        at += size
        yield common, last, number


def merge(runs: Sequence[Iterable[Item]]) -> Iterator[tuple[int, bytes, int, int]]:
    """All items of the runs in order, as (common prefix with the item before, string, run, value).

    Equal strings of different runs follow one another.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    streams = [iter(run) for run in runs]
    text: list[bytes | None] = [None] * leaves
    value, known = [0] * leaves, [0] * leaves
    for i, stream in enumerate(streams):
        item = next(stream, None)
        if item is not None:
            text[i], value[i] = item[1], item[2]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix is then that with the winner."""
        x, y = text[a], text[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p > q:  # both follow the last winner; the one that shares more of it comes first
            return a, b
        if q > p:
            return b, a
        n = common_prefix(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * leaves
    ahead = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        ahead[node], losers[node] = play(ahead[2 * node], ahead[2 * node + 1])
    winner = ahead[1] if leaves > 1 else 0
    while text[winner] is not None:
        yield known[winner], text[winner], winner, value[winner]
        item = next(streams[winner], None)
        if item is None:
            text[winner] = None
        else:
            known[winner], text[winner], value[winner] = item
        node = (winner + leaves) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def equal_groups(runs: Sequence[Iterable[Item]]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Every different string with its (run, value) pairs, in order."""
    last: bytes | None = None
    met: list[tuple[int, int]] = []
    for common, string, run, value in merge(runs):
        if last is not None and common == len(last) == len(string):
            met.append((run, value))
            continue
        if last is not None:
            yield last, met
        last, met = string, [(run, value)]
    if last is not None:
        yield last, met


def cut_at(strings: Sequence[bytes], borders: Sequence[bytes]) -> Iterator[tuple[int, int, int]]:
    """Stretches (range, from, to) of a sorted run between the borders; a border starts its range."""
    import bisect

    at = 0
    for number in range(len(borders) + 1):
        stop = bisect.bisect_left(strings, borders[number], at) if number < len(borders) else len(strings)
        if stop > at:
            yield number, at, stop
        at = stop


def borders_of(sample: Iterable[bytes], ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 borders that cut the sample into even parts."""
    ordered = sorted(set(sample))
    return sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)}) if ordered else []
