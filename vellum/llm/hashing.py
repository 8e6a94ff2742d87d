"""Hashes of the words and word shingles of many texts at once, with numpy.

A word's hash is a difference of prefix sums of a polynomial over random byte values, divided by the
power at its start and mixed; so all words of a batch cost a few passes over its bytes. Equal words have equal hashes;
different ones share a 64-bit hash by chance alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Texts are taken together up to this many bytes.
CHUNK = 1 << 21
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which like inputs have unlike images."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = mixed(np.arange(1, 65, dtype=U) * U(BASE)) | U(1)


@cache
def byte_values() -> np.ndarray:
    """A random value for each byte; A-Z have those of a-z."""
    values = mixed(np.arange(1, 257, dtype=U) * U(BASE))
    values[65:91] = values[97:123]
    return values


@cache
def raw_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * U(BASE))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those kept are of CHUNK only."""
    up, down = np.full(n, BASE, U), np.full(n, INVERSE, U)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z in lower case, and the number of words of each text.

    Prefix sums begin anew with each part of about CHUNK bytes, as a hash doesn't depend on its place; a part ends with a
    word, so that only a word longer than that makes a longer one.
    """
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U), np.zeros(len(encoded), np.int64)
    hashes = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(int(np.searchsorted(ends, begin + CHUNK, "right")), at + 1)
        here, there = starts[at:to] - begin, ends[at:to] - begin
        part = data[begin : ends[to - 1]]
        up, down = powers(CHUNK) if len(part) <= CHUNK else powers.__wrapped__(len(part))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(byte_values()[part] * up[: len(part)])])
            hashes[at:to] = mixed((sums[there] - sums[here]) * down[here])
        at = to
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` bytes from each place of data on; by parts, as a hash doesn't depend on its place."""
    n = len(data) - width + 1
    out = np.empty(max(n, 0), U)
    up, down = powers(CHUNK)
    for start in range(0, n, CHUNK // 2):
        part = data[start : start + CHUNK // 2 + width - 1]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(raw_values()[part] * up[: len(part)])])
            out[start : start + CHUNK // 2] = mixed((sums[width:] - sums[:-width]) * down[: len(part) - width + 1])
    return out


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text, as signed integers; the whole sequence if shorter than a shingle."""
    if not len(words):
        return np.empty(0, np.int64)
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, U)
        for k in range(n):
            total = total + words[k : len(words) - n + 1 + k] * STEPS[k]
    return np.unique(mixed(total).view(np.int64))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text; empty for null ones."""
    chunk: list[bytes] = []

    def done() -> Iterator[np.ndarray]:
        hashes, counts = word_hashes(chunk)
        ends = np.cumsum(counts)
        for start, end in zip(ends - counts, ends, strict=True):
            yield shingles_of(hashes[start:end], width)

    size = 0
    for text in texts:
        chunk.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(chunk[-1]) + 1
        if size >= CHUNK // 2:
            yield from done()
            chunk, size = [], 0
    if chunk:
        yield from done()
