"""Words of UTF-8 texts as 64-bit hashes, by whole Arrow batches.

A text is read in pieces of bounded size, cut between words; a word's hash is a polynomial in its bytes, taken
from running sums over the piece, so the cost is a few passes over the bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at once; a longer piece is one word.
PIECE = 1 << 20
#: Fixed odd base of the polynomial and its inverse mod 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORDS = np.where(SPACE, 0, 1).astype(np.uint8)  # classes of bytes: none, word
TOKENS = WORDS.copy()  # none, letters and digits and what is not ASCII, other signs
TOKENS[[b for b in range(128) if WORDS[b] and not chr(b).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
SHAPES = np.arange(256, dtype=np.uint8)  # upper-case letters, other letters and digits as one each; other signs as they are
SHAPES[65:91] = 65
SHAPES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 97

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _piece(b: np.ndarray, breaks: np.ndarray, classes: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in b; no word goes past a break."""
    kind = classes[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(((b if fold is SAME else fold[b]).astype(U) + U(1)) * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), starts, ends


def _cut(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of one long text that end before a space, or at the end of a word longer than a piece."""
    at = 0
    while at < len(b):
        to = at + PIECE
        if to < len(b):
            spaces = np.flatnonzero(SPACE[b[at:to]])
            if len(spaces):
                to = at + int(spaces[-1])
            else:
                while to < len(b) and not (found := np.flatnonzero(SPACE[b[to : to + PIECE]])).size:
                    to += PIECE
                to = min(to + (int(found[0]) if to < len(b) else 0), len(b))
        to = min(max(to, at + 1), len(b))
        yield at, to
        at = to


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row boundaries in them; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def spans(column: pa.Array, classes: np.ndarray = WORDS, fold: np.ndarray = LOWER) -> Iterator[tuple]:
    """For runs of rows, or pieces of one long row: the first row's number, the bytes, the words' hashes, starts and
    ends in the bytes, and the bounds of each row's words among them."""
    data, bounds = texts(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        to = max(int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1, row + 1)
        b = data[bounds[row] : bounds[to]]
        if len(b) <= PIECE:
            inner = bounds[row : to + 1] - bounds[row]
            h, starts, ends = _piece(b, inner, classes, fold) if len(b) else (np.zeros(0, U), *[np.zeros(0, np.int64)] * 2)
            yield row, b, h, starts, ends, np.searchsorted(starts, inner)
        else:
            for i, j in _cut(b):
                h, starts, ends = _piece(b[i:j], np.zeros(1, np.int64), classes, fold)
                yield row, b[i:j], h, starts, ends, np.array([0, len(h)])
        row = to


def words(column: pa.Array, classes: np.ndarray = WORDS, fold: np.ndarray = LOWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole rows: the first row's number, the words' hashes, and the bounds of each row's words among them."""
    held: list[tuple[int, np.ndarray]] = []
    for row, _, h, _, _, bounds in spans(column, classes, fold):
        if held and held[-1][0] != row:
            yield held[0][0], (all_ := np.concatenate([x for _, x in held])), np.array([0, len(all_)])
            held = []
        if len(bounds) == 2:  # perhaps a piece of a row
            held.append((row, h))
        else:
            yield row, h, bounds
    if held:
        yield held[0][0], (all_ := np.concatenate([x for _, x in held])), np.array([0, len(all_)])


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words that start at each word."""
    out = np.zeros(max(len(h) - width + 1, 0), U)
    for i in range(width):
        out = out * U(0xA0761D6478BD642F | 1) + h[i : len(h) - width + 1 + i]
    return mix(out)


def shingle_set(h: np.ndarray, width: int, runs: np.ndarray | None = None) -> np.ndarray:
    """The sorted distinct shingles of one text's words; with fewer words than `width`, their whole sequence as one."""
    if not len(h):
        return np.zeros(0, U)
    if len(h) < width:
        return mix(shingles(h, len(h)) + U(len(h)))
    s = np.sort(shingles(h, width) if runs is None else runs)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and shingle set of each row."""
    for row, h, bounds in words(column):
        runs = shingles(h, width) if len(h) >= width else None
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            yield row + i, shingle_set(h[a:b], width, runs[a : b - width + 1] if runs is not None and b - a >= width else None)
