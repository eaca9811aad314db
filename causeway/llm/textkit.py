"""Words, lines and their 64-bit hashes for whole Arrow columns of text, in numpy.

All functions work on a chunk: the UTF-8 bytes of some consecutive rows and the offsets between them. A hash is
polynomial over a fixed random table of the bytes, mixed at the end, so equal byte strings have equal hashes on
every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, target: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of chunks of about target bytes, whole rows each. A null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + target, "right")) - 1)
        yield first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums with which the hash of any byte range follows in one step."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(TABLE[data] * up[: len(data)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; the empty range has one too."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def pieces(data: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of maximal runs of bytes that are not marked in gap, never across rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def windows(word_hash: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of width words inside one row."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = (total + word_hash[k : k + n]) * _U(0xA24BAED4963EE407)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[at]), at


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles (A-Z lower-cased): runs of width words, or the whole
    sequence as one where there are fewer; none without words."""
    data = LOWER[data]
    starts, ends, row = pieces(data, offs, SPACE[data])
    word = hashes(sums(data), starts, ends)
    gram, at = windows(word, row, width)
    rows = len(offs) - 1
    bounds = np.searchsorted(row[at], np.arange(rows + 1))
    first = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for r in range(rows):
        if bounds[r] < bounds[r + 1]:
            out.append(np.unique(gram[bounds[r] : bounds[r + 1]]))
        elif first[r] < first[r + 1]:
            own = word[first[r] : first[r + 1]]
            out.append(windows(own, np.zeros(len(own), np.int64), len(own))[0] ^ _U(len(own)))
        else:
            out.append(np.zeros(0, _U))
    return out
