"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D. Bytes of multi-byte characters are all above 0x7F, so
splitting bytes gives the same words as splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on (a longer single document is one step by itself).
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: One random value a byte, and the odd base of the polynomial, for each of two independent hashes.
BYTE_VALUES = (_odd(11, 256), _odd(12, 256))
BASES = tuple(int(x) for x in _odd(13, 2))
GRAM_BASES = tuple(int(x) for x in _odd(14, 2))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


#: Everything in ASCII but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of the rows into them."""
    inside = ~space[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Cache(dict):
    """Empty again wherever it is sent to: tables are made anew rather than shipped."""

    def __reduce__(self):
        return _Cache, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = _Cache()


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << n.bit_length()
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[base] = (tables[0], tables[1])
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal ranges get equal hashes."""
    up, down = _power_tables(base, len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def rolling_hashes(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """`range_hashes` of each k consecutive values, of len(values) - k + 1 places, in place: a step's arrays are a worker's memory."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(base, len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.multiply(values, up[: len(values)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    h = total[k:] - total[:n]
    h *= down[:n]
    h += np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(h)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hashes(BYTE_VALUES[which][data], starts, ends, BASES[which])


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes, of len(words) - k + 1 places."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    base = np.uint64(GRAM_BASES[which])
    for j in range(1, k):
        h *= base
        h += words[j : j + n]
    return mix(h)


def sliding_argmin(order: np.ndarray, width: int, most: int = (1 << 28) - 1) -> np.ndarray:
    """Place of the first smallest of each `width` consecutive values (their upper 36 bits decide); over `most` places go in halves."""
    n = len(order)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    if n > max(most, width):
        half = (n - width + 1) // 2
        return np.concatenate([sliding_argmin(order[: half + width - 1], width, most), sliding_argmin(order[half:], width, most) + half])
    key = order & ~low
    key |= np.arange(n, dtype=np.uint64)
    pad = -n % width
    if pad:
        key = np.concatenate([key, np.full(pad, ~np.uint64(0))])
    blocks = key.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m], out=behind[:m])
    least &= low
    return least.view(np.int64)


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the (start, end) spans."""
    if not len(spans):
        return np.zeros(n, bool)
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.clip(spans[:, 0], 0, n), 1)
    np.add.at(d, np.clip(spans[:, 1], 0, n), -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of each maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)
