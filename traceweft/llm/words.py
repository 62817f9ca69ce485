"""Words and rolling hashes of whole Arrow batches of texts, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as the
regular expression ``[^\\x20\\x09-\\x0D]+`` on characters. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at a time; bounds the memory that a batch or one very long text takes.
PIECE = 1 << 20
#: Of words that many are hashed at a time; the arrays of a step take about 40 times that.
HASHED = 1 << 18
#: Longer words are hashed in parts of this many bytes.
LONGEST = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: a bijection whose every output bit depends on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_powers(seed: int, n: int) -> np.ndarray:
    """1, b, b**2, ... for an odd b drawn from the seed."""
    base = mix(np.array([seed], U))[0] | U(1)
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(b: int) -> int:
    return pow(int(b), -1, 1 << 64)


_BYTE = [mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(s)) for s in (11, 23)]
_POW = [odd_powers(s, LONGEST) for s in (101, 211)]


@dataclass
class Words:
    """first[d]:first[d+1] are the words of text d; start and end are byte positions in buf."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    h: list[np.ndarray]

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batches, most: int = 4 << 20, column: str = "text"):
    """The same rows in batches whose texts, those of a column, take at most ``most`` bytes; a longer text comes alone."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, a = np.cumsum(lengths, dtype=np.int64), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
            yield b.slice(a, z - a)
            a = z


def words_of(column: pa.Array, lower: bool = False, hashes: int = 1) -> Words:
    """Words of every text, with one or two independent 64-bit hashes of each."""
    buf, off = buffer_of(column)
    if lower:
        upper = (buf >= 65) & (buf <= 90)
        buf = buf + (upper.view(np.uint8) << 5)
    gap = np.ones(len(buf) + 1, bool)
    gap[:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = ~gap
    begins = word.copy()
    begins[1:] &= gap[:-1]
    edge = off[:-1][off[:-1] < len(buf)]
    begins[edge] |= word[edge]
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = word[:-1] & gap[1:]
    stop = off[1:][off[1:] > 0]
    ends[stop] |= word[stop - 1]
    start, end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    first = np.searchsorted(start, off)
    out = [np.zeros(len(start), U) for _ in range(hashes)]
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + HASHED, side="right")))
        _hash_some(buf, start[lo:hi], end[lo:hi], [o[lo:hi] for o in out])
        lo = hi
    return Words(buf, start, end, first, out)


def _hash_some(buf: np.ndarray, start: np.ndarray, end: np.ndarray, out: list[np.ndarray]) -> None:
    length = end - start
    if length.max() > LONGEST:
        for i in np.flatnonzero(length > LONGEST):
            for k, o in enumerate(out):
                h = 0
                for p in range(int(start[i]), int(end[i]), LONGEST):
                    b = buf[p : min(p + LONGEST, int(end[i]))]
                    part = int((_BYTE[k][b] * _POW[k][: len(b)]).sum(dtype=U))
                    h = (h * 0x9E3779B97F4A7C15 + part) % (1 << 64)
                o[i] = mix(np.array([h], U))[0] + U(int(length[i]))
        few = np.flatnonzero(length <= LONGEST)
        if len(few):
            part = [np.zeros(len(few), U) for _ in out]
            _hash_some(buf, start[few], end[few], part)
            for o, p in zip(out, part):
                o[few] = p
        return
    ahead = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(ahead, length)
    b = buf[np.repeat(start, length) + inside]
    for k, o in enumerate(out):
        o[:] = mix(np.add.reduceat(_BYTE[k][b] * _POW[k][inside], ahead)) + length.astype(U)


def windows(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n consecutive values that start at each place: len(h) - n + 1 of them, order counts."""
    if len(h) < n:
        return np.zeros(0, U)
    p = odd_powers(seed, n)
    if n <= 8:
        m = len(h) - n + 1
        acc = h[:m].copy()
        for k in range(1, n):
            acc += h[k : k + m] * p[k]
        return mix(acc)
    base = int(p[1])
    up = odd_powers(seed, len(h))
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up, out=total[1:])
    down = np.full(len(h) - n + 1, U(inverse(base)), U)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return mix((total[n:] - total[:-n]) * down)


def set_hash(values: np.ndarray) -> bytes:
    """128 bits that stand for a set of distinct 64-bit values, whatever their order."""
    a = mix(values + U(0x1234567)).sum(dtype=U)
    b = mix(values ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)
    return int(a).to_bytes(8, "big") + int(b + U(len(values))).to_bytes(8, "big")


def sequence_hash(h: list[np.ndarray]) -> bytes:
    """128 bits that stand for a sequence of words, from both of their hashes."""
    out = b""
    for k, x in enumerate(h):
        p = odd_powers(307 + k, max(1, len(x)))[: len(x)]
        out += int(mix((x * p).sum(dtype=U, keepdims=True) + U(len(x)))[0]).to_bytes(8, "big")
    return out
