"""Texts as numpy arrays of word hashes, for operators that work on token runs."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, remembered for the words met lately."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = set(words).difference(known)
        digest = xxhash.xxh3_64_intdigest
        for w in new:
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: near inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _letters() -> np.ndarray:
    """A number for each byte, the same for a letter of A-Z and its lower case."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
    out[65:91] = out[97:123]
    return out


SPLITS = np.zeros(256, bool)  # the characters at which bytes.split() splits
SPLITS[[9, 10, 11, 12, 13, 32]] = True
LETTERS = _letters()
BASE = 0x9FB21C651E98DF25  # odd, so that it can be divided by
AT_ONCE = 1 << 20  # bytes whose words are hashed together


@functools.lru_cache(maxsize=1)
def _powers(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2^64."""
    def of(base: int) -> np.ndarray:
        out = np.full(most, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


def lower_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z as a-z, and the number of words of each text. A hash is a sum of
    numbers of its bytes times powers of an odd base, as the difference of two running sums, so no word becomes an object."""
    data = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
    gap = SPLITS[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + AT_ONCE, "right")))
        begin = starts[first]
        size = int(ends[last - 1] - begin)
        powers, inverse = _powers(max(AT_ONCE, 1 << (size - 1).bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(LETTERS[data[begin:begin + size]] * powers[:size], out=sums[1:])
        s, e = starts[first:last] - begin, ends[first:last] - begin
        hashes[first:last] = mixed((sums[e] - sums[s]) * inverse[s])
        first = last
    bounds = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, as a polynomial built by doubling."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, out_len = None, 0
    part, part_len, power = words, 1, np.array([ODD])  # an array wraps silently
    left = length
    while left:
        if left & 1:
            if out is None:
                out, out_len = part, part_len
            else:
                # ``out`` covers the first words, ``part`` those after them.
                size = min(len(out), len(part) - out_len)
                out = out[:size] * power + part[out_len:out_len + size]
                out_len += part_len
        left >>= 1
        if left:
            size = len(part) - part_len
            part = part[:size] * power + part[part_len:part_len + size]
            part_len, power = part_len * 2, np.multiply(power, power)
    return mixed(out[:n])


def chunked(rows: Iterable[tuple], size_of, most: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``most`` units by ``size_of``; a larger row is alone."""
    held, total = [], 0
    for row in rows:
        size = size_of(row)
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += size
    if held:
        yield held


def text_slices(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``most`` bytes in the column ``text``; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends, start, before = np.cumsum(np.asarray(sizes), dtype=np.int64), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, ends[stop - 1]


def raw(column: pa.Array) -> list[bytes | None]:
    """A column of texts as UTF-8, without making strings of them."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8. Bytes split at the six ASCII white-space
    characters only, which is what separates words here."""
    return text.split() if text else []
