"""Words, shingles and their 64-bit names for whole Arrow batches of text, in numpy.

A word is read as 8-byte lanes; its name is the mixed sum of its lanes, each mixed with a key of its place, so no
arithmetic structure of the bytes carries over to the names. `exact_ids` names words by comparing their bytes. A-Z count
as a-z when asked. Texts are cut into blocks of bounded size, so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix((np.arange(n, dtype=U) + U(start)) * U(0x9E3779B97F4A7C15))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()
BYTE_VALUES = seeds(256)
BASE = 0x2545F4914F6CDD1D


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those of usual lengths are kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, BLOCK_BYTES // 2), base, U)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 4 * BLOCK_BYTES:
            return out[:n]
        _POWERS[base] = out
    return _POWERS[base][:n]


@cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class PrefixHash:
    """Rolling names (polynomials modulo 2**64) of any substrings of one block, to sample and to gather by; never proof of equality."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES, base: int = BASE):
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * powers(base, len(data)), out=self.sums[1:])
        self.back = powers(_inverse(base), len(data) + 1)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of rows and the end) for runs of rows of about `size` bytes; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each row's words begin in them (rows + 1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def span_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each span as 8-byte lanes (filled up with 0), each lane's number in its span, and where spans begin (n + 1)."""
    count = np.maximum((ends - starts + 7) >> 3, 1)
    first = np.append(0, np.cumsum(count))
    number = np.arange(first[-1]) - np.repeat(first[:-1], count)
    at = np.repeat(starts, count) + 8 * number
    words = np.zeros(len(data) // 8 + 2, U)
    words.view(np.uint8)[: len(data)] = data
    place, shift = at >> 3, ((at & 7) << 3).astype(U)
    lanes = (words[place] >> shift) | ((words[place + 1] << U(1)) << (U(63) - shift))
    return lanes & LANE_MASKS[np.clip(np.repeat(ends, count) - at, 0, 8)], number, first


def _lane_names(lanes: np.ndarray, number: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(length):
        return np.zeros(0, U)
    keyed = mix(lanes ^ seeds(int(number.max()) + 1, 40)[number])
    return mix(np.add.reduceat(keyed, first[:-1]) + length.astype(U) * U(0x9FB21C651E98DF25))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The name of each word (or other span), a bounded run of them at a time."""
    out = np.empty(len(starts), U)
    if lower:
        data = LOWER[data]
    i = 0
    while i < len(starts):
        j = min(len(starts), i + (BLOCK_BYTES >> 3))
        while j > i + 1 and int((ends[i:j] - starts[i:j]).sum()) > 4 * BLOCK_BYTES:
            j = (i + j) // 2
        a, b = int(starts[i:j].min()), int(ends[i:j].max())
        out[i:j] = _lane_names(*span_lanes(data[a:b], starts[i:j] - a, ends[i:j] - a), ends[i:j] - starts[i:j])
        i = j
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each kind, the kind of each span): spans are of one kind only if their bytes are equal."""
    lanes, number, first = span_lanes(data, starts, ends)
    length = ends - starts
    _, at, which = np.unique(_lane_names(lanes, number, first, length), return_index=True, return_inverse=True)
    other = at[which]
    same = bool((length == length[other]).all())
    if same and len(lanes):
        same = bool((lanes == lanes[np.arange(len(lanes)) + np.repeat(first[other] - first[:-1], np.diff(first))]).all())
    if not same:  # two kinds share a name: go by the bytes themselves
        raw, known = data.tobytes(), {}
        which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
        _, at = np.unique(which, return_index=True)
    return at, which


def exact_grams(ids: np.ndarray, pointer: np.ndarray, k: int) -> list[np.ndarray]:
    """row_shingles() by exact numbers for rows of exact word numbers: equal numbers are equal word sequences."""
    n, after = len(ids), int(ids.max(initial=-1)) + 1
    words = np.diff(pointer)
    kept = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), kept)
    at = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept) + np.repeat(pointer[:-1], kept)
    code = ids[at] if len(at) else at
    for j in range(1, k):
        following = np.where(at + j < pointer[row + 1], ids[np.minimum(at + j, n - 1)], after) if len(at) else at
        _, code = np.unique(code * (after + 1) + following, return_inverse=True)
    edges = np.append(0, np.cumsum(kept))
    return [np.unique(code[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def gram_names(names: np.ndarray, k: int) -> np.ndarray:
    """The name of names[i:i+k] for each i; the last k-1 are cut off."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors, out = seeds(k, 1000) | U(1), np.zeros(n, U)
    for j in range(k):
        out += names[j : j + n] * factors[j]
    return mix(out)


def row_shingles(names: np.ndarray, pointer: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct k-word shingles; fewer than k words make one shingle, none make none."""
    grams = gram_names(names, k)
    for a, b in zip(pointer[:-1].tolist(), pointer[1:].tolist()):
        if b - a >= k:
            row = np.sort(grams[a : b - k + 1])
            yield row[np.append(True, row[1:] != row[:-1])]
        elif b > a:
            yield gram_names(np.append(names[a:b], U(b - a)), b - a + 1)
        else:
            yield np.zeros(0, U)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """row_shingles() for every row of a column of texts, A-Z as a-z, words between white space."""
    for _, _, data, offsets in blocks(column):
        starts, ends, pointer = word_spans(data, offsets)
        yield from row_shingles(word_names(data, starts, ends), pointer, k)
