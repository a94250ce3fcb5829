"""Token ids of public byte-level BPE vocabularies inside tasks.

The ids are those of `tokenizers` for the given JSON file with add_special_tokens=False; the same merges, given as
ranks, are applied by `tiktoken`, which is several times as fast. Texts that hold the special token's string go
through `tokenizers` itself, as only it knows that token. Nothing is trained; the files stay where they are.

The vocabulary's pattern always ends a match before a single space that stands between two characters other than white
space, so a text is the sequence of its units cut there, and equal units have equal ids. `Units` encodes each
distinct unit of a few megabytes once and copies its ids for the others in numpy.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .words import WHITE, blocks, exact_ids

SPECIAL = "<|endoftext|>"
NAMES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def vocabulary_paths(names: tuple[str, str] = NAMES) -> tuple[str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in names)


@cache
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(json_path: str, ranks_path: str):
    """A function from a text (None: empty) to its ids as an array of unsigned 32-bit integers."""
    ranked = _ranked(ranks_path)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SPECIAL in text:
            return np.array(_whole(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
        return ranked.encode_to_numpy(text)

    return encode


#: White space outside ASCII as UTF-8; texts near it are encoded whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of text whose distinct units are encoded together.
TOGETHER = 4 << 20


class Units:
    """Encodes columns of texts; units count as equal only if their bytes are."""

    def __init__(self, json_path: str, ranks_path: str):
        self.encode = encoder(json_path, ranks_path)
        ranked = _ranked(ranks_path)
        self.width = np.array([len(ranked.decode_single_token_bytes(i)) for i in range(ranked.max_token_value + 1)], np.int64)

    def _each(self, raw: bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each unit has); plain units, encoded in one go, are told apart by their tokens' bytes."""
        counts, found = np.zeros(len(start), np.int64), [np.zeros(0, np.uint32)]
        for i in np.flatnonzero(~plain).tolist():
            found.append(self.encode(raw[start[i] : end[i]].decode()))
            counts[i] = len(found[-1])
        a, b = start[plain], end[plain]
        if len(a):
            ids = self.encode(b"".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist())]).decode())
            counts[plain] = np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(b - a)) + 1, prepend=0)
            found.append(ids)
        return np.concatenate(found), counts

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column; null counts as empty."""
        for first, n, data, offsets in blocks(column, TOGETHER):
            raw = data.tobytes()
            if WIDE_SPACE.search(raw) or SPECIAL.encode() in raw:
                yield from (self.encode(x.as_py()) for x in column.slice(first, n))
                continue
            if not len(data):
                yield from (np.zeros(0, np.uint32) for _ in range(n))
                continue
            inside = ~WHITE[data]
            cut = data == 0x20
            cut[1:] &= inside[:-1]
            cut[:-1] &= inside[1:]
            cut[-1] = False
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
            at, which = exact_ids(data, start, end)
            # Units that start with a space and end without can stand one after the other.
            plain = (data[start[at]] == 0x20) & ~WHITE[data[end[at] - 1]]
            ids, counts = self._each(raw, start[at], end[at], plain)
            order = np.append(np.flatnonzero(~plain), np.flatnonzero(plain))
            first_id = np.empty(len(at), np.int64)
            first_id[order] = np.cumsum(counts[order]) - counts[order]
            lengths = counts[which]
            ends = np.cumsum(lengths)
            ids = ids[np.repeat(first_id[which] - (ends - lengths), lengths) + np.arange(ends[-1])]
            edges = np.append(0, ends)[np.searchsorted(start, offsets)]
            yield from (ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))


@cache
def units(json_path: str, ranks_path: str) -> Units:
    return Units(json_path, ranks_path)
