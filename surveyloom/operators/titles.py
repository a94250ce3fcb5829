"""Titles and texts that meet in one task: which pairs are alike, hold one another, or have enough words in common."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Pairs that are looked at together, shared stretches that are counted together, pairs whose edits are counted together, and their letters.
CELLS, PIECE, LANES, LETTERS = 1 << 18, 1 << 18, 256, 1 << 20
#: An odd number that spreads bits, and the bits of a stretch's code. Two stretches of one code are told apart in the end.
SPREAD, BITS = np.uint64(0x9E3779B97F4A7C15), 20
#: Before any place, beyond any number of edits, no letter.
NEVER, FAR, NONE = -(1 << 40), np.int32(1 << 29), np.uint32(0xFFFFFFFF)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1, ..."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches whose counts n are about PIECE together."""
    upto = np.cumsum(n)
    if upto.size:
        cuts = np.unique([*np.searchsorted(upto, np.arange(0, int(upto[-1]), PIECE)).tolist(), 0, upto.size])
        yield from zip(cuts.tolist(), cuts[1:].tolist())


def edits(n: np.ndarray, least: float) -> np.ndarray:
    """The most edits by which titles, the longer of n letters, are `least` alike."""
    return np.floor(n * (1 - least) + 1e-9).astype(np.int64)


class _Grams:
    """Every stretch of q letters: its text (row), its place in half letters from the text's middle (at), its code, and where the
    same code stood last in that text (before). Rows go up; a text's stretches are first[row] .. first[row + 1] - 1."""

    def __init__(self, texts: list[str], q: int):
        n = _lengths(texts)
        letters, start = _letters(texts).astype(np.uint64), np.cumsum(n) - n
        count = np.maximum(n - q + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.row = np.repeat(np.arange(n.size), count)
        place = np.arange(self.row.size) - self.first[self.row]
        self.at, code = 2 * place - n[self.row], np.zeros(place.size, np.uint64)
        for i in range(q):
            code = code * SPREAD + letters[start[self.row] + place + i]
        self.code = (code * SPREAD >> np.uint64(64 - BITS)).astype(np.int64)
        wide = max(1, int(n.max(initial=1)).bit_length())
        order = np.sort((self.row << BITS | self.code) << wide | place)
        same = (order[1:] >> wide) == (order[:-1] >> wide)
        there = self.first[order >> wide + BITS] + (order & (1 << wide) - 1)
        self.before = np.full(place.size, NEVER)
        self.before[there[1:][same]] = self.at[there[:-1][same]]
        self._sorted: list[np.ndarray] = []

    def sorted(self) -> list[np.ndarray]:
        """Codes going up, and places in that order (each code's going up), texts and `before`."""
        if not self._sorted:
            order = np.lexsort((self.at, self.code))
            self._sorted = [x[order] for x in (self.code, self.at, self.row, self.before)]
        return self._sorted

    def of(self, x: int, y: int) -> slice:
        return slice(int(self.first[x]), int(self.first[y]))


def _within(ta: list[str], tb: list[str], may: np.ndarray) -> np.ndarray:
    """Bool by pair: whether it's at most `may` edits apart. Only the diagonals that so few edits can reach are computed."""
    out = np.zeros(len(ta), bool)
    m, n = _lengths(ta), _lengths(tb)
    order, x = np.argsort(m, kind="stable"), 0
    while x < order.size:
        own = order[x : x + LANES]
        own = own[: max(1, LETTERS // max(1, int(m[own[-1]])))]
        x += own.size
        p, q, most = (k[own].astype(np.int32) for k in (m, n, may))
        low, wide, rows = -((p - q + most) // 2), int(most.max()) + 1, int(p.max())
        a, b = np.full((rows, own.size), NONE), np.full((rows + wide, own.size), NONE)
        lane = np.arange(own.size)
        a[_spread(np.zeros_like(p), p), np.repeat(lane, p)] = _letters([ta[k] for k in own])
        place, letters, of = _spread(-low, q - low), _letters([tb[k] for k in own]), np.repeat(lane, q)
        fits = (place >= 0) & (place < rows + wide)
        b[place[fits], of[fits]] = letters[fits]
        step = np.arange(wide, dtype=np.int32)[:, None]
        now = low + step
        now = np.where(now < 0, FAR, now)
        for i in range(rows + 1):
            ended = np.flatnonzero(p == i)
            if ended.size:
                out[own[ended]] = now[(q - p - low)[ended], ended] <= most[ended]
            if i % 8 == 0:
                # From here on it takes an edit a diagonal to get to where the titles end.
                on = (p > i) & ((now + np.abs(q - p - low - step)).min(axis=0) <= most)
                if not on.any():
                    break
                if not on.all():
                    own, p, q, most, low, a, b, now = own[on], p[on], q[on], most[on], low[on], a[:, on], b[:, on], now[:, on]
            if i < rows:
                here = now + (b[i : i + wide] != a[i])
                here[:-1] = np.minimum(here[:-1], now[1:] + 1)
                now = np.minimum.accumulate(here - step, axis=0) + step
    return out


def _near_in(a: _Grams, b: _Grams, q: int, m: np.ndarray, n: np.ndarray, x: int, y: int, s: int, t: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, edits) of titles x .. y - 1 and s .. t - 1 that may be so many edits apart."""
    m, n = m[x:y], n[s:t]
    longer = np.maximum.outer(m, n)
    may = edits(longer, least)
    fits = (may > 0) & (np.abs(np.subtract.outer(m, n)) <= may)
    middle = int(longer.max()) + int(may.max()) + 1
    code, there, col, there_before = b.sorted()
    some = np.flatnonzero((col >= s) & (col < t))
    col, there, there_before = col[some] - s, there[some], there_before[some]
    key = code[some] * (2 * middle + 1) + there + middle
    own = a.of(x, y)
    row, here, here_before = a.row[own] - x, a.at[own], a.before[own]
    place, most = a.code[own] * (2 * middle + 1) + here + middle, may.max(axis=1)[row]
    low, high = np.searchsorted(key, place - most), np.searchsorted(key, place + most, "right")
    shared = np.zeros(longer.size, np.int64)
    for u, v in _pieces(high - low):
        i, j = np.repeat(np.arange(u, v), (high - low)[u:v]), _spread(low[u:v], high[u:v])
        pair = row[i] * n.size + col[j]
        # Each stretch of the longer title counts once, however often it stands in the other.
        apart, at, other = may.ravel()[pair], here[i], there[j]
        first = np.where(n[col[j]] >= m[row[i]], here_before[i] < other - apart, there_before[j] < at - apart)
        shared += np.bincount(pair[first & (np.abs(at - other) <= apart)], minlength=longer.size)
    i, j = np.nonzero(fits & (shared.reshape(longer.shape) >= longer + 1 - q - q * may))
    return i + x, j + s, may[i, j]


def near(ta: list[str], tb: list[str], least: float, grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different titles that are `least` alike; both lists go up by length, `grams` gives their stretches.

    An edit spoils at most q of a title's stretches of q letters, so the longer one keeps all but q times the edits. Letters before
    a kept stretch moved it by the insertions less the deletions there, those after it by those behind: measured from both
    titles' middles it's at most half a letter an edit off. What is left has its edits counted, many pairs at a time.
    """
    m, n, found = _lengths(ta), _lengths(tb), []
    x = int(np.searchsorted(m, 1))
    while x < m.size:
        y = min(int(np.searchsorted(m, int(m[x] * 1.15), "right")), x + 256)
        short, first = int(m[x]), int(np.searchsorted(n, max(1, np.ceil(m[x] * least - 1e-6))))
        last = int(np.searchsorted(n, m[y - 1] / max(least, 1e-9) + 1e-6, "right"))
        if first < last and edits(max(m[y - 1], n[last - 1]), least) > 0:
            q = next((q for q in (4, 3, 2) if short + 1 - q - q * int(edits(short, least)) > short // 6), 1)
            for s in range(first, last, max(1, CELLS // (y - x))):
                found.append(_near_in(*grams(q), q, m, n, x, y, s, min(last, s + max(1, CELLS // (y - x))), least))
        x = y
        if found and (x == m.size or sum(i.size for i, _, _ in found) > 64 * LANES):
            i, j, may = map(np.concatenate, zip(*found))
            other = np.array([k for k, (u, v) in enumerate(zip(i.tolist(), j.tolist())) if ta[u] != tb[v]], np.int64)
            i, j, may, found = i[other], j[other], may[other], []
            some = _within([ta[k] for k in i], [tb[k] for k in j], may)
            yield i[some], j[some]


def holding(short: list[str], long: list[str], own: _Grams, there: _Grams, q: int) -> tuple[list[int], list[int]]:
    """Pairs (i, j) of titles of which long[j] holds short[i], looked up by the rarest stretch of q letters."""
    once = np.flatnonzero(there.before == NEVER)
    once = once[np.argsort(there.code[once], kind="stable")]
    code, row = there.code[once], there.row[once]
    often = np.bincount(code, minlength=1 << BITS)[own.code]
    order = np.lexsort((often, own.row))
    rarest = order[own.first[:-1][np.diff(own.first) > 0]]
    rarest = rarest[often[rarest] > 0]
    bounds = zip(*(np.searchsorted(code, own.code[rarest], side).tolist() for side in ("left", "right")))
    looked = [(i, row[x:y].tolist()) for i, (x, y) in zip(own.row[rarest].tolist(), bounds)]
    looked += [(i, range(len(long))) for i, t in enumerate(short) if 0 < len(t) < q]
    i_out, j_out = [], []
    for i, rows in looked:
        t = short[i]
        found = [j for j in rows if t in long[j]]
        i_out += [i] * len(found)
        j_out += found
    return i_out, j_out


def _words_held(words: list[list[str]], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(title, word) of every word that stands in a title, and the texts that hold each word: where[bounds[word]:bounds[word + 1]]."""
    number: dict[str, int] = {}
    title = np.repeat(np.arange(len(words)), [len(w) for w in words])
    word = np.array([number.setdefault(w, len(number)) for own in words for w in own], np.int64)
    sizes, stands = sorted({len(w) for w in number}), {}
    for j, text in enumerate(texts):
        for token in set(text.split(" ")) if text and sizes else ():
            if len(token) >= sizes[0]:
                stands.setdefault(token, []).append(j)
    tokens, held = [], []
    for k, token in enumerate(stands):
        # A word has no blank, so one of the text's words holds it.
        for n in sizes[: bisect_right(sizes, len(token))]:
            for part in {token[i : i + n] for i in range(len(token) - n + 1)}:
                if part in number:
                    tokens.append(k)
                    held.append(number[part])
    upto = np.cumsum([0, *map(len, stands.values())])
    rows = np.fromiter(chain.from_iterable(stands.values()), np.int64, int(upto[-1]))
    low, high = upto[np.array(tokens, np.int64)], upto[np.array(tokens, np.int64) + 1]
    pairs = np.unique(np.repeat(np.array(held, np.int64) * len(texts), high - low) + rows[_spread(low, high)])
    return title, word, pairs % max(1, len(texts)), np.searchsorted(pairs, np.arange(len(number) + 1) * len(texts))


def meet(ta: list[str], tb: list[str | None], texts: list[str | None], least: float, coverage: float | None, longer: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) whose titles are `least` alike or hold one another, or whose text holds at least `coverage` (None: only titles
    count) of the title's words of more than `longer` letters, each as often as it stands; and the share of words that it holds.

    Each pair once, some at a time.
    """
    by_a, by_b = sorted(range(len(ta)), key=lambda i: len(ta[i])), sorted(range(len(tb)), key=lambda j: len(tb[j] or ""))
    ta, tb, texts = [ta[i] for i in by_a], [tb[j] or "" for j in by_b], [texts[j] if coverage is not None else None for j in by_b]
    by_a, by_b, n, known = np.array(by_a), np.array(by_b), len(tb), {}

    def grams(q: int) -> tuple[_Grams, _Grams]:
        if q not in known:
            known[q] = _Grams(ta, q), _Grams(tb, q)
        return known[q]

    a, b = grams(3)
    (i, j), (l, k) = holding(ta, tb, a, b, 3), holding(tb, ta, b, a, 3)
    alike = np.unique(np.concatenate([np.array(i + k, np.int64) * n + np.array(j + l, np.int64), *(i * n + j for i, j in near(ta, tb, least, grams))]))
    words = [[w for w in t.split(" ") if len(w) > longer] for t in ta]
    title, word, where, bounds = _words_held(words, texts)
    size, low, high = _lengths(words), bounds[word], bounds[word + 1]
    step = max(1, CELLS // n)
    for x in range(0, len(ta), step):
        y = min(len(ta), x + step)
        own = slice(*np.searchsorted(title, [x, y]))
        hits = np.zeros((y - x) * n, np.int64)
        for s, e in _pieces(high[own] - low[own]):
            first, last = low[own][s:e], high[own][s:e]
            hits += np.bincount(np.repeat((title[own][s:e] - x) * n, last - first) + where[_spread(first, last)], minlength=hits.size)
        share = hits / np.repeat(np.maximum(size[x:y], 1), n)
        found = alike[slice(*np.searchsorted(alike, [x * n, y * n]))] - x * n
        if coverage is not None:
            found = np.union1d(found, np.flatnonzero(share >= coverage))
        if found.size:
            yield by_a[found // n + x], by_b[found % n], share[found]
