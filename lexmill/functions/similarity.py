"""Integer similarities of many pairs of texts at once (NumPy), for Arrow UDFs.

Distances are Levenshtein's by Myers' bit vectors: a pattern of up to 64 characters is one
machine word, and one NumPy operation moves many pairs (lanes) on by a character of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Characters of a machine word; longer pairs are compared by the plain table.
WORD = 64
#: Lanes that move together, so that their words stay in the processor's cache; so few go one by one.
LANES, BLOCK, FEW = 16384, 4096, 8
#: Characters of text that are worked on at once, whole and by windows.
PART, WINDOWS = 1 << 21, 1 << 18
_FULL, _ONE = (1 << WORD) - 1, np.uint64(1)
_TOKEN = re.compile("[A-Za-z0-9]+|[一-鿿]")


def _codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _sizes(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _masks(patterns: Sequence[str], texts: Sequence[str], sizes: np.ndarray) -> np.ndarray:
    """For each character of the texts, which places of its row's pattern hold it. Equal patterns stand together."""
    codes, out = _codes(texts), np.zeros(sizes.sum(), np.uint64)
    ends, first, start = np.cumsum(sizes), 0, 0
    for last in range(1, len(patterns) + 1):
        if last < len(patterns) and patterns[last] == patterns[first]:
            continue
        bits: dict[int, int] = {}
        for k, c in enumerate(patterns[first]):
            bits[ord(c)] = bits.get(ord(c), 0) | 1 << k
        keys = np.array(sorted(bits), np.uint32)
        words, end = np.array([bits[k] for k in keys.tolist()], np.uint64), ends[last - 1]
        at = np.minimum(np.searchsorted(keys, codes[start:end]), len(keys) - 1)
        np.copyto(out[start:end], words[at], where=keys[at] == codes[start:end])
        first, start = last, end
    return out


def _rest(masks: np.ndarray, p: int, m: int) -> tuple[int, int]:
    """The steps of ``_lanes`` for one lane."""
    for e in masks.tolist():
        xv, xh = e | m, (((e & p) + p) ^ p) | e
        h, m = (m | ~(xh | p)) << 1 | 1, (p & xh) << 1
        p, m = (m | ~(xv | h)) & _FULL, h & xv & _FULL
    return p, m


def _move(p: np.ndarray, m: np.ndarray, e: np.ndarray) -> None:
    """The same for many lanes, in place."""
    xv = e | m
    xh = e & p
    xh += p
    xh ^= p
    xh |= e
    h = ~(xh | p)
    h |= m
    h <<= _ONE
    h |= _ONE
    xh &= p
    xh <<= _ONE
    np.bitwise_and(h, xv, out=m)
    xv |= h
    np.bitwise_or(xh, ~xv, out=p)


def _lanes(masks: np.ndarray, at: np.ndarray, steps: np.ndarray, size: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
    """Distance of each lane: a pattern of ``size`` characters, from place ``shift`` on, and the ``steps`` characters of text from ``at`` on."""
    order = np.argsort(-steps, kind="stable")
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), LANES):
        rows = order[i : i + LANES]
        a, s = at[rows], steps[rows]
        pv, mv = np.full(len(rows), _FULL, np.uint64), np.zeros(len(rows), np.uint64)
        alive = np.searchsorted(-s, -np.arange(s[0]), side="left").tolist()
        for j, k in enumerate(alive):
            if k <= FEW:
                for r in range(k):
                    e = masks[a[r] + j : a[r] + s[r]]
                    pv[r], mv[r] = _rest(e if shift is None else e >> shift[rows[r]], int(pv[r]), int(mv[r]))
                break
            e = masks[a[:k] + j]
            _move(pv[:k], mv[:k], e if shift is None else e >> shift[rows[:k]])
        low = np.uint64(_FULL) >> (WORD - size[rows]).astype(np.uint64)
        out[rows] = s + np.bitwise_count(pv & low).astype(np.int64) - np.bitwise_count(mv & low)
    return out


def _table(pattern: str, texts: np.ndarray) -> np.ndarray:
    """Distances of a text of any length and each row of a matrix of characters, row by row of the plain table."""
    codes = _codes([pattern])
    ramp = np.arange(len(codes) + 1, dtype=np.int32)
    row = np.tile(ramp, (len(texts), 1))
    for j in range(texts.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = j + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != texts[:, j, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row[:, -1]


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows with about ``most`` characters of text."""
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, side="right")))
        yield slice(first, last)
        first = last


def _shared(b: Sequence[str]) -> bool:
    return len(b) > FEW and 0 < len(b[0]) <= WORD and all(x == b[0] for x in b)


def distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Levenshtein distance of each pair; quickest where all pairs share their ``b``."""
    if _shared(b):
        return Texts(a).distances(b[0])
    out = np.maximum(_sizes(a), _sizes(b))
    swap = [len(y) > WORD >= len(x) for x, y in zip(a, b)]
    texts, patterns = [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]
    short = sorted((i for i in range(len(a)) if 0 < len(patterns[i]) <= WORD and texts[i]), key=patterns.__getitem__)
    texts_of, patterns_of = [texts[i] for i in short], [patterns[i] for i in short]
    every, rows = _sizes(texts_of), np.array(short, np.int64)
    for part in _parts(every, PART):
        sizes = every[part]
        masks = _masks(patterns_of[part], texts_of[part], sizes)
        out[rows[part]] = _lanes(masks, np.cumsum(sizes) - sizes, sizes, _sizes(patterns_of[part]))
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) > WORD and len(y) > WORD:
            out[i] = _table(y, _codes([x])[None])[0]
    return out


def _least(masks: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least distance of each row's pattern, of ``m`` characters, and the windows of that size in its text.

    Neighbours' distances differ by two at most. So every fourth window is measured, then the
    second ones and last the odd ones, each only if its neighbours let it fall below the least so far.
    """
    count = sizes - m + 1
    row, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]
    at, after = (np.cumsum(sizes) - sizes)[row] + place, count[row] - place
    found, best = np.zeros(len(row), np.int64), m.copy()
    for gap, step in ((4, 4), (4, 2), (2, 1)):
        here = np.flatnonzero(place % gap == (0 if step == gap else step))
        if step < gap:  # the place before is known, exactly or by a bound; the one after too, if there is one
            bound = np.maximum(found[here - step], np.where(after[here] > step, found[np.minimum(here + step, len(found) - 1)], 0)) - 2 * step
            found[here] = bound
            here = here[bound < best[row[here]]]
        size = m[row[here]]
        found[here] = _lanes(masks, at[here], size, size)
        np.minimum.at(best, row[here], found[here])
    return best


def window_distances(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Least distance of each ``short``, which is not empty, and the parts of its length in ``long``."""
    out = _sizes(short)
    order = sorted((i for i in range(len(short)) if len(short[i]) <= WORD), key=short.__getitem__)
    texts, patterns = [long[i] for i in order], [short[i] for i in order]
    every, rows = _sizes(texts), np.array(order, np.int64)
    for part in _parts(every, WINDOWS):
        out[rows[part]] = _least(_masks(patterns[part], texts[part], every[part]), every[part], _sizes(patterns[part]))
    for i, (x, y) in enumerate(zip(short, long)):
        if len(x) > WORD:
            windows = np.lib.stride_tricks.sliding_window_view(_codes([y]), len(x))
            out[i] = min(int(_table(x, windows[k : k + LANES]).min()) for k in range(0, len(windows), LANES))
    return out


def basis(numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """Share in basis points, rounded; one where there is nothing to share."""
    return np.where(denominator == 0, 10000, (numerator * 10000 + denominator // 2) // np.maximum(denominator, 1))


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    m = np.maximum(_sizes(a), _sizes(b))
    return basis(m - distances(a, b), m)


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio of the shorter text with the windows of its length; of an empty one, 0, but with another."""
    if _shared(b):
        return Texts(a).partial_ratios(b[0])
    short, long = [x if len(x) <= len(y) else y for x, y in zip(a, b)], [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    out, some = np.array([0 if y else 10000 for y in long], np.int64), [i for i, x in enumerate(short) if x]
    size = _sizes([short[i] for i in some])
    out[some] = basis(size - window_distances([short[i] for i in some], [long[i] for i in some]), size)
    return out


def tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased; each CJK ideograph on its own."""
    return _TOKEN.findall(text.lower()) if text.isascii() else [t.lower() for t in _TOKEN.findall(text)]


def token_sort_ratios(a: Sequence[list[str]], b: Sequence[list[str]]) -> np.ndarray:
    return ratios([" ".join(sorted(x)) for x in a], [" ".join(sorted(y)) for y in b])


def token_set_ratios(a: Sequence[list[str]], b: Sequence[list[str]]) -> np.ndarray:
    """Best ratio of the common tokens, and of them with either side's others; what two sides begin with alike needs no distance."""
    both, one, other = [], [], []
    for x, y in zip(map(set, a), map(set, b)):
        both.append(len(" ".join(x & y)))
        one.append(" ".join(sorted(x - y)))
        other.append(" ".join(sorted(y - x)))
    core = np.array(both, np.int64)
    left, right = (core + _sizes(s) + ((core > 0) & (_sizes(s) > 0)) for s in (one, other))
    apart = np.where((_sizes(one) > 0) & (_sizes(other) > 0), distances(one, other), abs(left - right))
    longer = np.maximum(left, right)
    return np.maximum(np.maximum(basis(core, left), basis(core, right)), basis(longer - apart, longer))


def grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) >= n else {text} if text else set()


def jaccards(pairs: Iterable[tuple[set[str], set[str]]]) -> np.ndarray:
    sizes = np.array([(len(x & y), len(x) + len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    return basis(sizes[:, 0], sizes[:, 1] - sizes[:, 0])


#: Characters of views that are scored at once, places of a matrix of texts, and the longest text whose n-grams are sorted in one.
VIEWS, CELLS, WIDE = 1 << 19, 1 << 21, 256
_NONE = 0x110000  #: no character


class Texts:
    """Many texts as arrays of characters, to be compared with one pattern after another. The longest come first, so that those which go on are the first ones."""

    def __init__(self, texts: Sequence[str]) -> None:
        sizes = _sizes(texts)
        self.order = np.argsort(-sizes, kind="stable")
        self.texts, self.sizes = [texts[i] for i in self.order.tolist()], sizes[self.order]
        self.codes, self.at = _codes(self.texts), np.cumsum(self.sizes) - self.sizes

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The texts in runs of at most ``BLOCK`` and ``CELLS`` places, each as a matrix: a place of all its texts a row."""
        i = 0
        while i < len(self.sizes):
            some = slice(i, i + max(1, min(BLOCK, CELLS // max(1, int(self.sizes[i])))))
            size, at = self.sizes[some], self.at[some]
            block = np.full((len(size), int(size[0])), _NONE, np.uint32)
            block[np.arange(block.shape[1]) < size[:, None]] = self.codes[at[0] : at[-1] + size[-1]]
            yield some, np.ascontiguousarray(block.T)
            i += len(size)

    def given(self, found: np.ndarray) -> np.ndarray:
        """Values in the order in which the texts came."""
        out = np.empty_like(found)
        out[self.order] = found
        return out

    def distances(self, pattern: str) -> np.ndarray:
        if not 0 < len(pattern) <= WORD:
            return self.given(distances(self.texts, [pattern] * len(self.texts)))
        table, low, out = _places(pattern), np.uint64(_FULL >> WORD - len(pattern)), self.sizes.copy()
        for some, block in self.blocks():
            size = self.sizes[some]
            p, m, masks = np.full(len(size), _FULL, np.uint64), np.zeros(len(size), np.uint64), table[block]
            for j, k in enumerate(np.searchsorted(-size, -np.arange(len(block)), side="left").tolist()):
                if k <= FEW:
                    for r in range(k):
                        p[r], m[r] = _rest(masks[j : size[r], r], int(p[r]), int(m[r]))
                    break
                _move(p[:k], m[:k], masks[j, :k])
            out[some] += np.bitwise_count(p & low).astype(np.int64) - np.bitwise_count(m & low)
        return self.given(out)

    def partial_ratios(self, pattern: str) -> np.ndarray:
        if not 0 < len(pattern) <= WORD:
            return self.given(partial_ratios(self.texts, [pattern] * len(self.texts)))
        masks, size, out = _places(pattern)[self.codes], len(pattern), np.zeros(len(self.sizes), np.int64)
        whole, some = (int(np.searchsorted(-self.sizes, -k, side="right")) for k in (size, 1))
        for part in _parts(self.sizes[:whole], WINDOWS):
            held, m = self.sizes[part], np.full(part.stop - part.start, size)
            out[part] = basis(m - _least(masks[self.at[part.start] : self.at[part.stop - 1] + held[-1]], held, m), m)
        for i in range(whole, some, BLOCK):  # windows of the pattern
            m = self.sizes[i : min(some, i + BLOCK)]
            count = size - m + 1
            first, row = np.cumsum(count) - count, np.repeat(np.arange(len(m)), count)
            found = _lanes(masks, self.at[i : i + len(m)][row], m[row], m[row], (np.arange(len(row)) - first[row]).astype(np.uint64))
            out[i : i + len(m)] = basis(m - np.minimum.reduceat(found, first), m)
        return self.given(out)

    def jaccards(self, patterns: Sequence[str], n: int) -> np.ndarray:
        """n-gram scores with each pattern (first axis)."""
        out, own = np.empty((len(patterns), len(self.texts)), np.int64), [grams(t, n) for t in patterns]
        fast = np.zeros(len(self.sizes), bool)
        if n <= 3 and all(len(t) >= n for t in patterns):
            fast = self.sizes >= n
            known = [np.array(sorted({_gram(g) for g in mine}), np.uint64) for mine in own]
            for some, block in self.blocks():
                size = self.sizes[some]
                if size[0] > WIDE:
                    fast[some] = False  # few, or else as wide as to be sorted in vain
                    continue
                keys, many = np.zeros((max(0, len(block) - n + 1), len(size)), np.uint64), np.maximum(size - n + 1, 0)
                for k in range(n):
                    keys |= block[k : len(block) - n + 1 + k].astype(np.uint64) << np.uint64(21 * k)
                keys = np.where(np.arange(len(keys))[:, None] < many, keys, np.uint64(_FULL)).T
                ranked = np.sort(keys, axis=1)
                distinct = (ranked[:, 1:] != ranked[:, :-1]).sum(axis=1) + 1 - (many < keys.shape[1])
                for k, mine in enumerate(known):
                    at = np.minimum(np.searchsorted(mine, ranked), len(mine) - 1)
                    hit = mine[at] == ranked
                    hit[:, 1:] &= ranked[:, 1:] != ranked[:, :-1]
                    both = hit.sum(axis=1)
                    out[k, some] = basis(both, distinct + len(mine) - both)
        if len(rest := np.flatnonzero(~fast)):
            parts = [grams(self.texts[i], n) for i in rest.tolist()]
            for k, mine in enumerate(own):
                out[k, rest] = jaccards((x, mine) for x in parts)
        return np.array([self.given(x) for x in out])


def _gram(text: str) -> int:
    return sum(ord(c) << 21 * k for k, c in enumerate(text))


def _places(pattern: str) -> np.ndarray:
    """For every character, which places of the pattern hold it (memory that no character of a text falls into is never touched)."""
    table = np.zeros(_NONE + 1, np.uint64)
    for k, c in enumerate(pattern):
        table[ord(c)] |= np.uint64(1 << k)
    return table


def scores(views: Sequence[str], templates: Sequence[str], n: int) -> np.ndarray:
    """Of every view (last axis) and template (first axis): ratio, partial, token sort, token set and n-gram scores."""
    out = np.empty((len(templates), 5, len(views)), np.int64)
    for part in _parts(_sizes(views), VIEWS):
        out[:, :, part] = _scores(views[part], templates, n)
    return out


def _scores(views: Sequence[str], templates: Sequence[str], n: int) -> np.ndarray:
    out, words = np.empty((len(templates), 5, len(views)), np.int64), [tokens(v) for v in views]
    kinds = [set(w) for w in words]
    whole, listed, once = Texts(views), Texts([" ".join(sorted(w)) for w in words]), Texts([" ".join(sorted(k)) for k in kinds])
    sizes, listed_sizes, once_sizes = _sizes(views), listed.given(listed.sizes), once.given(once.sizes)
    out[:, 4] = whole.jaccards(templates, n)
    for k, t in enumerate(templates):
        mine = tokens(t)
        own, line = set(mine), " ".join(sorted(mine))
        m = np.maximum(sizes, len(t))
        out[k, 0] = basis(m - whole.distances(t), m)
        out[k, 1] = whole.partial_ratios(t)
        m = np.maximum(listed_sizes, len(line))
        out[k, 2] = basis(m - listed.distances(line), m)
        # without a common token the best ratio is that of all tokens; one where a side has none
        other = " ".join(sorted(own))
        m = np.maximum(once_sizes, len(other))
        out[k, 3] = np.where((once_sizes > 0) & (len(other) > 0), basis(m - once.distances(other), m), 10000)
        common = [i for i, x in enumerate(kinds) if not own.isdisjoint(x)]
        out[k, 3, common] = token_set_ratios([words[i] for i in common], [mine] * len(common))
    return out
