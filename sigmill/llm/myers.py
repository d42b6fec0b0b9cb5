"""Myers' bit-parallel edit distance on sequences of any hashable symbols.

One column of the distance matrix is a pair of bit vectors, held in
integers of any length, so a pattern of m symbols costs O(m / 64) words
for each symbol of the text.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Pairs compared at once, entries of their masks, and the fewest such pairs for each word of a pattern; fewer are faster one by one.
PAIRS, ENTRIES, FEW = 2048, 1 << 22, 30


def masks(pattern: Sequence[Hashable]) -> dict[Hashable, int]:
    out: dict[Hashable, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _columns(peq: dict[Hashable, int], m: int, text: Sequence[Hashable], free: bool):
    """The last row's distance after each symbol; `free`: a match may begin anywhere."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 if free else up << 1 | 1
        down <<= 1
        plus = (down | (full & ~(d | up))) & full
        minus = up & d & full
        yield score


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance of two whole sequences."""
    if not a:
        return len(b)
    score = len(a)
    for score in _columns(masks(a), len(a), b, False):
        pass
    return score


def _differing(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[Sequence[Hashable], Sequence[Hashable]]:
    """Both without what both begin and end with."""
    low = _common(a, b, lambda x, n: x[:n])
    a, b = a[low:], b[low:]
    high = _common(a, b, lambda x, n: x[len(x) - n :])
    return a[: len(a) - high], b[: len(b) - high]


def within(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> bool:
    """Whether the edit distance is at most `most`; what both begin and end with costs nothing.

    Only rows that a path of `most` edits can cross are computed: a window
    that follows the diagonal.  What lies outside is taken as too far.
    """
    if abs(len(a) - len(b)) > most:
        return False
    a, b = sorted(_differing(a, b), key=len)
    m, n = len(a), len(b)
    if not m or n <= most:
        return True
    below, above = (most + n - m) // 2, (most - n + m) // 2
    peq, size = masks(a), below + above + 1
    full, last = (1 << size) - 1, 1 << (size - 1)
    # The window's first row, less one, and the distance above it.
    plus, minus, row, over = full, 0, 0, 0
    for j, c in enumerate(b, 1):
        if j - below - 1 > row:
            over += (plus & 1) - (minus & 1)
            plus, minus, row = plus >> 1 | last, minus >> 1, row + 1
        x = peq.get(c, 0) >> row & full | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = (minus | (full & ~(d | plus))) << 1 | 1, (plus & d) << 1
        plus, minus, over = (down | (full & ~(d | up))) & full, up & d & full, over + 1
        if j % 256 == 0 and _above(plus, minus, over, size, most):
            return False
    end = (1 << m - row) - 1
    return over + (plus & end).bit_count() - (minus & end).bit_count() <= most


def _above(plus: int, minus: int, start: int, size: int, most: int) -> bool:
    """Whether all `size` rows of a column, which begin below distance `start`, are farther than `most`; neighbours differ by one at most."""
    for low in range(0, size, 64):
        rows = min(64, size - low)
        part = (1 << rows) - 1
        to = start + (plus >> low & part).bit_count() - (minus >> low & part).bit_count()
        if (start + to - rows + 1) // 2 <= most:
            return False
        start = to
    return True


def all_within(ones: Sequence[str], others: Sequence[str], most: Sequence[int]) -> np.ndarray:
    """``within`` for many pairs of texts; those of like length go through the columns together.

    A quarter of the edits is tried first: most pairs within `most` are
    near copies, and fewer edits cross fewer words of a column.
    """
    out = np.zeros(len(ones), bool)
    todo = []
    for i, (a, b) in enumerate(zip(ones, others, strict=True)):
        if abs(len(a) - len(b)) <= most[i]:
            a, b = sorted(_differing(a, b), key=len)
            if len(b) <= most[i]:
                out[i] = True
            else:
                todo.append((-(-len(a) // 64), len(b), i, a, b))
    todo.sort(key=lambda x: x[:3])
    _pass(todo, [m // 4 for m in most], out)
    _pass([x for x in todo if not out[x[2]]], most, out)
    return out


def _pass(todo: list[tuple], most: Sequence[int], out: np.ndarray) -> None:
    """Set `out` for the pairs (words, length, number, pattern, text), in order, that are within `most`."""
    todo = [x for x in todo if x[3] and x[1] - len(x[3]) <= most[x[2]]]
    low = 0
    while low < len(todo):
        high = low + 1
        while high < len(todo) and high - low < PAIRS and 4 * todo[high][0] <= 5 * todo[low][0] + 3:
            high += 1
        codes = len(set().union(*[x[3] for x in todo[low:high]])) + 1
        part = todo[low : min(high, low + max(1, ENTRIES // (codes * todo[high - 1][0])))]
        low += len(part)
        at = [x[2] for x in part]
        # Words of a column that are computed.
        if len(part) < FEW * min(part[-1][0], max(most[i] for i in at) // 64 + 2):
            out[at] = [within(a, b, most[i]) for _, _, i, a, b in part]
        else:
            out[at] = _together([x[3] for x in part], [x[4] for x in part], np.array([most[i] for i in at]))


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a column for each text, and the lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((sizes.max(), len(texts)), -1, np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of] = flat
    return out, sizes


def _together(patterns: Sequence[str], texts: Sequence[str], most: np.ndarray) -> np.ndarray:
    """``within`` for pairs whose patterns have about as many words of 64 bits; a carry passes from word to word.

    Only words that a path of at most `most` edits can cross are computed.
    Such a path strays from the diagonal by no more than `most` allows, and
    what lies outside is taken as too far, so the answer is exact.
    """
    one, top = np.uint64(1), np.uint64(63)
    pattern, m = _codes(patterns)
    text, n = _codes(texts)
    known = np.unique(pattern[pattern >= 0])
    codes = len(known) + 1

    def code(x: np.ndarray) -> np.ndarray:
        """Number among the patterns' symbols; the last for all others."""
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[at] == x, at, len(known))

    base = np.arange(len(m)) * codes
    words = -(-int(m.max()) // 64)
    peq = np.zeros((words, len(m) * codes), np.uint64)
    for i, row in enumerate(code(pattern)):
        live = i < m
        peq[i >> 6, (base + row)[live]] |= one << np.uint64(i & 63)
    text = code(text)
    plus, minus = np.full((words, len(m)), ~np.uint64(0)), np.zeros((words, len(m)), np.uint64)
    out, pair = np.zeros(len(m), bool), np.arange(len(m))
    # The least and the most that a row may differ from its column, and the distance above the first word, less its column.
    below, above = int(((most + n - m) // 2).max()), int(((most - n + m) // 2).max())
    first, over = 0, np.zeros(len(m), np.int64)
    ends = np.bincount(n, minlength=len(text) + 1)
    for j in range(len(text)):
        while first < max(0, j - below) >> 6:
            over += _rise(plus[first], minus[first])
            first += 1
        last = min(words - 1, (j + above) >> 6)
        at = base + text[j][pair]
        up, down = one, np.uint64(0)
        for w in range(first, last + 1):
            eq, p, q = peq[w].take(at), plus[w], minus[w]
            x = eq | q
            eq |= down
            d = (((eq & p) + p) ^ p) | eq
            ups, downs = q | ~(d | p), p & d
            if w < last:
                more, less = ups >> top, downs >> top
            ups, downs = (ups << one) | up, (downs << one) | down
            plus[w], minus[w] = downs | ~(x | ups), ups & x
            if w < last:
                up, down = more, less
        if ends[j + 1]:
            done = np.flatnonzero(n[pair] == j + 1)
            score, rows = over[done] + j + 1, m[pair[done]]
            for w in range(first, last + 1):
                used = np.clip(rows - 64 * w, 0, 64)
                mask = np.where(used > 0, ~np.uint64(0) >> (np.maximum(64 - used, 0) & 63).astype(np.uint64), np.uint64(0))
                score += _rise(plus[w, done] & mask, minus[w, done] & mask)
            out[pair[done]] = score <= most[pair[done]]
        if j % 32 == 31:
            keep = (n[pair] > j + 1) & (_least(plus[first : last + 1], minus[first : last + 1], over + j + 1, 64 * first, m[pair] - n[pair] + j + 1) <= most[pair])
            if not keep.any():
                break
            if keep.mean() < 0.9:
                pair, base, over, plus, minus = pair[keep], base[keep], over[keep], plus[:, keep], minus[:, keep]
    return out


def _rise(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """How much the distance grows over the rows of a word."""
    return np.bitwise_count(plus).astype(np.int64) - np.bitwise_count(minus)


def _least(plus: np.ndarray, minus: np.ndarray, start: np.ndarray, row: int, diagonal: np.ndarray) -> np.ndarray:
    """No path through these rows of a column, which begin after `row` at distance `start`, ends with less; `diagonal` is the row on the end's."""
    least, at, off = np.full(len(start), 1 << 40), start, row - diagonal
    for p, q in zip(plus, minus, strict=True):
        for part in range(0, 64, 32):
            shift = np.uint64(part)
            to = at + _rise((p >> shift) & np.uint64(0xFFFFFFFF), (q >> shift) & np.uint64(0xFFFFFFFF))
            beyond = off + 32
            # Neighbours differ by one at most; the rows after the last may also be needed to come back to the diagonal.
            back = np.where((off > 0) | (beyond < 0), np.minimum(np.abs(off), np.abs(beyond)), 0)
            least = np.minimum(least, (at + to - 31) // 2 + back)
            at, off = to, beyond
    return least


def _common(a: Sequence[Hashable], b: Sequence[Hashable], part) -> int:
    """The length of the longest equal part, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if part(a, mid) == part(b, mid) else (low, mid - 1)
    return low


def ends(peq: dict[Hashable, int], m: int, text: Sequence[Hashable]) -> list[int]:
    """For each end in the text, the least distance of the pattern to a part that ends there."""
    return list(_columns(peq, m, text, True))


def start_of(pattern: Sequence[Hashable], text: Sequence[Hashable], best: int) -> int:
    """The start of the longest suffix of `text` at distance `best` from the pattern."""
    back = list(_columns(masks(pattern[::-1]), len(pattern), text[::-1], False))
    return len(text) - 1 - max(i for i, d in enumerate(back) if d == best)
