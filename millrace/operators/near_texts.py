"""Pairs of texts of two tiles that may be similar: what a task does with one pair of tiles.

Texts of l and k characters (k <= l) with a ratio from t on have at least M = t (l + k) / 2 characters in common, in the
same order, so l - M of the longer one and k - M of the shorter one, D = l + k - 2 M together, are left over. Pieces of the
longer one that may hold one of these take two of D + 1, a piece that may hold none takes one (pigeonhole): either the shorter
one has a piece without one of its characters, or with one more character inside, or the last piece as it is; and no
further along than l - M and k - M let it be. Pieces are laid where the other tile has few such places. What meets so is
compared by counts of characters, then by the pairs of characters that stand together.
Where thresholds leave pieces too short to tell anything, counts of characters are compared, text by text.
"""

from __future__ import annotations

import numpy as np

#: Characters of a piece, at least and at most; places where pieces may begin that are tried; pairs looked at together.
SHORTEST, LONGEST, LAYOUTS, AT_ONCE = 4, 8, 8, 1 << 18
#: Classes of characters, and their counts in a bit each; classes of two characters that stand together.
CLASSES, LEVELS, DOUBLES = 16, 8, 256
#: Bits of a key: hash, place in the text (as coarse as it takes), row.
PLACE, ROW = 6, 26
R = 0x9E3779B1
#: Keys that are sorted and looked up together.
KEYS = 1 << 21


def _power(n: int) -> np.uint32:
    return np.uint32(pow(R, n, 1 << 32))


class Tile:
    """Texts in order of length: characters one after the other, counts of them by class, and which two stand together."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.n) - self.n
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.n)
        self.place = np.arange(len(code), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.n)
        counts = np.bincount(self.text * np.int64(CLASSES) + code % CLASSES, minlength=len(texts) * CLASSES).astype(np.int32).reshape(-1, CLASSES)
        self.bits = np.ascontiguousarray(np.packbits(counts[:, :, None] > np.arange(LEVELS, dtype=np.int32), axis=None).view(np.uint64).reshape(len(texts), -1).T)
        self.more = np.maximum(counts - LEVELS, 0).sum(axis=1)
        # Sums of characters by falling powers: two of them give the hash of what is between, modulo 2^32.
        self.powers = np.cumprod(np.append(np.uint32(1), np.full(max(len(code) - 1, 0), R, np.uint32)), dtype=np.uint32)
        falling = np.cumprod(np.append(np.uint32(1), np.full(max(len(code) - 1, 0), pow(R, -1, 1 << 32), np.uint32)), dtype=np.uint32)[: len(code)]
        self.sums = np.append(np.uint32(0), np.cumsum((code + np.uint32(1)) * np.uint32(0x85EBCA6B) * falling, dtype=np.uint32))
        self.laid: dict[tuple[int, int], list] = {}
        at = self.places(2)
        both = np.zeros((len(texts), DOUBLES), bool)
        two = self.hash(2, at)
        both[self.text[at], ((two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)] = True
        self.doubles = np.ascontiguousarray(np.packbits(both, axis=None).view(np.uint64).reshape(len(texts), -1).T)

    def hash(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the size characters from each place on, or from these; beyond the end of all of them it means nothing."""
        if at is not None:
            return (self.sums[at + size] - self.sums[at]) * self.powers[at] * _power(size - 1)
        out = np.zeros(len(self.text), np.uint32)
        if size <= len(out):
            upto = len(out) + 1 - size
            out[:upto] = (self.sums[size:] - self.sums[:upto]) * self.powers[:upto] * _power(size - 1)
        return out

    def places(self, size: int) -> np.ndarray:
        """Where so many characters of one text begin."""
        return np.flatnonzero(self.place <= (self.n - size).astype(np.int32)[self.text]).astype(np.int32)


def common(l, k, t: float):
    return np.ceil(t * (l + k) / 2 - 1e-9).astype(np.int64)


def _fit(left: Tile, right: Tile, i: np.ndarray, j: np.ndarray, t: float, same: bool) -> np.ndarray:
    """Which pairs can reach the threshold, by lengths, counts of characters and characters that stand together.

    Two neighbours are neighbours in the other text unless one of them is left out or one that is left over stands between.
    """
    l, k = left.n[i], right.n[j]
    m = common(l, k, t)
    both = sum(np.bitwise_count(a[i] & b[j]).astype(np.int64) for a, b in zip(left.bits, right.bits, strict=True))
    ok = (m <= k) & (2 * k >= l) & (both + np.minimum(left.more[i], right.more[j]) >= m)
    if same:
        ok &= j < i
    at = np.flatnonzero(ok)
    i, j, out, over = i[at], j[at], (l - m)[at], (k - m)[at]
    a, b = [x[i] for x in left.doubles], [x[j] for x in right.doubles]
    ok[at] = sum(np.bitwise_count(x & ~y).astype(np.int64) for x, y in zip(a, b, strict=True)) <= 2 * out + over
    ok[at] &= sum(np.bitwise_count(y & ~x).astype(np.int64) for x, y in zip(a, b, strict=True)) <= 2 * over + out
    return ok


def _bounds(left: Tile, right: Tile, t: float) -> dict[int, tuple[int, int, int, int]]:
    """By length of the longer text, over all lengths it may meet: D + 1, M at least, l - M and k - M at most."""
    out = {}
    ks = np.unique(right.n)
    for l in np.unique(left.n).tolist():
        k = ks[(ks <= l) & (2 * ks >= l)]
        m = common(l, k, t)
        k, m = k[m <= k], m[m <= k]
        if len(k):
            out[l] = int((l + k - 2 * m).max()) + 1, int(m.min()), int((l - m).max()), int((k - m).max())
    return out


def _sizes(n: int, units: int) -> tuple[int, int, int]:
    """How many pieces may hold one change, how many (0 or 1) none; characters of the former, or 0 if they tell nothing."""
    several, exact = divmod(units, 2)
    size = min((n + 2 * exact) // (several + exact) if several else n, LONGEST)
    if exact and several and size <= SHORTEST:
        size = min((n - SHORTEST + 1) // several, SHORTEST)
    return several, exact, size if size >= SHORTEST else 0


def _layout(left: Tile, own: np.ndarray, n: int, units: int, busy) -> list[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(texts, starts, size, whether it may hold a change) of the pieces of each text of n characters, where they are least busy.

    Sizes are those that are best for all of them, so that few kinds of pieces are looked for.
    """
    several, exact, size = _sizes(n, units)
    first, best = left.first[own], None
    lasts = (sorted({max(size - 2, SHORTEST - 1), max(size - 1, SHORTEST - 1)}) if several else [size]) if exact else [0]
    for z in sorted({size, max(size - 1, SHORTEST)}) if several else [0]:
        for last in lasts:
            slack = n - several * z - last
            if slack < 0:
                continue
            starts = sorted({round(x) for x in np.linspace(0, slack, min(slack + 1, LAYOUTS))})
            cost = np.zeros((len(starts), len(own)), np.float32)
            for o, s in enumerate(starts):
                for x in range(several):
                    at = first + (s + x * z)
                    cost[o] += (busy(z - 1)[at] + busy(z - 1)[at + 1]) * (z / 2)
                if exact:
                    cost[o] += busy(last)[first + (s + several * z)]
            total = cost.min(axis=0).sum(dtype=np.float64)
            if best is None or total < best[0]:
                best = total, np.array(starts, np.int32)[cost.argmin(axis=0)], [(x * z, z, True) for x in range(several)] + [(several * z, last, False)] * exact
    return [(own, best[1] + np.int32(at), z, change) for at, z, change in best[2]]


def _busy(left: Tile, right: Tile):
    """Function of a size: about how often the other tile has so many characters as begin at each place, by hashes of 20 bits."""
    found: dict[int, np.ndarray] = {}

    def of(size: int) -> np.ndarray:
        if size not in found:
            shift = np.uint32(12)
            found[size] = np.bincount(right.hash(size)[right.places(size)] >> shift, minlength=1 << 20).astype(np.float32)[left.hash(size) >> shift]
        return found[size]

    return of


class _Index:
    """Places of a tile by key and place in the text."""

    def __init__(self, tile: Tile, keys: np.ndarray, places: np.ndarray):
        self.shift = max(0, int(tile.n.max()).bit_length() - PLACE)
        self.tile, self.size = tile, len(places)
        self.parts = [self._part(keys[x : x + (1 << ROW)], places[x : x + (1 << ROW)]) for x in range(0, len(places), 1 << ROW)]

    def _part(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = keys.astype(np.uint64)
        b <<= np.uint64(PLACE)
        b |= (self.tile.place[places] >> self.shift).view(np.uint32)
        b <<= np.uint64(ROW)
        b |= np.arange(len(b), dtype=np.uint32)
        b.sort()
        text = b.astype(np.uint32)  # the row's bits are all in there
        text &= np.uint32((1 << ROW) - 1)
        text = self.tile.text[places[text]]
        b >>= np.uint64(ROW)
        return b, text

    def meet(self, keys: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Texts of `of` and of the tile with equal keys, the latter's from place lo to place hi on, some at once."""
        mask, top = np.uint64((1 << ROW) - 1), (1 << PLACE) - 1
        for x in range(0, len(keys), KEYS):
            k, own, u, v = keys[x : x + KEYS], of[x : x + KEYS], lo[x : x + KEYS], hi[x : x + KEYS]
            u = np.clip(u >> self.shift, 0, top).astype(np.uint64)
            width = np.clip(v >> self.shift, 0, top).astype(np.uint64) - u
            a = np.sort((((k.astype(np.uint64) << np.uint64(PLACE)) | u) << np.uint64(ROW)) | np.arange(len(k), dtype=np.uint64))
            row = (a & mask).astype(np.int32)
            a >>= np.uint64(ROW)
            for b, text in self.parts:
                first = np.searchsorted(b, a)
                some = np.flatnonzero(b[np.minimum(first, len(b) - 1)] - a <= width[row])
                first, row_, end = first[some], row[some], a[some] + width[row[some]]
                size = np.searchsorted(b, end, "right") - first
                size = np.maximum(size, 0)
                upto = np.cumsum(size)
                y = 0
                while y < len(some):
                    z = max(y + 1, int(np.searchsorted(upto, (upto[y - 1] if y else 0) + AT_ONCE, "right")))
                    part = size[y:z]
                    total = int(part.sum())
                    if total:
                        at = np.arange(total) + np.repeat(first[y:z] - (upto[y:z] - part - (upto[y - 1] if y else 0)), part)
                        yield np.repeat(own[row_[y:z]], part), text[at]
                    y = z


def _by_pieces(left: Tile, right: Tile, pieces: list, bounds: dict, t: float, same: bool):
    """Pairs that meet by a piece, each length's bounds given; some more than once."""
    floor, far, on = (np.zeros(len(left.n), np.int32) for _ in range(3))
    for n, (_, m, out, over) in bounds.items():
        own = slice(*np.searchsorted(left.n, [n, n + 1]))
        floor[own], far[own], on[own] = m - left.more[own], out, over
    # By what the shorter text must have: so many characters in a row, or a piece with one more inside.
    whole: dict[int, list] = {}
    wider: dict[int, list] = {}
    for own, at, size, change in pieces:
        whole.setdefault(size - 1 if change else size, []).append((own, at, size))
        if change:
            wider.setdefault(size, []).append((own, at))

    def look(index, keys, own, at):
        for i, j in index.meet(keys, own, at - far[own], at + on[own]):
            near = np.bitwise_count(left.bits[0][i] & right.bits[0][j])
            for a, b in zip(left.bits[1:], right.bits[1:], strict=True):
                near += np.bitwise_count(a[i] & b[j])
            near = np.flatnonzero(near >= floor[i])
            i, j = i[near].astype(np.int64), j[near].astype(np.int64)
            ok = _fit(left, right, i, j, t, same)
            yield i[ok], j[ok]

    for z, parts in whole.items():
        p = right.places(z)
        near = (right.place[p] >= min(at.min() for _, at, _ in parts) - far.max()) & (right.place[p] <= max(at.max() for _, at, _ in parts) + 1 + on.max())
        p = p[near]
        index = _Index(right, right.hash(z, p), p)
        for own, at, size in parts if len(p) else []:
            start = left.first[own] + at
            if size == z:
                yield from look(index, left.hash(z, start), own, at)
                continue
            # Without its first character a piece begins one further along.
            keys = [left.hash(gone, start) * _power(z - gone) + left.hash(z - gone, start + gone + 1) if 0 < gone < z else left.hash(z, start + (gone == 0)) for gone in range(size)]
            yield from look(index, np.concatenate(keys), np.tile(own, size), np.concatenate([at + np.int32(1), *[at] * z]))
        del index
    for size, parts in wider.items():
        own, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys = left.hash(size, left.first[own] + at)
        known = np.zeros(1 << 24, bool)
        known[keys >> np.uint32(8)] = True
        p = right.places(size + 1)
        for gap in range(2, size - 1) if len(p) else ():
            others = right.hash(gap)[: -gap - 1] * _power(size - gap)
            others += right.hash(size - gap)[gap + 1 :]
            some = p[known[others[p] >> np.uint32(8)]]
            if len(some):
                yield from look(_Index(right, others[some], some), keys, own, at)


def _by_counts(left: Tile, right: Tile, own: np.ndarray, t: float, same: bool):
    """All texts of the lengths that each one may meet."""
    lo = np.searchsorted(right.n, np.maximum(left.n[own] / 2, left.n[own] * (t / (2 - t)) - 1e-9))
    for x, start in zip(own, lo, strict=True):
        for y in range(start, x if same else len(right.n), AT_ONCE):
            j = np.arange(y, min(y + AT_ONCE, x if same else len(right.n)))
            i = np.full(len(j), x, np.int64)
            ok = _fit(left, right, i, j, t, same)
            yield i[ok], j[ok]


def near_pairs(longer: list[str] | Tile, shorter: list[str] | Tile, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists, each in order of length, of all pairs that can reach the threshold, and of others.

    No text of the second list is longer than one of the first; same: they are one list. A tile that meets several others
    keeps the pieces that were laid for the first of them.
    """
    left = longer if isinstance(longer, Tile) else Tile(longer)
    right = left if same else shorter if isinstance(shorter, Tile) else Tile(shorter)
    bounds, busy = _bounds(left, right, t), _busy(left, right)
    pieces: list = []
    counted: list = []
    for n, (units, *_) in bounds.items():
        own = np.arange(*np.searchsorted(left.n, [n, n + 1]), dtype=np.int32)
        if _sizes(n, units)[2]:
            if (n, units) not in left.laid:
                left.laid[n, units] = _layout(left, own, n, units, busy)
            pieces += left.laid[n, units]
        else:
            counted.append(own)
    del busy
    found = [np.zeros(0, np.int64)]
    parts = [_by_pieces(left, right, pieces, bounds, t, same)] if pieces else []
    for part in [*parts, *(_by_counts(left, right, own, t, same) for own in counted)]:
        found += [i * len(right.n) + j for i, j in part if len(i)]
    both = np.unique(np.concatenate(found))
    return both // len(right.n), both % len(right.n)
