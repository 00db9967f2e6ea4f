"""A packed quotient filter: build from sorted fingerprints, probe, decode by blocks, merge, serialise.

A fingerprint of ``p`` bits splits into a quotient (its high ``q`` bits) and a remainder of ``r = p - q`` bits. A slot
array keeps the remainders of one quotient as a sorted run, as near to the quotient's own slot as earlier runs allow.
Three bits a slot tell runs apart: *occupied* (the quotient of this index has a run), *continuation* (not the first of
its run) and *shifted* (not in its own slot). The quotients are thus never stored, and the sorted fingerprints can be
read back, so filters merge by merging their sorted contents.

In memory as in bytes a slot takes ceil(r / 8) bytes and three bits. A small table has the slot of the first run of every BLOCK
quotients, so that probing and merging decode only blocks: beside the filter no more than some thousands of fingerprints are
ever held. A ``Cascade`` is a list of filters of falling size that takes in keys day by day; filters of about equal size
merge, so that every key is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Filters are built whole from sorted keys, never inserted into, so slots may be nearly all in use.
LOAD = 0.95
#: Quotients that are decoded together.
BLOCK = 1 << 12


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    values = np.sort(values, kind="stable")
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at ascending places of a packed map."""
    if len(at):
        lo = int(at[0]) & ~7
        part = np.zeros((int(at[-1]) >> 3) + 1 - (lo >> 3) << 3, bool)
        part[at - lo] = True
        packed = np.packbits(part, bitorder="little")
        bits[lo >> 3 : (lo >> 3) + len(packed)] |= packed


def _get_bits(bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)


class Builder:
    """Takes sorted different fingerprints in any number of parts; ``n`` is how many there will be at most."""

    def __init__(self, p: int, n: int):
        self.p, self.n = p, 0
        self.q = min(p - 1, max(4, int(np.ceil(np.log2(max(1, n) / LOAD)))))
        self.r = p - self.q
        self.width = -(-self.r // 8)
        self.room = (1 << self.q) + BLOCK
        self.rem = np.zeros((self.room, self.width), np.uint8)
        self.maps = [np.zeros(-(-self.room // 8), np.uint8) for _ in range(3)]
        self.first = np.full((1 << self.q) // BLOCK + 2, -1, np.int64)
        self.last, self.slot = -1, -1

    def append(self, fingerprints: np.ndarray) -> None:
        m = len(fingerprints)
        if not m:
            return
        quotient = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        order = np.arange(m, dtype=np.int64)
        at = order + np.maximum.accumulate(np.maximum(quotient - order, self.slot + 1))
        if at[-1] >= self.room:  # the last runs lie beyond the last quotient's slot
            more = int(at[-1]) + BLOCK - self.room
            self.rem = np.concatenate([self.rem, np.zeros((more, self.width), np.uint8)])
            self.room += more
            self.maps = [np.concatenate([b, np.zeros(-(-self.room // 8) - len(b), np.uint8)]) for b in self.maps]
        low = fingerprints & np.uint64((1 << self.r) - 1)
        self.rem[at] = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        again = quotient == np.append(self.last, quotient[:-1])
        starts = quotient[~again]
        _set_bits(self.maps[0], starts)
        _set_bits(self.maps[1], at[again])
        _set_bits(self.maps[2], at[at != quotient])
        block, begin = np.unique(starts // BLOCK, return_index=True)
        new = self.first[block] < 0
        self.first[block[new]] = at[~again][begin[new]]
        self.last, self.slot, self.n = int(quotient[-1]), int(at[-1]), self.n + m

    def finish(self) -> QuotientFilter:
        slots = max(1 << self.q, self.slot + 1)
        first = self.first
        first[-1] = self.slot + 1
        for i in range(len(first) - 2, -1, -1):
            if first[i] < 0:
                first[i] = first[i + 1]
        return QuotientFilter(self.p, self.q, self.n, self.rem[:slots], *(b[: -(-slots // 8)] for b in self.maps), first)


class QuotientFilter:
    """``rem``: bytes of the remainders; ``occupied``, ``continuation``, ``shifted``: packed bits; ``first``: the slot where the
    runs of each block of quotients begin."""

    def __init__(self, p: int, q: int, n: int, rem: np.ndarray, occupied: np.ndarray, continuation: np.ndarray, shifted: np.ndarray, first: np.ndarray):
        self.p, self.q, self.n, self.rem, self.first = p, q, n, rem, first
        self.occupied, self.continuation, self.shifted = occupied, continuation, shifted

    @property
    def r(self) -> int:
        return self.p - self.q

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.rem, self.occupied, self.continuation, self.shifted, self.first))

    @classmethod
    def build(cls, fingerprints: np.ndarray, p: int) -> QuotientFilter:
        """From sorted distinct fingerprints below 2**p. The array has 2**q slots and an overflow area, no wrap."""
        b = Builder(p, len(fingerprints))
        for i in range(0, len(fingerprints), 1 << 16):
            b.append(fingerprints[i : i + (1 << 16)])
        return b.finish()

    def block(self, i: int, j: int) -> np.ndarray:
        """The sorted fingerprints of the blocks i to j - 1."""
        lo, hi = int(self.first[i]), int(self.first[j])
        if lo >= hi:
            return np.zeros(0, np.uint64)
        quotients = i * BLOCK + np.flatnonzero(_get_bits(self.occupied, i * BLOCK, min(j * BLOCK, 1 << self.q)))
        again = _get_bits(self.continuation, lo, hi)
        own = _get_bits(self.occupied, lo, min(hi, 1 << self.q))
        used = again | _get_bits(self.shifted, lo, hi)
        used[: len(own)] |= own
        slots = np.flatnonzero(used)
        run = np.cumsum(~again[slots]) - 1
        low = np.zeros((len(slots), 8), np.uint8)
        low[:, : self.rem.shape[1]] = self.rem[lo + slots]
        return (quotients[run].astype(np.uint64) << np.uint64(self.r)) | low.view("<u8").reshape(-1)

    def parts(self, blocks: int = 16) -> Iterator[np.ndarray]:
        """The sorted content in pieces of some blocks."""
        last = len(self.first) - 1
        for i in range(0, last, blocks):
            yield self.block(i, min(last, i + blocks))

    def fingerprints(self) -> np.ndarray:
        """The sorted content."""
        return np.concatenate([*self.parts(), np.zeros(0, np.uint64)])

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        """For each of the sorted fingerprints, whether an equal one is stored; only the blocks that are asked for are decoded."""
        hit = np.zeros(len(fingerprints), bool)
        if not self.n or not len(fingerprints):
            return hit
        block = (fingerprints >> np.uint64(self.r)).astype(np.int64) // BLOCK
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(block)]):
            own = self.block(int(block[a]), int(block[a]) + 1)
            if len(own):
                at = np.searchsorted(own, fingerprints[a:b])
                hit[a:b] = own[np.minimum(at, len(own) - 1)] == fingerprints[a:b]
        return hit

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """A filter of both contents, merged as two sorted streams of blocks; the quotient grows with the number of keys."""
        if self.p != other.p:
            raise ValueError("filters of different fingerprint lengths don't merge")
        b = Builder(self.p, self.n + other.n)
        streams = [self.parts(), other.parts()]
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        open_ = [True, True]
        while any(open_):
            for i in (0, 1):
                while open_[i] and not len(held[i]):
                    part = next(streams[i], None)
                    open_[i], held[i] = part is not None, held[i] if part is None else part
            ends = [h[-1] for h, o in zip(held, open_) if o]
            if not ends:
                break
            upto = min(ends)
            take = []
            for i in (0, 1):
                cut = int(np.searchsorted(held[i], upto, side="right"))
                take.append(held[i][:cut])
                held[i] = held[i][cut:]
            b.append(distinct(np.concatenate(take)))
        return b.finish()

    def to_bytes(self) -> bytes:
        """Header of five 8-byte numbers, three bit maps, the blocks' first slots, and the remainders."""
        head = np.array([self.p, self.q, self.n, len(self.rem), len(self.first)], "<u8").tobytes()
        bits = b"".join(b.tobytes() for b in (self.occupied, self.continuation, self.shifted))
        return head + bits + self.first.astype("<i8").tobytes() + self.rem.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        p, q, n, slots, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        step, at, maps = -(-slots // 8), 40, []
        for _ in range(3):
            maps.append(np.frombuffer(raw, np.uint8, step, at))
            at += step
        first = np.frombuffer(raw, "<i8", blocks, at)
        width = -(-(p - q) // 8)
        return cls(p, q, n, np.frombuffer(raw, np.uint8, slots * width, at + 8 * blocks).reshape(slots, width), *maps, first)


#: New keys of small days that wait, sorted, until they are enough for a filter.
WAIT = 1024


class Cascade:
    """Filters of falling size, up to WAIT keys of small days, and the sorted new keys of the day, which count from the next on."""

    def __init__(self, p: int):
        self.p, self.filters, self.waiting, self.new, self.n_new = p, [], np.zeros(0, np.uint64), [], 0

    @property
    def n(self) -> int:
        return sum(f.n for f in self.filters) + len(self.waiting) + self.n_new

    @property
    def nbytes(self) -> int:
        return sum(f.nbytes for f in self.filters) + 8 * (len(self.waiting) + self.n_new)

    def absorb(self, f: QuotientFilter) -> None:
        self.filters.append(f)
        while len(self.filters) > 1 and self.filters[-2].n <= 2 * self.filters[-1].n:
            b, a = self.filters.pop(), self.filters.pop()
            self.filters.append(a.merge(b))

    def fresh(self, fingerprints: np.ndarray) -> np.ndarray:
        """Which of the sorted different fingerprints no earlier day has; these are taken in, to be asked for from the next day on."""
        new = np.ones(len(fingerprints), bool)
        for f in self.filters:
            new &= ~f.contains(fingerprints)
        if len(self.waiting):
            at = np.searchsorted(self.waiting, fingerprints)
            new &= self.waiting[np.minimum(at, len(self.waiting) - 1)] != fingerprints
        self.new.append(fingerprints[new])
        self.n_new += int(new.sum())
        return new

    def close_day(self) -> None:
        """The day's new keys, which came sorted and different in parts, become a filter once there are WAIT of them."""
        if len(self.waiting) + self.n_new >= WAIT:
            b = Builder(self.p, len(self.waiting) + self.n_new)
            if len(self.waiting):
                b.append(np.sort(np.concatenate([self.waiting, *self.new])))
                self.waiting = self.waiting[:0]
            else:
                for part in self.new:
                    b.append(part)
            self.absorb(b.finish())
        elif self.n_new:
            self.waiting = np.sort(np.concatenate([self.waiting, *self.new]))
        self.new, self.n_new = [], 0


def expected_wrong(new_keys: int, known: int, p: int) -> float:
    """Expected number of new keys taken for old ones when ``new_keys`` arrive one by one after ``known`` keys.

    The j-th new key meets known + j stored fingerprints and equals one of them by chance with probability
    (known + j) / 2**p, to first order.
    """
    return (known * new_keys + new_keys * (new_keys - 1) / 2) / 2.0**p
