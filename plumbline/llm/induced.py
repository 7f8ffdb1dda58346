"""Suffixes and their common prefixes by external induced sorting.

Suffixes are sorted on their first `cap` symbols, and common prefixes counted up to `cap`, in four steps:

1. The text is read by blocks from its end for the starred suffixes (S-type after an L-type).
2. The substrings between them get names, the numbers of smaller ones: rows of a few packed symbols are sorted externally,
   equal ones again by the symbols that follow.
3. The starred suffixes are in the order of the string of their names. Where some are equal, that string is sorted by
   recursion, each name written as one or two digits, until its names fit into memory, where ties are broken by doubling. Where
   digits don't make it shorter, doubling by external sorting ends the recursion.
4. One pass over the symbols upward induces the L-types, one downward the S-types. A queue for each symbol holds
   (place, common prefix with the one before it) tuples; they are inserted in the order of their suffixes, so a queue of
   its symbol alone serves as the priority queue, and the oldest blocks of all queues lie on disk. The common prefix of two
   suffixes induced one after the other is one more than the least over what was scanned between them; minima over a range come from
   a table over each block, and the minimum since a symbol's last insertion is carried along.

Text, starred places, names, order and queues are arrays and blocks of spill.Disk: beyond its bound they are files. Text that
lies in a file is read through a mapping, at the places that a block of a queue names."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from plumbline.llm.spill import BLOCK, Disk, Sorter


def starred(x: np.ndarray, disk: Disk) -> np.ndarray:
    """Places of the starred suffixes, ascending."""
    n, found = len(x), []
    after, after_s = 0, False  # the first symbol of the block behind and whether it is S-type
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        t = np.asarray(x[a : a + BLOCK])
        more = a + len(t) < n
        ends = np.flatnonzero(t[1:] != t[:-1])
        s_last = more and (after > t[-1] or (after == t[-1] and after_s))
        up = np.append(t[ends + 1] > t[ends], s_last)
        s = np.repeat(up, np.diff(np.r_[-1, ends, len(t) - 1]))
        star = np.flatnonzero(s[1:] & ~s[:-1]) + 1 + a
        if more and after_s and not s[-1]:
            star = np.append(star, a + len(t))
        if len(star):
            disk.put(found, star)
        after, after_s = t[0], bool(s[0])
    out = disk.array(sum(b[0].size if isinstance(b[0], np.ndarray) else b[0][1] for b in found), np.int32 if n < 2**31 else np.int64)
    at = 0
    for block in reversed(found):
        (star,) = disk.get(block)
        out[at : at + len(star)] = star
        at += len(star)
    disk.drop(found)
    return out


def words(x: np.ndarray, at: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """The next symbols from `at` packed into 60 bits; the symbol at `end` is marked, what follows it is zero."""
    w, n = np.zeros(len(at), np.uint64), len(x)
    for i in range(60 // bits):
        p = at + i
        code = (np.asarray(x[np.minimum(p, n - 1)]).astype(np.uint64) << np.uint64(1)) + (p == end) + np.uint64(1)
        w = (w << np.uint64(bits)) | np.where((p <= end) & (p < n), code, np.uint64(0))
    return w


def renamed(rows: Sorter, rank: np.ndarray) -> bool:
    """Ranks of rows (rank, what follows, index) told apart by what follows; whether some are still equal."""
    seen, last, group, part, equal = 0, None, 0, 0, False
    for r, w, i in rows.blocks():
        new = np.append(last is None or r[0] != last[0], r[1:] != r[:-1])
        sub = new | np.append(last is None or w[0] != last[1], w[1:] != w[:-1])
        pos = seen + np.arange(len(r))
        first = np.maximum.accumulate(np.where(new, pos, group))
        inner = np.maximum.accumulate(np.where(sub, pos, part))
        rank[i] = r + inner - first
        equal = equal or not sub.all()
        seen, last, group, part = seen + len(r), (r[-1], w[-1]), int(first[-1]), int(inner[-1])
    return equal


def names(x: np.ndarray, star: np.ndarray, bits: int, cap: int, disk: Disk) -> np.ndarray:
    """For each starred substring the number of smaller ones, up to `cap` symbols; equal ones share it. A substring runs to the next
    starred place, whose mark makes it larger than a longer one that goes on with an L-type there."""
    m, n, step, each = len(star), len(x), 0, 60 // bits
    rank = disk.array(m, np.int64)
    while step < cap:
        rows = Sorter(disk)
        for a in range(0, m, BLOCK):
            s = star[a : a + BLOCK].astype(np.int64)
            e = np.asarray(star[a + 1 : a + BLOCK + 1]).astype(np.int64)
            if len(e) < len(s):
                e = np.append(e, n)  # the last one ends with the text
            at = np.flatnonzero(e - s >= step) if step else np.arange(len(s))
            rows.add(rank[a : a + BLOCK][at], words(x, s[at] + step, e[at], bits), at + a)
        if not rows or not renamed(rows, rank):
            break
        step += each
    return rank


def doubled(rank: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a string of names, in memory: tied ones are compared by the names that follow, twice as many in
    each round, until `most` names are compared."""
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    slots = np.arange(n)  # places in the order that may still be tied
    rank = rank.copy()
    while k < most and len(slots):
        r = rank[order[slots]]
        tied = np.append(False, r[1:] == r[:-1])
        tied[:-1] |= tied[1:]
        slots = slots[tied]
        who, r = order[slots], r[tied]
        after = np.where(who + k < n, rank[np.minimum(who + k, n - 1)], -1)
        o = np.lexsort((after, r))
        who, after = who[o], after[o]
        order[slots] = who
        new = np.append(True, r[1:] != r[:-1])[: len(r)]
        sub = new | np.append(True, after[1:] != after[:-1])[: len(r)]
        pos = np.arange(len(r))
        rank[who] = r + np.maximum.accumulate(np.where(sub, pos, 0)) - np.maximum.accumulate(np.where(new, pos, 0))
        k *= 2
    return order


def doubled_on_disk(rank: np.ndarray, most: int, disk: Disk) -> None:
    """Ranks of the suffixes of a string of names, told apart as by `doubled`, by external sorting."""
    n, k, equal = len(rank), 1, True
    while k < most and equal:
        rows = Sorter(disk)
        for a in range(0, n, BLOCK):
            r = np.array(rank[a : a + BLOCK])
            after = np.asarray(rank[a + k : a + k + len(r)]) + 1
            rows.add(r, np.append(after, np.zeros(len(r) - len(after), np.int64)), np.arange(a, a + len(r)))
        equal = renamed(rows, rank)
        k *= 2


def star_order(x: np.ndarray, star: np.ndarray, bits: int, cap: int, disk: Disk, above: int | None) -> np.ndarray:
    """Starred places in the order of their suffixes."""
    m, most = len(star), -(-cap // 2) + 1
    rank = names(x, star, bits, cap, disk)
    order = disk.array(m, star.dtype)
    if 48 * m <= disk.memory:
        order[:] = star[doubled(rank, most)]
    elif above and 8 * m > 7 * above:
        # the string of digits above has hardly fewer starred places than it had names: recursion wouldn't end soon
        doubled_on_disk(rank, most, disk)
        rows, at = Sorter(disk), 0
        for a in range(0, m, BLOCK):
            rows.add(rank[a : a + BLOCK], np.arange(a, min(a + BLOCK, m)))
        for _, i in rows.blocks():
            order[at : at + len(i)] = star[i]
            at += len(i)
    else:
        # a name is one digit where that is enough, else two of much the same range, so that few symbols are scanned
        wide = 1 if m < 65535 else 2
        base = m + 1 if wide == 1 else int(np.sqrt(m)) + 1
        digits = disk.array(wide * m + 1, np.uint16)
        for a in range(0, m, BLOCK):
            r = np.asarray(rank[a : a + BLOCK])
            for k in range(wide):
                digits[wide * a + k : wide * (a + len(r)) : wide] = r // base ** (wide - 1 - k) % base + 1
        at = m
        for p, _ in suffix_blocks(digits, min(wide * most, 254), symbols=base + 1, disk=disk, above=m):
            p = p[p % wide == 0] // wide
            p = p[p < m][::-1]
            order[at - len(p) : at] = star[p]
            at -= len(p)
        disk.free(digits)
    disk.free(rank)
    return order


def prefix_lengths(x: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to cap, of the suffixes at a and b."""
    out, n, wide = np.zeros(len(a), np.uint8), len(x), 8 // x.itemsize
    a, b, going = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
    # whole words while both have them, single symbols for the rest
    step, view = 0, np.ndarray((max(0, n - wide + 1),), "<u8", buffer=x, strides=(x.itemsize,)) if n >= wide else None
    while len(going) and view is not None and step < cap:
        p, q = a[going] + step, b[going] + step
        inside = np.maximum(p, q) + wide <= n
        if not inside.all():
            going, p, q = going[inside], p[inside], q[inside]
        diff = view[p] ^ view[q]
        same = diff == 0
        low = diff & (~diff + np.uint64(1))
        out[going] = np.minimum(step + np.where(same, wide, np.bitwise_count(low - np.uint64(1)) // (8 * x.itemsize)), cap)
        going, step = going[same], step + wide
    # the suffixes near the text's end
    last = np.flatnonzero((np.maximum(a, b) + out + wide > n) & (out < cap))
    while len(last):
        p, q = a[last] + out[last], b[last] + out[last]
        same = (np.maximum(p, q) < n) & (np.asarray(x[np.minimum(p, n - 1)]) == np.asarray(x[np.minimum(q, n - 1)]))
        last = last[same]
        out[last] += 1
        last = last[out[last] < cap]
    return out


class Carry:
    """For each symbol the least common prefix scanned since its last insertion."""

    def __init__(self, symbols: int, cap: int):
        self.least, self.cap = np.zeros(symbols, np.uint8), cap

    def over(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """lcp: of each scanned item with the one before; at: items that induce, grouped by symbol, ascending in a group.
        Returns the common prefixes of what they induce, each with its symbol's insertion before."""
        table = [lcp]
        while 2 * (half := 1 << (len(table) - 1)) <= len(lcp):
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        first = np.append(True, symbol[1:] != symbol[:-1]) if len(at) else np.zeros(0, bool)
        lo = np.where(first, 0, np.append(0, at[:-1] + 1)[: len(at)])
        out = self._range(table, lo, at)
        heads = np.flatnonzero(first)
        out[heads] = np.minimum(out[heads], self.least[symbol[heads]])
        self.least = np.minimum(self.least, lcp.min())
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        rest = at[tails] + 1
        inside = rest < len(lcp)
        left = np.full(len(tails), self.cap, np.uint8)
        left[inside] = self._range(table, rest[inside], np.full(inside.sum(), len(lcp) - 1))
        self.least[symbol[tails]] = left
        return np.minimum(out.astype(np.int16) + 1, self.cap).astype(np.uint8)

    @staticmethod
    def _range(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = table[0][hi]
        wide = np.flatnonzero(hi > lo)
        if len(wide):
            lo, hi = lo[wide], hi[wide]
            level = np.frexp((hi - lo + 1).astype(np.float32))[1] - 1
            got = np.empty(len(lo), np.uint8)
            for k in np.flatnonzero(np.bincount(level)):
                some = np.flatnonzero(level == k)
                got[some] = np.minimum(table[k][lo[some]], table[k][hi[some] - (1 << int(k)) + 1])
            out[wide] = got
        return out


def together(disk: Disk, blocks: list):
    """The blocks of a queue, joined to a few large ones."""
    held, size = [], 0
    for k, block in enumerate(blocks):
        held.append(disk.get(block))
        size += len(held[-1][0])
        if size >= BLOCK or k == len(blocks) - 1:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0


def suffix_blocks(x: np.ndarray, cap: int, *, symbols: int = 256, disk: Disk | None = None, above: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lcps) blocks of all suffixes from the largest down; lcp is with the suffix yielded before, 0 between symbols.
    x: uint8 or uint16 symbols below `symbols`; cap at most 254; above: how many names the digits in x stand for."""
    n = len(x)
    if not n:
        return
    disk = disk or Disk(256 << 20)
    kind = np.int32 if n < 2**31 else np.int64
    star = starred(x, disk)
    order = star_order(x, star, 10 if x.itemsize == 1 else 18, cap, disk, above)
    disk.free(star)
    count, begins = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    for a in range(0, n, BLOCK):
        count += np.bincount(x[a : a + BLOCK], minlength=symbols)
    for a in range(0, len(star), BLOCK):
        begins += np.bincount(x[star[a : a + BLOCK]], minlength=symbols)
    del star
    begins = np.append(0, np.cumsum(begins))
    low, high = [[] for _ in range(symbols)], [[] for _ in range(symbols)]

    def run(p: int) -> int:
        t = np.asarray(x[p : p + cap])
        return int(np.append(t != t[0], True).argmax())

    def induce(places, lcps, carry, queues, wanted):
        """Inserts what a scanned block induces: the suffixes one place before, where `wanted` says so of their symbol."""
        c = np.asarray(x[places - 1])  # place 0 wraps around and isn't wanted
        at = np.flatnonzero((places > 0) & wanted(c))
        c = c[at]
        o = np.argsort(c, kind="stable")
        at, c = at[o], c[o]
        got = carry.over(lcps, at, c)
        before = places[at] - kind(1)
        edge = [*np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist(), len(at)] if len(at) else []
        for a, b in itertools.pairwise(edge):
            disk.put(queues[c[a]], before[a:b].copy(), got[a:b].copy())

    present = np.flatnonzero(count).tolist()
    carry = Carry(symbols, cap)
    disk.put(low[int(x[n - 1])], np.array([n - 1], kind), np.zeros(1, np.uint8))
    for c in present:
        done, last = 0, None
        while done < len(low[c]):  # a round for each length of the symbol's runs
            upto = len(low[c])
            for p, l in together(disk, low[c][done:upto]):
                if last is None:
                    l[0] = 0
                induce(p, l, carry, low, lambda s: s >= c)
                last = p[-1]
            done = upto
        for a in range(int(begins[c]), int(begins[c + 1]), BLOCK):
            p = np.asarray(order[a : min(a + BLOCK, begins[c + 1])])
            l = np.empty(len(p), np.uint8)
            l[0] = prefix_lengths(x, order[a - 1 : a], p[:1], cap)[0] if a > begins[c] else 0 if last is None else min(run(last), run(p[0]))
            l[1:] = prefix_lengths(x, p[:-1], p[1:], cap)
            induce(p, l, carry, low, lambda s: s >= c)
    disk.free(order)
    del order
    carry = Carry(symbols, cap)
    for c in reversed(present):
        done, last = 0, None
        while done < len(high[c]):
            upto = len(high[c])
            for p, l in together(disk, high[c][done:upto]):
                if last is None:
                    l[0] = 0
                induce(p, l, carry, high, lambda s: s <= c)
                yield p, l
                last = p[-1]
            done = upto
        behind = None  # the common prefix of the block scanned before with its own first
        blocks = low[c]
        while blocks:
            first = len(blocks)
            size = 0
            while first and size < BLOCK:
                first -= 1
                size += len(blocks[first][0]) if isinstance(blocks[first][0], np.ndarray) else blocks[first][0][1]
            p, l = ([np.concatenate(k) for k in zip(*map(disk.get, blocks[first:]), strict=True)]) if len(blocks) - first > 1 else disk.get(blocks[first])
            seam = behind if behind is not None else 0 if last is None else min(run(last), run(p[-1]))
            back = np.append(np.uint8(seam), l[:0:-1])
            behind = l[0]
            p = p[::-1]
            induce(p, back, carry, high, lambda s: s < c)
            yield p, back
            tail = blocks[first:]
            del blocks[first:]
            disk.drop(tail)
        disk.drop(high[c])
