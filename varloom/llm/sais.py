"""Suffix arrays by induced sorting, in numpy.

The scans of induced sorting are sequential: an entry may be read only after everything that is written
before it. Here a scan takes the longest stretch of entries none of whose writes can land inside the
stretch, and induces the whole stretch at once; a stretch is about as long as the smallest distance to
the next bucket head, so a scan of n entries takes few steps at any alphabet size.
"""

from __future__ import annotations

import numpy as np

from .common import eight_bytes


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S-type flags, leftmost S positions) of a text that ends with its unique smallest symbol."""
    n = len(t)
    s = np.ones(n, bool)
    step = np.flatnonzero(t[1:] != t[:-1])  # where a symbol differs from the next one
    up = t[step] < t[step + 1]
    s[: n - 1] = np.repeat(up, np.diff(step, prepend=-1))
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _heads(got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted symbols change, and how many there are of each."""
    new = np.empty(len(got), bool)
    new[0] = True
    np.not_equal(got[1:], got[:-1], out=new[1:])
    head = new.nonzero()[0]
    size = np.empty(len(head), np.int64)
    np.subtract(head[1:], head[:-1], out=size[:-1])
    size[-1] = len(got) - head[-1]
    return head, size


def _induce(t: np.ndarray, short: np.ndarray, s: np.ndarray, marked: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Array of all suffixes from the marked (leftmost S) ones in the given order.

    short is t in the smallest type, which sorts faster."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    every = np.arange(max(len(marked), 1 << 18) + 1)
    order = short[marked].argsort(kind="stable")
    head, size = _heads(short[marked][order])
    sym = short[marked][order][head].astype(np.int64)
    sa[np.repeat(ends[sym] - size - head, size) + every[: len(marked)]] = marked[order]
    starts = np.append(0, np.flatnonzero(t[1:] != t[:-1]) + 1)  # of runs of one symbol
    run_start = lambda x: starts[np.searchsorted(starts, x, side="right") - 1]
    flag = np.zeros(n + 2, bool)  # the last two stand for "no suffix before" (-1) and "no entry" (-2)
    flag[:n] = ~s
    # L-type suffixes, left to right
    free, at, window = (ends - counts).copy(), 0, 4096
    while at < n:
        stop = min(at + window, n)
        j = sa[at:stop] - 1
        live = flag[j].nonzero()[0]
        if not len(live):
            at, window = stop, min(window * 2, 1 << 18)
            continue
        j = j[live]
        reach = np.minimum.accumulate(free[t[j]])
        bad = live[1:] + at >= reach[:-1]  # an entry that earlier ones may still write, or shift
        take = int(bad.argmax()) + 1 if len(bad) else 1
        if not len(bad) or not bad[take - 1]:
            take = len(live)
        limit = int(live[take]) + at if take < len(live) else stop
        done = max(at + int(live[take - 1]) + 1, min(limit, int(reach[take - 1])))
        if take == 1:
            c, x = t[j[0]], int(j[0])
            slot = int(free[c])
            run = 1
            if slot == done:  # the next entry is this one: the symbol's run follows entry by entry
                run = x - int(run_start(x)) + 1
                done = slot + run - 1
            sa[slot : slot + run] = np.arange(x, x - run, -1)
            free[c] += run
        else:
            sym = short[j[:take]]
            order = sym.argsort(kind="stable")
            got = sym[order]
            head, size = _heads(got)
            which = got[head]
            sa[np.repeat(free[which] - head, size) + every[:take]] = j[:take][order]
            free[which] += size
        window = min(max(2 * (done - at), 256), 1 << 18)
        at = done
    # S-type suffixes, right to left; they overwrite the marked ones
    flag[:n] = s
    free, at, window = ends.copy(), n, 4096
    while at > 0:
        stop = max(at - window, 0)
        j = sa[stop:at][::-1] - 1
        live = flag[j].nonzero()[0]
        if not len(live):
            at, window = stop, min(window * 2, 1 << 18)
            continue
        j = j[live]
        reach = np.maximum.accumulate(free[t[j]]) - 1
        bad = at - 1 - live[1:] <= reach[:-1]
        take = int(bad.argmax()) + 1 if len(bad) else 1
        if not len(bad) or not bad[take - 1]:
            take = len(live)
        limit = at - int(live[take]) if take < len(live) else stop
        done = min(at - int(live[take - 1]) - 1, max(limit, int(reach[take - 1]) + 1))
        if take == 1:
            c, x = t[j[0]], int(j[0])
            free[c] -= 1
            slot = int(free[c])
            run = 1
            if slot == done - 1:
                run = x - int(run_start(x)) + 1
                done = slot - run + 2
            sa[slot - run + 1 : slot + 1] = np.arange(x - run + 1, x + 1)
            free[c] -= run - 1
        else:
            sym = short[j[:take]]
            order = sym.argsort(kind="stable")
            got = sym[order]
            head, size = _heads(got)
            which = got[head]
            sa[np.repeat(free[which] - 1 + head, size) - every[:take]] = j[:take][order]
            free[which] -= size
        window = min(max(2 * (at - done), 256), 1 << 18)
        at = done
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings, in text order, equal ones alike; and the number of names."""
    n = len(t)
    stop = np.zeros(n, np.int32)
    stop[lms[:-1]] = lms[1:]
    stop[lms[-1]] = lms[-1]
    size = stop[ordered] - ordered
    a, b = ordered[:-1], ordered[1:]
    same = size[:-1] == size[1:]
    same[size[1:] == 0] = False
    pairs, depth = np.flatnonzero(same), 0
    while len(pairs):
        equal = t[a[pairs] + depth] == t[b[pairs] + depth]
        same[pairs[~equal]] = False
        pairs = pairs[equal & (size[1:][pairs] > depth)]
        depth += 1
    name = np.zeros(len(ordered), np.int32)
    np.cumsum(~same, out=name[1:])
    by_place = np.zeros(n, np.int32)
    by_place[ordered] = name
    return by_place[lms], int(name[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of t in order; t ends with its unique smallest symbol, 0."""
    t = np.ascontiguousarray(t, np.int32)
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    s, lms = classify(t)
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    short = t.astype(np.uint16) if len(counts) < 1 << 16 else t
    lms = lms.astype(np.int32)
    sa = _induce(t, short, s, lms, ends, counts)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    names, distinct = _names(t, lms, ordered)
    if distinct < len(lms):
        ordered = lms[suffix_array(names)]
    return _induce(t, short, s, ordered, ends, counts)


def common_prefixes(t: np.ndarray, sa: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each text position in text order, how many bytes of raw its suffix and the one
    before it in the array (its `phi`) have in common; 0 for the first of the array.

    Where a suffix and its phi follow the same symbol, the value is the last position's less one. Only the others are
    compared, eight bytes at a time, all at once; their values sum to n log n at most.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = phi < 1
    own[0] = True
    rest = np.flatnonzero(~own)
    own[rest] = t[rest - 1] != t[phi[rest] - 1]
    word = np.append(eight_bytes(raw), np.zeros(8, np.uint64))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(own & (phi >= 0))
    depth = 0
    while len(live):
        x = word[live + depth] ^ word[phi[live] + depth]
        low = x & (~x + np.uint64(1))
        out[live] = depth + np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        depth += 8
        live = live[x == 0]
        live = live[np.maximum(live, phi[live]) + depth < n]
    place = np.arange(n)
    out = np.where(own, np.minimum(out, n - np.maximum(place, phi)), 0)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return out[last] - (place - last)
