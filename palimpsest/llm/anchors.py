"""Content-defined anchors: in each window of a text, the smallest hash of its grams."""

from __future__ import annotations

import numpy as np

from .common import Rolling

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minima of all w values in a row, by running minima forwards and backwards in blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.concatenate([x, np.full(-len(x) % w, NONE)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def window_anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position, hash, first, last, done): anchors of the windows of `length` bytes inside one text.

    Each window belongs to the first of the smallest gram hashes in it, so that equal windows belong
    to equal grams at the same distance. first and last are the anchor's first and last windows. A
    window that equals the one of the anchor before it, in a text that repeats itself, is a repeated
    one; an anchor with only such windows is left out, and done holds these windows' starts.
    """
    w = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none, none
    r = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    h = r.of(at, at + gram) >> np.uint64(1)
    low = sliding_min(h, w)
    size = np.diff(bounds)
    inside = np.zeros(len(low) + 1, np.int64)
    for b, s in zip(bounds[:-1][size >= length], size[size >= length], strict=True):
        inside[b] += 1
        inside[b + s - length + 1] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none.astype(np.uint64), none, none, none
    # Runs of windows in a row with the same smallest hash.
    value = low[starts]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)])
    begin = starts[new]
    end = starts[np.concatenate([new[1:], [True]])]
    value = value[new]
    # Positions of the smallest hashes, by hash and position.
    rim = np.zeros(w - 1, np.uint64)
    reach = ~sliding_min(~np.concatenate([rim, np.where(inside, low, np.uint64(0)), rim]), w)
    spot = np.flatnonzero(h == reach)
    names, rank = np.unique(h[spot], return_inverse=True)
    by = np.lexsort((spot, rank))
    spot, place = spot[by], (rank[by].astype(np.int64) << 40) | spot[by]
    own = np.searchsorted(names, value).astype(np.int64) << 40
    lo = np.searchsorted(place, own | begin)
    hi = np.searchsorted(place, own | end)
    n = hi - lo + 1
    run = np.repeat(np.arange(len(begin)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[run]
    pos = spot[k]
    first = np.maximum(begin[run], np.where(np.arange(len(run)) == (np.cumsum(n) - n)[run], 0, spot[np.maximum(k - 1, 0)] + 1))
    last = np.minimum(end[run], pos)
    text = np.searchsorted(bounds, pos, side="right") - 1
    # Several runs may share an anchor.
    by = np.lexsort((first, pos))
    pos, first, last, text, value = pos[by], first[by], last[by], text[by], h[pos[by]]
    lead = np.concatenate([[True], pos[1:] != pos[:-1]])
    first, last = first[lead], np.maximum.reduceat(last, np.flatnonzero(lead))
    pos, text, value = pos[lead], text[lead], value[lead]
    # Texts that repeat themselves.
    again = np.concatenate([[False], (value[1:] == value[:-1]) & (text[1:] == text[:-1])])
    q = np.concatenate([[0], np.diff(pos)])
    done, gone = [], np.zeros(len(pos), bool)
    for i in np.flatnonzero(again):
        s = np.arange(first[i], last[i] + 1)
        s = s[s - q[i] >= bounds[text[i]]]
        same = r.of(s, s + length) == r.of(s - q[i], s - q[i] + length)
        if len(s) == last[i] - first[i] + 1 and same.all():
            gone[i] = True
            done += [s, s - q[i]]
    stay = ~gone
    done = np.unique(np.concatenate(done)) if done else none
    return text[stay], pos[stay], value[stay], first[stay], last[stay], done
