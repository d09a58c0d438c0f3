"""Two-stage suffix sorting of a block of text, and the common prefixes of neighbours.

Suffixes smaller than their successor are sorted directly; the others follow from them in one scan over the
buckets of first bytes: when a suffix is met in order and the one before it in the text is larger than it,
that one is the next of its bucket. Order is exact in the first `depth` bytes, which is all that is asked.
"""

from __future__ import annotations

import numpy as np

STEP = 5  # bytes per round of the direct sort, beside 24 bits of group number


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest."""
    view = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    return view[at].astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a byte later; the empty suffix is the smallest."""
    n = len(text)
    step = np.empty(n, dtype=np.int16)
    step[:-1] = text[1:].astype(np.int16) - text[:-1]
    step[-1] = -1
    decisive = np.where(step != 0, np.arange(n), n - 1)
    decisive = np.minimum.accumulate(decisive[::-1])[::-1]
    return step[decisive] > 0


def sort_directly(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places ordered by the depth bytes from each on: by eight bytes, then ties by STEP more in each round."""
    key = words_at(padded, places)
    order = np.argsort(key)
    places, key = places[order], key[order]
    tied_with_last = np.zeros(len(places) + 1, dtype=bool)
    tied_with_last[1:-1] = key[1:] == key[:-1]
    tied = np.flatnonzero(tied_with_last[:-1] | tied_with_last[1:])
    fresh = ~tied_with_last[tied]
    for done in range(8, depth, STEP):
        if not len(tied):
            break
        # Groups are numbered in runs of fewer than 2^24, each sorted at once.
        group = fresh.cumsum() - 1
        for low in range(0, int(group[-1]) + 1, 1 << 24):
            part = slice(*np.searchsorted(group, [low, low + (1 << 24)]))
            own = places[tied[part]]
            key = (group[part] - low).astype(np.uint64) << np.uint64(40) | words_at(padded, own + done) >> np.uint64(24)
            order = np.argsort(key)
            places[tied[part]] = own[order]
            key = key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            fresh[part] = new
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        tied, fresh = tied[~alone], fresh[~alone]
    return places


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of text (bytes) in order of their first depth bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    small = smaller_than_next(text)
    direct = sort_directly(padded, np.flatnonzero(small), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # before the empty suffix
    out = []

    def induce(places: np.ndarray, now: int) -> np.ndarray:
        """Hands on the larger suffixes before places; returns those of the bucket now."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        same = before[:0]
        edges = np.flatnonzero(np.diff(head.astype(np.int16), prepend=-1, append=-1)).tolist()
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if head[begin] == now:
                same = before[begin:end]
            else:
                waiting[head[begin]].append(before[begin:end])
        return same

    for now in range(256):
        larger = np.concatenate(waiting[now]) if waiting[now] else np.zeros(0, dtype=np.int64)
        waiting[now] = []
        while len(larger):
            out.append(larger)
            larger = induce(larger, now)
        own = direct[bounds[now] : bounds[now + 1]]
        if len(own):
            out.append(own)
            induce(own, now)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes each suffix of order shares with the one before it, up to limit; 0 for the first."""
    padded = np.concatenate([text, np.zeros(limit + 16, dtype=np.uint8)])
    out = np.zeros(len(order), dtype=np.int64)
    at = np.arange(1, len(order))
    for done in range(0, limit, 8):
        if not len(at):
            break
        differ = words_at(padded, order[at] + done) ^ words_at(padded, order[at - 1] + done)
        same = differ == 0
        out[at[same]] = done + 8
        ends, bits = at[~same], differ[~same]
        shared = np.zeros(len(ends), dtype=np.int64)
        for k in range(1, 8):
            shared += bits >> np.uint64(64 - 8 * k) == 0
        out[ends] = done + shared
        at = at[same]
    return np.minimum(out, limit)


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from each place on also stand further left, both places being allowed starts.

    starts: one boolean per byte; an allowed start has length bytes of its own.
    """
    order = suffix_array(text, length)
    same = common_prefixes(text, order, length) >= length
    heads = np.flatnonzero(~same)
    first = np.minimum.reduceat(np.where(starts[order], order, len(text)), heads)
    sizes = np.diff(heads, append=len(order))
    out = np.zeros(len(text), dtype=bool)
    out[order] = order > np.repeat(first, sizes)
    return out & starts
