"""Suffix arrays by two-stage sorting, with adjacent common prefixes.

Stage one sorts directly only the suffixes that are smaller than their successors. Stage two induces the
others by scanning the buckets of first bytes from left to right (Itoh and Tanaka, 1999). Texts are a list
of segments; each ends in a separator of its own, smaller than any byte and ordered by position.
"""

from __future__ import annotations

import numpy as np


def suffix_array(segments: list[bytes], first: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the suffixes in order, the text (0: separator, 1 to 256: bytes), each place's end.

    Separator suffixes come first; an end is the place of the separator that closes the segment. With
    ``first``, only that many leading suffixes of each segment are wanted; the order then holds them and the
    few behind them from which the last ones are induced.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    n = int(lengths.sum()) + len(segments)
    text = np.zeros(n, np.int64)
    text[np.delete(np.arange(n), ends)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    stop = np.repeat(ends, lengths + 1)

    # a suffix is smaller than its successor if the first byte that differs from the next one is smaller:
    # runs of equal bytes take the type of their last place
    last = np.zeros(n, bool)
    change = np.ones(n, bool)
    change[:-1] = text[:-1] != text[1:]
    last[:-1] = text[:-1] < text[1:]
    run_end = np.flatnonzero(change)[np.searchsorted(np.flatnonzero(change), np.arange(n))]
    small = last[run_end]
    small[ends] = True

    kept = np.ones(n, bool)
    if first is not None:
        # up to the next directly sorted suffix, from which the others are induced
        starts, smalls = ends - lengths, np.flatnonzero(small)
        wanted = np.minimum(np.array(first, np.int64), lengths + 1)
        until = smalls[np.searchsorted(smalls, np.maximum(starts + wanted - 1, starts))]
        kept = np.arange(n) <= np.repeat(until, lengths + 1)

    raw = (text - 1).clip(0).astype(np.uint8).tobytes()
    stops = stop.tolist()
    direct = np.flatnonzero(small & (text > 0) & kept).tolist()
    direct.sort(key=lambda i: raw[i : stops[i]])  # stable: equal ones by position, as their separators

    counts = np.bincount(text[kept], minlength=257)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    order = np.full(int(counts.sum()), -1, np.int64)
    order[: counts[0]] = ends[kept[ends]]
    firsts = text[direct] if direct else np.zeros(0, np.int64)
    small_counts = np.bincount(firsts, minlength=257)
    # the directly sorted suffixes fill the ends of their buckets, the induced ones the fronts
    begin = tails - small_counts
    rank = np.arange(len(direct)) - (np.cumsum(small_counts) - small_counts)[firsts]
    order[begin[firsts] + rank] = direct

    order_list, kinds, symbols = order.tolist(), small.tolist(), text.tolist()
    for place in range(len(order_list)):
        before = order_list[place] - 1
        if before >= 0 and not kinds[before]:
            symbol = symbols[before]
            order_list[heads[symbol]] = before
            heads[symbol] += 1
    return np.array(order_list, np.int64), text, stop


def common_prefixes(order: np.ndarray, text: np.ndarray, stop: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix but the first in order, the prefix shared with the one before, up to ``limit``.

    Eight bytes are compared at a time; the end of a segment ends a prefix.
    """
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    raw = np.concatenate([(text - 1).clip(0).astype(np.uint8), np.zeros(limit + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    words = np.ascontiguousarray(words).view("<u8").reshape(-1)
    one, two = order[:-1], order[1:]
    room = np.minimum(np.minimum(stop[one] - one, stop[two] - two), limit)
    shared = np.zeros(len(one), np.int64)
    active = np.flatnonzero(room > 0)
    for k in range(0, limit, 8):
        differ = words[one[active] + k] ^ words[two[active] + k]
        same = differ == 0
        stuck, low = active[~same], differ[~same]
        lowest = low & (~low + np.uint64(1))
        shared[stuck] = k + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        active = active[same]
        shared[active] = k + 8
        active = active[room[active] > k + 8]
        if not len(active):
            break
    out[1:] = np.minimum(shared, room)
    return out


def repeated_starts(segments: list[bytes], length: int) -> np.ndarray:
    """Flags over the concatenated segments (each with one separator): a ``length``-byte string that
    starts here starts at another place, too.

    Only suffixes of ``length`` bytes or more are wanted: no shorter one can stand between two that share
    their first ``length`` bytes.
    """
    order, text, stop = suffix_array(segments, [max(0, len(s) - length + 1) for s in segments])
    order = order[stop[order] - order >= length]
    flags = np.zeros(len(text), bool)
    if len(order) > 1:
        same = common_prefixes(order, text, stop, length)[1:] >= length
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
    return flags
