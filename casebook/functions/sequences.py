"""Longest common subsequences of two sequences of hashable items: small helpers of the text scores and diffs.

Few differences are found by the greedy search over diagonals, whose work is length times differences. Otherwise a row of
the table is one long integer, a bit per item of the first sequence, so a step over an item of the second is a handful of
word-wide operations; rows are met from both ends to cut the problem in halves until all rows of a part can be kept.
"""

from __future__ import annotations

from itertools import compress

import numpy as np

FEW = 48  # differences up to which the search over diagonals is the cheaper one
KEPT_BITS = 1 << 25


def _masks(a: list) -> dict:
    masks: dict = {}
    if len(a) <= 1024:  # a shift costs less than an array
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        return masks
    for i, x in enumerate(a):
        masks.setdefault(x, []).append(i)
    out = {}
    for x, places in masks.items():
        bits = np.zeros(places[-1] + 1, dtype=np.uint8)
        bits[places] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _last_row(a: list, b: list) -> int:
    """Bit i is 0 where the common length with ``b`` rises from a[:i] to a[:i + 1]."""
    full = (1 << len(a)) - 1
    masks, row = _masks(a), full
    for y in b:
        both = row & masks.get(y, 0)
        if both:
            row = ((row + both) | (row - both)) & full
    return row


def lcs_length(a: list, b: list) -> int:
    if len(a) > len(b):
        a, b = b, a
    return len(a) - _last_row(a, b).bit_count() if a else 0


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _by_rows(a: list, b: list, i0: int, j0: int, out: list) -> None:
    n, m = len(a), len(b)
    if not n or not m:
        return
    if n * m > KEPT_BITS and m > 1:
        mid = m // 2
        ahead, back = _lengths(_last_row(a, b[:mid]), n), _lengths(_last_row(a[::-1], b[mid:][::-1]), n)
        cut = int(np.argmax(ahead + back[::-1]))
        _by_rows(a[:cut], b[:mid], i0, j0, out)
        _by_rows(a[cut:], b[mid:], i0 + cut, j0 + mid, out)
        return
    full, masks, size = (1 << n) - 1, _masks(a), n // 8 + 1
    row = full
    rows = [row.to_bytes(size, "little")]
    for y in b:
        both = row & masks.get(y, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row.to_bytes(size, "little"))
    found, i, j = [], n, m
    while i and j:
        byte, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
        if rows[j][byte] & bit:
            i -= 1
        elif not rows[j - 1][byte] & bit:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i0 + i, j0 + j))
    out += found[::-1]


def _by_diagonals(a: list, b: list, most: int) -> list | None:
    """Common items of a shortest edit script of at most ``most`` edits, or None if there is none."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(most + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                out = []
                for e in range(d, -1, -1):
                    before, k = trail[e], x - y
                    prev = k + 1 if k == -e or (k != e and before[k - 1] < before[k + 1]) else k - 1
                    px = before[prev] if e else 0
                    py = px - prev if e else 0
                    while x > px and y > py:
                        x, y = x - 1, y - 1
                        out.append((x, y))
                    x, y = px, py
                return out[::-1]
    return None


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending; what is left out is a shortest edit script."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    inner = _by_diagonals(x, y, FEW) if x and y else []
    if inner is None:
        inner = []
        _by_rows(x, y, 0, 0, inner)
    tail = [(len(a) - end + k, len(b) - end + k) for k in range(end)]
    return [*((k, k) for k in range(start)), *((i + start, j + start) for i, j in inner), *tail]


def _inside(a: list, b: list) -> list[int] | None:
    """Places in ``b`` of the items of ``a`` in their order, the first ones there are, or None if ``b`` hasn't got them all."""
    out, j = [], -1
    try:
        for x in a:
            out.append(j := b.index(x, j + 1))
    except ValueError:
        return None
    return out


def script_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """As ``lcs_pairs``, for texts with many differences; of several longest ones it may take another.

    Equal ends are common, and items that the other side hasn't got are not: both are set aside for as long as there are
    any. If one of the rests lies in the other as it is, no common subsequence is longer; else they are searched."""
    head, tail, i, j, x, y = [], [], range(len(a)), range(len(b)), a, b
    while True:
        short, start, end = min(len(x), len(y)), 0, 0
        while start < short and x[start] == y[start]:
            start += 1
        while end < short - start and x[-1 - end] == y[-1 - end]:
            end += 1
        head += zip(i[:start], j[:start])
        tail += zip(reversed(i[len(x) - end :]), reversed(j[len(y) - end :]))
        i, j, x, y = i[start : len(x) - end], j[start : len(y) - end], x[start : len(x) - end], y[start : len(y) - end]
        has, size = (set(x) & set(y)).__contains__, len(x) + len(y)
        in_x, in_y = list(map(has, x)), list(map(has, y))
        i, j, x, y = list(compress(i, in_x)), list(compress(j, in_y)), list(compress(x, in_x)), list(compress(y, in_y))
        if len(x) + len(y) == size:
            break
    if (places := _inside(x, y) if len(x) <= len(y) else None) is not None:
        inner = list(enumerate(places))
    elif (places := _inside(y, x) if len(y) <= len(x) else None) is not None:
        inner = [(p, q) for q, p in enumerate(places)]
    elif (inner := _by_diagonals(x, y, FEW)) is None:
        inner = []
        _by_rows(x, y, 0, 0, inner)
    return [*head, *((i[p], j[q]) for p, q in inner), *reversed(tail)]
