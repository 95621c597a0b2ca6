"""Fitting the lines of an edited text to those of the original by their least edits."""

from __future__ import annotations

import re

#: Edits up to which lines are compared by least edits; beyond it, and in what lies between sure lines, by blocks.
BAND = 500
#: Pairs of lines that a block is solved for in full; a larger one is paired in order.
CELLS = 40_000
#: Lines of one text that may stand in one line of the other.
JOINED = 40
#: What a line costs that is another one's part, is another, was lost or came in, and each further line that shares one.
PART, OTHER, GONE, FURTHER = 0.5, 1.0, 0.8, 0.1


def _bare(line: str) -> str:
    return "".join(line.split())


def _least_edits(a: list[str], b: list[str], band: int) -> list[tuple[int, int]] | None:
    """Pairs of equal lines in a shortest way from a to b by insertions and deletions (Myers); None if it takes more than ``band`` of them."""
    n, m = len(a), len(b)
    far, seen = {1: 0}, []
    for d in range(min(band, n + m) + 1):
        seen.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            far[k] = x
            if x >= n and y >= m:
                return _way_back(seen, n, m)
    return None


def _way_back(seen: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    equal = []
    for d in range(len(seen) - 1, -1, -1):
        far, k = seen[d], x - y
        down = k == -d or (k != d and far[k - 1] < far[k + 1])
        from_k = k + 1 if down else k - 1
        from_x = far[from_k] if d else 0
        from_y = from_x - from_k if d else 0
        while x > from_x and y > from_y and (x, y) != (from_x, from_y):
            if d and (x - from_x, y - from_y) in ((1, 0), (0, 1)):
                break
            x, y = x - 1, y - 1
            equal.append((x, y))
        x, y = from_x, from_y
    return equal[::-1]


def _sure(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of lines that both texts have once, as many as keep their order."""
    from bisect import bisect_left

    once = lambda xs: {x for x, n in _counts(xs).items() if n == 1}
    both = once(a) & once(b)
    at = {x: j for j, x in enumerate(b) if x in both}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in both]
    tops: list[int] = []
    last: list[int] = []
    before: list[int | None] = []
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before.append(last[k - 1] if k else None)
        if k == len(tops):
            tops.append(j)
            last.append(p)
        else:
            tops[k], last[k] = j, p
    out, p = [], last[-1] if last else None
    while p is not None:
        out.append(pairs[p])
        p = before[p]
    return out[::-1]


def _counts(xs: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for x in xs:
        out[x] = out.get(x, 0) + 1
    return out


def _block(a: list[str], b: list[str]) -> list[tuple[list[int], list[int]]]:
    """Lines of two blocks that belong together: groups of places in a and in b; a group has one of a, or one of b. Lost lines and new ones have none on the other side."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        k = min(n, m)
        return [([i], [i]) for i in range(k)] + [([i], []) for i in range(k, n)] + [([], [j]) for j in range(k, m)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    step: list[list[tuple[int, int]]] = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            ways = []
            if i < n:
                ways.append((GONE + best[i + 1][j], (1, 0)))
            if j < m:
                ways.append((GONE + best[i][j + 1], (0, 1)))
            if i < n and j < m:
                x, y = a[i], b[j]
                cost = 0.0 if x == y else PART if x and y and (x in y or y in x) else OTHER
                ways.append((cost + best[i + 1][j + 1], (1, 1)))
                for few, one, to in ((a[i:], y, 0), (b[j:], x, 1)):
                    joined = ""
                    for k, part in enumerate(few[:JOINED], 1):
                        joined += part
                        if len(joined) > len(one) or joined not in one:
                            break
                        if k > 1:
                            cost = (0.0 if joined == one else PART) + FURTHER * (k - 1)
                            ways.append((cost + (best[i + k][j + 1] if to == 0 else best[i + 1][j + k]), (k, 1) if to == 0 else (1, k)))
            if ways:
                best[i][j], step[i][j] = min(ways)
    out, i, j = [], 0, 0
    while i < n or j < m:
        di, dj = step[i][j]
        out.append((list(range(i, i + di)), list(range(j, j + dj))))
        i, j = i + di, j + dj
    return out


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    middle = _least_edits(x, y, BAND)
    middle = _sure(x, y) if middle is None else middle
    return [(i, i) for i in range(first)] + [(first + i, first + j) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def fitted(code: list[str], corrected: list[str], comments: list[str | None]) -> list[tuple[str, str | None]]:
    """Each code line with the comment of the corrected line that it stands for; ``comments`` has one for each corrected line.

    Equal lines, white space aside, are found by least edits; between them lines are told apart as changed, split, joined, lost and new at the least cost. A changed line takes the corrected text. Of
    code lines that share a corrected one the first has its comment; a code line that was split has the comments of all its parts. A lost line has none, and what was said of a new one goes.
    """
    flat = lambda xs: [re.sub(r"\s+", " ", x) for x in xs]
    lines, other = flat(code), flat(corrected)
    a, b = [_bare(x) for x in code], [_bare(x) for x in corrected]
    out: list[tuple[str, str | None]] = []
    i = j = 0
    for p, q in [*_matched(a, b), (len(a), len(b))]:
        for mine, theirs in _block(a[i:p], b[j:q]) if i < p or j < q else []:
            said = [comments[j + t] for t in theirs if comments[j + t] is not None]
            changed = len(mine) == len(theirs) == 1 and a[i + mine[0]] not in b[j + theirs[0]]
            for nth, k in enumerate(mine):
                out.append((other[j + theirs[0]] if changed else lines[i + k], "\n".join(said) if said and not nth else None))
        if p < len(a):
            out.append((lines[p], comments[q]))
        i, j = p + 1, q + 1
    return out
