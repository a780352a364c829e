"""What is sequential within a document: tuples of ``and`` and ``fuzzy``, and snippets.

All are plain functions over the lists of one document.  An entry is
(lower, upper, weight, points) with points a list of (offset, term).
"""

from __future__ import annotations

import math

Entry = tuple[int, int, float, list[tuple[int, int]]]
BEFORE, AFTER, REACH, LEAST = 30, 60, 100, 1e-3
BREAKS = frozenset(".!?:;,")
ELLIPSIS = "…"


def all_of(operands: list[list[Entry]]) -> list[Entry]:
    """Tuples with an entry of each operand, the operands given by descending weight.

    The heads of all operands make a tuple; those that begin it advance.  A
    tuple that reaches back into the one before replaces it if it weighs
    more, and is added behind it otherwise.
    """
    if not operands or not all(operands):
        return []
    at = [0] * len(operands)
    out: list[Entry] = []
    while True:
        heads = [x[i] for x, i in zip(operands, at)]
        lower, upper = min(h[0] for h in heads), max(h[1] for h in heads)
        rest = 1.0
        for h in heads:
            rest *= 1 - h[2]
        found = (lower, upper, 1 - rest, [p for h in heads for p in h[3]])
        if out and out[-1][1] >= lower and out[-1][2] < found[2]:
            out[-1] = found
        else:
            out.append(found)
        for k, h in enumerate(heads):
            if h[0] == lower:
                at[k] += 1
        if any(i >= len(x) for x, i in zip(operands, at)):
            break
    return out


def nearness(distance: int) -> float:
    """What a word at that distance from its place still counts."""
    near = math.cos(math.atan(abs(distance) / 5.0))
    return 0.01 + (0.99 if distance >= 0 else 0.95) * near


def fuzzy(operands: list[list[Entry]], ranges: list[float], orders: list[int], quorum: float) -> list[Entry]:
    """Tuples of operands that together reach the quorum, given by descending range.

    The first operands, as many as reach it, lead; the others join with their
    entry nearest before the tuple's beginning, or else the next, unless it
    ends too far on.  An overlapping tuple stays only if it weighs more than
    the one before.
    """
    heads: list[list[Entry]] = []
    reached, high = 0.0, 0
    for entries, weight in zip(operands, ranges):
        if reached >= quorum:
            break
        heads.append(entries)
        if entries:
            reached += weight
            high = max(high, entries[-1][1] + REACH)
    at = [0] * len(operands)
    loaded = len(heads)
    heads += [[] for _ in operands[loaded:]]
    out: list[Entry] = []

    def open_(k: int) -> bool:
        return at[k] < len(heads[k])

    while True:
        owner, lower, place = -1, 0, 0
        scalar = square = total = 0.0
        k = 0
        while k < len(heads) and total < quorum:
            if open_(k):
                total += ranges[k]
                head = heads[k][at[k]]
                if owner < 0:
                    owner, lower, place = k, head[0], head[0] - orders[k]
                    scalar = head[2]
                else:
                    if head[0] < lower:
                        owner, lower = k, head[0]
                    scalar += head[2] * nearness(head[0] - place - orders[k])
                square += head[2] ** 2
            k += 1
        if total < quorum or owner < 0:
            break
        for k in range(k, len(heads)):
            if k >= loaded:
                heads[k] = [e for e in operands[k] if max(lower - BEFORE, 0) <= e[0] and e[1] <= high]
                loaded = k + 1
            if not open_(k):
                continue
            while at[k] + 1 < len(heads[k]) and heads[k][at[k] + 1][0] < lower and heads[k][at[k]][0] < lower:
                at[k] += 1
            head = heads[k][at[k]]
            if head[1] > lower + AFTER:
                continue
            distance = head[0] - place - orders[k]
            if head[0] < lower:
                owner, lower = k, head[0]
            scalar += head[2] * nearness(distance)
            square += head[2] ** 2
        weight = scalar / (len(operands) * square) ** 0.25 if square > 0 else 0.0
        useful = weight >= LEAST
        if useful and out and out[-1][1] >= lower:
            useful = out[-1][2] < weight
            if useful:
                out.pop()
        if useful:
            members = [heads[k][at[k]] for k in range(len(heads)) if open_(k)]
            out.append((lower, max(m[1] for m in members), weight, [p for m in members for p in m[3]]))
        at[owner] += 1
    return out


def regions(n: int, tags: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of positions in the same innermost tag: first, last, index of the tag or -1. Tags come outermost first."""
    edges = sorted({0, n, *(t[1] for t in tags), *(t[2] + 1 for t in tags)})
    out = []
    for a, b in zip(edges, edges[1:]):
        if a >= n:
            break
        around = [i for i, t in enumerate(tags) if t[1] <= a and t[2] >= b - 1]
        out.append((a, min(b, n) - 1, around[-1] if around else -1))
    return out


def windows(is_break: list[bool], points: list[int], tags: list[tuple[str, int, int]], fields) -> list[tuple[int, int, bool, bool, int]]:
    """What a snippet shows: first, last, whether it is cut before and behind, and the tag.

    ``fields(name)`` gives quote ('auto', 'never' or 'always') and indents.
    Around each hit a window is drawn: it is at least as wide as the smaller
    indents and goes on to the nearest breaking mark, within the larger ones.
    Windows that touch become one.
    """
    out: list[list] = []
    for low, high, tag in regions(len(is_break), tags):
        quote, (left, right) = fields(tags[tag][0] if tag >= 0 else "")
        if quote == "always":
            out.append([low, high, False, False, tag])
        if quote != "auto":
            continue
        mine: list[list] = []
        for p in sorted({p for p in points if low <= p <= high}):
            wall = max(low, p - left[1]), min(high, p + right[1])
            a, b = max(wall[0], p - left[0]), min(wall[1], p + right[0])
            while a < p and is_break[a]:
                a += 1
            stopped = False
            while a > wall[0] and not (stopped := is_break[a - 1]):
                a -= 1
            before = not stopped and a > low
            stopped = False
            while b < wall[1] and not stopped:
                b += 1
                stopped = is_break[b]
            behind = not stopped and b < high
            if mine and mine[-1][1] + 1 >= a:
                mine[-1][1], mine[-1][3] = b, behind
            else:
                mine.append([a, b, before, behind, tag])
        out += mine
    return [tuple(x) for x in out]


#: What a token is, as bits: behind a blank, the first of its block, a number, a mark that breaks.
SPACED, FIRST, NUMBER, BREAK = 1, 2, 4, 8


def render(texts, kinds, first: int, last: int, before: bool, behind: bool, marks: dict[int, int], opening: str, closing: str) -> list[str]:
    """Texts of the tokens from first to last: a block of its own for each number and each text block that begins."""
    out: list[str] = []
    parts = [ELLIPSIS] if before else []
    for i in range(first, last + 1):
        kind, shown = kinds[i], texts[i]
        if kind & SPACED:
            parts.append(" ")
        elif kind & FIRST and parts:
            out.append("".join(parts))
            parts = []
        if i in marks:
            number = str(marks[i])
            parts.append(opening.replace("%u", number))
        if kind & NUMBER:
            if parts:
                out.append("".join(parts))
            out.append(shown)
            parts = []
        else:
            parts.append(shown)
        if i in marks:
            parts.append(closing.replace("%u", number))
    if behind:
        parts.append(ELLIPSIS)
    return out + ["".join(parts)] if parts else out
