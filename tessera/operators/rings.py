"""Rings from lines: the small part of polygon work that needs walking along borders. Used inside tasks, on one area's lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Hashable
from math import atan2

Point = tuple[float, float]
#: A line: the names of its nodes in order, and where they are.
Line = tuple[list[Hashable], list[Point]]


def signed_area(ring: list[Point]) -> float:
    """Positive if the ring, given without its first point at the end again, runs counter-clockwise."""
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _walks(lines: list[Line]) -> list[list[int]]:
    """Cycles of directed lines. Where one ends, the next is the first clockwise from the way back, so what lies to the left of a
    cycle has no line in it that is joined to the cycle."""
    leaving = defaultdict(list)
    for i, (names, at) in enumerate(lines):
        leaving[names[0]].append((atan2(at[1][1] - at[0][1], at[1][0] - at[0][0]), i))
    for around in leaving.values():
        around.sort()
    follows = {}
    for i, (names, at) in enumerate(lines):
        around = leaving[names[-1]]
        back = atan2(at[-2][1] - at[-1][1], at[-2][0] - at[-1][0])
        if around:
            follows[i] = around[bisect_left(around, (back, -1)) - 1][1]
    cycles, seen = [], set()
    for i in range(len(lines)):
        cycle = []
        while i in follows and i not in seen:
            seen.add(i)
            cycle.append(i)
            i = follows[i]
        if cycle and i == cycle[0]:
            cycles.append(cycle)
    return cycles


def _simple(lines: list[Line], cycle: list[int]) -> list[tuple[list[Hashable], list[Point]]]:
    """A cycle cut where it comes back to a node: rings that don't touch themselves."""
    out, stack, place = [], [], {}
    for i in cycle:
        place.setdefault(lines[i][0][0], len(stack))
        stack.append(i)
        if (at := place.get(lines[i][0][-1])) is not None:
            ring, stack = stack[at:], stack[:at]
            for k in ring:
                place.pop(lines[k][0][0], None)
            out.append(([n for k in ring for n in lines[k][0][:-1]], [p for k in ring for p in lines[k][1][:-1]]))
    return out


def _without_dangles(lines: list[Line]) -> list[Line]:
    """Lines that end where no other line does are cut off, again and again."""
    ends = defaultdict(set)
    for i, (names, _) in enumerate(lines):
        ends[names[0]].add(i)
        ends[names[-1]].add(i)
    closed = {i for i, (names, _) in enumerate(lines) if names[0] == names[-1]}
    loose = [n for n, at in ends.items() if len(at) == 1 and not at & closed]
    gone = set()
    while loose:
        for i in list(ends[loose.pop()]):
            gone.add(i)
            for n in (lines[i][0][0], lines[i][0][-1]):
                ends[n].discard(i)
                if len(ends[n]) == 1 and not ends[n] & closed:
                    loose.append(n)
    return [x for i, x in enumerate(lines) if i not in gone]


def faces(lines: list[Line]) -> list[tuple[list[Hashable], list[Point]]]:
    """The rings around each face that lines cut out of the plane, counter-clockwise, from the smallest name on, in order.

    Lines meet at their ends only. What lies on no ring is left out: lines that dangle, and bridges between rings. A ring that
    comes back to one of its nodes is several rings, of which those around holes are left out.
    """
    once = {}
    for names, at in lines:
        if len(names) > 1 and (len(names) > 2 or names[0] != names[-1]):
            once.setdefault(min(tuple(names), tuple(reversed(names))), (names, at))
    left = list(once.values())
    while True:
        left = _without_dangles(left)
        both = [x for names, at in left for x in ((names, at), (names[::-1], at[::-1]))]
        cycles = _walks(both)
        bridges = {i >> 1 for c in cycles for i in c if i ^ 1 in set(c)} if any(len({i >> 1 for i in c}) < len(c) for c in cycles) else set()
        if not bridges:
            break
        left = [x for i, x in enumerate(left) if i not in bridges]
    rings = []
    for cycle in cycles:
        for names, at in _simple(both, cycle):
            if len(names) > 2 and signed_area(at) > 0:
                k = names.index(min(names))
                rings.append((names[k:] + names[:k], at[k:] + at[:k]))
    return sorted(rings, key=lambda r: r[0])


def outline(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """The rings of directed edges that have the inside on their left: outer rings run counter-clockwise, holes clockwise."""
    lines = [([a, b], [a, b]) for a, b in edges if a != b]
    return [at for cycle in _walks(lines) for _, at in _simple(lines, cycle) if len(at) > 2]


def nested(rings: list[list[Point]]) -> list[list[list[Point]]]:
    """outline()'s rings -> polygons: each outer ring with the holes in it. A hole lies in the smallest ring around it."""
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    found = [[r] for r in outer]
    for hole in (r for r in rings if signed_area(r) < 0):
        # The middle of an edge: corners may touch the outer ring.
        (ax, ay), (bx, by) = hole[0], hole[1]
        x, y = (ax + bx) / 2, (ay + by) / 2
        for polygon in found:
            ring = polygon[0]
            crossed = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1]))
            if crossed % 2:
                polygon.append(hole)
                break
    return found


def clipped(box: tuple[float, float, float, float], corner_in: bool, edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """The rings of a polygon's part in a box. edges: those of the polygon that touch the box, the inside on their left; corner_in:
    whether the part just right of the box's lower left corner, on its lower border, is inside."""
    x0, y0, x1, y1 = box
    inner, ends = [], defaultdict(int)
    for (ax, ay), (bx, by) in edges:
        lo, hi, dx, dy = 0.0, 1.0, bx - ax, by - ay
        enter = leave = None
        for d, low, high, axis in ((dx, x0 - ax, x1 - ax, 0), (dy, y0 - ay, y1 - ay, 1)):
            if d == 0:
                if low >= 0 or high <= 0:  # beside the box, or along its border
                    lo = 2.0
                continue
            near, far = (low, high) if d > 0 else (high, low)
            if near / d > lo or (near / d == lo and enter is None and near != 0):
                lo, enter = near / d, (axis, near)
            if far / d < hi:
                hi, leave = far / d, (axis, far)
        if lo >= hi:
            continue

        def at(t: float, border: tuple[int, float] | None, a=(ax, ay), step=(dx, dy)) -> Point:
            p = [min(max(a[0] + t * step[0], x0), x1), min(max(a[1] + t * step[1], y0), y1)]
            if border:
                side = a[border[0]] + border[1]
                p[border[0]] = min((x0, x1) if border[0] == 0 else (y0, y1), key=lambda v: abs(v - side))
            return p[0], p[1]

        a, b = at(lo, enter) if enter else (ax, ay), at(hi, leave) if leave else (bx, by)
        if a != b:
            inner.append((a, b))
            for p in (a, b):
                if p[0] in (x0, x1) or p[1] in (y0, y1):
                    ends[p] += 1

    def along(p: Point) -> tuple[int, float]:
        """Where a point of the border comes on the way around, from the lower left corner on."""
        if p[1] == y0:
            return 0, p[0]
        if p[0] == x1:
            return 1, p[1]
        return (2, -p[0]) if p[1] == y1 else (3, -p[1])

    stops = sorted({(x0, y0), (x1, y0), (x1, y1), (x0, y1), *ends}, key=along)
    inside = corner_in
    for p, q in zip(stops, stops[1:] + stops[:1]):
        if inside:
            inner.append((p, q))
        inside ^= bool(ends[q] % 2)
    return outline(inner)
