"""Overlay of polygon sets in numpy: the one operation that built-in functions can't express.

Many pairs are computed at one go on flat arrays of edges. Coordinates go to a fine grid of whole numbers around the
pair's corner. A sweep upwards finds crossings: each edge meets only those that begin while it is active. Vertices and
crossings cut the plane into slabs, inside which edges don't cross; the edges active in a slab, sorted by x, tell what
is inside by the even-odd rule, part by part, so that overlapping parts of one geometry count once. Where inside begins
or ends are the edges of the result. Those of neighbouring slabs that run both ways cancel, the rest are walked into
rings, and rings are sorted into shells and their holes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Rings = list[list[list[tuple[float, float]]]]

#: Width of the grid, in units of the coordinates: far finer than survey data, coarser than rounding.
GRID = 2.0**-30
#: Edge pairs tested, and edges active in slabs, at a time.
BLOCK = 4_000_000
#: Edges of the pairs computed at one go.
EDGES = 20_000
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.list_(pa.list_(pa.list_(_POINT)))


class Flat:
    """Points of a geometry column in flat arrays: x, y, and each one's ring, part (polygon) and row. bad: rows with
    null or infinite coordinates, or null parts or rings. boxes: (rows, minx, miny, maxx, maxy) of rows whose geometry is
    their box and null in the column."""

    def __init__(self, column: pa.Array, boxes: tuple[np.ndarray, ...] | None = None):
        def lengths(c):
            return pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)

        rows = len(column)
        parts = column.flatten()
        part_row = np.repeat(np.arange(rows), lengths(column))
        rings = parts.flatten()
        ring_part = np.repeat(np.arange(len(parts)), lengths(parts))
        points = rings.flatten()
        self.ring = np.repeat(np.arange(len(rings)), lengths(rings))
        self.part = ring_part[self.ring]
        self.row = part_row[self.part]
        x, y = (pc.struct_field(points, [k]).to_numpy(zero_copy_only=False) if len(points) else np.zeros(0) for k in (0, 1))
        self.x, self.y = x.astype(float), y.astype(float)
        self.bad = np.zeros(rows, bool)
        self.bad[self.row[~(np.isfinite(self.x) & np.isfinite(self.y))]] = True
        self.bad[part_row[ring_part[rings.is_null().to_numpy(zero_copy_only=False)]]] = True
        self.bad[part_row[parts.is_null().to_numpy(zero_copy_only=False)]] = True
        if boxes is not None and len(boxes[0]):
            at, x0, y0, x1, y1 = boxes
            number = np.repeat(np.arange(len(at)), 4)
            more = (at[number], len(parts) + number, len(rings) + number, np.stack([x0, x1, x1, x0], 1).ravel(), np.stack([y0, y0, y1, y1], 1).ravel())
            whole = [np.concatenate(c) for c in zip((self.row, self.part, self.ring, self.x, self.y), more, strict=True)]
            order = np.argsort(whole[0], kind="stable")
            self.row, self.part, self.ring, self.x, self.y = (c[order] for c in whole)
            self.bad[at[~np.isfinite(x0 + y0 + x1 + y1)]] = True
        self.sizes = np.bincount(self.row, minlength=rows)

    def between(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """row - a, part, ring, x, y of the points of rows a to b."""
        p, q = np.searchsorted(self.row, [a, b])
        return self.row[p:q] - a, self.part[p:q], self.ring[p:q], self.x[p:q], self.y[p:q]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's number, repeated, and its members start, start + 1, ..."""
    number = np.repeat(np.arange(len(counts)), counts)
    return number, np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class _Edges:
    """Edges of n pairs that aren't level, the lower end first, on the grid; group tells their part."""

    def __init__(self, n: int, sides: list[tuple[np.ndarray, ...]]):
        row = np.concatenate([s[0] for s in sides])
        x, y = np.concatenate([s[3] for s in sides]), np.concatenate([s[4] for s in sides])
        low = np.full((2, n), np.inf)
        np.minimum.at(low[0], row, x)
        np.minimum.at(low[1], row, y)
        self.origin = np.floor(np.where(np.isfinite(low), low, 0))
        self.n, self.sides, out, first, self.points = n, max(len(sides), 2), [], 0, []
        for side, (r, part, ring, px, py) in enumerate(sides):
            gx, gy = np.rint((px - self.origin[0][r]) / GRID), np.rint((py - self.origin[1][r]) / GRID)
            self.points.append((r, gx, gy, px, py))
            # Each point's next one in its ring; the last one's is the first, so an open ring is closed.
            starts = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]]) if len(ring) else np.zeros(0, int)
            after = np.arange(1, len(ring) + 1)
            after[np.r_[starts[1:] - 1, len(ring) - 1][: len(starts)]] = starts
            up = gy < gy[after]
            keep = gy != gy[after]
            a, b = np.where(up, np.arange(len(ring)), after)[keep], np.where(up, after, np.arange(len(ring)))[keep]
            out.append((r[keep], np.full(keep.sum(), side), first + part[keep], gx[a], gy[a], gx[b], gy[b]))
            first += int(part.max(initial=-1)) + 1
        self.pair, self.side, self.group, self.x0, self.y0, self.x1, self.y1 = (np.concatenate(c) for c in zip(*out, strict=True))
        # One number for a pair and a height; heights are whole.
        self.tall = float(max(self.y1.max(initial=0.0) + 2, 2))

    def key(self, pair: np.ndarray, y: np.ndarray) -> np.ndarray:
        return pair.astype(np.int64) * int(self.tall) + y.astype(np.int64)

    def at(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x of edges e at heights y; exact at their ends."""
        x = self.x0[e] + (self.x1[e] - self.x0[e]) * ((y - self.y0[e]) / (self.y1[e] - self.y0[e]))
        return np.where(y == self.y1[e], self.x1[e], x)

    def crossings(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, y) where two edges of a pair cross. In order of their lower ends, an edge is active for those after it
        that begin below its upper end."""
        begins = self.key(self.pair, self.y0)
        order = np.argsort(begins, kind="stable")
        last = np.searchsorted(begins[order], self.key(self.pair, self.y1)[order], "left")
        counts = np.maximum(last - np.arange(len(order)) - 1, 0)
        left, right = np.minimum(self.x0, self.x1)[order], np.maximum(self.x0, self.x1)[order]
        ends, found = np.cumsum(counts), []
        k = 0
        while k < len(order):
            m = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK, "right")), k + 1)
            i, j = _ranges(np.arange(k + 1, m + 1), counts[k:m])
            i = i + k
            near = (left[i] <= right[j]) & (left[j] <= right[i])
            i, j = order[i[near]], order[j[near]]
            ax, ay, bx, by = self.x1[i] - self.x0[i], self.y1[i] - self.y0[i], self.x1[j] - self.x0[j], self.y1[j] - self.y0[j]
            ox, oy, d = self.x0[j] - self.x0[i], self.y0[j] - self.y0[i], ax * by - ay * bx
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (ox * by - oy * bx) / d, (ox * ay - oy * ax) / d
            hit = (d != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            found.append((self.pair[i[hit]], np.rint(self.y0[i[hit]] + t[hit] * ay[hit])))
            k = m
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))


def _inside(op: str, sides: list[np.ndarray]) -> np.ndarray:
    a, rest = sides[0], sides[1:]
    return np.logical_and.reduce(sides) if op == "and" else np.logical_or.reduce(sides) if op == "or" else a & ~np.logical_or.reduce(rest)


def _sweep(edges: _Edges, ops: tuple[str, ...]):
    """For each block of slabs and each of ops: (op, (pair, edge, opens, x at the bottom, bottom, x at the top, top)) where
    the inside begins or ends, slab by slab from left to right."""
    pair, y = edges.crossings()
    lines = np.unique(np.concatenate([edges.key(edges.pair, edges.y0), edges.key(edges.pair, edges.y1), edges.key(pair, y)]))
    height, of = (lines % int(edges.tall)).astype(float), lines // int(edges.tall)
    first, last = np.searchsorted(lines, edges.key(edges.pair, edges.y0)), np.searchsorted(lines, edges.key(edges.pair, edges.y1))
    active = np.cumsum(np.bincount(first, minlength=len(lines) + 1) - np.bincount(last, minlength=len(lines) + 1))
    load, s0 = np.cumsum(active), 0
    while s0 < len(lines):
        s1 = max(int(np.searchsorted(load, (load[s0 - 1] if s0 else 0) + BLOCK, "right")), s0 + 1)
        low, high = np.maximum(first, s0), np.minimum(last, s1)
        e, s = _ranges(low, np.maximum(high - low, 0))
        bottom, top = edges.at(e, height[s]), edges.at(e, height[np.minimum(s + 1, len(lines) - 1)])
        order = np.lexsort((bottom + top, s))
        e, s, bottom, top = e[order], s[order], np.rint(bottom[order]), np.rint(top[order])
        # Within a slab a part's edges open and close it by turns.
        mine = np.lexsort((np.arange(len(e)), edges.group[e], s))
        new = np.r_[True, (s[mine][1:] != s[mine][:-1]) | (edges.group[e][mine][1:] != edges.group[e][mine][:-1])] if len(e) else np.zeros(0, bool)
        place = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0)) if len(e) else np.zeros(0, int)
        turn = np.empty(len(e), int)
        turn[mine] = 1 - 2 * (place % 2)
        sides = [np.cumsum(np.where(edges.side[e] == k, turn, 0)) > 0 for k in range(edges.sides)]
        for op in ops:
            now = _inside(op, sides)
            before = np.r_[False, now[:-1]] if len(now) else now
            k = np.flatnonzero(now != before)
            yield op, (of[s[k]], e[k], now[k], bottom[k], height[s[k]], top[k], height[s[k] + 1])
        s0 = s1


def _turn(a: tuple, b: tuple, c: tuple) -> int:
    """Twice the signed area of a, b, c: exact, as Python's integers have no limit."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _ring_area(ring: list[tuple]) -> int:
    """Twice the signed area of a closed ring; positive if it runs anticlockwise."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))


def _half(d: tuple) -> int:
    return 0 if d[1] > 0 or d[1] == 0 and d[0] > 0 else 1


def _after(base: tuple, a: tuple, b: tuple) -> bool:
    """Does direction a come before b, turning clockwise from base?"""

    def past(d):
        cross, dot = base[0] * d[1] - base[1] * d[0], base[0] * d[0] + base[1] * d[1]
        return 0 if cross < 0 else 1 if cross == 0 and dot < 0 else 2 if cross > 0 else 3

    p, q = past(a), past(b)
    return p < q or p == q and a[0] * b[1] - a[1] * b[0] < 0


def walk(steps: list[tuple]) -> list[list[tuple]]:
    """Rings of directed steps (x0, y0, x1, y1, edge) whose inside is on the left.

    Where several steps leave a point, the sharpest left turn stays with the same piece of the inside; a ring that
    comes back to one of its points is cut there, so no ring touches itself. Points between two steps of one edge,
    and on a straight line, are left out.
    """
    leaving: dict[tuple, list] = {}
    for x0, y0, x1, y1, e in steps:
        leaving.setdefault((x0, y0), []).append(((x1, y1), e))
    rings = []
    for start in list(leaving):
        while leaving.get(start):
            path, seen = [(start, None)], {start: 0}
            while True:
                here = path[-1][0]
                ways = leaving[here]
                pick = 0
                if len(ways) > 1 and len(path) > 1:
                    back = (path[-2][0][0] - here[0], path[-2][0][1] - here[1])
                    direction = lambda w, here=here: (w[0][0] - here[0], w[0][1] - here[1])
                    for k in range(1, len(ways)):
                        if _after(back, direction(ways[k]), direction(ways[pick])):
                            pick = k
                to, e = ways.pop(pick)
                if not ways:
                    del leaving[here]
                if to in seen:
                    k = seen[to]
                    rings.append([*path[k:], (to, e)])
                    for p, _ in path[k + 1 :]:
                        del seen[p]
                    path = path[: k + 1]
                    if len(path) == 1:
                        break
                else:
                    seen[to] = len(path)
                    path.append((to, e))
    out = []
    for ring in rings:
        # ring[k + 1] holds the edge by which it was reached from ring[k].
        points = [p for p, _ in ring[:-1]]
        into = [ring[-1][1], *[e for _, e in ring[1:-1]]]
        n = len(points)
        keep = [k for k in range(n) if (into[k] < 0 or into[k] != into[(k + 1) % n]) and _turn(points[k - 1], points[k], points[(k + 1) % n])]
        kept = [points[k] for k in keep]
        if len(kept) > 2:
            lowest = kept.index(min(kept))
            kept = kept[lowest:] + kept[:lowest]
            out.append([*kept, kept[0]])
    return out


def _contains(ring: list[tuple], x2: int, y2: int) -> bool:
    """Is the point (x2 / 2, y2 / 2) inside a ring that it isn't on."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (2 * ay > y2) != (2 * by > y2):
            side = (2 * bx - 2 * ax) * (y2 - 2 * ay) - (x2 - 2 * ax) * (2 * by - 2 * ay)
            odd ^= (side > 0) == (by > ay)
    return odd


def polygons(rings: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Shells with their holes; a hole belongs to the smallest shell around it. Rings thinner than rounding go."""
    sized = [(_ring_area(r), r) for r in rings]
    sized = [(a, r) for a, r in sized if abs(a) > 8 * sum(max(p[k] for p in r) - min(p[k] for p in r) for k in (0, 1))]
    shells = sorted([(a, [r]) for a, r in sized if a > 0], key=lambda s: (s[0], s[1][0][0]))
    for a, hole in sized:
        if a < 0:
            (ax, ay), (bx, by) = hole[0], hole[1]
            for size, shell in shells:
                if size > -a and _contains(shell[0], ax + bx, ay + by):
                    shell.append(hole)
                    break
    return sorted((s for _, s in shells), key=lambda s: s[0][0])


def _assemble(edges: _Edges, found: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """The polygons of each pair as a geometry column, from where the inside begins and ends in each slab.

    Where no point of a pair is left by two steps, all its rings follow from where steps end, at one go for all such pairs;
    the others, and those with holes in several polygons or rings about as thin as rounding, are walked one by one.
    """
    pair, e, opens, x0, y0, x1, y1 = (np.concatenate(c) for c in zip(*found, strict=True))
    # Level steps: what is inside above a line but not below it runs east, the other way round west.
    line_pair, line, x = np.concatenate([pair, pair]), np.concatenate([y0, y1]), np.concatenate([x0, x1])
    change = np.concatenate([np.where(opens, 1, -1), np.where(opens, -1, 1)])
    order = np.lexsort((x, line, line_pair))
    line_pair, line, x, net = line_pair[order], line[order], x[order], np.cumsum(change[order])
    k = np.flatnonzero(net[:-1] != 0) if len(net) else np.zeros(0, int)
    k = k[x[k] != x[k + 1]]
    k = np.repeat(k, np.abs(net[k]))
    east = net[k] > 0
    level = (line_pair[k], np.where(east, x[k], x[k + 1]), line[k], np.where(east, x[k + 1], x[k]), line[k], np.full(len(k), -1))
    # Upright steps: down where the inside begins, up where it ends.
    upright = (pair, np.where(opens, x1, x0), np.where(opens, y1, y0), np.where(opens, x0, x1), np.where(opens, y0, y1), e)
    p, ax, ay, bx, by, edge = (np.concatenate(c) for c in zip(level, upright, strict=True))
    ax, ay, bx, by = (c.astype(np.int64) for c in (ax, ay, bx, by))
    back = (ay > by) | (ay == by) & (ax > bx)
    ends = [np.where(back, b, a) for a, b in ((ax, bx), (ay, by), (bx, ax), (by, ay))]
    order = np.lexsort((*ends, p))
    same = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (p, *ends)], axis=0)] if len(order) else np.zeros(0, bool)
    number = np.cumsum(same) - 1
    # Of steps both ways between the same points only the surplus stays.
    way = np.where(back[order], -1, 1)
    net = np.bincount(number, way).astype(int) if len(order) else np.zeros(0, int)
    surplus = way == np.sign(net[number])
    rank = np.cumsum(surplus) - surplus
    rank -= rank[np.flatnonzero(same)][number]
    keep = order[surplus & (rank < np.abs(net[number]))]
    steps = tuple(c[keep] for c in (p, ax, ay, bx, by, edge))
    plain, column = _plain(edges, *steps)
    rest = np.flatnonzero(~plain)
    if not len(rest):
        return column
    at = np.cumsum(plain) - 1
    at[rest] = len(column) + np.arange(len(rest))
    return pa.concat_arrays([column, to_arrow(_walked(edges, rest, steps))]).take(pa.array(at))


def _walked(edges: _Edges, rows: np.ndarray, steps: tuple[np.ndarray, ...]) -> list[Rings]:
    """The polygons of some pairs, walked one by one."""
    wanted = np.zeros(edges.n, bool)
    wanted[rows] = True
    original: dict[int, dict] = {row: {} for row in rows.tolist()}
    for r, *c in edges.points:
        own = wanted[r]
        gx, gy, px, py = (v[own] for v in c)
        for row, i, j, u, v in zip(r[own].tolist(), gx.astype(int).tolist(), gy.astype(int).tolist(), px.tolist(), py.tolist(), strict=True):
            original[row].setdefault((i, j), (u, v))
    own = wanted[steps[0]]
    of: dict[int, list] = {row: [] for row in rows.tolist()}
    for row, *step in zip(*(c[own].tolist() for c in steps), strict=True):
        of[row].append(step)
    out = []
    for row in rows.tolist():
        ox, oy = edges.origin[0][row], edges.origin[1][row]
        place = lambda q, row=row, ox=ox, oy=oy: original[row].get(q) or (float(ox + q[0] * GRID), float(oy + q[1] * GRID))
        out.append([[[place(q) for q in ring] for ring in polygon] for polygon in polygons(walk(of[row]))])
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's row isn't that before it."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(columns[0]) else np.zeros(0, bool)


def _plain(edges: _Edges, p, ax, ay, bx, by, edge) -> tuple[np.ndarray, pa.Array]:
    """(which pairs can be done at one go, their polygons), the same as by walk() and polygons()."""
    plain, n = np.ones(edges.n, bool), len(p)
    leave, reach = np.lexsort((ay, ax, p)), np.lexsort((by, bx, p))
    plain[p[leave][~_changes(p[leave], ax[leave], ay[leave])]] = False
    plain[p[leave][(ax[leave] != bx[reach]) | (ay[leave] != by[reach])]] = False
    after = np.empty(n, int)
    after[reach] = leave
    # A step's end is a corner unless its edge, or the line, goes on. Products are exact modulo 2 to the power 64.
    ux, uy, vx, vy = bx - ax, by - ay, (bx - ax)[after], (by - ay)[after]
    straight = (ux * vy - uy * vx == 0) & (np.abs(ux.astype(float) * vy - uy.astype(float) * vx) < 2.0**62)
    corner = ((edge < 0) | (edge != edge[after])) & ~straight & plain[p]
    # A ring's number is its first step's; rings begin at their smallest corner.
    ring, jump = np.arange(n), after
    while True:
        lower = np.minimum(ring, ring[jump])
        if (lower == ring).all():
            break
        ring, jump = lower, jump[jump]
    k = np.flatnonzero(corner)
    k = k[np.lexsort((by[k], bx[k], ring[k]))]
    heads = k[_changes(ring[k])]
    jump, ahead = after.copy(), np.ones(n, int)
    jump[heads], ahead[heads] = heads, 0
    longest = int(np.bincount(ring, minlength=1).max(initial=1))
    for _ in range(longest.bit_length()):
        ahead, jump = ahead + ahead[jump], jump[jump]
    k = k[np.lexsort((-ahead[k] + np.where(ahead[k] == 0, -n - 1, 0), ring[k]))]
    # Corners ring by ring; rings of one or two corners have no inside.
    new = _changes(ring[k])
    size = np.diff(np.r_[np.flatnonzero(new), len(k)])
    k = k[np.repeat(size > 2, size)]
    size = size[size > 2]
    starts = np.cumsum(size) - size
    x, y, rows = bx[k], by[k], p[k[starts]]
    last = np.arange(len(k)) + 1
    last[starts + size - 1] = starts
    fx, fy = (x - np.repeat(x[starts], size)).astype(float), (y - np.repeat(y[starts], size)).astype(float)
    add = lambda c: np.add.reduceat(c, starts) if len(starts) else np.zeros(0)
    extent = lambda c: np.maximum.reduceat(c, starts) - np.minimum.reduceat(c, starts) if len(starts) else np.zeros(0)
    area, wide, tall = add(fx * fy[last] - fy * fx[last]), extent(fx), extent(fy)
    slack = 1e-10 * size * wide * tall
    plain[rows[np.abs(area) <= 32 * (wide + tall) + slack]] = False
    hole = area < 0
    shells, holes = np.bincount(rows[~hole], minlength=edges.n), np.bincount(rows[hole], minlength=edges.n)
    plain[(holes > 0) & (shells != 1)] = False
    shell = np.zeros(edges.n)
    shell[rows[~hole]] = area[~hole]
    plain[rows[hole & (shell[rows] <= -area + 2 * slack)]] = False
    # Polygons by their first corners; a shell before its holes, these in the order of their first steps.
    one = holes[rows] > 0
    order = np.lexsort((np.where(one, 0, y[starts]), np.where(one, ring[k[starts]], x[starts]), one & hole, rows))
    order = order[plain[rows[order]]]
    number, at = _ranges(starts[order], size[order] + 1)
    at[np.cumsum(size[order] + 1) - 1] = starts[order]
    rows, hole = rows[order], hole[order]
    points = pa.StructArray.from_arrays(list(_places(edges, rows[number], x[at], y[at])), fields=list(_POINT))
    ends = lambda counts: pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    rings = pa.ListArray.from_arrays(ends(size[order] + 1), points)
    first = np.flatnonzero(~hole)
    parts = pa.ListArray.from_arrays(ends(np.diff(np.r_[first, len(hole)])), rings)
    return plain, pa.ListArray.from_arrays(ends(np.bincount(rows[first], minlength=edges.n)[plain]), parts)


def _places(edges: _Edges, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of points of the grid: those that a pair's own point there was given with, the first one's of several."""
    r, gx, gy, px, py = (np.concatenate(c) for c in zip(*edges.points, strict=True))
    m = len(r)
    every = [np.concatenate([gy, y.astype(float)]), np.concatenate([gx, x.astype(float)]), np.concatenate([r, row])]
    order = np.lexsort(every)  # stable: own points come before those asked for
    new = _changes(*(c[order] for c in every))
    known = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    back = np.empty(len(order), int)
    back[order] = known
    back = back[m:]
    own, to = back < m, np.minimum(back, max(m - 1, 0))
    return tuple(np.where(own, c[to], o[row] + g * GRID) if m else o[row] + g * GRID for c, o, g in ((px, edges.origin[0], x), (py, edges.origin[1], y)))


def _blocks(sides: list[Flat]):
    """(first row, row after the last, edges) of blocks of EDGES points; a larger row is a block of its own. Bad rows have
    no edges."""
    bad = np.logical_or.reduce([f.bad for f in sides])
    ends, k, n = np.cumsum(np.sum([f.sizes for f in sides], axis=0)), 0, len(bad)
    while k < n:
        m = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + EDGES, "right")), k + 1)
        points = [f.between(k, m) for f in sides]
        yield k, m, _Edges(m - k, [tuple(c[~bad[k:m][p[0]]] for c in p) for p in points])
        k = m


def _areas(found: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    pair, _, opens, x0, y0, x1, y1 = found
    return np.bincount(pair, np.where(opens, -1, 1) * ((x0 + x1) * GRID) * ((y1 - y0) * GRID) / 2, minlength=n)


def areas_flat(sides: list[Flat], ops: tuple[str, ...]) -> list[np.ndarray]:
    """Areas of each of ops between the rows of sides, by one sweep; NaN where a row is bad. "and" is what all sides
    share, "or" what any holds, "minus" the first's without the others."""
    out = {op: np.zeros(len(sides[0].bad)) for op in ops}
    for k, m, edges in _blocks(sides):
        if len(edges.pair):
            for op, found in _sweep(edges, ops):
                out[op][k:m] += _areas(found, m - k)
    bad = np.logical_or.reduce([f.bad for f in sides])
    return [np.where(bad, np.nan, out[op]) for op in ops]


def overlay_column(a: Flat, b: Flat | None, op: str) -> tuple[np.ndarray, pa.Array]:
    """Areas and polygons of "and", "or" or "minus" of the rows of a and b; NaN and no polygons where a row is bad."""
    sides = [a, b] if b else [a]
    area, out = np.zeros(len(a.bad)), []
    for k, m, edges in _blocks(sides):
        found = [f for _, f in _sweep(edges, (op,))] if len(edges.pair) else []
        for f in found:
            area[k:m] += _areas(f, m - k)
        out.append(_assemble(edges, found) if found else to_arrow([[] for _ in range(k, m)]))
    area[np.logical_or.reduce([f.bad for f in sides])] = np.nan
    return area, pa.concat_arrays(out) if out else to_arrow([])


def overlay_flat(a: Flat, b: Flat | None, op: str, geometry: bool = False) -> tuple[np.ndarray, list[Rings]]:
    """overlay_column() with polygons as lists, and none unless asked for."""
    if not geometry:
        return areas_flat([a, b] if b else [a], (op,))[0], []
    area, column = overlay_column(a, b, op)
    return area, [[[[(q["x"], q["y"]) for q in r] for r in p] for p in g] for g in column.to_pylist()]


def box_column(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> pa.Array:
    """Boxes as a geometry column."""
    n = len(x0)
    points = pa.StructArray.from_arrays([np.stack([x0, x1, x1, x0, x0], 1).ravel(), np.stack([y0, y0, y1, y1, y0], 1).ravel()], fields=list(_POINT))
    one = pa.array(np.arange(n + 1), pa.int32())
    return pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(pa.array(5 * np.arange(n + 1), pa.int32()), points)))


def to_arrow(geometries: list) -> pa.Array:
    """Nested lists of pairs as a geometry column; None stays null."""
    return pa.array([None if g is None else [[[{"x": x, "y": y} for x, y in r] for r in p] for p in g] for g in geometries], ARROW)


def overlay(a: Rings, b: Rings, op: str) -> tuple[float, Rings]:
    """(area, polygons) of one pair."""
    area, out = overlay_flat(Flat(to_arrow([a])), Flat(to_arrow([b])), op, True)
    return float(area[0]), out[0]


def repair(a: Rings) -> tuple[float, Rings]:
    """a as polygons whose rings neither cross nor touch themselves: even-odd inside a part, parts united."""
    return overlay(a, [], "or")
