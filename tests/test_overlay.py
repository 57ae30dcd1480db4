import math

import numpy as np
import pytest

from parcelcover.operators import overlay as overlay_module
from parcelcover.operators.overlay import Flat, overlay, overlay_flat, repair, to_arrow


def poly(*points, holes=()):
    return [[list(points) + [points[0]], *[list(h) + [h[0]] for h in holes]]]


SQUARE = poly((0, 0), (4, 0), (4, 4), (0, 4))


def area(geom):
    return overlay(geom, [], "or")[0]


@pytest.mark.parametrize("other,want", [
    (poly((2, 2), (6, 2), (6, 6), (2, 6)), 4.0), (poly((4, 0), (8, 0), (8, 4), (4, 4)), 0.0), (poly((1, 1), (2, 1), (2, 2), (1, 2)), 1.0), (poly((9, 9), (10, 9), (10, 10)), 0.0),
    (poly((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)), 7.0), (poly((-1, -1), (5, -1), (5, 5), (-1, 5), holes=[[(1, 1), (3, 1), (3, 3), (1, 3)]]), 12.0), (poly((0, 0), (4, 4), (4, 0), (0, 4)), 8.0), ([], 0.0),
])
def test_intersection(other, want):
    got, pieces = overlay(SQUARE, other, "and")
    assert got == pytest.approx(want) and area(pieces) == pytest.approx(want)
    assert overlay(SQUARE, other, "minus")[0] == pytest.approx(16 - want)


def test_overlapping_parts_count_once():
    parts = SQUARE + poly((3, 0), (7, 0), (7, 4), (3, 4))
    assert area(parts) == pytest.approx(28) and overlay(parts, SQUARE, "and")[0] == pytest.approx(16)


def star(rng, cx, cy):
    n = int(rng.integers(5, 20))
    angles = np.sort(rng.random(n)) * 2 * math.pi
    r = rng.uniform(0.5, 3, n)
    return poly(*[(cx + a * math.cos(t), cy + a * math.sin(t)) for a, t in zip(r, angles, strict=True)])


@pytest.mark.parametrize("offset", [0.0, 2_600_000.0])
def test_identities_of_random_stars(offset):
    rng = np.random.default_rng(4)
    for _ in range(25):
        a, b = star(rng, offset, offset), star(rng, offset + 1, offset)
        both, either, rest = (overlay(a, b, op)[0] for op in ("and", "or", "minus"))
        tolerance = 1e-7 if not offset else 1e-5
        assert both + rest == pytest.approx(area(a), abs=tolerance)
        assert either == pytest.approx(area(a) + area(b) - both, abs=tolerance)
        assert overlay(b, a, "and")[0] == pytest.approx(both, abs=tolerance)


def rings_of(geom):
    return [[ring for ring in polygon] for polygon in geom]


def turned(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2


def proper(geom):
    """Shells run anticlockwise, holes clockwise, and no ring comes to a point twice."""
    return all((turned(r) > 0) == (k == 0) and r[0] == r[-1] and len(set(r)) == len(r) - 1 for p in geom for k, r in enumerate(p))


def measured(geom):
    return sum(turned(r) for p in geom for r in p)


@pytest.mark.parametrize("geom,want", [
    (poly((0, 0), (4, 4), (4, 0), (0, 4)), [[[(0, 0), (2, 2), (0, 4), (0, 0)]], [[(2, 2), (4, 0), (4, 4), (2, 2)]]]),
    (poly((0, 0), (2, 0), (2, 0), (4, 0), (4, 4), (0, 4)), SQUARE),
    (SQUARE + poly((4, 4), (8, 4), (8, 8), (4, 8)), [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(4, 4), (8, 4), (8, 8), (4, 8), (4, 4)]]]),
    (SQUARE + poly((4, 0), (8, 0), (8, 2), (4, 2)), [[[(0, 0), (8, 0), (8, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]]),
    ([[[(0, 0), (4, 0), (4, 4), (0, 4)]]], SQUARE), (poly((0, 0), (4, 0), (2, 0)), []),
])
def test_repair(geom, want):
    assert repair(geom)[1] == want


def test_holes_and_islands():
    frame = overlay(SQUARE, poly((1, 1), (3, 1), (3, 3), (1, 3)), "minus")[1]
    assert [len(p) for p in frame] == [2] and proper(frame)
    both = overlay(frame, poly((1.5, 1.5), (2, 1.5), (2, 2), (1.5, 2)), "or")[1]
    assert sorted(len(p) for p in both) == [1, 2] and proper(both) and measured(both) == 12.25
    # A hole that touches its shell stays a ring of its own.
    touching = overlay(SQUARE, poly((0, 2), (2, 1), (2, 3)), "minus")[1]
    assert [len(p) for p in touching] == [2] and proper(touching) and measured(touching) == 14


@pytest.mark.parametrize("offset", [0.0, 2_600_000.0])
@pytest.mark.parametrize("block", [50, 4_000_000])
def test_polygons_of_random_stars(offset, block, monkeypatch):
    monkeypatch.setattr(overlay_module, "BLOCK", block)
    rng = np.random.default_rng(7)
    for k in range(25):
        a = star(rng, offset, offset) + star(rng, offset + 2, offset) * (k % 2)
        b = star(rng, offset + 1, offset + 0.5)
        for op in ("and", "or", "minus"):
            size, geom = overlay(a, b, op)
            shifted = [[[(x - offset, y - offset) for x, y in r] for r in p] for p in geom]
            assert proper(shifted) and measured(shifted) == pytest.approx(size, abs=1e-6)
            assert area(geom) == pytest.approx(size, abs=1e-6)


def test_many_pairs_equal_single_ones():
    rng = np.random.default_rng(9)
    pairs = [(star(rng, 0, 0), star(rng, 1, 0)) for _ in range(60)] + [(SQUARE, []), ([], [])]
    a, b = (Flat(to_arrow([p[k] for p in pairs])) for k in (0, 1))
    areas, geoms = overlay_flat(a, b, "minus", True)
    single = [overlay(p, q, "minus") for p, q in pairs]
    assert areas.tolist() == pytest.approx([s[0] for s in single], abs=1e-9) and [len(g) for g in geoms] == [len(s[1]) for s in single]


def test_two_polygons_of_2048_corners():
    gon = lambda cx: poly(*[(cx + 50 * math.cos(2 * math.pi * k / 2048), 50 * math.sin(2 * math.pi * k / 2048)) for k in range(2048)])
    size, geom = overlay(gon(0), gon(30), "and")
    lens = 2 * 2500 * math.acos(0.3) - 15 * math.sqrt(10000 - 900)
    assert size == pytest.approx(lens, rel=1e-4) and len(geom) == 1 and len(geom[0]) == 1 and proper(geom)
