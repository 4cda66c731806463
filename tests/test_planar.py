import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.functions import planar as P


def box(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_union_intersection_and_relations():
    a, b = P.make_valid(box(0, 0, 10)), P.make_valid(box(5, 5, 10))
    assert P.polygon_area(P.union([a, b])) == pytest.approx(175) and P.polygon_area(P.intersection(a, b)) == pytest.approx(25)
    assert P.relation(a, b) == ("overlaps", pytest.approx(25)) and P.relation(a, P.make_valid(box(2, 2, 3)))[0] == "contains"
    assert P.relation(P.make_valid(box(2, 2, 3)), a)[0] == "within" and P.relation(a, P.make_valid(box(10, 0, 3)))[0] == "apart"
    assert [len(r) for r in P.union_outlines([box(0, 0, 10), box(10, 0, 10)])] == [4]
    assert P.union([]) == []


def test_repair_of_crossing_rings():
    bow = P.make_valid([(0, 0), (10, 10), (10, 0), (0, 10)])
    assert len(bow) == 2 and P.polygon_area(bow) == pytest.approx(50)
    assert P.make_valid([(0, 0), (1, 1), (2, 2)]) == []
    holed = P.make_valid(box(0, 0, 10), [box(2, 2, 4), box(4, 4, 4)])
    assert P.polygon_area(holed) == pytest.approx(100 - 28)


def test_buffers():
    a = P.make_valid(box(0, 0, 10))
    assert P.polygon_area(P.buffer(a, 2)) == pytest.approx(180 + np.pi * 4, rel=2e-3)
    assert P.polygon_area(P.buffer(a, -2)) == pytest.approx(36)
    assert P.buffer(a, -6) == []
    dumbbell = P.make_valid([(0, 0), (20, 0), (20, 10), (12, 10), (12, 2), (8, 2), (8, 10), (0, 10)])
    assert len(P.buffer(dumbbell, -1.5)) == 2


def test_enclosed_gaps_and_holes():
    frame = [P.make_valid(r) for r in ([(0, 0), (30, 0), (30, 10), (0, 10)], [(0, 20), (30, 20), (30, 30), (0, 30)], [(0, 0), (10, 0), (10, 30), (0, 30)], [(20, 0), (30, 0), (30, 30), (20, 30)])]
    whole = P.union(frame)
    assert P.polygon_area(whole) == pytest.approx(800) and P.polygon_area(P.filled(whole)) == pytest.approx(900)
    cut = P.with_holes(P.make_valid(box(0, 0, 10)), [P.make_valid(box(1, 1, 3)), P.make_valid(box(2, 2, 3))])
    assert P.polygon_area(cut) == pytest.approx(86)


rings = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=8)


@settings(max_examples=120, deadline=None)
@given(rings, rings)
def test_areas_add_up(r, s):
    a, b = P.make_valid(r), P.make_valid(s)
    both, shared = P.polygon_area(P.union([a, b])), P.polygon_area(P.intersection(a, b))
    assert P.polygon_area(a) + P.polygon_area(b) == pytest.approx(both + shared, abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(rings)
def test_repair_is_even_odd(r):
    a = P.make_valid(r)
    points = np.random.default_rng(0).uniform(-21, 21, (400, 2))
    assert (P.in_polygon(a, points) == P.in_ring(P.as_ring(r), points)).mean() > 0.995


def test_large_rings_are_compared_in_blocks(monkeypatch):
    t = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    star = np.column_stack((np.cos(t), np.sin(t))) * (2 + np.cos(40 * t))[:, None]
    crossed = star.copy()
    crossed[[100, 1700]] = crossed[[1700, 100]]
    for pairs in (4_000_000, 50_000):
        monkeypatch.setattr(P, "_PAIRS", pairs)
        assert not P.edges_meet([star]) and P.edges_meet([crossed])
        assert P.edges_meet([star], [star + 0.5]) and not P.edges_meet([star], [star + 100])


def test_areas_add_up_at_near_equal_points():
    """Crossings that are equal to a corner but for rounding are that corner."""
    a, b = P.make_valid([(0, 0), (0, 1), (-14, 7)]), P.make_valid([(0, 1), (0, 12), (-18, -20)])
    assert P.polygon_area(P.union([a, b])) + P.polygon_area(P.intersection(a, b)) == pytest.approx(106)
