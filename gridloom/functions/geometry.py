"""Rectangle algebra as Column expressions. A rectangle is four columns l, r, b, t.

Two families of predicates are kept apart: ``overlaps_open`` is strict (touching or degenerate rectangles don't
overlap) and ``intersects_closed`` includes the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    l: Column  # noqa: E741
    r: Column
    b: Column
    t: Column


def rect(prefix: str = "") -> Rect:
    """The rectangle in columns ``<prefix>l``, ``<prefix>r``, ``<prefix>b``, ``<prefix>t``."""
    return Rect(*(F.col(f"{prefix}{c}") for c in "lrbt"))


def area(a: Rect) -> Column:
    return (a.t - a.b) * (a.r - a.l)


def perimeter(a: Rect) -> Column:
    return F.lit(2.0) * (a.t - a.b + a.r - a.l)


def is_valid(a: Rect) -> Column:
    return (a.r >= a.l) & (a.t >= a.b)


def contains(a: Rect, q: Rect) -> Column:
    """a holds all of q, edges included."""
    return (a.l <= q.l) & (q.r <= a.r) & (a.b <= q.b) & (a.t >= q.t)


def overlaps_open(a: Rect, q: Rect) -> Column:
    return (F.greatest(a.l, q.l) < F.least(a.r, q.r)) & (F.greatest(a.b, q.b) < F.least(a.t, q.t))


def intersects_closed(a: Rect, q: Rect) -> Column:
    return (a.l <= q.r) & (q.l <= a.r) & (a.b <= q.t) & (q.b <= a.t)


def intersection(a: Rect, q: Rect) -> Rect:
    """The common part where the two overlap, else null."""
    ok = overlaps_open(a, q)
    pick = lambda c: F.when(ok, c)
    return Rect(
        pick(F.greatest(a.l, q.l)), pick(F.least(a.r, q.r)), pick(F.greatest(a.b, q.b)), pick(F.least(a.t, q.t))
    )


def union(a: Rect, q: Rect) -> Rect:
    return Rect(F.least(a.l, q.l), F.greatest(a.r, q.r), F.least(a.b, q.b), F.greatest(a.t, q.t))


def overlap_area(a: Rect, q: Rect) -> Column:
    return F.coalesce(area(intersection(a, q)), F.lit(0.0))


def overlap_perimeter(a: Rect, q: Rect) -> Column:
    return F.coalesce(perimeter(intersection(a, q)), F.lit(0.0))


def overlap_growth(a: Rect, other: Rect, added: Rect, measure=overlap_area) -> Column:
    """How much the overlap of a with other grows when a takes in ``added``."""
    return measure(union(a, added), other) - measure(a, other)


def min_distance(a: Rect, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge; 0 inside."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(a.l - x, zero, x - a.r), F.greatest(a.b - y, zero, y - a.t))


def squared_distance(a: Rect, x: Column, y: Column) -> Column:
    dx = F.greatest(a.l - x, F.lit(0.0), x - a.r)
    dy = F.greatest(a.b - y, F.lit(0.0), y - a.t)
    return dx * dx + dy * dy


def quadrant(a: Rect, mid_x: Column, mid_y: Column) -> Column:
    """Quadrant digit of a rectangle that lies entirely in one: 0 (right, low), 1 (left, low), 2 (left, high),
    3 (right, high); null where it straddles or touches a middle line."""
    right, left = a.l > mid_x, a.r < mid_x
    low, high = a.t < mid_y, a.b > mid_y
    return F.when(right & low, 0).when(left & low, 1).when(left & high, 2).when(right & high, 3)
