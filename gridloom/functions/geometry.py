"""Rings as arrays of (x, y) structs: area, centroid, envelope, point in polygon, crossing edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def box_ring(w: Column, s: Column, e: Column, n: Column) -> Column:
    return ring((w, s), (e, s), (e, n), (w, n))


def square(x: Column, y: Column, half: float | Column) -> Column:
    """The footprint of a pixel from its centre."""
    return box_ring(x - half, y - half, x + half, y + half)


def diamond(x: Column, y: Column, r: Column) -> Column:
    return ring((x - r, y), (x, y - r), (x + r, y), (x, y + r))


def _over_edges(points: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The sum of value(a, b) over a ring's edges; the last point joins the first."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, value), F.lit(0.0), lambda t, x: t + x)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def area(points: Column) -> Column:
    """The area of a ring (shoelace), not signed."""
    return F.abs(_over_edges(points, _cross)) / 2


def centroid(points: Column) -> tuple[Column, Column]:
    twice = _over_edges(points, _cross)
    part = lambda k: _over_edges(points, lambda a, b: (a[k] + b[k]) * _cross(a, b)) / (3 * twice)
    return part("x"), part("y")


def envelope(points: Column) -> tuple[Column, Column, Column, Column]:
    """(w, s, e, n)"""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a place is inside a ring (even-odd); for holes, give the rings one after the other to `contains_even_odd`."""
    return _crossings(points, x, y) % 2 == 1


def _crossings(points: Column, x: Column, y: Column) -> Column:
    hit = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("double")).otherwise(0.0)
    return _over_edges(points, hit)


def edges_of(points: Column) -> Column:
    """A ring's edges as an array of (ax, ay, bx, by)."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(points, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def edges_beside(edges: Column, w: Column, s: Column, n: Column) -> Column:
    """The edges that decide for the places of a box (its west, south and north) whether they are inside: those of its rows that do
    not lie west of it."""
    return F.filter(edges, lambda g: (F.greatest(g["ay"], g["by"]) >= s) & (F.least(g["ay"], g["by"]) <= n) & (F.greatest(g["ax"], g["bx"]) >= w))


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """`contains` for a ring's edges, or for those of `edges_beside` and a place of that box."""
    hit = lambda g: ((g["ay"] > y) != (g["by"] > y)) & (x < (g["bx"] - g["ax"]) * (y - g["ay"]) / (g["by"] - g["ay"]) + g["ax"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def edges_cross(edges: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether any edge meets a box: it overlaps it, and not all corners lie on one side of it."""

    def meets(g: Column) -> Column:
        side = lambda x, y: (g["bx"] - g["ax"]) * (y - g["ay"]) - (g["by"] - g["ay"]) * (x - g["ax"])
        corners = [side(w, s), side(w, n), side(e, s), side(e, n)]
        over = (F.greatest(g["ax"], g["bx"]) >= w) & (F.least(g["ax"], g["bx"]) <= e) & (F.greatest(g["ay"], g["by"]) >= s) & (F.least(g["ay"], g["by"]) <= n)
        return over & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(edges, meets)


def contains_even_odd(rings: Column, x: Column, y: Column) -> Column:
    """Whether a place is inside a polygon with holes: an array of rings, counted together."""
    return F.aggregate(rings, F.lit(0.0), lambda t, r: t + _crossings(r, x, y)) % 2 == 1


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (w, s, e, n) share a place."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])
