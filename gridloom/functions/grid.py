"""A hierarchical equal-area grid of cells, as column functions.

Level r divides the longitude into 2^(r+1) columns and the sine of the latitude into 2^r rows, so all cells of a level have
the same area, each has four children and up to four edge neighbours. A cell's id holds its level in bits 58 and up, its
row in bits 29 to 57 and its column below. This is the only module that knows the layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
ROW, LEVEL = 1 << 29, 1 << 58
#: Direction -> (columns, rows) to the neighbour over that edge.
EDGES = {"e": (1, 0), "n": (0, 1), "w": (-1, 0), "s": (0, -1)}


def area_km2(level: int) -> float:
    return 4 * math.pi * EARTH_KM**2 / 2 ** (2 * level + 1)


def made(level: int | Column, row: Column, col: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return level.cast("long") * LEVEL + row * ROW + col


def cell(lat: Column, lon: Column, level: int) -> Column:
    """The cell of a place; the poles and the date line fall into the outermost cells."""
    rows, cols = 1 << level, 2 << level
    row = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((1 + F.sin(F.radians(lat))) / 2 * rows)))
    col = F.least(F.lit(cols - 1), F.greatest(F.lit(0), F.floor((lon + 180) / 360 * cols)))
    return made(level, row.cast("long"), col.cast("long"))


def level_of(c: Column) -> Column:
    return F.shiftright(c, 58)


def row_of(c: Column) -> Column:
    return F.shiftright(c, 29) % ROW


def col_of(c: Column) -> Column:
    return c % ROW


def parent(c: Column, up: int = 1) -> Column:
    """The ancestor `up` levels higher."""
    return made(level_of(c) - up, F.shiftright(row_of(c), up), F.shiftright(col_of(c), up))


def centre(c: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle of a cell."""
    rows = F.pow(F.lit(2.0), level_of(c))
    return F.degrees(F.asin((row_of(c) + 0.5) / rows * 2 - 1)), (col_of(c) + 0.5) / (rows * 2) * 360 - 180


def moved(c: Column, dcol: int | Column, drow: int | Column) -> Column:
    """The cell so many columns and rows away: columns wrap around, null beyond a pole."""
    rows = F.pow(F.lit(2.0), level_of(c)).cast("long")
    row = row_of(c) + drow
    return F.when((row >= 0) & (row < rows), made(level_of(c), row, F.pmod(col_of(c) + dcol, rows * 2)))


def neighbours(c: Column) -> Column:
    """Array of the cells over a cell's edges; beyond a pole there is none."""
    return F.array_compact(F.array(*[moved(c, *EDGES[d]) for d in EDGES]))


def rectangle(level: Column, row: Column, col: Column) -> tuple[Column, Column, Column, Column]:
    """(w, s, e, n) of a place of the grid in degrees; columns beyond the date line go on."""
    rows = F.pow(F.lit(2.0), level)
    lat = lambda r: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / rows * 2 - 1))))
    lon = lambda c: c / (rows * 2) * 360 - 180
    return lon(col), lat(row), lon(col + 1), lat(row + 1)


def disk(c: Column, k: int) -> Column:
    """The cells within k edge steps, the cell itself included, as an array."""
    steps = [(x, y) for x in range(-k, k + 1) for y in range(-k, k + 1) if abs(x) + abs(y) <= k]
    return F.array_compact(F.array(*[moved(c, x, y) for x, y in steps]))


def edges(c: Column) -> Column:
    """Array of (dir, neighbour, x1, y1, x2, y2): the sides of a cell in degrees, counter-clockwise; no neighbour is null."""
    rows = F.pow(F.lit(2.0), level_of(c))
    lat = lambda r: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / rows * 2 - 1))))
    w, e = col_of(c) / (rows * 2) * 360 - 180, (col_of(c) + 1) / (rows * 2) * 360 - 180
    s, n = lat(row_of(c)), lat(row_of(c) + 1)
    ends = {"e": (e, s, e, n), "n": (e, n, w, n), "w": (w, n, w, s), "s": (w, s, e, s)}
    side = lambda d: F.struct(F.lit(d).alias("dir"), moved(c, *EDGES[d]).alias("neighbour"), *[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), ends[d], strict=True)])
    return F.array(*map(side, EDGES))
