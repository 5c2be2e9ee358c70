"""Scalar rules on columns: predicates, units, heat, bands, flags, keys and dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ACRES_PER_KM2, M2_PER_ACRE = 247.105, 4046.8564


def present(v: Column) -> Column:
    """Neither null nor NaN; NaN equals itself here, so a self comparison would keep it."""
    return v.isNotNull() & ~F.isnan(v)


def above_floor(elev: Column, floor: float, eps: float) -> Column:
    """Land with a measured elevation: over the floor and not in the band around sea level."""
    return present(elev) & (elev > floor) & (F.abs(elev) > eps)


def owned(x: Column, y: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Half-open ownership, so that tiles that touch never both hold a place."""
    return (x >= w) & (x < e) & (y >= s) & (y < n)


def bin_index(x: Column, origin: float, size: float, down: bool = False) -> Column:
    """Whole-number index of a regular grid; `down` counts from the top."""
    return F.floor((origin - x if down else x - origin) / size).cast("bigint")


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def acres(pixels: Column, pixel_km2: float) -> Column:
    return pixels * pixel_km2 * ACRES_PER_KM2


def heat_index(tc: Column, rh: Column) -> Column:
    """Apparent temperature in Celsius: a simple formula where its mean with the temperature is below 80 F, else a regression
    with its two humidity adjustments."""
    t = tc * 9 / 5 + 32
    simple = 0.5 * (t + 61 + (t - 68) * 1.2 + rh * 0.094)
    # Coefficients of the published regression.
    full = -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    dry = F.when((rh < 13) & t.between(80, 112), (13 - rh) / 4 * F.sqrt((17 - F.abs(t - 95)) / 17)).otherwise(0.0)
    wet = F.when((rh > 85) & t.between(80, 87), (rh - 85) / 10 * ((87 - t) / 5)).otherwise(0.0)
    mean = (simple + t) / 2
    return (F.when(mean >= 80, full - dry + wet).otherwise(simple) - 32) * 5 / 9


def half_degree_code(tc: Column) -> Column:
    """Half degrees from -40 as 0..254; 255 is missing."""
    return F.when(present(tc), F.greatest(F.lit(0), F.least(F.lit(254), F.rint((tc + 40) * 2).cast("int")))).otherwise(255)


def packed_nibbles(high: Column, low: Column) -> Column:
    """Two small numbers, clamped to 0..15, in one byte."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(15), F.rint(c).cast("int")))
    return F.shiftleft(clamp(high), 4).bitwiseOR(clamp(low))


def excess(hi: Column, threshold: float | Column, wind: Column | None = None, vent: float | Column = 0.0) -> Column:
    """How far an index is over its threshold, less what the wind takes away."""
    over = F.greatest(F.lit(0.0), hi - threshold)
    return over if wind is None else over * F.greatest(F.lit(0.0), 1 - vent * wind / 10)


def band(load: Column, levels: Iterable[float]) -> Column:
    """The highest level reached, from 0."""
    out = F.lit(0)
    for k, level in enumerate(sorted(levels), 1):
        out = F.when(load >= level, k).otherwise(out)
    return out


# Zones of special hazard by their published codes; "AREA NOT INCLUDED" begins with A too and is none.
COASTAL, FLOODED = ("V", "VE"), ("A", "AE", "AH", "AO", "A99", "AR")


def zone_severity(zone: Column, subtype: Column) -> Column:
    """Flood zones: coastal 3, the A family 2, shaded X (a yearly chance of 0.2 %) 1, undetermined 0, anything else -1."""
    z = F.upper(F.trim(F.coalesce(zone, F.lit(""))))
    shaded = (z == "X") & F.coalesce(subtype.contains("0.2"), F.lit(False))
    return F.when(z.isin(*COASTAL), 3).when(z.isin(*FLOODED), 2).when(shaded, 1).when(z == "D", 0).otherwise(-1)


def non_crop(name: Column, names: Iterable[str], prefixes: Iterable[str]) -> Column:
    out = name.isin(*names)
    for p in prefixes:
        out |= name.startswith(p)
    return out


def ndvi(nir: Column, red: Column, cover: Column | None = None) -> Column:
    value = (nir - red) / F.greatest(nir + red, F.lit(1))
    return value if cover is None else F.when(cover, value)


def terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def disagreement(is_crop: Column, is_field: Column) -> Column:
    """1 crop in a field, 2 crop outside any, 3 a field without crop, null for neither."""
    return F.when(is_crop & is_field, 1).when(is_crop, 2).when(is_field, 3)


def log_clip(v: Column, low: float, high: float) -> Column:
    return (F.log10(F.greatest(F.lit(low), F.least(F.lit(high), v))) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low)))


def sqrt_clip(v: Column, high: float) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / high)))


def linear_clip(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / F.nullif(high - low, F.lit(0.0))))


def pivot_clip(v: Column, pivot: float, span: float) -> Column:
    """-1..1 around a pivot."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (v - pivot) / span))


def most_of_list(text: Column) -> Column:
    """The largest whole number in a list separated by ; or , (0 without one)."""
    numbers = F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    return F.coalesce(F.array_max(F.transform(numbers, lambda x: x.try_cast("bigint"))), F.lit(0))


def voltage(tags: Column) -> Column:
    """The highest voltage that a map of tags names, 0 where there is none."""
    return most_of_list(F.get(F.map_values(F.map_filter(tags, lambda k, _: k == "voltage")), 0))


def power_line(cls: Column, geometry: Column, tags: Column, least: int = 115_000) -> Column:
    """Major power lines: of that class, a line, and of a voltage."""
    return (cls == "power_line") & geometry.isin("LINESTRING", "MULTILINESTRING") & (voltage(tags) >= least)


def building_height(height: Column, floors: Column, per_floor: float = 3.0) -> Column:
    return F.coalesce(height, floors * per_floor)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    digit = lambda i: (F.call_function("shiftright", x, i) % 2 + F.call_function("shiftright", y, i) % 2 * 2).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), digit), "")


def hilbert(x: Column, y: Column, zoom: int) -> Column:
    """The place of a tile on the Hilbert curve of its zoom, after all tiles of lower zooms; a key that keeps neighbours near."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, i: Column) -> Column:
        s = F.pow(F.lit(2.0), i).cast("long")
        rx, ry = F.floor(acc["x"] / s) % 2, F.floor(acc["y"] / s) % 2
        turn = ry == 0
        fx, fy = F.when(rx == 1, s - 1 - acc["x"] % s).otherwise(acc["x"] % s), F.when(rx == 1, s - 1 - acc["y"] % s).otherwise(acc["y"] % s)
        nx, ny = F.when(turn, fy).otherwise(acc["x"] % s), F.when(turn, fx).otherwise(acc["y"] % s)
        return F.struct(nx.cast("long").alias("x"), ny.cast("long").alias("y"), (acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))).cast("long").alias("d"))

    base = (4**zoom - 1) // 3
    return F.aggregate(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"]) + base


def leaf_season(lat: Column) -> tuple[Column, Column]:
    """First and last day of the year of the season of leaves: from day 105 to 305 at latitude 35, and 0.9 days later and
    earlier for each degree away from the equator, within bounds. A rule of thumb."""
    shift = 0.9 * (F.abs(lat) - 35)
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return clamp(105 + shift, 60.0, 160.0), clamp(305 - shift, 250.0, 340.0)


def leaf_on(date: Column, lat: Column) -> Column:
    first, last = leaf_season(lat)
    return F.dayofyear(date).between(first, last)


# --- doubles as whole numbers of the same order

#: 2 to the power 52, the bits of a mantissa; the exponent of the smallest normal number, and the bias of exponents.
MANTISSA, SMALLEST, BIAS = 1 << 52, -1022, 1023


def ordered_code(v: Column) -> Column:
    """A double as a whole number in the same order: the bits of its size, below 0 for negative values. Both zeros are 0.

    The exponent is that of the base-2 logarithm, set right by one where rounding has carried it over a power of two; powers of two
    and divisions by them are exact."""
    size = F.abs(v)
    finite = F.when((size > 0) & (size < float("inf")), size).otherwise(1.0)
    about = F.greatest(F.lit(SMALLEST), F.least(F.lit(1023), F.floor(F.log2(finite)).cast("int")))
    scaled = finite / F.pow(F.lit(2.0), about)
    exponent = F.when(scaled >= 2, about + 1).when((scaled < 1) & (about > SMALLEST), about - 1).otherwise(about)
    share = F.when(scaled >= 2, scaled / 2).when((scaled < 1) & (about > SMALLEST), scaled * 2).otherwise(scaled)
    normal = (exponent.cast("long") + BIAS) * F.lit(MANTISSA) + ((share - 1) * float(MANTISSA)).cast("long")
    below = (share * float(MANTISSA)).cast("long")  # denormal: no leading one
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit((2 * BIAS + 1) * MANTISSA)).when(share < 1, below).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits)


def coded_value(code: Column) -> Column:
    """The double of an ordered code."""
    bits = F.abs(code)
    exponent, mantissa = F.shiftright(bits, 52), (bits % MANTISSA) / float(MANTISSA)
    size = F.when(exponent == 0, mantissa * 2.0**SMALLEST).when(exponent > 2 * BIAS, float("inf")).otherwise((1 + mantissa) * F.pow(F.lit(2.0), exponent - BIAS))
    return F.when(code < 0, -size).otherwise(size)
