"""Geodesy as column expressions: everything here stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6371000.0
RADIUS_KM = 6371.0088
POINTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def haversine(lat1, lng1, lat2, lng2, radius: float = RADIUS_M) -> Column:
    """Great-circle distance in the unit of radius; null if any coordinate is."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees clockwise from north, 0 to 360."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of eight points."""
    return F.element_at(F.array(*map(F.lit, POINTS)), (F.floor(degrees / 45 + 0.5) % 8 + 1).cast("int"))


def heading_delta(a, b) -> Column:
    """Smallest turn between two headings, 0 to 180."""
    turn = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(turn, 360 - turn)


def wrapped_lng(lng) -> Column:
    """A longitude brought to -180 to 180."""
    return F.pmod(_c(lng) + 180, F.lit(360.0)) - 180


def null_zero(lat, lng, what: Column) -> Column:
    """what, but null at (0, 0), which stands for a missing position."""
    return F.when((_c(lat) == 0) & (_c(lng) == 0), None).otherwise(what)


def valid(lat, lng) -> Column:
    lat, lng = _c(lat), _c(lng)
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def in_box(lat, lng, south: float, north: float, west: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lng).between(west, east)


def first_box(lat, lng, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """The name of the first of ordered boxes (name, south, north, west, east) that holds the position, else null."""
    out = F.lit(None).cast("string")
    for name, *box in reversed(boxes):
        out = F.when(in_box(lat, lng, *box), F.lit(name)).otherwise(out)
    return out


#: Fixed values of the GCJ-02 datum: the Krasovsky ellipsoid, the area where it holds, and its series, as
#: (amplitude, period) of sines of x or y in units of pi.
AXIS, ECCENTRICITY = 6378245.0, 0.00669342162296594323
DATUM_BOX = (0.8293, 55.8271, 72.004, 137.8347)
LAT_SERIES = (("x", 20.0, 6.0), ("x", 20.0, 2.0), ("y", 20.0, 1.0), ("y", 40.0, 1 / 3), ("y", 160.0, 1 / 12), ("y", 320.0, 1 / 30))
LNG_SERIES = (("x", 20.0, 6.0), ("x", 20.0, 2.0), ("x", 20.0, 1.0), ("x", 40.0, 1 / 3), ("x", 150.0, 1 / 12), ("x", 300.0, 1 / 30))
LAT_POLYNOMIAL = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2)  # of 1, x, y, xx, yy, xy, sqrt|x|
LNG_POLYNOMIAL = (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
BD_TURN = math.pi * 3000.0 / 180.0


def _offset(x: Column, y: Column, polynomial: tuple, series: tuple) -> Column:
    terms = (F.lit(1.0), x, y, x * x, y * y, x * y, F.sqrt(F.abs(x)))
    out = sum((F.lit(k) * t for k, t in zip(polynomial, terms, strict=True) if k), F.lit(0.0))
    for axis, amplitude, frequency in series:
        out = out + F.sin((x if axis == "x" else y) * (frequency * math.pi)) * (amplitude * 2 / 3)
    return out


def gcj_shift(lat, lng) -> tuple[Column, Column]:
    """What GCJ-02 adds to a WGS-84 position (nothing outside its area)."""
    lat, lng = _c(lat), _c(lng)
    x, y = lng - 105.0, lat - 35.0
    m = 1 - ECCENTRICITY * F.pow(F.sin(F.radians(lat)), 2)
    d_lat = F.degrees(_offset(x, y, LAT_POLYNOMIAL, LAT_SERIES) * m * F.sqrt(m) / (AXIS * (1 - ECCENTRICITY)))
    d_lng = F.degrees(_offset(x, y, LNG_POLYNOMIAL, LNG_SERIES) * F.sqrt(m) / (AXIS * F.cos(F.radians(lat))))
    inside = in_box(lat, lng, *DATUM_BOX)
    return F.when(inside, d_lat).otherwise(0.0), F.when(inside, d_lng).otherwise(0.0)


def wgs_to_gcj(lat, lng) -> tuple[Column, Column]:
    a, b = gcj_shift(lat, lng)
    return _c(lat) + a, _c(lng) + b


def gcj_to_wgs(lat, lng) -> tuple[Column, Column]:
    """The inverse to first order: the shift at the GCJ-02 position is taken off."""
    a, b = gcj_shift(lat, lng)
    return _c(lat) - a, _c(lng) - b


def bd_to_gcj(lat, lng) -> tuple[Column, Column]:
    x, y = _c(lng) - 0.0065, _c(lat) - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_TURN)
    turn = F.atan2(y, x) - 0.000003 * F.cos(x * BD_TURN)
    return z * F.sin(turn), z * F.cos(turn)


def bd_to_wgs(lat, lng) -> tuple[Column, Column]:
    return gcj_to_wgs(*bd_to_gcj(lat, lng))


def derived_position(key) -> tuple[Column, Column]:
    """A position made from an integer key, the same on every engine: test tables have none of their own."""
    k = _c(key).cast("long")
    return (k * 7919 % 170000) / F.lit(1000.0) - 85, (k * 104729 % 360000) / F.lit(1000.0) - 180


#: The published inverse of a provider's Mercator metres, a polynomial for each band of northing (from its lower
#: end on): two for longitude, seven for latitude, and the unit of the latter.
MERCATOR_BANDS = (
    (12890594.86, (1.410526172116255e-8, 0.00000898305509648872, -1.9939833816331, 200.9824383106796, -187.2403703815547, 91.6087516669843, -23.38765649603339, 2.57121317296198, -0.03801003308653, 17337981.2)),
    (8362377.87, (-7.435856389565537e-9, 0.000008983055097726239, -0.78625201886289, 96.32687599759846, -1.85204757529826, -59.36935905485877, 47.40033549296737, -16.50741931063887, 2.28786674699375, 10260144.86)),
    (5591021.0, (-3.030883460898826e-8, 0.00000898305509983578, 0.30071316287616, 59.74293618442277, 7.357984074871, -25.38371002664745, 13.45380521110908, -3.29883767235584, 0.32710905363475, 6856817.37)),
    (3481989.83, (-1.981981304930552e-8, 0.000008983055099779535, 0.03278182852591, 40.31678527705744, 0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204, -0.04625736007561, 4482777.06)),
    (1678043.12, (3.09191371068437e-9, 0.000008983055096812155, 0.00006995724062, 23.10934304144901, -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953, -0.00466043876332, 2555164.4)),
    (0.0, (2.890871144776878e-9, 0.000008983055095805407, -3.068298e-8, 7.47137025468032, -0.00000353937994, -0.02145144861037, -0.00001234426596, 0.00010322952773, -0.00000323890364, 826088.5)),
)


def mercator_to_bd(x, y) -> tuple[Column, Column]:
    """(lat, lng) in the provider's degrees of its Mercator metres: x is the easting, y the northing."""
    east, north = F.abs(_c(x)), F.abs(_c(y))
    lat = lng = F.lit(None).cast("double")
    for lower, (a, b, *powers, unit) in reversed(MERCATOR_BANDS):
        t, value = north / unit, F.lit(0.0)
        for p in reversed(powers):
            value = value * t + F.lit(p)
        lat, lng = F.when(north >= lower, value).otherwise(lat), F.when(north >= lower, F.lit(a) + F.lit(b) * east).otherwise(lng)
    return lat * F.when(_c(y) >= 0, 1.0).otherwise(-1.0), lng * F.when(_c(x) >= 0, 1.0).otherwise(-1.0)


#: Fixed value: the box that the shifted datum is used in (south, north, west, east).
SHIFTED_BOX = (0.8293, 55.8271, 72.004, 137.8347)


def outside_shift(lat, lng) -> Column:
    """Whether a position lies outside the box of the shifted datum; null positions do."""
    return ~F.coalesce(in_box(lat, lng, *SHIFTED_BOX), F.lit(False))


def projected_to_wgs(x, y) -> tuple[Column, Column]:
    """(lat, lng) in WGS-84 of a provider's Mercator metres."""
    return bd_to_wgs(*mercator_to_bd(x, y))
