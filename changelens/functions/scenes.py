"""Expressions on scene items, geometries, intervals, addresses and packages."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import finite
from .metadata import normalised

# Fixed values of the ellipsoid and of the transverse Mercator zones.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
TAG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def scale_offset(bands: Column) -> tuple[Column, Column]:
    """Scale and offset of the first band entry; null where there is none."""
    first = F.try_element_at(bands, F.lit(1))
    return first["scale"], first["offset"]


def utc_date(iso: Column) -> Column:
    """Date in UTC of an ISO instant; a missing one is an error."""
    day = F.to_date(F.to_timestamp(F.regexp_replace(iso, "Z$", "+00:00")))
    return F.when(iso.isNull(), F.raise_error(F.lit("an item has no datetime")).cast("date")).otherwise(day)


def half_open(first: Column, last: Column) -> tuple[Column, Column]:
    """Start and exclusive end of an inclusive range of dates."""
    return first, F.date_add(last, 1)


def json_safe(x: Column) -> Column:
    return F.when(finite(x), x)


def tag_ok(s: Column) -> Column:
    return F.coalesce(s.rlike(TAG), F.lit(False))


def referenced_paths(json: Column) -> Column:
    """Values of all "path" keys at any depth, in order."""
    return F.regexp_extract_all(json, F.lit(r'"path"\s*:\s*"([^"]*)"'), F.lit(1))


def asset_url(url: Column) -> Column:
    """Trimmed https address with single slashes; null with a query, fragment, backslash, credentials or a segment `.` or `..`, escaped or not."""
    s = F.trim(url)
    body = F.regexp_replace(F.substring(s, 9, 1 << 30), "/+", "/")
    bad = ~s.startswith("https://") | s.rlike("^https://[^/]*@")
    for x in (s, F.try_url_decode(s)):
        bad = bad | F.coalesce(x.rlike(r"[?#\\]") | x.rlike(r"/\.{1,2}(/|$)"), F.lit(True))
    return F.when(~bad, F.concat(F.lit("https://"), body))


def matching_keys(values: Column, part: str) -> Column:
    """Entries whose normalised key holds `part` and whose value isn't null."""
    return F.map_filter(values, lambda k, v: F.contains(normalised(k), F.lit(part)) & v.isNotNull())


def processable(assets: Column, bands: list[str]) -> Column:
    """Every band has at least one usable asset; assets is an array of (band, ok)."""
    return F.forall(F.array(*map(F.lit, bands)), lambda b: F.exists(assets, lambda a: (a["band"] == b) & a["ok"]))


def pixel_centre(left: float, top: float, size: float, r: Column, c: Column) -> tuple[Column, Column]:
    return F.lit(left) + (c + 0.5) * size, F.lit(top) - (r + 0.5) * size


def least_pixels(hectares: Column, pixel: float = 0.04) -> Column:
    return F.ceil(hectares / F.lit(pixel) - 1e-12)


def rounded_points(points: Column, digits: int) -> Column:
    """Array of (x, y) with rounded members and no negative zero."""
    return F.transform(points, lambda p: F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y")))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y), positive if counter-clockwise."""
    steps = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / 2


def overview_levels(size: Column, least: int = 128) -> Column:
    """Factors 2, 4, ... while the larger side at that factor is at least `least`."""
    powers = F.array(*[F.lit(1 << i) for i in range(1, 21)])
    return F.filter(powers, lambda f: size / f >= least)


def within(path: Column, roots: list[str]) -> Column:
    """The path is one of the roots or lies below one."""
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root.rstrip("/") + "/")
    return out


def _series(kind: str) -> list[float]:
    n = FLATTENING / (2 - FLATTENING)
    return {
        "forward": [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240],
        "back": [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480],
        "latitude": [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15],
    }[kind]


def _radius() -> float:
    n = FLATTENING / (2 - FLATTENING)
    return SCALE * SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees, northern half, by the Krueger series to third order."""
    n = FLATTENING / (2 - FLATTENING)
    k = 2 * sqrt(n) / (1 + n)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan(t / F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    a = list(enumerate(_series("forward"), 1))
    east = eta + _sum([v * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, v in a])
    north = xi + _sum([v * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, v in a])
    return FALSE_EASTING + _radius() * east, _radius() * north


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; the inverse of to_utm."""
    xi, eta = north / _radius(), (east - FALSE_EASTING) / _radius()
    b = list(enumerate(_series("back"), 1))
    x = xi - _sum([v * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, v in b])
    y = eta - _sum([v * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, v in b])
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + _sum([v * F.sin(2 * j * chi) for j, v in enumerate(_series("latitude"), 1)])
    return F.lit(6 * zone - 183) + F.degrees(F.atan(F.sinh(y) / F.cos(x))), F.degrees(lat)
