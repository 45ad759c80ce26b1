"""Expressions on records for delivery and on their checks: finite values, rounding, labels, charts, paths in documents, annual outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import finite

# Labels by coverage class, canonical names that no variant may take, files and fields of an annual output.
COVERAGE_LABELS = {"GOOD": ("Good coverage", "Good"), "USABLE_WITH_COVERAGE_FLAG": ("Partial coverage", "Partial"), "POOR": ("Poor coverage", "Poor")}
CANONICAL_VARIANTS = ("canonical", "rgb-web", "rgb-reflectance")
ANNUAL_FILES = ("nbr", "ndvi", "valid_count", "summary")
#: Largest part of the area, in percent, that rounded outlines may lose or gain in all and one by one; decimals that are tried in turn.
TOTAL_AREA_LIMIT, FEATURE_AREA_LIMIT, DECIMALS = 0.1, 0.5, (5, 6)
SAME_PICTURE = 12


def rounded_number(x: Column, digits: int, name: str) -> Column:
    """x rounded; null stays, NaN and infinities are errors."""
    wrong = F.raise_error(F.lit(f"{name} contains NaN or Infinity")).cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).when(finite(x), F.round(x.cast("double"), digits) + F.lit(0.0)).otherwise(wrong)


def all_finite(values: Column) -> Column:
    """Whether no member of an array of numbers is NaN or infinite; nulls are fine."""
    return F.forall(values, lambda x: x.isNull() | finite(x))


def coordinate_count(rings: Column) -> Column:
    """Positions of an array of rings."""
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + F.size(ring)).cast("long")


def coverage_label(status: Column, short: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for name, labels in COVERAGE_LABELS.items():
        out = F.when(status == name, labels[short]).otherwise(out)
    return out


def fixed(x: Column, digits: int) -> Column:
    """A double with one decimal or more as C's printf writes it: its exact binary value is rounded, ties to even. Null stays.

    format_string() rounds the shortest decimal text, ties up. Here the fraction times the scale is a product and its
    exact error (Dekker), so a tie is told from what lies beside it. From 2^63 on there is no fraction.
    """
    x, scale = x.cast("double"), 10.0**digits
    a = F.abs(x)
    whole = F.floor(a)
    part = a - whole
    product, spread = part * scale, part * 134217729.0
    high = spread - (spread - part)
    error = (high * scale - product) + (part - high) * scale
    down = F.floor(product)
    left = product - down
    up = (left > 0.5) | ((left == 0.5) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    n = down + F.when(up, 1).otherwise(0)
    full = n == int(scale)
    shown = F.concat((whole + F.when(full, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad(F.when(full, 0).otherwise(n).cast("string"), digits, "0"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(a < 2.0**63, F.concat(sign, shown)).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def recovery_text(value: Column) -> Column:
    return F.concat(fixed(value, 2), F.lit("×"))


def year_path(prefix: str, year: Column, suffix: str, known: Column) -> Column:
    """prefix/year suffix of a known year; any other is an error."""
    path = F.concat(F.lit(f"{prefix}/"), year.cast("string"), F.lit(suffix))
    return F.when(known, path).otherwise(F.raise_error(F.concat(F.lit("no such year: "), year.cast("string"))).cast("string"))


def chart_x(place: Column, n: int, left: float, width: float) -> Column:
    return F.lit(left) + place / F.lit(float(n - 1)) * width


def chart_y(value: Column, low: Column, high: Column, top: float, bottom: float) -> Column:
    return F.lit(bottom) - (value - low) / (high - low) * (bottom - top)


def variant_tag(variant: Column) -> Column:
    """File tag of a display variant: null for a name that isn't one or that is canonical; `candidate-` becomes w."""
    ok = variant.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~variant.isin(*CANONICAL_VARIANTS)
    return F.when(ok, F.regexp_replace(variant, "^candidate-", "w"))


def missing_path(document: Column, path: str) -> Column:
    """Whether a path of keys leads nowhere in a JSON text; a null at its end is there."""
    return F.isnull(F.variant_get(F.try_parse_json(document), f"$.{path}", "variant"))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold or can't be told, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def annual_state(n_files: Column, missing: Column, problems: Column) -> Column:
    """MISSING without any file, INVALID if a required one is missing or anything else is wrong, else COMPLETE."""
    return F.when(n_files == 0, "MISSING").when((F.size(missing) > 0) | (F.size(problems) > 0), "INVALID").otherwise("COMPLETE")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    radius = 6378137.0
    return F.radians(lon) * radius, F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * radius


def snapped(low: Column, high: Column, size: float) -> tuple[Column, Column, Column]:
    """(start, end, cells) of an extent widened to multiples of size."""
    a, b = F.floor(low / size) * F.lit(size), F.ceil(high / size) * F.lit(size)
    return a, b, F.rint((b - a) / size).cast("long")
