"""Expressions on cell values: scaling, masks, indices, recovery, classes, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SCL_EXCLUDED = (0, 1, 3, 8, 9, 10, 11)
GOOD_COVERAGE, USABLE_COVERAGE = 0.95, 0.80
PIXEL_HECTARES = 0.04
TREATMENTS = ("reject", "preserve", "clamp-zero")


def f32(value: float) -> Column:
    return F.lit(value).cast("float")


def finite(x: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def scaled(dn: Column, scale: Column, offset: Column) -> Column:
    return (dn * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))).cast("float")


def scl_valid(scl: Column) -> Column:
    return ~F.coalesce(scl, F.lit(0)).isin(*SCL_EXCLUDED)


def validity(a: Column, b: Column, mask: Column, treatment: str = "reject") -> dict[str, Column]:
    """The stages by which a pair of bands becomes valid for a normalised difference."""
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}")
    source = finite(a) & finite(b) & mask
    negative = source & ((a < 0) | (b < 0))
    first, second = (F.greatest(a, f32(0)), F.greatest(b, f32(0))) if treatment == "clamp-zero" else (a, b)
    before = source & (a >= 0) & (b >= 0) if treatment == "reject" else source
    nonzero = finite(first + second) & (first + second != 0)
    false = F.lit(False)
    return {
        "source_valid": F.coalesce(source, false), "negative_present": F.coalesce(negative, false),
        "negative_rejected": F.coalesce(negative, false) if treatment == "reject" else false, "before_denominator": F.coalesce(before, false),
        "denominator_failure": F.coalesce(before & ~nonzero, false), "final_valid": F.coalesce(before & nonzero, false), "first_used": first, "second_used": second,
    }


def normalised_difference(a: Column, b: Column, mask: Column, treatment: str = "reject") -> Column:
    """(a - b) / (a + b) as FLOAT, null where not valid. The cast follows the division, which widens to DOUBLE."""
    v = validity(a, b, mask, treatment)
    return F.when(v["final_valid"], ((v["first_used"] - v["second_used"]) / (v["first_used"] + v["second_used"])).cast("float"))


def candidate(pre: Column, change: Column, baseline: float = 0.30, threshold: float = 0.30) -> Column:
    """Both finite, baseline strictly above and change at least its threshold, compared as FLOAT."""
    return F.coalesce(finite(pre) & finite(change) & (pre > f32(baseline)) & (change >= f32(threshold)), F.lit(False))


def recovery_ratio(pre: Column, post: Column, now: Column) -> Column:
    """Share of the loss that came back, unbounded; null unless all three are finite and the loss is positive."""
    a, b, c = (x.cast("double") for x in (pre, post, now))
    return F.when(finite(a) & finite(b) & finite(c) & (a - b > 0), ((c - b) / (a - b)).cast("float"))


def coverage_class(fraction: Column) -> Column:
    """A fraction that is null, NaN or infinite is an error."""
    wrong = F.raise_error(F.lit("a valid fraction must be finite")).cast("string")
    return F.when(~F.coalesce(finite(fraction), F.lit(False)), wrong).when(fraction >= GOOD_COVERAGE, "GOOD").when(fraction >= USABLE_COVERAGE, "USABLE_WITH_COVERAGE_FLAG").otherwise("POOR")


def hectares(pixels: Column) -> Column:
    return pixels * F.lit(PIXEL_HECTARES)


def percentage(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * n, total), F.lit(0.0))


def display(v: Column, black: float = 0.01, white: float = 0.30, gamma: float = 1.0) -> Column:
    """0 to 255 with rounding half to even; invalid is black."""
    x = F.least(F.greatest((F.greatest(v.cast("double"), F.lit(0.0)) - black) / (white - black), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.rint(F.pow(x, F.lit(1.0 / gamma)) * 255), F.lit(0.0)).cast("int")


def _ramp(v: Column, stops: tuple[tuple[float, tuple[int, int, int]], ...], channel: int) -> Column:
    out = F.when(v <= stops[0][0], stops[0][1][channel]).when(v >= stops[-1][0], stops[-1][1][channel])
    for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False):
        out = out.when(v <= hi, F.floor(a[channel] + (b[channel] - a[channel]) * ((v - lo) / (hi - lo)) + 0.5))
    return F.coalesce(out, F.lit(0)).cast("int")


# Fixed colour stops.
CHANGE_STOPS = ((-0.4, (0x52, 0x73, 0x6E)), (0.0, (0xB6, 0xB4, 0xA9)), (0.3, (0xD3, 0x9B, 0x48)), (0.6, (0xB6, 0x5D, 0x3F)), (1.0, (0x80, 0x35, 0x2D)))
RECOVERY_STOPS = ((0.0, (0x6B, 0x4C, 0x3B)), (0.5, (0xC7, 0xA6, 0x6B)), (1.0, (0x6F, 0xAA, 0xA1)), (1.5, (0x2F, 0x6F, 0x68)))
CHANGE_ALPHA = (34, 190, 228, 240)
RECOVERY_ALPHA = 232


def change_colour(v: Column) -> dict[str, Column]:
    quiet, threshold, strong, most = CHANGE_ALPHA
    alpha = (
        F.when(v.isNull(), 0).when(v <= 0, quiet).when(v <= 0.3, F.floor(quiet + (threshold - quiet) * (v / 0.3) + 0.5))
        .when(v <= 0.6, F.floor(threshold + (strong - threshold) * ((v - 0.3) / 0.3) + 0.5)).otherwise(F.floor(strong + (most - strong) * F.least((v - 0.6) / 0.4, F.lit(1.0)) + 0.5))
    )
    return {"red": _ramp(v, CHANGE_STOPS, 0), "green": _ramp(v, CHANGE_STOPS, 1), "blue": _ramp(v, CHANGE_STOPS, 2), "alpha": alpha.cast("int")}


def recovery_colour(v: Column) -> dict[str, Column]:
    return {"red": _ramp(v, RECOVERY_STOPS, 0), "green": _ramp(v, RECOVERY_STOPS, 1), "blue": _ramp(v, RECOVERY_STOPS, 2), "alpha": F.when(v.isNull(), 0).otherwise(RECOVERY_ALPHA).cast("int")}
