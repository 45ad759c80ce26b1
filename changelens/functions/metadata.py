"""Expressions on scene metadata: band aliases, tiles, media types, byte ranges, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed aliases by required band.
BAND_ALIASES = {
    "blue": ("blue", "b02", "b2"), "green": ("green", "b03", "b3"), "red": ("red", "b04", "b4"), "nir": ("nir", "b08", "b8"), "swir2": ("swir2", "swir22", "b12"),
    "scl": ("scl", "sceneclassification", "sceneclassificationmap"),
}
RENDERINGS = ("visual", "visualjp2", "preview", "thumbnail")


def normalised(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def band_of(key: Column, texts: Column) -> Column:
    """Required band of an asset: by key, else, unless it is a rendering, by its texts, else by a scene classification among them."""
    k = normalised(key)
    by_key = F.lit(None).cast("string")
    by_text = F.lit(None).cast("string")
    clean = F.transform(F.filter(texts, lambda t: t.isNotNull() & (t != "")), normalised)
    among = lambda names: F.exists(clean, lambda t: t.isin(*names))
    for band, names in reversed(BAND_ALIASES.items()):
        by_key = F.when(k.isin(*names), band).otherwise(by_key)
        by_text = F.when(among(names), band).otherwise(by_text)
    by_text = F.coalesce(by_text, F.when(F.array_join(clean, " ").contains("sceneclassification"), "scl"))
    return F.coalesce(by_key, F.when(~k.isin(*RENDERINGS), by_text))


def cog_likely(media_type: Column, href: Column) -> Column:
    t, h = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.coalesce(href, F.lit("")))
    return t.contains("cloud-optimized") | t.contains("cloud_optimized") | (t.contains("image/tiff") & (h.endswith(".tif") | h.endswith(".tiff")))


def mgrs_tile(direct: Column, zone: Column, band: Column, square: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(direct), F.concat(some(zone), some(band), some(square)))


def object_id(n: Column) -> Column:
    return F.format_string("disturbance-%03d", n)


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end) inclusive of a `bytes=` range over `size` bytes, white space around it left out; null where it can't be satisfied."""
    header = F.trim(header)
    first = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).try_cast("long")
    last = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).try_cast("long")
    start = F.when(first.isNotNull(), first).otherwise(F.greatest(size - last, F.lit(0)))
    end = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    ok = (first.isNotNull() | (last > 0)) & (start < size) & (start <= end)
    return F.when(ok, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def human_bytes(n: Column) -> Column:
    x = n.cast("double")
    return F.when(x < 1024, F.format_string("%d B", n)).when(x < 1024**2, F.format_string("%.1f KiB", x / 1024)).when(x < 1024**3, F.format_string("%.1f MiB", x / 1024**2)).otherwise(F.format_string("%.1f GiB", x / 1024**3))
