"""Operators on tables of cells: composites, change objects, recovery, diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as C
from .graph import connected_components, cut, partitions

# The sweeps of the sensitivity runs, the last in hectares.
CHANGE_SWEEP, BASELINE_SWEEP, PATCH_SWEEP = (0.25, 0.30, 0.35, 0.40), (0.20, 0.30, 0.40), (1.0, 2.0, 5.0, 10.0)
#: What observation_flags tells of an observation; the first 16 are counted by date.
FLAGS = (
    "scl_valid", "source_valid_nir", "source_valid_red", "source_valid_swir2", "scl_source_valid_nir", "scl_source_valid_red", "scl_source_valid_swir2", "negative_nir", "negative_red", "negative_swir2",
    "nbr_before_denominator", "nbr_denominator_failure", "nbr_valid", "ndvi_before_denominator", "ndvi_denominator_failure", "ndvi_valid", "nbr_valid_without_negative_rejection", "ndvi_valid_without_negative_rejection",
)
FORWARD = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}
#: Added to places that are compared as text, so that those before the grid's first cell have no sign; the sums have 19 digits.
_PLACE = 2**62


def first_valid(rows: DataFrame, by: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Per group the first non-null of each value in the given order; never an average. One map-side combined aggregate."""
    key = F.struct(*order)
    return rows.groupBy(*by).agg(*[F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), key)).alias(v) for v in values])


def temporal_median(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Exact medians as FLOAT with counts; nulls and NaN don't count, none at all gives null and 0."""
    known = {v: F.nanvl(F.col(v), F.lit(None).cast("float")) for v in values}
    return rows.groupBy(*by).agg(*[F.median(x).cast("float").alias(v) for v, x in known.items()], *[F.count(x).alias(f"{v}_count") for v, x in known.items()])


def distribution(rows: DataFrame, value: Column, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    v = value.cast("double")
    p = F.percentile(v, F.array(*[F.lit(x) for x in at.values()]))
    out = rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), p.alias("_p"))
    return out.select(*(by or []), "n", "min", "max", "mean", "std", *[F.col("_p")[i].alias(k) for i, k in enumerate(at)])


def observation_flags(nir: Column, red: Column, swir2: Column, mask: Column) -> dict[str, Column]:
    """The FLAGS of one observation, as it is judged and as it would be with negative reflectance kept."""
    bands = {"nir": nir, "red": red, "swir2": swir2}
    nbr, ndvi = C.validity(nir, swir2, mask), C.validity(nir, red, mask)
    out = {"scl_valid": mask} | {f"source_valid_{k}": C.finite(x) for k, x in bands.items()} | {f"scl_source_valid_{k}": mask & C.finite(x) for k, x in bands.items()}
    out |= {"negative_nir": nbr["negative_rejected"] | ndvi["negative_rejected"], "negative_red": ndvi["negative_rejected"], "negative_swir2": nbr["negative_rejected"]}
    for name, v, kept in (("nbr", nbr, C.validity(nir, swir2, mask, "preserve")), ("ndvi", ndvi, C.validity(nir, red, mask, "preserve"))):
        out |= {f"{name}_before_denominator": v["before_denominator"], f"{name}_denominator_failure": v["denominator_failure"], f"{name}_valid": v["final_valid"], f"{name}_valid_without_negative_rejection": kept["final_valid"]}
    return {k: out[k] for k in FLAGS}


def missing_reason(valid: Column, masked: Column, source: Column, before: Column, failed: Column) -> Column:
    """0 for a valid cell, else the first that holds: 1 never clear, 2 never a source value, 3 always rejected as negative, 4 no index, 5 other."""
    return F.when(valid, 0).when(~masked, 1).when(~source, 2).when(~before & ~failed, 3).when(before, 4).otherwise(5)


def denominators(cells: DataFrame, baseline: float = 0.30, least: float = 0.30) -> DataFrame:
    """One row on pre - post of retained cells (pre, post): counts, percentiles and what lies at the threshold."""
    pre, post = F.col("pre").cast("double"), F.col("post").cast("double")
    pair = C.finite(pre) & C.finite(post)
    d = F.when(pair, pre - post)
    p = F.percentile(d, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    out = cells.agg(
        F.count("*").alias("retained"), F.count(d).alias("pairs"), F.count_if(~F.coalesce(pair, F.lit(False))).alias("invalid_pairs"), F.count_if(pair & (pre <= baseline)).alias("baseline_violations"),
        F.min(d).alias("min"), p.alias("_p"), F.max(d).alias("max"), F.count_if(d <= 0).alias("non_positive"), F.count_if(d < least).alias("below"), F.count_if(d >= least).alias("at_least"),
        F.count_if(d == least).alias("exactly"), F.count_if((d < least) & (d >= least - 1e-7)).alias("just_below"), F.count_if(F.abs(d - least) <= 1e-6).alias("close"),
    )
    return out.withColumns({k: F.col("_p")[i] for i, k in enumerate(("p01", "median", "p99"))}).drop("_p")


def checked_denominators(cells: DataFrame, baseline: float = 0.30, least: float = 0.30) -> DataFrame:
    """denominators(), with an error for what the rule of retained cells excludes: an invalid pair, then a low baseline, then a small loss."""
    out = denominators(cells, baseline, least)
    wrong = (
        F.when(F.col("invalid_pairs") > 0, F.lit("retained cells have invalid pairs")).when(F.col("baseline_violations") > 0, F.lit("retained cells have too low a baseline"))
        .when(F.col("below") > 0, F.concat(F.col("below").cast("string"), F.lit(f" retained cells lose less than {least:g}")))
    )
    return out.withColumn("retained", F.when(wrong.isNull(), F.col("retained")).otherwise(F.raise_error(wrong).cast("long")))


def _tile_roots(r: np.ndarray, c: np.ndarray, connectivity: int) -> np.ndarray:
    """Of each cell of a tile the place in (r, c) order of the first cell of its component; repeated cells are one."""
    r, c = r - r.min(), c - c.min()
    across = int(c.max()) + 2
    key, own = np.unique(r * across + c, return_inverse=True)
    root = np.arange(len(key))
    ends = []
    for dr, dc in FORWARD[connectivity]:
        # The spare column keeps the last cell of a row apart from the first of the next.
        near = key + dr * across + dc
        at = np.minimum(np.searchsorted(key, near), len(key) - 1)
        hit = (key[at] == near) & (key % across + dc >= 0)
        ends.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    first = np.full(len(key), len(own))
    np.minimum.at(first, own, np.arange(len(own)))
    return first[root[own]]


def components(cells: DataFrame, width: int, connectivity: int = 8, extra: list[str] | None = None, tile: int = 256) -> DataFrame:
    """cells (r, c) with root, the smallest r * width + c of their component; `extra` columns keep runs apart.

    Each tile is labelled by itself, at most tile * tile cells at a time. Only cells at the edges of tiles then meet, by equi-joins with
    the shifted cells, and the graph of what they join, one node a component of a tile, gives the components of the whole.
    """
    extra = extra or []
    keys = [*extra, "_tr", "_tc"]
    dealt = cells.withColumns({"_tr": F.floor(F.col("r") / tile), "_tc": F.floor(F.col("c") / tile)})

    def label(t: pa.Table) -> pa.Table:
        r, c = (t.column(k).to_numpy().astype(np.int64) for k in ("r", "c"))
        at = _tile_roots(r, c, connectivity)
        return t.append_column("_root", pa.array((r * width + c)[at], pa.int64()))

    labelled = cut(dealt.groupBy(*keys).applyInArrow(label, T.StructType([*dealt.schema.fields, T.StructField("_root", T.LongType())])), "cells")
    node = F.concat_ws(":", *[F.col(e).cast("string") for e in extra], (F.col("_root") + F.lit(_PLACE)).cast("string")) if extra else F.col("_root")
    last = lambda x: F.pmod(F.col(x), F.lit(tile)).isin(0, tile - 1)
    edge = labelled.filter(last("r") | last("c")).select(*extra, "r", "c", "_tr", "_tc", node.alias("id")).distinct()
    shifted = edge.select(*extra, F.col("id").alias("a"), F.col("_tr").alias("_ar"), F.col("_tc").alias("_ac"), F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in FORWARD[connectivity]])).alias("s"))
    met = shifted.select(*extra, "a", "_ar", "_ac", "s.r", "s.c").join(edge.withColumnRenamed("id", "b"), [*extra, "r", "c"])
    roots = connected_components(met.filter("_ar != _tr or _ac != _tc").select("a", "b").distinct())
    out = labelled.withColumn("_id", node).join(roots, F.col("_id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "_id"))
    out = out.drop("_id", "node", "component", "_root", "_tr", "_tc")
    return out.withColumn("root", F.substring_index("root", ":", -1).cast("long") - F.lit(_PLACE)) if extra else out


def keep_large(labelled: DataFrame, least: int, by: list[str]) -> DataFrame:
    large = labelled.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return labelled.join(large, by, "left_semi")


def object_statistics(labelled: DataFrame, by: list[str]) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return labelled.groupBy(*by).agg(
        F.count("*").alias("pixel_count"), C.hectares(F.count("*")).alias("area_ha"), F.avg(F.col("c") + 0.5).alias("centroid_x"), F.avg(-(F.col("r") + 0.5)).alias("centroid_y"),
        F.avg(d("pre")).alias("pre_mean"), F.median(d("pre")).alias("pre_median"), F.avg(d("post")).alias("post_mean"), F.median(d("post")).alias("post_median"),
        F.avg(d("dnbr")).alias("dnbr_mean"), F.median(d("dnbr")).alias("dnbr_median"), F.percentile(d("dnbr"), F.lit(0.9)).alias("dnbr_p90"), F.max(d("dnbr")).alias("dnbr_max"),
    )


def relabel(objects: DataFrame) -> DataFrame:
    """Stable labels from 1 by area, largest first, centroid and root. The objects are one row a component.

    They are range-partitioned in that order and written; a label is the place in its partition and the count of the
    partitions before, of which there is one row each, so no task sorts all objects.
    """
    parts = partitions(objects.sparkSession)
    order = [F.desc("pixel_count"), F.round("centroid_x", 9), F.round("centroid_y", 9), F.asc("root")]
    dealt = objects.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_p": F.spark_partition_id()}), "objects")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("_p", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(before), "_p")
    return out.withColumn("label", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_at", "_p", "_first", "_before")


def boundary_touch(labelled: DataFrame, by: list[str], aoi: Column, width: int, height: int) -> DataFrame:
    """Whether any cell of a component has a neighbour, of 8, outside the area (r, c, aoi as a predicate of them) or the grid."""
    outside = F.lit(False)
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            r, c = F.col("r") + dr, F.col("c") + dc
            outside = outside | ~(aoi(r, c) & (r >= 0) & (r < height) & (c >= 0) & (c < width))
    return labelled.groupBy(*by).agg(F.bool_or(outside).alias("touches_boundary"))


def pairwise_difference(rows: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """Overlap, gains, losses and absolute differences of two value columns of one table."""
    a, b = F.col(left), F.col(right)
    diff = F.abs((b - a).cast("float").cast("double"))
    return rows.groupBy(*(by or [])).agg(
        F.count(a).alias("left_valid"), F.count(b).alias("right_valid"), F.count_if(a.isNotNull() & b.isNotNull()).alias("overlap"), F.count_if(a.isNull() & b.isNotNull()).alias("gained"),
        F.count_if(a.isNotNull() & b.isNull()).alias("lost"), F.count_if(diff > 1e-6).alias("changed"), F.avg(diff).alias("mean_abs"), F.median(diff).alias("median_abs"), F.percentile(diff, F.lit(0.95)).alias("p95_abs"), F.max(diff).alias("max_abs"),
    )


def trusted_segments(series: DataFrame, by: str, at: str, trusted: Column) -> DataFrame:
    """Gaps and islands: runs of trusted rows, numbered from 1 within each series; a series is one row a year."""
    w = W.partitionBy(by).orderBy(at)
    rows = series.withColumn("_ok", F.coalesce(trusted, F.lit(False)))
    rows = rows.withColumn("_new", F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False)))
    return rows.withColumn("segment", F.sum(F.col("_new").cast("int")).over(w)).filter("_ok").drop("_ok", "_new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)
