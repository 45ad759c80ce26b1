"""Queries by operator. Observations are line items: a part is a cell, a ship date an acquisition, a supplier a tile."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metadata as M
from ..operators import cells as O

PRE, POST, LEAST = 1995, 1996, 3
#: Hectares of the patch sweep on this small grid; the operator's own are O.PATCH_SWEEP.
PATCH_SWEEP = (0.04, 0.08, 0.12, 0.2)
YEARS = tuple(range(1995, 2002))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6) + F.lit(0.0)  # no negative zero


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def width(spark: SparkSession, sf: str) -> int:
    return ceil(sqrt(table(spark, sf, "part").count()))


def aoi(w: int) -> Callable[[Column, Column], Column]:
    return lambda r, c: (r >= 1) & (r < w - 1) & (c >= 1) & (c < w - 1)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    w = width(spark, sf)
    cell = F.col("l_partkey") - 1
    return table(spark, sf, "lineitem").select(
        F.expr(f"(l_partkey - 1) div {w}").alias("r"), (cell % w).alias("c"), F.year("l_shipdate").alias("y"), F.to_date("l_shipdate").alias("d"), F.col("l_suppkey").alias("tile"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 12).alias("scl"),
        (F.col("l_quantity") * 0.02).cast("float").alias("nir"), (F.col("l_discount") * 5 - 0.05).cast("float").alias("swir2"), (F.col("l_tax") * 5 - 0.05).cast("float").alias("red"),
    )


def indices(spark: SparkSession, sf: str, treatment: str = "reject") -> DataFrame:
    ok = C.scl_valid(F.col("scl"))
    return obs(spark, sf).withColumns({"nbr": C.normalised_difference(F.col("nir"), F.col("swir2"), ok, treatment), "ndvi": C.normalised_difference(F.col("nir"), F.col("red"), ok, treatment)})


def annual(spark: SparkSession, sf: str, treatment: str = "reject") -> DataFrame:
    mosaic = O.first_valid(indices(spark, sf, treatment), ["y", "d", "r", "c"], ["nbr", "ndvi"], ["tile", "item"])
    return O.temporal_median(mosaic, ["y", "r", "c"], ["nbr", "ndvi"])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One aggregate instead of a self-join: pre and post of each cell."""
    a = annual(spark, sf).filter(F.col("y").isin(PRE, POST))
    out = a.groupBy("r", "c").agg(F.max(F.when(F.col("y") == PRE, F.col("nbr"))).alias("pre"), F.max(F.when(F.col("y") == POST, F.col("nbr"))).alias("post"))
    return out.withColumn("dnbr", F.col("pre") - F.col("post"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).filter(C.candidate(F.col("pre"), F.col("dnbr")))


def objects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cells of retained components with stable labels, and one row a component."""
    cells = O.keep_large(O.components(candidates(spark, sf), width(spark, sf)), LEAST, ["root"])
    stats = O.relabel(O.object_statistics(cells, ["root"]))
    return cells.join(stats.select("root", "label"), "root"), stats


def object_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every object cell in every year, observed or not."""
    cells, _ = objects(spark, sf)
    # The years of the observations, of which there are few whatever the number of rows.
    seen = [r["y"] for r in table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).distinct().orderBy("y").collect()]
    years = cells.select("label", "r", "c", "pre", "post", F.explode(F.array(*map(F.lit, seen))).alias("y"))
    now = annual(spark, sf).select("y", "r", "c", "nbr", "ndvi")
    out = years.join(now, ["y", "r", "c"], "left")
    return out.withColumn("recovery", C.recovery_ratio(F.col("pre"), F.col("post"), F.col("nbr")))


def object_years(spark: SparkSession, sf: str, by: tuple[str, ...] = ("label", "y")) -> DataFrame:
    v = F.col("recovery").cast("double")
    n, rec = F.count("nbr"), F.count("recovery")
    p = lambda x: F.percentile(F.col(x).cast("double"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), rec)
    total, seen = F.count("*"), F.count("ndvi")
    out = object_cells(spark, sf).groupBy(*by).agg(
        total.alias("total"), n.alias("nbr_count"), (n / total).alias("nbr_fraction"), rec.alias("recovery_count"), (rec / total).alias("recovery_fraction"), seen.alias("ndvi_count"), (seen / total).alias("ndvi_fraction"),
        F.avg(F.col("nbr").cast("double")).alias("nbr_mean"), p("nbr").alias("_nbr"), F.avg(v).alias("recovery_mean"), F.min(v).alias("recovery_min"), F.max(v).alias("recovery_max"), p("recovery").alias("_recovery"), p("ndvi").alias("_ndvi"),
        share(v < 0).alias("f_lt_0"), share(v >= 0).alias("f_ge_0"), share(v >= 0.5).alias("f_ge_050"), share(v >= 0.8).alias("f_ge_080"), share(v >= 1).alias("f_ge_100"), share(v > 1).alias("f_gt_100"),
    )
    out = out.withColumns({f"{x}_{q}": F.col(f"_{x}")[i] for x in ("nbr", "recovery", "ndvi") for i, q in enumerate(("p10", "median", "p90"))}).drop("_nbr", "_recovery", "_ndvi")
    out = out.withColumns({"area_ha": C.hectares(F.col("total")), "nbr_valid_ha": C.hectares(F.col("nbr_count")), "nbr_missing_ha": C.hectares(F.col("total") - F.col("nbr_count"))})
    out = out.withColumn("status", F.when(F.col("recovery_count") == 0, "POOR").otherwise(C.coverage_class(F.col("nbr_fraction"))))
    return out.withColumn("reporting_recommended", F.col("status") != "POOR")


@query
def nbr_P3(spark, sf):
    return indices(spark, sf).select("item", r6("nbr").alias("nbr"), r6("ndvi").alias("ndvi"))


@query
def validity_stages_P6(spark, sf):
    v = C.validity(F.col("nir"), F.col("swir2"), C.scl_valid(F.col("scl")))
    flags = ("source_valid", "negative_present", "negative_rejected", "before_denominator", "denominator_failure", "final_valid")
    used = {k: r6(v[k]) for k in ("first_used", "second_used")} | {"denominator": r6(v["first_used"] + v["second_used"])}
    return obs(spark, sf).select("item", *[v[k].alias(k) for k in flags], v["before_denominator"].alias("physical_valid"), *[x.alias(k) for k, x in used.items()])


@query
def treatments_P5(spark, sf):
    ok = C.scl_valid(F.col("scl"))
    return obs(spark, sf).select("item", *[r6(C.normalised_difference(F.col("nir"), F.col("swir2"), ok, t)).alias(t.replace("-", "_")) for t in C.TREATMENTS])


@query
def scale_offset_P1(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(C.scaled(F.col("l_quantity"), F.when(F.col("l_linenumber") % 3 != 0, F.lit(0.0001)), F.when(F.col("l_linenumber") % 2 == 0, F.lit(-0.1)))).alias("value"))


@query
def scl_filter_F1(spark, sf):
    return obs(spark, sf).filter(C.scl_valid(F.col("scl"))).groupBy("y", "scl").agg(F.count("*").alias("n")).select(F.col("y").cast("long").alias("y"), "scl", "n")


@query
def mosaic_first_valid_A3(spark, sf):
    return O.first_valid(indices(spark, sf), ["d", "r", "c"], ["nbr"], ["tile", "item"]).select(F.date_format("d", "yyyy-MM-dd").alias("d"), "r", "c", r6("nbr").alias("nbr"))


@query
def annual_median_A1(spark, sf):
    return rounded(annual(spark, sf))


@query
def dnbr_P7(spark, sf):
    return rounded(pairs(spark, sf).filter("dnbr is not null"))


@query
def area_ge_A8(spark, sf):
    n = F.count_if(F.col("dnbr") >= C.f32(0.2))
    return pairs(spark, sf).agg(n.alias("pixels"), F.round(C.hectares(n), 6).alias("hectares"))


@query
def threshold_grid_J14(spark, sf):
    cross = spark.createDataFrame([(b, t) for b in (0.2, 0.3, 0.4) for t in (0.1, 0.2, 0.3)], "baseline double, threshold double")
    hit = (F.col("pre") > F.col("baseline").cast("float")) & (F.col("dnbr") >= F.col("threshold").cast("float"))
    return pairs(spark, sf).join(F.broadcast(cross)).groupBy("baseline", "threshold").agg(F.count_if(hit).alias("pixels"))


@query
def distribution_A5(spark, sf):
    at = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return rounded(O.distribution(annual(spark, sf), F.col("nbr"), at, ["y"]))


@query
def wide_distribution_A6(spark, sf):
    return rounded(O.distribution(annual(spark, sf, "preserve"), F.col("nbr"), {"p001": 0.001, "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}, ["y"]))


@query
def valid_count_dist_A7(spark, sf):
    w = width(spark, sf)
    cells = spark.range(w * w).select(F.expr(f"id div {w}").alias("r"), (F.col("id") % w).alias("c")).filter(aoi(w)(F.col("r"), F.col("c")))
    n = F.coalesce(F.col("nbr_count"), F.lit(0))
    counts = annual(spark, sf).select("y", "r", "c", "nbr_count")
    every = cells.join(F.broadcast(counts.select("y").distinct()))
    p = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = every.join(counts, ["y", "r", "c"], "left").groupBy("y").agg(F.min(n).alias("min"), p.alias("p"), F.max(n).alias("max"), F.count_if(n == 0).alias("zero_count"), F.count("*").alias("cells"))
    return rounded(out.select("y", "min", *[F.col("p")[i].alias(k) for i, k in enumerate(("p25", "median", "p75"))], "max", "zero_count", "cells"))


@query
def candidate_F2(spark, sf):
    return rounded(candidates(spark, sf))


def _components(connectivity):
    def run(spark, sf):
        return O.components(candidates(spark, sf), width(spark, sf), connectivity).select("r", "c", "root")

    return run


QUERIES["components_8_W6"] = _components(8)
QUERIES["components_4_W6"] = _components(4)


@query
def component_filter_F8(spark, sf):
    return O.keep_large(O.components(candidates(spark, sf), width(spark, sf)), LEAST, ["root"]).select("r", "c", "root")


@query
def object_stats_A10(spark, sf):
    _, stats = objects(spark, sf)
    return rounded(stats.withColumn("disturbance_id", M.object_id(F.col("label"))).drop("label"))


@query
def relabel_W1(spark, sf):
    _, stats = objects(spark, sf)
    return stats.select("root", F.col("label").cast("long").alias("label"))


@query
def boundary_touch_F9(spark, sf):
    w = width(spark, sf)
    return O.boundary_touch(O.components(candidates(spark, sf), w), ["root"], aoi(w), w, w)


@query
def sensitivity_A31(spark, sf):
    runs = [("dnbr", 0.3, t, LEAST) for t in O.CHANGE_SWEEP] + [("baseline", b, 0.3, LEAST) for b in O.BASELINE_SWEEP] + [("patch", 0.3, 0.3, ceil(h / C.PIXEL_HECTARES - 1e-12)) for h in PATCH_SWEEP]
    params = spark.createDataFrame([(i, *x) for i, x in enumerate(runs)], "run int, what string, baseline double, threshold double, least int")
    hit = (F.col("pre") > F.col("baseline").cast("float")) & (F.col("dnbr") >= F.col("threshold").cast("float"))
    cells = pairs(spark, sf).join(F.broadcast(params)).filter(hit).select("run", "least", "r", "c")
    sizes = O.components(cells, width(spark, sf), 8, ["run"]).groupBy("run", "least", "root").agg(F.count("*").alias("n"))
    big = F.when(F.col("n") >= F.col("least"), F.col("n"))
    done = sizes.groupBy("run").agg(F.count("*").alias("raw"), F.sum("n").alias("raw_pixels"), F.count(big).alias("retained"), F.sum(big).alias("pixels"), F.max(big).alias("largest"))
    out = params.join(done, "run", "left").select(F.col("run").cast("long").alias("run"), "what", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("raw", "raw_pixels", "retained", "pixels", "largest")])
    return out.withColumn("retained_ha", r6(C.hectares(F.col("pixels"))))


@query
def recovery_P8(spark, sf):
    return rounded(object_cells(spark, sf).select("label", "y", "r", "c", "recovery"))


@query
def object_year_A11(spark, sf):
    return rounded(object_years(spark, sf))


@query
def landscape_year_A12(spark, sf):
    return rounded(object_years(spark, sf, ("y",)))


@query
def status_by_year_A17(spark, sf):
    s = F.col("status")
    return rounded(object_years(spark, sf).groupBy("y").agg(F.count_if(s == "GOOD").alias("good"), F.count_if(s == "USABLE_WITH_COVERAGE_FLAG").alias("usable"), F.count_if(s == "POOR").alias("poor"), F.median("nbr_fraction").alias("median_fraction"), F.min("nbr_fraction").alias("min_fraction"), F.count_if(F.col("nbr_count") == 0).alias("zero_valid")))


@query
def status_matrix_A21(spark, sf):
    code = F.when(F.col("status") == "GOOD", 2).when(F.col("status") == "POOR", 0).otherwise(1)
    m = object_years(spark, sf).groupBy("label").pivot("y", list(YEARS)).agg(F.first(code))
    return m.select(F.col("label").cast("long").alias("label"), *[F.col(str(y)).cast("long").alias(f"y{y}") for y in YEARS])


@query
def completeness_C1(spark, sf):
    return object_years(spark, sf).select(M.object_id(F.col("label")).alias("disturbance_id"), F.col("y").cast("long").alias("year"), C.coverage_class(F.col("nbr_fraction")).alias("category"), r6("nbr_fraction").alias("valid_fraction"))


@query
def denominator_diag_A15(spark, sf):
    cells, _ = objects(spark, sf)
    return rounded(O.denominators(cells))


def flags(spark, sf, by: str) -> DataFrame:
    """The observation flags of each cell of the area, united over the observations of a year or a date."""
    united = O.observation_flags(F.col("nir"), F.col("red"), F.col("swir2"), C.scl_valid(F.col("scl")))
    inside = aoi(width(spark, sf))(F.col("r"), F.col("c"))
    return obs(spark, sf).filter(inside).groupBy(by, "r", "c").agg(*[F.bool_or(x).alias(k) for k, x in united.items()])


@query
def union_flags_A4(spark, sf):
    return flags(spark, sf, "y").groupBy("y").agg(*[F.count_if(k).alias(k) for k in O.FLAGS]).withColumn("y", F.col("y").cast("long"))


@query
def missingness_A28(spark, sf):
    """Shares by year and reason: the totals are sums over the counts, which are a few rows a year."""
    reason = O.missing_reason(F.col("nbr_valid"), F.col("scl_valid"), F.col("source_valid_nir") & F.col("source_valid_swir2"), F.col("nbr_before_denominator"), F.col("nbr_denominator_failure"))
    n = flags(spark, sf, "y").groupBy(F.col("y").cast("long").alias("y"), reason.cast("long").alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(C.percentage(F.col("n"), F.sum("n").over(Window.partitionBy("y"))), 6))


@query
def date_breakdown_A29(spark, sf):
    total = max(width(spark, sf) - 2, 0) ** 2
    g = flags(spark, sf, "d").groupBy(F.date_format("d", "yyyy-MM-dd").alias("d")).agg(*[F.count_if(k).alias(k) for k in O.FLAGS[:16]])
    return g.select("d", F.lit(total).cast("long").alias("aoi"), *O.FLAGS[:16], *[F.round(C.percentage(F.col(k), F.lit(total)), 6).alias(f"{k}_pct") for k in O.FLAGS[:16]])


@query
def rescue_A30(spark, sf):
    """What keeping negative reflectance would add: gained cells a year, their shares and what would still be missing. One pass for both treatments."""
    ok, total = C.scl_valid(F.col("scl")), max(width(spark, sf) - 2, 0) ** 2
    now, then = (C.normalised_difference(F.col("nir"), F.col("swir2"), ok, t).isNotNull() for t in ("reject", "preserve"))
    inside = aoi(width(spark, sf))(F.col("r"), F.col("c"))
    cells = obs(spark, sf).filter(inside).groupBy("y", "r", "c").agg(F.bool_or(now).alias("now"), F.bool_or(then).alias("then"))
    n = cells.groupBy(F.col("y").cast("long").alias("y")).agg(F.count_if("now").alias("valid"), F.count_if(F.col("then") & ~F.col("now")).alias("gained"))
    missing = F.lit(total).cast("long") - F.col("valid")
    return n.select("y", "valid", "gained", r6(C.percentage(F.col("gained"), F.lit(total))).alias("pct_aoi"), r6(C.percentage(F.col("gained"), missing)).alias("pct_missing"), (missing - F.col("gained")).alias("remaining"))


@query
def variant_difference_A23(spark, sf):
    ok = C.scl_valid(F.col("scl"))
    rows = obs(spark, sf).select("y", C.normalised_difference(F.col("nir"), F.col("swir2"), ok, "preserve").alias("a"), C.normalised_difference(F.col("nir"), F.col("swir2"), ok, "clamp-zero").alias("b"))
    return rounded(O.pairwise_difference(rows, "a", "b", ["y"]))


@query
def extremes_F12(spark, sf):
    x = F.col("nbr")
    return rounded(indices(spark, sf, "preserve").groupBy("y").agg(F.count_if(x < -1).alias("lt_m1"), F.count_if(x > 1).alias("gt_1"), *[F.count_if(F.abs(x) > k).alias(f"abs_gt_{k}") for k in (1, 2, 5, 10)]))


@query
def largest_five_O4(spark, sf):
    _, stats = objects(spark, sf)
    return stats.orderBy("label").limit(5).select(F.col("label").cast("long").alias("label"), "pixel_count")


@query
def common_intersect_U3(spark, sf):
    a = annual(spark, sf).filter("nbr is not null")
    return a.filter(F.col("y") == PRE).select("r", "c").intersect(a.filter(F.col("y") == POST).select("r", "c"))


@query
def lost_except_U2(spark, sf):
    a = annual(spark, sf).filter("nbr is not null")
    return a.filter(F.col("y") == PRE).select("r", "c").subtract(a.filter(F.col("y") == POST).select("r", "c"))


@query
def gained_lost_U4(spark, sf):
    return pairs(spark, sf).agg(F.count_if(F.expr("pre is null and post is not null")).alias("gained"), F.count_if(F.expr("pre is not null and post is null")).alias("lost"), F.count_if(F.expr("pre is not null and post is not null")).alias("kept"))


@query
def segments_W3(spark, sf):
    rows = object_years(spark, sf).select("label", "y", "status", "recovery_median")
    got = O.trusted_segments(rows, "label", "y", (F.col("status") != "POOR") & F.col("recovery_median").isNotNull())
    return got.select(F.col("label").cast("long").alias("label"), F.col("y").cast("long").alias("y"), F.col("segment").cast("long").alias("segment"))


@query
def domain_A36(spark, sf):
    lo = F.least(F.lit(0.0), F.min(F.least("recovery_p10", "recovery_median", "recovery_p90")))
    hi = F.greatest(F.lit(1.0), F.max(F.greatest("recovery_p10", "recovery_median", "recovery_p90")))
    pad = F.greatest(F.lit(0.08), (hi - lo) * 0.1)
    return object_years(spark, sf).groupBy(F.col("label").cast("long").alias("label")).agg(r6(lo - pad).alias("low"), r6(hi + pad).alias("high"))


@query
def upsert_K13(spark, sf):
    a = annual(spark, sf).groupBy("y").agg(F.count("nbr").alias("n")).select(F.col("y").cast("long").alias("y"), "n")
    return O.upsert(a, a.filter("y >= 2000").select("y", (F.col("n") + 1).alias("n")), ["y"])


@query
def rgb_median_A2(spark, sf):
    rows = obs(spark, sf).filter(C.scl_valid(F.col("scl")))
    return rounded(O.temporal_median(rows, ["y", "r", "c"], ["red", "nir", "swir2"]).select("y", "r", "c", "red", "nir", "swir2"))


@query
def display_transform_P10(spark, sf):
    return obs(spark, sf).select("item", *[C.display(F.col(x)).cast("long").alias(x) for x in ("red", "nir", "swir2")])


@query
def all_white_P12(spark, sf):
    v = [C.display(F.col(x), white=0.1) for x in ("red", "nir", "swir2")]
    ok = C.scl_valid(F.col("scl"))
    white = ok & (v[0] == 255) & (v[1] == 255) & (v[2] == 255)
    return obs(spark, sf).groupBy(F.col("y").cast("long").alias("y")).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("nodata"), F.count_if(white).alias("remapped"))


@query
def tonal_A22(spark, sf):
    rows = obs(spark, sf).filter(C.scl_valid(F.col("scl"))).unpivot("y", ["red", "nir", "swir2"], "channel", "v")
    return rounded(rows.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("v") <= C.f32(0.01)).alias("low"), F.count_if(F.col("v") >= C.f32(0.3)).alias("high"), F.median(F.col("v").cast("double")).alias("median"), F.percentile(F.col("v").cast("double"), F.lit(0.98)).alias("p98")))


@query
def colour_dnbr_P36(spark, sf):
    v = F.col("v")
    return pairs(spark, sf).select("r", "c", F.col("dnbr").cast("double").alias("v")).select("r", "c", *[x.cast("long").alias(k) for k, x in C.change_colour(v).items()])


@query
def colour_recovery_P36(spark, sf):
    return object_cells(spark, sf).select("y", "r", "c", F.col("recovery").cast("double").alias("v")).select(F.col("y").cast("long").alias("y"), "r", "c", *[x.cast("long").alias(k) for k, x in C.recovery_colour(F.col("v")).items()])


@query
def mgrs_P24(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    tile = M.mgrs_tile(F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))), F.when(k % 5 != 0, (k % 60).cast("string")), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("V")), F.lit("WE"))
    return s.select("s_suppkey", tile.alias("tile"))


@query
def range_S19(spark, sf):
    k = F.col("c_custkey")
    header = F.when(k % 4 == 0, F.concat(F.lit("bytes="), k, F.lit("-"))).when(k % 4 == 1, F.concat(F.lit("bytes=-"), k)).when(k % 4 == 2, F.concat(F.lit("bytes="), k, F.lit("-"), k + 50)).otherwise(F.lit("items=0-1"))
    got = M.byte_range(header, F.lit(500).cast("long"))
    return table(spark, sf, "customer").select("c_custkey", got["start"].alias("start"), got["end"].alias("end"))


@query
def timeseries_json_K9(spark, sf):
    row = F.struct(F.col("y").alias("year"), F.col("nbr_count").alias("n"), F.col("status").alias("status"))
    g = object_years(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(row)).alias("series"))
    return g.select(F.col("label").cast("long").alias("label"), F.to_json("series").alias("json"))
