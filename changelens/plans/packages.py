"""Queries on metadata rules, resampling, stored products, packages and object diagnostics, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metadata as M
from ..functions import records as R
from ..functions import scenes as S
from ..operators import cells as O
from ..operators import polygons
from ..operators.graph import shared_path
from ..sources import catalog, config, rasters, sinks, tiff
from . import oracle
from .queries import LEAST, PRE, annual, aoi, candidates, object_cells, object_years, objects, obs, pairs, r6, rounded, table, width
from .records import _UTM, _grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle.compose(sql)
        return f

    return register


# Rules on metadata: inputs are made on both sides, the rules are applied on both


_ASSETS = [("Blue", None), ("B-03", None), ("b4", "x"), ("B08", ""), ("swir22", None), ("scene_classification", None), ("visual", "red"), ("x1", "Band B02"), ("thumb", "the Scene Classification map (20m)"), ("x2", "nir"), ("B12", None), ("preview", "B04")]
_ALIAS = " ".join(f"WHEN {{0}} IN ({', '.join(repr(n) for n in names)}) THEN '{band}'" for band, names in M.BAND_ALIASES.items())


@query(
    "WITH a(k, key, t) AS (VALUES " + ", ".join(f"({i}, '{k}', {'NULL' if t is None else repr(t)})" for i, (k, t) in enumerate(_ASSETS)) + "), n AS (SELECT k, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS key, regexp_replace(lower(nullif(t, '')), '[^a-z0-9]', '', 'g') AS t FROM a) "
    f"SELECT p_partkey, coalesce(CASE {_ALIAS.format('key')} END, CASE WHEN key NOT IN ('visual', 'visualjp2', 'preview', 'thumbnail') THEN coalesce(CASE {_ALIAS.format('t')} END, CASE WHEN contains(t, 'sceneclassification') THEN 'scl' END) END) AS band FROM part JOIN n ON k = p_partkey % 12"
)
def band_alias_P22(spark, sf):
    at = ((F.col("p_partkey") % 12) + 1).cast("int")
    key, text = (F.element_at(F.array(*[F.lit(x[i]) for x in _ASSETS]), at) for i in (0, 1))
    return table(spark, sf, "part").select("p_partkey", M.band_of(key, F.array(text)).alias("band"))


_TYPES = ("image/tiff; profile=Cloud-Optimized", "image/TIFF", "image/tiff", "image/jp2", "")
_ENDS = (".tif", ".TIFF", ".jp2")


@query("SELECT page_id, contains(lower(kind), 'cloud-optimized') OR contains(lower(kind), 'cloud_optimized') OR (contains(lower(kind), 'image/tiff') AND (lower(href) LIKE '%.tif' OR lower(href) LIKE '%.tiff')) AS cog FROM (SELECT page_id, ([" + ", ".join(map(repr, _TYPES)) + "])[page_id % 5 + 1] AS kind, url || ([" + ", ".join(map(repr, _ENDS)) + "])[page_id % 3 + 1] AS href FROM pages)")
def cog_likely_P23(spark, sf):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", M.cog_likely(pick(_TYPES), F.concat("url", pick(_ENDS))).alias("cog"))


@query("SELECT event_id, CAST(len(m) AS BIGINT) AS n, array_to_string(list_sort([x.v FOR x IN m]), ',') AS \"values\" FROM (SELECT event_id, [x FOR x IN [{'k': 'MGRS:zone', 'v': '33'}, {'k': 's2:mgrs_tile', 'v': CASE WHEN value > 20 THEN event_type END}, {'k': event_type || ':MgRs', 'v': nullif(CAST(user_id AS VARCHAR), '8')}, {'k': 'platform', 'v': props}] IF contains(regexp_replace(lower(x.k), '[^a-z0-9]', '', 'g'), 'mgrs') AND x.v IS NOT NULL] AS m FROM events)")
def property_filter_P25(spark, sf):
    tile, user = F.when(F.col("value") > 20, F.col("event_type")), F.nullif(F.col("user_id").cast("string"), F.lit("8"))
    props = F.create_map(F.lit("MGRS:zone"), F.lit("33"), F.lit("s2:mgrs_tile"), tile, F.concat("event_type", F.lit(":MgRs")), user, F.lit("platform"), F.col("props"))
    m = S.matching_keys(props, "mgrs")
    return table(spark, sf, "events").select("event_id", F.size(m).cast("long").alias("n"), F.array_join(F.array_sort(F.map_values(m)), ",").alias("values"))


_URLS = (" https://h//a/", "https://h/b///", "https://h/../", "https://h/./", "https://h/%2e%2e/", "https://u:p@h/", "https://h/a?x=", "http://h/", "https://h/a\\\\", "https://h/c%20d//")


@query("SELECT page_id, CASE WHEN starts_with(u, 'https://') AND NOT regexp_matches(u, '^https://[^/]*@') AND NOT regexp_matches(u, '[?#\\\\]') AND NOT regexp_matches(u, '/[.][.]?(/|$)') AND NOT regexp_matches(url_decode(u), '[?#\\\\]|/[.][.]?(/|$)') THEN 'https://' || regexp_replace(u[9:], '/+', '/', 'g') END AS url FROM (SELECT page_id, trim(([" + ", ".join(f"'{u}'" for u in _URLS).replace("\\\\", "\\") + "])[page_id % 10 + 1] || page_id) AS u FROM pages)")
def asset_url_P37(spark, sf):
    start = F.element_at(F.array(*[F.lit(u.replace("\\\\", "\\")) for u in _URLS]), (F.col("page_id") % 10 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", S.asset_url(F.concat(start, F.col("page_id"))).alias("url"))


@query("SELECT page_id, path = '/data/raw' OR starts_with(path, '/data/raw/') AS inside FROM (SELECT page_id, (['/data/raw', '/data/raw/', '/data/raw-', '/out/data/raw/', '/data/'])[page_id % 5 + 1] || CASE WHEN page_id % 2 = 0 THEN '' ELSE page_id::VARCHAR END AS path FROM pages)")
def path_guard_U8(spark, sf):
    k = F.col("page_id")
    start = F.element_at(F.array(*map(F.lit, ("/data/raw", "/data/raw/", "/data/raw-", "/out/data/raw/", "/data/"))), (k % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", S.within(F.concat(start, F.when(k % 2 == 0, "").otherwise(k.cast("string"))), ["/data/raw"]).alias("inside"))


@query("SELECT c_custkey, regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS ok FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '-' || c_name WHEN 1 THEN lower(c_mktsegment) || '_v1.0-b' WHEN 2 THEN c_name ELSE '' END AS s FROM customer)")
def variant_tag_P33(spark, sf):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, F.concat(F.lit("-"), F.col("c_name"))).when(k == 1, F.concat(F.lower("c_mktsegment"), F.lit("_v1.0-b"))).when(k == 2, F.col("c_name")).otherwise("")
    return table(spark, sf, "customer").select("c_custkey", S.tag_ok(s).alias("ok"))


@query("SELECT c_custkey, round(c_acctbal / 7, 5) + 0 AS x, round(-c_acctbal / 1e9::DOUBLE, 5) + 0 AS y, CAST(signbit(round(-c_acctbal / 1e9::DOUBLE, 5) + 0) AS BOOLEAN) AS negative FROM customer")
def coordinate_rounding_P20(spark, sf):
    p = F.array(F.struct((F.col("c_acctbal") / 7).alias("x"), (-F.col("c_acctbal") / 1e9).alias("y")))
    got = table(spark, sf, "customer").select("c_custkey", S.rounded_points(p, 5)[0].alias("p")).select("c_custkey", "p.x", "p.y")
    return got.withColumn("negative", F.col("y").cast("string").startswith("-"))


@query("SELECT y, count(*) AS items, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, min(scl * 9) AS cloud_min, round(median(scl * 9), 6) AS cloud_median, max(scl * 9) AS cloud_max, count(DISTINCT tile) AS tiles, bool_and(nir > 0.03::DOUBLE) AS all_nir, bool_and(nir > 0.01::DOUBLE) AS all_bands, count(*) FILTER (nir > 0.03::DOUBLE AND swir2 >= 0 AND red >= 0) AS complete, array_to_string(list_sort(list(DISTINCT scl)), ',') AS keys FROM obs GROUP BY y")
def discovery_summary_A18(spark, sf):
    """A year's items: dates, clouds, tiles, keys that occur, bands that all have, items that have all."""
    cloud = F.col("scl") * 9
    done = (F.col("nir") > 0.03) & (F.col("swir2") >= 0) & (F.col("red") >= 0)
    g = obs(spark, sf).groupBy("y").agg(
        F.count("*").alias("items"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"), F.min(cloud).alias("cloud_min"), F.median(cloud).alias("cloud_median"), F.max(cloud).alias("cloud_max"),
        F.countDistinct("tile").alias("tiles"), F.bool_and(F.col("nir") > 0.03).alias("all_nir"), F.bool_and(F.col("nir") > 0.01).alias("all_bands"), F.count_if(done).alias("complete"), F.array_join(F.array_sort(F.collect_set("scl")), ",").alias("keys"),
    )
    return rounded(g)


@query("SELECT l_returnflag AS band, string_agg(DISTINCT printf('%.2f', l_tax) || ':' || printf('%.2f', l_discount), ',' ORDER BY printf('%.2f', l_tax) || ':' || printf('%.2f', l_discount)) AS pairs, count(DISTINCT (l_tax, l_discount)) AS n FROM lineitem GROUP BY 1")
def scale_pairs_A19(spark, sf):
    """The sorted set of scale and offset pairs of each band."""
    li = table(spark, sf, "lineitem")
    pair = F.concat(F.format_string("%.2f", "l_tax"), F.lit(":"), F.format_string("%.2f", "l_discount"))
    return li.groupBy(F.col("l_returnflag").alias("band")).agg(F.array_sort(F.collect_set(pair)).alias("p")).select("band", F.array_join("p", ",").alias("pairs"), F.size("p").cast("long").alias("n"))


@query("SELECT c_mktsegment, count(DISTINCT (c_nationkey % 3, c_custkey % 2)) = 1 AS aligned, count(DISTINCT c_nationkey // 25) = 1 AS coarse FROM customer GROUP BY 1")
def alignment_V7(spark, sf):
    """Whether all rasters of a group carry the same metadata, field by field."""
    k = F.col("c_custkey")
    meta = F.struct((F.col("c_nationkey") % 3).alias("crs"), (k % 2).alias("size"))
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg((F.count_distinct(meta) == 1).alias("aligned"), (F.count_distinct(F.expr("c_nationkey div 25")) == 1).alias("coarse"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value < 0 OR value > 1000) AS out_of_range, count(*) FILTER (value IS NULL) AS missing, count(*) > 1 AS duplicate FROM events GROUP BY 1, 2 HAVING count(*) > 1 OR count(*) FILTER (value < 0 OR value > 1000 OR value IS NULL) > 0")
def payload_checks_V11(spark, sf):
    """Keys that stand twice, and values that are missing or out of range."""
    v = F.col("value")
    bad = F.count_if((v < 0) | (v > 1000))
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), bad.alias("out_of_range"), F.count_if(v.isNull()).alias("missing"))
    return g.filter("n > 1 or out_of_range + missing > 0").withColumn("duplicate", F.col("n") > 1)


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT c_custkey FROM customer)) AS only_right, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def set_equality_U5(spark, sf):
    """Ids on one side only, and ids that one side has more than once."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    g = a.unionByName(b).groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return g.agg(F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("only_left"), F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("only_right"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_paths_J11(spark, sf):
    there = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(there, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# Resampling: targets ask for their sources by equal keys


_SCALE, _SHIFT = 1.6, 0.35


def _targets(spark, sf, scale=_SCALE):
    """(y, i, j, x, z): target cells of each year with their centres in source cells."""
    n = int(width(spark, sf) / scale)
    years = annual(spark, sf).select("y").distinct()
    cells = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
    return cells.join(F.broadcast(years)).withColumns({"z": (F.col("i") + 0.5) * scale + _SHIFT, "x": (F.col("j") + 0.5) * scale + _SHIFT})


_TARGETS = f"tg AS (SELECT y, i, j, (i + 0.5::DOUBLE) * {_SCALE}::DOUBLE + {_SHIFT}::DOUBLE AS z, (j + 0.5::DOUBLE) * {_SCALE}::DOUBLE + {_SHIFT}::DOUBLE AS x FROM (SELECT DISTINCT y FROM ann) yy, w, unnest(range(CAST(floor(w / {_SCALE}::DOUBLE) AS BIGINT))) a(i), unnest(range(CAST(floor(w / {_SCALE}::DOUBLE) AS BIGINT))) b(j))"


def query_on_targets(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        needed = oracle._needed("SELECT 1 FROM ann, w", {})
        SQL[f.__name__] = "WITH " + ", ".join(f"{n} AS ({oracle.CTE[n]})" for n in oracle.CTE if n in needed) + f", {_TARGETS} " + sql
        return f

    return register


@query_on_targets("SELECT tg.y, i, j, round(nbr::DOUBLE, 6) AS nbr FROM tg LEFT JOIN ann a ON a.y = tg.y AND a.r = CAST(floor(z) AS BIGINT) AND a.c = CAST(floor(x) AS BIGINT)")
def nearest_R5(spark, sf):
    """The cell under each target's centre, by the inverse of the target grid's scale and shift."""
    t = _targets(spark, sf).withColumns({"r": F.floor("z"), "c": F.floor("x")})
    return rounded(t.join(annual(spark, sf).select("y", "r", "c", "nbr"), ["y", "r", "c"], "left").select("y", "i", "j", "nbr"))


_NEAR = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc)"


@query_on_targets(f"SELECT y, i, j, round(CASE WHEN bool_or(own) AND sum(wt) FILTER (v IS NOT NULL) > 1e-6 THEN sum(wt * v) / sum(wt) FILTER (v IS NOT NULL) END, 6) AS v FROM (SELECT tg.y, i, j, (1 - abs(z - 0.5::DOUBLE - (floor(z - 0.5::DOUBLE) + dr))) * (1 - abs(x - 0.5::DOUBLE - (floor(x - 0.5::DOUBLE) + dc))) AS wt, nbr::DOUBLE AS v, nbr IS NOT NULL AND floor(z - 0.5::DOUBLE) + dr = floor(z) AND floor(x - 0.5::DOUBLE) + dc = floor(x) AS own FROM tg CROSS JOIN {_NEAR} LEFT JOIN ann a ON a.y = tg.y AND a.r = CAST(floor(z - 0.5::DOUBLE) + dr AS BIGINT) AND a.c = CAST(floor(x - 0.5::DOUBLE) + dc AS BIGINT)) GROUP BY y, i, j")
def bilinear_R6_H10(spark, sf):
    """The valid ones of the four cells around a target's centre, by their share of the weight; valid only where the nearest is."""
    z, x = F.floor(F.col("z") - 0.5), F.floor(F.col("x") - 0.5)
    near = F.explode(F.array(*[F.struct((z + a).alias("r"), (x + b).alias("c")) for a in (0, 1) for b in (0, 1)]))
    t = _targets(spark, sf).withColumn("k", near)
    weight = (1 - F.abs(F.col("z") - 0.5 - F.col("k.r"))) * (1 - F.abs(F.col("x") - 0.5 - F.col("k.c")))
    own = (F.col("k.r") == F.floor("z")) & (F.col("k.c") == F.floor("x"))
    t = t.select("y", "i", "j", "k.r", "k.c", weight.alias("wt"), own.alias("own")).join(annual(spark, sf).select("y", "r", "c", F.col("nbr").cast("double").alias("v")), ["y", "r", "c"], "left")
    seen = F.sum(F.when(F.col("v").isNotNull(), F.col("wt")))
    ok = F.bool_or(F.col("own") & F.col("v").isNotNull()) & (seen > 1e-6)
    return rounded(t.groupBy("y", "i", "j").agg(F.when(ok, F.sum(F.col("wt") * F.col("v")) / seen).alias("v")))


@query_on_targets(f"SELECT y, i, j, round(sum(wt * v) / sum(wt) FILTER (v IS NOT NULL), 6) AS nbr, count(v) AS n FROM (SELECT tg.y, i, j, (least(z + {_SCALE / 2}::DOUBLE, r + 1) - greatest(z - {_SCALE / 2}::DOUBLE, r)) * (least(x + {_SCALE / 2}::DOUBLE, c + 1) - greatest(x - {_SCALE / 2}::DOUBLE, c)) AS wt, nbr::DOUBLE AS v FROM tg LEFT JOIN ann a ON a.y = tg.y AND a.r < z + {_SCALE / 2}::DOUBLE AND a.r + 1 > z - {_SCALE / 2}::DOUBLE AND a.c < x + {_SCALE / 2}::DOUBLE AND a.c + 1 > x - {_SCALE / 2}::DOUBLE) GROUP BY y, i, j")
def average_R4(spark, sf):
    """Mean of the cells that a target covers, by the part of each that it covers; a target asks for the few rows and columns that it touches."""
    half = _SCALE / 2
    lo, hi = (lambda k: F.col(k) - half), (lambda k: F.col(k) + half)
    rows = lambda k: F.explode(F.sequence(F.floor(lo(k)), F.ceil(hi(k)) - 1))
    t = _targets(spark, sf).withColumn("r", rows("z")).withColumn("c", rows("x"))
    part = lambda k, c: F.least(hi(k), F.col(c) + 1) - F.greatest(lo(k), F.col(c))
    t = t.withColumn("wt", part("z", "r") * part("x", "c")).join(annual(spark, sf).select("y", "r", "c", F.col("nbr").cast("double").alias("v")), ["y", "r", "c"], "left")
    return rounded(t.groupBy("y", "i", "j").agg((F.sum(F.col("wt") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), F.col("wt")))).alias("nbr"), F.count("v").alias("n")))


# Objects


@query("SELECT count(*) AS labels, count(*) FILTER (claimed <> n) AS differing FROM (SELECT label, count(*) AS n, any_value(pixel_count) + CASE WHEN label % 5 = 0 THEN 1 ELSE 0 END AS claimed FROM kept JOIN lab USING (root) GROUP BY label)")
def label_integrity_J5(spark, sf):
    """Cells by label against what a summary claims; every fifth claim is off by one."""
    cells, stats = objects(spark, sf)
    claim = stats.select("label", (F.col("pixel_count") + F.when(F.col("label") % 5 == 0, 1).otherwise(0)).alias("claimed"))
    both = claim.join(cells.groupBy("label").agg(F.count("*").alias("n")), "label", "full_outer")
    return both.agg(F.count("*").alias("labels"), F.count_if(~F.col("claimed").eqNullSafe(F.col("n"))).alias("differing"))


@query("SELECT printf('disturbance-%03d', label) AS id, abs(a - b) <= 1e-9 AS summary_agrees, abs(a - c) <= 1e-9 AS series_agrees FROM (SELECT label, area_ha AS a, area_ha + CASE WHEN label % 4 = 0 THEN 1e-6::DOUBLE ELSE 1e-12::DOUBLE END AS b FROM lab) JOIN (SELECT label, max(area_ha) AS c FROM oy GROUP BY label) USING (label)")
def reconcile_J6(spark, sf):
    """Areas of an object in three documents; within 1e-9 they are the same."""
    _, stats = objects(spark, sf)
    a = stats.select("label", F.col("area_ha").alias("a"), (F.col("area_ha") + F.when(F.col("label") % 4 == 0, 1e-6).otherwise(1e-12)).alias("b"))
    c = object_years(spark, sf).groupBy("label").agg(F.max("area_ha").alias("c"))
    same = lambda x: F.abs(F.col("a") - F.col(x)) <= 1e-9
    return a.join(c, "label").select(M.object_id(F.col("label")).alias("id"), same("b").alias("summary_agrees"), same("c").alias("series_agrees"))


@query("SELECT y, count(recovery) AS n, round(avg(recovery::DOUBLE), 6) AS mean, " + ", ".join(f"round(quantile_cont(recovery::DOUBLE, {q}), 6) AS {k}" for k, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + ", round(min(recovery::DOUBLE), 6) AS low, round(max(recovery::DOUBLE), 6) AS high FROM oc GROUP BY y")
def recovery_bundle_A13(spark, sf):
    v = F.col("recovery").cast("double")
    out = object_cells(spark, sf).groupBy("y").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.min(v).alias("low"), F.max(v).alias("high"))
    return rounded(out.select("y", "n", "mean", *[F.col("p")[i].alias(k) for i, k in enumerate(("p10", "median", "p90"))], "low", "high"))


@query("SELECT y, round(count(recovery) / count(*)::DOUBLE, 6) AS valid_fraction, round(min(recovery::DOUBLE), 6) AS low, " + ", ".join(f"round(quantile_cont(recovery::DOUBLE, {q}), 6) AS {k}" for k, q in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))) + ", round(max(recovery::DOUBLE), 6) AS high, round(count(*) FILTER (recovery < 0) / nullif(count(recovery), 0)::DOUBLE, 6) AS lt_0, round(count(*) FILTER (recovery > 1) / nullif(count(recovery), 0)::DOUBLE, 6) AS gt_1 FROM oc GROUP BY y")
def raster_statistics_A32(spark, sf):
    v = F.col("recovery").cast("double")
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), F.count(v))
    out = object_cells(spark, sf).groupBy("y").agg((F.count(v) / F.count("*")).alias("valid_fraction"), F.min(v).alias("low"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("p"), F.max(v).alias("high"), share(v < 0).alias("lt_0"), share(v > 1).alias("gt_1"))
    return rounded(out.select("y", "valid_fraction", "low", *[F.col("p")[i].alias(k) for i, k in enumerate(("p1", "p50", "p99"))], "high", "lt_0", "gt_1"))


_MODES = ("reject", "preserve", "clamp-zero")
_PAIRS = (("reject", "preserve"), ("reject", "clamp-zero"), ("preserve", "clamp-zero"))


@query("SELECT pair, count(x) AS overlap, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS gained, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS lost, count(*) FILTER (x > 1e-6) AS changed, round(max(x), 6) AS max_abs FROM (SELECT *, abs(CAST(b - a AS FLOAT)::DOUBLE) AS x FROM (" + " UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, {oracle._nd('nir', 'swir2', a)} AS a, {oracle._nd('nir', 'swir2', b)} AS b FROM obs" for a, b in _PAIRS) + ")) GROUP BY pair")
def variant_pairs_J18(spark, sf):
    ok = C.scl_valid(F.col("scl"))
    v = {m: C.normalised_difference(F.col("nir"), F.col("swir2"), ok, m) for m in _MODES}
    both = obs(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), v[a].alias("a"), v[b].alias("b")) for a, b in _PAIRS])).alias("s")).select("s.*")
    return O.pairwise_difference(both, "a", "b", ["pair"]).select("pair", "overlap", "gained", "lost", "changed", r6("max_abs").alias("max_abs"))


@query("SELECT label, mode, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS high FROM (SELECT label, " + "unnest(['reject', 'preserve', 'clamp-zero']) AS mode, unnest([" + ", ".join(f"({oracle._nd('nir', 'swir2', m)})::DOUBLE" for m in _MODES) + "]) AS v FROM obs JOIN (SELECT r, c, label FROM kept JOIN lab USING (root) WHERE label <= 5) USING (r, c)) GROUP BY label, mode")
def largest_by_mode_A26(spark, sf):
    """The index within the five largest objects, which carry the labels 1 to 5, under each treatment."""
    cells, _ = objects(spark, sf)
    ok = C.scl_valid(F.col("scl"))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), C.normalised_difference(F.col("nir"), F.col("swir2"), ok, m).cast("double").alias("v")) for m in _MODES]))
    rows = obs(spark, sf).join(cells.filter("label <= 5").select("r", "c", "label"), ["r", "c"]).select("label", values.alias("s")).select("label", "s.*")
    return rounded(rows.groupBy("label", "mode").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.percentile("v", F.lit(0.9)).alias("p90"), F.max("v").alias("high")))


@query(f"SELECT y, count(*) AS total, count(v) AS valid, round(100 * count(v) / count(*)::DOUBLE, 6) AS pct, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, count(*) FILTER (v < -1 OR v > 1) AS outside_1, count(*) FILTER (abs(v) > 2) AS gt_2, count(*) FILTER (abs(v) > 5) AS gt_5 FROM (SELECT y, ({oracle._nd('nir', 'swir2', 'preserve')})::DOUBLE AS v FROM obs JOIN kept USING (r, c)) GROUP BY y")
def footprint_stats_A24(spark, sf):
    cells, _ = objects(spark, sf)
    rows = obs(spark, sf).join(cells.select("r", "c"), ["r", "c"], "left_semi").select("y", C.normalised_difference(F.col("nir"), F.col("swir2"), C.scl_valid(F.col("scl")), "preserve").cast("double").alias("v"))
    v = F.col("v")
    g = rows.groupBy("y").agg(F.count("*").alias("total"), F.count(v).alias("valid"), C.percentage(F.count(v), F.count("*")).alias("pct"), F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count_if((v < -1) | (v > 1)).alias("outside_1"), F.count_if(F.abs(v) > 2).alias("gt_2"), F.count_if(F.abs(v) > 5).alias("gt_5"))
    return rounded(g.select("y", "total", "valid", "pct", *[F.col("p")[i].alias(k) for i, k in enumerate(("p10", "median", "p90"))], "outside_1", "gt_2", "gt_5"))


_EVIDENCE = "count(*) AS n, " + ", ".join(f"count(*) FILTER ({x}) AS {k}" for k, x in (("valid_reject", "a >= 0 AND b >= 0 AND a + b <> 0"), ("valid_preserve", "a + b <> 0"), ("valid_clamp", "greatest(a, 0) + greatest(b, 0) <> 0"), ("first_only", "a < 0 AND b >= 0"), ("second_only", "a >= 0 AND b < 0"), ("both_negative", "a < 0 AND b < 0"), ("admitted_preserve", "(a < 0 OR b < 0) AND a + b <> 0"), ("admitted_clamp", "(a < 0 OR b < 0) AND greatest(a, 0) + greatest(b, 0) <> 0"))) + ", " + ", ".join(f"count(*) FILTER (abs(a + b) < CAST({t} AS FLOAT)) AS near_{i}" for i, t in enumerate((0.0001, 0.001, 0.01, 0.05, 0.1)))


@query(f"SELECT name, y, {_EVIDENCE}, round(min(b)::DOUBLE, 6) AS min_b, round(median(b::DOUBLE), 6) AS median_b, round(max(b)::DOUBLE, 6) AS max_b FROM (SELECT unnest(['nbr', 'ndvi']) AS name, y, nir AS a, unnest([swir2, red]) AS b FROM obs WHERE {oracle.VALID}) GROUP BY name, y")
def treatment_evidence_A25(spark, sf):
    """By index and year: what each treatment admits, which bands are negative, and denominators near zero. The median is exact in place of a sample's."""
    rows = obs(spark, sf).filter(C.scl_valid(F.col("scl"))).select("y", F.col("nir").alias("a"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(b).alias("b")) for n, b in (("nbr", "swir2"), ("ndvi", "red"))])).alias("s")).select("y", "a", "s.*")
    a, b, zero = F.col("a"), F.col("b"), C.f32(0)
    negative, kept, clamped = (a < 0) | (b < 0), a + b != 0, F.greatest(a, zero) + F.greatest(b, zero) != 0
    n = F.count_if
    return rounded(rows.groupBy("name", "y").agg(
        F.count("*").alias("n"), n(~negative & kept).alias("valid_reject"), n(kept).alias("valid_preserve"), n(clamped).alias("valid_clamp"), n((a < 0) & (b >= 0)).alias("first_only"), n((a >= 0) & (b < 0)).alias("second_only"), n((a < 0) & (b < 0)).alias("both_negative"),
        n(negative & kept).alias("admitted_preserve"), n(negative & clamped).alias("admitted_clamp"), *[n(F.abs(a + b) < C.f32(t)).alias(f"near_{i}") for i, t in enumerate((0.0001, 0.001, 0.01, 0.05, 0.1))], F.min(b).alias("min_b"), F.median(b.cast("double")).alias("median_b"), F.max(b).alias("max_b"),
    ))


@query("SELECT count(*) AS raw, count(*) FILTER (n >= 3) AS retained, count(*) FILTER (n < 3) AS removed, round(sum(n) * 0.04::DOUBLE, 6) AS raw_ha, round(sum(n) FILTER (n >= 3) * 0.04::DOUBLE, 6) AS retained_ha, max(n) AS largest, round(median(n) FILTER (n >= 3), 6) AS median_size, count(*) FILTER (n >= 3 AND edge) AS at_boundary, round(100 * sum(n) FILTER (n >= 3) / (SELECT count(dnbr) FROM pairs)::DOUBLE, 6) AS pct_of_valid, round(sum(n) FILTER (n >= 3) * 0.04::DOUBLE, 6) AS outline_ha FROM (SELECT root, count(*) AS n, bool_or(r < 2 OR c < 2 OR r >= w - 2 OR c >= w - 2) AS edge FROM comp8, w GROUP BY root)")
def component_summary_A38(spark, sf):
    """Raw and retained components, those at the boundary, their part of what can be judged, and the area within their outlines beside that of their cells."""
    w = width(spark, sf)
    labelled = O.components(candidates(spark, sf), w)
    edge = O.boundary_touch(labelled, ["root"], aoi(w), w, w)
    n = labelled.groupBy("root").agg(F.count("*").alias("n")).join(edge, "root")
    big = F.col("n") >= LEAST
    area = polygons.outlines(O.keep_large(labelled, LEAST, ["root"]), "root").agg(F.sum("area").alias("area"))
    valid = pairs(spark, sf).agg(F.count("dnbr").alias("judged"))
    g = n.agg(F.count("*").alias("raw"), F.count_if(big).alias("retained"), F.count_if(~big).alias("removed"), C.hectares(F.sum("n")).alias("raw_ha"), F.sum(F.when(big, F.col("n"))).alias("kept"), F.max("n").alias("largest"), F.median(F.when(big, F.col("n"))).alias("median_size"), F.count_if(big & F.col("touches_boundary")).alias("at_boundary"))
    out = g.join(area).join(valid)
    return rounded(out.select("raw", "retained", "removed", "raw_ha", C.hectares(F.col("kept")).alias("retained_ha"), "largest", "median_size", "at_boundary", C.percentage(F.col("kept"), F.col("judged")).alias("pct_of_valid"), C.hectares(F.col("area")).alias("outline_ha")))


_BOX = "SELECT s_suppkey, (p_size + 1) / 7000.0::DOUBLE AS w, (p_size + 3) / 7000.0::DOUBLE AS h FROM supplier JOIN part ON p_partkey = s_suppkey"


@query(f"SELECT count(*) AS n, count(*) FILTER (round(w, 4) * round(h, 4) <= 0) AS invalid, round(100 * (sum(round(w, 4) * round(h, 4)) - sum(w * h)) / sum(w * h), 6) AS total_pct, round(max(d), 6) AS worst_pct, round(list_sort(list(d))[count(*) // 2 + 1], 6) AS upper_middle_pct FROM (SELECT *, abs(100 * (round(w, 4) * round(h, 4) - w * h) / (w * h)) AS d FROM ({_BOX}))")
def geometry_qa_A34(spark, sf):
    """Rounded outlines against their sources: validity, areas in all and one by one, and the upper of the two middle differences."""
    p = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(((F.col("p_size") + 1) / 7000.0).alias("w"), ((F.col("p_size") + 3) / 7000.0).alias("h"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = F.lit(0.0)
    ring = F.array(at(o, o), at(F.col("w"), o), at(F.col("w"), F.col("h")), at(o, F.col("h")), at(o, o))
    rows = p.select(S.ring_area(ring).alias("a"), S.ring_area(S.rounded_points(ring, 4)).alias("b"))
    rows = rows.withColumn("d", F.abs(100 * (F.col("b") - F.col("a")) / F.col("a")))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)")
    return rounded(rows.agg(F.count("*").alias("n"), F.count_if(F.col("b") <= 0).alias("invalid"), (100 * (F.sum("b") - F.sum("a")) / F.sum("a")).alias("total_pct"), F.max("d").alias("worst_pct"), middle.alias("upper_middle_pct")))


_EIGHT = ("area_ha", "centroid_x", "centroid_y", "pre_mean", "pre_median", "post_mean", "post_median", "dnbr_mean", "dnbr_median", "dnbr_p90", "dnbr_max")


@query("SELECT printf('disturbance-%03d', label) AS disturbance_id, label AS component_label, pixel_count, touches_boundary, " + ", ".join(f"round({k}, 8) + 0 AS {k}" for k in _EIGHT) + " FROM lab JOIN (SELECT root, bool_or(r < 2 OR c < 2 OR r >= w - 2 OR c >= w - 2) AS touches_boundary FROM kept, w GROUP BY root) USING (root)")
def public_record_H3(spark, sf):
    w = width(spark, sf)
    cells, stats = objects(spark, sf)
    edge = O.boundary_touch(cells, ["label"], aoi(w), w, w)
    return stats.join(edge, "label").select(M.object_id(F.col("label")).alias("disturbance_id"), F.col("label").cast("long").alias("component_label"), "pixel_count", "touches_boundary", *[R.rounded_number(F.col(c), 8, c).alias(c) for c in _EIGHT])


@query("SELECT printf('disturbance-%03d', label) AS id, 'Feature' AS type, 'MultiPolygon' AS shape, any_value(pixel_count) AS pixel_count, count(*)::DOUBLE AS area, min(c)::DOUBLE AS west, min(r)::DOUBLE AS north, max(c) + 1::DOUBLE AS east, max(r) + 1::DOUBLE AS south FROM kept JOIN lab USING (root) GROUP BY label")
def features_K10(spark, sf):
    """Each object as a GeoJSON feature with its outlines. What is returned is read from the JSON: area of outer rings less holes, and the bounds."""
    cells, stats = objects(spark, sf)
    shapes = polygons.multipolygons(cells.select("label", "r", "c")).withColumnRenamed("coordinates", "points")
    rows = stats.select("label", "pixel_count").join(shapes, "label").withColumn("id", M.object_id(F.col("label")))
    lines = sinks.feature_lines(rows, "id", F.struct(F.lit("MultiPolygon").alias("type"), F.col("points").alias("coordinates")), ["pixel_count"])
    doc = F.from_json("json", "type string, properties struct<pixel_count:long>, geometry struct<type:string,coordinates:array<array<array<array<double>>>>>")
    parsed = lines.select("id", doc.alias("d")).select("id", "d.type", F.col("d.geometry.type").alias("shape"), "d.properties.pixel_count", F.flatten("d.geometry.coordinates").alias("rings"))
    ring = lambda x: F.transform(x, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, x: s + S.ring_area(ring(x))))
    at = lambda i: F.transform(F.flatten("rings"), lambda p: p[i])
    return parsed.select("id", "type", "shape", "pixel_count", area.alias("area"), F.array_min(at(0)).alias("west"), F.array_min(at(1)).alias("north"), F.array_max(at(0)).alias("east"), F.array_max(at(1)).alias("south"))


# Stored products and documents


def _round_trip(spark, name: str, rows: DataFrame, nodata: dict[str, float], box=None) -> DataFrame:
    path = shared_path(spark, name)
    rasters.write(rows, path, nodata, tile=16)
    return rasters.read(spark, path, nodata, box, tile=16).drop("tile_r", "tile_c")


@query("SELECT 1995 AS year, r, c, label FROM kept JOIN lab USING (root)")
def label_store_K3_S11(spark, sf):
    """Labels as a raster of integers with 0 for none, written and read whole."""
    cells, _ = objects(spark, sf)
    w = width(spark, sf)
    grid = spark.range(w * w).select(F.expr(f"id div {w}").alias("r"), (F.col("id") % w).alias("c"))
    whole = grid.join(cells.select("r", "c", "label"), ["r", "c"], "left").withColumn("year", F.lit(PRE))
    got = _round_trip(spark, "labels", whole, {"label": 0}).filter("label is not null")
    return got.select(F.col("year").cast("long").alias("year"), "r", "c", F.col("label").cast("long").alias("label"))


@query("SELECT y AS year, r, c, round(recovery::DOUBLE, 6) + 0 AS recovery FROM oc")
def recovery_store_K4_S13(spark, sf):
    """Recovery by year with -9999 for none; a stored column that is no FLOAT is an error."""
    rows = object_cells(spark, sf).select(F.col("y").alias("year"), "r", "c", "recovery")
    got = _round_trip(spark, "recovery", rows, {"recovery": rasters.FLOAT_NODATA})
    if dict(got.dtypes)["recovery"] != "float":
        raise ValueError("recovery is not stored as FLOAT")
    return rounded(got.select(F.col("year").cast("long").alias("year"), "r", "c", "recovery"))


@query("SELECT y AS year, r, c, " + ", ".join(f"CASE WHEN ok THEN {oracle._DISP.format(k, 0.3)} ELSE 255 END AS {k}" for k in ("red", "nir", "swir2")) + f", CASE WHEN ok THEN 255 ELSE 0 END AS alpha FROM (SELECT y, r, c, CAST(median(red) FILTER ({oracle.VALID}) AS FLOAT) AS red, CAST(median(nir) FILTER ({oracle.VALID}) AS FLOAT) AS nir, CAST(median(swir2) FILTER ({oracle.VALID}) AS FLOAT) AS swir2, bool_or({oracle.VALID}) AS ok FROM obs GROUP BY y, r, c)")
def rgba_store_K5_K6_H15(spark, sf):
    """Rendered medians as bytes with alpha; invalid cells are white and transparent, and no valid one is all white."""
    ok = C.scl_valid(F.col("scl"))
    rows = obs(spark, sf).groupBy("y", "r", "c").agg(*[F.median(F.when(ok, F.col(x))).cast("float").alias(x) for x in ("red", "nir", "swir2")], F.bool_or(ok).alias("ok"))
    shown = rows.select(F.col("y").alias("year"), "r", "c", *[F.when(F.col("ok"), C.display(F.col(x))).otherwise(rasters.BYTE_NODATA).cast("smallint").alias(x) for x in ("red", "nir", "swir2")], F.when(F.col("ok"), 255).otherwise(0).cast("smallint").alias("alpha"))
    got = _round_trip(spark, "rgba", shown, {})
    return got.select(F.col("year").cast("long").alias("year"), "r", "c", *[F.col(x).cast("long").alias(x) for x in ("red", "nir", "swir2", "alpha")])


@query("SELECT y AS year, r, c, round(coalesce(nbr, -9999)::DOUBLE, 6) AS value, nbr IS NOT NULL AS valid FROM ann WHERE r >= 3 AND r < 20 AND c >= 2 AND c < 18")
def masked_store_K7_S15(spark, sf):
    """Values beside their mask, read in a window of blocks."""
    rows = annual(spark, sf).select(F.col("y").alias("year"), "r", "c", F.coalesce("nbr", C.f32(rasters.FLOAT_NODATA)).alias("value"), F.col("nbr").isNotNull().alias("valid"))
    got = _round_trip(spark, "masked", rows, {}, (3, 2, 20, 18))
    return got.select(F.col("year").cast("long").alias("year"), "r", "c", r6("value").alias("value"), "valid")


_TOML = Path(__file__).with_name("settings.toml")


@query("SELECT y AS year, strftime(make_date(y, 8, 1), '%Y-%m-%dT00:00:00Z') AS first, strftime(make_date(y, 9, 1), '%Y-%m-%dT00:00:00Z') AS stop, y IN (2017, 2018, 2020, 2023, 2026) AS benchmark FROM (SELECT unnest(range(2017, 2027)) AS y)")
def settings_S1_H21(spark, sf):
    """The windows of the settings' years, and which of them are shown as pictures."""
    s = config.load(_TOML)
    return spark.createDataFrame([(y, a, b, y in s.benchmarks) for y, (a, b) in zip(s.years, s.windows(), strict=True)], "year long, first string, stop string, benchmark boolean")


@query("SELECT c_custkey, CASE WHEN ok THEN t END AS top, CASE WHEN ok THEN l END AS \"left\", CASE WHEN ok THEN b END AS bottom, CASE WHEN ok THEN r END AS \"right\" FROM (SELECT *, t < b AND l < r AS ok FROM (SELECT c_custkey, greatest(CAST(floor((5000 - n) / 20) AS BIGINT) - 1, 0) AS t, greatest(CAST(floor((wst - 1000) / 20) AS BIGINT) - 1, 0) AS l, least(CAST(ceil((5000 - s) / 20) AS BIGINT) + 1, 100) AS b, least(CAST(ceil((e - 1000) / 20) AS BIGINT) + 1, 120) AS r FROM (SELECT c_custkey, 500 + c_acctbal / 2 AS wst, 600 + c_acctbal / 2 + c_nationkey * 10 AS e, 2500 + c_acctbal / 3 AS s, 2600 + c_acctbal / 3 + c_nationkey * 7 AS n FROM customer)))")
def source_windows_S7(spark, sf):
    """The cells that an extent needs, rounded outwards with one more and clipped; none outside the raster."""
    a, k = F.col("c_acctbal"), F.col("c_nationkey")
    w, e, s, n = 500 + a / 2, 600 + a / 2 + k * 10, 2500 + a / 3, 2600 + a / 3 + k * 7
    top, left = F.greatest(F.floor((5000 - n) / 20) - 1, F.lit(0)), F.greatest(F.floor((w - 1000) / 20) - 1, F.lit(0))
    bottom, right = F.least(F.ceil((5000 - s) / 20) + 1, F.lit(100)), F.least(F.ceil((e - 1000) / 20) + 1, F.lit(120))
    ok = (top < bottom) & (left < right)
    return table(spark, sf, "customer").select("c_custkey", *[F.when(ok, x).alias(name) for x, name in ((top, "top"), (left, "left"), (bottom, "bottom"), (right, "right"))])


@query("SELECT n_name AS name, n_nationkey::BIGINT AS key, sha256('{' || chr(10) || '  \"key\": ' || n_nationkey || ',' || chr(10) || '  \"name\": \"' || n_name || '\"' || chr(10) || '}' || chr(10)) AS sha256 FROM nation")
def documents_K8_K11_K12_S17_H12_H17(spark, sf):
    """One manifest a nation with sorted keys, all published in one step, found by name, hashed, and parsed so that a malformed one fails."""
    folder = shared_path(spark, "manifests")
    rows = table(spark, sf, "nation").select("n_name", "n_nationkey").collect()  # 25 rows, whatever the scale
    sinks.publish_shared(spark, {f"{folder}/{r['n_nationkey']}-manifest.json": sinks.canonical({"name": r["n_name"], "key": r["n_nationkey"]}).encode() for r in rows} | {f"{folder}/status.json": sinks.canonical({"done": True}).encode()})
    docs = spark.read.schema("name string, key long").option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*-manifest.json").json(folder)
    docs = docs.select("name", "key", F.substring_index("_metadata.file_path", "/", -1).alias("file"))
    found = catalog.hashes(spark, folder, "*-manifest.json").select(F.substring_index("path", "/", -1).alias("file"), "sha256")
    return docs.join(found, "file").select("name", "key", "sha256")


@query("SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS at, year(o_orderdate)::BIGINT AS year FROM orders")
def accessors_H18(spark, sf):
    from .delivery import items

    at = catalog.datetime_of(F.col("properties"))
    return items(spark, sf).select("id", at.alias("at"), F.year(S.utc_date(at)).cast("long").alias("year"))


def grid_records(grids: DataFrame, crs: str, size: float) -> DataFrame:
    """grids (left, bottom, right, top, width, height) with a manifest's record of each, as JSON."""
    transform = F.array(F.lit(size), F.lit(0.0), F.col("left"), F.lit(0.0), F.lit(-size), F.col("top"))
    return grids.withColumn("record", F.to_json(F.struct(F.lit(crs).alias("crs"), F.lit(size).alias("resolution"), "width", "height", F.array("left", "bottom", "right", "top").alias("bounds"), transform.alias("transform"))))


@query("WITH " + _UTM.format("20") + "SELECT c_custkey, CAST((rgt - lft) / 20 AS BIGINT) * CAST((tp - btm) / 20 AS BIGINT) AS cells, lft::DOUBLE AS west, tp::DOUBLE AS north, (lft + 20 * CAST((rgt - lft) / 20 AS BIGINT))::DOUBLE AS east FROM b")
def grid_record_H13(spark, sf):
    """Grids as records of a manifest; cells and corners are read from the record."""
    kind = "crs string, resolution double, width long, height long, bounds array<double>, transform array<double>"
    r = grid_records(_grid(spark, sf, 20.0), "EPSG:32633", 20.0).select("c_custkey", F.from_json("record", kind).alias("g"))
    t = F.col("g.transform")
    return r.select("c_custkey", (F.col("g.width") * F.col("g.height")).alias("cells"), t[2].alias("west"), t[5].alias("north"), (t[2] + t[0] * F.col("g.width")).alias("east"))


@query("SELECT c_custkey, CASE WHEN white > 0.01::DOUBLE AND c_nationkey % 5 <> 0 THEN white END AS white FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 0.22::DOUBLE ELSE round(c_acctbal / 20000, 3) END AS white FROM customer)")
def display_points_H14(spark, sf):
    """White points, the project's unless one is given; those that aren't above the black point, or with another gamma than 1, can't be shown."""
    white = F.coalesce(F.when(F.col("c_custkey") % 3 != 0, F.round(F.col("c_acctbal") / 20000, 3)), F.lit(0.22))
    gamma = F.when(F.col("c_nationkey") % 5 == 0, 1.2).otherwise(1.0)
    return table(spark, sf, "customer").select("c_custkey", F.when((white > 0.01) & (gamma == 1.0), white).alias("white"))


# TIFF files


def _tiffs(spark, sf, piece: int = 32):
    path = shared_path(spark, "tiffs")
    rows = annual(spark, sf).select("y", "r", "c", "nbr").filter("r >= 0 and c >= 0")
    listing = shared_path(spark, "tiff-list")
    tiff.write(rows, path, "nbr", "y", (499980.0, 6900000.0), 20.0, 32633, piece=piece, tile=16).write.parquet(listing)
    return path, spark.read.parquet(listing)


@query("SELECT y AS year, r, c, round(nbr::DOUBLE, 6) AS nbr FROM ann WHERE r >= 5 AND r < 40 AND c >= 3 AND c < 36 AND nbr IS NOT NULL")
def geotiff_K1_K2_S6(spark, sf):
    """The index of each year as tiled files, in pieces, and a window of them by the tiles that hold it."""
    path, listing = _tiffs(spark, sf)
    got = tiff.read(spark, path, listing, (5, 3, 40, 36)).filter("value is not null")
    return got.select(F.col("by").alias("year"), "r", "c", r6("value").alias("nbr"))


@query("SELECT y AS year, CAST(r // 32 AS BIGINT) AS piece_r, CAST(c // 32 AS BIGINT) AS piece_c, max(r) % 32 + 1 AS height, max(c) % 32 + 1 AS width, 0::BIGINT AS problems FROM ann WHERE r >= 0 AND c >= 0 GROUP BY y, r // 32, c // 32")
def raster_structure_V6(spark, sf):
    """The structure of each file by its header: one band, deflated tiles, projection, cell size, sentinel."""
    path, listing = _tiffs(spark, sf)
    place = F.split(F.regexp_replace("file", r"\.tif$", ""), "-")
    got = tiff.checked(spark, path, listing, 16, 32633, 20.0)
    return got.select(F.col("by").alias("year"), place[1].cast("long").alias("piece_r"), place[2].cast("long").alias("piece_c"), "height", "width", F.size("problems").cast("long").alias("problems"))
