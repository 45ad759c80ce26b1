"""Queries on delivery records, grids, annual outputs and their checks, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metadata as M
from ..functions import records as R
from ..functions import scenes as S
from ..operators import cells as O
from ..operators import polygons
from . import oracle
from .queries import LEAST, POST, PRE, annual, aoi, candidates, indices, object_cells, object_years, objects, obs, pairs, r6, rounded, table, width

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle.compose(sql)
        return f

    return register


def long(name: str):
    return F.col(name).cast("long").alias(name)


# Scalars


@query("SELECT p_partkey, round(p_size * 0.04::DOUBLE, 6) AS hectares FROM part")
def hectares_P16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(C.hectares(F.col("p_size"))).alias("hectares"))


@query("SELECT c_custkey, n, done, CASE WHEN n = 0 THEN 0 ELSE round(100 * done / n::DOUBLE, 6) END AS pct, CASE WHEN n = 0 THEN false ELSE 100 * done / n::DOUBLE >= 90 END AS ge_90, CASE WHEN n = 0 THEN false ELSE 100 * done / n::DOUBLE >= 95 END AS ge_95 FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 5 = 0 GROUP BY 1)")
def percentage_P17_P18(spark, sf):
    """Shares with a zero total, and the flags at 90 and 95 percent."""
    o = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    g = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "done")])
    p = C.percentage(F.col("done"), F.col("n"))
    return g.select("c_custkey", "n", "done", r6(p).alias("pct"), (p >= 90).alias("ge_90"), (p >= 95).alias("ge_95"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal / 3, 4) + 0 END AS value FROM customer")
def rounded_number_P19(spark, sf):
    x = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 3)
    return table(spark, sf, "customer").select("c_custkey", R.rounded_number(x, 4, "value").alias("value"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, l_tax <> 0 AS finite, l_tax <> 0 OR l_linenumber % 2 = 0 AS all_finite FROM lineitem")
def finite_F3_P31(spark, sf):
    """A value, and an array that holds it, where every second line has a null instead; division by zero gives an infinity or NaN."""
    x = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_discount"))
    held = F.array(F.lit(1.0), F.when(F.col("l_linenumber") % 2 != 0, x), F.lit(None).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), C.finite(x).alias("finite"), R.all_finite(held).alias("all_finite"))


@query("SELECT p_partkey, CAST(5 + CASE WHEN p_size > 20 THEN 1 + p_size % 4 ELSE 0 END AS BIGINT) AS positions FROM part")
def coordinate_count_P34(spark, sf):
    at = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    outer, hole = F.array_repeat(at, 5), F.array_repeat(at, (1 + F.col("p_size") % 4).cast("int"))
    rings = F.when(F.col("p_size") > 20, F.array(outer, hole)).otherwise(F.array(outer))
    return table(spark, sf, "part").select("p_partkey", R.coordinate_count(rings).alias("positions"))


@query("SELECT event_id, CASE WHEN event_type = 'click' OR json_extract_string(props, '$.k')::BIGINT % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS n FROM events")
def known_properties_P26(spark, sf):
    gone = (F.col("event_type") == "click") | (F.get_json_object("props", "$.k").cast("long") % 4 == 0)
    props = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.when(~gone, F.get_json_object("props", "$.k")))
    known = F.map_filter(props, lambda k, v: v.isNotNull())
    return table(spark, sf, "events").select("event_id", F.size(known).cast("long").alias("n"))


@query("SELECT label, y, CASE status WHEN 'GOOD' THEN 'Good coverage' WHEN 'POOR' THEN 'Poor coverage' ELSE 'Partial coverage' END AS coverage, CASE status WHEN 'GOOD' THEN 'Good' WHEN 'POOR' THEN 'Poor' ELSE 'Partial' END AS short, NOT reporting_recommended AS warning, 'rasters/recovery/' || y || '.tif' AS path, CASE WHEN recovery_median IS NOT NULL THEN printf('%.2f', recovery_median) || '×' END AS recovery FROM oy")
def labels_P38(spark, sf):
    s = F.col("status")
    path = R.year_path("rasters/recovery", F.col("y"), ".tif", F.col("y").between(1992, 2010))
    return object_years(spark, sf).select(long("label"), long("y"), R.coverage_label(s).alias("coverage"), R.coverage_label(s, True).alias("short"), (~F.col("reporting_recommended")).alias("warning"), path.alias("path"), F.when(F.col("recovery_median").isNotNull(), R.recovery_text(F.col("recovery_median"))).alias("recovery"))


@query("SELECT label, string_agg(printf('%.1f', 40 + (y - 1995) / 6.0::DOUBLE * 600) || ',' || printf('%.1f', 200 - (recovery_median - lo) / (hi - lo) * 180), ' ' ORDER BY y) AS points FROM (SELECT *, least(0, min(recovery_median) OVER (PARTITION BY label)) AS lo, greatest(1, max(recovery_median) OVER (PARTITION BY label)) AS hi FROM oy) WHERE recovery_median IS NOT NULL GROUP BY label")
def chart_P39(spark, sf):
    """Each object's recovery as the points of a line; years without a value are left out."""
    rows = object_years(spark, sf).select("label", "y", "recovery_median")
    g = rows.groupBy("label").agg(F.collect_list(F.struct("y", "recovery_median")).alias("s"), F.least(F.lit(0.0), F.min("recovery_median")).alias("lo"), F.greatest(F.lit(1.0), F.max("recovery_median")).alias("hi"))
    known = F.array_sort(F.filter("s", lambda p: p["recovery_median"].isNotNull()))
    text = lambda p: F.concat(R.fixed(R.chart_x(p["y"] - 1995, 7, 40.0, 600.0), 1), F.lit(","), R.fixed(R.chart_y(p["recovery_median"], F.col("lo"), F.col("hi"), 20.0, 200.0), 1))
    return g.filter(F.size(known) > 0).select(long("label"), F.array_join(F.transform(known, text), " ").alias("points"))


@query(f"SELECT item, CASE WHEN {oracle.VALID} THEN 255 ELSE 0 END AS alpha, {oracle.VALID} AND r >= 1 AND r < w - 1 AND c >= 1 AND c < w - 1 AS quality FROM obs, w")
def alpha_P11_F7(spark, sf):
    """Alpha of what can be shown, and the quality mask: three finite bands, a clear class and a place within the area."""
    ok = C.scl_valid(F.col("scl")) & C.finite(F.col("red")) & C.finite(F.col("nir")) & C.finite(F.col("swir2"))
    inside = aoi(width(spark, sf))(F.col("r"), F.col("c"))
    return obs(spark, sf).select("item", F.when(ok, 255).otherwise(0).alias("alpha"), (ok & inside).alias("quality"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'w' || c_custkey WHEN 1 THEN 'v' || c_custkey || '.b' WHEN 3 THEN lower(c_mktsegment) END AS tag FROM customer")
def variant_files_P33(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("candidate-"), k)).when(k % 5 == 1, F.concat(F.lit("v"), k, F.lit(".b"))).when(k % 5 == 2, "canonical").when(k % 5 == 3, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("../"), k))
    return table(spark, sf, "customer").select("c_custkey", R.variant_tag(name).alias("tag"))


# Grids


_E, _N = 500000.0, 0.0


def _boxes(spark, sf):
    k = F.col("c_custkey")
    west, south = 12 + k % 50 / 10.0, 58 + k % 37 / 10.0
    return table(spark, sf, "customer").select("c_custkey", west.alias("west"), south.alias("south"), (west + 0.05 + k % 7 / 100.0).alias("east"), (south + 0.03 + k % 5 / 100.0).alias("north"))


_UTM = """
u AS (SELECT c_custkey, west + (east - west) * i / 22.0::DOUBLE AS lon, south + (north - south) * j / 22.0::DOUBLE AS lat FROM (SELECT c_custkey, 12 + c_custkey % 50 / 10.0::DOUBLE AS west, 58 + c_custkey % 37 / 10.0::DOUBLE AS south, 12 + c_custkey % 50 / 10.0::DOUBLE + 0.05::DOUBLE + c_custkey % 7 / 100.0::DOUBLE AS east, 58 + c_custkey % 37 / 10.0::DOUBLE + 0.03::DOUBLE + c_custkey % 5 / 100.0::DOUBLE AS north FROM customer),
 (SELECT i, j FROM unnest(range(23)) a(i), unnest(range(23)) b(j) WHERE i IN (0, 22) OR j IN (0, 22))),
k AS (SELECT 0.0016792203863836547::DOUBLE AS n),
t AS (SELECT c_custkey, n, radians(lon - 15) AS d, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t FROM u, k),
x AS (SELECT *, atan(t / cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM t),
m AS (SELECT c_custkey, 500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS e, a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS nn FROM x),
b AS (SELECT c_custkey, floor(min(e) / {0}) * {0} AS lft, ceil(max(e) / {0}) * {0} AS rgt, floor(min(nn) / {0}) * {0} AS btm, ceil(max(nn) / {0}) * {0} AS tp FROM m GROUP BY 1)
"""


def _grid(spark, sf, size):
    """Boxes in degrees as grids in metres of zone 33: their edges, in 22 steps a side, projected and snapped outwards."""
    steps = [(i, j) for i in range(23) for j in range(23) if i in (0, 22) or j in (0, 22)]
    edge = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    p = _boxes(spark, sf).withColumn("p", edge)
    lon, lat = F.col("west") + (F.col("east") - F.col("west")) * F.col("p.i") / 22.0, F.col("south") + (F.col("north") - F.col("south")) * F.col("p.j") / 22.0
    east, north = S.to_utm(lon, lat, 33)
    g = p.select("c_custkey", east.alias("e"), north.alias("n")).groupBy("c_custkey").agg(*[f(c).alias(f"{c}{k}") for c in "en" for k, f in (("0", F.min), ("1", F.max))])
    left, right, cols = R.snapped(F.col("e0"), F.col("e1"), size)
    bottom, top, rows = R.snapped(F.col("n0"), F.col("n1"), size)
    return g.select("c_custkey", left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"), cols.alias("width"), rows.alias("height"))


_GRID = "SELECT c_custkey, lft::DOUBLE AS \"left\", btm::DOUBLE AS bottom, rgt::DOUBLE AS \"right\", tp::DOUBLE AS top, CAST((rgt - lft) / {0} AS BIGINT) AS width, CAST((tp - btm) / {0} AS BIGINT) AS height FROM b"


@query("WITH " + _UTM.format("20") + _GRID.format("20"))
def analysis_grid_R1(spark, sf):
    return _grid(spark, sf, 20.0)


@query("WITH " + _UTM.format("10") + _GRID.format("10"))
def display_grid_R2(spark, sf):
    return _grid(spark, sf, 10.0)


@query("WITH " + _UTM.split("b AS")[0].rstrip().rstrip(",") + " SELECT c_custkey, round(min(e), 3) AS west, round(max(e), 3) AS east, round(min(nn), 3) AS south, round(max(nn), 3) AS north FROM m GROUP BY 1")
def projected_bounds_R7(spark, sf):
    """Known coordinates against the projection written out in SQL, not only the way there and back."""
    steps = [(i, j) for i in range(23) for j in range(23) if i in (0, 22) or j in (0, 22)]
    p = _boxes(spark, sf).withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    east, north = S.to_utm(F.col("west") + (F.col("east") - F.col("west")) * F.col("p.i") / 22.0, F.col("south") + (F.col("north") - F.col("south")) * F.col("p.j") / 22.0, 33)
    g = p.select("c_custkey", east.alias("e"), north.alias("n")).groupBy("c_custkey")
    return g.agg(*[F.round(f(c), 3).alias(name) for c, f, name in (("e", F.min, "west"), ("e", F.max, "east"), ("n", F.min, "south"), ("n", F.max, "north"))])


@query("SELECT c_custkey, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y, CAST(floor((radians(lon) * 6378137 - 1335833.889519::DOUBLE) / 42.49620879501987::DOUBLE) AS BIGINT) AS c FROM (SELECT c_custkey, 12 + c_custkey % 50 / 10.0::DOUBLE AS lon, 58 + c_custkey % 37 / 10.0::DOUBLE AS lat FROM customer)")
def browser_grid_R3(spark, sf):
    """Places in Mercator metres and their column in the browser's grid of 42.496 m cells from 12 degrees east."""
    x, y = R.mercator(F.col("west"), F.col("south"))
    return _boxes(spark, sf).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.floor((x - 1335833.889519) / 42.49620879501987).alias("c"))


# Joins, sets and orders


@query("SELECT r, c, round(a.nbr::DOUBLE, 6) AS pre, round(b.nbr::DOUBLE, 6) AS post FROM (SELECT * FROM ann WHERE y = 1995) a JOIN (SELECT * FROM ann WHERE y = 1996) b USING (r, c)")
def positional_J1(spark, sf):
    a = annual(spark, sf)
    one = lambda y, n: a.filter(F.col("y") == y).select("r", "c", F.col("nbr").alias(n))
    return rounded(one(PRE, "pre").join(one(POST, "post"), ["r", "c"]))


@query("SELECT strftime(d, '%Y-%m-%d') AS date, string_agg(DISTINCT tile::VARCHAR, ',' ORDER BY tile::VARCHAR) AS tiles, count(*) AS items FROM obs GROUP BY d")
def date_groups_J3(spark, sf):
    tile = F.col("tile").cast("string")
    return obs(spark, sf).groupBy("d").agg(F.array_join(F.array_sort(F.collect_set(tile)), ",").alias("tiles"), F.count("*").alias("items")).select(F.date_format("d", "yyyy-MM-dd").alias("date"), "tiles", "items")


def _pairs(spark, sf, size):
    box = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("x"), (F.col("s_suppkey") % 50).alias("y"))
    span = lambda c: F.explode(F.sequence(F.expr(f"{c} div 8"), F.expr(f"({c} + {size - 1}) div 8")))
    box = box.withColumn("tx", span("x")).withColumn("ty", span("y"))
    a, b = (box.select(*[F.col(c).alias(c + k) for c in ("id", "x", "y")], "tx", "ty") for k in "ab")
    near = (F.col("ida") < F.col("idb")) & (F.abs(F.col("xa") - F.col("xb")) < size) & (F.abs(F.col("ya") - F.col("yb")) < size)
    return a.join(b, ["tx", "ty"]).filter(near).select(F.col("ida").alias("i"), F.col("idb").alias("j")).distinct()


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey - a.s_suppkey < 4 AND abs(a.s_suppkey % 50 - b.s_suppkey % 50) < 4 WHERE NOT (b.s_suppkey - a.s_suppkey < 3 AND abs(a.s_suppkey % 50 - b.s_suppkey % 50) < 3)")
def new_overlaps_J12(spark, sf):
    """Pairs of boxes that overlap only once they are widened."""
    return _pairs(spark, sf, 4).join(_pairs(spark, sf, 3), ["i", "j"], "left_anti")


@query("SELECT r, c FROM comp8 WHERE root IN (SELECT root FROM comp8 GROUP BY root HAVING count(*) >= 3)")
def retained_J13(spark, sf):
    labelled = O.components(candidates(spark, sf), width(spark, sf))
    large = labelled.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    return labelled.join(large, "root", "left_semi").select("r", "c")


@query("SELECT strftime(d, '%Y-%m-%d') AS d, r, c, item FROM (SELECT *, row_number() OVER (PARTITION BY d, r, c ORDER BY tile, item) AS k FROM idx WHERE nbr IS NOT NULL) WHERE k = 1")
def precedence_W2(spark, sf):
    w = Window.partitionBy("d", "r", "c").orderBy("tile", "item")
    first = indices(spark, sf).filter("nbr is not null").withColumn("k", F.row_number().over(w)).filter("k = 1")
    return first.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "r", "c", "item")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderkey::VARCHAR) AS place FROM orders")
def item_order_O1(spark, sf):
    """Items of a collection by time and id as texts; those without a time come first."""
    at = F.coalesce(F.when(F.col("o_orderkey") % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""))
    w = Window.partitionBy("o_custkey").orderBy(at, F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_custkey, coalesce(array_to_string(list_sort(list(DISTINCT y) FILTER (y NOT BETWEEN 1993 AND 1997)), ','), '') AS unsupported, coalesce(array_to_string(list_sort(list(DISTINCT y) FILTER (y BETWEEN 1993 AND 1997)), ','), '') AS years FROM (SELECT o_custkey, year(o_orderdate) AS y FROM orders) GROUP BY 1")
def unsupported_years_U6(spark, sf):
    known = F.array(*[F.lit(y) for y in range(1993, 1998)])
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))
    return g.select("o_custkey", F.array_join(F.array_except("years", known), ",").alias("unsupported"), F.array_join(F.array_intersect("years", known), ",").alias("years"))


@query("SELECT y, r, c, round(nbr::DOUBLE, 6) AS nbr FROM ann WHERE y IN (1995, 1997) UNION ALL SELECT y, r, c, round(nbr::DOUBLE, 6) FROM ann WHERE y = 1996 UNION ALL SELECT y, r, c, round(nbr::DOUBLE, 6) FROM ann WHERE y = 1996")
def union_all_U7(spark, sf):
    """Parts one after another; what stands in two of them stands twice."""
    a = annual(spark, sf).select("y", "r", "c", "nbr")
    part = lambda *years: a.filter(F.col("y").isin(*years))
    return rounded(part(1995, 1997).unionByName(part(1996)).unionByName(part(1996)))


# Statistics


@query("SELECT y, count(recovery) AS n, " + ", ".join(f"round(count(*) FILTER (recovery::DOUBLE {x}) / nullif(count(recovery), 0)::DOUBLE, 6) AS {k}" for k, x in (("lt_000", "< 0"), ("ge_000", ">= 0"), ("ge_050", ">= 0.5"), ("ge_080", ">= 0.8"), ("ge_100", ">= 1"), ("gt_100", "> 1"))) + " FROM oc GROUP BY y")
def threshold_fractions_A14(spark, sf):
    v = F.col("recovery").cast("double")
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), F.count(v))
    return rounded(object_cells(spark, sf).groupBy("y").agg(F.count(v).alias("n"), share(v < 0).alias("lt_000"), share(v >= 0).alias("ge_000"), share(v >= 0.5).alias("ge_050"), share(v >= 0.8).alias("ge_080"), share(v >= 1).alias("ge_100"), share(v > 1).alias("gt_100")))


@query("SELECT count(*) AS retained, count(*) FILTER (pre::DOUBLE - post::DOUBLE >= 0.25::DOUBLE) AS at_least, CASE WHEN count(*) FILTER (pre::DOUBLE - post::DOUBLE < 0.25::DOUBLE) > 0 THEN error('below') END AS checked FROM kept")
def denominator_check_A16(spark, sf):
    cells, _ = objects(spark, sf)
    return O.checked_denominators(cells, 0.3, 0.25).select("retained", "at_least", F.lit(None).cast("string").alias("checked"))


@query("SELECT y, round(quantile_cont(abs(nbr::DOUBLE), 0.99), 6) AS p99_abs, round(greatest(0.5::DOUBLE, quantile_cont(abs(nbr::DOUBLE), 0.99)), 6) AS limit_ FROM ann GROUP BY y")
def display_limit_A20(spark, sf):
    p = F.percentile(F.abs(F.col("nbr").cast("double")), F.lit(0.99))
    return rounded(annual(spark, sf).groupBy("y").agg(p.alias("p99_abs"), F.greatest(F.lit(0.5), p).alias("limit_")))


_SHOWN = ", ".join(f"{oracle._DISP.format(k, 0.3)} AS {k}_a, {oracle._DISP.format(k, 0.22)} AS {k}_b" for k in ("red", "nir", "swir2"))


@query(f"SELECT y, count(*) // 3 AS common, round(avg(x), 3) AS mean_difference, round(quantile_cont(x, 0.95), 3) AS p95_difference, CASE WHEN avg(x) <= 12 THEN 'materially preserved' ELSE 'review required' END AS assessment FROM (SELECT y, abs(unnest([red_a - red_b, nir_a - nir_b, swir2_a - swir2_b])) AS x FROM (SELECT y, {_SHOWN} FROM obs WHERE {oracle.VALID})) GROUP BY y")
def visual_comparison_A33(spark, sf):
    """Two renderings of the same scenes: mean and 95th percentile of the channels' absolute differences over what both show."""
    d = [F.abs(C.display(F.col(x), white=0.3) - C.display(F.col(x), white=0.22)).cast("double") for x in ("red", "nir", "swir2")]
    rows = obs(spark, sf).filter(C.scl_valid(F.col("scl"))).select(F.col("y").cast("long").alias("y"), F.explode(F.array(*d)).alias("x"))
    out = rows.groupBy("y").agg(F.expr("count(*) div 3").alias("common"), F.avg("x").alias("m"), F.percentile("x", F.lit(0.95)).alias("p"))
    return out.select("y", "common", F.round("m", 3).alias("mean_difference"), F.round("p", 3).alias("p95_difference"), F.when(F.col("m") <= R.SAME_PICTURE, "materially preserved").otherwise("review required").alias("assessment"))


@query("SELECT " + ", ".join(f"round(count(*) FILTER ({x}) / count(*)::DOUBLE, 6) AS {k}" for k, x in (("any_high", "red >= CAST(0.22 AS FLOAT) OR nir >= CAST(0.22 AS FLOAT) OR swir2 >= CAST(0.22 AS FLOAT)"), ("all_high", "red >= CAST(0.22 AS FLOAT) AND nir >= CAST(0.22 AS FLOAT) AND swir2 >= CAST(0.22 AS FLOAT)"), ("any_low", "red <= CAST(0.01 AS FLOAT) OR nir <= CAST(0.01 AS FLOAT) OR swir2 <= CAST(0.01 AS FLOAT)"), ("all_low", "red <= CAST(0.01 AS FLOAT) AND nir <= CAST(0.01 AS FLOAT) AND swir2 <= CAST(0.01 AS FLOAT)"))) + f", count(*) AS valid, y FROM obs WHERE {oracle.VALID} GROUP BY y")
def clipping_A22(spark, sf):
    """Shares of scenes that any or all channels clip."""
    bands = [F.col(x) for x in ("red", "nir", "swir2")]
    high, low = [b >= C.f32(0.22) for b in bands], [b <= C.f32(0.01) for b in bands]
    share = lambda c: F.count_if(c) / F.count("*")
    g = obs(spark, sf).filter(C.scl_valid(F.col("scl"))).groupBy("y")
    return rounded(g.agg(share(high[0] | high[1] | high[2]).alias("any_high"), share(high[0] & high[1] & high[2]).alias("all_high"), share(low[0] | low[1] | low[2]).alias("any_low"), share(low[0] & low[1] & low[2]).alias("all_low"), F.count("*").alias("valid")))


@query("SELECT white, channel, count(*) AS valid, " + ", ".join(f"round(count(*) FILTER (x = {k}) / count(*)::DOUBLE, 6) AS eq_{k}" for k in (0, 255)) + ", " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS {k}" for k, q in (("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))) + f", round(avg(x), 6) AS mean FROM (SELECT unnest([0.3, 0.22, 0.3, 0.22, 0.3, 0.22])::DOUBLE AS white, unnest(['red', 'red', 'nir', 'nir', 'swir2', 'swir2']) AS channel, unnest([red_a, red_b, nir_a, nir_b, swir2_a, swir2_b]) AS x FROM (SELECT {_SHOWN} FROM obs WHERE {oracle.VALID})) GROUP BY 1, 2")
def render_variants_H16(spark, sf):
    """Tones of the renderings at both white points, from one scan."""
    shown = [F.struct(F.lit(w).alias("white"), F.lit(x).alias("channel"), C.display(F.col(x), white=w).cast("double").alias("x")) for w in (0.3, 0.22) for x in ("red", "nir", "swir2")]
    rows = obs(spark, sf).filter(C.scl_valid(F.col("scl"))).select(F.explode(F.array(*shown)).alias("s")).select("s.*")
    at = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    out = rows.groupBy("white", "channel").agg(F.count("*").alias("valid"), *[(F.count_if(F.col("x") == k) / F.count("*")).alias(f"eq_{k}") for k in (0, 255)], F.percentile("x", F.array(*map(F.lit, at.values()))).alias("p"), F.avg("x").alias("mean"))
    return rounded(out.select("white", "channel", "valid", "eq_0", "eq_255", *[F.col("p")[i].alias(k) for i, k in enumerate(at)], "mean"))


@query("SELECT y, count(*) FILTER (r >= 1 AND r < w - 1 AND c >= 1 AND c < w - 1 AND nbr IS NOT NULL) AS valid FROM ann, w GROUP BY y")
def area_count_H6(spark, sf):
    inside = aoi(width(spark, sf))(F.col("r"), F.col("c"))
    return annual(spark, sf).groupBy(F.col("y").cast("long").alias("y")).agg(F.count_if(inside & F.col("nbr").isNotNull()).alias("valid"))


@query("SELECT item, round(nbr::DOUBLE, 6) AS nbr, round(ndvi::DOUBLE, 6) AS ndvi, round(more::DOUBLE, 6) AS nbr_whatif, round(moreni::DOUBLE, 6) AS ndvi_whatif FROM (SELECT i.*, " + oracle._nd("nir", "swir2", "preserve") + " AS more, " + oracle._nd("nir", "red", "preserve") + " AS moreni FROM idx i)")
def item_stages_H4(spark, sf):
    """Both indices under both treatments, in one pass over the items."""
    ok, a = C.scl_valid(F.col("scl")), F.col("nir")
    nd = lambda b, t: r6(C.normalised_difference(a, F.col(b), ok, t))
    return obs(spark, sf).select("item", nd("swir2", "reject").alias("nbr"), nd("red", "reject").alias("ndvi"), nd("swir2", "preserve").alias("nbr_whatif"), nd("red", "preserve").alias("ndvi_whatif"))


_MODES = ("reject", "preserve", "clamp-zero")


@query("SELECT mode, y, count(v) AS n, round(min(v), 6) AS low, round(median(v), 6) AS median, round(max(v), 6) AS high FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, y, ({oracle._nd('nir', 'swir2', m)})::DOUBLE AS v FROM obs" for m in _MODES) + ") GROUP BY mode, y")
def variant_values_H7_H8(spark, sf):
    """The index under each treatment as rows of one table, and their distributions side by side."""
    ok = C.scl_valid(F.col("scl"))
    rows = obs(spark, sf).select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), C.normalised_difference(F.col("nir"), F.col("swir2"), ok, m).cast("double").alias("v")) for m in _MODES])).alias("s")).select("y", "s.*")
    return rounded(rows.groupBy("mode", "y").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.median("v").alias("median"), F.max("v").alias("high")))


# Payloads


@query("SELECT printf('disturbance-%03d', label) AS disturbance_id, y AS year, " + ", ".join(f"round({k}, 4) + 0 AS {k}" for k in ("nbr_median", "recovery_median", "recovery_p10", "recovery_p90", "nbr_fraction", "ndvi_median", "ndvi_fraction")) + ", status, reporting_recommended FROM oy")
def series_payload_H1(spark, sf):
    """The rows of the time series: an object of ten rounded fields a year, as they stand in the document."""
    names = ("nbr_median", "recovery_median", "recovery_p10", "recovery_p90", "nbr_fraction", "ndvi_median", "ndvi_fraction")
    row = F.struct(F.col("y").alias("year"), *[R.rounded_number(F.col(k), 4, k).alias(k) for k in names], "status", "reporting_recommended")
    g = object_years(spark, sf).groupBy("label").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
    back = F.from_json("json", "array<struct<year:long," + ",".join(f"{k}:double" for k in names) + ",status:string,reporting_recommended:boolean>>")
    return g.select(M.object_id(F.col("label")).alias("disturbance_id"), F.explode(back).alias("s")).select("disturbance_id", "s.*")


@query("SELECT l.y AS year, " + ", ".join(f"round(l.{k}, 4) + 0 AS {k}" for k in ("nbr_median", "recovery_median", "recovery_p10", "recovery_p90", "nbr_fraction", "f_ge_050", "f_ge_080", "f_ge_100", "f_lt_0", "f_gt_100", "ndvi_median", "ndvi_fraction")) + ", good, usable, poor, zero_valid FROM ly l JOIN (SELECT y, count(*) FILTER (status = 'GOOD') AS good, count(*) FILTER (status = 'USABLE_WITH_COVERAGE_FLAG') AS usable, count(*) FILTER (status = 'POOR') AS poor, count(*) FILTER (nbr_count = 0) AS zero_valid FROM oy GROUP BY y) x USING (y)")
def summary_payload_H2(spark, sf):
    """Landscape years beside the objects' coverage classes."""
    names = ("nbr_median", "recovery_median", "recovery_p10", "recovery_p90", "nbr_fraction", "f_ge_050", "f_ge_080", "f_ge_100", "f_lt_0", "f_gt_100", "ndvi_median", "ndvi_fraction")
    s = F.col("status")
    classes = object_years(spark, sf).groupBy("y").agg(F.count_if(s == "GOOD").alias("good"), F.count_if(s == "USABLE_WITH_COVERAGE_FLAG").alias("usable"), F.count_if(s == "POOR").alias("poor"), F.count_if(F.col("nbr_count") == 0).alias("zero_valid"))
    whole = object_years(spark, sf, ("y",)).select("y", *[R.rounded_number(F.col(k), 4, k).alias(k) for k in names])
    return whole.join(classes, "y").withColumn("year", F.col("y").cast("long")).drop("y")


_BIG = "SELECT s_suppkey, p_size + 1 AS w, p_size + 3 AS h FROM supplier JOIN part ON p_partkey = s_suppkey"


@query(f"SELECT decimals, round(100 * (area - whole) / whole, 6) + 0 AS total_pct, round(worst, 6) + 0 AS worst_pct FROM (SELECT 5 AS decimals, sum(round(w / 7000::DOUBLE, 5) * round(h / 7000::DOUBLE, 5)) AS area, sum(w / 7000::DOUBLE * (h / 7000::DOUBLE)) AS whole, max(abs(100 * (round(w / 7000::DOUBLE, 5) * round(h / 7000::DOUBLE, 5) - w / 7000::DOUBLE * (h / 7000::DOUBLE)) / (w / 7000::DOUBLE * (h / 7000::DOUBLE)))) AS worst FROM ({_BIG}) UNION ALL SELECT 6, sum(round(w / 7000::DOUBLE, 6) * round(h / 7000::DOUBLE, 6)), sum(w / 7000::DOUBLE * (h / 7000::DOUBLE)), max(abs(100 * (round(w / 7000::DOUBLE, 6) * round(h / 7000::DOUBLE, 6) - w / 7000::DOUBLE * (h / 7000::DOUBLE)) / (w / 7000::DOUBLE * (h / 7000::DOUBLE)))) FROM ({_BIG})) WHERE abs(100 * (area - whole) / whole) <= 0.1 AND worst <= 0.5 ORDER BY decimals LIMIT 1")
def coordinate_precision_W9(spark, sf):
    """The first number of decimals at which rounded outlines keep their areas; both are judged in one pass, and neither passing is an error."""
    p = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(((F.col("p_size") + 1) / 7000.0).alias("w"), ((F.col("p_size") + 3) / 7000.0).alias("h"))
    whole = F.col("w") * F.col("h")
    tries = p.select(whole.alias("whole"), F.explode(F.array(*[F.struct(F.lit(d).alias("decimals"), (F.round("w", d) * F.round("h", d)).alias("area")) for d in R.DECIMALS])).alias("t")).select("whole", "t.*")
    qa = tries.groupBy("decimals").agg((100 * (F.sum("area") - F.sum("whole")) / F.sum("whole")).alias("total_pct"), F.max(F.abs(100 * (F.col("area") - F.col("whole")) / F.col("whole"))).alias("worst_pct"))
    ok = qa.filter((F.abs("total_pct") <= R.TOTAL_AREA_LIMIT) & (F.col("worst_pct") <= R.FEATURE_AREA_LIMIT))
    best = ok.agg(F.min_by(F.struct("decimals", "total_pct", "worst_pct"), "decimals").alias("b"))
    none = F.raise_error(F.lit("rounded outlines fail at every precision")).cast("int")
    return best.select(F.coalesce("b.decimals", none).cast("long").alias("decimals"), r6("b.total_pct").alias("total_pct"), r6("b.worst_pct").alias("worst_pct"))


# Checks


def _outputs(spark, sf):
    """Customers as years with outputs: some without files, some without one of them, some with wrong summaries."""
    k = F.col("c_custkey")
    files = F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array(*map(F.lit, R.ANNUAL_FILES)), lambda f: ~((k % 9 == 1) & (f == "ndvi"))))
    year = F.when(k % 9 != 2, 2017 + k % 10).otherwise(F.lit(1900))
    text = F.concat(F.lit('{"year":'), year, F.lit(',"outputs":{"files":{"nbr":1}'), F.when(k % 9 != 3, F.concat(F.lit(',"sizes":'), F.when(k % 9 == 4, "null").otherwise("{}"))).otherwise(""), F.lit('},"processing":{"treatment":"'), F.when(k % 9 == 5, "preserve").otherwise("reject"), F.lit('"}'), F.when(k % 9 == 6, "").otherwise("}"))
    return table(spark, sf, "customer").select("c_custkey", (2017 + k % 10).alias("year"), files.alias("files"), text.alias("summary"), F.when(k % 9 == 7, 10.0).otherwise(20.0).alias("resolution"))


@query("SELECT c_custkey, k = 3 OR k = 6 AS no_sizes, k = 6 AS no_year FROM (SELECT c_custkey, c_custkey % 9 AS k FROM customer)")
def missing_path_H19(spark, sf):
    """Paths in documents; a null at the end of one is there, and a text that is no document has none."""
    return _outputs(spark, sf).select("c_custkey", R.missing_path(F.col("summary"), "outputs.sizes").alias("no_sizes"), R.missing_path(F.col("summary"), "year").alias("no_year"))


def classified(outputs: DataFrame) -> DataFrame:
    """outputs (files, year, summary, resolution) with missing, problems and state."""
    doc = F.try_parse_json("summary")
    checks = {
        "summary can't be parsed": doc.isNull(), "summary has no sizes": R.missing_path(F.col("summary"), "outputs.sizes"), "wrong year": F.try_variant_get(doc, "$.year", "long") != F.col("year"),
        "wrong treatment": F.try_variant_get(doc, "$.processing.treatment", "string") != "reject", "wrong resolution": F.abs(F.col("resolution") - 20) > 1e-9,
    }
    missing = F.array_except(F.array(*map(F.lit, R.ANNUAL_FILES)), F.col("files"))
    rows = outputs.withColumns({"missing": missing, "problems": F.when(F.size(missing) == 0, R.reasons(checks)).otherwise(F.array().cast("array<string>"))})
    return rows.withColumn("state", R.annual_state(F.size("files"), F.col("missing"), F.col("problems")))


_PROBLEMS = "CASE k WHEN 2 THEN 'wrong year' WHEN 3 THEN 'summary has no sizes' WHEN 5 THEN 'wrong treatment' WHEN 6 THEN 'summary can''t be parsed; summary has no sizes; wrong year; wrong treatment' WHEN 7 THEN 'wrong resolution' ELSE '' END"


@query(f"SELECT c_custkey, CASE k WHEN 0 THEN 'MISSING' WHEN 4 THEN 'COMPLETE' WHEN 8 THEN 'COMPLETE' ELSE 'INVALID' END AS state, CASE k WHEN 0 THEN 'nbr, ndvi, valid_count, summary' WHEN 1 THEN 'ndvi' ELSE '' END AS missing, {_PROBLEMS} AS problems FROM (SELECT c_custkey, c_custkey % 9 AS k FROM customer)")
def annual_outputs_V2(spark, sf):
    return classified(_outputs(spark, sf)).select("c_custkey", "state", F.array_join("missing", ", ").alias("missing"), F.array_join("problems", "; ").alias("problems"))


@query("SELECT c_custkey, CASE k WHEN 4 THEN 'already_complete' WHEN 8 THEN 'already_complete' WHEN 0 THEN 'built' ELSE 'refused' END AS status, CASE k WHEN 0 THEN 'MISSING' WHEN 4 THEN 'COMPLETE' WHEN 8 THEN 'COMPLETE' ELSE 'INVALID' END AS before, CASE WHEN k IN (0, 4, 8) THEN 'COMPLETE' END AS after FROM (SELECT c_custkey, c_custkey % 9 AS k FROM customer)")
def batch_record_H20(spark, sf):
    """What a resumable batch notes of a year: only a missing output is built, a complete one is kept, an invalid one is left alone."""
    s = F.col("state")
    status = F.when(s == "COMPLETE", "already_complete").when(s == "MISSING", "built").otherwise("refused")
    return classified(_outputs(spark, sf)).select("c_custkey", status.alias("status"), s.alias("before"), F.when(status != "refused", "COMPLETE").alias("after"))


@query("SELECT count(*) AS cells, count(*) FILTER (b IS NULL) AS unlabelled, count(*) FILTER (a IS NULL) AS unmasked FROM (SELECT r, c, 1 AS a FROM kept) x FULL JOIN (SELECT r, c, label AS b FROM kept JOIN lab USING (root)) z USING (r, c)")
def recovery_inputs_V3(spark, sf):
    """Mask against labels, cell by cell: every masked cell has a label and every labelled one is masked."""
    cells, _ = objects(spark, sf)
    mask = O.keep_large(O.components(candidates(spark, sf), width(spark, sf)), LEAST, ["root"]).select("r", "c", F.lit(1).alias("a"))
    both = mask.join(cells.select("r", "c", F.col("label").alias("b")), ["r", "c"], "full_outer")
    return both.agg(F.count("*").alias("cells"), F.count_if(F.col("b").isNull()).alias("unlabelled"), F.count_if(F.col("a").isNull()).alias("unmasked"))


@query("SELECT l.y AS year, abs(l.nbr_fraction - x.f) > 1e-12 AS differs, x.n AS objects FROM ly l JOIN (SELECT y, sum(nbr_fraction * total) / sum(total) AS f, count(*) AS n FROM oy GROUP BY y) x USING (y)")
def completeness_V4(spark, sf):
    whole = object_years(spark, sf, ("y",)).select("y", "nbr_fraction")
    parts = object_years(spark, sf).groupBy("y").agg((F.sum(F.col("nbr_fraction") * F.col("total")) / F.sum("total")).alias("f"), F.count("*").alias("objects"))
    return whole.join(parts, "y").select(F.col("y").cast("long").alias("year"), (F.abs(F.col("nbr_fraction") - F.col("f")) > 1e-12).alias("differs"), "objects")


@query("SELECT CAST(count(DISTINCT label) AS BIGINT) AS objects, CAST(count(*) AS BIGINT) AS records, count(DISTINCT label) * count(DISTINCT y) = count(*) AS every_year_once, abs(sum(area_ha) / count(DISTINCT y) - (SELECT sum(area_ha) FROM lab)) <= 1e-6 AS areas_agree, bool_and(status IN ('GOOD', 'USABLE_WITH_COVERAGE_FLAG', 'POOR')) AS known_status FROM oy")
def source_context_V5(spark, sf):
    """What must hold between the objects and their years before anything is packed."""
    rows = object_years(spark, sf)
    _, stats = objects(spark, sf)
    g = rows.agg(F.count_distinct("label").alias("objects"), F.count("*").alias("records"), F.count_distinct("y").alias("years"), F.sum("area_ha").alias("area"), F.bool_and(F.col("status").isin(*R.COVERAGE_LABELS)).alias("known_status"))
    both = g.join(stats.agg(F.sum("area_ha").alias("whole")))
    return both.select("objects", "records", (F.col("objects") * F.col("years") == F.col("records")).alias("every_year_once"), (F.abs(F.col("area") / F.col("years") - F.col("whole")) <= 1e-6).alias("areas_agree"), "known_status")


@query("SELECT count(*) FILTER (b.nbr IS NOT NULL AND a.nbr IS NULL) AS expanded, count(*) FILTER (a.nbr IS NOT NULL AND b.nbr IS NULL) AS lost, round(count(a.nbr) / count(*)::DOUBLE, 6) AS source_fraction, round(count(b.nbr) / count(*)::DOUBLE, 6) AS result_fraction FROM (SELECT r, c, nbr FROM ann WHERE y = 1995) a FULL JOIN (SELECT r, c, nbr FROM ann_p WHERE y = 1995) b USING (r, c)")
def mask_expansion_V9(spark, sf):
    """A result's valid cells against its source's: those that it may not have, and those that it lost."""
    a, b = (annual(spark, sf, t).filter(F.col("y") == PRE).select("r", "c", F.col("nbr").alias(n)) for t, n in (("reject", "a"), ("preserve", "b")))
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return rounded(a.join(b, ["r", "c"], "full_outer").agg(F.count_if(y & ~x).alias("expanded"), F.count_if(x & ~y).alias("lost"), (F.count_if(x) / F.count("*")).alias("source_fraction"), (F.count_if(y) / F.count("*")).alias("result_fraction")))


@query("SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'not written' WHEN n <> claimed THEN 'size differs' ELSE 'agrees' END AS verdict FROM (SELECT c_custkey, c_custkey % 20 + 1 AS claimed FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def manifest_V10(spark, sf):
    """What a manifest claims against what was written."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 20 + 1).alias("claimed")).join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.when(F.col("o_custkey").isNull(), "not written").when(F.col("n") != F.col("claimed"), "size differs").otherwise("agrees").alias("verdict"))


@query("SELECT s_suppkey, s_nationkey <> 3 AND s_suppkey % 4 <> 0 AS same FROM supplier")
def grid_identity_V1_V12(spark, sf):
    """Grids of two rasters: the system and the size must be equal, the corner within 1e-9 and the bounds within 1e-6."""
    k = F.col("s_suppkey")
    a = table(spark, sf, "supplier").select(k.alias("key"), F.lit("EPSG:32633").alias("crs"), F.lit(1266).alias("width"), F.lit(499980.0).alias("left"), F.lit(25320.0).alias("extent"))
    b = table(spark, sf, "supplier").select(k.alias("key"), F.when(F.col("s_nationkey") == 3, "EPSG:4326").otherwise("EPSG:32633").alias("crs"), F.lit(1266).alias("width"), (499980.0 + F.when(k % 4 == 0, 1e-6).otherwise(0.0)).alias("left"), F.lit(25320.0 + 5e-7).alias("extent"))
    from ..sources import rasters

    got = rasters.require_same_grid(a, b, {"crs": 0, "width": 0, "left": 1e-9, "extent": 1e-6})
    return got.select(F.col("key").alias("s_suppkey"), (~F.col("differs")).alias("same"))


@query("SELECT y, count(*) FILTER (nbr IS NULL) AS invalid, count(*) FILTER ((nbr IS NOT NULL AND (r + c) % 17 = 0) OR (nbr IS NULL AND (r + c) % 13 = 0)) AS wrong FROM ann GROUP BY y")
def mask_values_H11(spark, sf):
    """Encoded cells against their masks: invalid ones hold the sentinel, valid ones a finite value. Some of both kinds are spoilt first."""
    from ..sources import rasters

    valid, at = F.col("nbr").isNotNull(), F.col("r") + F.col("c")
    v = F.when(valid & (at % 17 == 0), C.f32(float("nan"))).when(~valid & (at % 13 == 0), C.f32(0.0)).otherwise(F.coalesce(F.col("nbr"), C.f32(rasters.FLOAT_NODATA)))
    wrong = (~valid & (v != rasters.FLOAT_NODATA)) | (valid & ~(C.finite(v) & (v != rasters.FLOAT_NODATA)))
    return annual(spark, sf).groupBy(F.col("y").cast("long").alias("y")).agg(F.count_if(~valid).alias("invalid"), F.count_if(wrong).alias("wrong"))
