"""Queries on scans, catalogs, joins of rasters, objects and packages, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metadata as M
from ..operators import cells as O
from ..operators import polygons
from ..operators.graph import cut, shared_path
from ..sources import catalog, rasters, sinks
from . import oracle
from .queries import LEAST, POST, PRE, aoi, annual, candidates, indices, object_cells, object_years, objects, obs, pairs, r6, rounded, table, width

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NODATA = {"nbr": rasters.FLOAT_NODATA, "ndvi": rasters.FLOAT_NODATA, "nbr_count": rasters.COUNT_NODATA}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle.compose(sql)
        return f

    return register


def stored(spark, sf, box=None):
    """The annual cells, written as tiles and read back, all or those in a box."""
    path = shared_path(spark, "cells")
    rasters.write(annual(spark, sf).drop("ndvi_count").withColumnRenamed("y", "year"), path, NODATA, tile=16)
    return rasters.read(spark, path, NODATA, box, tile=16).drop("tile_r", "tile_c")


# Scans and sinks of cells


@query("SELECT y AS year, r, c, round(nbr::DOUBLE, 6) AS nbr, round(ndvi::DOUBLE, 6) AS ndvi, nbr_count FROM ann")
def cell_store_K1(spark, sf):
    return rounded(stored(spark, sf).select(F.col("year").cast("long").alias("year"), "r", "c", "nbr", "ndvi", "nbr_count"))


@query("SELECT y AS year, r, c, round(nbr::DOUBLE, 6) AS nbr FROM ann WHERE r >= 2 AND r < 10 AND c >= 1 AND c < 9")
def window_read_S6(spark, sf):
    return rounded(stored(spark, sf, (2, 1, 10, 9)).select(F.col("year").cast("long").alias("year"), "r", "c", "nbr"))


@query("SELECT y AS year, count(nbr) AS valid, round(min(nbr::DOUBLE), 6) AS low, round(max(nbr::DOUBLE), 6) AS high FROM ann, w WHERE r >= w // 2 - 2 AND r < w // 2 + 2 AND c >= w // 2 - 2 AND c < w // 2 + 2 GROUP BY y")
def centre_probe_S8(spark, sf):
    m = width(spark, sf) // 2
    got = stored(spark, sf, (m - 2, m - 2, m + 2, m + 2)).groupBy(F.col("year").cast("long").alias("year"))
    return rounded(got.agg(F.count("nbr").alias("valid"), F.min("nbr").alias("low"), F.max("nbr").alias("high")))


@query("SELECT i // k AS tile_r, i % k AS tile_c, least(16, w - i // k * 16) AS rows, least(16, w - i % k * 16) AS cols FROM (SELECT w, (w + 15) // 16 AS k FROM w), unnest(range(k * k)) AS u(i)")
def blocks_S9(spark, sf):
    w = width(spark, sf)
    return rasters.blocks(spark, w, w, 16)


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value FROM events")
def nodata_S10(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, rasters.FLOAT_NODATA).when(k % 11 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", rasters.decoded(raw).alias("value"))


@query("SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, round(a.nbr::DOUBLE, 6) AS pre, round(b.nbr::DOUBLE, 6) AS post FROM (SELECT * FROM ann WHERE y = 1995) a FULL JOIN (SELECT * FROM ann WHERE y = 1996) b ON a.r = b.r AND a.c = b.c")
def raster_set_S12(spark, sf):
    a = annual(spark, sf)
    one = lambda y, name: a.filter(F.col("y") == y).select("r", "c", F.col("nbr").alias(name))
    return rounded(one(PRE, "pre").join(one(POST, "post"), ["r", "c"], "full_outer"))


@query("SELECT count(*) AS cells, count(DISTINCT label) AS labels, max(label) AS high, count(DISTINCT label) = max(label) AS contiguous FROM kept JOIN lab USING (root)")
def footprint_S14(spark, sf):
    cells, _ = objects(spark, sf)
    n, high = F.count_distinct("label"), F.max("label").cast("long")
    return cells.agg(F.count("*").alias("cells"), n.alias("labels"), high.alias("high"), (n == high).alias("contiguous"))


@query("SELECT y, r // f AS r, c // f AS c, round(nbr::DOUBLE, 6) AS nbr FROM ann, (SELECT w, greatest(1, (w + 7) // 8) AS f FROM w) g WHERE r = least(r // f * f + f // 2, w - 1) AND c = least(c // f * f + f // 2, w - 1)")
def overview_S16(spark, sf):
    w = width(spark, sf)
    return rounded(rasters.decimated(annual(spark, sf).select("y", "r", "c", "nbr"), w, w, 8))


# Catalogs


def items(spark, sf):
    """Orders as catalog items: through JSON text, as a search returns them."""
    o = table(spark, sf, "orders")
    x = (F.col("o_custkey") % 100).cast("double")
    asset = lambda href, kind: F.struct(F.concat(F.lit("https://h/"), F.col("o_orderkey"), F.lit(href)).alias("href"), F.lit(kind).alias("type"), F.array(F.struct(F.lit(0.0001).alias("scale"), F.lit(-0.1).alias("offset"))).alias("raster:bands"))
    found = F.create_map(F.lit("nir"), asset("/B08.tif", "image/tiff; profile=cloud-optimized"), F.lit("visual"), asset("/TCI.tif", "image/tiff"), F.lit("red-jp2"), asset("/B04.jp2", "image/jp2"), F.lit("scl"), asset("/SCL.tif", "image/tiff"))
    props = F.create_map(F.lit("datetime"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("platform"), F.lit("a"))
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("collection"), F.array(x, x, x + 10, x + 10).alias("bbox"), props.alias("properties"), found.alias("assets")))
    return catalog.items_of(o.select(text.alias("json")))


_SEARCH = "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_custkey % 100 BETWEEN 30 AND 60 AND "


@query(_SEARCH + "year(o_orderdate) = 1996")
def search_S2(spark, sf):
    first = table(spark, sf, "orders").agg(F.min("o_orderpriority")).first()[0]
    got = catalog.search(items(spark, sf), first, (40.0, 40.0, 60.0, 60.0), "1996-01-01T00:00:00Z", "1997-01-01T00:00:00Z")
    return got.select("id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(_SEARCH + "o_orderdate >= DATE '1996-08-01' AND o_orderdate < DATE '1996-09-01'")
def season_S3(spark, sf):
    first = table(spark, sf, "orders").agg(F.min("o_orderpriority")).first()[0]
    got = catalog.search(items(spark, sf), first, (40.0, 40.0, 60.0, 60.0), "1996-08-01T00:00:00Z", "1996-09-01T00:00:00Z")
    return got.select("id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("SELECT o_orderkey::VARCHAR AS id, band, key, 'https://h/' || o_orderkey || tail AS href, cog AS cog_likely, 0.0001::DOUBLE AS scale, -0.1::DOUBLE AS \"offset\" FROM orders, (VALUES ('nir', 'nir', '/B08.tif', true), ('scl', 'scl', '/SCL.tif', true)) t(band, key, tail, cog)")
def flatten_S4(spark, sf):
    return catalog.assets(items(spark, sf))


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS collection, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS at FROM orders")
def inventory_S5(spark, sf):
    """One inventory document a customer, written as JSON files and scanned."""
    path = shared_path(spark, "inventory")
    i = items(spark, sf)
    i.groupBy(F.col("bbox")).agg(F.collect_list(F.struct(*i.columns)).alias("items")).select(F.to_json(F.struct("items")).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.from_json("value", f"items array<{catalog.ITEM}>").alias("d")).select(F.explode("d.items").alias("i"))
    return lines.select("i.id", "i.collection", catalog.datetime_of(F.col("i.properties")).alias("at"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def file_listing_S20(spark, sf):
    """Files listed without their contents; every partition's folder has some, so its rows are those of its listed files."""
    path = shared_path(spark, "listing")
    table(spark, sf, "orders").select(F.col("o_orderpriority"), "o_orderkey").write.partitionBy("o_orderpriority").parquet(path)
    listed = catalog.files(spark, path, "*.parquet").select(F.url_decode(F.substring_index("path", "/", -1)).alias("file")).distinct()
    rows = spark.read.parquet(path).select("o_orderpriority", F.url_decode(F.substring_index("_metadata.file_path", "/", -1)).alias("file"))
    return rows.join(listed, "file", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_custkey, o_orderkey) AS place, o_orderkey FROM orders")
def same_date_order_O2(spark, sf):
    w = Window.partitionBy("o_orderdate").orderBy("o_custkey", "o_orderkey")
    return table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.row_number().over(w).cast("long").alias("place"), "o_orderkey")


@query("SELECT o_orderkey::VARCHAR AS id, 'nir' AS key FROM orders")
def first_asset_O3(spark, sf):
    return items(spark, sf).select("id", F.array_min(F.map_keys("assets")).alias("key"))


@query("SELECT o_orderkey FROM orders ORDER BY year(o_orderdate) <> 1996, o_totalprice <= 1000, o_orderdate, o_orderkey LIMIT 1")
def representative_O6(spark, sf):
    return table(spark, sf, "orders").orderBy(F.year("o_orderdate") != 1996, F.col("o_totalprice") <= 1000, "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS items, count(DISTINCT tile) AS tiles, count(nbr) AS valid FROM idx GROUP BY d HAVING count(nbr) > 0")
def usable_acquisitions_F6(spark, sf):
    g = indices(spark, sf).groupBy("d").agg(F.count("*").alias("items"), F.count_distinct("tile").alias("tiles"), F.count("nbr").alias("valid"))
    return g.filter("valid > 0").select(F.date_format("d", "yyyy-MM-dd").alias("date"), "items", "tiles", "valid")


# Cells


@query("SELECT item, round(ndvi::DOUBLE, 6) AS ndvi, CASE WHEN ndvi IS NULL THEN 0 ELSE 255 END AS alpha FROM idx")
def ndvi_P4(spark, sf):
    return indices(spark, sf).select("item", r6("ndvi").alias("ndvi"), F.when(F.col("ndvi").isNull(), 0).otherwise(255).alias("alpha"))


@query(f"SELECT item, CASE WHEN {oracle.VALID} THEN round(greatest(red, 0)::DOUBLE, 6) END AS red, CASE WHEN {oracle.VALID} THEN round(greatest(nir, 0)::DOUBLE, 6) END AS nir FROM obs")
def rgb_prepare_P13(spark, sf):
    ok = C.scl_valid(F.col("scl")) & C.finite(F.col("red")) & C.finite(F.col("nir")) & C.finite(F.col("swir2"))
    up = lambda x: F.when(ok, r6(F.greatest(F.col(x), C.f32(0.0))))
    return obs(spark, sf).select("item", up("red").alias("red"), up("nir").alias("nir"))


@query("SELECT y, count(*) FILTER (r >= 1 AND r < w - 1 AND c >= 1 AND c < w - 1) AS cells, count(nbr) FILTER (r >= 1 AND r < w - 1 AND c >= 1 AND c < w - 1) AS valid FROM ann, w GROUP BY y")
def area_mask_J2(spark, sf):
    inside = aoi(width(spark, sf))(F.col("r"), F.col("c"))
    return annual(spark, sf).groupBy(F.col("y").cast("long").alias("y")).agg(F.count_if(inside).alias("cells"), F.count_if(inside & F.col("nbr").isNotNull()).alias("valid"))


@query("SELECT a.r, a.c, count(*) - 1 AS neighbours FROM cand a JOIN cand b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c")
def neighbours_J15(spark, sf):
    """Candidates among the eight cells around; each cell is sent to its neighbours' keys, so the join is on equal keys."""
    own = cut(candidates(spark, sf).select("r", "c"), "candidates")
    near = F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    seen = own.select(F.explode(near).alias("s")).groupBy("s.r", "s.c").agg(F.count("*").alias("n"))
    return own.join(seen, ["r", "c"], "left").select("r", "c", F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


@query("SELECT r, c FROM (SELECT DISTINCT a.r + i AS r, a.c + j AS c FROM cand a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) z(j)), w WHERE r >= 0 AND c >= 0 AND r < w AND c < w")
def focal_max_W5(spark, sf):
    w = width(spark, sf)
    near = F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = candidates(spark, sf).select(F.explode(near).alias("s")).select("s.r", "s.c")
    return out.filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < w) & (F.col("c") < w)).distinct()


@query("SELECT y, r, c FROM ann WHERE y = 1995 AND nbr IS NOT NULL UNION SELECT 1995, r, c FROM ann WHERE y = 1996 AND nbr IS NOT NULL")
def union_U1(spark, sf):
    a = annual(spark, sf).filter("nbr is not null")
    return a.filter(F.col("y").isin(PRE, POST)).select(F.lit(PRE).cast("long").alias("y"), "r", "c").distinct()




# Objects


@query("SELECT root, count(*) AS n FROM comp8 GROUP BY root")
def component_sizes_A9(spark, sf):
    return O.components(candidates(spark, sf), width(spark, sf)).groupBy("root").agg(F.count("*").alias("n"))


@query("SELECT label, r, c, printf('disturbance-%03d', label) AS disturbance_id, round(n * 0.04::DOUBLE, 6) AS area_ha FROM (SELECT label, r, c, count(*) OVER (PARTITION BY root) AS n FROM kept JOIN lab USING (root))")
def zonal_J4(spark, sf):
    cells, stats = objects(spark, sf)
    named = stats.select("label", M.object_id(F.col("label")).alias("disturbance_id"), r6("area_ha").alias("area_ha"))
    return cells.select("label", "r", "c").join(named, "label").select(F.col("label").cast("long").alias("label"), "r", "c", "disturbance_id", "area_ha")


@query("SELECT label, count(*) AS area FROM kept JOIN lab USING (root) GROUP BY label")
def polygons_W7(spark, sf):
    """Outlines of the objects; exterior rings less holes have the objects' areas."""
    cells, _ = objects(spark, sf)
    rings = polygons.outlines(cells.select(F.col("label").cast("long").alias("label"), "r", "c"))
    return rings.groupBy("label").agg(F.sum("area").cast("long").alias("area"))


@query("SELECT label, min(c) AS west, min(r) AS north, max(c) + 1 AS east, max(r) + 1 AS south FROM kept JOIN lab USING (root) GROUP BY label")
def bounds_A35(spark, sf):
    cells, _ = objects(spark, sf)
    rings = polygons.outlines(cells.select(F.col("label").cast("long").alias("label"), "r", "c"))
    p = rings.select("label", F.explode("points").alias("p"))
    return p.groupBy("label").agg(*[f(f"p.{k}").cast("long").alias(n) for f, k, n in ((F.min, "x", "west"), (F.min, "y", "north"), (F.max, "x", "east"), (F.max, "y", "south"))])


@query("SELECT label, y, round(recovery_median, 6) AS recovery FROM oy WHERE label = 1 AND y = 1998")
def lookup_J17(spark, sf):
    return object_years(spark, sf).filter("label = 1 and y = 1998").select(F.col("label").cast("long").alias("label"), F.col("y").cast("long").alias("y"), r6("recovery_median").alias("recovery"))


@query("SELECT y, count(*) AS objects, count(*) FILTER (status <> 'POOR' AND recovery_median IS NOT NULL) AS trusted FROM oy GROUP BY y")
def trusted_F11(spark, sf):
    ok = (F.col("status") != "POOR") & F.col("recovery_median").isNotNull()
    return object_years(spark, sf).groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("objects"), F.count_if(ok).alias("trusted"))


@query("SELECT l.y AS year, abs(l.nbr_fraction - x.f) <= 1e-12 AS same FROM ly l JOIN (SELECT y, sum(nbr_count) / sum(total)::DOUBLE AS f FROM oy GROUP BY y) x USING (y)")
def year_reconcile_J8(spark, sf):
    whole = object_years(spark, sf, ("y",)).select("y", "nbr_fraction")
    parts = object_years(spark, sf).groupBy("y").agg((F.sum("nbr_count") / F.sum("total")).alias("f"))
    return whole.join(parts, "y").select(F.col("y").cast("long").alias("year"), (F.abs(F.col("nbr_fraction") - F.col("f")) <= 1e-12).alias("same"))


@query("SELECT count(*) AS n, count(*) FILTER (pre <= CAST(0.3 AS FLOAT) OR pre IS NULL) AS low_baseline, count(*) FILTER (dnbr < CAST(0.3 AS FLOAT) OR dnbr IS NULL) AS low_change FROM kept")
def consistency_V8(spark, sf):
    cells, _ = objects(spark, sf)
    bad = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    return cells.agg(F.count("*").alias("n"), bad(F.col("pre") > C.f32(0.3)).alias("low_baseline"), bad(F.col("dnbr") >= C.f32(0.3)).alias("low_change"))
