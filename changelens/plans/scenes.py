"""Queries on scene metadata, geometries, packages and checks, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metadata as M
from ..functions import scenes as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c.cast("double"), 6) + F.lit(0.0)


@query("SELECT event_id, CASE WHEN k % 3 <> 0 THEN round(k * 0.5::DOUBLE, 6) END AS scale, CASE WHEN k % 3 <> 0 THEN -0.1::DOUBLE END AS \"offset\" FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def scale_meta_P2(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    band = F.struct((F.col("k") * 0.5).alias("scale"), F.lit(-0.1).alias("offset"))
    scale, offset = S.scale_offset(F.filter(F.array(band), lambda _: F.col("k") % 3 != 0))
    return e.select("event_id", r6(scale).alias("scale"), offset.alias("offset"))


@query("SELECT c_nationkey::BIGINT AS nation, f AS fraction, CASE WHEN f >= 0.95 THEN 'GOOD' WHEN f >= 0.8 THEN 'USABLE_WITH_COVERAGE_FLAG' ELSE 'POOR' END AS status FROM (SELECT c_nationkey, round(count(*) FILTER (c_acctbal > 0) / count(*), 6) AS f FROM customer GROUP BY 1)")
def coverage_class_P9(spark, sf):
    f = F.count_if(F.col("c_acctbal") > 0) / F.count("*")
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(r6(f).alias("fraction"))
    return g.withColumn("status", C.coverage_class(F.col("fraction")))


@query("SELECT p_partkey, 499980 + (p_partkey % 64 + 0.5::DOUBLE) * 20 AS x, 6500000 - (p_partkey // 64 + 0.5::DOUBLE) * 20 AS y FROM part")
def pixel_centre_P15(spark, sf):
    x, y = S.pixel_centre(499980.0, 6500000.0, 20.0, F.expr("p_partkey div 64"), F.col("p_partkey") % 64)
    return table(spark, sf, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey, CAST(ceil(p_size / 0.04::DOUBLE - 1e-12::DOUBLE) AS BIGINT) AS pixels FROM part")
def least_pixels_P14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.least_pixels(F.col("p_size").cast("double")).alias("pixels"))


@query("SELECT o_orderpriority, n, round(100.0::DOUBLE * n / t, 6) AS pct, 100.0::DOUBLE * n / t >= 90 AS ge_90, 100.0::DOUBLE * n / t >= 95 AS ge_95 FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS n, count(*) AS t FROM orders GROUP BY 1)")
def coverage_entry_A27(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "P").alias("n"), F.count("*").alias("t"))
    p = C.percentage(F.col("n"), F.col("t"))
    return g.select("o_orderpriority", "n", r6(p).alias("pct"), (p >= 90).alias("ge_90"), (p >= 95).alias("ge_95"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS name FROM customer")
def normalise_P21(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", M.normalised(F.col("c_name")).alias("name"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def utc_date_P27(spark, sf):
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", S.utc_date(iso).alias("day"))


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS y, make_date(year(o_orderdate), 8, 1) AS first, make_date(year(o_orderdate), 9, 1) AS stop FROM orders")
def interval_P28(spark, sf):
    first, stop = S.half_open(F.make_date("y", F.lit(8), F.lit(1)), F.make_date("y", F.lit(8), F.lit(31)))
    return table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct().select("y", first.alias("first"), stop.alias("stop"))


@query("SELECT s_suppkey, printf('disturbance-%03d', s_suppkey) AS id FROM supplier")
def object_id_P29(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", M.object_id(F.col("s_suppkey")).alias("id"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS v FROM lineitem")
def json_safe_P30(spark, sf):
    v = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_discount", "l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l"), r6(S.json_safe(v)).alias("v"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', n / 1073741824.0::DOUBLE) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 2 + 1 AS n FROM orders)")
def human_bytes_P32(spark, sf):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 2 + 1
    return table(spark, sf, "orders").select("o_orderkey", M.human_bytes(n).alias("size"))


@query("SELECT p_partkey, 5::BIGINT AS points, CAST(p_size * (p_size + 2) AS DOUBLE) AS area FROM part")
def ring_area_R8(spark, sf):
    """Vertices and area of a ring of each part: a rectangle of p_size by p_size + 2."""
    x0, w, h = F.col("p_partkey").cast("double"), F.col("p_size").cast("double"), F.col("p_size") + 2.0
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = F.lit(0.0)
    ring = F.array(at(x0, o), at(x0 + w, o), at(x0 + w, h), at(x0, h), at(x0, o))
    return table(spark, sf, "part").select("p_partkey", F.size(ring).cast("long").alias("points"), S.ring_area(ring).alias("area"))


@query("SELECT page_id, url AS a, page_id || '.json' AS b, 2::BIGINT AS n FROM pages")
def referenced_paths_P35(spark, sf):
    inner = F.struct(F.concat("page_id", F.lit(".json")).alias("path"), F.lit(1).alias("size"))
    paths = S.referenced_paths(F.regexp_replace(F.to_json(F.struct(F.col("url").alias("path"), F.array(inner).alias("files"))), r"\\/", "/"))
    return table(spark, sf, "pages").select("page_id", paths[0].alias("a"), paths[1].alias("b"), F.size(paths).cast("long").alias("n"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS sha256 FROM pages")
def sha256_P40(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) = 2 AS ok FROM orders GROUP BY 1")
def processable_F4(spark, sf):
    asset = F.struct(F.col("o_orderpriority").alias("band"), (F.col("o_orderstatus") == "F").alias("ok"))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(asset).alias("assets"))
    return g.select("o_custkey", S.processable(F.col("assets"), ["1-URGENT", "2-HIGH"]).alias("ok"))


@query("SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders WHERE month(o_orderdate) = 8 GROUP BY 1 HAVING count(*) > 0")
def date_range_F5(spark, sf):
    first, stop = S.half_open(F.make_date("y", F.lit(8), F.lit(1)), F.make_date("y", F.lit(8), F.lit(31)))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    return o.filter((F.col("d") >= first) & (F.col("d") < stop)).groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n")).filter("n > 0")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) <> 1996, o_orderstatus <> 'F', o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def preferred_item_F10(spark, sf):
    """A complete item of the preferred year if there is one, else the best of any: one aggregate, without a sort of the group."""
    rank = F.struct(F.year("o_orderdate") != 1996, F.col("o_orderstatus") != "F", F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))


@query("SELECT o_custkey, y, n, coalesce(q, 0) AS items, n = coalesce(u, 0) AS agrees FROM (SELECT o_custkey, year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1, 2) LEFT JOIN (SELECT o_custkey, year(o_orderdate)::BIGINT AS y, count(*) AS q, count(DISTINCT o_orderkey) AS u FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) USING (o_custkey, y)")
def object_year_join_J7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("y"))
    n = o.groupBy("o_custkey", "y").agg(F.count("*").alias("n"))
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("q"))
    q = o.join(per_order, "o_orderkey").groupBy("o_custkey", "y").agg(F.sum("q").alias("q"), F.count("*").alias("u"))
    return n.join(q, ["o_custkey", "y"], "left").select("o_custkey", "y", "n", F.coalesce("q", F.lit(0)).alias("items"), (F.col("n") == F.coalesce("u", F.lit(0))).alias("agrees"))


@query("SELECT c_custkey, n AS n_1996 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) ON c_custkey = o_custkey")
def enrich_latest_J9(spark, sf):
    n = table(spark, sf, "orders").filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).groupBy("o_custkey").agg(F.count("*").alias("n_1996"))
    return table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_1996")


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, CAST((3 - abs(a.s_suppkey - b.s_suppkey)) * (3 - abs(a.s_suppkey % 50 - b.s_suppkey % 50)) AS BIGINT) AS area FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey - a.s_suppkey < 3 AND abs(a.s_suppkey % 50 - b.s_suppkey % 50) < 3")
def overlaps_J10(spark, sf):
    """Pairs of overlapping boxes by an equi-join on the tiles that they touch; the tile of the overlap's corner reports a pair."""
    size, tile = 3, 4
    box = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("x"), (F.col("s_suppkey") % 50).alias("y"))
    span = lambda c: F.explode(F.sequence(F.expr(f"{c} div {tile}"), F.expr(f"({c} + {size - 1}) div {tile}")))
    box = box.withColumn("tx", span("x")).withColumn("ty", span("y"))
    a, b = (box.select(*[F.col(c).alias(c + k) for c in ("id", "x", "y")], "tx", "ty") for k in "ab")
    x, y = F.greatest("xa", "xb"), F.greatest("ya", "yb")
    w, h = F.least("xa", "xb") + size - x, F.least("ya", "yb") + size - y
    out = a.join(b, ["tx", "ty"]).filter((F.col("ida") < F.col("idb")) & (w > 0) & (h > 0) & (F.floor(x / tile) == F.col("tx")) & (F.floor(y / tile) == F.col("ty")))
    return out.select(F.col("ida").alias("i"), F.col("idb").alias("j"), (w * h).alias("area"))


@query("SELECT o_custkey, count(*) = 1 + max(y) - min(y) AS contiguous FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders) GROUP BY 1")
def contiguous_years_W4(spark, sf):
    y = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("o_custkey").orderBy("y"))
    return y.withColumn("gap", gap).groupBy("o_custkey").agg(F.coalesce(F.bool_and(F.col("gap") == 1), F.lit(True)).alias("contiguous"))


@query("SELECT o_orderkey, CASE WHEN coalesce(bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'not_attempted' WHEN o_orderstatus = 'F' THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS state FROM orders")
def batch_states_W8(spark, sf):
    """Each year of a batch: complete ones are skipped, the first failure stops, later ones aren't attempted."""
    s = F.col("o_orderstatus")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(s == "P").over(before), F.lit(False))
    return table(spark, sf, "orders").select("o_orderkey", F.when(stopped, "not_attempted").when(s == "F", "skipped").when(s == "P", "failed").otherwise("completed").alias("state"))


@query("SELECT suffix, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT 's' || page_id % 3 AS suffix, octet_length(encode(coalesce(html, ''))) AS size FROM pages) GROUP BY 1")
def inventory_A37(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("s"), F.col("page_id") % 3).alias("suffix"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    return p.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages ORDER BY 2 DESC, 1 LIMIT 10")
def largest_files_O5(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")).orderBy(F.desc("size"), "page_id").limit(10)


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years FROM orders GROUP BY 1")
def normalised_years_O7(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate"))), ",").alias("years"))


@query("SELECT p_partkey, array_to_string([f FOR f IN [2, 4, 8, 16, 32, 64, 128] IF p_size * 100 / f >= 128], ',') AS levels FROM part")
def overview_levels_R9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.overview_levels(F.col("p_size") * 100), ",").alias("levels"))


@query("SELECT c_custkey, round(12 + c_custkey % 600 / 100.0::DOUBLE, 7) AS lon, round(58 + c_custkey % 700 / 100.0::DOUBLE, 7) AS lat FROM customer")
def crs_round_trip_R7(spark, sf):
    """Degrees to metres of zone 33 and back, seven decimals."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", (12 + k % 600 / 100.0).alias("lon"), (58 + k % 700 / 100.0).alias("lat"))
    east, north = S.to_utm(F.col("lon"), F.col("lat"), 33)
    lon, lat = S.from_utm(F.col("e"), F.col("n"), 33)
    return c.select("c_custkey", east.alias("e"), north.alias("n")).select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("SELECT event_type, count(value) AS n, min(value) AS low, median(value) AS median, max(value) AS high FROM events GROUP BY 1")
def band_stats_H9(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.median("value").alias("median"), F.max("value").alias("high"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS before FROM documents WHERE doc_id % 10 = 0 AND coalesce(text, '') <> ''")
def changed_hashes_J16(spark, sf):
    """Files whose hash differs after a step: every tenth document is emptied; a document that was empty hasn't changed."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("before"))
    e = table(spark, sf, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 != 0, text).otherwise(""), 256).alias("after"))
    return d.join(e, "doc_id").filter("before <> after").select("doc_id", "before")
