"""Record, grid, check and package operators on small values, and their queries against SQL."""

import json
import math

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from changelens.functions import cells as C
from changelens.functions import metadata as M
from changelens.functions import records as R
from changelens.functions import scenes as S
from changelens.operators import cells as O
from changelens.operators import polygons
from changelens.plans import packages, records

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
#: Queries that run the components of all candidates take seconds each whatever the data; a few of them stand for the others here.
HEAVY = {
    "labels_P38", "chart_P39", "retained_J13", "threshold_fractions_A14", "summary_payload_H2", "recovery_inputs_V3", "completeness_V4", "source_context_V5", "label_integrity_J5", "reconcile_J6", "recovery_bundle_A13", "raster_statistics_A32",
    "largest_by_mode_A26", "footprint_stats_A24", "public_record_H3", "label_store_K3_S11", "recovery_store_K4_S13", "component_summary_A38",
}
QUERIES = records.QUERIES | packages.QUERIES
SQL = records.SQL | packages.SQL


def one(spark, expr, kind, *values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_non_finite_values_are_no_values(spark):
    rows = spark.createDataFrame([(NAN, 0.5), (0.8, NAN), (INF, 0.5), (0.8, INF), (None, 0.5), (0.8, 0.5)], "p float, d float")
    assert [r[0] for r in rows.select(C.candidate(F.col("p"), F.col("d"))).collect()] == [False] * 5 + [True]
    df = spark.createDataFrame([(NAN, 0.2, 0.5), (0.8, NAN, 0.5), (0.8, 0.2, NAN), (INF, 0.2, 0.5), (0.8, 0.2, 0.5)], "a float, b float, c float")
    got = [r[0] for r in df.select(C.recovery_ratio(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[:4] == [None] * 4 and abs(got[4] - 0.5) < 1e-6
    cells = spark.createDataFrame([(1, 1.0), (1, NAN), (1, 2.0), (2, NAN), (2, None)], "k int, v float")
    assert {tuple(r) for r in O.temporal_median(cells, ["k"], ["v"]).collect()} == {(1, 1.5, 2), (2, None, 0)}


@pytest.mark.parametrize("bad", [None, NAN, INF])
def test_coverage_class_of_no_fraction_is_an_error(spark, bad):
    with pytest.raises(PySparkException):
        one(spark, C.coverage_class, "double", bad)


def test_rounded_number(spark):
    assert one(spark, lambda x: R.rounded_number(x, 2, "x"), "double", None, 1.234, -0.001) == [None, 1.23, 0.0]
    for bad in (NAN, INF):
        with pytest.raises(PySparkException):
            one(spark, lambda x: R.rounded_number(x, 2, "x"), "double", bad)


def test_fixed_decimals_as_printf(spark):
    """Ties and their neighbours, carries, signs and sizes, against Python's own."""
    ties = [k / 16 for k in range(-200, 200)] + [k + 0.125 for k in (0, 1, 2**20, 2**40, 2**49)] + [0.625, 166.25, 2.0**53, 1e18]
    values = ties + [math.nextafter(x, to) for x in ties for to in (-INF, INF)] + [k / 1000 for k in range(-1100, 1100)] + [0.995, 9.995, 99.95, 0.9999999, 1.005, -0.0, -0.001, 5e-324, 1e-9]
    for digits in (1, 2, 4):
        assert one(spark, lambda x: R.fixed(x, digits), "double", *values) == [f"{x:.{digits}f}" for x in values]  # noqa: B023
    assert one(spark, lambda x: R.fixed(x, 2), "double", None, 1e19) == [None, "10000000000000000000.00"]


def test_recovery_texts_at_ties(spark):
    assert one(spark, R.recovery_text, "double", 0.625, 0.375, 1.125, -0.125) == ["0.62×", "0.38×", "1.12×", "-0.12×"]


def test_chart_points_at_ties(spark, monkeypatch):
    rows = [(1, 1995, 0.1875), (1, 1996, 0.5), (1, 1997, None), (2, 1998, None)]
    monkeypatch.setattr(records, "object_years", lambda spark, sf: spark.createDataFrame(rows, "label int, y int, recovery_median double"))
    assert [tuple(x) for x in records.QUERIES["chart_P39"](spark, SF).collect()] == [(1, "40.0,166.2 140.0,110.0")]


def test_paths_and_addresses(spark):
    good, bad = ["https://h/a//b", " https://h/a%20b "], ["https://h/%2e%2e/x", "https://h/./x", "https://u:p@h/x", "https://h/%2E/x", "https://h/%zz", "https://h/a%3Fx", "http://h"]
    assert one(spark, S.asset_url, "string", *good, *bad, None) == ["https://h/a/b", "https://h/a%20b", *[None] * (len(bad) + 1)]
    assert one(spark, lambda x: M.byte_range(x, F.lit(10).cast("long"))["end"], "string", " bytes=0-1 ", "bytes=-3", "bytes=20-") == [1, 9, None]
    docs = ['{"a":{"b":null}}', '{"a":{}}', '{"a":1}', "{", None]
    assert one(spark, lambda x: R.missing_path(x, "a.b"), "string", *docs) == [False, True, True, True, True]
    assert one(spark, R.variant_tag, "string", "candidate-030", "v1", "canonical", "../x", None) == ["w030", "v1", None, None, None]
    with pytest.raises(PySparkException):
        one(spark, lambda x: R.year_path("imagery", x, "/rgb.tif", x.isin(2017, 2018)), "int", 2019)


def test_annual_states(spark):
    rows = [(2017, [], "", 20.0), (2017, ["nbr"], "{", 20.0), (2018, list(R.ANNUAL_FILES), '{"year":2018,"outputs":{"sizes":{}},"processing":{"treatment":"reject"}}', 20.0), (2018, list(R.ANNUAL_FILES), '{"year":2017}', 10.0)]
    got = records.classified(spark.createDataFrame(rows, "year int, files array<string>, summary string, resolution double")).collect()
    assert [r["state"] for r in got] == ["MISSING", "INVALID", "COMPLETE", "INVALID"] and got[1]["missing"] == ["ndvi", "valid_count", "summary"]
    assert got[3]["problems"] == ["summary has no sizes", "wrong year", "wrong treatment", "wrong resolution"]


@pytest.mark.parametrize("cells, wrong", [([(0.8, None)], "invalid pairs"), ([(0.3, -0.5)], "baseline"), ([(0.8, 0.6)], "lose less"), ([(0.8, 0.2), (0.7, 0.3)], None)])
def test_denominators_in_order(spark, cells, wrong):
    df = O.checked_denominators(spark.createDataFrame(cells, "pre double, post double"))
    if wrong is None:
        assert df.first()["retained"] == len(cells)
    else:
        with pytest.raises(PySparkException, match=wrong):
            df.collect()


def test_relabel_by_ranges(spark):
    rows = [(i, 1 + i * 7 % 5, float(i % 3), float(i % 2)) for i in range(60)]
    got = O.relabel(spark.createDataFrame(rows, "root long, pixel_count long, centroid_x double, centroid_y double")).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2], r[3], r[0]))
    assert [r["root"] for r in sorted(got, key=lambda r: r["label"])] == [r[0] for r in want] and sorted(r["label"] for r in got) == list(range(1, 61))


def test_multipolygons_hold_their_cells(spark):
    ring = [(r, c) for r in range(5) for c in range(5) if (r, c) not in ((1, 1), (3, 3), (2, 2), (1, 3))]
    shapes = {1: ring, 2: [(0, 10), (1, 11), (2, 10)], 3: [(r, c + 20) for r in range(7) for c in range(7) if not (1 <= r <= 5 and 1 <= c <= 5) or (r, c) == (3, 3)]}
    df = spark.createDataFrame([(k, r, c) for k, cs in shapes.items() for r, c in cs], "label int, r long, c long")
    got = {r["label"]: json.loads(json.dumps(r["coordinates"])) for r in polygons.multipolygons(df).collect()}

    def inside(rings, x, y):
        crossed = 0
        for ps in rings:
            crossed += sum(a[0] == b[0] and a[0] > x and min(a[1], b[1]) < y < max(a[1], b[1]) for a, b in zip(ps, ps[1:], strict=False))
        return crossed % 2 == 1

    for k, cs in shapes.items():
        held = [[(r, c) for r in range(-1, 9) for c in range(-1, 29) if inside(polygon, c + 0.5, r + 0.5)] for polygon in got[k]]
        assert sorted(x for h in held for x in h) == sorted(cs)
    assert len(got[3]) == 2 and sorted(len(p) for p in got[3]) == [1, 2]


def test_analysis_grid_of_known_bounds(spark):
    """The study area of the settings at 20 m of zone 33 has 1266 by 1233 cells."""
    steps = [(15.12 + 0.48 * i / 22, 61.86 + 0.22 * j / 22) for i in range(23) for j in range(23) if i in (0, 22) or j in (0, 22)]
    e, n = S.to_utm(F.col("lon"), F.col("lat"), 33)
    b = spark.createDataFrame(steps, "lon double, lat double").select(e.alias("e"), n.alias("n")).agg(F.min("e").alias("w"), F.max("e").alias("e"), F.min("n").alias("s"), F.max("n").alias("n"))
    got = b.select(R.snapped(F.col("w"), F.col("e"), 20.0)[2], R.snapped(F.col("s"), F.col("n"), 20.0)[2]).first()
    assert tuple(got) == (1266, 1233)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in HEAVY])
def test_query_equals_sql(spark, db, name):
    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = db.execute(SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_tiff_round_trip(spark, tmp_path):
    import io
    import math

    import numpy as np

    from changelens.sources import tiff

    rng = np.random.default_rng(1)
    for kind in ("f4", "i4", "u2", "u1"):
        values = (rng.random((37, 50)) * 200).astype(kind)
        data = tiff.encode(values, 1000.0, 2000.0, 20.0, 32633, 255, 16)
        f = tiff.fields(io.BytesIO(data))
        assert f[tiff.WIDTH] == [50] and f[tiff.TIE_POINT][3:5] == [1000.0, 2000.0] and f[tiff.NODATA] == ["255"] and tiff.problems(f, 16, 32633, 20.0) == []
        for box in ((0, 0, 37, 50), (5, 7, 20, 33), (30, 40, 99, 99), (16, 16, 17, 17), (36, 0, 36, 9)):
            assert np.array_equal(tiff.window(io.BytesIO(data), box), values[box[0] : box[2], box[1] : box[3]])
        assert tiff.problems(f, 32, 4326, 10.0) == ["not tiled", "wrong projection", "wrong cell size", "tiles missing"]
    with pytest.raises(ValueError):
        tiff.fields(io.BytesIO(b"MM\0*" + bytes(20)))
    rows = [(1, 0, 0, 1.5), (1, 9, 12, NAN), (1, 9, 13, 2.5), (2, 3, 3, None), (2, 3, 3, 4.0), (2, 8, 8, INF)]
    path = f"file://{tmp_path}/t"
    listing = tiff.write(spark.createDataFrame(rows, "y int, r int, c int, v double"), path, "v", "y", (0.0, 0.0), 20.0, 32633, piece=8, tile=4)
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    got = {(r["by"], r["r"], r["c"]): r["value"] for r in tiff.read(spark, path, listing).filter("value is not null").collect()}
    assert got == {(1, 0, 0): 1.5, (1, 9, 13): 2.5, (2, 3, 3): 4.0} and all(map(math.isfinite, got.values()))
    assert tiff.read(spark, path, listing, (9, 13, 10, 14)).filter("by = 1").collect()[0]["value"] == 2.5
