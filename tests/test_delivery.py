"""Settings, catalogs, stored cells, outlines and sinks on small values, and every delivery query against its SQL."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from changelens.operators import polygons
from changelens.plans import packages
from changelens.plans.delivery import QUERIES, SQL
from changelens.sources import catalog, config, rasters, sinks

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
GOOD = """
[project]
study_area_id = "a"
[aoi]
west = 1.0
south = 2
east = 3.0
north = 4.0
[temporal]
analysis_years = [2019, 2020]
month = 8
window_start_day = 1
window_end_day = 31
benchmark_years = [2020]
[visualization]
resolution_m = 10
rgb_black_point = 0.01
rgb_white_point = 0.22
rgb_gamma = 1.0
[stac]
endpoint = "https://h"
collection = "c"
[disturbance]
baseline_nbr_min = 0.3
dnbr_min = 0.3
min_patch_ha = 5.0
connectivity = 8
"""


def test_settings():
    got = config.parse(GOOD)
    assert got.years == (2019, 2020) and got.bbox == (1, 2, 3, 4)
    assert got.windows() == [("2019-08-01T00:00:00Z", "2019-09-01T00:00:00Z"), ("2020-08-01T00:00:00Z", "2020-09-01T00:00:00Z")]


@pytest.mark.parametrize("old, new", [
    ("[2019, 2020]", "[2019, 2021]"), ("[2019, 2020]", "[]"), ("[2019, 2020]", '["2019"]'), ("benchmark_years = [2020]", "benchmark_years = [2018]"), ("month = 8", "month = 13"), ("window_end_day = 31", "window_end_day = 0"),
    ("month = 8", "month = 2"), ("west = 1.0", "west = 3.5"), ("connectivity = 8", "connectivity = 6"), ("rgb_white_point = 0.22", "rgb_white_point = 0.01"), ("rgb_gamma = 1.0", ""), ("min_patch_ha = 5.0", "min_patch_ha = 0"), ('endpoint = "https://h"', 'endpoint = ""'), ("dnbr_min = 0.3", "dnbr_min = 3"),
])
def test_settings_out_of_range(old, new):
    with pytest.raises(ValueError):
        config.parse(GOOD.replace(old, new))


def test_inventory(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"items": [{"id": "a", "collection": "c", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2018-08-02T10:00:00Z"}, "assets": {"B12": {"href": "https://h/x.tif", "type": "image/tiff"}, "odd": {"href": "u"}}}, {"id": "b", "bbox": None, "properties": None, "assets": None}]}, indent=1))
    got = catalog.inventory(spark, str(tmp_path / "good.json"))
    assert [(r.band, r.key, r.cog_likely, r.scale) for r in catalog.assets(got).collect()] == [("swir2", "B12", True, None)]
    near = lambda box, end: [r.id for r in catalog.search(got, "c", box, "2018-08-01", end).collect()]
    assert near((1, 1, 2, 2), "2018-09-01") == ["a"]
    assert near((2, 2, 3, 3), "2018-09-01") == near((1, 1, 2, 2), "2018-08-02T10:00:00Z") == []
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(Exception, match="no items"):
        catalog.inventory(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "bad.json").write_text('{"items": [')
    with pytest.raises(Exception):
        catalog.inventory(spark, str(tmp_path / "bad.json")).collect()
    assert {os.path.basename(r.path): r.bytes for r in catalog.files(spark, str(tmp_path), "*.json").collect()}["none.json"] == 2
    assert catalog.hashes(spark, str(tmp_path), "none.json").first().sha256 == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def test_stored_cells(spark, tmp_path):
    rows = [(2018, r, c, None if (r + c) % 3 == 0 else r + c / 10) for r in range(5) for c in range(7)]
    rasters.write(spark.createDataFrame(rows, "year int, r int, c int, v double"), str(tmp_path / "t"), {"v": -9999.0}, tile=4)
    read = lambda **k: sorted((x.r, x.c, x.v) for x in rasters.read(spark, str(tmp_path / "t"), {"v": -9999.0}, **k).collect())
    assert read(tile=4) == [x[1:] for x in rows]
    assert read(box=(1, 3, 3, 5), tile=4) == [x[1:] for x in rows if 1 <= x[1] < 3 and 3 <= x[2] < 5]
    with pytest.raises(ValueError):
        read(box=(3, 3, 3, 5))
    assert rasters.source_window((100, 80, 140, 120), 0, 200, 20, 10, 10) == (3, 4, 7, 8)
    with pytest.raises(ValueError):
        rasters.source_window((900, 80, 940, 120), 0, 200, 20, 10, 10)
    grid = lambda x: spark.createDataFrame([("g", x, 5)], "key string, left double, width int")
    assert [rasters.require_same_grid(grid(0.0), grid(x), {"left": 1e-6, "width": 0}).first().differs for x in (1e-7, 1.0)] == [False, True]


def area(ring):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:]))


def test_outlines(spark):
    square = [(1, r, c) for r in range(5) for c in range(5) if (r, c) not in ((1, 1), (2, 2), (3, 1))]
    diagonal = [(2, 0, 10), (2, 1, 11), (2, 1, 11), (2, None, 3), (None, 1, 1)]
    got = polygons.outlines(spark.createDataFrame(square + diagonal, "label int, r int, c int")).collect()
    sums = {k: sum(x.area for x in got if x.label == k) for k in (1, 2)}
    assert sums == {1: 22, 2: 2}
    assert all(x.points[0] == x.points[-1] and x.hole == (x.area < 0) and math.isclose(abs(area(x.points)) / 2, abs(x.area)) for x in got)
    outer = [x for x in got if x.label == 1 and not x.hole]
    assert len(outer) == 1 and {(p.x, p.y) for p in outer[0].points} == {(0, 0), (0, 5), (5, 5), (5, 0)}
    assert [x.area for x in got if x.label == 2] == [1, 1]
    assert polygons.outlines(spark.createDataFrame([], "label int, r int, c int")).count() == 0


def test_publish(tmp_path):
    a, b = str(tmp_path / "x/a.json"), str(tmp_path / "b.json")
    sinks.publish({a: sinks.compact({"k": [1, "ä"]}), b: sinks.canonical({"b": 1, "a": 2}).encode()})
    assert open(a, "rb").read() == '{"k":[1,"ä"]}'.encode() and open(b).read() == '{\n  "a": 2,\n  "b": 1\n}\n'
    with pytest.raises(TypeError):
        sinks.publish({a: b"new", b: "not bytes"})
    assert open(a, "rb").read() != b"new" and sorted(os.listdir(tmp_path)) == ["b.json", "x"] and os.listdir(tmp_path / "x") == ["a.json"]
    with pytest.raises(ValueError):
        sinks.compact({"x": float("nan")})


@pytest.mark.parametrize("scheme", ["", "file://", "viewfs://store"])
def test_publish_shared(spark, tmp_path, scheme):
    """A folder without a scheme, one with, and one that only Hadoop's file systems can open."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.store.link.{tmp_path}", f"file://{tmp_path}")
    a, b = f"{scheme}{tmp_path}/x/a.json", f"{scheme}{tmp_path}/b.json"
    sinks.publish_shared(spark, {a: b"old", b: b"{}"})
    sinks.publish_shared(spark, {a: '{"k":"ä"}'.encode()})
    with pytest.raises(TypeError):
        sinks.publish_shared(spark, {a: b"new", b: "not bytes"})
    assert spark.read.option("wholetext", True).text(a).first()[0] == '{"k":"ä"}'
    found = {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file() and f.suffix != ".crc"}
    assert found == {"x/a.json": '{"k":"ä"}'.encode(), "b.json": b"{}"}


def test_documents_in_a_folder_without_a_scheme(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packages, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    name = "documents_K8_K11_K12_S17_H12_H17"
    con = duckdb.connect()
    con.execute(f"create view nation as select * from '{SF}/nation.parquet'")
    got = packages.QUERIES[name](spark, SF)
    want = con.execute(packages.SQL[name])
    assert sorted(tuple(r) for r in got.select(*[d[0] for d in want.description]).collect()) == sorted(want.fetchall())


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr), sorted(cur.fetchall(), key=repr)
    assert len(got) == len(want) > 0
    assert all(len(g) == len(w) and all(map(same, g, w)) for g, w in zip(got, want, strict=True))
