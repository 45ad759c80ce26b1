"""Scene expressions on small values, and every scene query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from changelens.functions import scenes as S
from changelens.plans.scenes import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize("url, want", [(" https://h//a///b ", "https://h/a/b"), ("http://h/a", None), ("https://h/a?x", None), ("https://h/a/../b", None), ("https://h/a#b", None), ("https://h\\a", None), (None, None)])
def test_asset_url(spark, url, want):
    assert one(spark, S.asset_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("tag, want", [("a", True), ("v1.0_b-c", True), ("-a", False), ("", False), (None, False)])
def test_tag(spark, tag, want):
    assert one(spark, S.tag_ok(F.lit(tag).cast("string"))) is want


def test_utc_date(spark):
    assert str(one(spark, S.utc_date(F.lit("2018-08-02T23:59:59Z")))) == "2018-08-02"
    with pytest.raises(Exception, match="no datetime"):
        one(spark, S.utc_date(F.lit(None).cast("string")))


def test_utm(spark):
    east, north = S.to_utm(F.lit(15.0), F.lit(60.0), 33)
    assert one(spark, east) == pytest.approx(500000)
    assert one(spark, north) == pytest.approx(6651411.190, abs=0.01)


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 2), (3, 2), (3, 0), (0, 0))])
    assert one(spark, S.ring_area(ring)) == -6
    assert one(spark, S.overview_levels(F.lit(1272))) == [2, 4, 8]
    assert one(spark, S.least_pixels(F.lit(5.0))) == 125


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
