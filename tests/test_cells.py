"""Cell operators on small hand-made tables, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelens.functions import cells as C
from changelens.functions import metadata as M
from changelens.operators import cells as O
from changelens.operators.graph import connected_components, join_spread
from changelens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_scl(spark):
    got = spark.range(12).filter(C.scl_valid(F.col("id"))).collect()
    assert [r[0] for r in got] == [2, 4, 5, 6, 7]


@pytest.mark.parametrize("a, b, mode, want", [(3.0, 1.0, "reject", 0.5), (0.0, 0.0, "reject", None), (-0.1, 0.2, "reject", None), (-0.01, 0.2, "clamp-zero", -1.0), (None, 1.0, "preserve", None), (float("nan"), 1.0, "preserve", None)])
def test_index(spark, a, b, mode, want):
    df = spark.createDataFrame([(a, b)], "a float, b float")
    assert df.select(C.normalised_difference(F.col("a"), F.col("b"), F.lit(True), mode)).first()[0] == want


def test_candidate_is_strict_then_inclusive(spark):
    df = spark.createDataFrame([(0.29, 0.31), (0.30, 0.30), (0.31, 0.299), (None, 0.30), (0.31, 0.30)], "p float, d float")
    assert [r[0] for r in df.select(C.candidate(F.col("p"), F.col("d"))).collect()] == [False, False, False, False, True]


def test_recovery(spark):
    df = spark.createDataFrame([(0.8, 0.2, 0.8), (0.8, 0.2, 0.2), (0.8, 0.2, 0.95), (0.2, 0.2, 0.5), (0.8, 0.2, None)], "a float, b float, c float")
    got = [r[0] for r in df.select(F.round(C.recovery_ratio(F.col("a"), F.col("b"), F.col("c")), 5)).collect()]
    assert got == [1.0, 0.0, 1.25, None, None]


def test_coverage(spark):
    df = spark.createDataFrame([(0.95,), (0.9499999,), (0.8,), (0.7999999,)], "f double")
    assert [r[0] for r in df.select(C.coverage_class(F.col("f"))).collect()] == ["GOOD", "USABLE_WITH_COVERAGE_FLAG", "USABLE_WITH_COVERAGE_FLAG", "POOR"]


def test_display(spark):
    df = spark.createDataFrame([(-1.0,), (0.01,), (0.155,), (0.30,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(C.display(F.col("v"), 0.01, 0.22)).collect()] == [0, 0, 176, 255, 255, 0]


@pytest.mark.parametrize("n, want", [(8, 1), (4, 2)])
def test_diagonal(spark, n, want):
    df = spark.createDataFrame([(0, 0), (1, 1)], "r long, c long")
    assert O.components(df, 2, n).select("root").distinct().count() == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert connected_components(edges.filter("false")).count() == 0


def test_mosaic_and_median(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 8.0), (2, 1, 3.0), (2, 2, 7.0), (3, 1, None)], "cell int, seq int, v double")
    got = {r["cell"]: r["v"] for r in O.first_valid(rows, ["cell"], ["v"], ["seq"]).collect()}
    assert got == {1: 8.0, 2: 3.0, 3: None}
    med = {r["cell"]: (r["v"], r["v_count"]) for r in O.temporal_median(rows, ["cell"], ["v"]).collect()}
    assert med == {1: (8.0, 1), 2: (5.0, 2), 3: (None, 0)}


def test_segments(spark):
    rows = spark.createDataFrame([("a", y, y not in (2019, 2021)) for y in range(2017, 2023)], "id string, y int, ok boolean")
    got = sorted((r["y"], r["segment"]) for r in O.trusted_segments(rows, "id", "y", F.col("ok")).collect())
    assert got == [(2017, 1), (2018, 1), (2020, 2), (2022, 3)]


def test_metadata(spark):
    assert one(spark, M.object_id(F.lit(7)), x=1) == "disturbance-007"
    assert one(spark, M.cog_likely(F.lit("image/tiff; profile=cloud-optimized"), F.lit("x")), x=1)
    assert one(spark, M.byte_range(F.lit("bytes=-5"), F.lit(10)), x=1) == (5, 9)
    assert one(spark, M.byte_range(F.lit("bytes=10-"), F.lit(10)), x=1) is None


@pytest.mark.parametrize("name", ["candidate_F2", "components_8_W6", "object_year_A11", "missingness_A28", "segments_W3", "gained_lost_U4", "dnbr_P7", "recovery_P8"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns


def test_components_round_limit_and_hub(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, most_rounds=1)
    hub = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(1000, 1001), (1001, 1002)], "a long, b long").repartition(3)
    got = {r["node"]: r["component"] for r in connected_components(hub).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1003)}
    assert connected_components(chain.filter("false")).count() == 0


def test_join_spread(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (3, 1), (None, 2)], "k long, x long")
    right = spark.createDataFrame([(1, 300, "hot"), (2, 1, "cold"), (9, 1, "none")], "k long, n long, v string")
    got = sorted((r["k"] or 0, r["x"], r["v"] or "") for r in join_spread(left, right, "k", "n", 303, [F.col("x")]).collect())
    assert got == sorted([(1, i, "hot") for i in range(300)] + [(2, 0, "cold"), (3, 1, ""), (0, 2, "")])


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 5, 256])
def test_components_over_tiles(spark, connectivity, tile):
    """Against a flood fill, on a grid of many tiles and in two runs with repeated cells."""
    import random

    w, pick = 23, random.Random(31)
    runs = {k: {(r, c) for r in range(w) for c in range(w) if pick.random() < share} for k, share in ((1, 0.45), (2, 0.6))}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) == 1 or connectivity == 8 and (a or b)]
    want = set()
    for k, cells in runs.items():
        left = set(cells)
        while left:
            part = [left.pop()]
            for r, c in part:
                for x in [(r + a, c + b) for a, b in steps if (r + a, c + b) in left]:
                    left.remove(x)
                    part.append(x)
            want |= {(k, r, c, min(a * w + b for a, b in part)) for r, c in part}
    rows = [(k, r, c) for k, cells in runs.items() for r, c in cells]
    df = spark.createDataFrame(rows + rows[:5], "k int, r long, c long").repartition(3)
    got = [tuple(r) for r in O.components(df, w, connectivity, ["k"], tile).select("k", "r", "c", "root").collect()]
    assert set(got) == want and len(got) == len(want) + 5
    single = {tuple(r) for r in O.components(df.filter("k = 2").drop("k"), w, connectivity, None, tile).select("r", "c", "root").collect()}
    assert single == {x[1:] for x in want if x[0] == 2}
    assert O.components(df.filter("false"), w, connectivity, ["k"], tile).count() == 0


@pytest.mark.parametrize("tile", [4, 256])
def test_components_of_runs_before_the_grid(spark, tile):
    """A part of key 0 is the cell before the grid's first one; its place is negative."""
    cells = spark.createDataFrame([(1, 0, -1), (1, 0, 0), (1, 5, 5), (2, 0, -1), (2, 1, 1), (3, -3, -3), (3, -2, -4), (3, 0, 0)], "run int, r long, c long")
    got = {(x["run"], x["r"], x["c"]): x["root"] for x in O.components(cells, 10, 8, ["run"], tile).collect()}
    assert got == {(1, 0, -1): -1, (1, 0, 0): -1, (1, 5, 5): 55, (2, 0, -1): -1, (2, 1, 1): 11, (3, -3, -3): -33, (3, -2, -4): -33, (3, 0, 0): 0}
