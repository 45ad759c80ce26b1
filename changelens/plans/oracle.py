"""The same rows as plans.queries, in SQL for DuckDB."""

from __future__ import annotations

import re

VALID = "scl NOT IN (0, 1, 3, 8, 9, 10, 11)"


def _nd(a: str, b: str, mode: str = "reject") -> str:
    if mode == "clamp-zero":
        a, b = f"greatest({a}, CAST(0 AS FLOAT))", f"greatest({b}, CAST(0 AS FLOAT))"
    guard = f"{a} >= 0 AND {b} >= 0 AND " if mode == "reject" else ""
    return f"CASE WHEN {VALID} AND {guard}{a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


def _annual(name: str, mode: str = "reject") -> dict[str, str]:
    return {
        f"idx{name}": f"SELECT *, {_nd('nir', 'swir2', mode)} AS nbr, {_nd('nir', 'red', mode)} AS ndvi FROM obs",
        f"mos{name}": f"SELECT y, d, r, c, arg_min(nbr, tile * 1000000000000 + item) FILTER (nbr IS NOT NULL) AS nbr, arg_min(ndvi, tile * 1000000000000 + item) FILTER (ndvi IS NOT NULL) AS ndvi FROM idx{name} GROUP BY y, d, r, c",
        f"ann{name}": f"SELECT y, r, c, CAST(median(nbr) AS FLOAT) AS nbr, CAST(median(ndvi) AS FLOAT) AS ndvi, count(nbr) AS nbr_count, count(ndvi) AS ndvi_count FROM mos{name} GROUP BY y, r, c",
    }


def _cc(cells: str, name: str, n: int, key: str = "") -> dict[str, str]:
    k = f"a.{key} = b.{key} AND " if key else ""
    sel = f"{key}, " if key else ""
    near = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1" if n == 8 else "abs(a.r - b.r) + abs(a.c - b.c) <= 1"
    return {
        f"id{name}": f"SELECT *, r * (SELECT w FROM w) + c AS id FROM {cells}",
        f"edge{name}": f"SELECT {'a.' + key + ', ' if key else ''}a.id AS a, b.id AS b FROM id{name} a JOIN id{name} b ON {k}{near}",
        f"reach{name}": f"SELECT {sel}id AS src, id AS dst FROM id{name} UNION SELECT {'x.' + key + ', ' if key else ''}x.src, e.b FROM reach{name} x JOIN edge{name} e ON {'x.' + key + ' = e.' + key + ' AND ' if key else ''}x.dst = e.a",
        f"comp{name}": f"SELECT i.*, m.root FROM id{name} i JOIN (SELECT {sel}src, min(dst) AS root FROM reach{name} GROUP BY ALL) m ON i.id = m.src{' AND i.' + key + ' = m.' + key if key else ''}",
    }


CTE = {
    "w": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part",
    "obs": "SELECT (l_partkey - 1) // w AS r, (l_partkey - 1) % w AS c, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(l_shipdate AS DATE) AS d, l_suppkey AS tile, l_orderkey * 10 + l_linenumber AS item, (l_orderkey + l_linenumber) % 12 AS scl, CAST(l_quantity * 0.02::DOUBLE AS FLOAT) AS nir, CAST(l_discount * 5 - 0.05::DOUBLE AS FLOAT) AS swir2, CAST(l_tax * 5 - 0.05::DOUBLE AS FLOAT) AS red FROM lineitem, w",
    **_annual(""), **_annual("_p", "preserve"),
    "pairs": "SELECT *, pre - post AS dnbr FROM (SELECT r, c, max(nbr) FILTER (y = 1995) AS pre, max(nbr) FILTER (y = 1996) AS post FROM ann WHERE y IN (1995, 1996) GROUP BY r, c)",
    "cand": "SELECT * FROM pairs WHERE pre > CAST(0.3 AS FLOAT) AND dnbr >= CAST(0.3 AS FLOAT)",
    **_cc("cand", "8", 8), **_cc("cand", "4", 4),
    "kept": "SELECT * FROM comp8 WHERE root IN (SELECT root FROM comp8 GROUP BY root HAVING count(*) >= 3)",
    "stats": "SELECT root, count(*) AS pixel_count, count(*) * 0.04::DOUBLE AS area_ha, avg(c + 0.5::DOUBLE) AS centroid_x, avg(-(r + 0.5::DOUBLE)) AS centroid_y, avg(pre::DOUBLE) AS pre_mean, median(pre::DOUBLE) AS pre_median, avg(post::DOUBLE) AS post_mean, median(post::DOUBLE) AS post_median, avg(dnbr::DOUBLE) AS dnbr_mean, median(dnbr::DOUBLE) AS dnbr_median, quantile_cont(dnbr::DOUBLE, 0.9) AS dnbr_p90, max(dnbr::DOUBLE) AS dnbr_max FROM kept GROUP BY root",
    "lab": "SELECT *, row_number() OVER (ORDER BY pixel_count DESC, round(centroid_x, 9), round(centroid_y, 9), root) AS label FROM stats",
    "oc": "SELECT label, k.r, k.c, pre, post, yy.y, a.nbr, a.ndvi, CASE WHEN pre::DOUBLE - post::DOUBLE > 0 THEN CAST((a.nbr::DOUBLE - post::DOUBLE) / (pre::DOUBLE - post::DOUBLE) AS FLOAT) END AS recovery FROM kept k JOIN lab USING (root) CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) yy LEFT JOIN ann a ON a.y = yy.y AND a.r = k.r AND a.c = k.c",
}


def _oy(by: str) -> str:
    share = lambda x: f"count(*) FILTER (recovery::DOUBLE {x}) / nullif(count(recovery), 0)::DOUBLE"
    three = lambda x: ", ".join(f"quantile_cont({x}::DOUBLE, {q}) AS {x}_{k}" for k, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)))
    inner = f"""SELECT {by}, count(*) AS total, count(*) * 0.04::DOUBLE AS area_ha, count(nbr) * 0.04::DOUBLE AS nbr_valid_ha, (count(*) - count(nbr)) * 0.04::DOUBLE AS nbr_missing_ha, count(nbr) AS nbr_count, count(nbr) / count(*)::DOUBLE AS nbr_fraction, count(recovery) AS recovery_count, count(recovery) / count(*)::DOUBLE AS recovery_fraction, count(ndvi) AS ndvi_count, count(ndvi) / count(*)::DOUBLE AS ndvi_fraction, avg(nbr::DOUBLE) AS nbr_mean, avg(recovery::DOUBLE) AS recovery_mean, min(recovery::DOUBLE) AS recovery_min, max(recovery::DOUBLE) AS recovery_max, {three('nbr')}, {three('recovery')}, {three('ndvi')}, {share('< 0')} AS f_lt_0, {share('>= 0')} AS f_ge_0, {share('>= 0.5')} AS f_ge_050, {share('>= 0.8')} AS f_ge_080, {share('>= 1')} AS f_ge_100, {share('> 1')} AS f_gt_100 FROM oc GROUP BY {by}"""
    return f"SELECT *, status <> 'POOR' AS reporting_recommended FROM (SELECT *, CASE WHEN recovery_count = 0 THEN 'POOR' WHEN nbr_fraction >= 0.95 THEN 'GOOD' WHEN nbr_fraction >= 0.8 THEN 'USABLE_WITH_COVERAGE_FLAG' ELSE 'POOR' END AS status FROM ({inner}))"


CTE["oy"] = _oy("label, y")
CTE["ly"] = _oy("y")
_ok, _fin = VALID, f"{VALID} AND nir >= 0 AND swir2 >= 0 AND nir + swir2 <> 0"
_before = f"({VALID} AND nir >= 0 AND swir2 >= 0)"
_src = {k: f"{k} IS NOT NULL" for k in ("nir", "red", "swir2")}


def _stage(b: str, stage: str) -> str:
    before = f"{VALID} AND nir >= 0 AND {b} >= 0"
    return {"before": before, "failed": f"{before} AND nir + {b} = 0", "valid": f"{before} AND nir + {b} <> 0", "negative": f"{VALID} AND (nir < 0 OR {b} < 0)", "kept": f"{VALID} AND nir + {b} <> 0"}[stage]


_FLAGS = {"scl_valid": VALID} | {f"source_valid_{k}": x for k, x in _src.items()} | {f"scl_source_valid_{k}": f"{VALID} AND {x}" for k, x in _src.items()}
_FLAGS |= {"negative_nir": f"{VALID} AND (nir < 0 OR swir2 < 0 OR red < 0)", "negative_red": _stage("red", "negative"), "negative_swir2": _stage("swir2", "negative")}
for _n, _b in (("nbr", "swir2"), ("ndvi", "red")):
    _FLAGS |= {f"{_n}_before_denominator": _stage(_b, "before"), f"{_n}_denominator_failure": _stage(_b, "failed"), f"{_n}_valid": _stage(_b, "valid"), f"{_n}_valid_without_negative_rejection": _stage(_b, "kept")}
_BY_DATE = [k for k in _FLAGS if "without" not in k]
_INSIDE = "r >= 1 AND r < w - 1 AND c >= 1 AND c < w - 1"


def _united(by: str) -> str:
    return f"SELECT {by}, r, c, " + ", ".join(f"bool_or({x}) AS {k}" for k, x in _FLAGS.items()) + f" FROM obs, w WHERE {_INSIDE} GROUP BY {by}, r, c"


CTE["yflags"], CTE["dflags"] = _united("y"), _united("d")
CTE["runs"] = "SELECT * FROM (VALUES (0, 'dnbr', 0.3, 0.25, 3), (1, 'dnbr', 0.3, 0.3, 3), (2, 'dnbr', 0.3, 0.35, 3), (3, 'dnbr', 0.3, 0.4, 3), (4, 'baseline', 0.2, 0.3, 3), (5, 'baseline', 0.3, 0.3, 3), (6, 'baseline', 0.4, 0.3, 3), (7, 'patch', 0.3, 0.3, 1), (8, 'patch', 0.3, 0.3, 2), (9, 'patch', 0.3, 0.3, 3), (10, 'patch', 0.3, 0.3, 5)) t(run, what, baseline, threshold, least)"
CTE["rc"] = "SELECT run, r, c FROM pairs, runs WHERE pre > CAST(baseline AS FLOAT) AND dnbr >= CAST(threshold AS FLOAT)"
CTE |= _cc("rc", "s", 8, "run")

_R = "round({0}::DOUBLE, 6) + 0 AS {0}"


def _r(*names: str) -> str:
    return ", ".join(_R.format(n) for n in names)


_DISP = "CAST(round_even(least(greatest((greatest({0}::DOUBLE, 0) - 0.01::DOUBLE) / ({1}::DOUBLE - 0.01::DOUBLE), 0), 1) * 255, 0) AS BIGINT)"
_OY = "label, y, total, nbr_count, recovery_count, ndvi_count, status, reporting_recommended, " + _r(
    "area_ha", "nbr_valid_ha", "nbr_missing_ha", "nbr_fraction", "recovery_fraction", "ndvi_fraction", "nbr_mean", "nbr_p10", "nbr_median", "nbr_p90", "recovery_mean", "recovery_min", "recovery_max", "recovery_p10", "recovery_median", "recovery_p90",
    "ndvi_p10", "ndvi_median", "ndvi_p90", "f_lt_0", "f_ge_0", "f_ge_050", "f_ge_080", "f_ge_100", "f_gt_100",
)


def _ramp(stops, i):
    out = f"CASE WHEN v IS NULL THEN 0 WHEN v <= {stops[0][0]}::DOUBLE THEN {stops[0][1][i]} WHEN v >= {stops[-1][0]}::DOUBLE THEN {stops[-1][1][i]}"
    for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False):
        out += f" WHEN v <= {hi}::DOUBLE THEN floor({a[i]} + ({b[i] - a[i]}) * ((v - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)) + 0.5::DOUBLE)"
    return f"CAST({out} END AS BIGINT)"


def _colours(stops):
    return ", ".join(f"{_ramp(stops, i)} AS {n}" for i, n in enumerate(("red", "green", "blue")))


_CH = ((-0.4, (0x52, 0x73, 0x6E)), (0.0, (0xB6, 0xB4, 0xA9)), (0.3, (0xD3, 0x9B, 0x48)), (0.6, (0xB6, 0x5D, 0x3F)), (1.0, (0x80, 0x35, 0x2D)))
_RE = ((0.0, (0x6B, 0x4C, 0x3B)), (0.5, (0xC7, 0xA6, 0x6B)), (1.0, (0x6F, 0xAA, 0xA1)), (1.5, (0x2F, 0x6F, 0x68)))
_Q = "quantile_cont(nbr::DOUBLE, {0})"


def _dist(src: str, at: dict[str, float]) -> str:
    return f"SELECT y, count(nbr) AS n, round(min(nbr)::DOUBLE, 6) AS min, round(max(nbr)::DOUBLE, 6) AS max, round(avg(nbr::DOUBLE), 6) AS mean, round(stddev_pop(nbr::DOUBLE), 6) AS std, " + ", ".join(f"round({_Q.format(q)}, 6) AS {k}" for k, q in at.items()) + f" FROM {src} GROUP BY y"


FINAL = {
    "nbr_P3": f"SELECT item, {_r('nbr', 'ndvi')} FROM idx",
    "validity_stages_P6": f"SELECT item, {_ok} AS source_valid, {_ok} AND (nir < 0 OR swir2 < 0) AS negative_present, {_ok} AND (nir < 0 OR swir2 < 0) AS negative_rejected, {_before} AS before_denominator, {_before} AS physical_valid, {_before} AND nir + swir2 = 0 AS denominator_failure, {_fin} AS final_valid, round(nir::DOUBLE, 6) AS first_used, round(swir2::DOUBLE, 6) AS second_used, round((nir + swir2)::DOUBLE, 6) AS denominator FROM obs",
    "treatments_P5": "SELECT item, " + ", ".join(f"round(({_nd('nir', 'swir2', m)})::DOUBLE, 6) AS {m.replace('-', '_')}" for m in ("reject", "preserve", "clamp-zero")) + " FROM obs",
    "scale_offset_P1": "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity * (CASE WHEN l_linenumber % 3 <> 0 THEN 0.0001::DOUBLE ELSE 1 END) + (CASE WHEN l_linenumber % 2 = 0 THEN -0.1::DOUBLE ELSE 0 END) AS FLOAT)::DOUBLE, 6) AS value FROM lineitem",
    "scl_filter_F1": f"SELECT y, scl, count(*) AS n FROM obs WHERE {_ok} GROUP BY y, scl",
    "mosaic_first_valid_A3": "SELECT strftime(d, '%Y-%m-%d') AS d, r, c, round(nbr::DOUBLE, 6) AS nbr FROM mos",
    "annual_median_A1": f"SELECT y, r, c, {_r('nbr', 'ndvi')}, nbr_count, ndvi_count FROM ann",
    "dnbr_P7": f"SELECT r, c, {_r('pre', 'post', 'dnbr')} FROM pairs WHERE dnbr IS NOT NULL",
    "area_ge_A8": "SELECT count(*) FILTER (dnbr >= CAST(0.2 AS FLOAT)) AS pixels, round(count(*) FILTER (dnbr >= CAST(0.2 AS FLOAT)) * 0.04::DOUBLE, 6) AS hectares FROM pairs",
    "threshold_grid_J14": "SELECT b::DOUBLE AS baseline, t::DOUBLE AS threshold, count(*) FILTER (pre > CAST(b AS FLOAT) AND dnbr >= CAST(t AS FLOAT)) AS pixels FROM pairs, (VALUES (0.2), (0.3), (0.4)) x(b), (VALUES (0.1), (0.2), (0.3)) z(t) GROUP BY b, t",
    "distribution_A5": _dist("ann", {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}),
    "wide_distribution_A6": _dist("ann_p", {"p001": 0.001, "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}),
    "valid_count_dist_A7": "SELECT y, min(n) AS min, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS max, count(*) FILTER (n = 0) AS zero_count, count(*) AS cells FROM (SELECT yy.y, coalesce(nbr_count, 0) AS n FROM (SELECT i // w AS r, i % w AS c, w FROM w, unnest(range(w * w)) AS u(i)) g CROSS JOIN (SELECT DISTINCT y FROM ann) yy LEFT JOIN ann a ON a.y = yy.y AND a.r = g.r AND a.c = g.c WHERE g.r >= 1 AND g.r < w - 1 AND g.c >= 1 AND g.c < w - 1) GROUP BY y",
    "candidate_F2": f"SELECT r, c, {_r('pre', 'post', 'dnbr')} FROM cand",
    "components_8_W6": "SELECT r, c, root FROM comp8",
    "components_4_W6": "SELECT r, c, root FROM comp4",
    "component_filter_F8": "SELECT r, c, root FROM kept",
    "object_stats_A10": f"SELECT root, pixel_count, {_r('area_ha', 'centroid_x', 'centroid_y', 'pre_mean', 'pre_median', 'post_mean', 'post_median', 'dnbr_mean', 'dnbr_median', 'dnbr_p90', 'dnbr_max')}, printf('disturbance-%03d', label) AS disturbance_id FROM lab",
    "relabel_W1": "SELECT root, label FROM lab",
    "boundary_touch_F9": "SELECT root, bool_or(r < 2 OR c < 2 OR r >= w - 2 OR c >= w - 2) AS touches_boundary FROM comp8, w GROUP BY root",
    "sensitivity_A31": "SELECT run::BIGINT AS run, what, count(n) AS raw, CAST(coalesce(sum(n), 0) AS BIGINT) AS raw_pixels, count(*) FILTER (n >= least) AS retained, CAST(coalesce(sum(n) FILTER (n >= least), 0) AS BIGINT) AS pixels, coalesce(max(n) FILTER (n >= least), 0) AS largest, round(coalesce(sum(n) FILTER (n >= least), 0) * 0.04::DOUBLE, 6) AS retained_ha FROM runs LEFT JOIN (SELECT run, root, count(*) AS n FROM comps GROUP BY run, root) USING (run) GROUP BY run, what",
    "recovery_P8": "SELECT label, y, r, c, round(recovery::DOUBLE, 6) + 0 AS recovery FROM oc",
    "object_year_A11": f"SELECT {_OY} FROM oy",
    "landscape_year_A12": f"SELECT {_OY.removeprefix('label, ')} FROM ly",
    "status_by_year_A17": "SELECT y, count(*) FILTER (status = 'GOOD') AS good, count(*) FILTER (status = 'USABLE_WITH_COVERAGE_FLAG') AS usable, count(*) FILTER (status = 'POOR') AS poor, round(median(nbr_fraction), 6) AS median_fraction, round(min(nbr_fraction), 6) AS min_fraction, count(*) FILTER (nbr_count = 0) AS zero_valid FROM oy GROUP BY y",
    "status_matrix_A21": "SELECT label, " + ", ".join(f"CAST(max(CASE status WHEN 'GOOD' THEN 2 WHEN 'POOR' THEN 0 ELSE 1 END) FILTER (y = {y}) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM oy GROUP BY label",
    "completeness_C1": "SELECT printf('disturbance-%03d', label) AS disturbance_id, y AS year, CASE WHEN nbr_fraction >= 0.95 THEN 'GOOD' WHEN nbr_fraction >= 0.8 THEN 'USABLE_WITH_COVERAGE_FLAG' ELSE 'POOR' END AS category, round(nbr_fraction, 6) AS valid_fraction FROM oy",
    "denominator_diag_A15": "SELECT count(*) AS retained, count(x) AS pairs, count(*) - count(x) AS invalid_pairs, count(*) FILTER (pre::DOUBLE <= 0.3::DOUBLE) AS baseline_violations, round(min(x), 6) AS min, round(quantile_cont(x, 0.01), 6) AS p01, round(median(x), 6) AS median, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max, count(*) FILTER (x <= 0) AS non_positive, count(*) FILTER (x < 0.3::DOUBLE) AS below, count(*) FILTER (x >= 0.3::DOUBLE) AS at_least, count(*) FILTER (x = 0.3::DOUBLE) AS exactly, count(*) FILTER (x < 0.3::DOUBLE AND x >= 0.3::DOUBLE - 1e-7::DOUBLE) AS just_below, count(*) FILTER (abs(x - 0.3::DOUBLE) <= 1e-6) AS close FROM (SELECT *, pre::DOUBLE - post::DOUBLE AS x FROM kept)",
    "union_flags_A4": "SELECT y, " + ", ".join(f"count(*) FILTER ({k}) AS {k}" for k in _FLAGS) + " FROM yflags GROUP BY y",
    "missingness_A28": "SELECT y, reason, count(*) AS n, round(100 * count(*)::DOUBLE / any_value(t), 6) AS pct FROM (SELECT y, CAST(CASE WHEN nbr_valid THEN 0 WHEN NOT scl_valid THEN 1 WHEN NOT (source_valid_nir AND source_valid_swir2) THEN 2 WHEN NOT nbr_before_denominator AND NOT nbr_denominator_failure THEN 3 WHEN nbr_before_denominator THEN 4 ELSE 5 END AS BIGINT) AS reason, count(*) OVER (PARTITION BY y) AS t FROM yflags) GROUP BY y, reason",
    "date_breakdown_A29": "SELECT strftime(d, '%Y-%m-%d') AS d, any_value((w - 2) * (w - 2)) AS aoi, " + ", ".join(f"count(*) FILTER ({k}) AS {k}, round(100 * count(*) FILTER ({k}) / any_value((w - 2) * (w - 2))::DOUBLE, 6) AS {k}_pct" for k in _BY_DATE) + " FROM dflags, w GROUP BY d",
    "rescue_A30": f"SELECT y, valid, gained, round(100 * gained / total::DOUBLE, 6) AS pct_aoi, round(100 * gained / nullif(total - valid, 0)::DOUBLE, 6) AS pct_missing, total - valid - gained AS remaining FROM (SELECT y, count(*) FILTER (nbr_valid) AS valid, count(*) FILTER (nbr_valid_without_negative_rejection AND NOT nbr_valid) AS gained, any_value((w - 2) * (w - 2)) AS total FROM yflags, w GROUP BY y)",
    "variant_difference_A23": f"SELECT y, count(a) AS left_valid, count(b) AS right_valid, count(x) AS overlap, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS gained, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS lost, count(*) FILTER (x > 1e-6) AS changed, round(avg(x), 6) AS mean_abs, round(median(x), 6) AS median_abs, round(quantile_cont(x, 0.95), 6) AS p95_abs, round(max(x), 6) AS max_abs FROM (SELECT y, a, b, abs((b - a)::DOUBLE) AS x FROM (SELECT y, {_nd('nir', 'swir2', 'preserve')} AS a, {_nd('nir', 'swir2', 'clamp-zero')} AS b FROM obs)) GROUP BY y",
    "extremes_F12": "SELECT y, count(*) FILTER (nbr < -1) AS lt_m1, count(*) FILTER (nbr > 1) AS gt_1, " + ", ".join(f"count(*) FILTER (abs(nbr) > {k}) AS abs_gt_{k}" for k in (1, 2, 5, 10)) + " FROM idx_p GROUP BY y",
    "largest_five_O4": "SELECT label, pixel_count FROM lab ORDER BY label LIMIT 5",
    "common_intersect_U3": "SELECT r, c FROM ann WHERE y = 1995 AND nbr IS NOT NULL INTERSECT SELECT r, c FROM ann WHERE y = 1996 AND nbr IS NOT NULL",
    "lost_except_U2": "SELECT r, c FROM ann WHERE y = 1995 AND nbr IS NOT NULL EXCEPT SELECT r, c FROM ann WHERE y = 1996 AND nbr IS NOT NULL",
    "gained_lost_U4": "SELECT count(*) FILTER (pre IS NULL AND post IS NOT NULL) AS gained, count(*) FILTER (pre IS NOT NULL AND post IS NULL) AS lost, count(*) FILTER (pre IS NOT NULL AND post IS NOT NULL) AS kept FROM pairs",
    "segments_W3": "SELECT label, y, CAST(n AS BIGINT) AS segment FROM (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY y) AS n FROM (SELECT *, lag(ok) OVER (PARTITION BY label ORDER BY y) AS was FROM (SELECT label, y, status <> 'POOR' AND recovery_median IS NOT NULL AS ok FROM oy))) WHERE ok",
    "domain_A36": "SELECT label, round(lo - greatest(0.08::DOUBLE, (hi - lo) * 0.1::DOUBLE), 6) AS low, round(hi + greatest(0.08::DOUBLE, (hi - lo) * 0.1::DOUBLE), 6) AS high FROM (SELECT label, least(0, min(least(recovery_p10, recovery_median, recovery_p90))) AS lo, greatest(1, max(greatest(recovery_p10, recovery_median, recovery_p90))) AS hi FROM oy GROUP BY label)",
    "upsert_K13": "SELECT y, count(nbr) + CASE WHEN y >= 2000 THEN 1 ELSE 0 END AS n FROM ann GROUP BY y",
    "rgb_median_A2": f"SELECT y, r, c, " + ", ".join(f"round(CAST(median({k}) AS FLOAT)::DOUBLE, 6) AS {k}" for k in ("red", "nir", "swir2")) + f" FROM obs WHERE {_ok} GROUP BY y, r, c",
    "display_transform_P10": "SELECT item, " + ", ".join(f"{_DISP.format(k, 0.3)} AS {k}" for k in ("red", "nir", "swir2")) + " FROM obs",
    "all_white_P12": f"SELECT y, count(*) FILTER ({_ok}) AS valid, count(*) FILTER (NOT ({_ok})) AS nodata, count(*) FILTER ({_ok} AND " + " AND ".join(f"{_DISP.format(k, 0.1)} = 255" for k in ("red", "nir", "swir2")) + ") AS remapped FROM obs GROUP BY y",
    "tonal_A22": f"SELECT channel, count(*) AS n, count(*) FILTER (v <= CAST(0.01 AS FLOAT)) AS low, count(*) FILTER (v >= CAST(0.3 AS FLOAT)) AS high, round(median(v::DOUBLE), 6) AS median, round(quantile_cont(v::DOUBLE, 0.98), 6) AS p98 FROM (SELECT unnest(['red', 'nir', 'swir2']) AS channel, unnest([red, nir, swir2]) AS v FROM obs WHERE {_ok}) GROUP BY channel",
    "colour_dnbr_P36": f"SELECT r, c, {_colours(_CH)}, CAST(CASE WHEN v IS NULL THEN 0 WHEN v <= 0 THEN 34 WHEN v <= 0.3::DOUBLE THEN floor(34 + 156 * (v / 0.3::DOUBLE) + 0.5::DOUBLE) WHEN v <= 0.6::DOUBLE THEN floor(190 + 38 * ((v - 0.3::DOUBLE) / 0.3::DOUBLE) + 0.5::DOUBLE) ELSE floor(228 + 12 * least((v - 0.6::DOUBLE) / 0.4::DOUBLE, 1) + 0.5::DOUBLE) END AS BIGINT) AS alpha FROM (SELECT r, c, dnbr::DOUBLE AS v FROM pairs)",
    "colour_recovery_P36": f"SELECT y, r, c, {_colours(_RE)}, CAST(CASE WHEN v IS NULL THEN 0 ELSE 232 END AS BIGINT) AS alpha FROM (SELECT y, r, c, recovery::DOUBLE AS v FROM oc)",
    "mgrs_P24": "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN (s_suppkey % 60) || 'VWE' END) AS tile FROM supplier",
    "range_S19": "SELECT c_custkey, CASE WHEN k IN (0, 2) AND c_custkey < 500 THEN c_custkey WHEN k = 1 THEN greatest(500 - c_custkey, 0) END AS start, CASE WHEN k IN (0, 2) AND c_custkey < 500 THEN CASE WHEN k = 0 THEN 499 ELSE least(c_custkey + 50, 499) END WHEN k = 1 THEN 499 END AS \"end\" FROM (SELECT c_custkey, c_custkey % 4 AS k FROM customer)",
    "timeseries_json_K9": "SELECT label, '[' || string_agg('{\"year\":' || y || ',\"n\":' || nbr_count || ',\"status\":\"' || status || '\"}', ',' ORDER BY y) || ']' AS json FROM oy GROUP BY label",
}


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in CTE:
        if name not in seen and re.search(rf"\b{name}\b", sql) and re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
            if "reach" not in name or not sql.startswith("SELECT id AS src"):
                seen[name] = None
                _needed(CTE[name], seen)
    return seen


def compose(sql: str) -> str:
    """sql behind the common table expressions that it needs."""
    want = _needed(sql, {})
    ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in CTE if n in want)
    return (f"WITH RECURSIVE {ctes} " if ctes else "") + sql


def oracle_sql() -> dict[str, str]:
    return {key: compose(sql) for key, sql in FINAL.items()}
