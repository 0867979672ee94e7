"""The entities of ``bindings`` and the shared intermediate tables as SQL, written
independently of the DataFrame operators (windows instead of joins back)."""

from __future__ import annotations

import re

ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
UNITS = "CAST(FLOOR({0} * 1e4 + 0.5) AS BIGINT)"


def units(x: str) -> str:
    return UNITS.format(x)


def msum(x: str) -> str:
    return f"SUM({units(x)}) / 1e4"


def msum0(x: str) -> str:
    return f"COALESCE(SUM({units(x)}) / 1e4, 0)"


def mavg(x: str) -> str:
    return f"SUM({units(x)}) / COUNT({x}) / 1e4"


def q(x: str, p: float) -> str:
    return f"QUANTILE_CONT({x}, {p})"


CTES: dict[str, str] = {}

CTES["ln"] = """
SELECT l.*, s.s_nationkey AS nation, 'R' || CAST(s.s_nationkey AS VARCHAR) AS route_id,
  CAST(n.n_regionkey AS VARCHAR) AS fill_dc,
  'XD_' || CAST(n.n_regionkey AS VARCHAR) || '_' || n.n_name AS place, n.n_name,
  'C' || CAST(s.s_nationkey % 6 AS VARCHAR) AS dock_carrier,
  'XD_' || CAST(n.n_regionkey AS VARCHAR) || '_' || n.n_name || '.C' || CAST(s.s_nationkey % 6 AS VARCHAR) AS dc
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey"""

CTES["ev"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'RC' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'TS'
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'OV' ELSE 'FM' END AS charge_type,
  CASE WHEN l_tax < CAST(0.07 AS DOUBLE) THEN 'REG' ELSE 'STAT' END AS delivery_type,
  route_id, dc, dc AS xdock, fill_dc, l_shipdate AS delivered_at,
  CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS service_date,
  CAST(EXTRACT(YEAR FROM l_shipdate) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM l_shipdate) AS INTEGER) AS month,
  l_linenumber - 1 AS delivery_seq, l_partkey AS stop_id,
  'C' || CAST(l_suppkey % 6 AS VARCHAR) AS carrier_cd, 'Carrier ' || CAST(l_suppkey % 6 AS VARCHAR) AS carrier_name,
  l_extendedprice / 1e3 AS total_rate, l_quantity AS topside_cost, l_extendedprice / 2e3 AS base_cost,
  l_extendedprice * (1 - l_discount) / 1e3 AS leg_total_cost,
  l_extendedprice * (1 - l_discount) / 1e3 * 8e-1 AS leg_base_cost,
  l_extendedprice * (1 - l_discount) / 1e3 * 15e-2 AS leg_fuel_cost,
  l_extendedprice * (1 - l_discount) / 1e3 * 5e-2 AS leg_misc_cost,
  l_quantity AS tote_count, CAST(l_linenumber AS DOUBLE) AS route_count,
  CAST(l_partkey % 40 AS DOUBLE) AS stop_count, CAST(l_orderkey % 90 AS DOUBLE) AS route_tote_count
FROM ln"""

CTES["evd"] = """
SELECT ev.*, tote_count * (1 + p_size) AS distance FROM ev LEFT JOIN part ON stop_id = p_partkey"""

CTES["jobs"] = """
SELECT ev.*, CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 97 = 0 THEN fill_dc || '-' || route_id
  ELSE fill_dc || '-' || LOWER(route_id) || ' -' || CAST(delivery_seq AS VARCHAR) || '-' || CAST(o_custkey AS VARCHAR)
    || '-' || STRFTIME(delivered_at, '%Y-%m-%d') END AS job_id
FROM ev JOIN orders ON l_orderkey = o_orderkey"""

CTES["job_parts"] = """
SELECT *, UPPER(TRIM(SPLIT_PART(job_id, '-', 1))) AS job_dc,
  CASE WHEN LEN(STRING_SPLIT(job_id, '-')) >= 2 THEN UPPER(TRIM(SPLIT_PART(job_id, '-', 2))) END AS job_route,
  CASE WHEN LEN(STRING_SPLIT(job_id, '-')) >= 3 THEN UPPER(TRIM(SPLIT_PART(job_id, '-', 3))) END AS job_stop,
  CASE WHEN LEN(STRING_SPLIT(job_id, '-')) >= 4 THEN UPPER(TRIM(SPLIT_PART(job_id, '-', 4))) END AS job_customer,
  CASE WHEN LEN(STRING_SPLIT(job_id, '-')) >= 5 THEN ARRAY_TO_STRING(STRING_SPLIT(job_id, '-')[5:], '-') END AS job_date
FROM jobs"""

CTES["cust_found"] = """
SELECT DISTINCT fill_dc AS fill_dc_id, ' ' || CAST(c_custkey AS VARCHAR) AS account_id, route_id AS route_no,
  CAST(l_linenumber - 1 AS VARCHAR) AS stop_no, c_mktsegment AS customer_type, c_name AS customer_name
FROM ln JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 3"""

CTES["cust"] = """
SELECT * FROM cust_found UNION ALL
SELECT fill_dc_id, account_id, route_no, stop_no, customer_type, customer_name || ' ALT' FROM cust_found
WHERE CAST(TRIM(account_id) AS BIGINT) % 17 = 0"""

CTES["job_cust"] = """
SELECT j.*, c.customer_type, c.customer_name FROM job_parts j LEFT JOIN cust c ON job_dc = UPPER(TRIM(fill_dc_id))
  AND job_customer = UPPER(TRIM(account_id)) AND job_route = UPPER(TRIM(route_no)) AND job_stop = UPPER(TRIM(stop_no))"""

CTES["geo"] = """
SELECT route_id,
  CASE WHEN c_custkey % 211 = 0 THEN NULL WHEN c_custkey % 50 = 0 THEN 'S' || CAST(c_custkey AS VARCHAR)
       ELSE CAST(c_custkey AS VARCHAR) END AS stop_id,
  CASE WHEN nation % 5 = 0 THEN 'PLANT_' || n_name ELSE place END AS origin, dock_carrier AS carrier_cd, fill_dc,
  DATE_TRUNC('month', l_shipdate) AS contract_time,
  25 + (c_custkey % 2400) / 1e2 AS dest_lat, -120 + (c_custkey * 7 % 5000) / 1e2 AS dest_lon,
  CASE WHEN nation <> 3 THEN 3e1 + nation END AS origin_lat, -1e2 + nation / 2e0 AS origin_lon
FROM ln JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

CTES["rstops"] = """
SELECT DISTINCT route_id, stop_id, origin || '.' || carrier_cd AS origin, fill_dc, CAST(contract_time AS DATE) AS route_date,
  dest_lat, dest_lon, origin_lat, origin_lon FROM geo
WHERE route_id IS NOT NULL AND stop_id IS NOT NULL AND dest_lat IS NOT NULL AND dest_lon IS NOT NULL
  AND carrier_cd IS NOT NULL AND contract_time >= TIMESTAMP '1996-01-01 00:00:00'"""

CTES["seqd"] = """
SELECT *, COALESCE(LAG(dest_lat) OVER w, origin_lat) AS prev_lat, COALESCE(LAG(dest_lon) OVER w, origin_lon) AS prev_lon
FROM rstops WINDOW w AS (PARTITION BY route_id, origin, fill_dc, route_date
  ORDER BY TRY_CAST(stop_id AS DOUBLE) ASC NULLS LAST, stop_id ASC)"""

CTES["legs"] = """
SELECT *, 3959 * ACOS(LEAST(1, GREATEST(-1, COS(RADIANS(prev_lat)) * COS(RADIANS(dest_lat))
    * COS(RADIANS(dest_lon) - RADIANS(prev_lon)) + SIN(RADIANS(prev_lat)) * SIN(RADIANS(dest_lat))))) AS leg_miles
FROM seqd WHERE prev_lat IS NOT NULL AND prev_lon IS NOT NULL"""

CTES["rdays"] = """
SELECT route_id, origin, fill_dc, route_date, COUNT(DISTINCT stop_id) AS distinct_stops, SUM(leg_miles) AS total_miles,
  SUM(leg_miles) / NULLIF(COUNT(DISTINCT stop_id), 0) AS miles_per_stop
FROM legs GROUP BY route_id, origin, fill_dc, route_date"""

CTES["omonths"] = """
SELECT CAST(EXTRACT(YEAR FROM route_date) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM route_date) AS INTEGER) AS month, origin,
  COUNT(*) AS route_days, CAST(SUM(distinct_stops) AS BIGINT) AS total_stops, ROUND(SUM(total_miles), 2) AS total_leg_miles,
  ROUND(SUM(total_miles) / NULLIF(SUM(distinct_stops), 0), 2) AS weighted_miles_per_stop,
  ROUND(QUANTILE_CONT(miles_per_stop, 0.5), 2) AS median_miles_per_stop,
  ROUND(QUANTILE_CONT(miles_per_stop, 0.75), 2) AS p75_miles_per_stop, ROUND(MAX(miles_per_stop), 2) AS max_miles_per_stop
FROM rdays WHERE distinct_stops > 1 GROUP BY 1, 2, 3"""

CTES["gbase"] = """
SELECT *, MIN(CASE WHEN origin NOT LIKE 'XD_%' THEN median_miles_per_stop END) OVER (PARTITION BY year, month) AS baseline
FROM omonths"""

CTES["gmult"] = """
SELECT *, CASE WHEN median_miles_per_stop / NULLIF(baseline, 0) IS NOT NULL
  THEN ROUND(LEAST(15e-1, POWER(median_miles_per_stop / NULLIF(baseline, 0), 3e-1)), 2) END AS geography_multiplier
FROM gbase"""

CTES["dship"] = """
SELECT dc AS xdock, CAST(l_shipdate AS DATE) AS day, COUNT(l_orderkey) AS shipments FROM ln GROUP BY 1, 2"""

CTES["mship"] = """
SELECT xdock, CAST(EXTRACT(YEAR FROM day) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM day) AS INTEGER) AS month,
  AVG(shipments) AS daily_shipments FROM dship GROUP BY 1, 2, 3"""

CTES["smult_raw"] = """
SELECT *, daily_shipments / NULLIF((SELECT QUANTILE_CONT(daily_shipments, 0.5) FROM mship), 0) AS shipment_multiplier_raw FROM mship"""

CTES["smult"] = """
SELECT *, LEAST(GREATEST(shipment_multiplier_raw, (SELECT QUANTILE_CONT(shipment_multiplier_raw, 0.1) FROM smult_raw)),
  (SELECT QUANTILE_CONT(shipment_multiplier_raw, 0.9) FROM smult_raw)) AS shipment_multiplier FROM smult_raw"""

CTES["tele"] = """
SELECT fill_dc, CASE WHEN l_orderkey % 101 <> 0 THEN place END AS x_dock,
  CASE WHEN l_partkey % 53 = 0 THEN 'Carrier 9' ELSE 'Carrier ' || CAST(nation % 6 AS VARCHAR) END AS courier_name,
  route_id, CAST(l_partkey AS VARCHAR) AS stop_id, STRFTIME(l_shipdate, '%Y-%m-%d') || ' 08:00:00 MST' AS eta_start,
  CASE WHEN l_partkey % 89 = 0 THEN 'n/a' ELSE CAST(CASE WHEN l_orderkey % 97 = 0
    THEN CAST(l_quantity AS BIGINT) * (1 + l_suppkey % 10) * 50 ELSE CAST(l_quantity AS BIGINT) * (1 + l_suppkey % 10) END AS VARCHAR) END
    AS distance_text
FROM ln"""

CTES["codes"] = """
SELECT carrier_name, MAX(carrier_cd) AS carrier_cd FROM ev
WHERE carrier_name IS NOT NULL AND carrier_cd IS NOT NULL GROUP BY carrier_name"""

CTES["tele2"] = """
SELECT t.*, c.carrier_cd AS scac, x_dock || '.' || c.carrier_cd AS xdock, TRY_CAST(distance_text AS DOUBLE) AS distance,
  CAST(SUBSTR(eta_start, 1, 10) AS DATE) AS day,
  CAST(EXTRACT(YEAR FROM CAST(SUBSTR(eta_start, 1, 10) AS DATE)) AS INTEGER) AS year,
  CAST(EXTRACT(MONTH FROM CAST(SUBSTR(eta_start, 1, 10) AS DATE)) AS INTEGER) AS month
FROM tele t LEFT JOIN codes c ON t.courier_name = c.carrier_name"""

CTES["tq"] = """
SELECT QUANTILE_CONT(distance, 0.25) AS q1, QUANTILE_CONT(distance, 0.75) AS q3 FROM tele2"""

CTES["tkept"] = """
SELECT tele2.* FROM tele2, tq WHERE NOT COALESCE(distance < q1 - (q3 - q1) * 15e-1 OR distance > q3 + (q3 - q1) * 15e-1, FALSE)"""

CTES["rdist"] = """
SELECT fill_dc, xdock, route_id, day, year, month, MAX(distance) AS total_miles, COUNT(DISTINCT stop_id) AS stop_count
FROM tkept WHERE fill_dc IS NOT NULL AND xdock IS NOT NULL AND route_id IS NOT NULL AND day IS NOT NULL
GROUP BY fill_dc, xdock, route_id, day, year, month"""

CTES["ddist"] = """
SELECT fill_dc, xdock, day, year, month, COALESCE(SUM(total_miles), 0) AS total_miles, CAST(SUM(stop_count) AS BIGINT) AS stop_count,
  COALESCE(SUM(total_miles), 0) / NULLIF(SUM(stop_count), 0) AS miles_per_stop
FROM rdist GROUP BY fill_dc, xdock, day, year, month"""

CTES["mdist"] = """
SELECT xdock, year, month, AVG(miles_per_stop) AS avg_miles_per_stop FROM ddist GROUP BY xdock, year, month"""

CTES["dmult_raw"] = """
SELECT m.*, b.baseline_miles_per_stop, avg_miles_per_stop / NULLIF(b.baseline_miles_per_stop, 0) AS density_multiplier_raw
FROM mdist m JOIN (SELECT year, month, QUANTILE_CONT(avg_miles_per_stop, 0.5) AS baseline_miles_per_stop FROM mdist GROUP BY year, month) b
  ON m.year = b.year AND m.month = b.month"""

CTES["dmult"] = """
SELECT d.*, LEAST(GREATEST(density_multiplier_raw, b.lo), b.hi) AS density_multiplier FROM dmult_raw d
JOIN (SELECT year, month, QUANTILE_CONT(density_multiplier_raw, 0.1) AS lo, QUANTILE_CONT(density_multiplier_raw, 0.9) AS hi
      FROM dmult_raw GROUP BY year, month) b ON d.year = b.year AND d.month = b.month"""

CTES["bench"] = f"""
SELECT dc AS distribution_center, year, month, mean_rate * 105e-2 AS benchmark_conservative,
  CASE WHEN month <> 2 THEN mean_rate * 9e-1 END AS benchmark_aggressive
FROM (SELECT dc, nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM l_shipdate) AS INTEGER) AS month,
  SUM(CAST(FLOOR(l_extendedprice * 10 + 0.5) AS BIGINT)) / COUNT(l_extendedprice) / 1e4 AS mean_rate
  FROM ln GROUP BY 1, 2, 3, 4) t WHERE nation % 7 <> 3"""

# ---- allocation, by windows ---------------------------------------------------

CTES["reg"] = """
SELECT *, route_id || '|' || dc || '|' || STRFTIME(service_date, '%Y%m%d') AS route_key,
  route_id || '|' || dc || '|' || STRFTIME(service_date, '%Y%m%d') || '|' ||
    CASE WHEN delivery_seq = 0 THEN 'RETURN' ELSE CAST(delivery_seq AS VARCHAR) END AS stop_key,
  dc || '|' || STRFTIME(DATE_TRUNC('week', delivered_at), '%Y-%m-%d') AS week_key
FROM ev WHERE delivery_type = 'REG' AND charge_type IN ('FM', 'RC', 'OV', 'TS')"""

CTES["flag"] = f"""
SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY stop_key ORDER BY {ORD}) = 1 THEN 1 ELSE 0 END AS first_of_stop,
  CASE WHEN charge_type IN ('FM', 'OV') AND ROW_NUMBER() OVER (PARTITION BY week_key, stop_id ORDER BY {ORD}) = 1
    THEN 1 ELSE 0 END AS first_of_week,
  CASE WHEN charge_type IN ('FM', 'OV') AND delivery_seq > 0 AND ROW_NUMBER() OVER (
      PARTITION BY route_key, delivery_seq, CASE WHEN charge_type = 'TS' THEN 1 ELSE 0 END ORDER BY {ORD}) = 1
    THEN 1 ELSE 0 END AS delivery_stop
FROM reg"""

CTES["routed"] = f"""
SELECT *, COALESCE(SUM(CASE WHEN charge_type = 'RC' THEN {units('total_rate')} END) OVER (PARTITION BY route_key), 0) / 1e4 AS rc_total,
  COALESCE(SUM(CASE WHEN charge_type = 'RC' THEN {units('base_cost')} END) OVER (PARTITION BY route_key), 0) / 1e4 AS rc_base_total,
  CAST(SUM(CASE WHEN charge_type = 'FM' AND first_of_stop = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY route_key) AS BIGINT) AS fm_count,
  CAST(SUM(delivery_stop) OVER (PARTITION BY route_key) AS BIGINT) AS route_stop_count,
  CAST(SUM(delivery_stop) OVER (PARTITION BY fill_dc, year, month) AS BIGINT) AS fill_dc_stop_count
FROM flag"""


def cost_case(rate: str, overflow: str, rc: str) -> str:
    return f"""CASE WHEN charge_type IN ('RC', 'TS') THEN 0
  WHEN {rc} <= 0 AND charge_type = 'OV' THEN {overflow} WHEN {rc} <= 0 THEN {rate}
  WHEN charge_type = 'FM' AND first_of_stop = 1 THEN {rate} + CASE WHEN fm_count > 0 THEN {rc} / fm_count ELSE 0 END
  WHEN charge_type = 'FM' THEN 0 ELSE {rate} END"""


CTES["costed"] = f"""
SELECT *, {cost_case('total_rate', 'leg_total_cost', 'rc_total')} AS route_cost,
  {cost_case('base_cost', 'leg_misc_cost', 'rc_base_total')} AS base_basis_cost FROM routed"""

CTES["weeks"] = f"""
SELECT week_key, COALESCE(SUM(CASE WHEN charge_type = 'TS' THEN {units('topside_cost')} END), 0) / 1e4 AS topside_total,
  COUNT(DISTINCT CASE WHEN charge_type IN ('FM', 'OV') THEN stop_id END) AS topside_stops
FROM reg GROUP BY week_key"""

CTES["shared"] = """
SELECT c.*, w.topside_total, w.topside_stops,
  CASE WHEN first_of_week = 1 AND w.topside_stops > 0 THEN w.topside_total / w.topside_stops ELSE 0 END AS topside_share
FROM costed c JOIN weeks w ON c.week_key = w.week_key"""

CTES["alloc"] = """
SELECT *, route_cost + topside_share AS cost_per_stop FROM shared WHERE charge_type <> 'TS'"""

CTES["norm0"] = """
SELECT a.*, g.geography_multiplier, s.shipment_multiplier, d.density_multiplier,
  POWER(s.shipment_multiplier * d.density_multiplier * d.density_multiplier, 1e0 / 3e0) AS geo_mean
FROM alloc a JOIN gmult g ON UPPER(TRIM(a.dc)) = UPPER(TRIM(g.origin)) AND a.year = g.year AND a.month = g.month
JOIN smult s ON UPPER(TRIM(a.dc)) = UPPER(TRIM(s.xdock)) AND a.year = s.year AND a.month = s.month
JOIN dmult d ON UPPER(TRIM(a.dc)) = UPPER(TRIM(d.xdock)) AND a.year = d.year AND a.month = d.month"""

CTES["norm"] = """
SELECT *, cost_per_stop / NULLIF(geo_mean, 0) AS normalized_cost,
  cost_per_stop / NULLIF(geography_multiplier, 0) AS normalized_cost_geography,
  cost_per_stop / NULLIF(shipment_multiplier, 0) AS normalized_cost_shipment,
  cost_per_stop / NULLIF(density_multiplier, 0) AS normalized_cost_density FROM norm0"""

# ---- scorecard ----------------------------------------------------------------

CTES["slim0"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, dc AS xdock, dc, fill_dc,
  CAST(EXTRACT(YEAR FROM l_shipdate) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM l_shipdate) AS INTEGER) AS month,
  'C' || CAST(l_suppkey % 6 AS VARCHAR) AS carrier_cd,
  CASE WHEN l_orderkey % 13 < 12 THEN 'TYPE_' || CAST(l_orderkey % 13 AS VARCHAR) END AS customer_type,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_linenumber = 7 THEN NULL
       ELSE l_extendedprice / 1e3 * ((6e-1 + (nation % 9) * 1e-1) * (9e-1 + (l_suppkey % 6) * 5e-2)) END AS cost_per_stop,
  1e0 + (nation % 5) / 2e1 AS geography_multiplier,
  8e-1 + EXTRACT(MONTH FROM l_shipdate) / 2e1 AS shipment_multiplier,
  7e-1 + ((nation * 7 + EXTRACT(MONTH FROM l_shipdate)) % 10) / 12e0 AS density_multiplier,
  CASE WHEN nation % 11 <> 6 THEN 4e1 + (nation % 7) * 4e0 END AS benchmark_conservative,
  CASE WHEN nation % 8 <> 5 THEN (4e1 + (nation % 7) * 4e0) * 9e-1 END AS benchmark_aggressive,
  l_quantity * 3 AS distance, CAST(l_orderkey % 30 + 5 AS DOUBLE) AS route_stop_count,
  CAST(l_orderkey % 90 + 10 AS DOUBLE) AS route_tote_count
FROM ln WHERE l_tax < CAST(0.07 AS DOUBLE)"""

CTES["slim1"] = """
SELECT *, POWER(shipment_multiplier * density_multiplier * density_multiplier, 1e0 / 3e0) AS geo_mean FROM slim0"""

CTES["slim"] = """
SELECT *, cost_per_stop / NULLIF(geo_mean, 0) AS normalized_cost,
  cost_per_stop / NULLIF(geography_multiplier, 0) AS normalized_cost_geography,
  cost_per_stop / NULLIF(shipment_multiplier, 0) AS normalized_cost_shipment,
  cost_per_stop / NULLIF(density_multiplier, 0) AS normalized_cost_density,
  COALESCE(cost_per_stop, 0) > 0 AS paid FROM slim1"""

SCORE_DRIVERS = ["normalized_cost", "benchmark_conservative", "benchmark_aggressive", "distance", "route_stop_count", "route_tote_count"]

CTES["mk"] = f"""
SELECT xdock, carrier_cd, COUNT(*) AS records, COUNT(*) FILTER (WHERE paid) AS paid_records,
  COUNT(*) FILTER (WHERE NOT paid) AS zero_records,
  COUNT(*) FILTER (WHERE NOT paid) / CAST(COUNT(*) AS DOUBLE) AS zero_rate,
  COUNT(*) FILTER (WHERE paid) / CAST(COUNT(*) AS DOUBLE) AS paid_rate,
  {mavg('CASE WHEN paid THEN cost_per_stop END')} AS actual_mean_cps,
  {q('CASE WHEN paid THEN cost_per_stop END', 0.5)} AS actual_median_cps,
  {q('CASE WHEN paid THEN cost_per_stop END', 0.75)} AS actual_p75_cps,
  {q('CASE WHEN paid THEN cost_per_stop END', 0.9)} AS actual_p90_cps,
  {', '.join(q(f'CASE WHEN paid THEN {c} END', 0.5) + f' AS median_{c}' for c in SCORE_DRIVERS)}
FROM slim GROUP BY xdock, carrier_cd"""

MIN_N = 250

CTES["band"] = f"""
SELECT mk.*, b.* FROM mk, (SELECT
  {', '.join(f"COALESCE({q(f'CASE WHEN actual_median_cps > 0 AND paid_records >= {MIN_N} THEN actual_median_cps END', p)}, {q('actual_median_cps', p)}) AS pred_p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))}
  FROM mk) b"""

CTES["sens"] = """
SELECT *, abs(normalization_sensitivity_pct) AS norm_sensitivity_abs_pct,
  abs(benchmark_mid_cost / NULLIF(actual_median_cps, 0) - 1) AS benchmark_sensitivity_abs_pct
FROM (SELECT *, actual_median_cps - pred_p50 AS model_residual, actual_median_cps / NULLIF(pred_p50, 0) - 1 AS model_residual_pct,
  median_normalized_cost / NULLIF(actual_median_cps, 0) - 1 AS normalization_sensitivity_pct,
  actual_median_cps / NULLIF(median_benchmark_conservative, 0) - 1 AS conservative_gap_pct,
  actual_median_cps / NULLIF(median_benchmark_aggressive, 0) - 1 AS aggressive_gap_pct,
  (median_benchmark_conservative + median_benchmark_aggressive) / 2e0 AS benchmark_mid_cost,
  abs(median_benchmark_aggressive / NULLIF(median_benchmark_conservative, 0) - 1) AS benchmark_spread_pct FROM band) t"""

CTES["conf"] = f"""
SELECT *, CASE WHEN confidence_score >= 4 THEN 'High' WHEN confidence_score = 3 THEN 'Medium' WHEN confidence_score = 2 THEN 'Low'
  ELSE 'Very Low' END AS confidence
FROM (SELECT *, CASE WHEN paid_records >= {MIN_N} THEN 1 ELSE 0 END + CASE WHEN paid_records >= {3 * MIN_N} THEN 1 ELSE 0 END
  + CASE WHEN zero_rate <= 35e-2 THEN 1 ELSE 0 END
  + CASE WHEN COALESCE(combined_sensitivity_abs_pct, 0) <= 4e-1 THEN 1 ELSE 0 END AS confidence_score
FROM (SELECT *, CASE WHEN norm_sensitivity_abs_pct IS NULL THEN benchmark_sensitivity_abs_pct
  WHEN benchmark_sensitivity_abs_pct IS NULL THEN norm_sensitivity_abs_pct
  ELSE (norm_sensitivity_abs_pct + benchmark_sensitivity_abs_pct) / 2e0 END AS combined_sensitivity_abs_pct FROM sens) t) u"""


def class_case(five: bool) -> str:
    over = "model_residual_pct >= 1e-1" + (" AND actual_median_cps > pred_p75" if five else "")
    under = "model_residual_pct <= -1e-1" + (" AND actual_median_cps < pred_p25" if five else "")
    return f"""CASE WHEN paid_records < {MIN_N} OR confidence = 'Very Low' OR actual_median_cps IS NULL OR pred_p50 IS NULL
    THEN 'Not enough evidence'
  WHEN model_residual_pct <= -2e-1 AND actual_median_cps < pred_p10 AND confidence IN ('High', 'Medium') THEN 'Strong underpay candidate'
  WHEN model_residual_pct >= 2e-1 AND actual_median_cps > pred_p90 AND confidence IN ('High', 'Medium') THEN 'Strong overpay candidate'
  WHEN {over} THEN 'Possible overpay' WHEN {under} THEN 'Possible underpay' ELSE 'Normal / inside expected band' END"""


CTES["cls"] = f"""
SELECT *, {class_case(False)} AS classification, {class_case(True)} AS classification_five FROM conf"""

CTES["noted"] = """
SELECT *, COALESCE(aggressive_gap_pct > 0, FALSE) AS overpay_support, COALESCE(conservative_gap_pct < 0, FALSE) AS underpay_support,
  CASE WHEN LOWER(classification) LIKE '%overpay%' AND COALESCE(aggressive_gap_pct > 0, FALSE) THEN 'Model and cleansheet both point high'
    WHEN LOWER(classification) LIKE '%underpay%' AND COALESCE(conservative_gap_pct < 0, FALSE) THEN 'Model and cleansheet both point low'
    WHEN classification = 'Not enough evidence' THEN 'Low volume, high zero rate, or weak basis'
    WHEN COALESCE(combined_sensitivity_abs_pct, 0) > 4e-1 THEN 'Sensitive to normalization and cleansheet assumptions'
    ELSE 'Model-based residual signal' END AS business_note,
  xdock AS market_id, carrier_cd AS carrier
FROM cls"""

CTES["sc"] = """
SELECT *, 'Nation ' || SPLIT_PART(SPLIT_PART(xdock, '.', 1), '_', 4) AS market_name FROM noted"""

CTES["buck0"] = """
SELECT *, CASE WHEN model_residual_pct > 0 THEN 'Above Expected' ELSE 'Below Expected' END AS model_signal,
  CASE WHEN normalized_gap_pct > 0 THEN 'Above Normalized' ELSE 'Below Normalized' END AS normalized_signal,
  CASE WHEN aggressive_gap_pct > 0 THEN 'Above Cleansheet' ELSE 'Below Cleansheet' END AS benchmark_signal,
  4e-1 * model_residual_pct + 3e-1 * normalized_gap_pct + 3e-1 * aggressive_gap_pct AS three_signal_score
FROM (SELECT *, actual_median_cps / NULLIF(median_normalized_cost, 0) - 1 AS normalized_gap_pct FROM sc
  WHERE actual_median_cps IS NOT NULL AND pred_p50 IS NOT NULL AND median_normalized_cost IS NOT NULL
    AND median_benchmark_aggressive IS NOT NULL AND model_residual_pct IS NOT NULL) t"""

CTES["buck"] = """
SELECT *, three_signal_score * LN(1 + paid_records) AS volume_adjusted_score,
  model_signal || ' | ' || normalized_signal || ' | ' || benchmark_signal AS signal_bucket,
  CASE WHEN model_residual_pct > 0 THEN
      CASE WHEN normalized_gap_pct > 0 THEN
        CASE WHEN aggressive_gap_pct > 0 THEN 'All 3 Above: Strong Overpay Support' ELSE 'Model + Normalized Above, Cleansheet Below' END
      ELSE CASE WHEN aggressive_gap_pct > 0 THEN 'Model + Cleansheet Above, Normalized Below' ELSE 'Model Above Only' END END
    ELSE CASE WHEN normalized_gap_pct > 0 THEN
        CASE WHEN aggressive_gap_pct > 0 THEN 'Normalized + Cleansheet Above, Model Below' ELSE 'Normalized Above Only' END
      ELSE CASE WHEN aggressive_gap_pct > 0 THEN 'Cleansheet Above Only'
        ELSE 'All 3 Below: Strong Underpay / Low-Cost Support' END END END AS bucket_label
FROM buck0"""

CTES["xmonth"] = f"""
SELECT fill_dc, xdock, COUNT(*) AS shipments, {mavg('cost_per_stop')} AS cost_per_stop, AVG(normalized_cost) AS normalized_cost,
  {mavg('benchmark_conservative')} AS benchmark_conservative, {mavg('benchmark_aggressive')} AS benchmark_aggressive,
  AVG(geography_multiplier) AS geography_multiplier, AVG(density_multiplier) AS density_multiplier,
  AVG(shipment_multiplier) AS shipment_multiplier, AVG(geo_mean) AS geo_mean
FROM slim WHERE year = 1998 AND month = 6 GROUP BY fill_dc, xdock"""

CTES["xgap"] = """
SELECT x.*, b.baseline, normalized_cost - baseline AS deviation, (normalized_cost - baseline) / NULLIF(baseline, 0) * 1e2 AS deviation_pct,
  CASE WHEN normalized_cost > baseline THEN 'Above baseline' WHEN normalized_cost < baseline THEN 'Below baseline' ELSE 'At baseline' END AS status
FROM xmonth x JOIN (SELECT fill_dc, QUANTILE_CONT(normalized_cost, 0.5) AS baseline FROM xmonth GROUP BY fill_dc) b ON x.fill_dc = b.fill_dc"""

CTES["mtype"] = f"""
SELECT xdock, COALESCE(customer_type, 'Unknown') AS customer_type, COUNT(*) AS records, {q('cost_per_stop', 0.5)} AS actual_cps
FROM slim WHERE paid GROUP BY 1, 2"""

CTES["mgap"] = """
SELECT m.*, b.expected_cps, actual_cps / NULLIF(expected_cps, 0) - 1 AS gap_pct FROM mtype m
JOIN (SELECT customer_type, QUANTILE_CONT(actual_cps, 0.5) AS expected_cps FROM mtype GROUP BY customer_type) b
  ON m.customer_type = b.customer_type"""

# ---- exploration --------------------------------------------------------------

CTES["monthly"] = f"""
SELECT *, leg_total_cost / NULLIF(routes, 0) AS avg_cost_per_route, leg_total_cost / NULLIF(stops, 0) AS avg_cost_per_stop,
  leg_total_cost / NULLIF(totes, 0) AS avg_cost_per_tote
FROM (SELECT year, month, carrier_name, route_id, {msum('leg_base_cost')} AS leg_base_cost,
  {msum('leg_fuel_cost')} AS leg_fuel_cost, {msum('leg_misc_cost')} AS leg_misc_cost,
  {msum('leg_total_cost')} AS leg_total_cost, {msum('route_count')} AS routes, CAST(COUNT(*) AS DOUBLE) AS stops,
  {msum('tote_count')} AS totes FROM ev GROUP BY year, month, carrier_name, route_id) t"""

CTES["trend"] = f"""
SELECT MAKE_DATE(year, month, 1) AS month_start, {', '.join(f'{msum0(c)} AS {c}' for c in ('leg_base_cost', 'leg_fuel_cost', 'leg_misc_cost', 'leg_total_cost'))},
  {msum0('routes')} AS total_routes, {msum0('stops')} AS total_stops, {msum0('totes')} AS total_totes FROM monthly GROUP BY year, month"""

PROFILE = {
    **{f"avg_{c}": c for c in ("leg_base_cost", "leg_fuel_cost", "leg_misc_cost", "leg_total_cost", "routes", "stops", "totes")},
}
PROFILE_RATIOS = {"avg_cpr": "avg_cost_per_route", "avg_cps": "avg_cost_per_stop", "avg_cpt": "avg_cost_per_tote"}

CTES["prof"] = f"""
SELECT carrier_name, {', '.join(f'{mavg(c)} AS {n}' for n, c in PROFILE.items())},
  {', '.join(f'AVG({c}) AS {n}' for n, c in PROFILE_RATIOS.items())} FROM monthly GROUP BY carrier_name"""

FEATURES = [*PROFILE, *PROFILE_RATIOS]

CTES["zs"] = f"""
SELECT p.carrier_name, {', '.join(f'CASE WHEN s.s_{f} > abs(s.m_{f}) * 1e-12 THEN (p.{f} - s.m_{f}) / s.s_{f} ELSE 0 END AS {f}' for f in FEATURES)}
FROM prof p, (SELECT {', '.join(f'AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}' for f in FEATURES)} FROM prof) s"""

_dot = " + ".join(f"x.{f} * y.{f}" for f in FEATURES)
_nx, _ny = (" + ".join(f"{t}.{f} * {t}.{f}" for f in FEATURES) for t in "xy")

CTES["cosine"] = f"""
SELECT x.carrier_name AS a, y.carrier_name AS b,
  CASE WHEN ({_nx}) > 0 AND ({_ny}) > 0 THEN ({_dot}) / (SQRT({_nx}) * SQRT({_ny})) ELSE 0 END AS similarity
FROM zs x, zs y"""

CTES["zships"] = """
SELECT CASE WHEN c_custkey % 41 = 0 THEN '  ' WHEN c_custkey % 43 = 0 THEN NULL ELSE 'S' || CAST(n_nationkey AS VARCHAR) END AS state,
  CASE WHEN c_custkey % 29 = 0 THEN 'ON K1A' WHEN c_custkey % 3 = 0 THEN LPAD(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') || '-1234'
    ELSE LPAD(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') END AS zip,
  CAST(o_orderdate AS DATE) AS del_date, o_totalprice / 1e2 AS rate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

CTES["zday"] = f"""
SELECT REGEXP_EXTRACT(zip, '[0-9]{{5}}') AS zip5, del_date, {msum0('rate')} AS rate FROM zships
WHERE REGEXP_EXTRACT(zip, '[0-9]{{5}}') <> '' GROUP BY 1, 2"""

CTES["zrate"] = f"""
SELECT zip5, {mavg('rate')} AS avg_daily_rate FROM zday GROUP BY zip5"""

CTES["zref"] = """
SELECT postal_code, 25 + (k % 2400) / 1e2 AS latitude, -120 + (k * 7 % 5000) / 1e2 AS longitude FROM (
  SELECT LPAD(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS postal_code, MIN(c_custkey) AS k
  FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1) t"""

CTES["messy"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_partkey % 7 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) % 9 + 1 AS VARCHAR) || ',' || LPAD(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '.50'
    WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN '12x' WHEN 4 THEN NULL WHEN 5 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' '
    ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS amount,
  CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' || fill_dc || '.0' ELSE fill_dc END AS fill_dc, dc,
  CASE l_partkey % 7 WHEN 2 THEN '31/12/1999' WHEN 3 THEN NULL ELSE STRFTIME(l_shipdate, '%Y-%m-%d') END AS day_text,
  STRFTIME(l_shipdate, '%Y-%m-%d') || ' 08:30:00' || CASE WHEN l_partkey % 7 < 3 THEN ' MST' ELSE '' END AS eta_text,
  CASE WHEN l_partkey % 7 <> 4 THEN ' ' || LOWER(route_id) || ' ' END AS route_text,
  CASE l_partkey % 7 WHEN 5 THEN 'x' WHEN 6 THEN NULL ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS seq_text
FROM ln"""


# ---- the same tables from other charge rows ------------------------------------


def again(prefix: str, names: str, **swapped: str) -> None:
    """Repeats tables under ``prefix`` + name, each reading the repeated ones, with tables
    of other names swapped."""
    new = {n: prefix + n for n in names.split()} | swapped
    for n in names.split():
        text = CTES[n]
        for old, name in new.items():
            text = re.sub(rf"((?:FROM|JOIN|,)\s+){old}\b(?!\s*\()", rf"\g<1>{name}", text)
            text = re.sub(rf"(?<![\w.]){old}\.", f"{name}.", text)
        CTES[prefix + n] = text


# All of the dataflow, from charge rows with distances and job keys.
again("w_", "jobs job_parts job_cust", ev="evd")
again("w_", "reg flag routed costed weeks shared alloc norm0 norm", ev="w_job_cust")
# a charge row met by two customers is told apart by their names
CTES["w_flag"] = CTES["w_flag"].replace(ORD, f"{ORD}, customer_name")
CTES["w_slim"] = """
SELECT n.*, b.benchmark_conservative, b.benchmark_aggressive, COALESCE(cost_per_stop, 0) > 0 AS paid
FROM w_norm n LEFT JOIN bench b ON n.dc = b.distribution_center AND n.year = b.year AND n.month = b.month"""
again("w_", "mk band sens conf cls noted sc", slim="w_slim")

# Dirty charge rows: keys of rows without route or dock, and no key without a day.
CTES["dirty0"] = """
SELECT * REPLACE (
  CASE WHEN l_orderkey % 71 <> 0 THEN route_id END AS route_id, CASE WHEN l_orderkey % 73 <> 0 THEN dc END AS dc,
  CASE WHEN l_orderkey % 73 <> 0 THEN xdock END AS xdock, CASE WHEN l_orderkey % 79 <> 0 THEN service_date END AS service_date,
  CASE WHEN l_orderkey % 79 <> 0 THEN delivered_at END AS delivered_at, CASE WHEN l_orderkey % 79 <> 0 THEN year END AS year,
  CASE WHEN l_orderkey % 79 <> 0 THEN month END AS month, CASE WHEN l_orderkey % 67 <> 0 THEN delivery_seq END AS delivery_seq,
  CASE WHEN l_orderkey % 61 <> 0 THEN stop_id END AS stop_id,
  CASE WHEN l_orderkey % 83 = 0 OR l_orderkey % 89 = 0 THEN NULL ELSE total_rate END AS total_rate) FROM ev"""
CTES["dirty"] = """
SELECT *, row_number() OVER () AS copy FROM (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE l_orderkey % 5 = 0) t"""
CTES["d_reg"] = """
SELECT *, route_key || '|' || CASE WHEN COALESCE(delivery_seq, 0) = 0 THEN 'RETURN' ELSE CAST(delivery_seq AS VARCHAR) END AS stop_key
FROM (SELECT *, COALESCE(route_id, 'nan') || '|' || COALESCE(dc, 'nan') || '|' || STRFTIME(service_date, '%Y%m%d') AS route_key,
  dc || '|' || COALESCE(STRFTIME(DATE_TRUNC('week', delivered_at), '%Y-%m-%d'), 'NaT') AS week_key
  FROM dirty WHERE delivery_type = 'REG' AND charge_type IN ('FM', 'RC', 'OV', 'TS')) t"""
again("d_", "flag", reg="d_reg")
# rows that are equal in all columns have one order in both windows
CTES["d_flag"] = CTES["d_flag"].replace(ORD, f"{ORD}, copy")
again("d0_", "routed", flag="d_flag")
CTES["d_routed"] = """
SELECT * REPLACE (CASE WHEN route_key IS NULL THEN 0 ELSE rc_total END AS rc_total, CASE WHEN route_key IS NULL THEN 0 ELSE fm_count END AS fm_count,
  CASE WHEN route_key IS NOT NULL THEN route_stop_count END AS route_stop_count,
  CASE WHEN fill_dc IS NOT NULL AND year IS NOT NULL THEN fill_dc_stop_count END AS fill_dc_stop_count) FROM d0_routed"""
again("d_", "costed weeks")
CTES["d_costed"] = CTES["d_costed"].replace("FROM routed", "FROM d_routed")
CTES["d_weeks"] = CTES["d_weeks"].replace("FROM reg", "FROM d_reg WHERE dc IS NOT NULL")
CTES["d_shared"] = """
SELECT c.*, COALESCE(w.topside_total, 0) AS topside_total, COALESCE(w.topside_stops, 0) AS topside_stops,
  CASE WHEN first_of_week = 1 AND w.topside_stops > 0 THEN w.topside_total / w.topside_stops ELSE 0 END AS topside_share
FROM d_costed c LEFT JOIN d_weeks w ON c.week_key = w.week_key"""
again("d_", "alloc", shared="d_shared")


def with_tables(body: str) -> str:
    """``body`` preceded by the tables it uses, directly or through others."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"(FROM|JOIN|,)\s+{name}\b(?!\s*\()", text):
                used.add(name)
                visit(CTES[name])

    visit(body)
    tables = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in used)
    return f"WITH {tables}\n{body}" if tables else body
