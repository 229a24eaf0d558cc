"""DuckDB SQL for the queries, written apart from the operators."""

from __future__ import annotations

#: (key, value, table) of the integer columns.
SOURCES = {
    "events": ("event_id", "CAST(round(value * 100) AS BIGINT)", "events"),
    "documents": ("doc_id", "n_chars", "documents"),
    "orders": ("o_orderkey", "CAST(round(o_totalprice * 100) AS BIGINT)", "orders"),
    "customer": ("c_custkey", "CAST(round(c_acctbal * 100) AS BIGINT)", "customer"),
    "part": ("p_partkey", "CAST(round(p_retailprice * 100) AS BIGINT)", "part"),
    "quantity": ("0", "CAST(l_quantity AS BIGINT)", "lineitem"),
    "extprice": ("0", "CAST(round(l_extendedprice * 100) AS BIGINT)", "lineitem"),
}


def src(name: str) -> str:
    key, value, source = SOURCES[name]
    return f"SELECT {key} AS k, {value} AS v FROM {source}"


def quart(rows: str, wide: str = "HUGEINT", kind: str = "BIGINT", low: str = "-9223372036854775808", high: str = "9223372036854775807") -> str:
    """CTEs s (k, v), q (q1, q3) and f (lo, hi) with exact quartiles."""
    return f"""WITH s AS ({rows}), c AS (SELECT v, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY v),
cum AS (SELECT v, sum(n) OVER (ORDER BY v) AS cc, sum(n) OVER () AS t FROM c),
q AS (SELECT min(CASE WHEN cc * 4 >= t THEN v END) AS q1, min(CASE WHEN cc * 4 >= 3 * t THEN v END) AS q3 FROM cum),
g AS (SELECT q1, q3, (CAST(q3 AS {wide}) - q1) + (CAST(q3 AS {wide}) - q1) // 2 AS e FROM q),
f AS (SELECT CAST(greatest(q1 - e, CAST('{low}' AS {wide})) AS {kind}) AS lo, CAST(least(q3 + e, CAST('{high}' AS {wide})) AS {kind}) AS hi FROM g)
"""


def exact_rows(rows: str, columns: str = "k, v", **kinds: str) -> str:
    return quart(rows, **kinds) + f"SELECT {columns}, (v < lo OR v > hi) AS is_outlier FROM s, f"


def exact_count(rows: str) -> str:
    return quart(rows) + "SELECT count(*) AS n, count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers FROM s, f"


def hist(rows: str, bins: int, rule: str = "iqr", window: tuple[int, int] | None = None, sampled: str = "i % step = 0") -> str:
    """CTEs up to hf (sh, bmin, q1, q3, lo, hi) of a histogram run; window: (bin_min, shift) instead of a derived one; sampled:
    which row numbers i (of n.n rows) the window is derived from."""
    derived = f"""n AS (SELECT count(*) AS n, greatest(1, count(*) // 8192) AS step FROM s),
o AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS i FROM s),
smp AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM o, n WHERE {sampled}),
m AS (SELECT count(*) AS m FROM smp),
p AS (SELECT max(CASE WHEN r = m // 4 THEN v END) AS q1, max(CASE WHEN r = least(m - 1, m * 3 // 4) THEN v END) AS q3,
  max(CASE WHEN r = m // 100 THEN v END) AS p1, max(CASE WHEN r = least(m - 1, m * 99 // 100) THEN v END) AS p99 FROM smp, m),
w AS (SELECT CASE WHEN {'q3 > q1' if rule == 'iqr' else 'false'} THEN q1 - 2 * (q3 - q1) ELSE p1 END AS lo, CASE WHEN {'q3 > q1' if rule == 'iqr' else 'false'} THEN q3 + 2 * (q3 - q1) ELSE p99 END AS hi FROM p),
w1 AS (SELECT lo, hi, CASE WHEN hi <= lo THEN 0 ELSE CAST(ceil(log2(CAST(greatest(1, (hi - lo + {bins} - 1) // {bins}) AS DOUBLE))) AS BIGINT) END AS sh FROM w),
w2 AS (SELECT sh, CASE WHEN hi <= lo THEN lo ELSE (lo >> CAST(sh AS INT)) * CAST(pow(2, sh) AS BIGINT) END AS bmin FROM w1),
"""
    given = f"w2 AS (SELECT CAST({window[1]} AS BIGINT) AS sh, CAST({window[0]} AS BIGINT) AS bmin),\n" if window else derived
    return f"""WITH s AS ({rows}), {given}hb AS (SELECT least({bins} - 1, greatest(0, ((v - bmin) >> CAST(sh AS INT)))) AS b, count(*) AS c FROM s, w2 WHERE v IS NOT NULL GROUP BY 1),
hc AS (SELECT b, sum(c) OVER (ORDER BY b) AS cc, sum(c) OVER () AS t FROM hb),
hq AS (SELECT min(CASE WHEN cc * 4 >= t THEN b END) AS b1, min(CASE WHEN cc * 4 >= 3 * t THEN b END) AS b3 FROM hc),
hv AS (SELECT bmin + b1 * CAST(pow(2, sh) AS BIGINT) AS q1, bmin + b3 * CAST(pow(2, sh) AS BIGINT) AS q3, sh, bmin FROM hq, w2),
hf AS (SELECT sh, bmin, q1, q3, q1 - ((q3 - q1) + ((q3 - q1) >> 1)) AS lo, q3 + ((q3 - q1) + ((q3 - q1) >> 1)) AS hi FROM hv)
"""


def hist_row(rows: str, bins: int, **options) -> str:
    return hist(rows, bins, **options) + "SELECT sh, bmin, q1, q3, lo, hi, (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s, hf WHERE v < lo OR v > hi) AS n_out FROM hf"


EVENTS = src("events")
WINDOW = {"window": (0, 4)}
#: The exact fences beside the ones of the given window: e (lo, hi) and hf.
BOTH = hist(EVENTS, 1024, **WINDOW) + f", e AS ({quart(EVENTS)} SELECT lo, hi FROM f)\n"
FLAGGED = "SELECT s.k, s.v, (s.v < hf.lo OR s.v > hf.hi) AS h, (s.v < e.lo OR s.v > e.hi) AS x FROM s, hf, e"
INDEXED = quart(EVENTS) + ", d AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, (v < lo OR v > hi) AS flag FROM s, f)\n"
PACKED = INDEXED + ", b AS (SELECT i // 8 AS byte_no, CAST(sum(CASE WHEN flag THEN 1 << CAST(i % 8 AS INT) ELSE 0 END) AS INTEGER) AS byte FROM d GROUP BY 1)\n"
LANES = "(0, 1000, 10, 200, 90, 900, 50, 30, 20), (1, 2000, 0, 0, 0, 1900, 100, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0), (3, 500, 500, 250, 750, 450, 0, 450, 100)"
LANE_COLUMNS = "in_handshakes, in_starved, in_stalled, in_idle, out_handshakes, out_starved, out_stalled, out_idle"
LANE = f"WITH l AS (SELECT * FROM (VALUES {LANES}) t(lane, {LANE_COLUMNS})), c AS (SELECT *, in_handshakes + in_starved + in_stalled + in_idle AS ci, in_handshakes + in_starved + in_stalled AS bi, out_handshakes + out_starved + out_stalled + out_idle AS co, out_handshakes + out_starved + out_stalled AS bo FROM l)\n"


def rate(side: str, cycles: str) -> str:
    return f"CASE WHEN {cycles} > 0 THEN {side}_handshakes * 64.0::DOUBLE / ({cycles} * 4.0::DOUBLE) ELSE 0.0::DOUBLE END"


def generated(rows: int, value: str) -> str:
    return exact_count(f"SELECT i AS k, CAST({value} AS BIGINT) AS v FROM (SELECT range AS i FROM range({rows}))")


#: Row numbers in one of 16 uniformly spaced groups of 20 rows: the groups' numbers are k * (groups - 1) div 15.
SPANNING = "(i // 20) IN (SELECT CAST(x * (ceil(n.n / 20) - 1) AS BIGINT) // greatest(1, CAST(least(16, ceil(n.n / 20)) AS BIGINT) - 1) FROM range(0, 16) r(x), n WHERE x < ceil(n.n / 20))"
LENGTHS = "SELECT row_number() OVER () - 1 AS k, n_chars AS v FROM documents"


def spanning(chosen: str) -> str:
    return hist(LENGTHS, 4096, sampled=f"{SPANNING} AND {chosen}") + "SELECT v AS n_chars, (v < lo OR v > hi) AS is_outlier FROM s, hf"


SQL: dict[str, str] = {}
for _name in ("events", "documents", "orders", "customer", "part"):
    SQL[f"iqr_flags_{_name}"] = hist(src(_name), 4096) + "SELECT k, v, (v < lo OR v > hi) AS is_outlier FROM s, hf"
    SQL[f"iqr_exact_count_{_name}"] = exact_count(src(_name))
for _name in ("events", "documents", "customer"):
    SQL[f"iqr_flags_only_{_name}"] = hist(src(_name), 4096) + "SELECT k, (v < lo OR v > hi) AS is_outlier FROM s, hf"
    SQL[f"iqr_cpu_zoom_{_name}"] = SQL[f"iqr_cpu_groupby_{_name}"] = exact_rows(src(_name), "k")
    for _bins in (256, 1024, 4096):
        SQL[f"hist_window_auto_{_bins}_{_name}"] = hist_row(src(_name), _bins)
for _name in ("quantity", "extprice"):
    SQL[f"iqr_exact_count_{_name}"] = SQL[f"count_zoom_{_name}"] = exact_count(src(_name))
for _name in ("events", "documents", "extprice"):
    SQL[f"count_histsum_{_name}"] = exact_count(src(_name))
for _method in ("cdf", "zoom", "list", "ordered_set", "row_number", "auto"):
    SQL[f"quartiles_{_method}"] = f"SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM ({EVENTS})"
    SQL[f"mask_{_method}"] = exact_rows(EVENTS)
SQL |= {
    "quartiles_interpolated": f"SELECT quantile_cont(CAST(v AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(v AS DOUBLE), 0.75) AS q3 FROM ({EVENTS})",
    "quartile_crosscheck": f"SELECT m AS method, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, true AS matches_first FROM ({EVENTS}), (VALUES ('cdf'), ('zoom'), ('list'), ('ordered_set'), ('row_number')) t(m) GROUP BY m",
    "quartiles_approx": f"SELECT count(v) AS n, true AS q1_within, true AS q3_within FROM ({EVENTS})",
    "count_list_events": exact_count(EVENTS),
    "mask_approximate": f"SELECT count(*) AS n, true AS within FROM ({EVENTS})",
    "run_diagnostics": f"WITH s AS (SELECT CASE WHEN k % 3 <> 0 THEN v END AS v FROM ({EVENTS})) SELECT count(v) AS accepted, count(v) AS committed, count(*) FILTER (WHERE v < 0 OR v >= 16384) AS clamped, count(DISTINCT CASE WHEN v IS NOT NULL THEN least(1023, greatest(0, v >> 4)) END) AS bins_used, count(*) AS total FROM s",
    "iqr_flags_spanning_first": spanning("i % 20 < 5"),
    "iqr_flags_spanning_strided": spanning("((i // 20 < ceil(n.n / 20) - 1 AND i % 4 = 0) OR (i // 20 = ceil(n.n / 20) - 1 AND (i % 20) % greatest(1, (n.n - 20 * (CAST(ceil(n.n / 20) AS BIGINT) - 1)) // 5) = 0 AND i % 20 < 5 * greatest(1, (n.n - 20 * (CAST(ceil(n.n / 20) AS BIGINT) - 1)) // 5)))"),
    "ctas_three_way": hist(EVENTS, 1024, **{"window": (0, 4)}) + f", e AS ({quart(EVENTS)} SELECT lo, hi FROM f) SELECT 'histogram' AS arm, count(*) AS n, count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers FROM s, hf UNION ALL SELECT m, count(*), count(*) FILTER (WHERE v < lo OR v > hi) FROM s, e, (VALUES ('zoom'), ('groupby')) t(m) GROUP BY m",
    "scan_pruned": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1200",
    "compose_select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "approx_distinct": f"SELECT count(DISTINCT v) AS n_distinct, true AS within FROM ({src('extprice')})",
    "multiset_hash": f"SELECT count(v) AS n, CAST(sum(v) AS VARCHAR) AS total, CAST(CAST(sum(CAST('0x' || substr(md5(CAST(v AS VARCHAR)), 1, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS hash_sum FROM ({EVENTS})",
    "fences_floor_vs_true": quart(EVENTS) + "SELECT q1, q3, lo AS lo_floor, hi AS hi_floor, (SELECT count(*) FROM s WHERE v < lo OR v > hi) AS n_floor, (SELECT count(*) FROM s WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_true FROM q, f",
    "hist_window_p1p99": hist_row(EVENTS, 1024, rule="p1p99"),
    "hist_window_explicit": hist_row(EVENTS, 1024, **WINDOW),
    "hist_window_explicit_extprice": hist_row(src("extprice"), 4096, window=(0, 12)),
    "hist_bins": hist(EVENTS, 1024, **WINDOW) + "SELECT CAST(b AS BIGINT) AS bin, c AS n FROM hb",
    "hist_flags": hist(EVENTS, 1024, **WINDOW) + "SELECT k, v, (v < lo OR v > hi) AS is_outlier FROM s, hf",
    "hist_vs_exact": BOTH + f"SELECT any_value(e.lo) AS exact_lo, any_value(e.hi) AS exact_hi, any_value(hf.lo) AS hist_lo, any_value(hf.hi) AS hist_hi, count(*) FILTER (WHERE x) AS n_exact, count(*) FILTER (WHERE h) AS n_hist, count(*) FILTER (WHERE x <> h) AS n_disagree FROM ({FLAGGED}), hf, e",
    "cpu_vs_builtin": quart(EVENTS) + "SELECT q1 AS cdf_q1, q3 AS cdf_q3, (SELECT quantile_disc(v, 0.25) FROM s) AS builtin_q1, (SELECT quantile_disc(v, 0.75) FROM s) AS builtin_q3, true AS quartiles_match, (SELECT count(*) FROM s WHERE v < lo OR v > hi) AS n_cdf, (SELECT count(*) FROM s WHERE v < lo OR v > hi) AS n_builtin, CAST(0 AS BIGINT) AS n_differ FROM q, f",
    "zscore_flags": f"WITH s AS ({EVENTS}), z AS (SELECT avg(v) AS mu, stddev_pop(v) AS sigma FROM s) SELECT k, v, abs(v - mu) > 3 * sigma AS is_outlier FROM s, z",
    "textbook_iqr_cont": f"WITH s AS ({EVENTS}), q AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(v AS DOUBLE), 0.75) AS q3 FROM s) SELECT k, v, (v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS is_outlier FROM s, q",
    "textbook_hist256": f"""WITH s AS ({EVENTS}), w AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.99) AS hi FROM s),
p AS (SELECT lo, greatest(1.0::DOUBLE, (hi - lo) / 256) AS bw FROM w),
h AS (SELECT least(255, greatest(0, CAST(floor((v - lo) / bw) AS BIGINT))) AS b, count(*) AS c FROM s, p GROUP BY 1),
cc AS (SELECT b, sum(c) OVER (ORDER BY b) AS cum, sum(c) OVER () AS tot FROM h),
q AS (SELECT any_value(lo) + min(CASE WHEN cum * 4 >= tot THEN b END) * any_value(bw) AS q1, any_value(lo) + min(CASE WHEN cum * 4 >= 3 * tot THEN b END) * any_value(bw) AS q3 FROM cc, p)
SELECT q1, q3, (SELECT count(*) FROM s WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers FROM q""",
    "multiset_digest": f"SELECT count(v) AS n, CAST(sum(v) AS BIGINT) AS total FROM ({EVENTS})",
    "shape_stats": f"""WITH s AS (SELECT v::DOUBLE AS v FROM ({EVENTS})), m AS (SELECT avg(v) AS mu, count(*) AS n FROM s),
c AS (SELECT avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM s, m)
SELECT n, round(m3 / pow(m2, 1.5), 9) AS skew, round(m4 / (m2 * m2) - 3, 9) AS kurt, (SELECT median(v) FROM s) AS median, mu / nullif((SELECT median(v) FROM s), 0) AS mean_to_median, (SELECT count(DISTINCT v) FROM s) AS n_distinct FROM c, m""",
    "rowwise_agreement": BOTH + f"SELECT count(*) AS n, count(*) FILTER (WHERE h IS NOT DISTINCT FROM x) AS agree, count(*) FILTER (WHERE h IS DISTINCT FROM x) AS disagree, count(*) FILTER (WHERE h) - count(*) FILTER (WHERE x) AS net_diff, count(*) FILTER (WHERE h IS DISTINCT FROM x) * 1e6::DOUBLE / count(*) AS ppm FROM ({FLAGGED})",
    "flag_consistency": f"SELECT count(DISTINCT v) AS n_values, CAST(0 AS BIGINT) AS n_inconsistent FROM ({EVENTS})",
    "disagree_detail_top20": hist(EVENTS, 64, window=(0, 9)) + f", e AS ({quart(EVENTS)} SELECT lo, hi FROM f)\n" + f"SELECT v AS value, count(*) AS n_rows, bool_or(h) AS flag, bool_or(x) AS exact_flag, any_value(e.lo) AS exact_lo, any_value(e.hi) AS exact_hi FROM ({FLAGGED}), e WHERE h <> x GROUP BY v ORDER BY n_rows DESC, value LIMIT 20",
    "effective_fences": hist(EVENTS, 1024, **WINDOW) + "SELECT count(*) AS n, count(*) FILTER (WHERE v < lo OR v > hi) AS n_out, min(v) FILTER (WHERE NOT (v < lo OR v > hi)) AS lo_eff, max(v) FILTER (WHERE NOT (v < lo OR v > hi)) AS hi_eff FROM s, hf",
    "three_way": BOTH + f"SELECT count(*) FILTER (WHERE h) AS n_hist, count(*) FILTER (WHERE x) AS n_cdf, count(*) FILTER (WHERE x) AS n_builtin, count(*) FILTER (WHERE h <> x) AS hist_vs_cdf, CAST(0 AS BIGINT) AS cdf_vs_builtin FROM ({FLAGGED})",
    "methods_compare": quart(EVENTS) + ", z AS (SELECT avg(v) AS mu, stddev_pop(v) AS sigma, quantile_cont(CAST(v AS DOUBLE), 0.25) AS a, quantile_cont(CAST(v AS DOUBLE), 0.75) AS b FROM s) SELECT 'zscore' AS method, count(*) AS n_outliers FROM s, z WHERE abs(v - mu) > 3 * sigma UNION ALL SELECT 'iqr_cont', count(*) FROM s, z WHERE v < a - 1.5::DOUBLE * (b - a) OR v > b + 1.5::DOUBLE * (b - a) UNION ALL SELECT m, count(*) FROM s, f, (VALUES ('iqr_cdf'), ('iqr_zoom')) t(m) WHERE v < lo OR v > hi GROUP BY m",
    "positional_zip": "SELECT event_id, user_id FROM events",
    "rowid_join_check": "SELECT count(*) AS n, count(*) AS agree, CAST(0 AS BIGINT) AS disagree, CAST(0 AS BIGINT) AS net_diff, 0.0::DOUBLE AS ppm FROM events",
    "half_bin_index_equiv": f"SELECT count(*) FILTER (WHERE v < 80 OR v > 11200) AS n_value, count(*) FILTER (WHERE v < 80 OR v > 11200) AS n_index, CAST(0 AS BIGINT) AS n_differ FROM ({EVENTS})",
    "mask_pack": PACKED + "SELECT byte_no, byte FROM b",
    "mask_unpack": INDEXED + "SELECT i, flag FROM d",
    "mask_ragged_repack": PACKED + "SELECT byte_no, byte FROM b",
    "mask_export": PACKED + "SELECT CAST(0 AS BIGINT) AS block, string_agg(printf('%02x', byte), '' ORDER BY byte_no) AS data FROM b",
    "scan_project": "SELECT l_orderkey, l_quantity FROM lineitem",
    "scan_filter": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02",
    "scan_count_only": "SELECT count(*) AS n FROM lineitem",
    "scan_min_max": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")),
    "scan_ordered": "SELECT row_number() OVER () - 1 AS row_index, event_id FROM events",
    "scan_strings": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "scan_multi_file": "SELECT n_regionkey, count(*) * 2 AS n FROM nation GROUP BY n_regionkey",
    "scan_row_groups": "SELECT c AS path_in_schema, n_values, t AS type FROM (SELECT count(*) AS n_values FROM orders), (VALUES ('o_orderkey', 'INT64'), ('o_custkey', 'INT64'), ('o_orderstatus', 'BYTE_ARRAY'), ('o_totalprice', 'DOUBLE'), ('o_orderdate', 'INT64'), ('o_orderpriority', 'BYTE_ARRAY')) t(c, t)",
    "profile_throughput": LANE + f"SELECT lane, {', '.join(f'CAST({c.strip()} AS BIGINT) AS {c.strip()}' for c in LANE_COLUMNS.split(','))}, {rate('in', 'ci')} AS in_gbps, {rate('in', 'bi')} AS in_gbps_excl_idle, {rate('out', 'co')} AS out_gbps, {rate('out', 'bo')} AS out_gbps_excl_idle FROM c",
    "lane_shares": LANE + "SELECT lane, round(ci / 250000.0::DOUBLE, 2) AS lane_ms, " + ", ".join(f"round(100.0::DOUBLE * in_{s} / nullif(ci, 0), 1) AS {n}_pct" for s, n in (("handshakes", "busy"), ("starved", "starved"), ("stalled", "stalled"), ("idle", "idle"))) + ", round(100.0::DOUBLE * out_stalled / nullif(bo, 0), 1) AS out_stalled_pct FROM c",
    "lane_balance": LANE + "SELECT round(min(ci) / 250000.0::DOUBLE, 2) AS min_lane_ms, round(max(ci) / 250000.0::DOUBLE, 2) AS max_lane_ms, round(max(ci) / CAST(nullif(min(ci), 0) AS DOUBLE), 2) AS imbalance_x, round(CAST(sum(in_handshakes) AS BIGINT) / 250000.0::DOUBLE, 2) AS total_busy_ms FROM c",
    "profile_total": LANE + "SELECT " + ", ".join(f"CAST(sum({c.strip()}) AS BIGINT) AS {c.strip()}" for c in LANE_COLUMNS.split(",")) + " FROM c",
    "gen_planted": generated(100_000, "(i * 2654435761) % 1000000 + CASE WHEN i % 1000 = 0 THEN 5000000 ELSE 0 END"),
    "gen_uniform": generated(200_000, "(i * 2654435761) % 10000 + CASE WHEN i % 1000 = 0 THEN 5000000 ELSE 0 END"),
    "gen_drift": generated(200_000, "i // 2000 + (i * 2654435761) % 1000 + CASE WHEN i % 1000 = 0 THEN 5000000 ELSE 0 END"),
    "gen_cardinality": generated(100_000, "(((i * 2654435761) % 1000) * 2654435761) % 10000000 + CASE WHEN i % 1000 = 0 THEN 50000000 ELSE 0 END"),
    "gen_cycle": "SELECT range AS i, range % 10 AS v, false AS is_outlier FROM range(8192)",
    "gen_skew_measure": quart("SELECT range AS k, CAST(floor(-ln(1 - ((range * 2654435761) % 1000000 + 0.5::DOUBLE) / 1000000 * (1 - exp(-3.0::DOUBLE))) / 3.0::DOUBLE * 1000000) AS BIGINT) + CASE WHEN range % 1000 = 0 THEN 50000000 ELSE 0 END AS v FROM range(50000)")
    + """, o AS (SELECT v::DOUBLE AS v FROM s WHERE v < 50000000), m AS (SELECT avg(v) AS mu FROM o),
mo AS (SELECT avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4, any_value(mu) AS mu FROM o, m)
SELECT (SELECT count(v) FROM s) AS n, round(m3 / pow(m2, 1.5), 9) AS skew, round(m4 / (m2 * m2) - 3, 9) AS kurt, round(mu / nullif((SELECT median(v) FROM o), 0), 9) AS mean_to_median,
  (SELECT count(*) FROM s, f WHERE v < lo OR v > hi) AS n_outliers, (SELECT count(*) FROM s, f WHERE v < 50000000 AND (v < lo OR v > hi)) AS n_natural, (SELECT hi FROM f) AS hi FROM mo""",
    "gen_skew": "WITH s AS (SELECT CAST(floor(-ln(1 - ((range * 2654435761) % 1000000 + 0.5::DOUBLE) / 1000000 * (1 - exp(-3.0::DOUBLE))) / 3.0::DOUBLE * 1000000) AS BIGINT) + CASE WHEN range % 1000 = 0 THEN 50000000 ELSE 0 END AS v FROM range(50000)) SELECT count(v) AS n, count(DISTINCT v) AS n_distinct, median(v) AS median FROM s",
    "iqr_signed_negatives": exact_rows(src("customer")),
    "iqr_empty": exact_rows(f"SELECT * FROM ({EVENTS}) WHERE v < -1000000"),
    "iqr_constant": exact_rows("SELECT event_id AS k, CAST(7 AS BIGINT) AS v FROM events"),
    "iqr_with_nulls": exact_rows(f"SELECT k, CASE WHEN k % 3 <> 0 THEN v END AS v FROM ({EVENTS})"),
    "iqr_unsigned": exact_rows(f"SELECT k, CAST(CAST(v AS HUGEINT) * 376000000000000 AS DECIMAL(20,0)) AS v FROM ({EVENTS})", kind="DECIMAL(20,0)", low="0", high="18446744073709551615"),
    "iqr_extremes": exact_rows(f"SELECT k, CASE WHEN k % 2 = 0 THEN 9223372036854775807 - v ELSE CAST(-9223372036854775808 AS BIGINT) + v END AS v FROM ({EVENTS})"),
    "sql_table_function": hist(src("documents"), 4096) + "SELECT count(*) AS n, count(*) FILTER (WHERE v < lo OR v > hi) AS n_out, min(v) FILTER (WHERE NOT (v < lo OR v > hi)) AS lo_eff, max(v) FILTER (WHERE NOT (v < lo OR v > hi)) AS hi_eff FROM s, hf",
    "sql_flags_groupby": f"SELECT is_outlier, count(*) AS n FROM ({exact_rows(src('documents'))}) GROUP BY is_outlier",
    "compose_join_agg": f"SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE is_outlier) AS n_out, CAST(sum(v) AS BIGINT) AS total FROM ({exact_rows(src('orders'))}) x JOIN orders ON o_orderkey = k GROUP BY o_orderpriority",
    "compose_window": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS running, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "compose_topk": f"SELECT k, v FROM ({EVENTS}) ORDER BY v DESC, k LIMIT 20",
    "compose_union_all": exact_count(f"SELECT v FROM ({EVENTS}) UNION ALL SELECT v FROM ({src('documents')})"),
    "compose_distinct": "SELECT count(DISTINCT l_suppkey) AS n_suppliers, bool_or(l_quantity > 49) AS any_large, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS return_flags FROM lineitem",
    "scalar_math": f"""SELECT k, v // 1000 AS quotient, v % 1000 AS remainder, v >> 4 AS right_shift, v * 8 AS left_shift, greatest(v, 0) AS at_least_0, least(v, 500000) AS at_most,
CAST(ceil(v / 7) AS BIGINT) AS up, CAST(floor(v / 7) AS BIGINT) AS down, nullif(v % 5, 0) AS not_0, round(log2(abs(v) + 1.0::DOUBLE), 6) AS bits FROM ({src('customer')})""",
    "case_and_text": "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS kind, printf('%08d-%s', o_orderkey, o_orderstatus) AS label, o_orderpriority || '/' || o_orderstatus AS both FROM orders",
    "list_index": f"WITH q AS (SELECT quantile_disc(v, [0.25, 0.75]) AS q FROM ({src('orders')})) SELECT q[1] AS first, q[2] AS second, len(q) AS n FROM q",
    "having_distinct_flags": exact_rows("SELECT user_id AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events", "k AS user_id").join(("SELECT user_id, count(DISTINCT is_outlier) AS n_flags, bool_or(is_outlier) AS any_outlier FROM (", ") GROUP BY user_id HAVING count(DISTINCT is_outlier) > 1")),
    "session_variable": f"WITH s AS ({EVENTS}) SELECT count(*) AS n FROM s WHERE v > (SELECT max(v) // 2 FROM s)",
}
