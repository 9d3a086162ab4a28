"""Shared pieces of the DuckDB counterparts: the domain tables and intermediate results as common table expressions."""

from __future__ import annotations

import re

from ridgeline.sources.adapters import FEE_ROWS

SHIFT = "CAST(epoch((to_timestamp({t}) AT TIME ZONE 'America/New_York' - to_days({k})) AT TIME ZONE 'America/New_York') AS BIGINT)"
DAY_START = "CAST(epoch(date_trunc('day', to_timestamp({t}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AS BIGINT)"
BAND = (
    "concat(greatest(1, least(10, CAST(ceil(round({p} * 10, 7)) AS INTEGER))) * 10 - 9, '-', "
    "CASE WHEN ceil(round({p} * 10, 7)) >= 10 THEN 99 ELSE greatest(1, CAST(ceil(round({p} * 10, 7)) AS INTEGER)) * 10 END, 'c')"
)
FEE = (
    "CASE {f} WHEN 'quadratic' THEN ceil({r} * {c} * {p} * (1 - {p}) * 100 - 1e-9) / 100 "
    "WHEN 'flat_per_contract' THEN ceil({r} * {c} * 100 - 1e-9) / 100 WHEN 'none' THEN 0.0 END"
)
UTC_DAY = "CAST(make_timestamp({t} * 1000000) AS DATE)"
MONTH = "strftime(make_timestamp({t} * 1000000), '%Y-%m')"
ORDINAL = "CAST(year(make_timestamp({t} * 1000000)) * 12 + month(make_timestamp({t} * 1000000)) - 1 AS INTEGER)"


def fee_values() -> str:
    rows = []
    for n, day, role, form, rate, kind, values in FEE_ROWS:
        listed = "CAST(NULL AS VARCHAR[])" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"
        rows.append(f"({n}, DATE '{day}', '{role}', '{form}', CAST({rate} AS DOUBLE), '{kind}', {listed})")
    return ", ".join(rows)


LOOKUP = """
  SELECT a.*, f.form, f.rate, f.scope_kind FROM {asked} a LEFT JOIN (
    SELECT k.role, k.as_of, k.ticker, k.series_ticker, r.form, r.rate, r.scope_kind
    FROM (SELECT DISTINCT role, as_of, ticker, series_ticker FROM {asked}) k JOIN fee_rows r
      ON k.role = r.role AND k.as_of >= r.effective_from AND (r.until IS NULL OR k.as_of < r.until)
      AND (r.scope_kind = 'all' OR (r.scope_kind = 'series' AND k.series_ticker = r.v) OR (r.scope_kind = 'ticker_prefix' AND starts_with(k.ticker, r.v)))
    QUALIFY row_number() OVER (PARTITION BY k.role, k.as_of, k.ticker, k.series_ticker
      ORDER BY CASE r.scope_kind WHEN 'series' THEN 1 WHEN 'ticker_prefix' THEN 2 ELSE 3 END, r.ord) = 1) f
  ON a.role = f.role AND a.as_of = f.as_of AND a.ticker IS NOT DISTINCT FROM f.ticker AND a.series_ticker IS NOT DISTINCT FROM f.series_ticker"""

CTES: dict[str, str] = {
    "raw_fills": """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS trade_id,
    concat('P', l_partkey) AS ticker, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 99 + 1 AS INTEGER) AS cents,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 99 + 1 AS DOUBLE) / 100 AS price, l_quantity AS count_fp,
    CASE WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'R' THEN 'no' WHEN l_linestatus = 'O' THEN 'yes' END AS taker_side,
    CASE WHEN l_linestatus = 'O' THEN 'live' ELSE 'historical' END AS source,
    CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS t, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem""",
    "fills": "SELECT DISTINCT * FROM raw_fills",
    "event_fills": """
  SELECT CAST(event_id AS VARCHAR) AS trade_id, concat('U', user_id) AS ticker,
    CAST(abs(CAST(round(value * 100) AS BIGINT)) % 99 + 1 AS DOUBLE) / 100 AS price, CAST(1 AS DOUBLE) AS count_fp,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'yes' ELSE 'no' END AS taker_side, epoch_us(ts) AS t FROM events""",
    "markets": """
  SELECT concat('P', k) AS ticker, k AS key, concat('E', g) AS event_ticker, concat('S', g % 25) AS series_ticker, concat('C', g % 25 % 6) AS category,
    r AS result, c AS close_t, CAST(c - p_size * 28800 AS BIGINT) AS open_t, CAST((k * 613) % 5000 AS DOUBLE) AS volume_fp,
    CASE WHEN r IS NOT NULL THEN CAST(((r = 'yes') != (k % 97 = 0)) AS DOUBLE) END AS settlement_value,
    c < 915148800 AS in_r1_window, c >= 915148800 AS in_r2_window, k % 53 <> 0 AS tape_done
  FROM (SELECT p_partkey AS k, p_size, p_partkey // 4 AS g, CAST(852076800 + (p_partkey * 37 % 1500) * 86400 + 72000 AS BIGINT) AS c,
    CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN (p_partkey * 7919) % 100 < 2 * p_size THEN 'yes' ELSE 'no' END AS r FROM part)""",
    "quotes": """
  SELECT concat('P', p_partkey) AS ticker, CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE CAST((p_partkey * 31) % 26 AS DOUBLE) / 100 END AS spread,
    CASE WHEN p_partkey % 2 = 0 THEN 'live' ELSE 'historical' END AS quote_source FROM part WHERE p_partkey % 29 <> 0""",
    "quoted": "SELECT m.*, q.ticker IS NOT NULL AS attempted, q.spread FROM markets m LEFT JOIN quotes q USING (ticker)",
    "reasons": """
  SELECT *, list_filter([CASE WHEN volume_fp IS NULL OR volume_fp < 1000 THEN 'volume_below_1000' END,
    CASE WHEN NOT attempted THEN 'spread_filter_not_yet_fetched' WHEN spread IS NULL THEN 'spread_filter_not_computable' WHEN spread > 0.20 THEN 'spread_above_20c' END,
    CASE WHEN open_t IS NULL OR close_t IS NULL THEN 'missing_open_or_close_time' WHEN close_t - open_t < 86400 THEN 'open_below_24h' END,
    CASE WHEN result IS NULL OR result NOT IN ('yes', 'no') THEN 'result_missing_or_invalid'
      WHEN settlement_value IS NOT NULL AND (result = 'yes') != (settlement_value >= 0.5) THEN 'settlement_contradicts_result' END], lambda x: x IS NOT NULL) AS reasons
  FROM quoted""",
    "passed": "SELECT * FROM reasons WHERE len(reasons) = 0",
    "scope_markets": "SELECT m.* FROM markets m JOIN (SELECT ticker FROM passed) p USING (ticker)",
    "ticks": "SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id) = 1",
    "day0": """
  SELECT m.ticker, 0 AS lookback_day, m.close_t AS ref_t, k.t, k.price, k.count_fp, k.taker_side, k.trade_id
  FROM (SELECT * FROM scope_markets WHERE result IN ('yes', 'no')) m ASOF JOIN ticks k ON m.ticker = k.ticker AND m.close_t >= k.t""",
    "back_refs": f"SELECT ticker, CAST(k AS INTEGER) AS lookback_day, {SHIFT.format(t='t', k='CAST(k AS INTEGER)')} AS ref_t FROM day0, range(1, 11) r(k)",
    "prices": """
  SELECT * FROM day0 UNION ALL
  SELECT r.ticker, r.lookback_day, r.ref_t, k.t, k.price, k.count_fp, k.taker_side, k.trade_id FROM back_refs r ASOF JOIN ticks k ON r.ticker = k.ticker AND r.ref_t >= k.t""",
    "panel": """
  SELECT ticker, event_ticker, series_ticker, lookback_day, category, close_t, 'yes' AS side, CASE WHEN result = 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
    price AS p, count_fp, taker_side, in_r1_window, in_r2_window FROM prices JOIN markets USING (ticker) WHERE price > 0 AND price < 1""",
    "doubled": "SELECT * FROM panel UNION ALL SELECT * REPLACE ('no' AS side, 1 - y AS y, 1 - p AS p) FROM panel",
    "fee": f"SELECT * FROM (VALUES {fee_values()}) v(ord, effective_from, role, form, rate, scope_kind, scope_values)",
    "generation": "SELECT *, lead(effective_from) OVER (PARTITION BY role, scope_kind ORDER BY effective_from) AS until FROM (SELECT DISTINCT role, scope_kind, effective_from FROM fee)",
    "fee_rows": """
  SELECT f.ord, f.role, f.form, f.rate, f.scope_kind, f.effective_from, g.until, unnest(coalesce(f.scope_values, [NULL])) AS v
  FROM fee f JOIN generation g USING (role, scope_kind, effective_from)""",
    "listed": f"""
  SELECT CAST({ORDINAL.format(t='close_t')} + 100 AS INTEGER) AS ord, CAST(date_trunc('month', {UTC_DAY.format(t='close_t')}) AS DATE) AS effective_from, 'maker' AS role, 'quadratic' AS form,
    CAST(0.01 AS DOUBLE) + {ORDINAL.format(t='close_t')} % 4 * CAST(0.0025 AS DOUBLE) AS rate, 'series' AS scope_kind, list_sort(list(DISTINCT series_ticker)) AS scope_values FROM markets WHERE volume_fp >= 2500 GROUP BY 1, 2, 5
  UNION ALL SELECT CAST({ORDINAL.format(t='close_t')} // 3 + 100000 AS INTEGER) AS ord, CAST(date_trunc('quarter', {UTC_DAY.format(t='close_t')}) AS DATE) AS effective_from, 'taker', 'quadratic', CAST(0.035 AS DOUBLE), 'ticker_prefix', list_sort(list(DISTINCT left(ticker, 3))) FROM markets WHERE volume_fp >= 4000 GROUP BY 1, 2
  UNION ALL SELECT ord, effective_from, role, form, rate, scope_kind, scope_values FROM fee WHERE ord = 2""",
    "listed_rows": """
  SELECT f.ord, f.role, f.form, f.rate, f.scope_kind, f.effective_from, g.until, unnest(coalesce(f.scope_values, [NULL])) AS v
  FROM listed f JOIN (SELECT *, lead(effective_from) OVER (PARTITION BY role, scope_kind ORDER BY effective_from) AS until FROM (SELECT DISTINCT role, scope_kind, effective_from FROM listed)) g USING (role, scope_kind, effective_from)""",
    "panel_asked": f"SELECT *, 'taker' AS role, {UTC_DAY.format(t='close_t')} AS as_of FROM panel",
    "panel_fee": f"SELECT *, CASE WHEN count_fp > 0 THEN {FEE.format(f='form', r='rate', c='count_fp', p='p')} END AS fee FROM ({LOOKUP.format(asked='panel_asked')})",
    "doubled_asked": f"""
  SELECT *, 'taker' AS role, {UTC_DAY.format(t='close_t')} AS as_of, CASE WHEN side = taker_side THEN 'taker' ELSE 'maker' END AS who
  FROM doubled WHERE taker_side IN ('yes', 'no') AND p > 0 AND p < 1""",
    "doubled_fee": f"SELECT *, CASE WHEN count_fp > 0 THEN {FEE.format(f='form', r='rate', c='count_fp', p='p')} END AS fee FROM ({LOOKUP.format(asked='doubled_asked')})",
    "sides": f"""
  SELECT ticker, series_ticker, count_fp, traded, s.p AS p, s.y AS y, s.role AS role FROM (
    SELECT f.ticker, m.series_ticker, f.count_fp, {UTC_DAY.format(t='f.t')} AS traded, unnest([
      {{'p': f.price, 'y': CASE WHEN m.result = 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'role': CASE WHEN f.taker_side = 'yes' THEN 'taker' ELSE 'maker' END}},
      {{'p': 1 - f.price, 'y': CASE WHEN m.result = 'yes' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 'role': CASE WHEN f.taker_side = 'no' THEN 'taker' ELSE 'maker' END}}]) AS s
    FROM fills f JOIN scope_markets m USING (ticker)
    WHERE m.result IN ('yes', 'no') AND f.taker_side IN ('yes', 'no') AND f.price > 0 AND f.price < 1 AND f.count_fp > 0) WHERE s.p >= 0.5""",
    "sides_b_asked": "SELECT *, traded AS as_of FROM sides",
    "sides_c_asked": "SELECT *, DATE '1999-06-01' AS as_of FROM sides",
    "sides_b": LOOKUP.format(asked="sides_b_asked"),
    "sides_c": LOOKUP.format(asked="sides_c_asked"),
    "rows_": "SELECT *, coalesce(nullif(event_ticker, ''), ticker) AS cluster, p * 100 AS x, (y - p) * 100 AS u FROM panel",
    "treat_asked": f"SELECT DISTINCT 'maker' AS role, {UTC_DAY.format(t='close_t')} AS as_of, CAST(NULL AS VARCHAR) AS ticker, series_ticker FROM panel",
    "charged": f"SELECT series_ticker, as_of, CASE WHEN form <> 'none' AND rate <> 0 THEN 1 ELSE 0 END AS c FROM ({LOOKUP.format(asked='treat_asked')})",
    "flagged": f"""
  SELECT r.*, {ORDINAL.format(t='close_t')} AS month, coalesce(c.c, 0) AS now, max(coalesce(c.c, 0)) OVER (PARTITION BY r.series_ticker) AS ever
  FROM rows_ r LEFT JOIN charged c ON r.series_ticker = c.series_ticker AND {UTC_DAY.format(t='r.close_t')} = c.as_of""",
    "control_markets": """
  SELECT CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
    CAST(852076800 + (c_custkey * 53 % 900) * 86400 AS BIGINT) AS close_t, lower(concat_ws('-', c_mktsegment, c_name)) AS slug, abs(c_acctbal) AS volume FROM customer""",
    "control_trades": """
  SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 101 AS DOUBLE) / 100 AS price,
    CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS t, o_orderkey AS trade_no FROM orders""",
    "control_panel": r"""
  SELECT m.ticker, m.close_t, m.y, k.price AS p, m.volume, CASE WHEN regexp_matches(w, '\b(automobile|autos?|automobiles)\b') THEN 'transport'
    WHEN regexp_matches(w, '\b(furniture|household)\b') THEN 'home' WHEN regexp_matches(w, '\b(machinery|tools?)\b') THEN 'industry' END AS category
  FROM (SELECT *, slug || ' ' || replace(slug, '-', ' ') AS w FROM control_markets WHERE y IS NOT NULL AND close_t BETWEEN 852076800 AND 915148800) m
  JOIN (SELECT t.ticker, t.price FROM control_trades t JOIN control_markets c ON t.ticker = c.ticker AND t.t <= c.close_t
    QUALIFY row_number() OVER (PARTITION BY t.ticker ORDER BY t.t DESC, t.price DESC) = 1) k ON m.ticker = k.ticker WHERE k.price > 0 AND k.price < 1""",
}


def mz_sql(rows: str, by: str) -> str:
    """A clustered line for each group of rows (columns by, cluster, x, u)."""
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    grp = f"GROUP BY {by}" if by else ""
    return f"""
  SELECT {g}CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS n_clusters, round(a, 6) AS alpha, round(sqrt(greatest(0, c * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det))), 6) AS alpha_se,
    round(b, 6) AS psi, round(sqrt(greatest(0, c * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (det * det))), 6) AS psi_se
  FROM (SELECT *, g / (g - 1) * (n - 1) / (n - 2) AS c FROM (
    SELECT {g}count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM (
      SELECT {g}cluster, sum(u - a - b * x) AS s0, sum((u - a - b * x) * x) AS s1 FROM ({rows}) JOIN ({moments_sql(rows, by)}) {on} GROUP BY {g}cluster) {grp})
    JOIN ({moments_sql(rows, by)}) {on} WHERE n > 2 AND g > 1)"""


def moments_sql(rows: str, by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT *, (su - b * sx) / n AS a FROM (SELECT *, CASE WHEN hi > lo THEN (n * sxu - sx * su) / det END AS b FROM (
      SELECT {g}count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(u) AS su, sum(x * u) AS sxu, min(x) AS lo, max(x) AS hi, count(*) * sum(x * x) - sum(x) * sum(x) AS det
      FROM ({rows}) {f'GROUP BY {by}' if by else ''})) WHERE b IS NOT NULL"""


def signed_spread_sql(per: str, by: str, names: list[str], reps: int = 999, seed: int = 0) -> str:
    """Spread of sums over clusters of random signs, bits of digests, times each cluster's numbers; per: by, cluster, names."""
    sums = ", ".join(f"sum(CASE WHEN (bits >> k) & 1 = 0 THEN {z} ELSE -{z} END) AS {z}" for z in names)
    out = ", ".join(f"stddev_samp({z}) AS {z}_se, (quantile_cont({z}, 0.975) - quantile_cont({z}, 0.025)) / 2 AS {z}_half" for z in names)
    return f"""SELECT {by}, {out} FROM (
    SELECT {by}, w * 32 + k AS rep, {sums} FROM (SELECT *, ('0x' || substr(md5(concat_ws(':', {seed}, w // 4, cluster)), CAST(w % 4 * 8 + 1 AS INTEGER), 8))::BIGINT AS bits FROM ({per}), range({-(-reps // 32)}) words(w)), range(32) r(k)
    GROUP BY ALL HAVING rep < {reps}) GROUP BY {by}"""


def wild_shifts_sql(rows: str, by: str, digits: int = 6, below: int = 50) -> str:
    """Slope shifts between three regimes with intervals; from signed replicates, the shift's null imposed, below so many clusters. rows: by, regime, cluster, x, u."""
    of = ", ".join(f"max(b) FILTER (WHERE regime = '{k}') AS {k}" for k in ("pre", "mid", "post"))
    on = f"USING ({by})"

    def common(k: str, j: str, name: str) -> str:
        mine = f"FILTER (WHERE regime IN ('{k}', '{j}'))"
        return f"sum(b * det / n) {mine} / sum(det / n) {mine} AS {name}"

    def pull(slope: str) -> str:
        """Influence of a row on its regime's slope, with residuals from the line of that slope through the regime's means."""
        return f"(n * x - sx) * (u - (su - {slope} * sx) / n - {slope} * x) / det"

    own = ", ".join(f"sum(CASE WHEN regime = '{k}' THEN {pull('b')} ELSE 0 END) AS {k}" for k in ("pre", "mid", "post"))
    nulls = ", ".join(f"sum(CASE regime WHEN '{j}' THEN {pull(s)} WHEN '{k}' THEN -({pull(s)}) ELSE 0 END) AS z_{n}" for n, k, j, s in (("fee", "pre", "mid", "null_fee"), ("pub", "mid", "post", "null_pub")))
    cells, columns = moments_sql(rows, f"{by}, regime"), []
    for n in ("fee", "pub"):
        half = f"CASE WHEN g < {below} THEN z_{n}_half ELSE 1.96 * se_{n} END"
        columns += [f"round(d_{n}, {digits}) AS delta_{n}", f"round(CASE WHEN g < {below} THEN z_{n}_se ELSE se_{n} END, {digits}) AS delta_{n}_se", f"round(d_{n} - {half}, {digits}) AS delta_{n}_lo", f"round(d_{n} + {half}, {digits}) AS delta_{n}_hi"]
    return f"""WITH cells AS ({cells}), lines AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS all_n, count(*) AS k, max(a) FILTER (WHERE regime = 'pre') AS alpha_c, {of}, {common('pre', 'mid', 'null_fee')}, {common('mid', 'post', 'null_pub')} FROM cells GROUP BY {by}),
  per AS (SELECT {by}, cluster, {own}, {nulls} FROM ({rows}) JOIN cells USING ({by}, regime) JOIN (SELECT {by}, null_fee, null_pub FROM lines) {on} GROUP BY {by}, cluster),
  meat AS (SELECT {by}, count(*) AS g, sum((mid - pre) ** 2) AS vf, sum((post - mid) ** 2) AS vp FROM per GROUP BY {by}),
  fit AS (SELECT l.*, g, mid - pre AS d_fee, post - mid AS d_pub, sqrt(g / (g - 1) * (all_n - 1) / (all_n - 6) * vf) AS se_fee, sqrt(g / (g - 1) * (all_n - 1) / (all_n - 6) * vp) AS se_pub FROM lines l JOIN meat {on} WHERE k = 3 AND all_n > 6 AND g > 1),
  drawn AS ({signed_spread_sql(f"SELECT * FROM per SEMI JOIN (SELECT * FROM fit WHERE g < {below}) {on}", by, ["z_fee", "z_pub"])})
  SELECT {by}, all_n AS n, g AS n_clusters, round(alpha_c, {digits}) AS alpha_c, round(pre, {digits}) AS psi_c, {', '.join(columns)}, g < {below} AS used_wild FROM fit LEFT JOIN drawn {on}"""


def did_sql(rows: str, fit: str) -> str:
    """A difference-in-differences fit by orthogonal regressors: months first, then ever and its slope (not with clean controls), now, and now's slope.

    rows: cluster, month, ever, now, x, u. One row, with nulls unless every month's prices differ and no regressor is explained by those before it.
    """
    before = [] if fit == "clean_controls" else ["ever", "ever * x"]
    regressors = [*before, "now", "now * x"]
    k = len(regressors)
    # within a month, each regressor and the outcome less their line in x
    def free(v: str) -> str:
        slope = f"((mn * sum(x * {v}) OVER m - mx * sum({v}) OVER m) / md)"
        return f"({v} - (sum({v}) OVER m - {slope} * mx) / mn - {slope} * x)"

    steps = [
        f"r AS (SELECT *, count(*) OVER m AS mn, sum(x) OVER m AS mx, count(*) OVER m * sum(x * x) OVER m - sum(x) OVER m * sum(x) OVER m AS md, max(x) OVER m > min(x) OVER m AS spread FROM ({rows}) WINDOW m AS (PARTITION BY month))",
        f"q0 AS (SELECT cluster, month, now, ever, x, spread, {', '.join(f'{free(f'({v})')} AS v{j}' for j, v in enumerate(regressors))}, {free('u')} AS e0, ({', '.join(f'[(mn * sum(x * ({v})) OVER m - mx * sum({v}) OVER m) / md]' for v in [*regressors, 'u'])}) AS slopes FROM r WHERE spread WINDOW m AS (PARTITION BY month))",
    ]
    # v_j keeps what the regressors before it don't explain; s_j_i is what v_i explains of v_j, and c_j the outcome's coefficient
    for j in range(k):
        later = ", ".join(f"v{i} - v{j} * s{i}_{j} AS v{i}" for i in range(j + 1, k))
        shares = ", ".join(f"sum(v{i} * v{j}) OVER () / nullif(sum(v{j} * v{j}) OVER (), 0) AS s{i}_{j}" for i in range(j + 1, k))
        steps.append(f"p{j} AS (SELECT *, sum(v{j} * e{j}) OVER () / nullif(sum(v{j} * v{j}) OVER (), 0) AS c{j}, sum(v{j} * v{j}) OVER () AS d{j}{', ' + shares if shares else ''} FROM q{j})")
        steps.append(f"q{j + 1} AS (SELECT * {f'REPLACE ({later})' if later else ''}, e{j} - v{j} * c{j} AS e{j + 1} FROM p{j})")
    last = k - 1
    beta = {last: f"c{last}"}
    for j in range(last - 1, -1, -1):
        beta[j] = "(" + f"c{j}" + "".join(f" - s{i}_{j} * {beta[i]}" for i in range(j + 1, k)) + ")"
    slope = lambda j: f"slopes[{j + 1}][1]"
    untreated = f"{slope(k)}" + "".join(f" - {beta[j]} * {slope(j)}" for j in range(k))
    per = f"SELECT cluster, sum(v{last} * e{k}) / any_value(d{last}) AS z, sum(v{last} * e{last}) / any_value(d{last}) AS z_null FROM q{k} GROUP BY cluster"
    ever = beta[1] if before else "CAST(NULL AS DOUBLE)"
    return f"""WITH {', '.join(steps)}, per AS ({per}),
  facts AS (SELECT count(*) AS n, count(DISTINCT month) AS months, count(*) FILTER (WHERE now = 1) AS n_treated, count(*) FILTER (WHERE now = 0) AS n_control, bool_and(spread) AS spread FROM r),
  one AS (SELECT {beta[last]} AS delta, {beta[last - 1]} AS alpha, {ever} AS ever, {untreated} AS base, {' AND '.join(f'd{j} > 1e-6' for j in range(k))} AS good FROM q{k} ORDER BY month LIMIT 1),
  meat AS (SELECT count(*) AS g, sum(z * z) AS v FROM per), drawn AS (SELECT z_null_se AS se, z_null_half AS half FROM ({signed_spread_sql('SELECT *, 0 AS one_ FROM per', 'one_', ['z_null'])})),
  found AS (SELECT *, sqrt(g / (g - 1) * (n - 1) / (n - 2 * months - {k}) * v) AS plain, g < 50 AS wild FROM facts, one, meat, drawn WHERE spread AND good AND months > 1 AND g > 1 AND n_treated > 0 AND n_control > 0 AND n > 2 * months + {k})
  SELECT '{fit}' AS fit, delta AS delta_did, CASE WHEN wild THEN se ELSE plain END AS delta_did_se, delta - CASE WHEN wild THEN half ELSE 1.96 * plain END AS ci_lo, delta + CASE WHEN wild THEN half ELSE 1.96 * plain END AS ci_hi,
    alpha AS alpha_did, base AS psi_untreated, ever AS delta_ever, n, g AS n_clusters, n_treated, n_control, CAST(months AS INTEGER) AS months, wild AS used_wild FROM (SELECT 1) LEFT JOIN found ON TRUE"""


def event_moments_sql(rows: str) -> str:
    """Moments of the event study's groups less the months' lines, from rows: month, ever, k (event time), x, u."""
    return f"""WITH r AS ({rows}), months AS (SELECT month, count(*) AS n, sum(x) AS sx, count(*) * sum(x * x) - sum(x) * sum(x) AS det FROM r GROUP BY month HAVING max(x) > min(x)),
  member AS (SELECT month, x, u, unnest(list_filter([CASE WHEN ever = 1 THEN 0 END, CASE WHEN k <> -1 THEN k + 7 - CAST(k > -1 AS INTEGER) END], lambda g: g IS NOT NULL)) AS i FROM r),
  part AS (SELECT month, x, u, i, p, CASE p WHEN 0 THEN 1.0::DOUBLE ELSE x END AS v FROM member, range(2) parts(p)),
  slopes AS (SELECT month, j, q, (n * sxv - sx * sv) / det AS slope, (sv - (n * sxv - sx * sv) / det * sx) / n AS level FROM (SELECT month, i AS j, p AS q, sum(v) AS sv, sum(x * v) AS sxv FROM part GROUP BY ALL) JOIN months USING (month)),
  lines AS (SELECT month, (n * sxu - sx * su) / det AS slope, (su - (n * sxu - sx * su) / det * sx) / n AS level FROM (SELECT month, sum(u) AS su, sum(x * u) AS sxu FROM r GROUP BY month) JOIN months USING (month)),
  raw AS (SELECT a.i, b.i AS j, sum(1.0::DOUBLE) AS t00, sum(a.x) AS t01, sum(a.x * a.x) AS t11 FROM (SELECT *, row_number() OVER () AS id FROM r) s, LATERAL (SELECT unnest(list_filter([CASE WHEN s.ever = 1 THEN 0 END, CASE WHEN s.k <> -1 THEN s.k + 7 - CAST(s.k > -1 AS INTEGER) END], lambda g: g IS NOT NULL)) AS i, s.x AS x) a,
    LATERAL (SELECT unnest(list_filter([CASE WHEN s.ever = 1 THEN 0 END, CASE WHEN s.k <> -1 THEN s.k + 7 - CAST(s.k > -1 AS INTEGER) END], lambda g: g IS NOT NULL)) AS i) b GROUP BY ALL),
  gone AS (SELECT i, j, sum(v * (level + slope * x)) FILTER (WHERE p = 0 AND q = 0) AS g00, sum(v * (level + slope * x)) FILTER (WHERE p = 0 AND q = 1) AS g01, sum(v * (level + slope * x)) FILTER (WHERE p = 1 AND q = 0) AS g10, sum(v * (level + slope * x)) FILTER (WHERE p = 1 AND q = 1) AS g11 FROM part JOIN slopes USING (month) GROUP BY i, j)
  SELECT i, j, round(coalesce(t00, 0) - g00, 3) AS s00, round(coalesce(t01, 0) - g01, 3) AS s01, round(coalesce(t01, 0) - g10, 3) AS s10, round(coalesce(t11, 0) - g11, 3) AS s11 FROM gone LEFT JOIN raw USING (i, j)
  UNION ALL SELECT i, -1, round(sum(v * (u - level - slope * x)) FILTER (WHERE p = 0), 3), NULL, round(sum(v * (u - level - slope * x)) FILTER (WHERE p = 1), 3), NULL FROM part JOIN lines USING (month) GROUP BY i"""


def sql(body: str) -> str:
    """The body with the table expressions that it needs, directly or through others, in order."""
    names = sorted(CTES, key=len, reverse=True)
    word = re.compile(r"\b(" + "|".join(names) + r")\b")
    need: set[str] = set()
    todo = {m for m in word.findall(body)}
    while todo:
        need |= todo
        todo = {m for n in todo for m in word.findall(CTES[n])} - need
    used = [n for n in CTES if n in need]
    if used and body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return (("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in used) + " ") if used else "") + body
