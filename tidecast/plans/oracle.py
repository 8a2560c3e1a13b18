"""What each registered query must return, said again in plain SQL on the same tables."""

from __future__ import annotations

from tidecast import fixed

_SQL: dict[str, str] = {}


def all_sql() -> dict[str, str]:
    return dict(_SQL)


# --- building blocks ---------------------------------------------------------------------

OC = """oc AS (
  SELECT o.*, c.*, CAST(o.o_orderdate AS DATE) AS day, o.o_orderpriority AS source
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

DAILY = """daily AS (
  SELECT l_linestatus AS source, l_returnflag AS entity, CAST(l_shipdate AS DATE) AS day,
    SUM(l_extendedprice) AS cost, SUM(l_quantity) AS clicks,
    CAST(SUM(l_partkey) AS DOUBLE) AS impr, AVG(l_discount + 0.0) AS discount,
    SUM(l_discount * l_extendedprice) AS discount_cost, COUNT(*) AS n
  FROM lineitem GROUP BY ALL),
spans AS (SELECT source, MIN(day) AS lo, MAX(day) AS hi FROM daily GROUP BY source),
spine AS (
  SELECT e.source, e.entity, CAST(g.d AS DATE) AS day
  FROM (SELECT DISTINCT source, entity FROM daily) e JOIN spans s USING (source),
    LATERAL (SELECT UNNEST(generate_series(s.lo, s.hi, INTERVAL 1 DAY)) AS d) g),
dense AS (
  SELECT p.source, p.entity, p.day, COALESCE(cost, 0.0) AS cost, COALESCE(clicks, 0.0) AS clicks,
    COALESCE(impr, 0.0) AS impr, discount, COALESCE(discount_cost, 0.0) AS discount_cost,
    COALESCE(n, 0) AS n
  FROM spine p LEFT JOIN daily d USING (source, entity, day))"""

PANEL = DAILY + f""",
wide AS (
  SELECT source, entity, day, cost, clicks,
    CASE WHEN cost = 0 THEN 0.0 ELSE discount_cost / cost END AS rate FROM dense
  UNION ALL
  SELECT source, '{fixed.ACCOUNT}', day, SUM(cost), SUM(clicks),
    CASE WHEN SUM(cost) = 0 THEN 0.0 ELSE SUM(discount_cost) / SUM(cost) END
  FROM dense GROUP BY source, day),
panel AS (
  SELECT source, entity, 'Cost' AS metric, day, cost AS value FROM wide
  UNION ALL SELECT source, entity, 'Clicks', day, clicks FROM wide
  UNION ALL SELECT source, entity, 'Discount rate', day, rate FROM wide)"""


def history(cte: str = "panel") -> str:
    return f"""plan AS (
  SELECT source, as_of, w AS "window", wd FROM (
    SELECT source, MAX(day) AS as_of, date_diff('day', MIN(day), MAX(day)) + 1 AS n_days
    FROM {cte} GROUP BY source) s,
    (VALUES ('full', 0), ('270d', 270), ('90d', 90)) v(w, wd)
  WHERE wd < n_days),
hist AS (
  SELECT p.source AS series_id, entity, metric, "window", as_of, day, value
  FROM {cte} p JOIN plan USING (source)
  WHERE wd = 0 OR date_diff('day', day, as_of) < wd)"""


GRID = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
KEYS = 'series_id, entity, metric, "window"'
AHEAD = "ahead AS (SELECT UNNEST(generate_series(1, 7)) AS h)"
IDX = "idx AS (SELECT UNNEST(generate_series(0, 8)) AS q_idx)"

NAIVE = f"""naive_spread AS (
  SELECT {KEYS}, as_of, quantile_cont(change, {GRID}) AS spread FROM (
    SELECT {KEYS}, as_of, value - LAG(value, 7) OVER (
      PARTITION BY {KEYS} ORDER BY day) AS change FROM hist) c
  GROUP BY ALL),
naive AS (
  SELECT s.series_id, s.entity, s.metric, s."window", 'seasonal_naive' AS model, s.as_of,
    CAST(s.as_of + CAST(h AS INTEGER) AS DATE) AS day, CAST(q_idx AS INTEGER) AS q_idx,
    b.value + spread[q_idx + 1] AS value
  FROM naive_spread s, ahead, idx
  JOIN hist b ON TRUE
  WHERE b.series_id = s.series_id AND b.entity = s.entity AND b.metric = s.metric
    AND b."window" = s."window"
    AND b.day = CAST(s.as_of + CAST(h AS INTEGER) - CASE WHEN h <= 7 THEN 7 ELSE 14 END AS DATE))"""

WEEKDAY = f"""per_weekday AS (
  SELECT {KEYS}, as_of, isodow(day) AS wd, quantile_cont(value, {GRID}) AS q
  FROM hist GROUP BY ALL),
weekday AS (
  SELECT series_id, entity, metric, "window", 'weekday_quantile' AS model, as_of,
    CAST(as_of + CAST(h AS INTEGER) AS DATE) AS day, CAST(q_idx AS INTEGER) AS q_idx,
    q[q_idx + 1] AS value
  FROM per_weekday, ahead, idx
  WHERE isodow(CAST(as_of + CAST(h AS INTEGER) AS DATE)) = wd)"""

TREND = f"""line AS (
  SELECT {KEYS}, as_of, COALESCE(regr_slope(value, t), 0.0) AS slope,
    AVG(value) - COALESCE(regr_slope(value, t), 0.0) * AVG(t) AS level
  FROM (SELECT *, CAST(date_diff('day', as_of, day) AS DOUBLE) AS t FROM hist) x GROUP BY ALL),
offs AS (
  SELECT h.series_id, h.entity, h.metric, h."window", h.as_of, slope, level,
    isodow(day) AS wd, value - level - slope * date_diff('day', h.as_of, day) AS off
  FROM hist h JOIN line l ON h.series_id = l.series_id AND h.entity = l.entity
    AND h.metric = l.metric AND h."window" = l."window"),
effects AS (SELECT {KEYS}, wd, AVG(off) AS effect FROM offs GROUP BY ALL),
trend_spread AS (
  SELECT o.series_id, o.entity, o.metric, o."window", as_of, slope, level,
    quantile_cont(off - effect, {GRID}) AS spread
  FROM offs o JOIN effects e ON o.series_id = e.series_id AND o.entity = e.entity
    AND o.metric = e.metric AND o."window" = e."window" AND o.wd = e.wd
  GROUP BY ALL),
trend AS (
  SELECT s.series_id, s.entity, s.metric, s."window", 'trend_weekday' AS model, as_of,
    CAST(as_of + CAST(h AS INTEGER) AS DATE) AS day, CAST(q_idx AS INTEGER) AS q_idx,
    level + slope * h + effect + spread[q_idx + 1] AS value
  FROM trend_spread s, ahead, idx
  JOIN effects e ON TRUE
  WHERE e.series_id = s.series_id AND e.entity = s.entity AND e.metric = s.metric
    AND e."window" = s."window"
    AND e.wd = isodow(CAST(as_of + CAST(h AS INTEGER) AS DATE)))"""

LONG = """SELECT series_id, entity, metric, "window", model, day, q_idx,
  ROUND(value, 4) + 0.0 AS value FROM {}"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- records and cells -----------------------------------------------------------------

_SQL["csv_records"] = """
SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS row_num, CAST(o_orderkey AS VARCHAR) AS key,
  CASE WHEN o_orderstatus = 'P' THEN 'line one,' || chr(10) || o_orderpriority
       ELSE 'a "b", ' || o_orderpriority END AS note,
  CASE WHEN o_orderstatus = 'P' THEN 'y' ELSE 'x' END AS mark, 3 AS width, false AS malformed
FROM orders"""

_SQL["clean_cells"] = _with(OC) + """
SELECT source, o_orderkey + 2 AS row_num,
  ROUND(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END, 2) AS cost,
  false AS cost_percent,
  CASE WHEN c_acctbal < 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS clicks,
  c_acctbal < 0 AS clicks_no_data, ROUND(c_acctbal, 2) + 0.0 AS share, true AS share_percent
FROM oc"""

_SQL["cell_no_data"] = _with(OC) + """
SELECT source, COUNT(*) AS n_cells, COUNT(*) FILTER (c_acctbal < 0) AS n_no_data,
  SUM(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END) AS clicks
FROM oc GROUP BY source"""

_SQL["parse_dates"] = _with(OC) + "SELECT source, o_orderkey + 2 AS row_num, day FROM oc"

_SQL["date_order"] = _with(OC) + """
SELECT source, CASE WHEN source IN ('2-HIGH', '3-MEDIUM') THEN
    CASE WHEN MAX(day(day)) <= 12 THEN 'undecided'
         WHEN source = '2-HIGH' THEN 'day' ELSE 'month' END
  ELSE 'plain' END AS date_order
FROM oc GROUP BY source"""

_SQL["unreadable_dates"] = _with(OC) + """
SELECT source, MIN(o_orderkey) + 2 AS row_num, 'Day' AS column_name,
  arg_min(c_mktsegment, o_orderkey) AS detail, COUNT(*) AS n FROM oc GROUP BY source"""

# --- columns ---------------------------------------------------------------------------

_SQL["column_profile"] = _with(OC) + """
SELECT source, CAST(col_idx AS INTEGER) AS col_idx, COUNT(*) AS n_cells,
  COUNT(*) FILTER (words) AS n_bad, BOOL_OR(pct) AS is_percent, BOOL_OR(words) AS first_is_text,
  CAST(0 AS BIGINT) AS n_blank, COUNT(*) FILTER (col_idx = 2) AS n_state,
  COUNT(*) FILTER (col_idx <> 2) AS n_other
FROM oc, (VALUES (1, true, false), (2, true, false), (3, true, false), (4, false, false),
  (5, false, false), (6, false, false), (7, false, true)) v(col_idx, words, pct)
GROUP BY source, col_idx"""

_SQL["percent_flags"] = """
SELECT o_orderpriority AS source, 'Share of voice' AS name, COUNT(*) AS n_cells
FROM orders GROUP BY ALL"""

_SQL["column_roles"] = """
SELECT source, CAST(col_idx AS INTEGER) AS col_idx, name, role, concept, averaged, is_percent
FROM (SELECT DISTINCT l_linestatus AS source FROM lineitem) s, (VALUES
  (1, 'Campaign', 'text', NULL, false, false),
  (2, 'Campaign status', 'text', NULL, false, false),
  (3, 'Currency code', 'text', NULL, false, false),
  (4, 'Budget', 'setting', NULL, false, false),
  (5, 'Cost', 'metric', 'spend', false, false),
  (6, 'Clicks', 'metric', 'clicks', false, false),
  (7, 'Impr.', 'metric', 'impressions', false, false),
  (8, 'CTR', 'metric', 'rate', true, true),
  (9, 'Discount rate', 'metric', 'rate', true, false),
  (10, 'Quality score', 'not_metric', NULL, false, false)
) v(col_idx, name, role, concept, averaged, is_percent)"""

NAMES = """names AS (
  SELECT name, COUNT(*) AS n FROM (
    SELECT UNNEST([
      'Cost per ' || event_type || ' (USD)', title || 's', title || ' rate',
      'Cost / ' || event_type, 'Conv. ' || event_type || ' value / cost',
      'Unique  ' || event_type || '-through CTR', 'Coût ' || event_type, title || ' ID',
      'Max ' || event_type || ' bid', 'Avg. CPC ' || title, 'Impact of ' || event_type,
      title || ' share (of all']) AS name
    FROM (SELECT event_type, upper(event_type[1]) || event_type[2:] AS title FROM events) e) x
  GROUP BY name)"""


def _bare(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace({e}, '\\([^)]*\\)', '', 'g'), '\\(.*$', '')"
    )


def _words(e: str) -> str:
    low = f"translate(lower(trim({_bare(e)})), '{fixed.ACCENTS_FROM}', '{fixed.ACCENTS_TO}')"
    return f"(' ' || trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _has(w: str, patterns: list[str]) -> str:
    return f"regexp_matches({w}, ' ({'|'.join(patterns)}) ')"


def _concept(w: str) -> str:
    whens = " ".join(f"WHEN {_has(w, p)} THEN '{c}'" for c, _, _, p in fixed.CONCEPTS)
    return f"CASE {whens} END"


_ALL_PATTERNS = [p for _, _, _, ps in fixed.CONCEPTS for p in ps]
_SLASHED = (
    f"(contains(bare, '/') AND len(list_filter(string_split(bare, '/'), lambda x: "
    f"{_has(_words('x'), _ALL_PATTERNS)})) > 0)"
)
PREPARED = NAMES + f""",
prepared AS (SELECT name, n, {_bare('name')} AS bare, {_words('name')} AS w FROM names)"""

_ADDABLE = ", ".join(f"'{c}'" for c, add, _, _ in fixed.CONCEPTS if add)
_SQL["metric_concepts"] = _with(
    PREPARED,
    f"judged AS (SELECT *, CASE WHEN {_SLASHED} THEN 'ratio' ELSE {_concept('w')} END AS concept "
    "FROM prepared)",
) + f"""
SELECT name, n, concept, COALESCE(concept IN ({_ADDABLE}), true) AS addable,
  regexp_matches(lower(trim(name)), '(^|[ _-])(id|ids|code)[ _-]*$') AS identifier,
  regexp_matches(lower(name), 'budget|bid|target|limit|cap') AS setting,
  regexp_matches(lower(trim(name)), 'ctr|rate|%|ratio|share|avg\\.|avg |average') AS ratio
FROM judged"""

_IMPLIED = " ".join(f"WHEN {_has('w', p)} THEN '{c}'" for c, p in fixed.IMPLIED_DENOMINATORS)
_AFTER_SLASH = "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '([^/]*)$', 1) END"
_AFTER_PER = "CASE WHEN contains(w, ' per ') THEN substr(w, instr(w, ' per ') + 4) END"
_SQL["rate_denominators"] = _with(
    PREPARED,
    f"split AS (SELECT *, {_AFTER_SLASH.format('name')} AS below, "
    f"{_AFTER_SLASH.format('bare')} AS bare_below, {_AFTER_PER} AS per FROM prepared)",
    f"sides AS (SELECT *, {_words('below')} AS below_w, {_words('bare_below')} AS bare_below_w "
    "FROM split)",
) + f"""
SELECT name, n,
  COALESCE({_concept('below_w')}, CASE {_IMPLIED} END, {_concept('per')}) AS denominator,
  COALESCE(CASE WHEN bare_below IS NOT NULL THEN trim(bare_below_w) END, trim(per), '') AS phrase
FROM sides"""

_SQL["weight_choice"] = """
SELECT source, metric, weighted_by, kind
FROM (SELECT DISTINCT l_linestatus AS source FROM lineitem) s,
  (VALUES ('CTR', 'Impr.', 'blended'), ('Discount rate', NULL, 'plain mean'))
    v(metric, weighted_by, kind)"""

_SQL["bad_cells"] = _with(
    OC, "marked AS (SELECT *, CAST(c_custkey AS VARCHAR) LIKE '%99' AS bad FROM oc)"
) + """
SELECT source, 'Clicks' AS column_name,
  arg_min(o_orderkey, (day, o_orderkey)) FILTER (bad) + 2 AS row_num,
  printf('%d unreadable', COUNT(*) FILTER (bad)) AS detail
FROM marked GROUP BY source
HAVING COUNT(*) FILTER (bad) > 0 AND COUNT(*) FILTER (bad) * 10 < COUNT(*)"""

RAGGED = OC + """,
ragged AS (
  SELECT source, day, 'Market ' || c_mktsegment AS entity, SUM(o_totalprice) AS cost,
    COUNT(*) AS n FROM oc GROUP BY ALL),
per_day AS (SELECT source, day, COUNT(*) AS n_rows FROM ragged GROUP BY ALL),
first_days AS (
  SELECT source, MIN(day) AS first_day, MAX(day) AS last_day, arg_min(n_rows, day) AS rows_per_day
  FROM per_day GROUP BY source)"""

_SQL["group_column"] = _with(RAGGED) + """
SELECT DISTINCT l_linestatus AS source, 'Campaign' AS group_by, 'ok' AS verdict FROM lineitem
UNION ALL
SELECT source, CASE WHEN rows_per_day = 1 THEN NULL ELSE 'Market' END,
  CASE WHEN rows_per_day = 1 THEN 'single' ELSE 'ok' END
FROM first_days"""

_SQL["near_duplicates"] = """
WITH names AS (
  SELECT DISTINCT o_orderpriority AS source,
    CASE WHEN o_orderstatus = 'F' THEN lower(c_mktsegment) ELSE c_mktsegment END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT source, lower(name) AS folded, COUNT(*) AS spellings
FROM names GROUP BY ALL HAVING COUNT(*) > 1"""

_SQL["one_currency"] = _with(OC) + """
SELECT source, CASE WHEN MIN(cur) = MAX(cur) THEN MIN(cur) END AS currency,
  MIN(cur) <> MAX(cur) AS mixed
FROM (SELECT source, CASE WHEN source = '5-LOW' AND c_nationkey < 5 THEN 'EUR' ELSE 'USD' END
  AS cur FROM oc) x GROUP BY source"""

# --- days and entities --------------------------------------------------------------------

_SQL["rows_per_day"] = _with(RAGGED) + "SELECT source, day, n_rows FROM per_day"

_SQL["uneven_days"] = _with(RAGGED) + """
SELECT source, MIN(day) AS day, arg_min(printf('%d rows, not %d', n_rows, rows_per_day), day)
  AS detail, COUNT(*) AS n
FROM per_day JOIN first_days USING (source) WHERE n_rows <> rows_per_day GROUP BY source"""

NATIONS = OC + """,
nations AS (
  SELECT DISTINCT source, day, 'Market ' || c_nationkey AS entity FROM oc),
nation_spans AS (
  SELECT source, entity, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days
  FROM nations GROUP BY ALL),
days AS (SELECT DISTINCT source, day FROM nations)"""

_SQL["entity_span"] = _with(NATIONS) + """
SELECT source, entity, first_day, last_day, CAST(n_days AS INTEGER) AS n_days FROM nation_spans"""

_SQL["fill_absent"] = _with(NATIONS) + """
SELECT source, d.day, entity, CAST(d.day AS VARCHAR) AS written, '0' AS cost, '0' AS orders
FROM nation_spans JOIN days d USING (source) WHERE d.day < first_day OR d.day > last_day"""

_SQL["interior_holes"] = _with(RAGGED) + """
SELECT s.source, s.entity, MIN(p.day) AS day, COUNT(*) AS n
FROM (SELECT source, entity, MIN(day) AS lo, MAX(day) AS hi FROM ragged GROUP BY ALL) s
JOIN per_day p USING (source)
WHERE p.day > lo AND p.day < hi AND NOT EXISTS (
  SELECT 1 FROM ragged r WHERE r.source = s.source AND r.entity = s.entity AND r.day = p.day)
GROUP BY s.source, s.entity"""

_SQL["stopped_entities"] = _with(NATIONS) + """
SELECT source, entity, last_day FROM nation_spans
JOIN (SELECT source, MAX(day) AS source_last FROM days GROUP BY source) d USING (source)
WHERE last_day < source_last"""

_SQL["flat_entities"] = """
SELECT source, entity FROM (
  SELECT o_orderpriority AS source, CAST(o_custkey AS VARCHAR) AS entity,
    CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY ALL) x
GROUP BY ALL HAVING MIN(n) = MAX(n)"""

_SQL["entity_states"] = f"""
SELECT DISTINCT l_linestatus AS source, l_returnflag AS entity,
  CASE WHEN l_returnflag = 'R' THEN 'paused' ELSE 'live' END AS state,
  CASE WHEN l_returnflag = 'R' THEN 'switched off in the export' END AS reason
FROM lineitem
UNION ALL SELECT DISTINCT l_linestatus, '{fixed.ACCOUNT}', 'live', NULL FROM lineitem"""

_SQL["paused_entities"] = """
SELECT DISTINCT l_linestatus AS source, l_returnflag AS entity
FROM lineitem WHERE l_returnflag = 'R'"""

_SQL["excluded_entities"] = """
SELECT DISTINCT l_linestatus AS source, l_returnflag AS entity, 'paused' AS state
FROM lineitem WHERE l_returnflag = 'R'"""

_SQL["exclusion_lists"] = """
SELECT DISTINCT l_linestatus AS source, 'paused' AS state, CAST(1 AS BIGINT) AS n, 'R' AS names
FROM lineitem WHERE l_returnflag = 'R'"""

SHOPS = """shop_days AS (
  SELECT DISTINCT l_linestatus AS source, CAST(l_suppkey AS VARCHAR) AS key,
    CAST(l_shipdate AS DATE) AS day,
    printf('Nation %d %s', s_nationkey, CASE WHEN s_acctbal < 0 AND
      CAST(l_shipdate AS DATE) > DATE '1998-06-30' THEN 'outlet' ELSE 'shop' END) AS name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
shops AS (
  SELECT source, key, arg_min(name, day) AS first_name, arg_max(name, day) AS last_name
  FROM shop_days GROUP BY ALL),
labelled AS (
  SELECT *, COUNT(*) OVER (PARTITION BY source, last_name) AS n_ids FROM shops)"""
_LABEL = "CASE WHEN n_ids > 1 THEN last_name || ' (' || key || ')' ELSE last_name END AS label"

_SQL["entity_labels"] = _with(SHOPS) + f"SELECT source, key, {_LABEL}, first_name FROM labelled"
_SQL["renames"] = _with(SHOPS) + f"""
SELECT source, key, first_name, {_LABEL} FROM labelled WHERE first_name <> last_name"""
_SQL["name_collisions"] = _with(SHOPS) + """
SELECT source, last_name, COUNT(*) AS n_ids FROM shops GROUP BY ALL HAVING COUNT(*) > 1"""

_SQL["same_entities"] = _with(
    RAGGED,
    "seen AS (SELECT source, entity, MIN(day) AS first_seen FROM ragged GROUP BY ALL)",
) + """
SELECT s.source, 'entity_missing' AS rule, s.entity, MIN(p.day) AS day, COUNT(*) AS n
FROM seen s JOIN first_days f USING (source) JOIN per_day p USING (source)
WHERE first_seen = first_day AND NOT EXISTS (
  SELECT 1 FROM ragged r WHERE r.source = s.source AND r.entity = s.entity AND r.day = p.day)
GROUP BY s.source, s.entity
UNION ALL
SELECT source, 'entity_new', entity, first_seen, 1 FROM seen JOIN first_days USING (source)
WHERE first_seen > first_day"""

_SQL["day_gaps"] = """
SELECT source, prev_day, day, CAST(date_diff('day', prev_day, day) - 1 AS INTEGER) AS missing
FROM (
  SELECT source, day, LAG(day) OVER (PARTITION BY source ORDER BY day) AS prev_day
  FROM (SELECT DISTINCT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day
    FROM orders) d) x
WHERE date_diff('day', prev_day, day) > 1"""

_SQL["segmentation"] = """
WITH days AS (
  SELECT DISTINCT 'week ' || o_orderpriority AS source,
    CAST(date_trunc('week', o_orderdate) AS DATE) AS day FROM orders
  UNION ALL
  SELECT DISTINCT 'day ' || o_orderpriority, CAST(o_orderdate AS DATE) FROM orders),
steps AS (
  SELECT source, date_diff('day', LAG(day) OVER (PARTITION BY source ORDER BY day), day) AS step
  FROM days)
SELECT source, CAST(MIN(step) AS INTEGER) AS step, CASE WHEN MIN(step) = 7 THEN 'weekly'
  WHEN MIN(step) BETWEEN 28 AND 31 THEN 'monthly'
  ELSE printf('every %d days', MIN(step)) END AS period
FROM steps GROUP BY source
HAVING MIN(step) = MAX(step) AND MIN(step) > 1 AND COUNT(step) > 1"""

_SQL["too_short"] = f"""
SELECT event_type AS source,
  printf('%d days, {fixed.MIN_DAYS} needed', COUNT(DISTINCT CAST(ts AS DATE))) AS detail
FROM events GROUP BY event_type HAVING COUNT(DISTINCT CAST(ts AS DATE)) < {fixed.MIN_DAYS}"""

_SQL["history_verdict"] = """
SELECT source, n_days, CASE WHEN n_days < 90 THEN 'too short' WHEN n_days >= 730 THEN 'two years'
  WHEN n_days >= 365 THEN 'one year' ELSE 'enough' END AS verdict, n_days >= 90 AS enough
FROM (SELECT o_orderpriority AS source, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_days
  FROM orders GROUP BY ALL) x"""

# --- panel ---------------------------------------------------------------------------------

CTR = """ctr AS (
  SELECT *, CASE WHEN impr > 0
    THEN CAST(printf('%.6f', 100.0 * clicks / impr) AS DOUBLE) ELSE 0.0 END AS ctr FROM dense)"""

_SQL["account_totals"] = _with(DAILY) + """
SELECT source, metric, day, ROUND(value, 4) + 0.0 AS value FROM (
  SELECT source, day, SUM(cost) AS cost, SUM(clicks) AS clicks, SUM(impr) AS impr,
    CAST(COUNT(*) * 500 AS DOUBLE) AS budget
  FROM dense GROUP BY ALL) x,
  LATERAL (VALUES ('Cost', cost), ('Clicks', clicks), ('Impr.', impr), ('Budget', budget))
    v(metric, value)"""

_SQL["entity_series"] = _with(DAILY, CTR) + """
SELECT source, entity, metric, day, ROUND(value, 6) + 0.0 AS value FROM ctr,
  LATERAL (VALUES ('Cost', cost), ('Clicks', clicks), ('Impr.', impr), ('Budget', 500.0),
    ('CTR', ctr), ('Discount rate', ROUND(COALESCE(discount, 0.0), 6))) v(metric, value)"""

_SQL["blended_rates"] = _with(DAILY, CTR) + """
SELECT source, day, ROUND(CASE WHEN SUM(impr) = 0 THEN 0.0
  ELSE SUM(ctr * impr) / SUM(impr) END, 4) + 0.0 AS value FROM ctr GROUP BY ALL"""

_SQL["plain_rates"] = _with(DAILY) + """
SELECT source, day, ROUND(COALESCE(AVG(ROUND(discount, 6)), 0.0), 8) + 0.0 AS value
FROM dense GROUP BY ALL"""

_SQL["item_panel"] = _with(PANEL) + """
SELECT source, entity, metric, day, ROUND(value, 4) + 0.0 AS value FROM panel"""

_SQL["last_n_days"] = _with(PANEL) + """
SELECT source, entity, metric, day, ROUND(value, 4) + 0.0 AS value
FROM panel JOIN spans USING (source) WHERE date_diff('day', day, hi) < 90"""

_SQL["window_plan"] = """
WITH lengths AS (
  SELECT l_linestatus AS source, COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS n_days
  FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT event_type, COUNT(DISTINCT CAST(ts AS DATE)) FROM events GROUP BY ALL)
SELECT source, "window", CAST(window_days AS BIGINT) AS window_days, n_days
FROM lengths, (VALUES ('full', 0), ('270d', 270), ('90d', 90)) v("window", window_days)
WHERE window_days < n_days"""

_SQL["raw_json_query"] = """
SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, COUNT(*) AS n,
  ROUND(SUM(value), 4) AS total
FROM events GROUP BY ALL"""

# --- forecasts --------------------------------------------------------------------------------

_SQL["seasonal_naive"] = _with(PANEL, history(), AHEAD, IDX, NAIVE) + LONG.format("naive")
_SQL["weekday_quantile"] = _with(PANEL, history(), AHEAD, IDX, WEEKDAY) + LONG.format("weekday")
_SQL["trend_weekday"] = _with(PANEL, history(), AHEAD, IDX, TREND) + LONG.format("trend")

_SQL["covariate_forecast"] = _with(PANEL, history(), IDX, f"""x AS (
  SELECT source AS series_id, entity, day, value AS x FROM panel WHERE metric = 'Clicks'),
pairs AS (
  SELECT h.*, x.x FROM hist h JOIN x USING (series_id, entity, day) WHERE metric <> 'Clicks'),
fit AS (
  SELECT {KEYS}, as_of, COALESCE(regr_slope(value, x), 0.0) AS slope,
    AVG(value) - COALESCE(regr_slope(value, x), 0.0) * AVG(x) AS level
  FROM pairs GROUP BY ALL),
resid AS (
  SELECT p.series_id, p.entity, p.metric, p."window", p.as_of, slope, level,
    quantile_cont(value - level - slope * x, {GRID}) AS spread
  FROM pairs p JOIN fit f ON p.series_id = f.series_id AND p.entity = f.entity
    AND p.metric = f.metric AND p."window" = f."window" GROUP BY ALL)""") + """
SELECT r.series_id, r.entity, metric, "window", 'covariate_line' AS model,
  CAST(x.day + 7 AS DATE) AS day, CAST(q_idx AS INTEGER) AS q_idx,
  ROUND(level + slope * x.x + spread[q_idx + 1], 4) + 0.0 AS value
FROM resid r JOIN x ON r.series_id = x.series_id AND r.entity = x.entity, idx
WHERE date_diff('day', x.day, r.as_of) < 7"""

_SQL["ensemble_average"] = _with(PANEL, history(), AHEAD, IDX, NAIVE, WEEKDAY, TREND) + """
SELECT series_id, entity, metric, '90d' AS "window", 'average' AS model, day, q_idx,
  COUNT(*) AS n_runs, ROUND(AVG(value), 4) + 0.0 AS value
FROM (SELECT * FROM naive UNION ALL SELECT * FROM weekday UNION ALL SELECT * FROM trend) f
WHERE "window" = '90d' GROUP BY series_id, entity, metric, day, q_idx"""

_SQL["own_forecaster"] = _with(PANEL, history(), AHEAD, IDX, f"""recent AS (
  SELECT {KEYS}, as_of, quantile_cont(value, {GRID}) AS q FROM hist
  WHERE date_diff('day', day, as_of) < 28 GROUP BY ALL)""") + """
SELECT series_id, entity, metric, "window", 'damped_mean' AS model,
  CAST(as_of + CAST(h AS INTEGER) AS DATE) AS day, CAST(q_idx AS INTEGER) AS q_idx,
  ROUND(q[q_idx + 1], 4) + 0.0 AS value FROM recent, ahead, idx"""

WIDE = "[0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, " \
    "0.75, 0.8, 0.85, 0.9, 0.95, 0.99]"
_SQL["quantile_grids"] = _with(PANEL, history(), AHEAD, IDX, NAIVE, WEEKDAY, f"""recent AS (
  SELECT {KEYS}, as_of, quantile_cont(value, {WIDE}) AS q FROM hist
  WHERE "window" = '90d' AND date_diff('day', day, as_of) < 28 GROUP BY ALL),
nine AS (
  SELECT * FROM (SELECT * FROM naive UNION ALL SELECT * FROM weekday) f WHERE "window" = '90d'),
every AS (
  SELECT series_id, entity, metric, 'damped_mean' AS model,
    CAST(as_of + CAST(h AS INTEGER) AS DATE) AS day, {WIDE}[i] AS quantile, q[i] AS value
  FROM recent, ahead, (SELECT UNNEST(generate_series(1, 21)) AS i) x
  UNION ALL
  SELECT series_id, entity, metric, model, day, {GRID}[q_idx + 1], value FROM nine
  UNION ALL
  SELECT series_id, entity, metric, 'average', day, {GRID}[q_idx + 1], AVG(value)
  FROM nine GROUP BY series_id, entity, metric, day, q_idx)""") + """
SELECT series_id, entity, metric, model, day, CAST(quantile AS DOUBLE) AS quantile,
  ROUND(value, 4) + 0.0 AS value FROM every"""

RIDGE = f"""accounts AS (
  SELECT * FROM hist
  UNION ALL
  SELECT * REPLACE ('copy of ' || series_id AS series_id, value * 2 AS value) FROM hist),
scaled AS (
  SELECT *, value / level AS y FROM (
    SELECT *, greatest(AVG(abs(value)) OVER (PARTITION BY {KEYS}), 1e-9) AS level
    FROM accounts) x),
framed AS (
  SELECT {KEYS}, as_of, day, level, y FROM scaled
  UNION ALL
  SELECT {KEYS}, as_of, CAST(as_of + CAST(h AS INTEGER) AS DATE), level, NULL
  FROM scaled, ahead WHERE day = as_of),
featured AS (
  SELECT * FROM (
    SELECT *, LAG(y, 7) OVER s AS a, LAG(y, 14) OVER s AS b,
      AVG(y) OVER (PARTITION BY {KEYS} ORDER BY day ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING) AS c
    FROM framed WINDOW s AS (PARTITION BY {KEYS} ORDER BY day)) x
  WHERE a IS NOT NULL AND b IS NOT NULL),
sums AS (
  SELECT series_id, "window", AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, AVG(c) AS mc,
    (AVG(a * a) - AVG(a) * AVG(a)) * 1.1 AS aa,
    (AVG(b * b) - AVG(b) * AVG(b)) * 1.1 AS bb,
    (AVG(c * c) - AVG(c) * AVG(c)) * 1.1 AS cc,
    AVG(a * b) - AVG(a) * AVG(b) AS ab, AVG(a * c) - AVG(a) * AVG(c) AS ac,
    AVG(b * c) - AVG(b) * AVG(c) AS bc, AVG(a * y) - AVG(a) * AVG(y) AS ay,
    AVG(b * y) - AVG(b) * AVG(y) AS "by", AVG(c * y) - AVG(c) * AVG(y) AS cy
  FROM featured WHERE y IS NOT NULL GROUP BY series_id, "window"),
dets AS (
  SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d,
    ay * (bb * cc - bc * bc) - ab * ("by" * cc - bc * cy) + ac * ("by" * bc - bb * cy) AS da,
    aa * ("by" * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - "by" * ac) AS db,
    aa * (bb * cy - "by" * bc) - ab * (ab * cy - "by" * ac) + ay * (ab * bc - bb * ac) AS dc
  FROM sums),
guessed AS (
  SELECT f.*, my + coalesce(da / nullif(d, 0), 0) * (a - ma) + coalesce(db / nullif(d, 0), 0) * (b - mb)
    + coalesce(dc / nullif(d, 0), 0) * (c - mc) AS p
  FROM featured f JOIN dets USING (series_id, "window")),
ridge_spread AS (
  SELECT {KEYS}, quantile_cont(y - p, {GRID}) AS spread FROM guessed WHERE y IS NOT NULL
  GROUP BY ALL),
ridge AS (
  SELECT g.series_id, g.entity, g.metric, g."window", 'pooled_ridge' AS model, day,
    CAST(q_idx AS INTEGER) AS q_idx, (p + spread[q_idx + 1]) * level AS value
  FROM guessed g JOIN ridge_spread r ON g.series_id = r.series_id AND g.entity = r.entity
    AND g.metric = r.metric AND g."window" = r."window", idx
  WHERE y IS NULL)"""
_SQL["pooled_ridge"] = _with(PANEL, history(), AHEAD, IDX, RIDGE) + LONG.format("ridge")

_SQL["loaded_forecaster"] = _SQL["own_forecaster"]

_SQL["fitted_lines"] = """WITH RECURSIVE line AS (
  SELECT l_returnflag, l_linestatus, [l_quantity, l_discount, l_tax, l_linenumber, l_quantity * 2,
    3, month(l_shipdate), l_quantity * l_tax]::DOUBLE[] AS x, l_extendedprice AS y FROM lineitem),
wide AS (
  SELECT l_returnflag, l_linestatus, k, list_append(x[1:k], y) AS z
  FROM line, (VALUES (3), (8)) v(k)),
pair AS (
  SELECT l_returnflag, l_linestatus, k, i, j, COUNT(*) AS n, AVG(z[k + 1]) AS mean_y,
    AVG(z[i] * z[i]) AS size,
    (AVG(z[i] * z[j]) - AVG(z[i]) * AVG(z[j])) * CASE WHEN i = j THEN 1.1 ELSE 1 END AS v
  FROM wide, range(1, 9) a(i), range(1, 10) b(j) WHERE i <= k AND j <= k + 1
  GROUP BY l_returnflag, l_linestatus, k, i, j),
line_of AS (
  SELECT l_returnflag, l_linestatus, k, i, n, mean_y, any_value(size) AS size,
    list(v ORDER BY j) AS r FROM pair GROUP BY ALL),
step AS (
  SELECT l_returnflag, l_linestatus, k, n, mean_y, 1 AS p, list(size ORDER BY i) AS size,
    list(r ORDER BY i) AS m FROM line_of GROUP BY ALL
  UNION ALL
  SELECT l_returnflag, l_linestatus, k, n, mean_y, p + 1, size,
    CASE WHEN m[p][p] > 1e-10 * size[p]
      THEN list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: v / m[p][p])
        ELSE list_transform(r, lambda v, j: v - r[p] / m[p][p] * m[p][j]) END)
      ELSE list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: 0.0::DOUBLE)
        ELSE r END) END
  FROM step WHERE p <= k)
SELECT l_returnflag, l_linestatus, k AS n_inputs, n, ROUND(mean_y, 3) AS mean_y,
  CAST(i - 1 AS INTEGER) AS input, ROUND(m[i][k + 1], 3) + 0.0 AS b
FROM step, range(1, 9) a(i) WHERE p = k + 1 AND i <= k"""

_SQL["input_hash"] = _with(PANEL, history(), f"""texts AS (
  SELECT {KEYS}, sha256(string_agg(pair, chr(10) ORDER BY pair)) AS h FROM (
    SELECT *, CAST(day AS VARCHAR) || '=' || CAST(CAST(ROUND(value * 1e6) AS HUGEINT) AS VARCHAR)
      AS pair FROM hist) x GROUP BY ALL),
named AS (
  SELECT series_id, "window", sha256(entity || '/' || metric || '/' || h) AS h FROM texts),
pieces AS (
  SELECT series_id, "window", i, SUM(('0x' || h[1 + 15 * i:15 + 15 * i])::BIGINT) AS p
  FROM named, (SELECT UNNEST(generate_series(0, 3)) AS i) x GROUP BY ALL)""") + """
SELECT series_id, "window", sha256(string_agg(CAST(p AS VARCHAR), '-' ORDER BY i)) AS input_hash
FROM pieces GROUP BY series_id, "window\""""

WEEKS = """weeks AS (
  SELECT source AS series_id, entity, metric, day, value,
    CAST(floor(date_diff('day', day, hi) / 7) AS INTEGER) AS week, hi
  FROM panel JOIN spans USING (source))"""

_SQL["quantile_repair"] = _with(PANEL, WEEKS, IDX, """scaled AS (
  SELECT *, MAX(abs(value) * 1.1) OVER (PARTITION BY series_id, entity, metric, week) AS scale,
    list_sort(list_transform([0.9, 0.92, 0.91, 0.95, 1.0, 1.02, 1.01, 1.05, 1.1],
      lambda f: value * CAST(f AS DOUBLE))) AS q
  FROM weeks)""") + """
SELECT series_id, entity, metric, day, CAST(q_idx AS INTEGER) AS q_idx,
  ROUND(q[q_idx + 1], 4) + 0.0 AS value,
  ROUND(CASE WHEN scale < 1e-6 THEN 0.0 ELSE 0.01 * value / scale END, 9) + 0.0 AS crossing
FROM scaled, idx"""

_SQL["forecast_contract"] = _with(PANEL, WEEKS, """sizes AS (
  SELECT series_id, entity, metric, week, COUNT(*) AS n, MAX(value) AS top FROM weeks
  GROUP BY ALL)""") + """
SELECT series_id, entity, metric, CAST(week AS VARCHAR) AS "window",
  CASE WHEN metric = 'Discount rate' OR n < 7 THEN 'days' ELSE 'out of order' END AS problem
FROM sizes
WHERE (metric = 'Discount rate' AND n > 1) OR (metric <> 'Discount rate' AND n < 7)
  OR (metric = 'Clicks' AND top > 0)"""

_SQL["floor_at_zero"] = _with(PANEL, WEEKS, IDX, """bent AS (
  SELECT *, list_transform([-0.5, -0.25, -0.1, 0.0, 0.1, 0.5, 1.0, 1.5, 2.0],
    lambda f: value * CAST(f AS DOUBLE)) AS q FROM weeks)""") + """
SELECT series_id, entity, metric, day, CAST(q_idx AS INTEGER) AS q_idx,
  ROUND(CASE WHEN metric <> 'Discount rate' AND q[q_idx + 1] < 0 THEN 0.0
    ELSE q[q_idx + 1] END, 4) + 0.0 AS value,
  CAST(CASE WHEN metric <> 'Discount rate' AND value > 0 THEN 3 ELSE 0 END AS BIGINT) AS clamped
FROM bent, idx"""

_SQL["backtest"] = _with(PANEL, AHEAD, """changed AS (
  SELECT *, isodow(day) AS wd, value - LAG(value, 7) OVER (
    PARTITION BY source, entity, metric ORDER BY day) AS change FROM panel),
framed AS (
  SELECT source, entity, metric, day, value,
    quantile_cont(change, [0.1, 0.5, 0.9]) OVER (s ROWS UNBOUNDED PRECEDING) AS spread_full,
    quantile_cont(change, [0.1, 0.5, 0.9]) OVER (s ROWS 82 PRECEDING) AS spread_90,
    quantile_cont(value, [0.1, 0.5, 0.9]) OVER (w ROWS UNBOUNDED PRECEDING) AS same_full,
    quantile_cont(value, [0.1, 0.5, 0.9]) OVER (w ROWS 11 PRECEDING) AS same_11,
    quantile_cont(value, [0.1, 0.5, 0.9]) OVER (w ROWS 12 PRECEDING) AS same_12
  FROM changed WINDOW s AS (PARTITION BY source, entity, metric ORDER BY day),
    w AS (PARTITION BY source, entity, metric, wd ORDER BY day)),
cuts AS (
  SELECT source, CAST(hi - CAST(7 + i * 7 AS INTEGER) AS DATE) AS as_of
  FROM spans, (SELECT UNNEST(generate_series(0, 1000)) AS i) x
  WHERE hi - CAST(7 + i * 7 AS INTEGER) > lo),
met AS (
  SELECT o.source, o.entity, o.metric, h, ROUND(t.value, 6) AS actual,
    COALESCE(b.value, o.value) AS base, o.spread_full, o.spread_90, b.same_full,
    CASE WHEN h = 1 THEN b.same_11 ELSE b.same_12 END AS same_90, b.day IS NOT NULL AS there
  FROM cuts c JOIN framed o ON o.source = c.source AND o.day = c.as_of CROSS JOIN ahead
    JOIN framed t ON t.source = o.source AND t.entity = o.entity AND t.metric = o.metric
      AND t.day = CAST(o.day + CAST(h AS INTEGER) AS DATE)
    LEFT JOIN framed b ON b.source = o.source AND b.entity = o.entity AND b.metric = o.metric
      AND b.day = CAST(o.day + CAST(h - 7 AS INTEGER) AS DATE)),
banded AS (
  SELECT 'seasonal_naive' AS model, 'full' AS "window", metric, actual,
    [base + spread_full[1], base + spread_full[2], base + spread_full[3]] AS q FROM met
  UNION ALL SELECT 'seasonal_naive', '90d', metric, actual,
    [base + spread_90[1], base + spread_90[2], base + spread_90[3]] FROM met
  UNION ALL SELECT 'weekday_quantile', 'full', metric, actual, same_full FROM met WHERE there
  UNION ALL SELECT 'weekday_quantile', '90d', metric, actual, same_90 FROM met WHERE there)""") + """
SELECT model, "window", metric, COUNT(*) AS n_days, ROUND(AVG(abs(q[2] - actual)), 4) + 0.0 AS mae,
  ROUND(AVG(CASE WHEN actual <> 0 THEN 100.0 * abs(q[2] - actual) / abs(actual) END), 4) + 0.0 AS mape,
  ROUND(AVG(CAST(actual BETWEEN ROUND(q[1], 6) AND ROUND(q[3], 6) AS INTEGER)) * 100, 4) + 0.0
    AS in_range
FROM banded GROUP BY ALL"""

# --- scoring stored forecasts --------------------------------------------------------------------

STORED = PANEL + f""",
past AS (SELECT panel.* FROM panel JOIN spans USING (source) WHERE date_diff('day', day, hi) >= 7),
{history('past')},
{AHEAD},
{IDX},
{NAIVE},
{WEEKDAY},
stored AS (
  SELECT * REPLACE (model || '@' || "window" AS model),
    CASE WHEN f.model = 'weekday_quantile' THEN CAST(as_of + 2 AS DATE) END AS through
  FROM (SELECT * FROM naive UNION ALL SELECT * FROM weekday) f),
series AS (
  SELECT source AS series_id, entity, metric, day, value
  FROM panel JOIN spans USING (source) WHERE date_diff('day', day, hi) >= 2),
bands AS (
  SELECT series_id, entity, metric, model, as_of, day, through,
    MAX(value) FILTER (q_idx = 4) AS forecast, MAX(value) FILTER (q_idx = 0) AS low,
    MAX(value) FILTER (q_idx = 8) AS high
  FROM stored GROUP BY ALL),
scored AS (
  SELECT b.*, s.value AS actual, forecast - s.value AS error,
    CASE WHEN s.value <> 0 THEN 100.0 * (forecast - s.value) / s.value END AS pct_error,
    CAST(date_diff('day', as_of, b.day) AS INTEGER) AS days_ahead,
    s.value BETWEEN low AND high AS inside_range, COALESCE(b.day <= through, false) AS trained_on
  FROM bands b LEFT JOIN series s ON b.series_id = s.series_id AND b.entity = s.entity
    AND b.metric = s.metric AND b.day = s.day)"""

_SQL["stored_tables"] = _with(STORED) + """
SELECT series_id, model, as_of, COUNT(*) AS n_values, COUNT(DISTINCT entity) AS n_entities,
  any_value(n_days) AS n_days
FROM stored JOIN (SELECT series_id, COUNT(DISTINCT day) AS n_days FROM series GROUP BY ALL) n
  USING (series_id) GROUP BY ALL"""

_SQL["forecast_accuracy"] = _with(STORED) + """
SELECT series_id, model, as_of, days_ahead, entity, metric, day, ROUND(forecast, 4) + 0.0
  AS forecast, ROUND(actual, 4) + 0.0 AS actual, ROUND(error, 4) + 0.0 AS error,
  ROUND(abs(error), 4) + 0.0 AS abs_error, ROUND(pct_error, 4) + 0.0 AS pct_error,
  ROUND(low, 4) + 0.0 AS low, ROUND(high, 4) + 0.0 AS high, inside_range, trained_on,
  CAST(through AS VARCHAR) AS trained_through
FROM scored"""

_SQL["scored_streams"] = _SQL["forecast_accuracy"]

_SCORES = """COUNT(*) AS n_days, ROUND(AVG(abs(pct_error)), 4) + 0.0 AS avg_error,
  ROUND(AVG(pct_error), 4) + 0.0 AS bias,
  ROUND(AVG(CAST(inside_range AS INTEGER)) * 100, 4) + 0.0 AS in_range
FROM scored WHERE actual IS NOT NULL AND NOT trained_on"""

_SQL["accuracy_summary"] = _with(STORED) + f"""
SELECT model, metric, {_SCORES} AND entity = '{fixed.ACCOUNT}' GROUP BY model, metric"""
_SQL["accuracy_by_day"] = _with(STORED) + f"""
SELECT model, metric, days_ahead, {_SCORES} GROUP BY model, metric, days_ahead"""
_SQL["waiting_leaked"] = _with(STORED) + """
SELECT series_id, model, COUNT(*) FILTER (actual IS NULL AND NOT trained_on) AS waiting,
  COUNT(*) FILTER (actual IS NOT NULL AND trained_on) AS leaked FROM scored GROUP BY ALL"""
_SQL["known_values"] = f"""
SELECT DISTINCT l_returnflag AS name FROM lineitem
UNION ALL SELECT * FROM (VALUES ('{fixed.ACCOUNT}'), ('Cost'), ('Clicks'), ('Discount rate')) v"""

# --- report datasets ---------------------------------------------------------------------------

_SQL["report_rows"] = _with(STORED) + """
SELECT series_id, model, entity, metric, day, ROUND(low, 4) + 0.0 AS low,
  ROUND(forecast, 4) + 0.0 AS median, ROUND(high, 4) + 0.0 AS high FROM bands"""
_SQL["horizon_totals"] = _with(STORED) + """
SELECT series_id, entity, metric, model, metric = 'Discount rate' AS is_rate,
  ROUND(CASE WHEN metric = 'Discount rate' THEN AVG(forecast) ELSE SUM(forecast) END, 4) + 0.0
    AS total
FROM bands GROUP BY series_id, entity, metric, model"""
_SQL["compare_pivot"] = _with(STORED) + """
SELECT series_id, entity, metric, day, """ + ",\n".join(
    f"ROUND(MAX(forecast) FILTER (model = '{m}@{w}'), 4) AS {m}_{w}"
    for m in ("seasonal_naive", "weekday_quantile") for w in ("full", "270d", "90d")) + """
FROM bands GROUP BY series_id, entity, metric, day"""
_SQL["observed_totals"] = _with(STORED) + """
SELECT series_id, entity, metric, COUNT(*) AS n_days, ROUND(SUM(value), 4) + 0.0 AS observed
FROM (SELECT *, MAX(day) OVER (PARTITION BY series_id) AS last_day FROM series) s
WHERE date_diff('day', day, last_day) < 90 GROUP BY series_id, entity, metric"""
_SQL["axis_bounds"] = _with(STORED, """ends AS (
  SELECT series_id, entity, metric, MIN(v) AS lo, CASE WHEN MAX(v) <= MIN(v) THEN MIN(v) + 1
    ELSE MAX(v) END AS hi
  FROM (SELECT series_id, entity, metric, value AS v FROM series
    UNION ALL SELECT series_id, entity, metric, forecast FROM bands) x GROUP BY ALL)""") + """
SELECT series_id, entity, metric, ROUND(CASE WHEN lo > 0 AND lo < hi * 0.6 THEN 0.0 ELSE lo END, 4)
  + 0.0 AS lo, ROUND(hi, 4) + 0.0 AS hi FROM ends"""
_SQL["idle_entities"] = """
SELECT DISTINCT l_linestatus AS series_id, l_returnflag AS entity FROM lineitem"""
_SQL["headline_entity"] = f"""
SELECT series_id, model || '@' || w AS model, '{fixed.ACCOUNT}' AS entity
FROM (SELECT DISTINCT l_linestatus AS series_id FROM lineitem) s,
  (VALUES ('seasonal_naive'), ('weekday_quantile')) v(model), (VALUES ('full'), ('270d'), ('90d')) x(w)"""
_SQL["chart_payload"] = _with(STORED) + """
SELECT series_id, entity, metric, 'actual' AS line, day, ROUND(value, 4) + 0.0 AS median,
  NULL::DOUBLE AS low, NULL::DOUBLE AS high,
  CAST(COUNT(*) OVER (PARTITION BY series_id, entity, metric) AS INTEGER) AS cut FROM series
UNION ALL
SELECT b.series_id, b.entity, b.metric, model, b.day, ROUND(forecast, 4) + 0.0,
  ROUND(low, 4) + 0.0, ROUND(high, 4) + 0.0, CAST(n AS INTEGER)
FROM bands b JOIN (SELECT series_id, entity, metric, COUNT(*) AS n FROM series GROUP BY ALL) c
  ON b.series_id = c.series_id AND b.entity = c.entity AND b.metric = c.metric"""
_SQL["revised_runs"] = _with(STORED, """twice AS (
  SELECT *, 1.0::DOUBLE AS f FROM bands WHERE model = 'weekday_quantile@90d'
  UNION ALL SELECT *, 1.5 FROM bands WHERE model = 'weekday_quantile@90d')""") + """
SELECT b.series_id, model, b.entity, b.metric, b.day, ROUND(forecast * f, 4) + 0.0 AS forecast,
  ROUND(s.value, 4) + 0.0 AS actual, ROUND(low * f, 4) + 0.0 AS low,
  ROUND(high * f, 4) + 0.0 AS high, s.value BETWEEN low * f AND high * f AS inside_range
FROM twice b LEFT JOIN series s ON b.series_id = s.series_id AND b.entity = s.entity
  AND b.metric = s.metric AND b.day = s.day"""

ORDER_RUNS = OC + f""",
order_runs AS (
  SELECT printf('%012d', o_orderkey) AS id, c_mktsegment AS series_id,
    CASE WHEN o_orderstatus = 'O' THEN '{fixed.AVERAGE_LABEL}' ELSE o_orderpriority END AS model,
    CAST(date_trunc('year', day) AS DATE) AS as_of, o_orderdate AS created_at,
    o_orderpriority = '5-LOW' AS fitted
  FROM oc),
latest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY series_id, model ORDER BY created_at DESC, id DESC) AS rn
    FROM (SELECT *, MAX(as_of) OVER (PARTITION BY series_id) AS newest FROM order_runs) x
    WHERE as_of = newest) y
  WHERE rn = 1)"""
_SQL["latest_runs"] = _with(ORDER_RUNS) + "SELECT series_id, model, as_of, id FROM latest"
_SQL["drawn_runs"] = _with(ORDER_RUNS, f"""marked AS (
  SELECT *, model = '{fixed.AVERAGE_LABEL}' AS is_average,
    BOOL_OR(model = '{fixed.AVERAGE_LABEL}') OVER (PARTITION BY series_id) AS has_average
  FROM latest)""") + """
SELECT 'models' AS page, series_id, model, id FROM marked
WHERE NOT fitted AND (is_average OR NOT has_average)
UNION ALL
SELECT 'fitted', series_id, model, id FROM marked
WHERE fitted OR is_average OR NOT has_average"""
_SQL["provenance"] = """
SELECT c_mktsegment AS series_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN '2000-01-01' END AS trained_through, COUNT(*) AS n_runs
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
BRANDS = f"""seen AS (
  SELECT l_returnflag AS series_id, l_returnflag || '/' || CAST(l_quantity AS INTEGER) AS run_id,
    p_brand AS entity, MIN(l_orderkey * 10 + l_linenumber) AS position, any_value(l_quantity) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
named AS (
  SELECT series_id, run_id, entity, position FROM (
    SELECT series_id, run_id, entity, MIN(position) AS position FROM seen GROUP BY ALL)
  UNION ALL SELECT DISTINCT series_id, run_id, '{fixed.ACCOUNT}', 0 FROM seen WHERE q <= 10)"""
_SQL["first_entities"] = _with(BRANDS) + f"""
SELECT run_id, entity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id
  ORDER BY entity <> '{fixed.ACCOUNT}', position, entity) AS rn FROM named) WHERE rn = 1"""
_SQL["entity_order"] = _with(BRANDS) + """
SELECT series_id, item, position, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY position, item) AS rank
FROM (SELECT series_id, entity AS item, MIN(position) AS position, COUNT(*) AS n FROM named GROUP BY ALL)
JOIN (SELECT series_id, COUNT(DISTINCT run_id) AS n FROM named GROUP BY ALL) r USING (series_id, n)"""
_SQL["shared_entities"] = """
SELECT series_id, item, true AS after_account FROM (
  SELECT l_linestatus AS series_id, CAST(l_partkey AS VARCHAR) AS item,
    COUNT(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) x
JOIN (SELECT l_linestatus AS series_id, COUNT(DISTINCT l_linenumber) AS n_runs
  FROM lineitem GROUP BY ALL) r USING (series_id)
WHERE n = n_runs"""
_SQL["runs_without_history"] = """
WITH runs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, MIN(CAST(l_suppkey AS VARCHAR)) AS series_id
  FROM lineitem GROUP BY l_orderkey),
series AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_returnflag AS metric
  FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1 AND MAX(l_linenumber) < 7)
SELECT id, series_id FROM runs r WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l JOIN series s ON l.l_returnflag = s.metric
  WHERE CAST(l.l_orderkey AS VARCHAR) = r.id AND s.series_id = r.series_id)"""
_SQL["display_values"] = """
WITH vals AS (
  SELECT c_custkey, CAST(kind AS INTEGER) AS kind, v FROM customer, LATERAL (VALUES
    (0, c_acctbal), (1, c_acctbal / 1000), (2, c_acctbal / 1e5), (3, 0.0),
    (4, c_custkey * 1e12)) x(kind, v))
SELECT c_custkey, kind, CASE WHEN v = 0 THEN '0' WHEN abs(v) >= 1e15 OR abs(v) < 1e-4
    THEN regexp_replace(printf('%.5e', v), '\\.?0*e', 'e') ELSE CASE WHEN abs(v) < 1 THEN printf('%.6f', v)
    WHEN abs(v) < 100 THEN printf('%.3f', v) ELSE printf('%.2f', v) END END
  || CASE WHEN kind = 1 THEN '%' ELSE '' END AS shown
FROM vals"""

# --- the whole way -----------------------------------------------------------------------------

_SQL["full_import"] = _with(DAILY, CTR, f"""long AS (
  SELECT source, entity, metric, value FROM ctr, LATERAL (VALUES ('Cost', cost),
    ('Clicks', clicks), ('Impr.', impr), ('Budget', 500.0), ('CTR', ctr),
    ('Discount rate', ROUND(COALESCE(discount, 0.0), 6))) v(metric, value)
  UNION ALL
  SELECT source, '{fixed.ACCOUNT}', metric, value FROM (
    SELECT source, day, SUM(cost) AS cost, SUM(clicks) AS clicks, SUM(impr) AS impr,
      CAST(COUNT(*) * 500 AS DOUBLE) AS budget,
      CASE WHEN SUM(impr) = 0 THEN 0.0 ELSE SUM(ctr * impr) / SUM(impr) END AS ctr,
      COALESCE(AVG(ROUND(discount, 6)), 0.0) AS rate
    FROM ctr GROUP BY ALL) x, LATERAL (VALUES ('Cost', cost), ('Clicks', clicks),
    ('Impr.', impr), ('Budget', budget), ('CTR', ctr), ('Discount rate', rate))
    v(metric, value))""") + """
SELECT source, entity, metric, COUNT(*) AS n_days, ROUND(SUM(value), 3) AS total,
  CASE WHEN entity = 'R' THEN 'paused' ELSE 'live' END AS state
FROM long GROUP BY source, entity, metric"""

_SQL["violation_counts"] = _with(
    RAGGED,
    "seen AS (SELECT source, entity, MIN(day) AS first_seen FROM ragged GROUP BY ALL)",
    """steps AS (
  SELECT source, date_diff('day', LAG(day) OVER (PARTITION BY source ORDER BY day), day) AS step
  FROM per_day)""",
) + """
SELECT * FROM (
  SELECT source, 'uneven_days' AS rule, COUNT(*) AS n FROM per_day
  JOIN first_days USING (source) WHERE n_rows <> rows_per_day GROUP BY source
  UNION ALL
  SELECT source, 'day_gap', COUNT(*) FROM steps WHERE step > 1 GROUP BY source
  UNION ALL
  SELECT source, 'entity_new', COUNT(*) FROM seen JOIN first_days USING (source)
  WHERE first_seen > first_day AND rows_per_day > 1 GROUP BY source
  UNION ALL
  SELECT s.source, 'entity_missing', COUNT(*)
  FROM seen s JOIN first_days f USING (source) JOIN per_day p USING (source)
  WHERE first_seen = first_day AND rows_per_day > 1 AND NOT EXISTS (
    SELECT 1 FROM ragged r WHERE r.source = s.source AND r.entity = s.entity AND r.day = p.day)
  GROUP BY s.source) x"""

_SQL["broken_exports"] = _with(DAILY, f"""per AS (
  SELECT source, day, CAST(SUM(clicks) AS BIGINT) AS clicks,
    ROW_NUMBER() OVER (PARTITION BY source ORDER BY day) - 1 AS i FROM dense GROUP BY source, day),
base AS (
  SELECT source, COUNT(*) AS n, MIN(day) AS lo, arg_min(clicks, day) AS c0,
    COUNT(*) FILTER (i % 100 = 7) AS n7, COUNT(*) FILTER (i % 50 = 5) AS n5,
    COUNT(*) FILTER (i % 60 = 20 AND i + 1 < (SELECT MAX(i) + 1 FROM per q WHERE q.source = per.source))
      AS n20
  FROM per GROUP BY source),
met AS (
  SELECT source, x.* FROM base, LATERAL (VALUES
    ('zip', 'not_a_csv', NULL, NULL, NULL, NULL, 'zip', 1),
    ('pdf', 'not_a_csv', NULL, NULL, NULL, NULL, 'pdf', 1),
    ('tabs', 'not_a_csv', NULL, NULL, NULL, NULL, 'tabs', 1),
    ('semicolons', 'not_a_csv', NULL, NULL, NULL, NULL, 'semicolons', 1),
    ('wide', 'too_large', 1, NULL, NULL, NULL, NULL, n + 1),
    ('quote', 'malformed', 11, NULL, NULL, NULL, NULL, 1),
    ('title', 'too_few_columns', 1, NULL, NULL, NULL, 'title rows', 1),
    ('latin', 'header_not_utf8', NULL, NULL, NULL, NULL, NULL, 1),
    ('summary', 'no_dates', NULL, NULL, NULL, NULL, NULL, 1),
    ('ragged', 'ragged_rows', 9, NULL, NULL, NULL, '3 of 2', n7),
    ('empty', 'no_rows', NULL, NULL, NULL, NULL, NULL, 1),
    ('ambiguous', 'date_order_undecided', NULL, NULL, NULL, NULL, NULL, 1),
    ('second', 'unreadable_date', 2, NULL, NULL, 'Day', CAST(c0 AS VARCHAR), n),
    ('uneven', 'uneven_days', NULL, lo + 5, NULL, NULL, '1 rows, not 2', n5),
    ('typo', 'bad_cell', 5, NULL, NULL, 'Clicks', '2 unreadable', 1),
    ('same', 'same_column_name', NULL, NULL, NULL, 'clicks', NULL, 1),
    ('words', 'nothing_to_forecast', NULL, NULL, NULL, NULL, NULL, 1),
    ('money', 'mixed_currency', NULL, NULL, NULL, NULL, NULL, 1),
    ('groups', 'group_column', NULL, NULL, NULL, NULL, 'several', 1),
    ('measures', 'group_column', NULL, NULL, NULL, NULL, 'only_measures', 1),
    ('account', 'named_account', 3, NULL, '{fixed.ACCOUNT}', NULL, NULL, n),
    ('twice', 'entity_twice', NULL, lo + 20, 'A', NULL, NULL, 1),
    ('overflow', 'overflow', NULL, lo, '{fixed.ACCOUNT}', 'Clicks', NULL, n),
    ('weekly', 'segmented', NULL, NULL, NULL, NULL, 'weekly', 1),
    ('gap', 'day_gap', NULL, lo + 21, NULL, NULL,
      '1 missing after ' || CAST(CAST(lo + 19 AS DATE) AS VARCHAR), n20),
    ('short', 'too_short', NULL, NULL, NULL, NULL, '20 days, {fixed.MIN_DAYS} needed', 1)
  ) x(kind, rule, row_num, day, entity, column_name, detail, n))""") + """
SELECT kind || '_' || source AS source, rule, CAST(row_num AS BIGINT) AS row_num,
  CAST(day AS DATE) AS day, entity, column_name, detail, CAST(n AS BIGINT) AS n FROM met"""
_SQL["group_hints"] = """
SELECT source, asked, 'group_column' AS rule, detail
FROM (SELECT DISTINCT l_linestatus AS source FROM lineitem), (VALUES ('item', 'count_by_case'),
  ('Team', 'count'), ('Clicks', 'measured'), ('Nothing', 'unknown')) v(asked, detail)"""
_SQL["refused_requests"] = """
SELECT source, rule, entity, column_name, detail
FROM (SELECT DISTINCT l_linestatus AS source FROM lineitem), (VALUES
  ('column_not_forecastable', NULL, 'Campaign', 'text'),
  ('column_not_forecastable', NULL, 'No such', 'unknown'),
  ('entity_not_forecast', 'nobody', NULL, 'unknown'),
  ('future_input', NULL, 'Clicks', 'length differs from the horizon'),
  ('future_input', NULL, 'No such', 'length differs from the horizon'),
  ('future_input', NULL, 'No such', 'not a numeric column')) v(rule, entity, column_name, detail)"""

# --- storage and streams ----------------------------------------------------------------------

_SQL["store_replace"] = _with(PANEL) + """
SELECT source AS series_id, entity, metric, COUNT(*) AS n_days, ROUND(SUM(value), 3) AS total
FROM panel JOIN spans USING (source)
WHERE source <> 'F' OR date_diff('day', day, hi) < 30 GROUP BY ALL"""
_SQL["published_versions"] = _with(PANEL) + """
SELECT CAST(1 AS INTEGER) AS version, source AS series_id, entity, metric, COUNT(*) AS n_days,
  ROUND(SUM(value), 3) AS total FROM panel GROUP BY ALL
UNION ALL
SELECT 2, source, entity, metric, COUNT(*), ROUND(SUM(value), 3)
FROM panel JOIN spans USING (source)
WHERE source <> 'F' OR date_diff('day', day, hi) < 30 GROUP BY ALL"""
_SQL["repeated_append"] = _with(STORED) + """
SELECT series_id, model, entity, metric, day, q_idx, CAST(1 AS BIGINT) AS n,
  ROUND(value, 4) AS value
FROM stored WHERE model LIKE 'weekday_quantile@%'"""
_SQL["ledger_import"] = _with(PANEL) + f"""
SELECT source AS series_id, COUNT(*) AS n_days, SUM(value) AS clicks,
  CAST(CASE WHEN source = 'F' THEN 2 ELSE 1 END AS BIGINT) AS n_imports,
  CAST(CASE WHEN source = 'F' THEN 6 ELSE 3 END AS BIGINT) AS n_runs,
  CAST(CASE WHEN source = 'F' THEN 2 ELSE 1 END AS BIGINT) AS n_archived
FROM panel JOIN spans USING (source)
WHERE entity = '{fixed.ACCOUNT}' AND metric = 'Clicks'
  AND (source <> 'F' OR date_diff('day', day, hi) >= 10) GROUP BY ALL"""
_SQL["late_events"] = """
WITH e AS (
  SELECT *, CAST(ts AS DATE) AS day, MIN(CAST(ts AS DATE)) OVER () AS lo,
    MAX(CAST(ts AS DATE)) OVER () AS hi FROM events),
a AS (
  SELECT *, CAST(floor(date_diff('day', lo, day) * 4.0 / (date_diff('day', lo, hi) + 1)) AS INTEGER)
    + CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS k FROM e),
marks AS (
  SELECT k, CAST(MAX(MAX(ts)) OVER (ORDER BY k) - INTERVAL 1 DAY AS DATE) AS cut FROM a GROUP BY k),
seen AS (
  SELECT a.*, COALESCE(day < m.cut, false) AS late FROM a LEFT JOIN marks m ON m.k = a.k - 1)
SELECT CASE WHEN late THEN 'late' WHEN day < (SELECT MAX(cut) FROM marks) THEN 'closed' ELSE 'open'
  END AS kind, event_type AS entity, day, COUNT(*) AS n_events, ROUND(SUM(value), 4) + 0.0 AS total
FROM seen GROUP BY ALL"""
_SQL["stored_raw"] = _with(DAILY) + """
SELECT source, CASE WHEN entity = 'R' AND day >= DATE '1999-01-01' THEN 'Paused' ELSE 'Enabled'
  END AS status, COUNT(*) AS n_rows, ROUND(SUM(cost), 2) AS cost FROM dense GROUP BY ALL"""
_SQL["closed_days_stream"] = """
SELECT event_type AS entity, CAST(ts AS DATE) AS day, COUNT(*) AS n_events,
  ROUND(SUM(value), 4) + 0.0 AS total
FROM events WHERE CAST(ts AS DATE) < (SELECT MAX(CAST(ts AS DATE)) FROM events) GROUP BY ALL"""

_SQL["run_list"] = """
SELECT DISTINCT l_linestatus AS series_id, 'weekday_quantile@90d' AS model, 7 AS horizon,
  CAST(2 AS BIGINT) AS n_runs, CAST(2 AS BIGINT) AS n_ids FROM lineitem"""
_SQL["dataset_list"] = """
SELECT DISTINCT l_linestatus AS series_id, 'all' AS asked FROM lineitem
UNION ALL SELECT DISTINCT l_linestatus, 'f' FROM lineitem WHERE l_linestatus = 'F'"""
_SQL["series_read"] = _with(PANEL) + f"""
SELECT source AS series_id, day, ROUND(value, 4) + 0.0 AS value FROM panel JOIN spans USING (source)
WHERE entity = '{fixed.ACCOUNT}' AND metric = 'Cost' AND date_diff('day', day, hi) >= 2"""
_SQL["forecast_days"] = _with(PANEL, AHEAD) + """
SELECT source AS series_id, CAST(hi - 7 + CAST(h AS INTEGER) AS DATE) AS day,
  CAST(2 AS BIGINT) AS n_runs
FROM spans, ahead"""
_SQL["cleared_store"] = _with(PANEL) + """
SELECT source AS series_id, COUNT(*) AS n FROM panel GROUP BY source
UNION ALL SELECT t, 0 FROM (VALUES ('raw'), ('series'), ('columns'), ('runs'), ('run_entities'),
  ('models'), ('forecasts'), ('files')) v(t)"""

_SQL["import_scored"] = _with(DAILY, CTR, f"""panel AS (
  SELECT source, entity, day, metric, value FROM ctr, LATERAL (VALUES ('Cost', cost),
    ('Clicks', clicks), ('Impr.', impr), ('CTR', ctr),
    ('Discount rate', ROUND(COALESCE(discount, 0.0), 6))) v(metric, value)
  WHERE entity <> 'R'
  UNION ALL
  SELECT source, '{fixed.ACCOUNT}', day, metric, value FROM (
    SELECT source, day, SUM(cost) AS cost, SUM(clicks) AS clicks, SUM(impr) AS impr,
      CASE WHEN SUM(impr) = 0 THEN 0.0 ELSE SUM(ctr * impr) / SUM(impr) END AS ctr,
      COALESCE(AVG(ROUND(discount, 6)), 0.0) AS rate
    FROM ctr GROUP BY ALL) x, LATERAL (VALUES ('Cost', cost), ('Clicks', clicks),
    ('Impr.', impr), ('CTR', ctr), ('Discount rate', rate)) v(metric, value))""",
    history(), AHEAD, IDX, NAIVE, WEEKDAY, TREND, """plain AS (
  SELECT series_id, entity, metric, model || '@' || "window" AS model, "window" AS w, day, q_idx,
    CASE WHEN metric IN ('Cost', 'Clicks', 'Impr.') THEN greatest(value, 0.0) ELSE value END AS value
  FROM (SELECT * FROM naive UNION ALL SELECT * FROM weekday UNION ALL SELECT * FROM trend) f),
stored AS (
  SELECT series_id, entity, metric, model, day, q_idx, value FROM plain
  UNION ALL
  SELECT series_id, entity, metric, 'average@90d', day, q_idx, AVG(value) FROM plain
  WHERE w = '90d' GROUP BY ALL)""") + """
SELECT series_id, model, entity, metric, day,
  ROUND(MAX(value) FILTER (q_idx = 4) + 1e-7, 3) + 0.0 AS forecast,
  ROUND(MAX(value) FILTER (q_idx = 0) + 1e-7, 3) + 0.0 AS low,
  ROUND(MAX(value) FILTER (q_idx = 8) + 1e-7, 3) + 0.0 AS high, NULL::DOUBLE AS actual, false AS trained_on
FROM stored GROUP BY series_id, model, entity, metric, day"""
