"""The registered queries as SQL over the same tables, for checking."""

from __future__ import annotations

# Fixed values, written out here again so that a wrong edge in the library is seen.
VISIT_LENGTH_BUCKETS = (
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60),
    ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None),
)
STEP_LENGTH_BUCKETS = (
    ("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60),
    ("60", 61, None),
)

ACTIONS = """
ev AS (
  SELECT *, CAST(substr(props, 7, length(props) - 7) AS INTEGER) AS k,
         CAST(ts AS DATE) AS day
  FROM events),
actions AS (
  SELECT day AS date, user_id, CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS session_id,
         CAST(k % 10 AS BIGINT) AS page_id, ts AS action_time,
         CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword,
         CASE WHEN event_type = 'click' THEN CAST(k AS BIGINT) END AS click_category_id,
         CASE WHEN event_type = 'click' THEN event_id % 100 END AS click_product_id,
         CASE WHEN event_type = 'purchase'
              THEN CAST(k AS VARCHAR) || ',' || CAST((k * 3 + 1) % 100 AS VARCHAR) END AS order_category_ids,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id % 100 AS VARCHAR) END AS order_product_ids,
         CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
         CASE WHEN event_type = 'signup' THEN CAST(event_id % 100 AS VARCHAR) END AS pay_product_ids,
         user_id % 25 AS city_id
  FROM ev)"""

# The same actions on the compressed clock: a minute of the day plays in one second.
COMPRESSED = (
    ACTIONS
    + """,
clocked AS (
  SELECT session_id, user_id,
         date + to_seconds(hour(action_time) * 60 + minute(action_time)) AS action_time
  FROM actions)"""
)

USERS = """
users AS (
  SELECT c_custkey AS user_id, c_custkey % 60 AS age, c_mktsegment AS professional,
         n_name AS city, CAST(c_custkey % 2 AS VARCHAR) AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PRODUCTS = """
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CASE WHEN p_size % 2 = 0 THEN 'Self' ELSE 'Third Party' END AS product_status
  FROM part)"""

CITIES = """
cities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _sessions(source: str) -> str:
    return f"""
sessions AS (
  SELECT session_id, arg_min(user_id, action_time) AS user_id, min(action_time) AS start_time,
         max(action_time) AS end_time, count(*) AS step_length,
         CAST(floor(epoch(max(action_time))) - floor(epoch(min(action_time))) AS BIGINT) AS visit_length
  FROM {source} GROUP BY session_id)"""


SESSIONS = _sessions("actions")

LISTS = """
lists AS (
  SELECT session_id,
         coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '') AS search_keywords
  FROM actions GROUP BY session_id),
id_lists AS (
  SELECT session_id, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c), '') AS click_category_ids
  FROM (SELECT DISTINCT session_id, click_category_id AS c FROM actions) GROUP BY session_id)"""

# The filter of the registered queries.
KEPT = (
    USERS
    + """,
kept AS (
  SELECT s.*, u.age, u.professional, u.city, u.sex
  FROM sessions s JOIN users u USING (user_id)
  WHERE u.age BETWEEN 10 AND 50
    AND u.professional IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')
    AND u.sex = '1'
    AND session_id IN (SELECT session_id FROM actions
                       WHERE search_keyword IN ('kw1', 'kw2', 'kw3', 'kw7')))"""
)

# Sessions and actions of the date range of the registered jobs.
RANGED = """
ranged AS (
  SELECT * FROM actions WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-29')"""

JOB = ", ".join([ACTIONS, RANGED, _sessions("ranged"), KEPT.replace("FROM actions", "FROM ranged")])
KEPT_ACTIONS = """
kept_actions AS (
  SELECT * FROM ranged WHERE session_id IN (SELECT session_id FROM kept))"""


def _buckets(column: str, buckets, alias: str) -> str:
    whens = " ".join(
        f"WHEN {column} >= {low} THEN '{name}'"
        if high is None
        else f"WHEN {column} BETWEEN {low} AND {high} THEN '{name}'"
        for name, low, high in buckets
    )
    return f"CASE {whens} END AS {alias}"


def _bucket_columns():
    for prefix, buckets in (
        ("visit_length", VISIT_LENGTH_BUCKETS),
        ("step_length", STEP_LENGTH_BUCKETS),
    ):
        for name, low, high in buckets:
            test = f"{prefix} >= {low}" if high is None else f"{prefix} BETWEEN {low} AND {high}"
            yield f"{prefix}_{name}", test


def _ratios(source: str) -> str:
    columns = ", ".join(
        f"floor(count(*) FILTER ({test}) * 100.0::DOUBLE / nullif(count(*), 0) + 0.5) / 100.0::DOUBLE"
        f" AS {name}_ratio"
        for name, test in _bucket_columns()
    )
    return f"SELECT count(*) AS session_count, {columns} FROM {source}"


def _bucket_rows(source: str) -> str:
    rows = [f"SELECT 'session_count' AS name, count(*) AS count FROM {source}"]
    rows += [
        f"SELECT '{name}', count(*) FROM {source} WHERE {test}" for name, test in _bucket_columns()
    ]
    return " UNION ALL ".join(rows)


def _exploded(kind: str, column: str, source: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, CAST(unnest(string_split({column}, ',')) AS BIGINT) AS category_id"
        f" FROM {source} WHERE {column} IS NOT NULL"
    )


def _uses(source: str) -> str:
    return (
        "uses AS ("
        f"SELECT 'click' AS kind, click_category_id AS category_id FROM {source}"
        " WHERE click_category_id IS NOT NULL"
        f" UNION ALL {_exploded('order', 'order_category_ids', source)}"
        f" UNION ALL {_exploded('pay', 'pay_category_ids', source)})"
    )


FUNNEL = """
funnel AS (
  SELECT category_id, count(*) FILTER (kind = 'click') AS click_count,
         count(*) FILTER (kind = 'order') AS order_count, count(*) FILTER (kind = 'pay') AS pay_count
  FROM uses GROUP BY category_id)"""
TOP = """
top AS (
  SELECT * FROM funnel ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id
  LIMIT 10)"""

AREA_COUNTS = """
area_counts AS (
  SELECT area, click_product_id, count(*) AS click_count,
         string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name)
           AS city_info
  FROM actions JOIN cities USING (city_id)
  WHERE click_product_id IS NOT NULL GROUP BY area, click_product_id)"""
AREA_RANK = """
ranked AS (
  SELECT a.*, p.product_name, p.product_status,
         row_number() OVER (PARTITION BY area ORDER BY click_count DESC, click_product_id) AS rank
  FROM area_counts a JOIN products p ON a.click_product_id = p.product_id)"""

CLICKS = (
    ACTIONS
    + ","
    + CITIES
    + """,
clicks AS (
  SELECT ts, day AS date, area AS province, city_name AS city, user_id AS userid,
         CAST(k % 20 AS BIGINT) AS adid, event_type
  FROM ev JOIN cities ON city_id = user_id % 25)"""
)
USER_AD = """
user_ad AS (
  SELECT date, userid, adid, count(*) AS click_count FROM clicks GROUP BY ALL)"""
LOGGED = """
logged AS (
  SELECT * REPLACE (replace(province, ' ', '_') AS province, replace(city, ' ', '_') AS city)
  FROM clicks WHERE event_type <> 'error')"""


def _flow() -> str:
    """The blacklist stream part by part: a part's clicks without users listed by earlier ones."""
    steps = ["list_0 AS (SELECT NULL::BIGINT AS userid WHERE false)"]
    for n in range(4):
        so_far = " UNION ALL ".join(f"SELECT * FROM part_{k}" for k in range(n + 1))
        steps += [
            f"part_{n} AS (SELECT * FROM logged WHERE hour(ts) // 6 = {n}"
            f" AND userid NOT IN (SELECT userid FROM list_{n}))",
            f"list_{n + 1} AS (SELECT userid FROM list_{n} UNION SELECT userid FROM"
            f" (SELECT date, userid, adid FROM ({so_far}) GROUP BY ALL HAVING count(*) >= 2)"
            f" SEMI JOIN part_{n} USING (date, userid, adid))",
        ]
    steps.append(f"flow AS ({so_far})")
    return ", ".join(steps)


FLOW = _flow()
PROVINCE = """
province_ad AS (
  SELECT date, province, adid, count(*) AS click_count FROM clicks GROUP BY ALL)"""


def _blacklist(name: str, where: str) -> str:
    return (
        f"{name} AS (SELECT DISTINCT userid FROM ("
        f"SELECT userid FROM clicks WHERE {where} GROUP BY date, userid, adid HAVING count(*) >= 3))"
    )


_SAMPLE_PARTS = """
cells AS (
  SELECT CAST(start_time AS DATE) AS date, hour(start_time) AS hour, count(*) AS session_count
  FROM sessions GROUP BY ALL),
quota AS (
  SELECT *, least(CAST(floor(per_day * (CAST(session_count AS DOUBLE) / day_count)) AS BIGINT),
                  session_count) AS quota
  FROM (SELECT *, CAST(sum(session_count) OVER (PARTITION BY date) AS BIGINT) AS day_count,
               (SELECT 3000 // count(DISTINCT date) FROM cells) AS per_day
        FROM cells)),
sample AS (
  SELECT session_id FROM (
    SELECT session_id, quota,
           row_number() OVER (PARTITION BY date, hour
                              ORDER BY md5('7:' || session_id), session_id) AS rn
    FROM (SELECT session_id, CAST(start_time AS DATE) AS date, hour(start_time) AS hour FROM sessions)
    JOIN quota USING (date, hour))
  WHERE rn <= quota)"""
SAMPLE = ", ".join([ACTIONS, SESSIONS, _SAMPLE_PARTS])

STAMP = "'20240131000000' AS task_id"

_ACTION_COLUMNS = """date, user_id, session_id, page_id, action_time, search_keyword,
  click_category_id, click_product_id, order_category_ids, order_product_ids,
  pay_category_ids, pay_product_ids, city_id"""

_TOP3 = """SELECT date, province, adid, click_count FROM (
  SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY click_count DESC, adid{tie}) AS rn
  FROM {source}) WHERE rn <= 3"""

_MINUTE = "date_trunc('minute', ts)"

_PERIOD_PARTS = """
pairs AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_orderdate AS a, l_shipdate AS b,
         (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS m,
         day(l_shipdate) - day(o_orderdate) AS dd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
periods AS (
  SELECT *, CASE WHEN m > 0 AND dd < 0 THEN m - 1 WHEN m < 0 AND dd > 0 THEN m + 1 ELSE m END AS mm,
         CASE WHEN m > 0 AND dd < 0
                THEN date_diff('day', CAST(a AS DATE) + to_months(CAST(m - 1 AS INTEGER)), b)
              WHEN m < 0 AND dd > 0 THEN dd - day(last_day(b)) ELSE dd END AS rest
  FROM pairs)"""

_PACKED = """
packed AS (
  SELECT session_id, 'sessionid=' || session_id || '|clickCategoryIds=' || click_category_ids
         || '|stepLength=' || CAST(step_length AS VARCHAR) AS packed,
         click_category_ids, step_length
  FROM sessions JOIN id_lists USING (session_id))"""

_VALIDITY = """
texts AS (
  SELECT d, d || ' ' || lpad(CAST(o_custkey % 26 AS VARCHAR), 2, '0') || ':30:00' AS t
  FROM (SELECT o_custkey, '2024-' || strftime(o_orderdate, '%m') || '-'
               || lpad(CAST(o_orderkey % 33 + 1 AS VARCHAR), 2, '0') AS d
        FROM orders)),
flags AS (
  SELECT TRY_CAST(d AS DATE) IS NOT NULL AS is_date, TRY_CAST(t AS TIMESTAMP) IS NOT NULL AS is_time
  FROM texts)"""


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


_SESSION_COLUMNS = "session_id, user_id, start_time, end_time, step_length, visit_length"
_ALL_LISTS = [ACTIONS, SESSIONS, LISTS]

ORACLE = {
    "action_scan": _with([ACTIONS, RANGED], f"SELECT {_ACTION_COLUMNS} FROM ranged"),
    "session_aggregate": _with(
        _ALL_LISTS,
        f"SELECT {_SESSION_COLUMNS}, search_keywords, click_category_ids"
        " FROM sessions JOIN lists USING (session_id) JOIN id_lists USING (session_id)",
    ),
    "session_user_join": _with(
        [ACTIONS, SESSIONS, USERS],
        f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex"
        " FROM sessions JOIN users USING (user_id)",
    ),
    "session_filter": _with(
        [*_ALL_LISTS, KEPT],
        f"SELECT {_SESSION_COLUMNS}, search_keywords, click_category_ids, age, professional, city, sex"
        " FROM kept JOIN lists USING (session_id) JOIN id_lists USING (session_id)",
    ),
    "filter_any_match": _with(
        [ACTIONS],
        "SELECT session_id, coalesce(bool_or(click_category_id IN (5, 50, 95)), false) AS matches"
        " FROM actions GROUP BY session_id",
    ),
    "visit_length_bucket": _with(
        [COMPRESSED, _sessions("clocked")],
        "SELECT session_id, visit_length,"
        f" {_buckets('visit_length', VISIT_LENGTH_BUCKETS, 'visit_bucket')} FROM sessions",
    ),
    "step_length_bucket": _with(
        [ACTIONS, SESSIONS],
        "SELECT session_id, step_length,"
        f" {_buckets('step_length', STEP_LENGTH_BUCKETS, 'step_bucket')} FROM sessions",
    ),
    "session_ratio_stats": _with([JOB], f"SELECT {STAMP}, * FROM ({_ratios('kept')})"),
    "session_ratio_stats_all": _with([COMPRESSED, _sessions("clocked")], _ratios("sessions")),
    "bucket_counts": _with([COMPRESSED, _sessions("clocked")], _bucket_rows("sessions")),
    "session_hour_counts": _with([SAMPLE], "SELECT * FROM cells"),
    "session_sample_quota": _with([SAMPLE], "SELECT * FROM quota"),
    "session_random_sample": _with(
        [SAMPLE, LISTS],
        f"SELECT {STAMP}, session_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,"
        " search_keywords, click_category_ids"
        " FROM sample JOIN sessions USING (session_id)"
        " JOIN lists USING (session_id) JOIN id_lists USING (session_id)",
    ),
    "session_detail": _with(
        [SAMPLE],
        f"SELECT {STAMP}, user_id, session_id, page_id, action_time, search_keyword,"
        " click_category_id, click_product_id, order_category_ids, order_product_ids,"
        " pay_category_ids, pay_product_ids"
        " FROM actions WHERE session_id IN (SELECT session_id FROM sample)",
    ),
    "session_sample_job": _with(
        [JOB, _SAMPLE_PARTS.replace("FROM sessions", "FROM kept"), LISTS.replace("FROM actions", "FROM ranged")],
        f"SELECT {STAMP}, session_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,"
        " search_keywords, click_category_ids"
        " FROM sample JOIN kept USING (session_id)"
        " JOIN lists USING (session_id) JOIN id_lists USING (session_id)",
    ),
    "filtered_actions": _with(
        [JOB, KEPT_ACTIONS], f"SELECT {_ACTION_COLUMNS} FROM kept_actions"
    ),
    "category_click_counts": _with(
        [ACTIONS],
        "SELECT click_category_id AS category_id, count(*) AS click_count FROM actions"
        " WHERE click_category_id IS NOT NULL GROUP BY ALL",
    ),
    "category_order_counts": _with(
        [ACTIONS, _uses("actions")],
        "SELECT category_id, count(*) AS order_count FROM uses WHERE kind = 'order' GROUP BY ALL",
    ),
    "category_pay_counts": _with(
        [ACTIONS, _uses("actions")],
        "SELECT category_id, count(*) AS pay_count FROM uses WHERE kind = 'pay' GROUP BY ALL",
    ),
    "category_universe": _with(
        [ACTIONS, _uses("actions")], "SELECT DISTINCT category_id FROM uses"
    ),
    "category_funnel": _with([ACTIONS, _uses("actions"), FUNNEL], "SELECT * FROM funnel"),
    "top10_category": _with(
        [JOB, KEPT_ACTIONS, _uses("kept_actions"), FUNNEL, TOP], f"SELECT {STAMP}, * FROM top"
    ),
    "category_session_counts": _with(
        [ACTIONS],
        "SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM actions"
        " WHERE click_category_id IS NOT NULL GROUP BY ALL",
    ),
    "top10_session": _with(
        [JOB, KEPT_ACTIONS, _uses("kept_actions"), FUNNEL, TOP],
        f"SELECT {STAMP}, category_id, session_id, click_count FROM ("
        " SELECT *, row_number() OVER (PARTITION BY category_id"
        "   ORDER BY click_count DESC, session_id) AS rn"
        " FROM (SELECT click_category_id AS category_id, session_id, count(*) AS click_count"
        "       FROM kept_actions"
        "       WHERE click_category_id IN (SELECT category_id FROM top) GROUP BY ALL))"
        " WHERE rn <= 10",
    ),
    "product_click_scan": _with(
        [ACTIONS],
        "SELECT city_id, click_product_id FROM actions WHERE click_product_id IS NOT NULL",
    ),
    "click_city_join": _with(
        [ACTIONS, CITIES],
        "SELECT city_id, click_product_id, city_name, area FROM actions JOIN cities USING (city_id)"
        " WHERE click_product_id IS NOT NULL",
    ),
    "area_product_counts": _with([ACTIONS, CITIES, AREA_COUNTS], "SELECT * FROM area_counts"),
    "concat_distinct": _with(
        [ACTIONS, CITIES],
        "SELECT area, string_agg(DISTINCT city_id || ':' || city_name, ','"
        " ORDER BY city_id || ':' || city_name) AS city_info"
        " FROM actions JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL GROUP BY area",
    ),
    "product_status_label": _with([PRODUCTS], "SELECT product_id, product_status FROM products"),
    "area_product_rank": _with(
        [ACTIONS, CITIES, PRODUCTS, AREA_COUNTS, AREA_RANK], "SELECT * FROM ranked"
    ),
    "area_top3_products": _with(
        [ACTIONS, CITIES, PRODUCTS, AREA_COUNTS, AREA_RANK], "SELECT * FROM ranked WHERE rank <= 3"
    ),
    "ad_log_parse": _with(
        [CLICKS, LOGGED],
        "SELECT date_trunc('millisecond', ts) AS ts, date, province, city, userid, adid FROM logged",
    ),
    "ad_log_malformed": _with(
        [CLICKS],
        "SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS malformed FROM clicks",
    ),
    "blacklist_filter": _with(
        [CLICKS, _blacklist("listed", "true")],
        "SELECT ts, date, province, city, userid, adid FROM clicks"
        " WHERE userid NOT IN (SELECT userid FROM listed)",
    ),
    "ad_user_click_count": _with([CLICKS, USER_AD], "SELECT * FROM user_ad"),
    "keyed_add_upsert": _with(
        [CLICKS], "SELECT province, adid, count(*) AS click_count FROM clicks GROUP BY ALL"
    ),
    "blacklist_candidates": _with(
        [CLICKS, USER_AD], "SELECT * FROM user_ad WHERE click_count >= 2"
    ),
    "blacklist_users": _with(
        [CLICKS, USER_AD], "SELECT DISTINCT userid FROM user_ad WHERE click_count >= 2"
    ),
    "blacklist_merge": _with(
        [
            CLICKS,
            _blacklist("old", "date < DATE '2024-01-15'"),
            _blacklist("new", "date >= DATE '2024-01-15'"),
        ],
        "SELECT userid FROM new EXCEPT SELECT userid FROM old",
    ),
    "ad_stat": _with(
        [CLICKS],
        "SELECT date, province, city, adid, count(*) AS click_count FROM clicks GROUP BY ALL",
    ),
    "keyed_set_upsert": _with(
        [CLICKS],
        "SELECT city, adid, coalesce(n.click_count, o.click_count) AS click_count"
        " FROM (SELECT city, adid, count(*) AS click_count FROM clicks"
        "       WHERE date < DATE '2024-01-15' GROUP BY ALL) o"
        " FULL JOIN (SELECT city, adid, count(*) AS click_count FROM clicks"
        "       WHERE date >= DATE '2024-01-15' GROUP BY ALL) n USING (city, adid)",
    ),
    "ad_province_counts": _with([CLICKS, PROVINCE], "SELECT * FROM province_ad"),
    "ad_province_top3": _with(
        [CLICKS, PROVINCE], _TOP3.format(scope="date, province", tie="", source="province_ad")
    ),
    "ad_province_top3_all_dates": _with(
        [CLICKS, PROVINCE], _TOP3.format(scope="province", tie=", date", source="province_ad")
    ),
    "keyed_replace": _with(
        [
            CLICKS,
            PROVINCE,
            "fresh AS (SELECT * FROM province_ad WHERE date >= DATE '2024-01-15')",
            f"old AS ({_TOP3.format(scope='date, province', tie='', source='province_ad')})".replace(
                "rn <= 3", "rn <= 5"
            ),
            f"new AS ({_TOP3.format(scope='date, province', tie='', source='fresh')})",
        ],
        "SELECT * FROM new UNION ALL SELECT * FROM old"
        " WHERE (date, province) NOT IN (SELECT (date, province) FROM new)",
    ),
    "ad_click_trend": _with(
        [CLICKS],
        f"SELECT CAST({_MINUTE} AS DATE) AS date, strftime({_MINUTE}, '%H') AS hour,"
        f" strftime({_MINUTE}, '%M') AS minute, adid, count(*) AS click_count"
        " FROM clicks GROUP BY ALL",
    ),
    "ad_click_sliding": _with(
        [
            CLICKS,
            "spread AS (SELECT adid, time_bucket(INTERVAL 10 MINUTE, ts)"
            " - to_minutes(10 * unnest(range(6))) AS window_start FROM clicks)",
        ],
        "SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, adid,"
        " count(*) AS click_count FROM spread GROUP BY ALL",
    ),
    "stream_ad_blacklist": _with([CLICKS, LOGGED, FLOW], "SELECT userid FROM list_4"),
    "stream_ad_user_click_count": _with(
        [CLICKS, LOGGED, FLOW],
        "SELECT date, userid, adid, count(*) AS click_count FROM flow GROUP BY ALL",
    ),
    "stream_ad_province_top3": _with(
        [
            CLICKS,
            LOGGED,
            FLOW,
            "counted AS (SELECT date, province, adid, count(*) AS click_count FROM flow GROUP BY ALL)",
        ],
        _TOP3.format(scope="date, province", tie="", source="counted"),
    ),
    "stream_ad_line_counts": (
        "SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS malformed FROM events"
    ),
    "stream_ad_click_sliding": _with(
        [
            CLICKS,
            LOGGED,
            "spread AS (SELECT adid, time_bucket(INTERVAL 10 MINUTE, ts)"
            " - to_minutes(10 * unnest(range(6))) AS window_start FROM logged)",
        ],
        "SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, adid,"
        " count(*) AS click_count FROM spread GROUP BY ALL",
    ),
    "stream_ad_stat": _with(
        [CLICKS, LOGGED],
        "SELECT date, province, city, adid, count(*) AS click_count FROM logged GROUP BY ALL",
    ),
    "stream_ad_click_trend": _with(
        [CLICKS, LOGGED],
        f"SELECT CAST({_MINUTE} AS DATE) AS date, strftime({_MINUTE}, '%H') AS hour,"
        f" strftime({_MINUTE}, '%M') AS minute, adid, count(*) AS click_count"
        " FROM logged GROUP BY ALL",
    ),
    "date_diff_features": _with(
        [_PERIOD_PARTS],
        "SELECT l_orderkey, l_linenumber, (epoch_ms(b) - epoch_ms(a)) / 3600000.0::DOUBLE AS diff_hours,"
        " date_sub('minute', a, b) AS diff_minutes, date_sub('second', a, b) AS diff_seconds,"
        " date_sub('day', a, b) AS diff_full_days, date_diff('day', a, b) AS diff_calendar_days,"
        " CAST(CAST(trunc(mm / 12.0) AS INTEGER) AS VARCHAR) || ','"
        "   || CAST(mm - 12 * CAST(trunc(mm / 12.0) AS INTEGER) AS VARCHAR) || ','"
        "   || CAST(rest AS VARCHAR) AS diff_period,"
        " year(b) - year(a) - CASE WHEN strftime(b, '%m%d') < strftime(a, '%m%d') THEN 1 ELSE 0 END"
        "   AS completed_years,"
        " CAST(sign(epoch(b) - epoch(a)) AS BIGINT) * -1 AS time_order FROM periods",
    ),
    "date_part_features": (
        "SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text,"
        " date_trunc('second', ts) AS parsed_time, date_trunc('day', ts) AS day_start,"
        " date_trunc('day', ts) + INTERVAL 1 DAY AS next_day_start,"
        " date_trunc('day', ts) - INTERVAL 1 SECOND AS previous_day_end,"
        " ts + INTERVAL 7 DAY AS plus_days, ts + INTERVAL 1 YEAR AS plus_years,"
        " dayofweek(ts) AS weekday,"
        " ['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六'][dayofweek(ts) + 1]"
        "   AS weekday_name,"
        " strftime(ts, '%Y-%m-%d_%H') AS date_hour FROM events"
    ),
    "calendar_spine": _with(
        [
            "daily AS (SELECT CAST(o_orderdate AS DATE) AS date,"
            + ",".join(
                f" count(*) FILTER (o_orderpriority LIKE '{n}-%') AS orders_{n}" for n in range(1, 6)
            )
            + " FROM orders GROUP BY ALL)",
            "spine AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))"
            " AS DATE) AS date FROM daily)",
        ],
        "SELECT date,"
        + ",".join(f" coalesce(orders_{n}, 0) AS orders_{n}" for n in range(1, 6))
        + " FROM spine LEFT JOIN daily USING (date)",
    ),
    "week_calendar": _with(
        [
            "weeks AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start"
            " FROM orders)"
        ],
        "SELECT week_start, CAST(week_start + to_days(CAST(n AS INTEGER)) AS DATE) AS date"
        " FROM weeks, range(7) AS r(n)",
    ),
    "stepped_calendar": _with(
        ["days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS start_date FROM orders)"],
        "SELECT start_date, n AS position,"
        " CAST(start_date - to_days(CAST(7 * (2 - n) AS INTEGER)) AS DATE) AS date"
        " FROM days, range(3) AS r(n)",
    ),
    "date_validity_report": _with(
        [_VALIDITY],
        "SELECT count(*) AS rows, count(*) FILTER (is_time) AS valid_times,"
        " count(*) FILTER (NOT is_time) AS invalid_times, count(*) FILTER (is_date) AS valid_dates,"
        " count(*) FILTER (NOT is_date) AS invalid_dates FROM flags",
    ),
    "kv_field_extract": _with(
        [*_ALL_LISTS, _PACKED],
        "SELECT session_id, session_id AS sessionid, nullif(click_category_ids, '') AS"
        ' "clickCategoryIds", CAST(step_length AS VARCHAR) AS "stepLength",'
        " CAST(NULL AS VARCHAR) AS age FROM packed",
    ),
    "kv_field_rewrite": _with(
        [*_ALL_LISTS, _PACKED],
        "SELECT session_id, 'sessionid=' || session_id || '|clickCategoryIds=none|stepLength='"
        " || CAST(step_length AS VARCHAR) AS packed FROM packed",
    ),
    "text_normalise": _with(
        [
            ACTIONS,
            "items AS (SELECT event_id, CASE event_type WHEN 'click' THEN ',' || k || ','"
            " WHEN 'view' THEN '' WHEN 'error' THEN NULL ELSE CAST(k AS VARCHAR) END AS item FROM ev)",
        ],
        "SELECT event_id, item, coalesce(item, '') = '' AS is_empty,"
        " regexp_replace(item, '^,|,$', '', 'g') AS comma_trimmed,"
        " CASE WHEN length(item) < 2 THEN lpad(item, 2, '0') ELSE item END AS padded FROM items",
    ),
    "ratio_round": (
        "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) AS orders,"
        " floor(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*) + 0.5)"
        " / 100.0::DOUBLE AS finished_ratio"
        " FROM orders GROUP BY o_custkey"
    ),
}

_FLOW_PAGES = (1, 2, 3, 4, 5, 6, 7)


def _page_steps() -> str:
    """One row per step of the flow, from counts of adjacent pages."""
    count = lambda a, b: f"(SELECT count(*) FROM steps WHERE previous = {a} AND page_id = {b})"
    rows, reached = [], f"(SELECT count(*) FROM steps WHERE page_id = {_FLOW_PAGES[0]})"
    for n, (a, b) in enumerate(zip(_FLOW_PAGES, _FLOW_PAGES[1:], strict=False), 1):
        taken = count(a, b)
        rows.append(
            f"SELECT {n}::BIGINT AS step, {a}::BIGINT AS from_page, {b}::BIGINT AS to_page,"
            f" {taken} AS transitions, {reached} AS reached"
        )
        reached = taken
    return (
        "SELECT *, floor(transitions * 100.0::DOUBLE / nullif(reached, 0) + 0.5) / 100.0::DOUBLE"
        f" AS conversion_ratio FROM ({' UNION ALL '.join(rows)})"
    )


def _islands(source: str, user: str, time: str) -> str:
    """Rows numbered by sessions that end after six hours of rest."""
    return f"""
timed AS (
  SELECT {user}, {time} AS t, lag({time}) OVER (PARTITION BY {user} ORDER BY {time}) AS before
  FROM {source}),
islands AS (
  SELECT {user}, t, sum(CASE WHEN before IS NULL OR t - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                      OVER (PARTITION BY {user} ORDER BY t ROWS UNBOUNDED PRECEDING) AS island
  FROM timed)"""


def _ratio_sets(by: str, sets: str) -> str:
    figures = _ratios("sessions JOIN users USING (user_id)").replace("SELECT ", "", 1)
    return f"SELECT {by}, GROUPING({by})::BIGINT AS grouping_id, {figures} GROUP BY GROUPING SETS ({sets})"


# Lines as the log holds them, in whole milliseconds.
_LINES = """
lines AS (
  SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM logged)"""

_LATE = """
hours AS (
  SELECT hour(ts) // 6 AS part, date_trunc('hour', ts) AS window_start, adid FROM lines),
marks AS (
  SELECT n AS part, (SELECT max(ts) FROM lines WHERE hour(ts) // 6 < n) - INTERVAL 600 SECOND AS mark
  FROM range(4) AS r(n)),
judged AS (
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, adid,
         coalesce(window_start + INTERVAL 1 HOUR <= mark, false) AS late
  FROM hours JOIN marks USING (part))"""

ORACLE |= {
    "page_step_conversion": _with(
        [
            ACTIONS,
            "steps AS (SELECT page_id, lag(page_id) OVER"
            " (PARTITION BY session_id ORDER BY action_time, page_id) AS previous"
            " FROM actions WHERE page_id IS NOT NULL)",
        ],
        _page_steps(),
    ),
    "gap_sessions": _with(
        [ACTIONS, _islands("actions", "user_id", "action_time")],
        "SELECT user_id, CAST(island AS BIGINT) AS gap_session, min(t) AS start_time, max(t) AS end_time,"
        " count(*) AS step_length,"
        " CAST(floor(epoch(max(t))) - floor(epoch(min(t))) AS BIGINT) AS visit_length"
        " FROM islands GROUP BY user_id, island",
    ),
    "click_last_view": _with(
        [ACTIONS],
        "SELECT c.event_id, c.user_id, c.ts, v.ts AS viewed_at, CAST(v.k % 10 AS BIGINT) AS viewed_page"
        " FROM (SELECT * FROM ev WHERE event_type = 'click') c"
        " ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v"
        " ON c.user_id = v.user_id AND c.ts >= v.ts",
    ),
    "session_ratio_sets": _with(
        [COMPRESSED, _sessions("clocked"), USERS],
        _ratio_sets("age, professional, city, sex", "(age), (professional), (city), (sex), ()"),
    ),
    "session_ratio_cube": _with(
        [COMPRESSED, _sessions("clocked"), USERS],
        _ratio_sets("professional, sex", "(professional, sex), (professional), (sex), ()"),
    ),
    "session_sketch_days": _with(
        [COMPRESSED, _sessions("clocked")],
        "SELECT CAST(start_time AS DATE) AS date, count(*) AS session_count,"
        " count(DISTINCT user_id) AS exact_users, true AS users_within, true AS median_within"
        " FROM sessions GROUP BY ALL",
    ),
    "partition_replace": ORACLE["keyed_replace"],
    "stream_ad_stat_state": ORACLE["stream_ad_stat"],
    "stream_ad_unique": _with(
        [CLICKS, LOGGED, _LINES],
        "SELECT date, province, city, adid, count(*) AS click_count"
        " FROM (SELECT DISTINCT date, province, city, adid, userid, ts FROM lines) GROUP BY ALL",
    ),
    "stream_click_sessions": _with(
        [CLICKS, LOGGED, _LINES, _islands("lines", "userid", "ts")],
        "SELECT userid, min(t) AS start_time, max(t) AS end_time, count(*) AS click_count"
        " FROM islands GROUP BY userid, island HAVING max(t) + INTERVAL 6 HOUR"
        " <= (SELECT max(ts) FROM lines) - INTERVAL 1 HOUR",
    ),
    "stream_ad_window_late": _with(
        [CLICKS, LOGGED, _LINES, _LATE],
        "SELECT window_start, window_end, adid, count(*) FILTER (NOT late) AS on_time,"
        " count(*) FILTER (late) AS late FROM judged GROUP BY window_start, window_end, adid",
    ),
    "stream_ad_arrival_hour": _with(
        [
            CLICKS,
            LOGGED,
            "counted AS (SELECT hour(ts) // 6 AS part, adid, count(*) AS n FROM logged GROUP BY ALL)",
        ],
        "SELECT TIMESTAMP '2024-03-01 12:00:00' + to_minutes(CAST(25 * part AS INTEGER)) AS as_of, adid,"
        " CAST(sum(n) OVER (PARTITION BY adid ORDER BY part RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"
        " AS BIGINT) AS click_count FROM counted",
    ),
}
