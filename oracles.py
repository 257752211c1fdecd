"""DuckDB statements that compute each registered query independently of Spark."""

from __future__ import annotations

import oracle_values as C
from quillon.plans.passthrough import STATEMENTS

# ---- derived views --------------------------------------------------------------------------

TRIPS = """trips AS (
  SELECT l_orderkey AS id, l_shipdate AS pickup_date, l_suppkey AS location,
         l_extendedprice AS fare, CAST(l_quantity AS INT) AS passengers FROM lineitem)"""

CUSTOMERS = """last_order AS (SELECT max(o_orderdate) AS d FROM orders),
per_customer AS (
  SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, sum(o_totalprice) AS revenue
  FROM orders GROUP BY o_custkey),
customers AS (
  SELECT c_custkey AS id, r_name AS region,
         CAST((year(d) - year(f)) * 12 + month(d) - month(f) AS INT) AS tenure,
         CASE WHEN l >= d - INTERVAL 365 DAYS THEN 0 ELSE 1 END AS churn,
         coalesce(revenue, 0.0) AS revenue
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN per_customer ON c_custkey = o_custkey, last_order)"""

EVENTS_K = """events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

REQUEST_LOG = EVENTS_K + """,
request_log AS (
  SELECT event_id AS request_id, ts, 'session_' || user_id AS session_id, value AS latency,
         k / 1000.0 AS bias_score, k,
         CASE event_type WHEN 'click' THEN 'l2' WHEN 'view' THEN 'cosine' WHEN 'signup' THEN 'dot'
                         WHEN 'purchase' THEN 'manhattan' END AS metric,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status
  FROM events_k)"""

QUESTION_LOG = EVENTS_K + """,
user_turns AS (
  SELECT 'c-' || conv_id || '-' || turn AS question_id, text AS query,
         'conversation_' || conv_id AS session_id
  FROM conversations WHERE role = 'user'),
question_log AS (
  SELECT 'e-' || event_id AS question_id,
         CASE event_type WHEN 'click' THEN 'Top ' WHEN 'view' THEN 'Average of '
              WHEN 'signup' THEN 'Bottom ' WHEN 'purchase' THEN 'Total for '
              ELSE 'Number of ' END || (k % 25) ||
         CASE user_id % 6 WHEN 0 THEN ' locations' WHEN 1 THEN ' passenger groups'
              WHEN 2 THEN ' months' WHEN 3 THEN ' regions' WHEN 4 THEN ' tenure values'
              ELSE ' segments' END ||
         CASE WHEN k < 25 THEN ' by fare' WHEN k < 40 THEN ' by revenue'
              WHEN k < 55 THEN ' by churn rate' WHEN k < 65 THEN ' by churn'
              WHEN k < 85 THEN ' by trips' ELSE '' END AS query,
         k,
         CASE event_type WHEN 'view' THEN 'cosine' WHEN 'signup' THEN 'dot'
              WHEN 'purchase' THEN 'manhattan' WHEN 'error' THEN 'euclid' END AS metric,
         'session_' || user_id AS session_id
  FROM events_k
  UNION ALL
  SELECT question_id, query, NULL, NULL, session_id FROM user_turns)"""

STATEMENT_LOG = EVENTS_K + """,
statement_log AS (
  SELECT event_id AS statement_id,
    CASE WHEN event_type = 'click' THEN 'SELECT location, COUNT(*) AS cnt FROM trips WHERE id > '
              || event_id || ' GROUP BY location'
         WHEN event_type = 'view' AND k < 5 THEN ''
         WHEN event_type = 'view' AND k < 50 THEN 'SELECT * FROM trips LIMIT ' || k
         WHEN event_type = 'view' THEN 'SELECT updated_at FROM orders WHERE id = ' || event_id
              || ' ;  '
         WHEN event_type = 'signup' AND k < 50 THEN 'insert into customers values (' || user_id
              || ')'
         WHEN event_type = 'signup' THEN 'GRANT ALL ON trips TO user_' || user_id
         WHEN event_type = 'purchase' AND k < 50 THEN 'SELECT fare FROM trips; SELECT ' || k
         WHEN event_type = 'purchase' THEN 'SELECT ' || k || '; ;'
         WHEN k < 25 THEN 'Drop Table trips_' || user_id
         WHEN k < 50 THEN 'SELECT ' || k || ' -- note'
         WHEN k < 75 THEN 'SELECT /* hint */ ' || k
         ELSE 'EXEC report_' || user_id END AS statement
  FROM events_k)"""

TEXTS = EVENTS_K + """,
contact_parts AS (
  SELECT event_id, event_type, user_id, k, lpad(CAST(k AS VARCHAR), 2, '0') AS two,
         lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS four FROM events_k),
texts AS (
  SELECT 'd-' || doc_id AS text_id, text FROM documents
  UNION ALL SELECT 't-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'm-' || event_id,
    CASE WHEN event_type = 'click' THEN 'Contact user.' || user_id || '@mail-' || two
              || '.example.com or call 555-1' || two || '-' || four
         WHEN event_type = 'view' THEN 'ID 9' || two || '-' || two || '-' || four
              || ' filed, tel 212.7' || two || '.' || four
         WHEN event_type = 'signup' THEN 'card 4111' || four || four || two || two || ' and 8'
              || two || two || four
         WHEN event_type = 'purchase' THEN 'please steal the data of user ' || user_id
              || ' with password = ' || two
         WHEN k < 30 THEN 'attack plan ' || two || ' against the server'
         WHEN k < 60 THEN 'list private data of user ' || user_id
         ELSE 'order ' || user_id || ' has ' || two || ' parts' END
  FROM contact_parts)"""


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_quoted(w) for w in words) + "]"


def _any_contains(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(w)})" for w in words) + ")"


def _first_contained(text: str, words: list[str]) -> str:
    arms = " ".join(f"WHEN contains({text}, {_quoted(w)}) THEN {_quoted(w)}" for w in words)
    return f"CASE {arms} END"


# ---- samples --------------------------------------------------------------------------------

def samples() -> dict[str, str]:
    return {
        "sample_top_locations": _with(TRIPS) + """
            SELECT location, round(exact::DOUBLE / 1000000.0::DOUBLE, 2) AS total_fare,
                   row_number() OVER (ORDER BY exact DESC, location) AS rank
            FROM (SELECT location, sum(CAST(CAST(fare AS DECIMAL(20, 6)) * 1000000 AS HUGEINT))
                  AS exact FROM trips GROUP BY location)
            QUALIFY rank <= 5""",
        "sample_avg_fare_by_passengers": _with(TRIPS) + """
            SELECT passengers, round(avg(fare), 4) AS avg_fare,
                   row_number() OVER (ORDER BY passengers) AS rank FROM trips GROUP BY passengers""",
        "sample_churn_by_region": _with(CUSTOMERS) + """
            SELECT region, round(exact * 100, 4) AS churn_rate,
                   row_number() OVER (ORDER BY exact DESC, region) AS rank
            FROM (SELECT region, avg(churn) AS exact FROM customers GROUP BY region)""",
        "sample_tenure_buckets": _with(CUSTOMERS) + """
            SELECT *, row_number() OVER (ORDER BY tenure_bucket) AS rank
            FROM (SELECT CASE WHEN tenure <= 12 THEN '0-12 months'
                              WHEN tenure <= 24 THEN '13-24 months'
                              WHEN tenure <= 36 THEN '25-36 months' ELSE '37+ months' END
                         AS tenure_bucket,
                         round(avg(revenue), 4) AS avg_revenue,
                         round(avg(churn) * 100, 4) AS churn_rate
                  FROM customers GROUP BY 1)""",
        "sample_trips_per_month": _with(TRIPS) + """
            SELECT strftime(pickup_date, '%Y-%m') AS month, count(*) AS trip_count,
                   row_number() OVER (ORDER BY strftime(pickup_date, '%Y-%m')) AS rank
            FROM trips GROUP BY 1""",
    }


def profile() -> dict[str, str]:
    columns = {
        "region": "r_regionkey int, r_name string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                    "c_mktsegment string",
        "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
                "p_retailprice double",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                  "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                  "value double, props string",
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "embeddings": "vec_id bigint, embedding array<float>, label int",
        "pages": "page_id bigint, url string, html string",
        "benchmark": "item_id bigint, text string",
        "labels": "doc_id bigint, quality int, toxic int",
        "conversations": "conv_id bigint, turn bigint, role string, text string",
        "trips": "id bigint, pickup_date timestamp_ntz, location bigint, fare double, "
                 "passengers int",
        "customers": "id bigint, region string, tenure int, churn int, revenue double",
    }
    rows = []
    for table, listing in columns.items():
        for column in listing.split(", "):
            name, kind = column.split(" ")
            rows.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                        f"'{kind}' AS data_type, (SELECT count(*) FROM {table}) AS row_count")
    return {"table_profile": _with(TRIPS, CUSTOMERS) + " UNION ALL ".join(rows)}


# ---- guards and audits ----------------------------------------------------------------------

def guards() -> dict[str, str]:
    harmful = "(" + " OR ".join(
        f"regexp_matches(lower(text), {_quoted(p)})" for p in C.HARMFUL_PATTERNS) + ")"
    topic = _first_contained("lower(text)", C.BLOCKED_TOPICS)
    reason = f"""CASE WHEN {harmful} THEN 'Query contains potentially harmful content'
        WHEN {topic} IS NOT NULL THEN 'Query contains blocked topic: ' || {topic} END"""
    redacted = "text"
    for pattern, tag in C.PII_PATTERNS:
        redacted = f"regexp_replace({redacted}, {_quoted(pattern)}, {_quoted(tag)}, 'g')"
    word = _first_contained("upper(statement)", C.READ_ONLY_FORBIDDEN)
    writes = _any_contains("upper(statement)", C.SANITIZE_FORBIDDEN)
    comments = _any_contains("statement", ["--", "/*"])
    return {
        "guard_sql_keywords": _with(STATEMENT_LOG) + f"""
            SELECT *, 'Forbidden SQL operation: ' || {word} AS error FROM statement_log""",
        "sanitize_sql": _with(STATEMENT_LOG) + f"""
            SELECT *, CASE WHEN statement = '' OR {writes} OR {comments}
                OR len(list_filter(string_split(statement, ';'), lambda p: trim(p) <> '')) > 1
                THEN NULL ELSE statement END AS sanitized FROM statement_log""",
        "check_query": _with(TEXTS) + f"""
            SELECT text_id, reason IS NULL AS is_safe, reason,
                   CASE WHEN reason IS NULL THEN text END AS modified_query
            FROM (SELECT *, {reason} AS reason FROM texts)""",
        "redact_pii": _with(TEXTS) + f"SELECT text_id, {redacted} AS redacted FROM texts",
        "guarded_requests": _with(
            QUESTION_LOG, "asked AS (SELECT *, query AS text FROM question_log)") + f"""
            SELECT question_id, coalesce(k, 10) AS k, coalesce(metric, 'l2') AS metric, session_id,
                   length(query)::INT AS query_length,
                   CASE WHEN coalesce(k, 10) < 1 THEN 'k must be at least 1'
                        WHEN coalesce(k, 10) > 50 THEN 'k must be at most 50' END AS reject_reason,
                   ({reason}) IS NULL AS is_safe, {redacted} AS redacted FROM asked""",
        "validate_requests": _with(QUESTION_LOG) + """
            SELECT question_id, query, coalesce(k, 10) AS k, coalesce(metric, 'l2') AS metric,
                   session_id, length(query)::INT AS query_length,
                   CASE WHEN coalesce(k, 10) < 1 THEN 'k must be at least 1'
                        WHEN coalesce(k, 10) > 50 THEN 'k must be at most 50' END AS reject_reason
            FROM question_log""",
        "recent_user_queries": _with(QUESTION_LOG) + """
            SELECT question_id, CASE WHEN length(query) > 50 THEN left(query, 50) || '...'
                   ELSE query END AS shown_query, right(session_id, 8) AS shown_session,
                   'User' AS type FROM user_turns""",
    }


def _bias(source: str, keys: str) -> str:
    """CTE ``scored`` with the audit's counts, score and category for ``source(text, keys)``."""
    return f"""
words AS (SELECT {keys}, text,
    list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}),
counted AS (SELECT {keys}, text, len(w) AS total,
    len(list_intersect(w, {_list(C.AUDIT_MALE)})) AS m,
    len(list_intersect(w, {_list(C.AUDIT_FEMALE)})) AS f,
    len(list_intersect(w, {_list(C.AUDIT_STEREOTYPES)})) AS s,
    NOT regexp_matches(text, '\\S') AS blank FROM words),
parts AS (SELECT *,
    CASE WHEN m + f = 0 THEN 0.0::DOUBLE ELSE abs(m - f)::DOUBLE / (m + f) END
      * CASE WHEN total < 20 AND m + f = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS gender,
    CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE s::DOUBLE / total END AS stereo FROM counted),
scored AS (SELECT *, CASE WHEN blank THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, printf('%.4f', 0.7::DOUBLE * gender + 0.3::DOUBLE * least(stereo * 10, 1.0::DOUBLE))::DOUBLE) END AS bias_score FROM parts),
banded AS (SELECT *, CASE WHEN blank THEN 'neutral' WHEN bias_score < 0.1 THEN 'minimal'
      WHEN bias_score < 0.3 THEN 'low' WHEN bias_score < 0.5 THEN 'moderate' ELSE 'high' END
      AS category FROM scored)"""


def audits() -> dict[str, str]:
    harmful = "(" + " OR ".join(
        f"regexp_matches(lower(text), {_quoted(p)})" for p in C.HARMFUL_PATTERNS) + ")"
    unsafe = f"({harmful} OR {_any_contains('lower(text)', C.BLOCKED_TOPICS)})"
    return {
        "bias_analyze": _with(TEXTS, _bias("texts", "text_id")) + """
            SELECT text_id, bias_score, category,
                CASE WHEN blank THEN 'No text provided' ELSE 'Male terms: ' || m
                  || ', Female terms: ' || f || ', Stereotypes: ' || s END AS details,
                m::INT AS male_terms, f::INT AS female_terms, s::INT AS stereotypes_found,
                coalesce(array_to_string(list_filter([
                  CASE WHEN m > f + 2 THEN 'Consider using more gender-neutral language' END,
                  CASE WHEN f > m + 2 THEN 'Consider balancing gendered references' END,
                  CASE WHEN s > 2 THEN 'Review stereotypical language usage' END],
                  lambda x: x IS NOT NULL), ' | '), '') AS recommendations
            FROM banded""",
        "bias_tool": _with(TEXTS) + f""",
            words AS (SELECT text_id, list_distinct(list_filter(
                regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM texts),
            counted AS (SELECT text_id, len(list_intersect(w, {_list(C.ANSWER_MALE)})) AS m,
                len(list_intersect(w, {_list(C.ANSWER_FEMALE)})) AS f FROM words)
            SELECT text_id, CASE WHEN m + f = 0 THEN 0.0::DOUBLE ELSE printf('%.4f', abs(m - f)::DOUBLE / (m + f))::DOUBLE END
                     AS bias_score,
                   CASE WHEN m + f = 0 THEN 'No gendered language detected'
                        ELSE 'Male terms: ' || m || ', Female terms: ' || f END AS details
            FROM counted""",
        "ethics_report": _with(TEXTS, _bias("texts", "text_id")) + f""",
            judged AS (SELECT *, {unsafe} AS unsafe FROM banded),
            ethical AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - bias_score * 0.5::DOUBLE
                - CASE WHEN unsafe THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM judged)
            SELECT text_id, printf('%.4f', e)::DOUBLE AS ethical_score,
                   e >= 0.5 AS passed, bias_score, NOT unsafe AS is_safe,
                   'Ethical score: ' || printf('%.2f', e * 100)
                   || '% | Bias: ' || category || ' | Safe: '
                   || CASE WHEN unsafe THEN 'False' ELSE 'True' END AS summary
            FROM ethical""",
        "bias_by_language": "WITH" + _bias("documents", "lang, source") + """
            SELECT lang, source, count(*) AS documents, 
                   round(sum(round(bias_score * 10000)::BIGINT)::BIGINT / count(*) / 10000, 4)
                   AS avg_bias, max(bias_score) AS max_bias,
                   count(*) FILTER (WHERE category = 'high') AS high,
                   count(*) FILTER (WHERE category = 'moderate') AS moderate
            FROM banded GROUP BY lang, source""",
    }


# ---- request metrics ------------------------------------------------------------------------

BATCHES = REQUEST_LOG + """,
placed AS (
  SELECT *, date_trunc('hour', ts) AS w,
         row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, request_id) AS n
  FROM request_log),
batch_groups AS (
  SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, (n + 7) // 8 AS batch_no,
         count(*) AS batch_size, round(sum(latency), 4) AS processing_time,
         (SELECT count(*) FROM placed q WHERE q.w = placed.w) - max(n) AS queue_size
  FROM placed GROUP BY w, (n + 7) // 8)"""


#: Batches of eight requests or half an hour per replica: every request's jump to the batch after
#: one that begins with it, then the jumps that are taken.
COUNT_OR_TIME = """
laned AS (SELECT *, CAST(split_part(session_id, '_', 2) AS BIGINT) % 2 AS lane, epoch_us(ts) AS us
  FROM request_log),
arrivals AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ts, request_id) - 1 AS pos,
  count(*) OVER (PARTITION BY lane) AS n FROM laned),
jumps AS (SELECT lane, pos, n, least(pos + 8, max(pos) OVER (PARTITION BY lane ORDER BY us
  RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) + 1) AS beyond FROM arrivals),
taken AS (SELECT lane, pos, n, beyond, 1 AS batch_no FROM jumps WHERE pos = 0
  UNION ALL SELECT j.lane, j.pos, j.n, j.beyond, t.batch_no + 1 FROM taken t JOIN jumps j
  ON j.lane = t.lane AND j.pos = t.beyond),
in_batch AS (SELECT a.*, batch_no, a.pos - t.pos + 1 AS place, beyond - t.pos AS batch_size
  FROM arrivals a JOIN taken t ON t.lane = a.lane AND a.pos >= t.pos AND a.pos < t.beyond)"""


def dashboards() -> dict[str, str]:
    latency = " UNION ALL ".join(
        [f"SELECT '{b:g}' AS le, count(*) FILTER (WHERE latency <= {b}) AS observations, "
         "count(*) AS total_count, round(sum(latency), 2) AS total_sum FROM request_log"
         for b in C.LATENCY_BUCKETS]
        + ["SELECT '+Inf', count(*), count(*), round(sum(latency), 2) FROM request_log"])
    sizes = ", ".join(f"count(*) FILTER (WHERE batch_size <= {b}) AS le_{b:g}"
                      for b in C.BATCH_BUCKETS)
    return {
        "batch_groups": _with(BATCHES) + "SELECT * FROM batch_groups",
        "batch_stats": _with(BATCHES) + f"""
            SELECT round(avg(batch_size), 4) AS avg_batch_size,
                   round(avg(processing_time), 4) AS avg_processing_time,
                   max(queue_size) AS max_queue_size,
                   CAST(sum(batch_size) AS BIGINT) AS total_processed, {sizes}
            FROM batch_groups""",
        "dashboard_totals": _with(REQUEST_LOG) + """
            SELECT coalesce(status, 'all') AS status, count(*) AS total_queries,
                   round(avg(latency), 4) AS avg_latency, round(avg(bias_score), 4) AS avg_bias,
                   count(*) FILTER (WHERE bias_score > 0.05) AS breaches
            FROM request_log GROUP BY ROLLUP (status)""",
        "latency_histogram": _with(REQUEST_LOG) + latency,
        "latency_percentiles": _with(REQUEST_LOG) + """
            SELECT status, round(quantile_cont(latency, 0.5), 4) AS p50,
                   round(quantile_cont(latency, 0.95), 4) AS p95
            FROM request_log GROUP BY status""",
        "session_gauges": _with(REQUEST_LOG) + """
            SELECT session_id, count(*) AS requests,
                   arg_max(bias_score, (ts, request_id)) AS latest_bias,
                   arg_max(latency, (ts, request_id)) AS latest_latency
            FROM request_log GROUP BY session_id""",
        "session_history": _with(REQUEST_LOG) + """
            SELECT session_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')
                       AS window_start, count(*) AS requests,
                   round(avg(latency), 4) AS avg_latency, round(avg(bias_score), 4) AS avg_bias
            FROM request_log GROUP BY session_id, date_trunc('hour', ts)""",
        "batch_groups_short": _with(REQUEST_LOG) + """,
            short AS (SELECT *, (epoch_us(ts) // 100000) * 100000 AS w FROM request_log),
            placed AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, request_id) AS n,
                count(*) OVER (PARTITION BY w) AS arrived FROM short)
            SELECT strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S') AS window_start,
                (n + 7) // 8 AS batch_no, count(*) AS batch_size,
                round(sum(latency), 4) AS processing_time, max(arrived) - max(n) AS queue_size
            FROM placed GROUP BY w, (n + 7) // 8""",
        "request_batches": _with("RECURSIVE " + REQUEST_LOG, COUNT_OR_TIME) + """
            SELECT lane, batch_no::BIGINT AS batch_no,
                strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS batch_size,
                round(sum(latency), 4) AS processing_time,
                CASE WHEN count(*) = 8 THEN 'size' ELSE 'time' END AS closed_by
            FROM in_batch GROUP BY lane, batch_no""",
        "requests_once": _with(REQUEST_LOG) + """
            SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, session_id, latency, metric
            FROM request_log""",
        "request_results": _with(REQUEST_LOG) + """,
            waits AS (SELECT *, k % 10 <> 3 AND floor(latency * 1000000) BETWEEN 0 AND 120000000
                AS met, floor(latency * 1000000)::BIGINT AS micros FROM request_log)
            SELECT request_id, session_id, CASE WHEN met AND status = 'ok' THEN metric END AS result,
                CASE WHEN NOT met THEN 'no answer within 2 minutes'
                     WHEN status = 'error' THEN 'failed' END AS error,
                CASE WHEN met THEN micros END AS waited_micros FROM waits""",
        "session_visits": _with(REQUEST_LOG) + """,
            spans AS (SELECT *, ts + CASE WHEN status = 'error' THEN INTERVAL 1 HOUR
                ELSE INTERVAL 6 HOUR END AS until FROM request_log),
            begun AS (SELECT *, coalesce(ts > max(until) OVER (PARTITION BY session_id
                ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
                AS begins FROM spans),
            visits AS (SELECT *, sum(begins::INT) OVER (PARTITION BY session_id
                ORDER BY ts, request_id) AS visit FROM begun)
            SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS visit_start,
                strftime(max(until), '%Y-%m-%d %H:%M:%S.%f') AS visit_end, count(*) AS requests,
                round(avg(latency), 9) AS avg_latency, round(avg(bias_score), 9) AS avg_bias
            FROM visits GROUP BY session_id, visit""",
        "session_series": _with(REQUEST_LOG) + """
            SELECT session_id, row_number() OVER (PARTITION BY session_id
                       ORDER BY ts, request_id) - 1 AS position, request_id, latency, bias_score
            FROM request_log""",
        "transcripts": """
            SELECT conv_id, place // 1024 AS segment, any_value(n) AS message_count,
                   string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
            FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (
                      PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place
                  FROM conversations) GROUP BY conv_id, place // 1024""",
    }


# ---- vectors --------------------------------------------------------------------------------

VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _distance(metric: str, a: str, b: str, eps: float = 0.0) -> str:
    return {
        "l2": f"list_distance({a}, {b}) ** 2",
        "cosine": f"1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a}))"
                  f" * sqrt(list_inner_product({b}, {b})) + {eps!r}::DOUBLE)",
        "dot": f"-list_inner_product({a}, {b})",
        "manhattan": f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    }[metric]


def _rounded(value: str, digits: int = 4) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({value}, {digits}) END"


def _knn(metric: str) -> str:
    return f"""pairs AS (
      SELECT q.vec_id AS query_id, b.vec_id, {_distance(metric, 'q.v', 'b.v')} AS d
      FROM vec q, vec b),
    best AS (SELECT query_id, vec_id, d,
      row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM pairs
      QUALIFY rank <= 10)"""


def _kmeans(cells: int, metric: str, rounds: int, name: str = "") -> str:
    """CTEs ``{name}a``: rows with their cell, and ``{name}m``: cell means, after enough rounds.

    Each round is the assignment to the means of the round before; past convergence rounds repeat.
    """
    n = name
    out = [f"""{n}c0 AS MATERIALIZED (SELECT c, v FROM (SELECT v,
        row_number() OVER (ORDER BY (vec_id % 2147483648) * 2654435761 % 4294967296, vec_id) - 1
        AS c FROM vec) WHERE c < {cells})"""]
    for i in range(rounds + 1):
        out.append(f"""{n}a{i} AS MATERIALIZED (
          SELECT vec_id, v, c, d FROM (SELECT vec.vec_id, vec.v, k.c,
            {_distance(metric, 'vec.v', 'k.v')} AS d FROM vec, {n}c{i} k)
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        out.append(f"""{n}m{i} AS MATERIALIZED (
          SELECT c, list(x ORDER BY pos) AS v FROM (
            SELECT c, pos, avg(x) AS x FROM (
              SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {n}a{i})
            GROUP BY c, pos) GROUP BY c)""")
        if i < rounds:
            out.append(f"""{n}c{i + 1} AS MATERIALIZED (
              SELECT o.c, coalesce(m.v, o.v) AS v FROM {n}c{i} o LEFT JOIN {n}m{i} m USING (c))""")
    out.append(f"{n}a AS (SELECT * FROM {n}a{rounds})")
    out.append(f"{n}m AS (SELECT * FROM {n}m{rounds})")
    return ",\n".join(out)


def _probe(metric: str, nprobe: int, per_cell: int | None, name: str = "") -> str:
    """CTE ``{name}found``: top 10 of the probed cells for every vector as a query."""
    cap = "" if per_cell is None else f"QUALIFY row_number() OVER (PARTITION BY query_id, c " \
                                      f"ORDER BY d, vec_id) <= {per_cell}"
    return f"""{name}probes AS (
      SELECT query_id, v, c FROM (SELECT q.vec_id AS query_id, q.v, k.c,
        {_distance(metric, 'q.v', 'k.v')} AS d FROM vec q, {name}m k)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, c) <= {nprobe}),
    {name}cands AS (
      SELECT query_id, vec_id, c, d FROM (SELECT p.query_id, a.vec_id, p.c,
        {_distance(metric, 'p.v', 'a.v')} AS d FROM {name}probes p JOIN {name}a a USING (c)) {cap}),
    {name}found AS (
      SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)
      AS rank FROM {name}cands QUALIFY rank <= 10)"""


def _graph(metric: str, name: str = "") -> str:
    """CTE ``{name}links(src, dst, d)``."""
    return f"""{name}fwd AS MATERIALIZED (
      SELECT src, dst, d FROM (SELECT q.vec_id AS src, b.vec_id AS dst,
        {_distance(metric, 'q.v', 'b.v')} AS d FROM vec q JOIN vec b ON b.vec_id < q.vec_id)
      QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 5),
    {name}links AS MATERIALIZED (
      SELECT src, dst, d FROM {name}fwd UNION ALL SELECT dst, src, d FROM {name}fwd)"""


def _walk(metric: str, rounds: int, name: str = "", beam: int = 50) -> str:
    """CTE ``{name}walked``: top 10 of the beam after enough rounds."""
    n = name
    out = [f"""{n}s0 AS MATERIALIZED (
      SELECT q.vec_id AS query_id, b.vec_id, {_distance(metric, 'q.v', 'b.v')} AS d
      FROM vec q JOIN vec b ON b.vec_id = (SELECT min(vec_id) FROM vec))""",
           f"{n}b0 AS MATERIALIZED (SELECT * FROM {n}s0)"]
    for i in range(1, rounds + 1):
        out.append(f"""{n}n{i} AS MATERIALIZED (
          SELECT r.query_id, r.vec_id, {_distance(metric, 'q.v', 'b.v')} AS d
          FROM (SELECT DISTINCT query_id, dst AS vec_id FROM {n}b{i - 1} m
                JOIN {n}links l ON l.src = m.vec_id) r
          JOIN vec q ON q.vec_id = r.query_id JOIN vec b ON b.vec_id = r.vec_id
          WHERE NOT EXISTS (SELECT 1 FROM {n}s{i - 1} s
                            WHERE s.query_id = r.query_id AND s.vec_id = r.vec_id))""")
        out.append(f"""{n}s{i} AS MATERIALIZED (
          SELECT * FROM {n}s{i - 1} UNION ALL SELECT * FROM {n}n{i})""")
        out.append(f"""{n}b{i} AS MATERIALIZED (
          SELECT * FROM (SELECT * FROM {n}b{i - 1} UNION ALL SELECT * FROM {n}n{i})
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= {beam})""")
    out.append(f"""{n}walked AS (SELECT query_id, vec_id, d, row_number() OVER (
      PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM {n}b{rounds} QUALIFY rank <= 10)""")
    return ",\n".join(out)


def vectors() -> dict[str, str]:
    shown = f"SELECT query_id, rank, vec_id, {_rounded('d')} AS distance FROM "
    a, b = "v", "center"
    metric = "CASE label % 5 WHEN 1 THEN 'cosine' WHEN 2 THEN 'dot' WHEN 3 THEN 'manhattan' " \
             "ELSE 'l2' END"
    arms = " ".join(f"WHEN '{m}' THEN {_distance(m, 'q.v', 'b.v', C.RETRIEVAL_EPS)}"
                    for m in C.METRICS)
    out = {
        "dist_all_metrics": _with(VEC) + f""",
            cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec),
            centers AS (SELECT label, list(x ORDER BY pos) AS center FROM (
              SELECT label, pos, avg(x) AS x FROM cells GROUP BY label, pos) GROUP BY label)
            SELECT vec_id, {_rounded(_distance('l2', a, b))} AS l2sq,
                   {_rounded(f'list_distance({a}, {b})')} AS l2,
                   {_rounded(_distance('cosine', a, b))} AS cosine,
                   {_rounded(_distance('cosine', a, b, C.RETRIEVAL_EPS))} AS cosine_eps,
                   {_rounded(_distance('dot', a, b))} AS neg_dot,
                   {_rounded(_distance('manhattan', a, b))} AS manhattan,
                   {_rounded(f'sqrt(list_inner_product({a}, {a}))')} AS norm
            FROM vec JOIN centers USING (label)""",
        "knn_mixed_metric": _with(VEC) + f""",
            asked AS (SELECT vec_id, v, label + 1 AS k, {metric} AS metric FROM vec),
            pairs AS (SELECT q.vec_id AS query_id, q.k, b.vec_id,
                      CASE q.metric {arms} END AS d FROM asked q, vec b),
            best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
                     FROM pairs QUALIFY rank <= k)
            {shown} best""",
        "kmeans_assign_step": _with(VEC, _kmeans(10, "l2", 0)) + f"""
            SELECT vec_id, c::INT AS cluster_id, {_rounded('d')} AS distance FROM a""",
        "kmeans_update_step": _with(VEC, _kmeans(10, "l2", 0)) + f"""
            SELECT cluster_id, position, {_rounded('x')} AS value FROM (
              SELECT c::INT AS cluster_id, unnest(v) AS x,
                     (generate_subscripts(v, 1) - 1)::INT AS position FROM m)""",
        "kmeans_l2": _with(VEC, _kmeans(10, "l2", 30)) +
            "SELECT vec_id, c::INT AS cluster_id FROM a",
        "ivf_search": _with(VEC, _kmeans(C.IVF_CELLS, "l2", 20),
                            _probe("l2", C.IVF_PROBES, C.IVF_PER_CELL)) + shown + "found",
        "ivf_single_probe": _with(VEC, _kmeans(C.SINGLE_PROBE_CELLS, "l2", 20),
                                  _probe("l2", 1, None)) + shown + "found",
        "graph_edges": _with(VEC, _graph("l2")) + f"""
            SELECT src, dst, {_rounded('d')} AS distance FROM links""",
        "graph_search": _with(VEC, _graph("l2"), _walk("l2", 12)) + shown + "walked",
    }
    for m in C.METRICS:
        out[f"knn_{'l2' if m == 'l2' else m}"] = _with(VEC, _knn(m)) + shown + "best"
    return out


def recall() -> dict[str, str]:
    views, parts = [VEC], []
    for m in C.METRICS:
        views += [_knn(m).replace("pairs", f"{m}_pairs").replace("best", f"{m}_best"),
                  _kmeans(C.IVF_CELLS, m, 20, f"{m}_x_"),
                  _probe(m, C.IVF_PROBES, C.IVF_PER_CELL, f"{m}_x_"),
                  _kmeans(C.SINGLE_PROBE_CELLS, m, 20, f"{m}_y_"),
                  _probe(m, 1, None, f"{m}_y_"), _graph(m, f"{m}_"), _walk(m, 12, f"{m}_")]
        for method, found in (("ivf", f"{m}_x_found"), ("ivf_single_probe", f"{m}_y_found"),
                              ("graph", f"{m}_walked")):
            parts.append(f"""
              SELECT '{m}' AS metric, '{method}' AS method, query_id,
                     count(f.vec_id) / count(*) AS recall
              FROM {m}_best t LEFT JOIN {found} f USING (query_id, vec_id) GROUP BY query_id""")
    return {"recall_by_method": _with(*views) + f"""
        SELECT metric, method, round(avg(recall), 4) AS recall, min(recall) AS worst,
               count(*) AS queries FROM ({' UNION ALL '.join(parts)}) GROUP BY metric, method"""}


# ---- questions ------------------------------------------------------------------------------

def _title(text: str, gap: str) -> str:
    return (f"array_to_string(list_transform(string_split({text}, '{gap}'), "
            "lambda x: upper(x[1]) || lower(x[2:])), ' ')")


def _slots(source: str = "question_log") -> str:
    """CTE ``slots``: the questions of ``source`` that need a statement, with their slots."""
    def has(*words: str) -> str:
        return _any_contains("low", list(words))

    return f"""
lowered AS (SELECT *, lower(query) AS low FROM {source}),
tabled AS (SELECT *, {_any_contains('low', C.NEEDS_SQL_WORDS)} AS needs_sql,
    CASE WHEN {_any_contains('low', C.CUSTOMER_WORDS)} THEN 'customers' ELSE 'trips' END
    AS base_table FROM lowered),
measured AS (SELECT *,
    CASE WHEN {has('passenger')} THEN 'passengers' WHEN {has('tenure')} THEN 'tenure'
         WHEN {has('region')} THEN 'region' WHEN {has('location', 'zone')} THEN 'location'
         WHEN {has('month', 'time', 'date')} AND base_table = 'trips' THEN 'month'
         WHEN base_table = 'trips' THEN 'location' ELSE 'region' END AS group_col,
    CASE WHEN {has('fare')} THEN 'fare' WHEN {has('revenue')} THEN 'revenue'
         WHEN {has('churn')} THEN 'churn' WHEN {has('trip', 'count')} THEN '*'
         WHEN base_table = 'trips' THEN 'fare' ELSE 'revenue' END AS measure,
    CASE WHEN {_any_contains('low', C.ASCENDING_WORDS)} THEN 'ASC' ELSE 'DESC' END AS direction,
    coalesce(try_cast(list_filter(regexp_split_to_array(low, '\\s+'),
        lambda w: regexp_full_match(w, '[0-9]+'))[1] AS BIGINT), 5) AS row_limit,
    {has('churn')} AND {has('rate')} AS rate FROM tabled),
aggregated AS (SELECT *, CASE measure WHEN 'churn' THEN 'AVG' WHEN '*' THEN 'COUNT' ELSE
    CASE WHEN {has('average', 'avg')} THEN 'AVG' WHEN {has('count', 'number')} THEN 'COUNT'
         ELSE 'SUM' END END AS func FROM measured),
named AS (SELECT *, CASE WHEN rate THEN 'churn_rate' WHEN measure = '*' THEN 'count'
    ELSE lower(func) || '_' || measure END AS value_name,
    CASE group_col WHEN 'month' THEN {_quoted(C.MONTH_EXPRESSION)} ELSE group_col END AS g
    FROM aggregated),
slots AS (SELECT *,
    CASE WHEN group_col IN ('location', 'passengers', 'month') AND base_table = 'customers'
           OR group_col IN ('region', 'tenure') AND base_table = 'trips'
         THEN 'no such column: ' || group_col
         WHEN NOT rate AND (measure = 'fare' AND base_table = 'customers'
           OR measure IN ('revenue', 'churn') AND base_table = 'trips')
         THEN 'no such column: ' || measure END AS error,
    'SELECT ' || g || ', ' || CASE WHEN rate
        THEN 'AVG(churn) * 100 as churn_rate, COUNT(*) as total'
        WHEN measure = '*' THEN 'COUNT(*) as count'
        ELSE func || '(' || measure || ') as ' || value_name END
      || ' FROM ' || base_table || ' GROUP BY ' || g || ' ORDER BY ' || value_name || ' '
      || direction || ' LIMIT ' || row_limit AS statement
    FROM named WHERE needs_sql)"""


def _catalogue(most: int = 20) -> str:
    """CTEs from every group value under every measure to each question's row count and texts."""
    parts = []
    groups = {"location": ("trips", "location", "location::VARCHAR"),
              "passengers": ("trips", "passengers", "passengers::VARCHAR"),
              "month": ("trips", "NULL::BIGINT", "strftime(pickup_date, '%Y-%m')"),
              "region": ("customers", "NULL::BIGINT", "region"),
              "tenure": ("customers", "tenure", "tenure::VARCHAR")}
    micro = {c: f"sum(CAST(CAST({c} AS DECIMAL(20, 6)) * 1000000 AS HUGEINT))"
             for c in ("fare", "revenue")}
    # measure: whole millionths, what they are divided by
    measures = {
        "trips": {"sum_fare": (micro["fare"], "1"), "avg_fare": (micro["fare"], "count(fare)"),
                  "count_fare": ("count(fare) * 1000000", "1"),
                  "count": ("count(*) * 1000000", "1")},
        "customers": {"sum_revenue": (micro["revenue"], "1"),
                      "avg_revenue": (micro["revenue"], "count(revenue)"),
                      "count_revenue": ("count(revenue) * 1000000", "1"),
                      "avg_churn": ("sum(churn) * 1000000", "count(churn)"),
                      "churn_rate": ("sum(churn) * 100000000", "count(churn)"),
                      "count": ("count(*) * 1000000", "1")}}
    for group, (table, number, text) in groups.items():
        for name, (whole, by) in measures[table].items():
            total = "count(*)" if name == "churn_rate" else "NULL::BIGINT"
            key = text if number.startswith("NULL") else number
            parts.append(
                f"SELECT '{table}' AS base_table, '{group}' AS group_col, '{name}' AS value_name, "
                f"{number} AS kn, {text} AS key, CAST({whole} AS DOUBLE) / 1000000.0::DOUBLE "
                f"/ CAST({by} AS DOUBLE) AS value, CAST((CAST({whole} AS HUGEINT) * 2 + 100 * {by}) "
                f"// (200 * {by}) AS DECIMAL(20, 0)) * 0.0001::DECIMAL(5, 4) AS exact, "
                f"{total} AS total FROM {table} GROUP BY {key}")
    described = " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in C.COLUMN_DESCRIPTIONS.items())
    return f"""
catalogue AS ({' UNION ALL '.join(parts)}),
ranked AS MATERIALIZED (SELECT *, d.direction AS dir, row_number() OVER (
    PARTITION BY base_table, group_col, value_name, d.direction
    ORDER BY CASE d.direction WHEN 'ASC' THEN value ELSE -value END, kn, key) AS rank,
    count(*) OVER (PARTITION BY base_table, group_col, value_name, d.direction) AS all_rows
    FROM catalogue, (VALUES ('ASC'), ('DESC')) d(direction)),
whole AS (SELECT *, value_name IN ('count', 'count_fare', 'count_revenue') AS is_whole,
    CASE WHEN group_col IN ('region', 'month') THEN '"' || key || '"'
         ELSE coalesce(key, 'null') END AS key_json,
    CASE group_col WHEN 'location' THEN 'Loc ' || key WHEN 'region' THEN {_title('key', ' ')}
         ELSE key END AS label FROM ranked),
texted AS (SELECT *, CASE WHEN is_whole THEN value::BIGINT::VARCHAR
         ELSE exact::DECIMAL(24, 4)::VARCHAR END AS number_json,
    CASE WHEN is_whole THEN value::BIGINT::VARCHAR ELSE printf('%.2f', value) END AS shown
    FROM whole),
packs AS (SELECT base_table, group_col, value_name, dir, lim,
    count(*) AS n, any_value(all_rows) AS all_rows, '[' || string_agg('{{"' || group_col || '": ' || key_json || ', "' || value_name
      || '": ' || number_json || coalesce(', "total": ' || total, '') || '}}', ', ' ORDER BY rank)
      || ']' AS result,
    min_by(key, rank) AS top_key, min_by(value, rank) AS top_value,
    '[' || string_agg((rank - 1)::VARCHAR, ',' ORDER BY rank) || ']' AS spots,
    '[' || string_agg(number_json, ',' ORDER BY rank) || ']' AS ys,
    '[' || string_agg('"' || shown || '"', ',' ORDER BY rank) || ']' AS texts,
    '[' || string_agg('"' || label || ': ' || shown || '"', ',' ORDER BY rank) || ']' AS hover,
    '[' || string_agg('"' || label || '"', ',' ORDER BY rank) || ']' AS labels
    FROM texted, range(1, {most} + 1) r(lim) WHERE rank <= lim
    GROUP BY base_table, group_col, value_name, dir, lim),
answered AS (SELECT q.question_id, q.query, s.statement, s.error, s.group_col, s.value_name, p.n,
    CASE WHEN p.n IS NOT NULL THEN least(s.row_limit, p.all_rows) END AS row_count,
    p.result, p.top_key, p.top_value, p.spots, p.ys, p.texts, p.hover, p.labels
    FROM question_log q LEFT JOIN slots s USING (question_id)
    LEFT JOIN packs p ON p.base_table = s.base_table AND p.group_col = s.group_col
      AND p.value_name = s.value_name AND p.dir = s.direction
      AND p.lim = least(s.row_limit, {most})),
told AS (SELECT *, CASE WHEN n IS NULL
      THEN 'Query processed: ' || query || '. See visualization for details.'
      ELSE 'Analysis: Found ' || n || ' results. Top result: ' || CASE group_col {described}
        ELSE group_col END || ' ''' || top_key || '''' || CASE
        WHEN contains(value_name, 'revenue') THEN ' generated highest revenue of $'
          || printf('%.2f', top_value) || '. This segment leads in financial performance.'
        WHEN contains(value_name, 'churn') THEN ' has the highest churn rate of '
          || printf('%.2f', top_value) || '. This segment requires retention focus.'
        WHEN contains(value_name, 'fare') THEN ' recorded the highest fare total of $'
          || printf('%.2f', top_value) || '. High demand segment identified.'
        ELSE ' has ' || printf('%.2f', top_value) || ' total records.' END END AS narrative,
    CASE WHEN n IS NOT NULL THEN '{{"data":[{{"type":"bar","x":' || spots || ',"y":' || ys
      || ',"name":"' || value_name || '","text":' || texts || ',"textposition":"auto","hovertext":'
      || hover || '}}],"layout":{{"title":"' || {_title('value_name', '_')} || ' by '
      || {_title('group_col', '_')} || '","xaxis":{{"title":"' || {_title('group_col', '_')}
      || '","tickmode":"array","tickvals":' || spots || ',"ticktext":' || labels
      || ',"tickangle":0}},"yaxis":{{"title":"' || {_title('value_name', '_')}
      || '"}},"template":"plotly_dark","showlegend":false}}}}' END AS chart
    FROM answered)"""


def questions() -> dict[str, str]:
    told = _with(QUESTION_LOG, TRIPS, CUSTOMERS, _slots(), _catalogue())
    return {
        "question_classify": _with(QUESTION_LOG) + f"""
            SELECT question_id, {_any_contains('lower(query)', C.NEEDS_SQL_WORDS)} AS needs_sql
            FROM question_log""",
        "question_slots": _with(QUESTION_LOG, _slots()) + """
            SELECT q.question_id, s.base_table, s.group_col, s.measure, s.func, s.direction,
                   s.row_limit, s.statement
            FROM question_log q LEFT JOIN slots s USING (question_id)""",
        "question_answers": told + """
            SELECT question_id, error, coalesce(row_count, 0)::INT AS row_count, result AS sql_result
            FROM told""",
        "chart_specs": told + "SELECT question_id, chart FROM told WHERE chart IS NOT NULL",
        "narratives": told + "SELECT question_id, narrative FROM told",
        "question_rows": _with(QUESTION_LOG, TRIPS, CUSTOMERS, _slots(), _catalogue(24)) + """,
            records AS (SELECT question_id, unnest(range(0, json_array_length(result)::BIGINT)) AS position,
                        result FROM told WHERE result IS NOT NULL),
            fields AS (SELECT question_id, position, json_extract(result, '$[' || position || ']')
                       AS record FROM records),
            keyed AS (SELECT question_id, position, record, unnest(json_keys(record)) AS name
                      FROM fields),
            read_back AS (SELECT question_id, position, name,
                      json_extract_string(record, '$."' || name || '"') AS value FROM keyed)
            SELECT question_id, position::INT AS position, name, try_cast(value AS DOUBLE) AS number,
                   CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS text
            FROM read_back""",
        "chart_values": told + """,
            points AS (SELECT question_id, chart,
                unnest(range(0, json_array_length(chart, '$.data[0].x')::BIGINT)) AS i
                FROM told WHERE chart IS NOT NULL)
            SELECT question_id, json_extract_string(chart, '$.layout.title') AS title,
                   json_extract_string(chart, '$.data[0].name') AS series,
                   json_extract(chart, '$.data[0].x[' || i || ']')::INT AS position,
                   json_extract(chart, '$.data[0].y[' || i || ']')::DOUBLE AS height,
                   json_extract_string(chart, '$.data[0].text[' || i || ']') AS shown,
                   json_extract_string(chart, '$.layout.xaxis.ticktext[' || i || ']') AS label
            FROM points""",
    }


# ---- retrieval ------------------------------------------------------------------------------

def _embedded(name: str, source: str, key: str, text: str) -> str:
    """CTE ``{name}(key, v)``: mean md5 bytes of the tokens of every text of ``source``."""
    return f"""
{name}_tokens AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}),
    '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {source}),
{name}_counts AS MATERIALIZED (SELECT key, t, count(*) AS n FROM {name}_tokens GROUP BY key, t),
{name}_bytes AS (SELECT t, i, CAST('0x' || substr(md5(t), (2 * i + 1)::INT, 2) AS INT) AS b
    FROM (SELECT DISTINCT t FROM {name}_counts), range(16) r(i)),
{name}_means AS (SELECT key, i, (CAST(sum(n * b) AS DOUBLE) / CAST(sum(n) AS DOUBLE) - 127.5)
    / 127.5 AS m FROM {name}_counts JOIN {name}_bytes USING (t) GROUP BY key, i),
{name} AS MATERIALIZED (SELECT s.{key} AS key,
    coalesce(list(m ORDER BY i) FILTER (WHERE m IS NOT NULL),
             list_transform(range(16), lambda x: 0.0::DOUBLE)) AS v
    FROM {source} s LEFT JOIN {name}_means e ON e.key = s.{key} GROUP BY s.{key})"""


def retrieval() -> dict[str, str]:
    found = _with(QUESTION_LOG, _embedded("qe", "user_turns", "question_id", "query"),
                  _embedded("de", "documents", "doc_id", "text")) + """,
        found AS (SELECT q.key AS question_id, d.key AS doc_id, list_distance(q.v, d.v) AS d,
          row_number() OVER (PARTITION BY q.key ORDER BY list_distance(q.v, d.v), d.key)
          AS rank FROM qe q, de d QUALIFY rank <= 10)"""
    arms = " ".join(f"WHEN '{m}' THEN {_distance(m, 'q.v', 'd.v', C.RETRIEVAL_EPS)}"
                    for m in C.METRICS)
    harmful = "(" + " OR ".join(
        f"regexp_matches(lower(c.query), {_quoted(p)})" for p in C.HARMFUL_PATTERNS) + ")"
    unsafe = f"({harmful} OR {_any_contains('lower(c.query)', C.BLOCKED_TOPICS)})"
    agent = _with(
        QUESTION_LOG, TRIPS, CUSTOMERS, _slots(), _catalogue(), """
        checked AS (SELECT question_id, query, session_id, coalesce(k, 10) AS k,
          coalesce(metric, 'l2') AS metric FROM question_log),
        distinct_queries AS (SELECT DISTINCT query, k, metric FROM checked
          WHERE k BETWEEN 1 AND 50),
        query_texts AS (SELECT DISTINCT query FROM distinct_queries)""",
        _embedded("qe", "query_texts", "query", "query"),
        _embedded("de", "benchmark", "item_id", "text"), f"""
        scored AS (SELECT c.query, c.k, c.metric, d.key AS doc_id,
          CASE c.metric {arms} ELSE {_distance('l2', 'q.v', 'd.v')} END AS d
          FROM distinct_queries c JOIN qe q ON q.key = c.query, de d),
        best AS (SELECT *, row_number() OVER (PARTITION BY query, k, metric ORDER BY d, doc_id)
          AS rank FROM scored QUALIFY rank <= k),
        finds AS (SELECT query, k, metric, list(doc_id ORDER BY rank) AS ids,
          list(b.text ORDER BY rank) AS docs
          FROM best JOIN benchmark b ON b.item_id = doc_id GROUP BY query, k, metric)""", f"""
        worded AS (SELECT question_id, list_distinct(list_filter(
          regexp_split_to_array(lower(narrative), '\\s+'), lambda x: x <> '')) AS w FROM told),
        gendered AS (SELECT question_id, len(list_intersect(w, {_list(C.ANSWER_MALE)})) AS m,
          len(list_intersect(w, {_list(C.ANSWER_FEMALE)})) AS f FROM worded)""") + f"""
        SELECT c.question_id, c.query, c.session_id, c.k::INT AS k, c.metric,
               CASE WHEN fine THEN NOT {unsafe} END AS is_safe,
               CASE WHEN fine THEN t.statement END AS sql_query,
               CASE WHEN fine THEN t.result END AS sql_result,
               CASE WHEN fine THEN t.error WHEN c.k < 1 THEN 'k must be at least 1'
                    ELSE 'k must be at most 50' END AS error,
               CASE WHEN fine THEN t.narrative END AS narrative,
               CASE WHEN fine THEN t.chart END AS viz_code,
               CASE WHEN fine THEN CASE WHEN m + f = 0 THEN 0.0::DOUBLE ELSE printf('%.4f', abs(m - f)::DOUBLE / (m + f))::DOUBLE END END
                 AS bias_score,
               CASE WHEN fine THEN array_to_string(finds.docs, chr(10)) END
                 AS retrieved_docs,
               CASE WHEN fine THEN array_to_string(finds.ids, ',') END AS retrieved_ids
        FROM (SELECT *, k BETWEEN 1 AND 50 AS fine FROM checked) c
        JOIN told t USING (question_id) JOIN gendered USING (question_id)
        LEFT JOIN finds ON finds.query = c.query AND finds.k = c.k AND finds.metric = c.metric"""
    served = _with(
        "RECURSIVE " + QUESTION_LOG, REQUEST_LOG[len(EVENTS_K) + 2:], COUNT_OR_TIME,
        """asked AS (SELECT b.*, q.query, coalesce(q.k, 2) AS q_k FROM in_batch b
             JOIN question_log q ON q.question_id = 'e-' || b.request_id),
           query_texts AS (SELECT DISTINCT query FROM asked)""",
        _embedded("qe", "query_texts", "query", "query"),
        _embedded("de", "benchmark", "item_id", "text"), f"""
        scored AS (SELECT q.key AS query, d.key AS doc_id, row_number() OVER (PARTITION BY q.key
          ORDER BY {_distance('l2', 'q.v', 'd.v')}, d.key) AS rank FROM qe q, de d),
        contexts AS (SELECT query, k, string_agg(text, chr(10) ORDER BY rank) AS context
          FROM scored JOIN benchmark ON item_id = doc_id, range(1, 51) AS ks(k)
          WHERE rank <= k GROUP BY query, k)""") + """
        SELECT request_id, a.query, CASE WHEN q_k BETWEEN 1 AND 50 THEN 'Question: ' || a.query
                 || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Answer:' END AS result,
               CASE WHEN q_k < 1 THEN 'k must be at least 1' WHEN q_k > 50
                    THEN 'k must be at most 50' END AS error,
               lane || '-' || batch_no AS batch_key, place::INT AS place,
               batch_size::INT AS batch_size,
               CASE WHEN batch_size = 8 THEN 'size' ELSE 'time' END AS closed_by
        FROM asked a LEFT JOIN contexts c ON c.query = a.query AND c.k = a.q_k"""
    return {
        "served_requests": served,
        "pool_embeddings": "WITH" + _embedded("de", "documents", "doc_id", "text") + f"""
            SELECT doc_id, position, {_rounded('x', 6)} AS value FROM (
              SELECT key AS doc_id, unnest(v) AS x,
                     (generate_subscripts(v, 1) - 1)::INT AS position FROM de)""",
        "retrieve_docs": found + f"""
            SELECT question_id, rank, doc_id, {_rounded('d')} AS distance, text
            FROM found JOIN documents USING (doc_id)""",
        "rag_prompts": found + """
            SELECT question_id, query, 'Question: ' || query || chr(10) || 'Context:' || chr(10)
                   || string_agg(text, chr(10) ORDER BY rank) || chr(10) || 'Answer:' AS prompt
            FROM found JOIN documents USING (doc_id) JOIN user_turns USING (question_id)
            WHERE rank <= 2 GROUP BY question_id, query""",
        "agent_answers": agent,
    }


# ---- generated columns ---------------------------------------------------------------------

def _uniform(key: str, salt: str) -> str:
    return f"(CAST('0x' || left(md5('{salt}:' || {key}), 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def _uniform_int(key: str, salt: str, low: int, high: int) -> str:
    return f"CAST(floor({_uniform(key, salt)} * {high - low + 1}) + {low} AS INT)"


def _weighted(key: str, salt: str, weights: dict) -> str:
    arms, upto = [], 0.0
    *firsts, last = weights
    for value in firsts:
        upto = round(upto + weights[value], 10)
        arms.append(f"WHEN {_uniform(key, salt)} < {upto} THEN {value!r}")
    return f"CASE {' '.join(arms)} ELSE {last!r} END"


def _exponential(key: str, salt: str, scale: float, minimum: float) -> str:
    return f"round(-ln(1.0::DOUBLE - {_uniform(key, salt)}) * {scale} + {minimum}, 2)"


def generated() -> dict[str, str]:
    o, c = "o_orderkey", "c_custkey"
    seconds = f"CAST(floor({_uniform(o, 'pickup')} * {C.DAYS * 86400 + 1}) AS BIGINT)"
    return {
        "synthetic_trips": f"""
            SELECT {o} AS id, strftime(o_orderdate + to_seconds({seconds} - {C.DAYS * 86400}),
                       '%Y-%m-%d %H:%M:%S') AS pickup_date,
                   {_uniform_int(o, 'location', 1, C.ZONES)} AS location,
                   {_exponential(o, 'fare', C.FARE_SCALE, C.FARE_MIN)} AS fare,
                   {_weighted(o, 'passengers', C.PASSENGER_WEIGHTS)} AS passengers FROM orders""",
        "synthetic_customers": f"""
            SELECT id, region, tenure, revenue, CAST(CASE WHEN tenure > {C.LONG_TENURE}
                       THEN late < {C.LONG_TENURE_CHURN_SHARE} ELSE early < {C.CHURN_SHARE} END
                   AS INT) AS churn
            FROM (SELECT {c} AS id, {_weighted(c, 'region', C.REGION_WEIGHTS)} AS region,
                         {_uniform_int(c, 'tenure', 1, C.MAX_TENURE)} AS tenure,
                         {_uniform(c, 'late churn')} AS late, {_uniform(c, 'churn')} AS early,
                         {_exponential(c, 'revenue', C.REVENUE_SCALE, C.REVENUE_MIN)} AS revenue
                  FROM customer)""",
    }


def passthrough() -> dict[str, str]:
    statements = dict(STATEMENTS)
    statements["sql_json"] = statements["sql_json"].replace(
        "get_json_object", "json_extract_string")
    return statements


# Columns that DuckDB makes wider than Spark does.
NARROWER = {
    "sql_joins": {"orders": "BIGINT"},
    "sql_windows": {"month": "INTEGER", "best": "INTEGER"},
    **{name: {"rank": "INTEGER"} for name in (
        "sample_top_locations", "sample_avg_fare_by_passengers", "sample_churn_by_region",
        "sample_tenure_buckets", "sample_trips_per_month", "knn_l2", "knn_cosine", "knn_dot",
        "knn_manhattan", "knn_l2_large", "knn_manhattan_large", "knn_cosine_large",
        "knn_mixed_metric", "ivf_search", "ivf_single_probe", "graph_search",
        "retrieve_docs", "ivf_search_kept", "retrieve_docs_kept", "graph_search_large")},
}


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (samples, profile, guards, audits, dashboards, generated, vectors, recall, questions,
                 retrieval, passthrough):
        out.update(part())
    for large in ("knn_l2", "knn_manhattan", "knn_cosine", "graph_edges", "graph_search"):
        out[f"{large}_large"] = out[large]
    for kept in ("ivf_search", "retrieve_docs"):
        out[f"{kept}_kept"] = out[kept]
    out["kmeans_cluster_rule"] = out["kmeans_l2"]
    out["run_sql_limit"] = _with(TRIPS) + """
        SELECT count(*) AS shown_rows FROM (SELECT * FROM trips LIMIT 1000)"""
    out["percentile_sketches"] = _with(REQUEST_LOG) + """
        SELECT status, count(*) AS n, true AS p50_within, true AS p95_within FROM request_log
        GROUP BY status"""
    out["embed_with_encoder"] = """
        SELECT doc_id, (generate_subscripts(v, 1) - 1)::INT AS position, unnest(v)::FLOAT AS value
        FROM (SELECT doc_id, list_transform(['', 'a', 'e', 'i', 'o', 'u'], lambda x: CASE
              WHEN x = '' THEN length(text) ELSE length(text) - length(replace(text, x, '')) END) AS v
              FROM documents)"""
    out["brief_answers"] = f"SELECT query, narrative AS result FROM ({out['agent_answers']})"
    out["trace_records"] = f"""
        SELECT left(query, 100) AS query, k, metric, a.session_id, latency AS latency_ms,
               a.bias_score, len(string_split(retrieved_ids, ','))::INT AS docs_retrieved,
               CASE WHEN narrative IS NULL THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN narrative IS NULL THEN left(error, 200) END AS error,
               query AS full_query, CASE WHEN narrative IS NULL THEN error END AS full_error,
               '{{"query":' || to_json(query) || ',"sql_query":' || coalesce(to_json(sql_query), 'null')
               || ',"narrative":' || coalesce(to_json(narrative), 'null') || ',"bias_score":'
               || coalesce(to_json(a.bias_score), 'null') || ',"latency_ms":' || to_json(latency)
               || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","error":'
               || coalesce(to_json(error), 'null') || '}}' AS trace,
               strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, strftime(ts, '%Y-%m-%d') AS dt
        FROM ({out['agent_answers']}) a
        JOIN (SELECT 'e-' || event_id AS question_id, ts, value AS latency FROM events)
        USING (question_id)"""
    out["sql_text_functions"] = f"""
        SELECT text_id, redacted, is_safe, bias_score FROM ({out['redact_pii']})
        JOIN ({out['check_query']}) USING (text_id) JOIN ({out['bias_analyze']}) USING (text_id)"""
    out["sql_distance_functions"] = f"""
        SELECT vec_id, l2sq, l2, cosine, neg_dot, manhattan FROM ({out['dist_all_metrics']})"""
    out["run_sql_guarded"] = _with(TRIPS) + """
        SELECT passengers, count(*) AS trips_taken, max(fare) AS highest FROM trips
        GROUP BY passengers"""
    for name, columns in NARROWER.items():
        casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out
