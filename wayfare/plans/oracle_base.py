"""DuckDB twins of the driver-table adapter (``wayfare.sources.driver``).

Each CTE below must stay expression-for-expression equal to its Spark
counterpart; the statements in ``oracle.py`` are written from the definitions
of the figures, so that they check the Spark plans, not mirror them.
"""

EV = r"""
ev_b0 AS (
  SELECT event_id, ts, user_id, event_type, value,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS _k,
         CAST(event_id % 100 AS INTEGER) AS _j
  FROM events
),
ev_b AS (SELECT *, (_k + _j) % 100 AS _u FROM ev_b0),
ev0 AS (
  SELECT
    event_id,
    CAST(user_id AS VARCHAR) AS user_pseudo_id,
    ts AS event_ts,
    epoch_us(ts) AS event_timestamp,
    strftime(ts, '%Y%m%d') AS event_date,
    CASE event_type
      WHEN 'view' THEN 'page_view'
      WHEN 'click' THEN CASE WHEN _k < 16 THEN 'content_cta' WHEN _k < 24 THEN 'begin_checkout'
                             WHEN _k < 32 THEN 'request_call_back_confirmation'
                             WHEN _k < 40 THEN 'request_quote_confirmation'
                             WHEN _k < 48 THEN 'request_brochure_confirmation'
                             WHEN _k < 60 THEN 'find_your_cruise_filter' ELSE 'page_view' END
      WHEN 'signup' THEN CASE WHEN _k < 40 THEN 'generate_lead' WHEN _k < 55 THEN 'generate_lead_WEBQ'
                              WHEN _k < 65 THEN 'generate_lead_WBOF_01' WHEN _k < 70 THEN 'generate_lead_WBOF_04'
                              WHEN _k < 75 THEN 'generate_lead_RAB' WHEN _k < 80 THEN 'generate_lead_RAQ'
                              WHEN _k < 85 THEN 'generate_lead_SFO' WHEN _k < 92 THEN 'generate_lead_WBBK'
                              ELSE 'generate_lead_WBCH' END
      WHEN 'purchase' THEN 'purchase'
      WHEN 'error' THEN 'experiment_viewed'
    END AS event_name,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(strftime(ts, '%Y%m%d') AS BIGINT) END AS ga_session_id,
    CASE
      WHEN _u < 8 THEN 'https://www.cruise-line.test/en/booking?step=suites&journey=J' || CAST(_j % 6 AS VARCHAR)
      WHEN _u < 22 THEN 'https://www.cruise-line.test/en/journeys/dest-' || CAST(_j % 5 AS VARCHAR) || '/voyage-' || CAST(_j % 7 AS VARCHAR)
      WHEN _u < 34 THEN 'https://booking.cruise-line.test/touchb2c/journeys/step-' || CAST(_j % 4 AS VARCHAR)
      WHEN _u < 38 THEN 'https://www.cruise-line.test/en/my-area/journeys/' || CAST(_j % 3 AS VARCHAR)
      WHEN _u < 41 THEN 'https://www.cruise-line.test/en/about/journeys'
      WHEN _u < 52 THEN 'https://www.cruise-line.test/cruises/itin-' || CAST(_j % 9 AS VARCHAR) || '?ref=' || CAST(_j % 2 AS VARCHAR)
      WHEN _u < 62 THEN 'https://www.cruise-line.test/destinations/dest-' || CAST(_j % 6 AS VARCHAR) || '/overview'
      WHEN _u < 70 THEN 'https://quote.cruise-line.test/voyage/' || CAST(_j % 4 AS VARCHAR) || CASE WHEN _j % 3 = 0 THEN '/guests-info' ELSE '/summary' END
      WHEN _u < 80 THEN 'https://www.cruise-line.test/offers?utm_medium=Email&utm_campaign=' || CASE WHEN _j % 2 = 0 THEN 'spring_VS_' ELSE 'springXVSY' END
                        || CAST(_j % 5 AS VARCHAR) || '&IndividualId=' || CAST(user_id * 10 + _j % 10 AS VARCHAR)
      WHEN _u < 90 THEN 'https://www.cruise-line.test/lp?utm_medium=email&utm_campaign=news' || CAST(_j % 5 AS VARCHAR) || '&IndividualId='
                        || CASE WHEN _j % 17 = 0 THEN 'unknown' ELSE CAST(user_id * 10 + _j % 10 AS VARCHAR) END
      WHEN _u < 96 THEN 'https://www.cruise-line.test/home'
    END AS page_location,
    CASE WHEN event_type = 'signup' AND _k < 40 THEN CASE WHEN _k % 2 = 0 THEN 'booking' ELSE 'newsletter' END END AS lead_name,
    ['total', 'free', 'deposit'][_j % 4 + 1] AS payment_type,
    CASE WHEN _j % 3 = 0 THEN 'confirmed' ELSE 'option' END AS booking_status,
    CASE WHEN _k % 10 = 0 THEN 'YES' WHEN _k % 10 = 1 THEN NULL ELSE 'NO' END AS p_journey_is_destex,
    CASE WHEN _j % 20 = 0 THEN NULL ELSE 'J' || CAST(_j % 6 AS VARCHAR) END AS p_journey_code,
    CASE WHEN _k < 45 THEN strftime(CAST(ts AS DATE) + (_k * 10 - 5), '%Y-%m-%d')
         WHEN _k < 75 THEN strftime(CAST(ts AS DATE) + (_k * 3 - 150), '%d-%m-%Y')
         WHEN _k < 80 THEN 'n/a' END AS p_departure_date,
    CASE WHEN _u >= 8 AND _u < 22 AND _j % 4 <> 0 THEN 'dest-' || CAST(_j % 5 AS VARCHAR) END AS p_sub_category,
    CASE WHEN event_type = 'error' THEN CASE WHEN _k < 60 THEN 'exp_popup' ELSE 'exp_other' END END AS experiment_id,
    CASE WHEN event_type <> 'error' THEN NULL
         WHEN _k % 25 = 24 THEN NULL
         WHEN user_id % 2 = 0 OR (user_id % 3 = 0 AND _k % 10 = 7) THEN 'a'
         ELSE 'b' END AS variation_id,
    CASE WHEN event_type = 'click' AND _k < 8 THEN 'popup_funnel'
         WHEN event_type = 'click' AND _k < 16 THEN 'return_to_funnel' END AS cta_name,
    CASE WHEN event_type = 'click' AND _k < 8 THEN 'popup_seen'
         WHEN event_type = 'click' AND _k < 16 THEN 'cta_click' END AS cta_type,
    CASE WHEN event_type = 'signup' AND _k >= 40 AND _k < 55 THEN ['guests', 'category', 'fare', 'summary'][_k % 4 + 1] || ' WEBQ'
         WHEN _u >= 62 AND _u < 70 THEN ['guests', 'category', 'fare', 'summary'][_j % 4 + 1] END AS voyage_funnel_step_name,
    CASE WHEN event_type = 'signup' AND _k >= 40 AND _k < 55 THEN 'U' || CAST(event_id AS VARCHAR) END AS uwrid,
    CASE WHEN _j % 7 = 6 THEN NULL ELSE ['US', 'UK', 'LACAR', 'DE', 'IT', 'AU'][_j % 6 + 1] END AS market,
    CASE WHEN event_type = 'error' AND _k >= 60 THEN
      CASE WHEN _j % 3 = 0 THEN '{"test":"payment-loading-progress","s":"b"}'
           WHEN _j % 3 = 1 THEN '{"test":"payment-loading-progress","segmentId":"b"}'
           ELSE '{"test":"payment-loading-progress","s":"a"}' END END AS ab_component_tests,
    value AS event_value_in_usd
  FROM ev_b
),
ev AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN page_location END AS raw_url FROM ev0)
"""

IDENTITY = r"""
super_id AS (
  SELECT 'S' || CAST(c_custkey AS VARCHAR) AS super_id,
         CASE WHEN c_custkey % 11 = 5 THEN CAST([] AS VARCHAR[])
              WHEN c_custkey % 7 = 0 THEN [CAST(c_custkey AS VARCHAR), CAST(c_custkey + 1 AS VARCHAR)]
              ELSE [CAST(c_custkey AS VARCHAR)] END AS google_ids
  FROM customer
),
latest_individual AS (
  SELECT 'S' || CAST(c_custkey AS VARCHAR) AS super_id, c_custkey AS latest_individual_id
  FROM customer WHERE c_acctbal >= 0
),
booking_role AS (
  SELECT o_custkey AS IndividualId, 'B' || CAST(o_orderkey AS VARCHAR) AS BkgCod FROM orders
),
booking_header AS (
  SELECT 'B' || CAST(o_orderkey AS VARCHAR) AS BkgCod,
         CASE o_orderstatus WHEN 'F' THEN 'BK' WHEN 'O' THEN 'OP' ELSE 'CX' END AS BkgStatus,
         CAST(o_orderdate + INTERVAL 276 MONTH AS DATE) AS ConfirmationDate
  FROM orders
),
web_request AS (
  SELECT o_custkey AS IndividualId, 'U' || CAST(o_orderkey * 5 AS VARCHAR) AS uwrid,
         CAST(o_orderdate + INTERVAL 276 MONTH AS DATE) AS Date, o_orderpriority AS RequestTypology
  FROM orders
)
"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + body


def rnd(expr: str, n: int) -> str:
    """SQL ROUND with decimal half-up semantics on a double expression."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"
