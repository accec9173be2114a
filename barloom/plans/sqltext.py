"""The derived inputs as SQL views, for the oracle side. Same derivations as ``fixtures.py``."""

from __future__ import annotations

from collections.abc import Sequence

# view name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": (
        (),
        """SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
           l_quantity AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "bars": (
        ("ticks",),
        """SELECT symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS time, arg_min(price, seq) AS open,
           max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume,
           count(*) AS n_ticks FROM ticks GROUP BY ALL""",
    ),
    "rbars": (
        ("bars",),
        """SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS c1, ln(close / lag(close) OVER w) AS lr
           FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""",
    ),
    "event_ticks": (
        (),
        "SELECT event_type AS symbol, ts, value AS price, 1.0 AS size, user_id, event_id FROM events WHERE value > 0",
    ),
    "sector": (
        (),
        """SELECT DISTINCT p_brand AS symbol, 'S' || substr(split_part(p_brand, '#', 2), 1, 1) AS sector
           FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#23')""",
    ),
    "macro_obs": (
        (),
        """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'vix' WHEN '2-HIGH' THEN 'nasdaq'
             WHEN '3-MEDIUM' THEN 'russell2000' WHEN '4-NOT SPECIFIED' THEN 'yield_10y' ELSE 'yield_3m' END AS series,
             CAST(o_orderdate AS TIMESTAMP) AS time, o_totalprice AS v FROM orders
           UNION ALL SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'tlt' WHEN 'BUILDING' THEN 'hyg'
             WHEN 'AUTOMOBILE' THEN 'dxy' WHEN 'FURNITURE' THEN 'gold' ELSE 'oil' END,
             CAST(o_orderdate AS TIMESTAMP), o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
           UNION ALL SELECT 'sp500', CAST(o_orderdate AS TIMESTAMP), o_totalprice FROM orders""",
    ),
    "macro_long": (
        ("macro_obs",),
        """SELECT series, time, CASE WHEN series = 'vix' THEN avg(v) / 9000.0
             WHEN series LIKE 'yield%' THEN avg(v) / 60000.0 ELSE avg(v) / 1000.0 END AS value
           FROM macro_obs GROUP BY series, time""",
    ),
    "macro_raw": (
        ("macro_long",),
        "SELECT time, "
        + ", ".join(
            f"max(value) FILTER (WHERE series = '{s}') AS {s}"
            for s in "vix sp500 nasdaq russell2000 yield_10y yield_3m tlt hyg dxy gold oil".split()
        )
        + " FROM macro_long GROUP BY time",
    ),
    "macro": (
        ("macro_raw",),
        "SELECT time, "
        + ", ".join(
            f"last_value({s} IGNORE NULLS) OVER w AS {s}"
            for s in "vix sp500 nasdaq russell2000 yield_10y yield_3m tlt hyg dxy gold oil".split()
        )
        + " FROM macro_raw WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)",
    ),
    "predictions": (
        ("bars",),
        """SELECT symbol, time, model, y_true, y_pred, rn FROM (
             SELECT symbol, time, rn, lead(close, 5) OVER w / close - 1 AS y_true, close / lag(close, 5) OVER w - 1 AS r5,
               CASE WHEN rn >= 5 THEN -(close / avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS 4 PRECEDING) - 1) END AS rev
             FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM bars)
             WINDOW w AS (PARTITION BY symbol ORDER BY time)) b,
           LATERAL (VALUES ('reversal', rev), ('momentum', r5), ('flat', CASE WHEN rn > 0 THEN 0.0 END)) AS m(model, y_pred)
           WHERE y_true IS NOT NULL AND y_pred IS NOT NULL""",
    ),
    "chain": (
        (),
        """SELECT p_brand AS symbol, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS expiration,
             CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'put' END AS side,
             floor(p_retailprice / 5) * 5 AS strike, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS open_interest,
             avg(l_discount + l_tax) AS implied_volatility, max(l_extendedprice / l_quantity) AS last_price,
             count(*) AS volume
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    ),
    "wallets": (
        (),
        "SELECT c_custkey AS wallet_id, c_custkey AS user_id, CAST(c_acctbal AS DECIMAL(19,4)) AS balance, 'TRY' AS currency FROM customer",
    ),
    "transactions": (
        (),
        """SELECT o_orderkey AS id, 'k' || CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS idempotency_key,
             o_custkey AS sender_wallet_id, (o_custkey * 7 + 1) % (SELECT count(*) FROM customer) AS receiver_wallet_id,
             CAST(o_totalprice AS DECIMAL(19,4)) AS amount,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'PAYMENT' WHEN '2-HIGH' THEN 'REFUND' ELSE 'TRANSFER' END AS type,
             CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
             CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders""",
    ),
    "plans": (
        (),
        """SELECT * FROM (VALUES (0, 'FREE', 3, 0.0, true, '{"features": ["basic"]}'),
             (1, 'PRO', 20, 19.9, true, '{"features": ["basic", "signals"]}'),
             (2, 'LEGACY', 40, 9.9, false, '{"features": ["basic", "export"]}'),
             (3, 'MAX', 60, 49.9, true, '{"features": ["basic", "signals", "api"]}')
           ) AS p(plan_id, name, monthly_quota, price, active, features)""",
    ),
    "subscriptions": (
        (),
        """SELECT event_id AS id, user_id, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS plan_id,
             'ACTIVE' AS status, ts AS starts_at, ts + INTERVAL 10 DAY AS expires_at FROM events WHERE event_type = 'signup'""",
    ),
    "requests": (
        (),
        """SELECT event_id AS id, user_id, ts, 'Brand#' || (user_id % 25 + 1) AS symbol,
             CASE CAST(props->>'k' AS INTEGER) % 3 WHEN 0 THEN 'tree' WHEN 1 THEN 'lstm' ELSE 'arima' END AS model,
             '1y' AS period, CASE CAST(props->>'k' AS INTEGER) % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 20 END AS horizon,
             1 AS credits FROM events WHERE event_type <> 'signup'""",
    ),
    "audit": (
        (),
        """SELECT event_id AS id, user_id, CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'click' THEN 'LOGIN'
             ELSE upper(event_type) END AS action, 'EVENT' AS entity_type, props AS details, ts AS created_at FROM events""",
    ),
    "notifications": (
        (),
        """SELECT event_id AS id, user_id, event_type AS type, event_type || ' ' || event_id AS title,
             event_id % 3 = 0 AS is_read, ts AS created_at FROM events""",
    ),
    "signals": (
        (),
        """SELECT event_id AS id, ts AS generated_at, 'Brand#' || (user_id % 25 + 1) AS symbol,
             'm' || (user_id % 3) AS model_name, value / 100.0 - 0.1 AS prediction, least(1.0, value / 500.0) AS confidence,
             24 AS horizon_hours FROM events""",
    ),
    "news": (
        (),
        """SELECT doc_id, 'Brand#' || (doc_id % 25 + 1) AS symbol, trim(split_part(text, chr(10), 1)) AS title,
             coalesce(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS summary,
             CAST(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS TIMESTAMP) AS published FROM documents""",
    ),
    "lexicon": (
        (),
        """SELECT * FROM (VALUES ('that', 1), ('with', 1), ('que', 1), ('und', 1), ('les', 1), ('for', 1),
             ('was', -1), ('are', -1), ('des', -1), ('die', -1), ('from', -1), ('une', -1)) AS x(word, polarity)""",
    ),
    "categories": (
        (),
        """SELECT * FROM (VALUES (1, 'earnings', 'tionth'), (1, 'earnings', 'orre'), (2, 'analyst', 'sich'),
             (2, 'analyst', 'eaux'), (3, 'deals', 'with'), (4, 'legal', 'los'), (5, 'product', 'ing'))
           AS x(priority, category, keyword)""",
    ),
    "brand_years": (
        (),
        """SELECT p_brand AS symbol, year(l_shipdate) AS y, sum(CAST(l_quantity AS BIGINT)) AS units,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS revenue,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) / 10000.0 AS tax
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    ),
}


def with_views(names: Sequence[str]) -> str:
    """``WITH`` clause holding the named views and everything they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
