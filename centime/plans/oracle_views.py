"""SQL text of the fixture views, for the independent DuckDB oracle.

The Spark side builds the same views with the DataFrame API
(``centime.sources.tables.Ledger``); the oracle inlines these as CTEs because
the checker only registers the base tables.
"""

from __future__ import annotations

VIEWS = {
    "v_users": """SELECT c_custkey AS user_id, c_name AS name, concat(lower(c_name),'@example.org') AS email FROM customer""",
    "v_accounts": """SELECT c_custkey*2+k AS account_id, c_custkey AS user_id,
       CASE WHEN k=0 THEN 'CURRENT' ELSE 'SAVINGS' END AS type,
       (k=0 AND c_custkey%10<>9) AS is_default, c_acctbal AS balance
FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) a""",
    "v_budgets": """SELECT c_custkey AS user_id, 50000.0+(c_custkey%20)*25000.0 AS amount,
       CASE WHEN c_custkey%4=0 THEN TIMESTAMP '1998-03-02 06:00:00'
            WHEN c_custkey%4=1 THEN TIMESTAMP '1998-02-20 06:00:00' END AS last_alert_sent
FROM customer WHERE c_custkey%5<>0""",
    "v_transactions": """SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey*2+(o_orderkey%2) AS account_id,
       CASE WHEN o_orderstatus='F' THEN 'INCOME' ELSE 'EXPENSE' END AS type, o_totalprice AS amount,
       CASE WHEN o_orderkey%11=0 THEN NULL
            ELSE concat(CASE WHEN o_orderstatus='F' THEN 'Received ' ELSE 'Paid for ' END, o_orderpriority) END AS description,
       o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey%24 AS INT) AS date,
       CASE o_orderkey%7 WHEN 0 THEN 'food' WHEN 1 THEN 'shopping' WHEN 2 THEN 'transport' WHEN 3 THEN 'entertainment'
                         WHEN 4 THEN 'bills' WHEN 5 THEN 'healthcare' ELSE 'education' END AS category,
       o_orderkey%10=0 AS is_recurring,
       CASE o_orderkey%40 WHEN 0 THEN 'DAILY' WHEN 10 THEN 'WEEKLY' WHEN 20 THEN 'MONTHLY' WHEN 30 THEN 'YEARLY' END AS recurring_interval,
       CASE WHEN o_orderkey%10=0 AND o_orderkey%3<>0 THEN o_orderdate END AS last_processed,
       CASE o_orderpriority WHEN '5-LOW' THEN 'PENDING' WHEN '4-NOT SPECIFIED' THEN 'FAILED' ELSE 'COMPLETED' END AS status
FROM orders""",
    "v_purchases": """SELECT l_orderkey, l_linenumber, s_name AS merchant, p_name AS description, l_extendedprice AS amount,
       lower(p_type) AS native_category, l_shipdate AS date,
       CASE l_returnflag WHEN 'R' THEN 'Credit' ELSE 'Debit' END AS transaction_type, l_linestatus AS source
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey""",
    "v_category_map": """SELECT * FROM (VALUES ('economy','food'),('standard','bills'),('small','transport'),
                      ('medium','shopping'),('large','healthcare')) t(native_category, category)""",
    "v_profiles": """SELECT user_id, 20000.0+(user_id%50)*2500.0 AS monthly_income, 0.05+(user_id%12)*0.05 AS savings_target_pct,
       CASE user_id%5 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' WHEN 2 THEN 'growth_oriented'
                      WHEN 3 THEN 'flexible' ELSE 'other' END AS lifestyle,
       (user_id%9)*1500.0 AS debt_obligations
FROM v_users""",
    "v_risk_events": """SELECT event_id, user_id, ts, value*100 AS amount,
       CASE event_type WHEN 'purchase' THEN 'shopping' WHEN 'view' THEN 'entertainment' WHEN 'click' THEN 'food'
                       WHEN 'signup' THEN 'education' ELSE 'unknown' END AS category,
       concat('m', CAST(event_id%20 AS VARCHAR)) AS merchant, CAST(hour(ts) AS INT) AS hour_of_day,
       CAST(regexp_extract(props,'[0-9]+',0) AS DOUBLE)*10 AS distance_from_home_km,
       1.0-CAST(regexp_extract(props,'[0-9]+',0) AS DOUBLE)/100 AS device_trust_score,
       (event_id%100)/100.0 AS merchant_risk_score,
       CASE WHEN event_type='error' THEN 1 ELSE 0 END AS is_foreign_currency
FROM events""",
}

# views that read other views
DEPENDS = {"v_profiles": ["v_users"]}

ORDER = list(VIEWS)


def M(x: str) -> str:
    """Money rounding, same recipe as ``centime.functions.money.money``."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(30,8)), 2) AS DECIMAL(18,2))"


def R(x: str, digits: int = 6) -> str:
    """Deterministic rounding of a double, same recipe as ``round_to``."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def with_views(body: str, *views: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with its own CTE list via
    ``extra_ctes``) with the needed view definitions in dependency order."""
    need: list[str] = []

    def add(v):
        for d in DEPENDS.get(v, []):
            add(d)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    need.sort(key=ORDER.index)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in need]
    if extra_ctes:
        ctes.append(extra_ctes)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
