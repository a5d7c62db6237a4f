"""Ledger queries over the fixture views (clock: 1998-03-15 12:00, report
month February 1998)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.money import as_number, money
from ..operators import ledger as L
from ..sources.tables import FIXTURE_NOW, Ledger
from .oracle_views import M, R, with_views
from .registry import query

NOW = FIXTURE_NOW
REPORT_MONTH = "1998-02-01 00:00:00"

_FEB = "date >= TIMESTAMP '1998-02-01 00:00:00' AND date <= TIMESTAMP '1998-02-28 00:00:00'"
_WHOLE_FEB = "date >= TIMESTAMP '1998-02-01 00:00:00' AND date < TIMESTAMP '1998-03-01 00:00:00'"


def _month_ctes(where: str) -> str:
    return f"""st AS (
  SELECT user_id,
         SUM(CASE WHEN type='INCOME' THEN {M('amount')} END) AS inc,
         SUM(CASE WHEN type='EXPENSE' THEN {M('amount')} END) AS exp,
         COUNT(*) AS n
  FROM v_transactions WHERE {where} GROUP BY user_id),
ct AS (SELECT user_id, string_agg(category || ': $' || CAST(amt AS VARCHAR), ', ' ORDER BY category) AS cats
       FROM (SELECT user_id, category, CAST(SUM({M('amount')}) AS DECIMAL(18,2)) AS amt FROM v_transactions
             WHERE type = 'EXPENSE' AND category IS NOT NULL AND {where} GROUP BY user_id, category) GROUP BY user_id)"""


def _report_sql(where: str) -> str:
    return with_views("""
SELECT u.user_id, u.email, u.name, 'February' AS month,
       CAST(COALESCE(inc, 0) AS DOUBLE) AS total_income,
       CAST(COALESCE(exp, 0) AS DOUBLE) AS total_expenses,
       CAST(COALESCE(inc, 0) - COALESCE(exp, 0) AS DOUBLE) AS net_income,
       COALESCE(n, 0) AS transaction_count, COALESCE(cats, '') AS by_category,
       '""" + " | ".join(dims.FALLBACK_INSIGHTS) + """' AS insights
FROM v_users u LEFT JOIN st ON st.user_id = u.user_id LEFT JOIN ct ON ct.user_id = u.user_id""",
        "v_users", "v_transactions", extra_ctes=_month_ctes(where))


def _report_rows(report):
    from ..functions.text import category_amounts_text
    return report.withColumn("by_category", category_amounts_text("by_category")) \
                 .withColumn("insights", F.array_join("insights", " | "))


@query("monthly_report", "G15,A3,A4,J4,F4,D2,D10,P6", oracle=_report_sql(_FEB))
def q_monthly_report(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return _report_rows(L.monthly_report(db.users(), db.transactions("1998-02-01", "1998-02-28"), REPORT_MONTH))


from ..functions.dims import LEDGER_CATEGORIES, ledger_categories_df
from ..operators import jobs as J
from ..operators import mutations as X


def NEXT(base: str, iv: str) -> str:
    """DuckDB twin of D1 (day overflow past month end)."""
    return (f"CASE {iv} WHEN 'DAILY' THEN {base} + INTERVAL 1 DAY WHEN 'WEEKLY' THEN {base} + INTERVAL 7 DAY "
            f"WHEN 'MONTHLY' THEN date_trunc('month', {base}) + INTERVAL 1 MONTH + ({base} - date_trunc('month', {base})) "
            f"WHEN 'YEARLY' THEN date_trunc('month', {base}) + INTERVAL 12 MONTH + ({base} - date_trunc('month', {base})) "
            f"ELSE {base} END")


SIGNED = f"CASE WHEN type='EXPENSE' THEN -{M('amount')} ELSE {M('amount')} END"


@query("budget_utilisation", "A1,A2,F3,D2", oracle=with_views(f"""
SELECT user_id, account_id, budget_amount, cur AS current_expenses, {R('pct')} AS pct_used,
       CASE WHEN pct >= 90 THEN 'red' WHEN pct >= 75 THEN 'yellow' ELSE 'green' END AS band
FROM k""", "v_accounts", "v_budgets", "v_transactions", extra_ctes=f"""sp AS (
  SELECT account_id, SUM({M('amount')}) AS spend FROM v_transactions
  WHERE type='EXPENSE' AND date >= TIMESTAMP '1998-03-01 00:00:00' AND date <= TIMESTAMP '1998-03-31 00:00:00'
  GROUP BY account_id),
j AS (SELECT a.user_id, a.account_id, b.amount AS budget_amount, CAST(COALESCE(sp.spend, 0) AS DOUBLE) AS cur
      FROM v_accounts a LEFT JOIN sp ON sp.account_id = a.account_id LEFT JOIN v_budgets b ON b.user_id = a.user_id),
k AS (SELECT *, CASE WHEN budget_amount > 0 THEN cur / budget_amount * 100 ELSE 0.0 END AS pct FROM j)"""))
def q_budget_utilisation(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    spend = L.month_to_date_spend(db.transactions("1998-03-01", "1998-03-31"), NOW)
    return L.budget_utilisation(db.accounts(), db.budgets(), spend)


@query("budget_alerts", "G14,J13,D3,C6,P5", oracle=with_views(f"""
SELECT user_id, email, account_id, amount AS budget_amount, total AS total_expenses, {R('pct')} AS percentage_used,
       printf('%.1f', floor(amount)) AS budget_amount_text, printf('%.1f', floor(total)) AS total_expenses_text,
       TIMESTAMP '1998-03-15 12:00:00' AS alert_sent_at
FROM k WHERE pct >= 80 AND (last_alert_sent IS NULL OR date_trunc('month', last_alert_sent) <> TIMESTAMP '1998-03-01')""",
    "v_users", "v_accounts", "v_budgets", "v_transactions", extra_ctes=f"""d AS (
  SELECT user_id, min(account_id) AS account_id FROM v_accounts WHERE is_default GROUP BY user_id),
sp AS (SELECT user_id, account_id, SUM({M('amount')}) AS spend FROM v_transactions
       WHERE type='EXPENSE' AND date >= TIMESTAMP '1998-03-01 12:00:00' GROUP BY user_id, account_id),
j AS (SELECT b.user_id, u.email, d.account_id, b.amount, b.last_alert_sent, CAST(COALESCE(sp.spend, 0) AS DOUBLE) AS total
      FROM v_budgets b JOIN v_users u ON u.user_id = b.user_id JOIN d ON d.user_id = b.user_id
      LEFT JOIN sp ON sp.user_id = b.user_id AND sp.account_id = d.account_id),
k AS (SELECT *, total / amount * 100 AS pct FROM j)"""))
def q_budget_alerts(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    alerts, _ = J.budget_alerts(db.budgets(), db.users(), db.accounts(),
                                db.transactions(date_from="1998-03-01"), NOW)
    return alerts


@query("budgets_after_alerts", "G14,P5,X6", oracle=with_views(f"""
SELECT b.user_id, b.amount, CASE WHEN f.user_id IS NOT NULL THEN TIMESTAMP '1998-03-15 12:00:00' ELSE b.last_alert_sent END AS last_alert_sent
FROM v_budgets b LEFT JOIN (SELECT user_id FROM k WHERE pct >= 80 AND (last_alert_sent IS NULL OR date_trunc('month', last_alert_sent) <> TIMESTAMP '1998-03-01')) f
  ON f.user_id = b.user_id""",
    "v_users", "v_accounts", "v_budgets", "v_transactions", extra_ctes=f"""d AS (
  SELECT user_id, min(account_id) AS account_id FROM v_accounts WHERE is_default GROUP BY user_id),
sp AS (SELECT user_id, account_id, SUM({M('amount')}) AS spend FROM v_transactions
       WHERE type='EXPENSE' AND date >= TIMESTAMP '1998-03-01 12:00:00' GROUP BY user_id, account_id),
j AS (SELECT b.user_id, d.account_id, b.amount, b.last_alert_sent, CAST(COALESCE(sp.spend, 0) AS DOUBLE) AS total
      FROM v_budgets b JOIN v_users u ON u.user_id = b.user_id JOIN d ON d.user_id = b.user_id
      LEFT JOIN sp ON sp.user_id = b.user_id AND sp.account_id = d.account_id),
k AS (SELECT *, total / amount * 100 AS pct FROM j)"""))
def q_budgets_after_alerts(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    _, updated = J.budget_alerts(db.budgets(), db.users(), db.accounts(),
                                 db.transactions(date_from="1998-03-01"), NOW)
    return updated


@query("account_lookup", "S12,F1,J12", oracle=with_views("""
SELECT r.user_id, r.account_id, COUNT(*) AS n_requests, bool_or(a.account_id IS NOT NULL) AS found,
       max(a.type) AS type, bool_or(a.is_default) AS is_default
FROM (SELECT user_id, account_id + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS account_id FROM v_transactions) r
LEFT JOIN v_accounts a ON a.user_id = r.user_id AND a.account_id = r.account_id
GROUP BY r.user_id, r.account_id""", "v_transactions", "v_accounts"))
def q_account_lookup(spark, sf_dir):
    """Accounts by key, scoped to the asking user: every third transaction asks for the next user's account."""
    db = Ledger(spark, sf_dir)
    asked = F.col("account_id") + F.when(F.col("id") % 3 == 0, 2).otherwise(0)
    requests = db.transactions().select("user_id", asked.alias("account_id"))
    return L.point_lookup(requests, db.accounts(), ["user_id", "account_id"], ["type", "is_default"])


@query("account_summary", "J3,A9,F20,S11", oracle=with_views("""
SELECT a.account_id, a.user_id, a.type, a.is_default, a.balance, COALESCE(c.n, 0) AS transaction_count
FROM v_accounts a LEFT JOIN (SELECT account_id, COUNT(id) AS n FROM v_transactions GROUP BY account_id) c
  ON c.account_id = a.account_id""", "v_accounts", "v_transactions"))
def q_account_summary(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.account_tx_counts(db.accounts(), db.transactions())


@query("account_history", "J2,T1,C5", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default, a.balance,
       t.id AS tx_id, t.date AS tx_date, t.type AS tx_type, CAST({M('t.amount')} AS DOUBLE) AS tx_amount,
       CASE WHEN t.id IS NULL THEN NULL ELSE COALESCE(NULLIF(t.description, ''), 'Untitled Transaction') END AS tx_description,
       t.category AS tx_category, COALESCE(c.n, 0) AS transaction_count
FROM v_accounts a LEFT JOIN v_transactions t ON t.account_id = a.account_id
LEFT JOIN (SELECT account_id, COUNT(id) AS n FROM v_transactions GROUP BY account_id) c ON c.account_id = a.account_id""",
    "v_accounts", "v_transactions"))
def q_account_history(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.account_history(db.accounts(), db.transactions())


@query("transactions_listing", "F10,J1,T1,S11", oracle=with_views(f"""
SELECT t.*, a.type AS account_type, a.is_default AS account_is_default
FROM v_transactions t JOIN v_accounts a ON a.account_id = t.account_id WHERE t.status = 'COMPLETED'""",
    "v_accounts", "v_transactions"))
def q_transactions_listing(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    t = L.filter_transactions(db.transactions(), where=F.col("status") == "COMPLETED")
    return L.sort_transactions(L.with_account(t, db.accounts()), "date", ascending=False)


@query("transaction_page", "F7,F8,F9,T2,T3,T4", oracle=with_views("""
SELECT * FROM r WHERE row_in_list > 0 AND row_in_list <= 10""", "v_transactions", extra_ctes="""f AS (
  SELECT * FROM v_transactions WHERE lower(description) LIKE '%paid%' AND type = 'EXPENSE' AND NOT is_recurring),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY amount DESC, id DESC) AS row_in_list,
             CAST(CEIL(COUNT(*) OVER (PARTITION BY account_id) / 10.0) AS BIGINT) AS total_pages FROM f)"""))
def q_transaction_page(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    t = L.filter_transactions(db.transactions(), search="Paid", type_="EXPENSE", recurring=False)
    return L.page_of(t, page=1, field="amount", ascending=False)


@query("recent_transactions", "T5,C5", oracle=with_views("""
SELECT *, COALESCE(NULLIF(description, ''), 'Untitled Transaction') AS display_description FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY date DESC, id DESC) AS recent_rank FROM v_transactions)
WHERE recent_rank <= 5""", "v_transactions"))
def q_recent_transactions(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.recent_per_account(db.transactions(), 5)


@query("default_or_latest_account", "W12", oracle=with_views("""
SELECT account_id, user_id, type, is_default, balance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY is_default DESC, account_id DESC) AS rn FROM v_accounts)
WHERE rn = 1""", "v_accounts"))
def q_default_or_latest_account(spark, sf_dir):
    return L.default_account(Ledger(spark, sf_dir).accounts(), only_default=False)


@query("category_breakdown", "A7,F5", oracle=with_views(f"""
SELECT account_id, category, CAST(SUM({M('amount')}) AS DOUBLE) AS amount, COUNT(*) AS transaction_count
FROM v_transactions WHERE type = 'EXPENSE' AND date_trunc('month', date) = TIMESTAMP '1998-03-01'
GROUP BY account_id, category""", "v_transactions"))
def q_category_breakdown(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.category_breakdown(db.transactions("1998-03-01", "1998-03-31"), NOW)


def _chart_sql(where: str) -> str:
    return with_views(f"""
SELECT account_id, strftime(date, '%b %d') AS day,
       CAST(COALESCE(SUM(CASE WHEN type = 'INCOME' THEN {M('amount')} END), 0) AS DOUBLE) AS income,
       CAST(COALESCE(SUM(CASE WHEN type = 'EXPENSE' THEN {M('amount')} END), 0) AS DOUBLE) AS expense
FROM v_transactions {where} GROUP BY account_id, strftime(date, '%b %d')""", "v_transactions")


@query("account_chart_1m", "A5,F6,D10", oracle=_chart_sql(
    "WHERE date >= TIMESTAMP '1998-02-13 00:00:00' AND date < TIMESTAMP '1998-03-16 00:00:00'"))
def q_account_chart_1m(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.daily_chart(db.transactions("1998-02-13", "1998-03-16"), NOW, "1M")


@query("account_chart_all", "A5,F6,D10", oracle=_chart_sql("WHERE date < TIMESTAMP '1998-03-16 00:00:00'"))
def q_account_chart_all(spark, sf_dir):
    """The whole history up to the end of today; rows dated later are left out."""
    return L.daily_chart(Ledger(spark, sf_dir).transactions(), NOW, "ALL")


@query("chart_totals_3m", "A6,F6", oracle=with_views(f"""
SELECT account_id,
       CAST(COALESCE(SUM(CASE WHEN type = 'INCOME' THEN {M('amount')} END), 0) AS DOUBLE) AS total_income,
       CAST(COALESCE(SUM(CASE WHEN type = 'EXPENSE' THEN {M('amount')} END), 0) AS DOUBLE) AS total_expense,
       CAST(COALESCE(SUM(CASE WHEN type = 'INCOME' THEN {M('amount')} END), 0)
            - COALESCE(SUM(CASE WHEN type = 'EXPENSE' THEN {M('amount')} END), 0) AS DOUBLE) AS net
FROM v_transactions WHERE date >= TIMESTAMP '1997-12-15 00:00:00' AND date < TIMESTAMP '1998-03-16 00:00:00'
GROUP BY account_id""", "v_transactions"))
def q_chart_totals_3m(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return L.range_totals(db.transactions("1997-12-15", "1998-03-16"), NOW, "3M")


_NEXT_CTE = f"""t AS (SELECT *, CASE WHEN is_recurring AND recurring_interval IS NOT NULL
     THEN {NEXT('COALESCE(last_processed, date)', 'recurring_interval')} END AS next_recurring_date FROM v_transactions),
due AS (SELECT * FROM t WHERE is_recurring AND status = 'COMPLETED'
        AND (last_processed IS NULL OR COALESCE(next_recurring_date <= TIMESTAMP '1998-03-15 12:00:00', false)))"""


@query("due_recurring", "F11,F12,P1,D1", oracle=with_views(
    "SELECT id AS transaction_id, user_id FROM due", "v_transactions", extra_ctes=_NEXT_CTE))
def q_due_recurring(spark, sf_dir):
    return J.due_recurring(Ledger(spark, sf_dir).transactions(), NOW)


@query("next_recurring_dates", "D1", oracle=with_views(f"""
SELECT id, date, recurring_interval, {NEXT('date', 'recurring_interval')} AS next_recurring_date
FROM v_transactions WHERE is_recurring""", "v_transactions"))
def q_next_recurring_dates(spark, sf_dir):
    from ..functions.dates import next_recurring_date
    t = Ledger(spark, sf_dir).transactions().filter("is_recurring")
    return t.select("id", "date", "recurring_interval",
                    next_recurring_date("date", "recurring_interval").alias("next_recurring_date"))


def _posting(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    tx = db.transactions()
    return J.post_recurring(tx, db.accounts(), J.due_recurring(tx, NOW), NOW)


@query("post_recurring", "P2,C5,M4", oracle=with_views("""
SELECT id AS source_id, user_id, account_id, type, amount,
       COALESCE(NULLIF(description, ''), 'Untitled Transaction') || ' (Recurring)' AS description,
       TIMESTAMP '1998-03-15 12:00:00' AS date, category, false AS is_recurring, 'COMPLETED' AS status
FROM due""", "v_transactions", extra_ctes=_NEXT_CTE))
def q_post_recurring(spark, sf_dir):
    posted, _, _ = _posting(spark, sf_dir)
    return posted.drop("id", "recurring_interval")


@query("recurring_balances", "P2,M4,X1", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default,
       CAST({M('a.balance')} + COALESCE(d.delta, 0) AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM({SIGNED}) AS delta FROM due GROUP BY account_id) d
  ON d.account_id = a.account_id""", "v_accounts", "v_transactions", extra_ctes=_NEXT_CTE))
def q_recurring_balances(spark, sf_dir):
    _, acc, _ = _posting(spark, sf_dir)
    return acc


@query("recurring_templates", "P2,D1", oracle=with_views(f"""
SELECT t.id,
       CASE WHEN d.id IS NOT NULL THEN TIMESTAMP '1998-03-15 12:00:00' ELSE t.last_processed END AS last_processed,
       CASE WHEN d.id IS NOT NULL THEN {NEXT("TIMESTAMP '1998-03-15 12:00:00'", 't.recurring_interval')}
            ELSE t.next_recurring_date END AS next_recurring_date
FROM t LEFT JOIN due d ON d.id = t.id WHERE t.is_recurring""", "v_transactions", extra_ctes=_NEXT_CTE))
def q_recurring_templates(spark, sf_dir):
    _, _, upd = _posting(spark, sf_dir)
    return upd.filter("is_recurring").select("id", "last_processed", "next_recurring_date")


@query("throttle_events", "P3", oracle="""
SELECT event_id, user_id, ts, event_type,
       ROW_NUMBER() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 10 AS admitted
FROM events""")
def q_throttle_events(spark, sf_dir):
    ev = Ledger(spark, sf_dir).table("events", "event_id", "user_id", "ts", "event_type")
    return J.throttle(ev)


_LEDGER_CATS_SQL = "(VALUES " + ", ".join(f"('{i}', '{t}')" for i, _, t, _, _ in LEDGER_CATEGORIES) + ") lc(cid, ctype)"


@query("transaction_validation", "F17,F18,F19", oracle=with_views(f"""
SELECT id, concat_ws('; ',
  CASE WHEN type IS NULL OR type NOT IN ('INCOME', 'EXPENSE') THEN 'type: invalid enum' END,
  CASE WHEN COALESCE(length(CAST(amount AS VARCHAR)), 0) < 1 THEN 'amount: Amount is required' END,
  CASE WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount: not a number' END,
  CASE WHEN date IS NULL THEN 'date: Date is required' END,
  CASE WHEN COALESCE(length(CAST(account_id AS VARCHAR)), 0) < 1 THEN 'accountId: Account is required' END,
  CASE WHEN COALESCE(length(category), 0) < 1 THEN 'category: Category is required' END,
  CASE WHEN COALESCE(is_recurring, false) AND recurring_interval IS NULL
       THEN 'recurringInterval: Recurring interval is required for recurring transactions' END,
  CASE WHEN recurring_interval IS NOT NULL AND recurring_interval NOT IN ('DAILY', 'WEEKLY', 'MONTHLY', 'YEARLY')
       THEN 'recurringInterval: invalid enum' END,
  CASE WHEN category IS NOT NULL AND lc.cid IS NULL THEN 'category: not offered for this type' END) AS error_text,
  (lc.cid IS NOT NULL AND category IS NOT NULL AND type IN ('INCOME', 'EXPENSE') AND date IS NOT NULL) AS is_valid
FROM v_transactions t LEFT JOIN {_LEDGER_CATS_SQL} ON lc.cid = t.category AND lc.ctype = t.type""", "v_transactions"))
def q_transaction_validation(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    v = L.validate_transactions(db.transactions(), ledger_categories_df(spark))
    return v.select("id", F.array_join("errors", "; ").alias("error_text"),
                    (F.size("errors") == 0).alias("is_valid"))


@query("balance_reconciliation", "X10,M4", oracle=with_views(f"""
SELECT a.account_id, a.user_id, CAST({M('a.balance')} AS DOUBLE) AS balance,
       CAST(COALESCE(s.s, 0) AS DOUBLE) AS expected_balance,
       CAST({M('a.balance')} - COALESCE(s.s, 0) AS DOUBLE) AS drift
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM({SIGNED}) AS s FROM v_transactions GROUP BY account_id) s
  ON s.account_id = a.account_id""", "v_accounts", "v_transactions"))
def q_balance_reconciliation(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return X.reconcile(db.accounts(), db.transactions())


@query("bulk_delete_failed", "X3,A8,F2", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default, CAST({M('a.balance')} + COALESCE(d.delta, 0) AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM(-({SIGNED})) AS delta FROM v_transactions
                             WHERE status = 'FAILED' GROUP BY account_id) d ON d.account_id = a.account_id""",
    "v_accounts", "v_transactions"))
def q_bulk_delete_failed(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    tx = db.transactions()
    req = tx.filter(F.col("status") == "FAILED").select("id", "user_id")
    _, acc = X.bulk_delete(tx, db.accounts(), req)
    return acc


def _purchase_requests(db: Ledger):
    e = db.table("events", "event_id", "user_id", "ts", "event_type", "value").filter(F.col("event_type") == "purchase")
    return e.select(
        (F.col("event_id") + F.lit(10 ** 12)).alias("id"), "user_id",
        (F.col("user_id") * 2 + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)).alias("account_id"),
        F.lit("EXPENSE").alias("type"), (F.col("value") * 100).alias("amount"),
        F.lit("Card purchase").alias("description"), F.col("ts").alias("date"),
        F.lit("shopping").alias("category"), (F.col("event_id") % 50 == 0).alias("is_recurring"),
        F.when(F.col("event_id") % 50 == 0, "MONTHLY").alias("recurring_interval"),
        F.lit(None).cast("timestamp_ntz").alias("last_processed"), F.lit("COMPLETED").alias("status"))


_PURCHASE_REQ_CTE = """req AS (
  SELECT event_id + 1000000000000 AS id, user_id, user_id * 2 + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS account_id,
         'EXPENSE' AS type, value * 100 AS amount, 'Card purchase' AS description, ts AS date, 'shopping' AS category,
         event_id % 50 = 0 AS is_recurring, CASE WHEN event_id % 50 = 0 THEN 'MONTHLY' END AS recurring_interval,
         'COMPLETED' AS status
  FROM events WHERE event_type = 'purchase'),
ok AS (SELECT r.* FROM req r WHERE EXISTS (SELECT 1 FROM v_accounts a WHERE a.account_id = r.account_id AND a.user_id = r.user_id))"""


@query("post_transactions", "X1,J12,D1", oracle=with_views(f"""
SELECT id, user_id, account_id, type, amount, description, date, category, is_recurring, recurring_interval, status,
       CASE WHEN is_recurring AND recurring_interval IS NOT NULL THEN {NEXT('date', 'recurring_interval')} END AS next_recurring_date
FROM ok""", "v_accounts", extra_ctes=_PURCHASE_REQ_CTE))
def q_post_transactions(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    rows, _, _, _ = X.post_transactions(db.transactions(), db.accounts(), _purchase_requests(db))
    return rows.drop("last_processed")


@query("post_transactions_balances", "X1,J12,M4", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default, CAST({M('a.balance')} + COALESCE(d.delta, 0) AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM({SIGNED}) AS delta FROM ok GROUP BY account_id) d
  ON d.account_id = a.account_id""", "v_accounts", extra_ctes=_PURCHASE_REQ_CTE))
def q_post_transactions_balances(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    _, _, acc, _ = X.post_transactions(db.transactions(), db.accounts(), _purchase_requests(db))
    return acc


@query("rejected_requests", "J12", oracle=with_views("""
SELECT r.id, r.user_id, r.account_id FROM req r
WHERE NOT EXISTS (SELECT 1 FROM v_accounts a WHERE a.account_id = r.account_id AND a.user_id = r.user_id)""",
    "v_accounts", extra_ctes=_PURCHASE_REQ_CTE))
def q_rejected_requests(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    _, _, _, rej = X.post_transactions(db.transactions(), db.accounts(), _purchase_requests(db))
    return rej.select("id", "user_id", "account_id")


def _amend_requests(tx):
    """Pending rows are confirmed: status COMPLETED, amount rounded up to the
    next hundred; every fourth one is also moved to the user's other account."""
    p = tx.filter(F.col("status") == "PENDING")
    other = F.col("user_id") * 2 + (1 - F.col("account_id") % 2)
    return p.select(
        "id", "user_id",
        F.when(F.col("id") % 4 == 1, other).otherwise(F.col("account_id")).alias("account_id"),
        "type", (F.ceil(F.col("amount") / 100) * 100).cast("double").alias("amount"),
        "description", "date", "category", "is_recurring", "recurring_interval", "last_processed",
        F.lit("COMPLETED").alias("status"))


_AMEND_CTE = f"""upd AS (
  SELECT id, user_id, CASE WHEN id % 4 = 1 THEN user_id * 2 + (1 - account_id % 2) ELSE account_id END AS account_id,
         account_id AS old_account_id, type, CAST(CEIL(amount / 100) * 100 AS DOUBLE) AS amount, {SIGNED} AS old_signed
  FROM v_transactions WHERE status = 'PENDING'),
dl AS (SELECT old_account_id AS account_id, -old_signed AS delta FROM upd
       UNION ALL SELECT account_id, {SIGNED} FROM upd)"""


@query("amend_transactions_balances", "X2,M4", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default, CAST({M('a.balance')} + COALESCE(d.delta, 0) AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM(delta) AS delta FROM dl GROUP BY account_id) d
  ON d.account_id = a.account_id""", "v_accounts", "v_transactions", extra_ctes=_AMEND_CTE))
def q_amend_transactions_balances(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    tx = db.transactions()
    _, acc = X.amend_transactions(tx, db.accounts(), _amend_requests(tx))
    return acc


@query("set_default_accounts", "X4", oracle=with_views("""
SELECT a.account_id, a.user_id, a.type,
       CASE WHEN r.user_id IS NULL THEN a.is_default ELSE a.account_id = r.target END AS is_default, a.balance
FROM v_accounts a LEFT JOIN (
  SELECT user_id, max(account_id) AS target FROM v_accounts
  WHERE user_id NOT IN (SELECT user_id FROM v_accounts WHERE is_default) AND type = 'SAVINGS' GROUP BY user_id) r
  ON r.user_id = a.user_id""", "v_accounts"))
def q_set_default_accounts(spark, sf_dir):
    acc = Ledger(spark, sf_dir).accounts()
    no_default = acc.groupBy("user_id").agg(F.max(F.col("is_default").cast("int")).alias("d")).filter("d = 0")
    req = acc.filter(F.col("type") == "SAVINGS").join(no_default.select("user_id"), "user_id", "left_semi")
    return X.set_default(acc, req.select("user_id", "account_id"))


@query("open_accounts", "X5,F19", oracle=with_views("""
SELECT a.account_id, a.user_id, a.type,
       a.is_default AND a.user_id NOT IN (SELECT user_id FROM req WHERE is_default) AS is_default, a.balance
FROM v_accounts a
UNION ALL
SELECT account_id, user_id, type, is_default, balance FROM req""", "v_accounts", extra_ctes="""req AS (
  SELECT c_custkey * 2 + 1000000000000 AS account_id, c_custkey AS user_id, 'SAVINGS' AS type,
         TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS balance, c_custkey % 2 = 0 AS is_default
  FROM customer WHERE c_mktsegment = 'BUILDING')"""))
def q_open_accounts(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    c = db.table("customer", "c_custkey", "c_acctbal", "c_mktsegment").filter(F.col("c_mktsegment") == "BUILDING")
    req = c.select((F.col("c_custkey") * 2 + F.lit(10 ** 12)).alias("account_id"),
                   F.col("c_custkey").alias("user_id"), F.lit("SAVINGS").alias("type"),
                   F.col("c_acctbal").cast("string").alias("balance"),
                   (F.col("c_custkey") % 2 == 0).alias("is_default"))
    return X.open_accounts(db.accounts(), req)


@query("upsert_budgets", "X6,F19", oracle=with_views(f"""
SELECT COALESCE(b.user_id, r.user_id) AS user_id, COALESCE(r.amount, b.amount) AS amount, b.last_alert_sent
FROM v_budgets b FULL OUTER JOIN req r ON r.user_id = b.user_id""", "v_budgets", "v_transactions", extra_ctes=f"""req AS (
  SELECT user_id, CAST(ROUND(SUM({M('amount')}) * 1.1, 2) AS DOUBLE) AS amount FROM v_transactions
  WHERE type = 'EXPENSE' AND date >= TIMESTAMP '1998-02-01 00:00:00' AND date <= TIMESTAMP '1998-02-28 00:00:00'
  GROUP BY user_id)"""))
def q_upsert_budgets(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    st = L.monthly_stats(db.transactions("1998-02-01", "1998-02-28"), REPORT_MONTH)
    req = st.filter(F.col("total_expenses").isNotNull()).select(
        "user_id", F.round(F.col("total_expenses") * F.lit(1.1).cast("decimal(2,1)"), 2).cast("double").alias("amount"))
    return X.upsert_budgets(db.budgets(), req)


@query("register_users", "X7", oracle=with_views("""
SELECT user_id, name, email FROM v_users
UNION ALL
SELECT s_suppkey + 1000000000 AS user_id, s_name AS name, concat(lower(s_name), '@example.org') AS email FROM supplier
WHERE concat(lower(s_name), '@example.org') NOT IN (SELECT email FROM v_users)""", "v_users"))
def q_register_users(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    s = db.table("supplier", "s_suppkey", "s_name")
    req = s.select((F.col("s_suppkey") + F.lit(10 ** 9)).alias("user_id"), F.col("s_name").alias("name"),
                   F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"))
    return X.register_users(db.users(), req.unionByName(db.users()))


@query("cascade_delete", "X9", oracle=with_views("""
SELECT 'users' AS table_name, COUNT(*) AS rows_left FROM v_users WHERE user_id NOT IN (SELECT user_id FROM doomed)
UNION ALL SELECT 'accounts', COUNT(*) FROM v_accounts WHERE user_id NOT IN (SELECT user_id FROM doomed)
UNION ALL SELECT 'transactions', COUNT(*) FROM v_transactions WHERE user_id NOT IN (SELECT user_id FROM doomed)
UNION ALL SELECT 'budgets', COUNT(*) FROM v_budgets WHERE user_id NOT IN (SELECT user_id FROM doomed)""",
    "v_users", "v_accounts", "v_budgets", "v_transactions",
    extra_ctes="doomed AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'MACHINERY')"))
def q_cascade_delete(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    doomed = db.table("customer", "c_custkey", "c_mktsegment").filter(F.col("c_mktsegment") == "MACHINERY") \
               .select(F.col("c_custkey").alias("user_id"))
    u, a, t, b = X.cascade_delete_users(db.users(), db.accounts(), db.transactions(), db.budgets(), doomed)
    parts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("table_name"), "rows_left")
             for n, df in [("users", u), ("accounts", a), ("transactions", t), ("budgets", b)]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("replace_account_history", "X8,X10", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default,
       CASE WHEN a.type = 'SAVINGS' AND a.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
            THEN CAST(COALESCE(n.t, 0) AS DOUBLE) ELSE a.balance END AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM({SIGNED}) AS t FROM newrows GROUP BY account_id) n
  ON n.account_id = a.account_id""", "v_accounts", "v_transactions", extra_ctes="""newrows AS (
  SELECT t.account_id, 'INCOME' AS type, t.amount / 10 AS amount FROM v_transactions t
  JOIN customer c ON c.c_custkey = t.user_id
  WHERE c.c_mktsegment = 'HOUSEHOLD' AND t.account_id % 2 = 1)"""))
def q_replace_account_history(spark, sf_dir):
    """Savings accounts of the HOUSEHOLD segment get a regenerated history
    (one deposit of a tenth of each old row)."""
    db = Ledger(spark, sf_dir)
    acc = db.accounts()
    seg = db.table("customer", "c_custkey", "c_mktsegment").filter(F.col("c_mktsegment") == "HOUSEHOLD") \
            .select(F.col("c_custkey").alias("user_id"))
    target = acc.filter(F.col("type") == "SAVINGS").join(seg, "user_id", "left_semi").select("account_id")
    tx = db.transactions()
    new_rows = (tx.join(target, "account_id", "left_semi")
                .withColumn("type", F.lit("INCOME")).withColumn("amount", F.col("amount") / 10))
    _, acc2 = X.replace_history(tx, acc, target, new_rows)
    return acc2


@query("token_bucket_events", "P4", oracle="""
SELECT event_id, user_id, ts, event_type,
       ROW_NUMBER() OVER (PARTITION BY user_id, floor((epoch_us(ts) - t0) / 3600000000) ORDER BY epoch_us(ts), event_id) <= 10 AS admitted
FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events)""")
def q_token_bucket_events(spark, sf_dir):
    """Per-user token bucket (capacity 10, 10 tokens per whole hour since the
    user's first request) replayed over the event log."""
    from ..streaming.rate_limit import token_bucket
    ev = Ledger(spark, sf_dir).table("events", "event_id", "user_id", "ts", "event_type")
    return token_bucket(ev)


@query("report_prompt_text", "C8,A3,A4", oracle=with_views("""
SELECT u.user_id, 'Total Income: $' || CAST(CAST(COALESCE(inc, 0) AS DECIMAL(18,2)) AS VARCHAR)
       || ', Total Expenses: $' || CAST(CAST(COALESCE(exp, 0) AS DECIMAL(18,2)) AS VARCHAR)
       || ', Net Income: $' || CAST(CAST(COALESCE(inc, 0) - COALESCE(exp, 0) AS DECIMAL(18,2)) AS VARCHAR)
       || ', Expense Categories: ' || COALESCE(cats, '') AS prompt_text
FROM v_users u LEFT JOIN st ON st.user_id = u.user_id LEFT JOIN ct ON ct.user_id = u.user_id""",
    "v_users", "v_transactions", extra_ctes=_month_ctes(_FEB)))
def q_report_prompt_text(spark, sf_dir):
    """The report's data block of every user: totals, net and the category
    amounts joined with ', ' (none for users without expenses)."""
    db = Ledger(spark, sf_dir)
    return L.report_prompt(db.users(), db.transactions("1998-02-01", "1998-02-28"), REPORT_MONTH)


@query("amend_transactions_balances_strict", "X2", oracle=with_views(f"""
SELECT a.account_id, a.user_id, a.type, a.is_default, CAST({M('a.balance')} + COALESCE(d.delta, 0) AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (SELECT account_id, SUM({SIGNED} - old_signed) AS delta FROM upd GROUP BY account_id) d
  ON d.account_id = a.account_id""", "v_accounts", "v_transactions", extra_ctes=_AMEND_CTE))
def q_amend_transactions_balances_strict(spark, sf_dir):
    """X2 with the reference's behaviour: the whole difference goes to the
    new account (a moved row leaves its old account unreversed)."""
    db = Ledger(spark, sf_dir)
    tx = db.transactions()
    _, acc = X.amend_transactions(tx, db.accounts(), _amend_requests(tx), strict=True)
    return acc


@query("account_chart_1m_by_date", "A5,F6", oracle=with_views(f"""
SELECT account_id, CAST(date AS DATE) AS day,
       CAST(COALESCE(SUM(CASE WHEN type = 'INCOME' THEN {M('amount')} END), 0) AS DOUBLE) AS income,
       CAST(COALESCE(SUM(CASE WHEN type = 'EXPENSE' THEN {M('amount')} END), 0) AS DOUBLE) AS expense
FROM v_transactions WHERE date >= TIMESTAMP '1998-02-13 00:00:00' AND date < TIMESTAMP '1998-03-16 00:00:00'
GROUP BY account_id, CAST(date AS DATE)""", "v_transactions"))
def q_account_chart_by_date(spark, sf_dir):
    """A5 keyed by the calendar date instead of the 'MMM dd' label."""
    return L.daily_chart(Ledger(spark, sf_dir).transactions("1998-02-13", "1998-03-16"), NOW, "1M", by_date=True)


@query("monthly_report_whole_month", "G15,F4", oracle=_report_sql(_WHOLE_FEB))
def q_monthly_report_whole_month(spark, sf_dir):
    """G15 with ``strict=False``: the whole calendar month, including the
    hours of its last day that the reference's bound leaves out."""
    db = Ledger(spark, sf_dir)
    return _report_rows(L.monthly_report(db.users(), db.transactions("1998-02-01", "1998-03-01"), REPORT_MONTH, strict=False))


_CAT_VALUES = "(VALUES " + ", ".join(
    f"('{i}', '{n}', '{t}', '{c}', '{', '.join(sub)}')" for i, n, t, c, sub in LEDGER_CATEGORIES) + ") lc(cid, label, ctype, color, subcategories)"
_INTERVALS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.INTERVAL_LABELS.items())


@query("category_totals_labelled", "R2,A7", oracle=with_views(f"""
SELECT t.category, lc.label, lc.color, lc.subcategories, t.interval_label, t.amount, t.transaction_count
FROM (SELECT category, type, CASE recurring_interval {_INTERVALS} END AS interval_label,
             CAST(SUM({M('amount')}) AS DOUBLE) AS amount, COUNT(*) AS transaction_count
      FROM v_transactions GROUP BY category, type, recurring_interval) t
LEFT JOIN {_CAT_VALUES} ON lc.cid = t.category AND lc.ctype = t.type""", "v_transactions"))
def q_category_totals_labelled(spark, sf_dir):
    """R2: totals per category and recurrence with the category's label, colour
    and subcategories (a fixed 21-row table) and the interval's label."""
    tx = Ledger(spark, sf_dir).transactions()
    per = tx.groupBy("category", "type", "recurring_interval").agg(
        as_number(F.sum(money("amount"))).alias("amount"), F.count("*").alias("transaction_count"))
    cats = F.broadcast(ledger_categories_df(spark).select(
        F.col("id").alias("category"), "type", F.col("name").alias("label"), "color",
        F.array_join("subcategories", ", ").alias("subcategories")))
    return per.join(cats, ["category", "type"], "left").select(
        "category", "label", "color", "subcategories",
        dims.map_expr(dims.INTERVAL_LABELS, F.col("recurring_interval")).alias("interval_label"), "amount", "transaction_count")


@query("receipt_records", "C7,F18", oracle="""
SELECT id, parsed, CASE WHEN good THEN amount END AS amount, CASE WHEN good THEN date END AS date,
       CASE WHEN good THEN 'Order of ' || clerk END AS description, CASE WHEN good THEN 'shopping' END AS category,
       CASE WHEN good THEN clerk END AS merchant_name, parsed AND good AND amount > 0 AS accepted
FROM (SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS parsed, o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS good,
             o_totalprice AS amount, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS date, o_orderpriority AS clerk FROM orders)""")
def q_receipt_records(spark, sf_dir):
    """Receipt replies (built from the orders: fenced JSON, every 17th an empty
    object, every 13th no JSON) parsed to records; rows not ``accepted`` are the
    quarantine."""
    from ..functions.text import receipt_record
    o = Ledger(spark, sf_dir).table("orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    body = F.to_json(F.struct(F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                              F.concat(F.lit("Order of "), F.col("o_orderpriority")).alias("description"),
                              F.col("o_orderpriority").alias("merchantName"), F.lit("shopping").alias("category")))
    reply = (F.when(F.col("o_orderkey") % 13 == 0, F.lit("I could not read this receipt"))
             .when(F.col("o_orderkey") % 17 == 0, F.lit("```json\n{}\n```"))
             .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))))
    r = o.select(F.col("o_orderkey").alias("id"), receipt_record(reply).alias("r")).select("id", "r.*")
    return r.withColumn("accepted", F.col("parsed") & F.coalesce(F.col("amount") > 0, F.lit(False)))
