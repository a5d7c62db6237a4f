"""Ledger read operators: filters, joins, aggregates, listings (F1-F20, J1-J4,
J12, J13, A1-A9, T1-T5, W12).

Every operator works on all users at once.  Aggregates are pre-aggregated per
key before any join (map-side partial aggregation), so a user or account that
owns a third of all rows costs one partial row per input partition, not a hot
shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.dates import day_label, month_last_day, month_name, month_start, ts_lit
from ..functions.money import as_number, money, round_to, signed_amount
from ..functions.text import category_amounts_text, display_description


# ---------------------------------------------------------------- filters ---

def month_window(date_col: str, anchor: str, strict: bool = True) -> Column:
    """date within the month of ``anchor`` (a timestamp literal text).

    ``strict`` keeps the reference bound [first 00:00, last day 00:00]; anything
    later on the month's last day falls outside.  ``strict=False`` takes the
    whole calendar month.
    """
    a = ts_lit(anchor)
    lo = month_start(a)
    if strict:
        return (F.col(date_col) >= lo) & (F.col(date_col) <= month_last_day(a))
    return (F.col(date_col) >= lo) & (F.col(date_col) < month_last_day(a) + F.expr("INTERVAL 1 DAY"))


def same_calendar_month(date_col: str, now: str) -> Column:
    """month and year equal to now's (no last-day cut-off)."""
    return F.trunc(F.to_date(date_col), "MM") == F.trunc(F.to_date(ts_lit(now)), "MM")


def point_lookup(requests: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per requested key (null keys too) with ``n_requests``, ``found`` and
    ``columns`` of the row of ``table`` that has it; ``table`` holds a key at most once.

    With the owner among the keys, a row of another owner is not found.  Requests
    are counted before the join, so a key that everybody asks for is one row a task.
    """
    asked = requests.groupBy(*keys).agg(F.count("*").alias("n_requests"))
    have = table.select(*keys, *columns, F.lit(True).alias("found"))
    return asked.join(have, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


TRAILING_DAYS = {"7D": 7, "1M": 30, "3M": 90, "6M": 180}


def trailing_range(date_col: str, now: str, key: str) -> Column:
    """[start of day(now - n), end of day(now)]; 'ALL' has no lower bound,
    but ends with the day too: rows dated in the future are in no range."""
    today = F.to_date(ts_lit(now))
    ended = F.col(date_col) < F.to_timestamp_ntz(F.date_add(today, 1).cast("string"))
    if key == "ALL":
        return ended
    return (F.col(date_col) >= F.to_timestamp_ntz(F.date_sub(today, TRAILING_DAYS[key]).cast("string"))) & ended


def filter_transactions(tx: DataFrame, search: str | None = None, type_: str | None = None,
                        recurring: bool | None = None, where: Column | None = None) -> DataFrame:
    """Description search (case-insensitive, NULL never matches),
    type, recurring flag and a caller-supplied extra predicate."""
    if search:
        tx = tx.filter(F.lower(F.col("description")).contains(search.lower()))
    if type_:
        tx = tx.filter(F.col("type") == type_)
    if recurring is not None:
        tx = tx.filter(F.col("is_recurring") == F.lit(recurring))
    if where is not None:
        tx = tx.filter(where)
    return tx


def due_recurring_predicate(now: str) -> Column:
    """recurring, completed, never processed or next date reached.

    Written so a NULL next date with a non-NULL last-processed is not due
    (three-valued logic collapses to false, as in the reference's OR).
    """
    return (F.col("is_recurring") & (F.col("status") == "COMPLETED")
            & (F.col("last_processed").isNull()
               | F.coalesce(F.col("next_recurring_date") <= ts_lit(now), F.lit(False))))


def is_due(now: str) -> Column:
    """never processed -> due; else next date <= now."""
    return F.when(F.col("last_processed").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.col("next_recurring_date") <= ts_lit(now), F.lit(False)))


def validation_errors(tx: DataFrame) -> Column:
    """list of rule violations of a transaction row (empty = valid)."""
    amt = F.col("amount").cast("string")
    checks = [
        (~F.col("type").isin("INCOME", "EXPENSE") | F.col("type").isNull(), "type: invalid enum"),
        (F.coalesce(F.length(amt), F.lit(0)) < 1, "amount: Amount is required"),
        (F.expr("try_cast(amount AS DOUBLE)").isNull(), "amount: not a number"),
        (F.col("date").isNull(), "date: Date is required"),
        (F.coalesce(F.length(F.col("account_id").cast("string")), F.lit(0)) < 1,
         "accountId: Account is required"),
        (F.coalesce(F.length("category"), F.lit(0)) < 1, "category: Category is required"),
        (F.coalesce(F.col("is_recurring"), F.lit(False)) & F.col("recurring_interval").isNull(),
         "recurringInterval: Recurring interval is required for recurring transactions"),
        (F.col("recurring_interval").isNotNull()
         & ~F.col("recurring_interval").isin(*dims.INTERVAL_LABELS.keys()),
         "recurringInterval: invalid enum"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def valid_budget_amount(c) -> Column:
    """numeric and > 0."""
    v = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v > 0)


# ------------------------------------------------------------------ joins ---

def with_account(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each transaction with its account's type/default flag."""
    a = accounts.select("account_id", F.col("type").alias("account_type"),
                        F.col("is_default").alias("account_is_default"))
    return tx.join(a, "account_id", "inner")


def account_tx_counts(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """Every account with its transaction count (0 kept)."""
    counts = tx.groupBy("account_id").agg(F.count("id").alias("transaction_count"))
    return (accounts.join(counts, "account_id", "left")
            .withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)).cast("long")))


def owned(requests: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose account belongs to the user, rejected requests)."""
    keys = accounts.select("account_id", "user_id")
    return (requests.join(keys, ["account_id", "user_id"], "left_semi"),
            requests.join(keys, ["account_id", "user_id"], "left_anti"))


def default_account(accounts: DataFrame, only_default: bool = True) -> DataFrame:
    """One account per user.

    ``only_default``: the first default account (users without one drop out);
    otherwise the default if any, else the most recent account.
    """
    w = Window.partitionBy("user_id")
    if only_default:
        a = accounts.filter("is_default")
        return (a.withColumn("_rn", F.row_number().over(w.orderBy("account_id")))
                .filter("_rn = 1").drop("_rn"))
    order = [F.col("is_default").desc()]
    if "created_at" in accounts.columns:
        order.append(F.col("created_at").desc())
    order.append(F.col("account_id").desc())
    return (accounts.withColumn("_rn", F.row_number().over(w.orderBy(*order)))
            .filter("_rn = 1").drop("_rn"))


# ------------------------------------------------------------- aggregates ---

def expense_sum(cond: Column | None = None) -> Column:
    """Exact (decimal) sum of EXPENSE amounts matching ``cond``."""
    c = F.col("type") == "EXPENSE"
    if cond is not None:
        c = c & cond
    return F.sum(F.when(c, money("amount")))


def month_to_date_spend(tx: DataFrame, now: str, strict: bool = True) -> DataFrame:
    """A1: EXPENSE sum per (user, account) in the current month, NULL -> 0."""
    t = tx.filter((F.col("type") == "EXPENSE") & month_window("date", now, strict))
    return (t.groupBy("user_id", "account_id")
            .agg(F.sum(money("amount")).alias("spend")))


def budget_utilisation(accounts: DataFrame, budgets: DataFrame, spend: DataFrame) -> DataFrame:
    """A2: per account, spend / budget x 100 and its colour band."""
    b = budgets.select("user_id", F.col("amount").alias("budget_amount"))
    s = spend.select("account_id", "spend")
    j = (accounts.select("account_id", "user_id")
         .join(s, "account_id", "left").join(b, "user_id", "left"))
    spent = as_number(F.coalesce("spend", F.lit(0).cast("decimal(18,2)")))
    pct = F.when(F.col("budget_amount") > 0, spent / F.col("budget_amount") * 100).otherwise(F.lit(0.0))
    return j.select(
        "user_id", "account_id", "budget_amount",
        spent.alias("current_expenses"),
        round_to(pct, 6).alias("pct_used"),
        F.when(pct >= 90, "red").when(pct >= 75, "yellow").otherwise("green").alias("band"))


def monthly_stats(tx: DataFrame, month_anchor: str, strict: bool = True) -> DataFrame:
    """A3/A4: per user totals of a month, and the expenses of every category
    that occurs, whatever its name, as the map ``by_category``.

    Rows are first summed per (user, type, category), map-side; a user's map
    then holds one entry per category.
    """
    t = tx.filter(month_window("date", month_anchor, strict))
    per = t.groupBy("user_id", "type", "category").agg(F.sum(money("amount")).alias("amt"), F.count("*").alias("n"))
    spent = F.col("type") == "EXPENSE"
    entry = F.struct("category", F.col("amt").cast("decimal(18,2)").alias("amt"))
    return per.groupBy("user_id").agg(
        F.sum(F.when(F.col("type") == "INCOME", F.col("amt"))).alias("total_income"),
        F.sum(F.when(spent, F.col("amt"))).alias("total_expenses"),
        F.sum("n").alias("transaction_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(spent & F.col("category").isNotNull(), entry)))).alias("by_category"))


def monthly_report(users: DataFrame, tx: DataFrame, month_anchor: str, strict: bool = True) -> DataFrame:
    """Previous-month report for every user (zeros and an empty map when
    inactive), with the fallback insights."""
    st = monthly_stats(tx, month_anchor, strict)
    zero = F.lit(0).cast("decimal(18,2)")
    cols = [F.col("user_id"), F.col("email"), F.col("name"),
            month_name(ts_lit(month_anchor)).alias("month")]
    inc = F.coalesce("total_income", zero)
    exp = F.coalesce("total_expenses", zero)
    cols += [as_number(inc).alias("total_income"), as_number(exp).alias("total_expenses"),
             as_number(inc - exp).alias("net_income"),
             F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
             F.coalesce("by_category", F.create_map().cast("map<string,decimal(18,2)>")).alias("by_category"),
             F.array(*[F.lit(s) for s in dims.FALLBACK_INSIGHTS]).alias("insights")]
    return users.join(st, "user_id", "left").select(*cols)


def report_prompt(users: DataFrame, tx: DataFrame, month_anchor: str, strict: bool = True) -> DataFrame:
    """The data block of the report's prompt, one for every user."""
    st = monthly_stats(tx, month_anchor, strict)
    inc, exp = (F.coalesce(c, F.lit(0)).cast("decimal(18,2)") for c in ("total_income", "total_expenses"))
    return users.select("user_id").join(st, "user_id", "left").select("user_id", F.concat(
        F.lit("Total Income: $"), inc.cast("string"), F.lit(", Total Expenses: $"), exp.cast("string"),
        F.lit(", Net Income: $"), (inc - exp).cast("decimal(18,2)").cast("string"), F.lit(", Expense Categories: "),
        F.coalesce(category_amounts_text("by_category"), F.lit(""))).alias("prompt_text"))


def category_breakdown(tx: DataFrame, now: str) -> DataFrame:
    """Current calendar month expenses by (account, category)."""
    t = tx.filter((F.col("type") == "EXPENSE") & same_calendar_month("date", now))
    return (t.groupBy("account_id", "category")
            .agg(as_number(F.sum(money("amount"))).alias("amount"),
                 F.count("*").alias("transaction_count")))


def daily_chart(tx: DataFrame, now: str, range_key: str = "1M", by_date: bool = False) -> DataFrame:
    """A5: income/expense per account and day in a trailing range.

    The reference keys days by their 'MMM dd' label, so the same day of two
    different years merges (range 'ALL'); ``by_date=True`` keys by the date.
    """
    t = tx.filter(trailing_range("date", now, range_key))
    key = F.to_date("date") if by_date else day_label("date")
    g = t.groupBy("account_id", key.alias("day")).agg(
        as_number(F.coalesce(F.sum(F.when(F.col("type") == "INCOME", money("amount"))),
                             F.lit(0).cast("decimal(18,2)"))).alias("income"),
        as_number(F.coalesce(expense_sum(), F.lit(0).cast("decimal(18,2)"))).alias("expense"))
    return g


def range_totals(tx: DataFrame, now: str, range_key: str = "1M") -> DataFrame:
    """Per account totals of the chart range and the net."""
    t = tx.filter(trailing_range("date", now, range_key))
    zero = F.lit(0).cast("decimal(18,2)")
    inc = F.coalesce(F.sum(F.when(F.col("type") == "INCOME", money("amount"))), zero)
    exp = F.coalesce(expense_sum(), zero)
    return t.groupBy("account_id").agg(
        as_number(inc).alias("total_income"), as_number(exp).alias("total_expense"),
        as_number(inc - exp).alias("net"))


def balance_delta_of_delete(tx: DataFrame) -> DataFrame:
    """Per account balance change when the given rows are deleted
    (+amount for EXPENSE, -amount for INCOME)."""
    return tx.groupBy("account_id").agg(
        F.sum(-signed_amount("type", money("amount"))).alias("delta"))


# --------------------------------------------------------------- listings ---

SORT_FIELDS = {"date": "date", "amount": "amount", "category": "category"}


def sort_transactions(tx: DataFrame, field: str = "date", ascending: bool = False) -> DataFrame:
    """Sort with an id tie-break (total order, stable pages)."""
    c = F.col(SORT_FIELDS[field])
    return tx.orderBy(c.asc() if ascending else c.desc(),
                      F.col("id").asc() if ascending else F.col("id").desc())


def page_of(tx: DataFrame, page: int, page_size: int = dims.PAGE_SIZE,
            partition_by: str = "account_id", field: str = "date", ascending: bool = False) -> DataFrame:
    """Page ``page`` (1-based) of each account's sorted list, plus total pages.

    The per-account row_number filter becomes a WindowGroupLimit before the
    shuffle, so each task keeps at most page*page_size rows per account.
    """
    c = F.col(SORT_FIELDS[field])
    order = [c.asc() if ascending else c.desc(), F.col("id").asc() if ascending else F.col("id").desc()]
    w = Window.partitionBy(partition_by).orderBy(*order)
    lo = (page - 1) * page_size
    ranked = tx.withColumn("row_in_list", F.row_number().over(w))
    sliced = ranked.filter((F.col("row_in_list") > lo) & (F.col("row_in_list") <= lo + page_size))
    totals = tx.groupBy(partition_by).agg(
        F.ceil(F.count("*") / F.lit(page_size)).cast("long").alias("total_pages"))
    return sliced.join(totals, partition_by, "inner")


def recent_per_account(tx: DataFrame, n: int = 5) -> DataFrame:
    """T5: the n most recent transactions of every account."""
    w = Window.partitionBy("account_id").orderBy(F.col("date").desc(), F.col("id").desc())
    return (tx.withColumn("recent_rank", F.row_number().over(w))
            .filter(F.col("recent_rank") <= n)
            .withColumn("display_description", display_description("description")))


def account_history(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """J2 (flat form) / T1: every account with each of its transactions and
    the account's transaction count, ordered account, date desc.

    Transactions are the left side of an inner join, which AQE splits when an
    account is heavy; accounts without transactions are added by an anti join.
    The sort is a distributed range sort, so a heavy account's history never
    becomes one in-memory list.
    """
    counts = tx.groupBy("account_id").agg(F.count("id").alias("transaction_count"))
    t = tx.select("account_id", F.col("id").alias("tx_id"), F.col("date").alias("tx_date"),
                  F.col("type").alias("tx_type"), as_number(money("amount")).alias("tx_amount"),
                  display_description("description").alias("tx_description"),
                  F.col("category").alias("tx_category"))
    known = accounts.join(counts, "account_id", "left").withColumn(
        "transaction_count", F.coalesce("transaction_count", F.lit(0)).cast("long"))
    order = [*accounts.columns, *[c for c in t.columns if c != "account_id"], "transaction_count"]
    full = t.join(known, "account_id").select(*order)
    bare = known.join(tx.select("account_id"), "account_id", "left_anti")
    bare = bare.select(*[F.col(c) if c in bare.columns else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in order])
    return full.unionByName(bare).orderBy("account_id", F.col("tx_date").desc(), F.col("tx_id").desc())


def validate_transactions(tx: DataFrame, ledger_categories: DataFrame) -> DataFrame:
    """rule violations per row; the category must be one offered
    for the row's type (joined from the fixed 21-row category table)."""
    cats = F.broadcast(ledger_categories.select(F.col("id").alias("_cid"),
                                                F.col("type").alias("_ctype")))
    j = tx.join(cats, (F.col("category") == F.col("_cid")) & (F.col("type") == F.col("_ctype")), "left")
    errs = F.concat(validation_errors(j), F.array_compact(F.array(
        F.when(F.col("category").isNotNull() & F.col("_ctype").isNull(),
               F.lit("category: not offered for this type")))))
    return j.withColumn("errors", errs).drop("_cid", "_ctype")
