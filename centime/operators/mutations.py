"""Ledger mutations as table transformations.

Each operator takes the current tables and a batch of requests and returns
new tables (copy-on-write: write the result as a new snapshot, then swap).
Balance changes are always summed per account first and applied with one
join, never row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import next_recurring_date
from ..functions.money import as_number, money, signed_amount
from . import ledger as L

def _zero():
    return F.lit(0).cast("decimal(18,2)")


def apply_deltas(accounts: DataFrame, delta: DataFrame) -> DataFrame:
    """Add per-account ``delta`` (decimal) to ``balance``."""
    d = delta.groupBy("account_id").agg(F.sum("delta").alias("_d"))
    return (accounts.join(d, "account_id", "left")
            .withColumn("balance", as_number(money("balance") + F.coalesce("_d", _zero())))
            .drop("_d"))


def post_transactions(tx: DataFrame, accounts: DataFrame, requests: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ownership check, next date for recurring rows, balance +/- amount.

    Returns (new rows, all transactions, accounts, rejected requests).
    """
    ok, rejected = L.owned(requests, accounts)
    rows = ok.withColumn(
        "next_recurring_date",
        F.when(F.col("is_recurring") & F.col("recurring_interval").isNotNull(),
               next_recurring_date("date", "recurring_interval")))
    delta = rows.select("account_id", signed_amount("type", money("amount")).alias("delta"))
    cols = [c for c in tx.columns if c in rows.columns]
    return rows, tx.unionByName(rows.select(*cols)), apply_deltas(accounts, delta), rejected


def amend_transactions(tx: DataFrame, accounts: DataFrame, updates: DataFrame,
                       strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace owned rows and move the balance difference.

    Default: the old signed amount is reversed on the old account and the
    new one applied on the new account.  ``strict=True`` keeps the
    reference's behaviour of putting the whole difference on the new account
    (an account move leaves the old account unreversed).
    """
    old = tx.select("id", "user_id", F.col("account_id").alias("old_account_id"),
                    signed_amount("type", money("amount")).alias("old_signed"))
    u = updates.join(old, ["id", "user_id"], "inner")  # ownership: id must belong to the user
    new_signed = signed_amount("type", money("amount"))
    if strict:
        delta = u.select("account_id", (new_signed - F.col("old_signed")).alias("delta"))
    else:
        delta = (u.select(F.col("old_account_id").alias("account_id"), (-F.col("old_signed")).alias("delta"))
                 .unionByName(u.select("account_id", new_signed.alias("delta"))))
    upd = u.drop("old_account_id", "old_signed").withColumn(
        "next_recurring_date",
        F.when(F.col("is_recurring") & F.col("recurring_interval").isNotNull(),
               next_recurring_date("date", "recurring_interval")))
    cols = [c for c in tx.columns if c in upd.columns]
    new_tx = tx.join(upd.select("id"), "id", "left_anti").unionByName(upd.select(*cols), allowMissingColumns=True)
    return new_tx, apply_deltas(accounts, delta)


def bulk_delete(tx: DataFrame, accounts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete owned ids (request: id, user_id) and reverse their balances."""
    gone = tx.join(requests.select("id", "user_id"), ["id", "user_id"], "left_semi")
    delta = L.balance_delta_of_delete(gone)
    return tx.join(gone.select("id"), "id", "left_anti"), apply_deltas(accounts, delta)


def _turn(requests: DataFrame, *then: str) -> Column:
    """Order of a batch's requests: their ``seq`` column if they have one, then
    the given columns, so that the same request wins in every run."""
    return F.struct(*([F.col("seq")] if "seq" in requests.columns else []), *then)


def set_default(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Per requesting user, the target account becomes the only default;
    of several requests of a user the last one holds.

    Requests for accounts the user does not own change nothing.
    """
    own = requests.join(accounts.select("user_id", "account_id"), ["user_id", "account_id"], "left_semi")
    req = own.groupBy("user_id").agg(F.max_by("account_id", _turn(own, "account_id")).alias("_target"))
    j = accounts.join(req, "user_id", "left")
    return (j.withColumn("is_default", F.when(F.col("_target").isNull(), F.col("is_default"))
                         .otherwise(F.col("account_id") == F.col("_target")))
            .drop("_target"))


def open_accounts(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Open one account per request (account_id, user_id, type, balance
    text, is_default).  A user's first account is always default; a new
    default clears the user's other defaults, so of several default requests
    the last one holds.  Balances that do not parse are rejected (F19)."""
    r = requests.withColumn("_bal", F.expr("try_cast(balance AS DOUBLE)"))
    r = r.filter(F.col("_bal").isNotNull() & ~F.isnan("_bal"))
    has = accounts.select("user_id").distinct().withColumn("_has", F.lit(True))
    turn = _turn(r, "account_id")
    # the user's last default request, or the first request of a user without accounts
    winner = (r.join(has, "user_id", "left").groupBy("user_id").agg(
        F.max_by("account_id", F.when(F.col("is_default"), turn)).alias("_last"),
        F.min_by("account_id", turn).alias("_first"), F.first("_has").alias("_has")))
    winner = winner.select("user_id", F.coalesce("_last", F.when(F.col("_has").isNull(), F.col("_first"))).alias("_win"))
    r = (r.join(winner, "user_id", "left")
         .withColumn("is_default", F.coalesce(F.col("account_id") == F.col("_win"), F.lit(False)))
         .withColumn("balance", F.col("_bal")).drop("_bal", "_win"))
    clear = r.filter("is_default").select("user_id").distinct().withColumn("_clear", F.lit(True))
    old = (accounts.join(clear, "user_id", "left")
           .withColumn("is_default", F.col("is_default") & F.col("_clear").isNull()).drop("_clear"))
    return old.unionByName(r.select(*accounts.columns))


def upsert_budgets(budgets: DataFrame, requests: DataFrame) -> DataFrame:
    """One budget per user; update the amount if present, else insert.  Of
    several requests of a user the last one holds; amounts that are no number
    above zero are rejected (F19)."""
    requests = requests.filter(L.valid_budget_amount("amount")).withColumn("amount", F.expr("try_cast(amount AS DOUBLE)"))
    r = requests.groupBy("user_id").agg(F.max_by("amount", _turn(requests, "amount")).alias("_new"))
    j = budgets.join(r, "user_id", "full_outer")
    return j.select("user_id", F.coalesce("_new", "amount").alias("amount"), "last_alert_sent")


def register_users(users: DataFrame, requests: DataFrame, key: str = "email") -> DataFrame:
    """Insert requested users whose external key is not present; of several
    requests with one key the first one holds."""
    fresh = requests.join(users.select(key), key, "left_anti")
    row = F.struct(*[c for c in users.columns if c != key])
    new = fresh.groupBy(key).agg(F.min_by(row, _turn(fresh, *[c for c in users.columns if c != key])).alias("_r")).select(key, "_r.*")
    return users.unionByName(new.select(*users.columns))


def replace_history(tx: DataFrame, accounts: DataFrame, account_ids: DataFrame,
                    new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the accounts' rows, insert the batch, balance = signed total."""
    keep = tx.join(account_ids.select("account_id"), "account_id", "left_anti")
    tx2 = keep.unionByName(new_rows.select(*tx.columns))
    tot = new_rows.groupBy("account_id").agg(F.sum(signed_amount("type", money("amount"))).alias("_t"))
    target = account_ids.select("account_id").withColumn("_hit", F.lit(True))
    acc = (accounts.join(target, "account_id", "left").join(tot, "account_id", "left")
           .withColumn("balance", F.when(F.col("_hit"), as_number(F.coalesce("_t", _zero())))
                       .otherwise(F.col("balance")))
           .drop("_hit", "_t"))
    return tx2, acc


def cascade_delete_users(users: DataFrame, accounts: DataFrame, tx: DataFrame, budgets: DataFrame,
                         doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """User -> accounts, transactions, budget; account -> transactions."""
    d = doomed.select("user_id").distinct()
    acc = accounts.join(d, "user_id", "left_anti")
    return (users.join(d, "user_id", "left_anti"), acc,
            tx.join(d, "user_id", "left_anti").join(acc.select("account_id"), "account_id", "left_semi"),
            budgets.join(d, "user_id", "left_anti"))


def reconcile(accounts: DataFrame, tx: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Stored balance vs opening + sum of signed amounts, and the drift."""
    s = tx.groupBy("account_id").agg(F.sum(signed_amount("type", money("amount"))).alias("_s"))
    j = accounts.join(s, "account_id", "left")
    if opening is not None:
        j = j.join(opening.select("account_id", F.col("opening").alias("_o")), "account_id", "left")
        base = F.coalesce(money("_o"), _zero())
    else:
        base = _zero()
    expected = base + F.coalesce("_s", _zero())
    return j.select("account_id", "user_id", as_number(money("balance")).alias("balance"),
                    as_number(expected).alias("expected_balance"),
                    as_number(money("balance") - expected).alias("drift"))
