"""Domain scoring operators, table in -> table out (G1-G8, J6-J8, J14, W7,
W11, A22, R1, M1-M3, C4, C6).

All rule logic is column expressions; the fixed benchmark, lifestyle and
class tables (a few rows each) are literal maps or broadcast joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.dates import is_night
from ..functions.money import as_number, clip, col_, money, round_to
from ..functions.text import money_text, title_case

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US


def _epoch_us(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def baseline_category(category) -> Column:
    """lower(category) if it has a benchmark, else 'shopping'."""
    c = F.lower(col_(category))
    return F.when(c.isin(*dims.BASELINES.keys()), c).otherwise(F.lit(dims.DEFAULT_BASELINE_CATEGORY))


def _baseline(cat: Column, idx: int) -> Column:
    return dims.map_expr({k: v[idx] for k, v in dims.BASELINES.items()}, cat)


# ---------------------------------------------------------------- velocity --

def velocity(events: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
             window_us: int = HOUR_US) -> DataFrame:
    """Number of the key's events in [ts - window, ts] (itself included).

    Rows are partitioned by (key, time bucket of one window length); each row
    is also copied into the next bucket as context, so every frame is
    complete while a key's history is split across many buckets (a hot key
    does not land in one task).
    """
    e = events.select(key, id_col, _epoch_us(ts).alias("_t"))
    e = e.withColumn("_bk", F.floor(F.col("_t") / window_us))
    both = (e.withColumn("_home", F.lit(True))
            .unionByName(e.withColumn("_bk", F.col("_bk") + 1).withColumn("_home", F.lit(False))))
    w = Window.partitionBy(key, "_bk").orderBy("_t").rangeBetween(-window_us, 0)
    v = both.withColumn("velocity_1h", F.count("*").over(w)).filter("_home")
    return v.select(id_col, F.col("velocity_1h").cast("int"))


# ---------------------------------------------------------------- features --

def fraud_features(events: DataFrame, with_velocity: bool = True) -> DataFrame:
    """Model features of each transaction.

    Input columns: amount, category, hour_of_day, distance_from_home_km,
    device_trust_score, merchant_risk_score, is_foreign_currency, optional
    is_weekend / velocity_1h (derived from ``ts`` when absent).
    """
    df = events
    if with_velocity and "velocity_1h" not in df.columns:
        df = df.join(velocity(df), "event_id", "left")
    cat = baseline_category("category")
    median = _baseline(cat, 0)
    weekend = (F.col("is_weekend") if "is_weekend" in df.columns
               else (F.weekday("ts") >= 5).cast("int") if "ts" in df.columns else F.lit(0))
    return df.select(
        *[c for c in df.columns if c not in ("is_weekend",)],
        cat.alias("baseline_category"),
        round_to(F.col("amount") / F.greatest(F.lit(1.0), median), 3).alias("amount_to_category_ratio"),
        is_night("hour_of_day").alias("is_night_time"),
        weekend.alias("is_weekend"),
        clip("device_trust_score", 0.0, 1.0).alias("trust_clipped"),
        clip("merchant_risk_score", 0.0, 1.0).alias("merchant_risk_clipped"),
    )


def reason_flags(f: DataFrame) -> list[Column]:
    """G5 as flags, in the reference's order (the high-amount code only when
    the spike code is absent)."""
    cat = F.col("baseline_category")
    spike = F.col("amount_to_category_ratio") >= 5.0
    return [
        spike.alias("r_spend_spike"),
        (~spike & (F.col("amount") >= _baseline(cat, 2) * 2.0)).alias("r_high_amount"),
        (F.col("is_night_time") == 1).alias("r_off_hours"),
        (F.col("trust_clipped") < 0.35).alias("r_untrusted_device"),
        (F.col("distance_from_home_km") >= 300.0).alias("r_geo_deviation"),
        (F.col("merchant_risk_clipped") >= 0.65).alias("r_merchant_risk"),
        (F.col("is_foreign_currency") == 1).alias("r_cross_border"),
        (F.coalesce(F.col("velocity_1h"), F.lit(1)) >= 4).alias("r_velocity_burst"),
    ]


def reason_texts(f: DataFrame) -> Column:
    """The explanation strings (normal-behaviour line when none)."""
    cat = F.col("baseline_category")
    spike = F.col("amount_to_category_ratio") >= 5.0
    texts = [
        F.when(spike, F.concat(F.lit("Unusual spend spike: Amount is "),
                               round_to(F.col("amount_to_category_ratio"), 1).cast("string"),
                               F.lit("x higher than the typical "), cat, F.lit(" median (INR "),
                               F.format_number(_baseline(cat, 0), 0), F.lit(")."))),
        F.when(~spike & (F.col("amount") >= _baseline(cat, 2) * 2.0),
               F.concat(F.lit("High monetary amount: Transaction (INR "), money_text(money("amount")),
                        F.lit(") significantly exceeds the 95th percentile."))),
        F.when(F.col("is_night_time") == 1,
               F.concat(F.lit("Off-hours activity: Transaction initiated at "),
                        F.lpad(F.col("hour_of_day").cast("string"), 2, "0"), F.lit(":00 hours."))),
        F.when(F.col("trust_clipped") < 0.35,
               F.lit("Unrecognized hardware: Transaction performed from a new or untrusted device.")),
        F.when(F.col("distance_from_home_km") >= 300.0,
               F.concat(F.lit("Geo-location deviation: Transaction location is "),
                        F.format_number("distance_from_home_km", 0), F.lit(" km away from registered home base."))),
        F.when(F.col("merchant_risk_clipped") >= 0.65,
               F.lit("High merchant risk: Merchant category or terminal has elevated dispute/fraud risk.")),
        F.when(F.col("is_foreign_currency") == 1,
               F.lit("Cross-border transaction: Payment processed in a foreign currency.")),
        F.when(F.coalesce(F.col("velocity_1h"), F.lit(1)) >= 4,
               F.concat(F.lit("High velocity burst: "), F.col("velocity_1h").cast("string"),
                        F.lit(" transactions detected within the last 60 minutes."))),
    ]
    arr = F.array_compact(F.array(*texts))
    return F.when(F.size(arr) == 0, F.array(F.lit("Transaction pattern aligns with normal user behavior."))
                  ).otherwise(arr)


def fraud_probability(f: DataFrame) -> Column:
    """Rule fallback probability, clipped to [0.01, 0.99]."""
    p = F.lit(0.05)
    p = p + F.when(F.col("amount_to_category_ratio") >= 7.0, 0.40).otherwise(0.0)
    p = p + F.when(F.col("is_night_time") == 1, 0.20).otherwise(0.0)
    p = p + F.when(F.col("trust_clipped") < 0.3, 0.25).otherwise(0.0)
    p = p + F.when(F.col("merchant_risk_clipped") > 0.6, 0.20).otherwise(0.0)
    return clip(p, 0.01, 0.99)


def risk_tier(prob: Column) -> list[Column]:
    """Tier and action from the probability, percentage with 1 decimal."""
    level = F.when(prob >= 0.70, "HIGH").when(prob >= 0.30, "MEDIUM").otherwise("LOW")
    action = (F.when(prob >= 0.70, "BLOCK_TRANSACTION").when(prob >= 0.30, "MANUAL_REVIEW")
              .otherwise("ALLOW"))
    detail = dims.map_expr(dims.ACTION_DETAILS, action)
    return [round_to(prob, 4).alias("fraud_probability"), round_to(prob * 100.0, 1).alias("fraud_percentage"),
            level.alias("risk_level"), action.alias("recommended_action"), detail.alias("action_detail")]


def fraud_risk(events: DataFrame) -> DataFrame:
    """Probability, tier, action with its text, and the risk factors."""
    f = fraud_features(events)
    p = fraud_probability(f)
    return f.select("*", *risk_tier(p), reason_texts(f).alias("risk_factors"))


# -------------------------------------------------------------- duplicates --

def duplicate_flags(tx: DataFrame, key: str = "user_id", merchant: str = "merchant", amount: str = "amount",
                    ts: str = "ts", id_col: str = "event_id", window_us: int = DAY_US,
                    tolerance: float = 0.01) -> DataFrame:
    """Is there another transaction of the same key and merchant
    (case-insensitive), |amount difference| < tolerance, at or before this
    one and at most ``window_us`` earlier?

    Exact without pairing rows: amounts are bucketed by cents (floor of
    amount x 100), each row is compared only with rows of its own and the
    two neighbouring buckets, and inside a bucket the question becomes a
    window over time: same bucket -> any other row in the frame (the
    difference is below a cent); bucket above -> is the frame's minimum
    amount within tolerance; bucket below -> is the maximum.  Partitions
    also carry a time bucket (rows copied into the next one as context), so
    a hot (key, merchant, amount) is split by time.
    """
    base = tx.select(F.col(id_col).alias("_id"), F.col(key).alias("_k"), F.lower(merchant).alias("_m"),
                     F.col(amount).alias("_a"), _epoch_us(ts).alias("_t"))
    base = base.withColumn("_c", F.floor(F.col("_a") * 100)).withColumn("_tb", F.floor(F.col("_t") / window_us))
    # role 0 = home row; +1: copy of a row from the bucket above; -1: from below
    copies = []
    for role, shift in ((0, 0), (1, -1), (-1, 1)):
        for tb_shift, home_time in ((0, True), (1, False)):
            copies.append(base.select(
                "_id", "_k", "_m", "_a", "_t", (F.col("_c") + shift).alias("_cb"),
                (F.col("_tb") + tb_shift).alias("_tbk"), F.lit(role).alias("_role"),
                F.lit(role == 0 and home_time).alias("_home")))
    u = copies[0]
    for c in copies[1:]:
        u = u.unionByName(c)
    w = Window.partitionBy("_k", "_m", "_cb", "_tbk").orderBy("_t").rangeBetween(-window_us, 0)
    same = F.count(F.when(F.col("_role") == 0, 1)).over(w)
    up_min = F.min(F.when(F.col("_role") == 1, F.col("_a"))).over(w)
    down_max = F.max(F.when(F.col("_role") == -1, F.col("_a"))).over(w)
    flagged = u.select("_id", "_home", "_a",
                       (same > 1).alias("_s"), up_min.alias("_up"), down_max.alias("_down")).filter("_home")
    dup = (F.col("_s") | F.coalesce(F.col("_up") - F.col("_a") < tolerance, F.lit(False))
           | F.coalesce(F.col("_a") - F.col("_down") < tolerance, F.lit(False)))
    return flagged.select(F.col("_id").alias(id_col), dup.alias("is_duplicate_payment"))


def spending_anomaly(events: DataFrame) -> DataFrame:
    """G8 (rule branch): duplicate + statistical outlier + severity."""
    f = fraud_features(events).join(duplicate_flags(events), "event_id", "left")
    cat = F.col("baseline_category")
    ratio = F.col("amount_to_category_ratio")
    outlier = (F.col("amount") > _baseline(cat, 2) * 2.0) | (ratio >= 6.0)
    dup = F.coalesce(F.col("is_duplicate_payment"), F.lit(False))
    flagged = outlier | dup | (ratio >= 5.0)
    sev = F.when(dup | (ratio >= 10.0), "CRITICAL").when(flagged, "WARNING").otherwise("NORMAL")
    twice = F.concat(F.lit("Potential duplicate payment: An identical charge of INR "), money_text(money("amount")),
                     F.lit(" at '"), F.col("merchant"), F.lit("' was found in recent transactions."))
    reasons = F.concat(F.array_compact(F.array(F.when(dup, twice))), reason_texts(f))
    return f.select("*", outlier.alias("is_outlier"), F.when(outlier, 0.65).otherwise(0.0).alias("anomaly_score"),
                    flagged.alias("is_anomaly"), sev.alias("severity"), reasons.alias("reasons"))


# ----------------------------------------------------------------- budgets --

def _lifestyle(lifestyle) -> Column:
    """Unknown lifestyle -> balanced."""
    l_ = col_(lifestyle)
    return F.when(l_.isin(*dims.LIFESTYLES.keys()), l_).otherwise(F.lit(dims.DEFAULT_LIFESTYLE))


def allocate_budget(profiles: DataFrame, income: str = "monthly_income", pct: str = "savings_target_pct",
                    lifestyle: str = "lifestyle") -> tuple[DataFrame, DataFrame]:
    """G1: savings first, the rest split needs:wants by the lifestyle ratio,
    then by category weight; the rounding remainder goes to food so the
    parts add up to the income to the cent.  Returns (allocations,
    quarantined rows with income <= 0)."""
    bad = profiles.filter(~(F.col(income) > 0) | F.col(income).isNull())
    p = profiles.filter(F.col(income) > 0)
    ls = _lifestyle(lifestyle)
    needs_t = dims.map_expr({k: v[0] for k, v in dims.LIFESTYLES.items()}, ls)
    wants_t = dims.map_expr({k: v[1] for k, v in dims.LIFESTYLES.items()}, ls)
    pct_c = clip(pct, 0.05, 0.60)
    p = p.select("*", ls.alias("lifestyle_used"), pct_c.alias("savings_pct_used"),
                 (needs_t / (needs_t + wants_t)).alias("_nr"))
    savings = money(F.col(income) * F.col("savings_pct_used"))
    p = p.withColumn("savings", savings)
    spendable = F.col(income) - as_number("savings")
    p = p.withColumn("_sp", spendable).withColumn("_needs", F.col("_sp") * F.col("_nr")) \
         .withColumn("_wants", F.col("_sp") * (F.lit(1.0) - F.col("_nr")))
    for c in dims.ALLOCATION_ORDER:
        bucket = "_needs" if dims.CATEGORY_CLASS[c] == "needs" else "_wants"
        p = p.withColumn(f"_a_{c}", money(F.col(bucket) * dims.CATEGORY_WEIGHTS[c]))
    total = None
    for c in dims.ALLOCATION_ORDER:
        total = F.col(f"_a_{c}") if total is None else total + F.col(f"_a_{c}")
    disc = money(F.col("_sp")) - total
    p = p.withColumn("_a_food", F.col("_a_food") + disc)
    cols = [c for c in profiles.columns if c not in (lifestyle, pct)]
    out = p.select(*cols, F.col("lifestyle_used").alias("lifestyle"), F.col("savings_pct_used").alias("savings_target_pct"),
                   *[as_number(f"_a_{c}").alias(c) for c in dims.CATEGORIES],
                   as_number("savings").alias("savings"))
    return out, bad


def recommend_budget(alloc: DataFrame, actual: DataFrame, income: str = "monthly_income") -> DataFrame:
    """Long form per (user, category): recommended budget, % of
    income, class, and where the user has actual spend in that category the
    variance and status (+/- 5 % band)."""
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("recommended_budget"),
                             F.lit(dims.CATEGORY_CLASS[c]).alias("type")) for c in dims.CATEGORIES])
    long = alloc.select("user_id", income, F.explode(arr).alias("r")).select(
        "user_id", income, "r.category", "r.recommended_budget", "r.type")
    j = long.join(actual.select("user_id", "category", F.col("amount").alias("actual_spend")),
                  ["user_id", "category"], "left")
    b = F.col("recommended_budget")
    diff = as_number(money(F.col("actual_spend") - b))
    status = (F.when(F.col("actual_spend").isNull(), F.lit(None).cast("string"))
              .when(diff > 0.05 * b, "OVERSPENT").when(diff < -(0.05 * b), "UNDERSPENT").otherwise("OPTIMAL"))
    return j.select("user_id", "category", "recommended_budget",
                    round_to(b / F.col(income) * 100, 1).alias("pct_of_income"), "type",
                    "actual_spend", diff.alias("variance"), status.alias("status"))


def rule_totals(alloc: DataFrame, income: str = "monthly_income") -> DataFrame:
    """Needs / wants / savings amounts and % of income."""
    needs = [c for c in dims.CATEGORIES if dims.CATEGORY_CLASS[c] == "needs"]
    wants = [c for c in dims.CATEGORIES if dims.CATEGORY_CLASS[c] == "wants"]

    def tot(cs):
        return as_number(sum((money(c) for c in cs[1:]), money(cs[0])))

    out = alloc.select("user_id", income, tot(needs).alias("needs_amount"), tot(wants).alias("wants_amount"),
                       F.col("savings").alias("savings_amount"))
    for k in ("needs", "wants", "savings"):
        out = out.withColumn(f"{k}_pct", round_to(F.col(f"{k}_amount") / F.col(income) * 100, 1))
    return out.drop(income)


def budget_tips(rec: DataFrame, alloc: DataFrame, actual: DataFrame, debt: DataFrame,
                income: str = "monthly_income") -> DataFrame:
    """Optimisation tips per user: the savings gap, the
    two largest overspends (ties in category order), or the fallback.

    The gap counts all of ``actual``, also categories without a budget;
    negative debt counts as none."""
    has_hist = actual.groupBy("user_id").agg(F.count("amount").alias("_h"), F.sum(money("amount")).alias("_tot"))
    base = (alloc.select("user_id", income, "savings").join(has_hist, "user_id", "left")
            .join(debt.select("user_id", "debt_obligations"), "user_id", "left"))
    actual_savings = F.col(income) - as_number(F.coalesce("_tot", F.lit(0).cast("decimal(18,2)"))) \
        - F.greatest(F.lit(0.0), F.coalesce(F.col("debt_obligations"), F.lit(0.0)))
    gap = base.filter((F.col("_h") > 0) & (actual_savings < F.col("savings"))).select(
        "user_id", F.lit(0).alias("tip_rank"),
        F.concat(F.lit("You are INR "), money_text(money(F.col("savings") - actual_savings)),
                 F.lit(" short of your desired monthly savings target (INR "), money_text("savings"),
                 F.lit(").")).alias("tip"))
    order = F.array_position(F.array(*[F.lit(c) for c in dims.CATEGORIES]), F.col("category"))
    w = Window.partitionBy("user_id").orderBy(F.col("variance").desc(), order)
    over = rec.filter(F.col("status") == "OVERSPENT").withColumn("tip_rank", F.row_number().over(w)) \
              .filter(F.col("tip_rank") <= 2)
    cat = title_case("category")
    text = F.when(F.col("type") == "wants",
                  F.concat(F.lit("Discretionary spending in '"), cat, F.lit("' exceeded recommended budget by INR "),
                           money_text("variance"), F.lit(". Reallocate this to Savings to optimize cash flow."))
                  ).otherwise(
                  F.concat(F.lit("Essential spending in '"), cat, F.lit("' is INR "), money_text("variance"),
                           F.lit(" higher than standard benchmarks. Look for subscription or utility optimizations.")))
    over = over.select("user_id", F.col("tip_rank").cast("int"), text.alias("tip"))
    tips = gap.unionByName(over)
    none = alloc.select("user_id").join(tips.select("user_id").distinct(), "user_id", "left_anti").select(
        "user_id", F.lit(0).alias("tip_rank"),
        F.lit("Spending habits align well with recommended 50/30/20 benchmarks!").alias("tip"))
    return tips.unionByName(none)


# ------------------------------------------------------------------ health --

def _piecewise_down(x: Column) -> Column:
    """Shared shape of the obligation and discretionary pillars."""
    return (F.when(x <= 0.25, 100.0)
            .when(x <= 0.35, 85.0 + ((0.35 - x) / 0.10) * 15.0)
            .when(x <= 0.50, 55.0 + ((0.50 - x) / 0.15) * 30.0)
            .when(x <= 0.70, 25.0 + ((0.70 - x) / 0.20) * 30.0)
            .otherwise(F.greatest(F.lit(0.0), 25.0 - (x - 0.70) * 50.0)))


def health_score(df: DataFrame, income: str = "monthly_income", balance: str = "current_balance",
                 total_expenses: str = "total_expenses", discretionary: str | None = "discretionary_spend",
                 bills: str | None = "bills_spend", debt: str = "debt_obligations",
                 savings: str | None = None) -> DataFrame:
    """Five pillars weighted .25/.25/.20/.15/.15, score rounded to one
    decimal and clipped to 0-100, grade and status.

    With ``discretionary``/``bills`` = None the expense total is a scalar
    and 30 % / 25 % of it are used.  Income <= 0 rows are dropped (the
    caller quarantines them)."""
    d = df.filter(F.col(income) > 0)
    inc = F.col(income)
    bal = F.greatest(F.lit(0.0), F.col(balance))
    dbt = F.greatest(F.lit(0.0), F.coalesce(F.col(debt), F.lit(0.0)))
    if discretionary is None:
        tot = F.greatest(F.lit(0.0), F.col(total_expenses))
        disc = tot * 0.30
        bil = tot * 0.25
    else:
        tot = F.col(total_expenses)
        disc = F.col(discretionary)
        bil = F.col(bills)
    d = d.withColumn("_tot", tot).withColumn("_disc", disc).withColumn("_bills", bil) \
         .withColumn("_bal", bal).withColumn("_debt", dbt)
    sav = (F.col(savings) if savings else
           F.greatest(-inc, inc - F.col("_tot") - F.col("_debt")))
    d = d.withColumn("_sr", sav / inc)
    sr = F.col("_sr")
    s_score = (F.when(sr >= 0.30, 100.0).when(sr >= 0.20, 85.0 + ((sr - 0.20) / 0.10) * 15.0)
               .when(sr >= 0.10, 60.0 + ((sr - 0.10) / 0.10) * 25.0)
               .when(sr > 0.0, 30.0 + (sr / 0.10) * 30.0)
               .otherwise(F.greatest(F.lit(0.0), 30.0 + sr * 50.0)))
    d = d.withColumn("_for", (F.col("_debt") + F.col("_bills")) / inc)
    d = d.withColumn("_dr", F.when(F.col("_tot") > 0, F.col("_disc") / F.col("_tot")).otherwise(0.30))
    d = d.withColumn("_burn", F.greatest(F.lit(100.0), F.col("_tot") + F.col("_debt")))
    d = d.withColumn("_rw", F.col("_bal") / F.col("_burn"))
    rw = F.col("_rw")
    r_score = (F.when(rw >= 6.0, 100.0).when(rw >= 3.0, 80.0 + ((rw - 3.0) / 3.0) * 20.0)
               .when(rw >= 1.0, 50.0 + ((rw - 1.0) / 2.0) * 30.0)
               .when(rw > 0.0, rw * 50.0).otherwise(0.0))
    d = d.withColumn("_nb", (inc - F.col("_tot") - F.col("_debt")) / inc)
    nb = F.col("_nb")
    b_score = (F.when(nb >= 0.20, 100.0).when(nb >= 0.05, 70.0 + ((nb - 0.05) / 0.15) * 30.0)
               .when(nb >= 0.0, 50.0 + (nb / 0.05) * 20.0)
               .otherwise(F.greatest(F.lit(0.0), 50.0 + nb * 100.0)))
    d = (d.withColumn("_s", s_score).withColumn("_d", _piecewise_down(F.col("_for")))
         .withColumn("_c", _piecewise_down(F.col("_dr"))).withColumn("_r", r_score).withColumn("_b", b_score))
    overall = (F.col("_s") * 0.25 + F.col("_d") * 0.25 + F.col("_c") * 0.20
               + F.col("_r") * 0.15 + F.col("_b") * 0.15)
    d = d.withColumn("_score", clip(round_to(overall, 1), 0.0, 100.0))
    sc = F.col("_score")
    grade = F.when(sc >= 90, "A+").when(sc >= 80, "A").when(sc >= 70, "B").when(sc >= 55, "C").otherwise("D")
    status = (F.when(sc >= 90, "EXCEPTIONAL").when(sc >= 80, "HEALTHY").when(sc >= 70, "GOOD")
              .when(sc >= 55, "NEEDS_ATTENTION").otherwise("CRITICAL"))
    keep = [c for c in df.columns]
    return d.select(
        *keep, F.col("_score").alias("financial_health_score"), grade.alias("grade"), status.alias("status"),
        round_to("_rw", 1).alias("runway_months"), round_to(F.col("_sr") * 100, 1).alias("savings_rate_pct"),
        round_to("_s", 1).alias("savings_rate_score"), round_to("_d", 1).alias("debt_score"),
        round_to("_c", 1).alias("discretionary_score"), round_to("_r", 1).alias("runway_score"),
        round_to("_b", 1).alias("buffer_score"),
        health_advice().alias("recommendations"))


def health_advice() -> Column:
    """One sentence for each of four pillars under 70, or the praise."""
    def one(x):
        return round_to(x, 1).cast("string")

    s = [F.when(F.col("_s") < 70, F.concat(F.lit("Boost monthly savings rate (currently "), one(F.col("_sr") * 100),
                                           F.lit("%) towards 20% by setting up auto-investments."))),
         F.when(F.col("_d") < 70, F.concat(F.lit("Fixed obligations and debt take up "), one(F.col("_for") * 100),
                                           F.lit("% of income. Target debt paydown to free up cash flow."))),
         F.when(F.col("_c") < 70, F.concat(F.lit("Discretionary wants account for "), one(F.col("_dr") * 100),
                                           F.lit("% of expenses. Trimming non-essentials can quickly raise your score."))),
         F.when(F.col("_r") < 70, F.concat(F.lit("Emergency liquidity covers "), one(F.col("_rw")),
                                           F.lit(" month(s). Aim for at least 3-6 months of expenses (INR "),
                                           money_text(money(F.col("_burn") * 3)), F.lit(").")))]
    found = F.array_compact(F.array(*s))
    return F.when(F.size(found) == 0, F.array(F.lit(
        "Excellent financial health! Maintain current investment strategy and emergency runway."))).otherwise(found)
