"""Source unification and data-preparation queries (S2-S6, J5, U1-U6, W9,
F13, F15, F16, F22, A13-A15, A23-A25, C1-C3, D4, M5, M6, L1).

Three source-shaped raw tables are derived from the driver's tables:
finance-shaped rows from line items (``Ledger.purchases``), household-shaped
rows from the ledger transactions and toy-shaped rows from the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dims
from ..functions.dates import day_of_week
from ..functions.money import bucket_label, money
from ..functions.text import clean_text, text_feature
from ..operators import stats as ST
from ..sources import adapters as AD
from ..sources.tables import Ledger
from .oracle_views import M, with_views
from .registry import query
from ..session import materialize, scratch_path

# Fixture rule: household-style native names for the ledger categories.
HOUSEHOLD_NATIVE = {"food": "Food", "shopping": "Apparel", "transport": "Transportation",
                    "entertainment": "Subscription", "bills": "Household", "healthcare": "Health",
                    "education": "Education"}


def raw_finance(db: Ledger) -> DataFrame:
    p = db.purchases()
    return p.select(
        F.date_format("date", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("Transaction at "), F.col("merchant")).alias("Description"),
        F.col("amount").cast("string").alias("Amount"),
        F.col("native_category").alias("Category"),
        F.lit("Card").alias("PaymentMethod"),
        F.col("description").alias("MerchantType"),
        F.col("transaction_type").alias("TransactionType"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"))


def raw_household(db: Ledger) -> DataFrame:
    t = db.transactions()
    return t.select(
        F.date_format("date", "dd/MM/yyyy HH:mm:ss").alias("Date"),
        F.lit("Cash").alias("Mode"),
        dims.map_expr(HOUSEHOLD_NATIVE, F.col("category")).alias("Category"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("status")).alias("Subcategory"),
        F.col("description").alias("Note"),
        F.col("amount").cast("string").alias("Amount"),
        F.when(F.col("type") == "EXPENSE", " Expense ").otherwise("Income").alias("Income/Expense"),
        F.lit("INR").alias("Currency"),
        F.col("id").cast("string").alias("record_id"))


def raw_toy(db: Ledger) -> DataFrame:
    e = db.table("events", "event_id", "event_type", "value")
    return e.select(
        F.col("event_id").cast("string").alias("expense_id"),
        (F.col("value") * 100).cast("string").alias("amount"),
        F.concat(F.lit("m"), (F.col("event_id") % 20).cast("string")).alias("merchant"),
        F.col("event_type").alias("description"),
        F.when(F.col("event_type") == "purchase", "Shopping ").when(F.col("event_type") == "view", "entertainment")
         .when(F.col("event_type") == "click", "FOOD").when(F.col("event_type") == "signup", "technology")
         .otherwise("unknown").alias("category"))


def adapted_sources(db: Ledger) -> list[DataFrame]:
    frames = []
    for raw, cmap in [(raw_finance(db), db.category_map()), (raw_household(db), None), (raw_toy(db), None)]:
        a = AD.detect_adapter(raw.columns)
        frames.append(a.fn(raw, cmap))
    return frames


def flagged_union(spark, sf_dir) -> DataFrame:
    return AD.unify(adapted_sources(Ledger(spark, sf_dir)))


def unified_table(spark, sf_dir) -> DataFrame:
    return flagged_union(spark, sf_dir).filter("kept").drop("kept")


def deduped_table(spark, sf_dir) -> DataFrame:
    return ST.keep_first(unified_table(spark, sf_dir), ["merchant", "description", "amount", "category"],
                         ["source", "date", "record_id"])


def identified_table(spark, sf_dir) -> DataFrame:
    """The de-duplicated rows with ``row_id``, an MD5 of the columns that the
    de-duplication keeps distinct and of the row's origin.  ``record_id`` repeats
    within a source; this id does not."""
    d = deduped_table(spark, sf_dir)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "record_id", "merchant", "description")]
    text = F.concat_ws("|", *parts, F.coalesce(money("amount").cast("string"), F.lit("")), F.coalesce("category", F.lit("")))
    return d.withColumn("row_id", F.md5(text.cast("binary")))


# ------------------------------------------------------------ oracle SQL ---

def _case_map(expr: str, mapping: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_HH_NATIVE_SQL = _case_map("category", HOUSEHOLD_NATIVE)

RAW_CTES = f"""fin_raw AS (
  SELECT strftime(date, '%Y-%m-%d') AS "Date", 'Transaction at ' || merchant AS "Description",
         CAST(amount AS VARCHAR) AS "Amount", native_category AS fin_cat, description AS "MerchantType",
         transaction_type AS "TransactionType", CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS record_id
  FROM v_purchases),
fin AS (
  SELECT trim(regexp_replace("Description", '^Transaction at\\s*', '')) AS merchant, "MerchantType" AS description,
         TRY_CAST("Amount" AS DOUBLE) AS amount, m.category AS category,
         CAST(try_strptime("Date", '%Y-%m-%d') AS DATE) AS date, 'finance_8000' AS source, record_id
  FROM fin_raw LEFT JOIN v_category_map m ON m.native_category = lower(trim(fin_cat))
  WHERE lower("TransactionType") = 'debit'),
hh_raw AS (
  SELECT strftime(date, '%d/%m/%Y %H:%M:%S') AS "Date", {_HH_NATIVE_SQL} AS "Category",
         CASE WHEN id % 3 = 0 THEN NULL ELSE status END AS "Subcategory", description AS "Note",
         CAST(amount AS VARCHAR) AS "Amount", CASE WHEN type = 'EXPENSE' THEN ' Expense ' ELSE 'Income' END AS "IE",
         CAST(id AS VARCHAR) AS record_id
  FROM v_transactions),
hh AS (
  SELECT COALESCE("Subcategory", "Category") AS merchant, COALESCE("Note", "Subcategory", "Category") AS description,
         TRY_CAST("Amount" AS DOUBLE) AS amount, {_case_map('lower(trim("Category"))', dims.HOUSEHOLD_CATEGORY_MAP)} AS category,
         CAST(try_strptime("Date", '%d/%m/%Y %H:%M:%S') AS DATE) AS date, 'household' AS source, record_id
  FROM hh_raw WHERE lower(trim("IE")) = 'expense'),
toy_raw AS (
  SELECT CAST(event_id AS VARCHAR) AS expense_id, CAST(value * 100 AS VARCHAR) AS amount,
         'm' || CAST(event_id % 20 AS VARCHAR) AS merchant, event_type AS description,
         CASE event_type WHEN 'purchase' THEN 'Shopping ' WHEN 'view' THEN 'entertainment' WHEN 'click' THEN 'FOOD'
                         WHEN 'signup' THEN 'technology' ELSE 'unknown' END AS category
  FROM events),
toy AS (
  SELECT merchant, description, TRY_CAST(amount AS DOUBLE) AS amount,
         {_case_map('lower(trim(category))', dims.TOY_CATEGORY_MAP)} AS category,
         CAST(NULL AS DATE) AS date, 'toy' AS source, expense_id AS record_id
  FROM toy_raw),
allrows AS (
  SELECT *, (category IS NOT NULL AND merchant IS NOT NULL AND amount IS NOT NULL AND NOT isnan(amount)) AS kept
  FROM (SELECT * FROM fin UNION ALL SELECT * FROM hh UNION ALL SELECT * FROM toy)),
u AS (SELECT merchant, description, amount, category, date, source, record_id FROM allrows WHERE kept),
dd AS (
  SELECT merchant, description, amount, category, date, source, record_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant, description, amount, category
                                 ORDER BY source, date NULLS FIRST, record_id) AS rn FROM u) WHERE rn = 1)"""

ROW_IDS = f"""ids AS (SELECT *, md5(concat_ws('|', COALESCE(source, ''), COALESCE(CAST(record_id AS VARCHAR), ''), COALESCE(merchant, ''),
                         COALESCE(description, ''), COALESCE(CAST({M('amount')} AS VARCHAR), ''), COALESCE(category, ''))) AS row_id FROM dd)"""


def _hash(text: str, seed: int = 42) -> str:
    """DuckDB twin of ``stats.seeded_hash``."""
    return f"CAST('0x' || substr(md5({text} || '|{seed}'), 1, 15) AS BIGINT)"


def _id_sql(body: str) -> str:
    return with_views(body, *_VIEWS, extra_ctes=RAW_CTES + ",\n" + ROW_IDS)


_VIEWS = ("v_transactions", "v_purchases", "v_category_map")


def _sql(body: str) -> str:
    return with_views(body, *_VIEWS, extra_ctes=RAW_CTES)


# --------------------------------------------------------------- queries ---

@query("unified_transactions", "S2,S3,S4,S5,S6,J5,U1,F13,F15,F16,C3", oracle=_sql("SELECT * FROM u"))
def q_unified(spark, sf_dir):
    return unified_table(spark, sf_dir)


@query("csv_directory_unified", "S1,S2,S6", oracle=_sql("SELECT merchant, description, amount, category, date, source FROM u"))
def q_csv_directory(spark, sf_dir):
    """The raw sources written as one directory of CSV files, then found by their headers and united."""
    db = Ledger(spark, sf_dir)
    folder = scratch_path(spark, f"raw-csv-{uuid.uuid4().hex}")
    for raw in (raw_finance(db), raw_household(db), raw_toy(db)):
        raw.drop("record_id").write.mode("append").option("header", True).csv(folder)
    flagged, _ = AD.load_and_unify(spark, folder, {"finance_8000": db.category_map()})
    return flagged.filter("kept").drop("kept", "record_id")


@query("unify_report", "A13,S6", oracle=_sql("""
SELECT source, COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE category IS NULL) AS unmapped,
       COUNT(*) FILTER (WHERE kept) AS kept, COUNT(*) FILTER (WHERE NOT kept) AS dropped
FROM allrows GROUP BY source"""))
def q_unify_report(spark, sf_dir):
    return AD.unify_report(flagged_union(spark, sf_dir))


@query("category_counts", "A13,A15", oracle=_sql("""
SELECT category, COUNT(*) AS rows, COUNT(*) < 10 AS is_small FROM dd GROUP BY category"""))
def q_category_counts(spark, sf_dir):
    d = deduped_table(spark, sf_dir)
    return d.groupBy("category").agg(F.count("*").alias("rows")).withColumn("is_small", F.col("rows") < 10)


@query("dedup_unified", "A23", oracle=_sql("SELECT * FROM dd"))
def q_dedup(spark, sf_dir):
    return deduped_table(spark, sf_dir)


@query("text_features", "C1,C2,D4", oracle=_sql("""
SELECT source, record_id,
       trim(concat_ws(' ', m, m, trim(regexp_replace(regexp_replace(lower(COALESCE(description, '')), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g')))) AS text_feature,
       COALESCE(isodow(date) - 1, -1) AS day_of_week
FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(COALESCE(merchant, '')), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g')) AS m FROM u)"""))
def q_text_features(spark, sf_dir):
    u = unified_table(spark, sf_dir)
    return u.select("source", "record_id", text_feature("merchant", "description").alias("text_feature"),
                    day_of_week("date").alias("day_of_week"))


@query("clean_documents", "C1", oracle="""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(COALESCE(text, '')), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean_text
FROM documents""")
def q_clean_documents(spark, sf_dir):
    d = Ledger(spark, sf_dir).table("documents", "doc_id", "text")
    return d.select("doc_id", clean_text("text").alias("clean_text"))


@query("label_encoding", "L1", oracle=_sql("""
SELECT category, CAST(DENSE_RANK() OVER (ORDER BY category) - 1 AS INTEGER) AS category_encoded, rows
FROM (SELECT category, COUNT(*) AS rows FROM dd GROUP BY category)"""))
def q_label_encoding(spark, sf_dir):
    d = deduped_table(spark, sf_dir)
    counts = d.groupBy("category").agg(F.count("*").alias("rows"))
    # the class list is tiny (one row per class), so one ordered window is fine
    return counts.withColumn("category_encoded",
                             (F.dense_rank().over(Window.orderBy("category")) - 1).cast("int"))


QUANTS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def fit_bucket_edges(df: DataFrame, col: str = "amount", labels=None):
    """Quantile edges (exact), duplicates dropped, labels truncated (M6
    persists them as a one-row table)."""
    edges = ST.exact_quantiles(df, col, QUANTS)
    uniq = []
    for e in edges:
        if not uniq or e != uniq[-1]:
            uniq.append(e)
    labs = list(labels or dims.BUCKET_LABELS)[: len(uniq) - 1]
    return uniq, labs


def save_bucketizer(spark, edges: list[float], labels: list[str], path: str) -> None:
    """M6: the fitted edges and labels as a one-row table."""
    row = [([float(e) for e in edges], list(labels))]
    spark.createDataFrame(row, "edges array<double>, labels array<string>").write.mode("overwrite").parquet(path)


def load_bucketizer(spark, path: str) -> tuple[list[float], list[str]]:
    r = spark.read.parquet(path).first()
    return list(r["edges"]), list(r["labels"])


@query("amount_bucket_edges", "A25,M6", oracle=_sql("""
SELECT CAST(i - 1 AS INTEGER) AS edge_index, e[i] AS edge_value
FROM (SELECT list_sort(list_distinct(quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM dd),
     range(1, 7) r(i)"""))
def q_bucket_edges(spark, sf_dir):
    edges, _ = fit_bucket_edges(materialize(deduped_table(spark, sf_dir)))
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "edge_index int, edge_value double")


@query("amount_buckets", "A25,M5,M6", oracle=_sql("""
SELECT source, record_id, amount,
       CASE WHEN amount IS NULL OR isnan(amount) THEN 'nan' WHEN amount <= e[2] THEN 'very_low'
            WHEN amount <= e[3] THEN 'low' WHEN amount <= e[4] THEN 'medium' WHEN amount <= e[5] THEN 'high'
            ELSE 'very_high' END AS amount_bucket
FROM dd, (SELECT list_sort(list_distinct(quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM dd)"""))
def q_amount_buckets(spark, sf_dir):
    d = materialize(deduped_table(spark, sf_dir))
    path = scratch_path(spark, f"bucketizer-{uuid.uuid4().hex}")
    save_bucketizer(spark, *fit_bucket_edges(d), path)
    edges, labels = load_bucketizer(spark, path)
    e = F.array(*[F.lit(float(x)) for x in edges])
    lab = F.array(*[F.lit(x) for x in labels])
    return d.select("source", "record_id", "amount", bucket_label("amount", e, lab).alias("amount_bucket"))


_LEDGER_IDS = "(VALUES " + ", ".join(f"('{i}')" for i, *_ in dims.LEDGER_CATEGORIES) + ") lc(category)"
_CANON = "(VALUES " + ", ".join(f"('{c}')" for c in dims.CATEGORIES) + ") cc(category)"


@query("category_domain_check", "F22,U3,F17", oracle=with_views(f"""
SELECT 'ledger' AS domain, 'unexpected' AS issue, category FROM (SELECT DISTINCT category FROM v_transactions)
  WHERE category NOT IN (SELECT category FROM {_LEDGER_IDS})
UNION ALL SELECT 'ledger', 'missing', category FROM {_LEDGER_IDS}
  WHERE category NOT IN (SELECT DISTINCT category FROM v_transactions)
UNION ALL SELECT 'unified', 'unexpected', category FROM (SELECT DISTINCT category FROM u)
  WHERE category NOT IN (SELECT category FROM {_CANON})
UNION ALL SELECT 'unified', 'missing', category FROM {_CANON}
  WHERE category NOT IN (SELECT DISTINCT category FROM u)""", *_VIEWS, extra_ctes=RAW_CTES))
def q_category_domain_check(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    ledger_ids = dims.ledger_categories_df(spark).select(F.col("id").alias("category"))
    canon = spark.createDataFrame([(c,) for c in dims.CATEGORIES], "category string")
    seen_l = db.transactions().select("category").distinct()
    seen_u = unified_table(spark, sf_dir).select("category").distinct()

    def check(domain, seen, expected):
        unexpected = seen.subtract(expected).select(F.lit(domain).alias("domain"), F.lit("unexpected").alias("issue"), "category")
        missing = expected.exceptAll(seen).select(F.lit(domain).alias("domain"), F.lit("missing").alias("issue"), "category")
        return unexpected.unionByName(missing)

    return check("ledger", seen_l, ledger_ids).unionByName(check("unified", seen_u, canon))


@query("distinct_merchants", "A14", oracle=_sql("""
SELECT source, COUNT(DISTINCT lower(merchant)) AS distinct_values FROM dd GROUP BY source"""))
def q_distinct_merchants(spark, sf_dir):
    return ST.distinct_count(deduped_table(spark, sf_dir), ["source"], F.lower("merchant"))


@query("unified_profile", "A24", oracle=_sql("""
SELECT COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE merchant IS NULL) AS nulls_merchant, COUNT(*) FILTER (WHERE description IS NULL) AS nulls_description,
       COUNT(*) FILTER (WHERE amount IS NULL) AS nulls_amount, COUNT(*) FILTER (WHERE category IS NULL) AS nulls_category,
       COUNT(*) FILTER (WHERE date IS NULL) AS nulls_date, COUNT(*) FILTER (WHERE source IS NULL) AS nulls_source,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT merchant, description, amount, category, date, source FROM u)) AS duplicate_rows
FROM u"""))
def q_unified_profile(spark, sf_dir):
    u = unified_table(spark, sf_dir).drop("record_id")
    return ST.profile(u)


@query("stratified_split_sizes", "U4,U8", oracle=_sql("""
SELECT category, COUNT(*) AS rows, CAST(round(COUNT(*) * 0.2) AS BIGINT) AS test_rows,
       COUNT(*) - CAST(round(COUNT(*) * 0.2) AS BIGINT) AS train_rows
FROM dd GROUP BY category"""))
def q_stratified_split_sizes(spark, sf_dir):
    s = ST.stratified_split(identified_table(spark, sf_dir), ["category"], ["row_id"], 0.2, 42)
    return s.groupBy("category").agg(F.count("*").alias("rows"),
                                     F.count_if(F.col("split") == "test").alias("test_rows"),
                                     F.count_if(F.col("split") == "train").alias("train_rows"))


@query("positional_split_sizes", "W9,U8", oracle=_sql("""
SELECT COUNT(*) AS rows, CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS train_rows,
       COUNT(*) - CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS test_rows FROM dd"""))
def q_positional_split_sizes(spark, sf_dir):
    s = ST.positional_split(identified_table(spark, sf_dir), ["row_id"], 0.2, 42)
    return s.agg(F.count("*").alias("rows"), F.count_if(F.col("split") == "train").alias("train_rows"),
                 F.count_if(F.col("split") == "test").alias("test_rows"))


@query("group_split_sizes", "U5,U2", oracle=_sql("""
SELECT COUNT(*) AS groups, CAST(round(COUNT(*) * 0.2) AS BIGINT) AS test_groups, 0 AS leaked_groups
FROM (SELECT DISTINCT lower(merchant) AS g FROM dd)"""))
def q_group_split_sizes(spark, sf_dir):
    s = ST.group_split(deduped_table(spark, sf_dir), F.lower("merchant"), 0.2, 42).withColumn("g", F.lower("merchant"))
    tr = s.filter(F.col("split") == "train").select("g")
    te = s.filter(F.col("split") == "test").select("g")
    leaked = tr.intersect(te).agg(F.count("*").alias("leaked_groups"))
    sizes = s.agg(F.count_distinct("g").alias("groups"),
                  F.count_distinct(F.when(F.col("split") == "test", F.col("g"))).alias("test_groups"))
    return _one_row_join(sizes, leaked)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row aggregates (broadcast, both sides are one row)."""
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k")


@query("stratified_fold_sizes", "U6", oracle=_sql("""
SELECT category, CAST(f AS INTEGER) AS fold, CAST((n - f + k - 1) // k AS BIGINT) AS rows
FROM (SELECT category, COUNT(*) AS n FROM dd GROUP BY category) c,
     (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT COUNT(*) AS n FROM dd GROUP BY category)) kk,
     range(0, 5) r(f)
WHERE f < k AND n > f"""))
def q_stratified_fold_sizes(spark, sf_dir):
    f = ST.stratified_folds(identified_table(spark, sf_dir), "category", ["row_id"], 5, 42)
    return f.groupBy("category", "fold").agg(F.count("*").alias("rows"))


# which rows, not only how many

@query("stratified_split_rows", "U4,U8", oracle=_id_sql(f"""
SELECT row_id, category, CASE WHEN ROW_NUMBER() OVER (PARTITION BY category ORDER BY {_hash('row_id')}, row_id)
                              <= round(COUNT(*) OVER (PARTITION BY category) * 0.2) THEN 'test' ELSE 'train' END AS split FROM ids"""))
def q_stratified_split_rows(spark, sf_dir):
    s = ST.stratified_split(identified_table(spark, sf_dir), ["category"], ["row_id"], 0.2, 42)
    return s.select("row_id", "category", "split")


@query("positional_split_rows", "W9,U8", oracle=_id_sql(f"""
SELECT row_id, CASE WHEN ROW_NUMBER() OVER (ORDER BY {_hash('row_id')}, row_id) <= floor(COUNT(*) OVER () * (1 - 0.2))
                    THEN 'train' ELSE 'test' END AS split FROM ids"""))
def q_positional_split_rows(spark, sf_dir):
    return ST.positional_split(identified_table(spark, sf_dir), ["row_id"], 0.2, 42).select("row_id", "split")


@query("group_split_rows", "U5", oracle=_id_sql(f"""
SELECT i.row_id, g.split FROM ids i JOIN (
  SELECT g, CASE WHEN ROW_NUMBER() OVER (ORDER BY {_hash('g')}, g) <= round(COUNT(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT DISTINCT lower(merchant) AS g FROM ids)) g ON g.g = lower(i.merchant)"""))
def q_group_split_rows(spark, sf_dir):
    return ST.group_split(identified_table(spark, sf_dir), F.lower("merchant"), 0.2, 42).select("row_id", "split")


@query("stratified_fold_rows", "U6", oracle=_id_sql(f"""
SELECT row_id, category, CAST((ROW_NUMBER() OVER (PARTITION BY category ORDER BY {_hash('row_id')}, row_id) - 1) % k AS INTEGER) AS fold
FROM ids, (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT COUNT(*) AS n FROM ids GROUP BY category))"""))
def q_stratified_fold_rows(spark, sf_dir):
    f = ST.stratified_folds(identified_table(spark, sf_dir), "category", ["row_id"], 5, 42)
    return f.select("row_id", "category", "fold")


@query("hash_fold_rows", "U7", oracle=_id_sql(f"SELECT row_id, CAST({_hash('row_id')} % 5 AS INTEGER) AS fold FROM ids"))
def q_hash_fold_rows(spark, sf_dir):
    return ST.hash_folds(identified_table(spark, sf_dir), ["row_id"], 5, 42).select("row_id", "fold")
