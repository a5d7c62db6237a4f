"""Raw transaction sources and their adapters.

A source file is recognised by its column signature and turned into the
unified schema (merchant, description, amount, category, date, source,
record_id).  Adapters are pure column expressions plus one broadcast join
with a small category map, so they stream through whole files without a
shuffle.  ``record_id`` keeps a source-level identity so "first row wins"
rules stay deterministic after distributed reads.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dims
from ..functions.text import strip_transaction_prefix
from ..session import written

UNIFIED_COLUMNS = ["merchant", "description", "amount", "category", "date", "source", "record_id"]


def _map_category(df: DataFrame, native, mapping) -> DataFrame:
    """Native category (lower, trimmed) -> canonical; unmapped -> NULL.

    ``mapping`` is a dict (fixed table, broadcast) or a two-column DataFrame
    (native_category, category) — broadcast only because its size is bounded
    by the number of distinct native categories.
    """
    key = F.lower(F.trim(native))
    if isinstance(mapping, dict):
        return df.withColumn("category", dims.map_expr(mapping, key))
    m = F.broadcast(mapping.select(F.col("native_category").alias("_nat"), F.col("category")))
    return df.withColumn("_nat", key).join(m, "_nat", "left").drop("_nat")


def _amount(c) -> F.Column:
    """numeric coercion, bad value -> NULL (try_cast never fails the job)."""
    return F.col(c).cast("string").try_cast("double")


def _date(c, patterns: list[str]) -> F.Column:
    """first pattern that parses, as a DATE; unparsable -> NULL."""
    s = F.col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in patterns]).cast("date")


def adapt_toy(df: DataFrame, category_map=None) -> DataFrame:
    """S3: (expense_id, amount, merchant, description, category)."""
    out = df.select(
        F.col("merchant").cast("string").alias("merchant"),
        F.col("description").cast("string").alias("description"),
        _amount("amount").alias("amount"),
        F.col("category").alias("_native"),
        F.lit(None).cast("date").alias("date"),
        F.lit("toy").alias("source"),
        F.col("expense_id").cast("string").alias("record_id"))
    return _map_category(out, F.col("_native"), category_map or dims.TOY_CATEGORY_MAP).drop("_native")


def adapt_finance(df: DataFrame, category_map=None) -> DataFrame:
    """Keep debits only (if the column exists), merchant from
    'Transaction at X', description = MerchantType."""
    if "TransactionType" in df.columns:
        df = df.filter(F.lower(F.col("TransactionType")) == "debit")
    desc = F.col("MerchantType") if "MerchantType" in df.columns else F.lit("")
    rid = F.col("record_id") if "record_id" in df.columns else F.monotonically_increasing_id().cast("string")
    out = df.select(
        strip_transaction_prefix("Description").alias("merchant"),
        desc.cast("string").alias("description"),
        _amount("Amount").alias("amount"),
        F.col("Category").alias("_native"),
        _date("Date", FINANCE_DATE_PATTERNS).alias("date"),
        F.lit("finance_8000").alias("source"),
        rid.cast("string").alias("record_id"))
    return _map_category(out, F.col("_native"), category_map or dims.FINANCE_CATEGORY_MAP).drop("_native")


# Patterns are tried in order and a failed parse is the slow path, so the
# most common layout of each source comes first (the layouts are exclusive).
FINANCE_DATE_PATTERNS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy"]
HOUSEHOLD_DATE_PATTERNS = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy"]


def adapt_household(df: DataFrame, category_map=None) -> DataFrame:
    """Expenses only (trimmed, case-insensitive); merchant = Subcategory
    else Category; description = Note else Subcategory else Category;
    day-first dates."""
    df = df.filter(F.lower(F.trim(F.col("Income/Expense"))) == "expense")
    rid = F.col("record_id") if "record_id" in df.columns else F.monotonically_increasing_id().cast("string")
    out = df.select(
        F.coalesce("Subcategory", "Category").alias("merchant"),
        F.coalesce("Note", "Subcategory", "Category").alias("description"),
        _amount("Amount").alias("amount"),
        F.col("Category").alias("_native"),
        _date("Date", HOUSEHOLD_DATE_PATTERNS).alias("date"),
        F.lit("household").alias("source"),
        rid.cast("string").alias("record_id"))
    return _map_category(out, F.col("_native"), category_map or dims.HOUSEHOLD_CATEGORY_MAP).drop("_native")


@dataclass
class Adapter:
    name: str
    required: frozenset
    fn: Callable[..., DataFrame]


# First adapter whose required columns are all present wins.
ADAPTERS = [
    Adapter("toy", frozenset({"expense_id", "merchant", "description", "category"}), adapt_toy),
    Adapter("finance_8000", frozenset({"Description", "MerchantType", "TransactionType"}), adapt_finance),
    Adapter("household", frozenset({"Mode", "Subcategory", "Income/Expense"}), adapt_household),
]


def detect_adapter(columns) -> Adapter | None:
    """Dispatch on column signature (a driver-side test on the header)."""
    cols = set(columns)
    for a in ADAPTERS:
        if a.required <= cols:
            return a
    return None


def with_kept_flag(df: DataFrame) -> DataFrame:
    """F13 as a flag: rows with NULL/NaN category, merchant or amount are dropped."""
    ok = (F.col("category").isNotNull() & F.col("merchant").isNotNull()
          & F.col("amount").isNotNull() & ~F.isnan("amount"))
    return df.withColumn("kept", ok)


def unify(frames: list[DataFrame]) -> DataFrame:
    """Union by name of adapted frames, all rows with a ``kept`` flag.

    The caller filters ``kept`` for the unified table and aggregates the
    flag for the kept/dropped report, in the same plan (no extra count job
    per file).
    """
    flagged = [with_kept_flag(f.select(*UNIFIED_COLUMNS)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), flagged)


def unified(frames: list[DataFrame]) -> DataFrame:
    return unify(frames).filter("kept").drop("kept")


def unify_report(flagged: DataFrame) -> DataFrame:
    """Rows in, unmapped category, kept and dropped per source."""
    return flagged.groupBy("source").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("category").isNull()).alias("unmapped"),
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("dropped"))


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    """The directory's *.csv files, sorted; error if none.

    Uses the Hadoop file system of the session, so it lists local, HDFS or
    object-store folders alike.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(conf)
    files = sorted(str(s.getPath().toString()) for s in fs.listStatus(path)
                   if str(s.getPath().getName()).endswith(".csv"))
    if not files:
        raise FileNotFoundError(f"No CSV files found in {directory}")
    return files


def read_headers(spark: SparkSession, files: list[str], threads: int = 32) -> dict[str, str | None]:
    """First line of each file (None if empty), through the session's Hadoop
    file system.  One line a file is read, no job is run; ``threads`` files at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first_line(file: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        try:
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(files, pool.map(first_line, files)))


def numbered(raw: DataFrame) -> DataFrame:
    """``raw`` (a file scan) with ``record_id`` = file name and position of the row in its file.

    The scan is written once with the split that a row came from; a split is read by
    one task in file order, so the position is the offset of the split, a prefix sum of
    row counts over the splits of a file, plus the position in it.  The id does not
    depend on how files are cut into splits or dealt to tasks.
    """
    rows = written(raw.select("*", F.col("_metadata.file_name").alias("_file"),
                              F.col("_metadata.file_block_start").alias("_split"),
                              F.monotonically_increasing_id().alias("_at")), "csv-rows")
    splits = rows.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select("_file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    position = F.col("_at") + F.col("_shift") + 1
    return rows.join(shift, ["_file", "_split"]) \
        .withColumn("record_id", F.concat_ws(":", "_file", position.cast("string"))) \
        .drop("_file", "_split", "_at", "_shift")


def load_and_unify(spark: SparkSession, directory: str, category_maps: dict | None = None
                   ) -> tuple[DataFrame, list[str]]:
    """The directory's CSV files, adapted, flagged, united.

    Files are grouped by their header line (a glob read over different headers
    would misalign columns) and each group is one scan, however many files it has.
    Returns (flagged union, names of skipped files: empty or of no known
    signature).  Columns are read as strings; adapters coerce them.  ``record_id`` is
    the file's name and the row's position in it (toy rows keep their expense_id).
    """
    groups, skipped = defaultdict(list), []
    for file, header in read_headers(spark, list_csv(spark, directory)).items():
        groups[header].append(file)
    frames = []
    for header, files in groups.items():
        raw = spark.read.option("header", True).option("inferSchema", False).csv(files) if header else None
        a = raw is not None and detect_adapter(raw.columns)
        if not a:
            skipped += files
            continue
        raw = numbered(raw)
        if a.name == "toy":
            raw = raw.withColumn("expense_id", F.coalesce(F.col("expense_id"), F.col("record_id")))
        frames.append(a.fn(raw, (category_maps or {}).get(a.name)))
    if not frames:
        raise ValueError(f"no CSV file of a known source in {directory}")
    return unify(frames), sorted(skipped)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Overwrite a table (parquet by default, partitioned if asked)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """metrics/metadata rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
