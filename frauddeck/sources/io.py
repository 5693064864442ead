"""Typed readers, writers, stage tables and model persistence."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, TS, I, DT = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.DateType()


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Input schemas of the payments data set (FIXTURES.md section 1).
CUSTOMERS = _schema([("CUSTOMER_ID", S), ("x_customer_id", D), ("y_customer_id", D)])
TERMINALS = _schema([("TERMINAL_ID", S), ("x_terminal_id", D), ("y_terminal__id", D)])
MERCHANTS = _schema([("MERCHANT_ID", S), ("BUSINESS_TYPE", S), ("MCC_CODE", S), ("LEGAL_NAME", S),
                     ("FOUNDATION_DATE", DT), ("TAX_EXCEMPT_INDICATOR", S), ("OUTLET_TYPE", S),
                     ("ACTIVE_FROM", DT), ("TRADING_FROM", DT), ("ANNUAL_TURNOVER_CARD", D),
                     ("ANNUAL_TURNOVER", D), ("AVERAGE_TICKET_SALE_AMOUNT", D),
                     ("PAYMENT_PERCENTAGE_FACE_TO_FACE", D), ("PAYMENT_PERCENTAGE_ECOM", D),
                     ("PAYMENT_PERCENTAGE_MOTO", D), ("DEPOSIT_REQUIRED_PERCENTAGE", D), ("DEPOSIT_PERCENTAGE", D),
                     ("DELIVERY_SAME_DAYS_PERCENTAGE", D), ("DELIVERY_WEEK_ONE_PERCENTAGE", D),
                     ("DELIVERY_WEEK_TWO_PERCENTAGE", D), ("DELIVERY_OVER_TWO_WEEKS_PERCENTAGE", D)])
_TX_COMMON = [("TX_ID", S), ("TX_TS", TS), ("CUSTOMER_ID", S), ("TERMINAL_ID", S), ("TX_AMOUNT", D)]
_TX_REST = [("TRANSACTION_GOODS_AND_SERVICES_AMOUNT", D), ("TRANSACTION_CASHBACK_AMOUNT", D),
            ("CARD_EXPIRY_DATE", S), ("CARD_DATA", S), ("CARD_BRAND", S), ("TRANSACTION_TYPE", S),
            ("TRANSACTION_STATUS", S), ("FAILURE_CODE", S), ("FAILURE_REASON", S), ("TRANSACTION_CURRENCY", S),
            ("CARD_COUNTRY_CODE", S), ("MERCHANT_ID", S), ("IS_RECURRING_TRANSACTION", S), ("ACQUIRER_ID", S)]
TRANSACTIONS_TRAIN = _schema(_TX_COMMON + [("TX_FRAUD", I)] + _TX_REST + [("CARDHOLDER_AUTH_METHOD", S)])
TRANSACTIONS_TEST = _schema(_TX_COMMON + _TX_REST)
PREDICTIONS = _schema([("TX_ID", S), ("TX_FRAUD", D)])

SCHEMAS = {"customers": CUSTOMERS, "terminals": TERMINALS, "merchants": MERCHANTS,
           "transactions_train": TRANSACTIONS_TRAIN, "transactions_test": TRANSACTIONS_TEST,
           "predictions": PREDICTIONS}


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, *, timestamp_format: str | None = None,
                   mode: str = "PERMISSIVE") -> DataFrame:
    """A1 / A2 / A3: header CSV with a fixed schema (no inference pass); bad fields -> NULL.

    A3: a missing path raises ``FileNotFoundError`` naming the path.
    """
    r = spark.read.schema(schema).option("header", True).option("mode", mode)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    try:
        return r.csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet read with the same clear missing-input error (A3)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise


def require_columns(df: DataFrame, cols: list[str], what: str = "input") -> DataFrame:
    """A4: raise ``ValueError`` when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write cleaned tables, features, reports or submissions (parquet or header CSV)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_mappings(mappings: dict[str, DataFrame], path: str) -> None:
    """Category code mappings as one JSON table ``(column, value, code)``."""
    parts = [m.select(F.lit(c).alias("column"), F.col("_value").alias("value"), F.col("code")) for c, m in mappings.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u.write.mode("overwrite").json(path)


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def stage(spark: SparkSession, name: str, builder: Callable[[], DataFrame], root: str, *,
          rebuild: bool = False) -> DataFrame:
    """Reuse ``root/name`` when a committed copy (``_SUCCESS``) exists, else build and write it.

    The Parquet committer writes ``_SUCCESS`` last, so a half-written stage is rebuilt. The
    returned frame is read back from storage, which also cuts the lineage (executor loss
    then recomputes from the stage, not from the raw inputs).
    """
    path = os.path.join(root, name)
    if not rebuild and _fs_exists(spark, os.path.join(path, "_SUCCESS")):
        return spark.read.parquet(path)
    builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder, read again: cuts the lineage."""
    from frauddeck.session import stage_root
    path = os.path.join(stage_root(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_stages(spark: SparkSession, root: str) -> list[str]:
    """Names of committed stages under ``root``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        if st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(st.getPath().getName())
    return sorted(out)


class FoldProgress:
    """Finished folds of a cross-validation in a folder that all executors share.

    A fold is ``fold-<f>/scores`` (Parquet) and ``fold-<f>/model`` (text, written last); it counts once
    the model's ``_SUCCESS`` is there, so a fold that died half-way is done again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, fold: int, part: str) -> str:
        return f"{self.root}/fold-{fold}/{part}"

    def done(self, folds: int) -> int:
        """How many folds are finished, counted from the first."""
        return next((f for f in range(folds) if not _fs_exists(self.spark, self._at(f, "model/_SUCCESS"))), folds)

    def load(self, fold: int) -> tuple[str, DataFrame] | None:
        if not _fs_exists(self.spark, self._at(fold, "model/_SUCCESS")):
            return None
        return self.spark.read.text(self._at(fold, "model"), wholetext=True).first()[0], self.spark.read.parquet(self._at(fold, "scores"))

    def save(self, fold: int, model: str, scores: DataFrame) -> DataFrame:
        scores.write.mode("overwrite").parquet(self._at(fold, "scores"))
        self.spark.createDataFrame([(model,)], "value string").coalesce(1).write.mode("overwrite").text(self._at(fold, "model"))
        return self.spark.read.parquet(self._at(fold, "scores"))


def sample_exact(df: DataFrame, n: int, seed: int = 42, id_col: str = "TX_ID") -> DataFrame:
    """Exactly ``n`` rows, repeatable: the ``n`` smallest seeded hashes (a bounded top-n)."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A9 (cheap form): Bernoulli sample with a seed."""
    return df.sample(False, fraction, seed)


def save_model(model, path: str) -> None:
    """A11."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    """A11."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
