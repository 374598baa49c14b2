"""What several operators of this package share: reading tables, plan sizes, input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, at_least: int = 1 << 20) -> int:
    """The planner's size of a DataFrame in bytes (file sizes for a scan; no job runs).

    Plans without file statistics report an absurd size; those are measured by one count of rows.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 58:
        size = df.count() * 4096
    return max(size, at_least)


#: Rows of an Arrow batch between the JVM and Python, for tables of whole texts.
BATCH_ROWS = "1000"


def short_batches(df: DataFrame) -> DataFrame:
    """The same df; its session sends Arrow batches of BATCH_ROWS rows unless a size was chosen.

    The default of 10,000 whole texts a batch takes much memory in the JVM and in Python at the same time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
