"""Sources and sinks: file readers by extension, JDBC, filtered extraction, named datasets.

All reads are Spark readers (split-parallel, predicate / column pushdown); nothing is
loaded through the driver. Scratch output for round trips goes under the cluster's
checkpoint folder (shared storage), never a machine-local temp directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-io/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, header: bool = True, infer_schema: bool = True,
             schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """SRC1 / SRC3: CSV with header; chunking is Spark's own file splitting."""
    r = spark.read.option("header", header).option("encoding", encoding)
    r = r.schema(schema) if schema else r.option("inferSchema", infer_schema)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema: str | None = None) -> DataFrame:
    """SRC4: JSON lines, or one JSON array per file with ``multiline=True``."""
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema else r).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC5."""
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "json": read_json, "parquet": read_parquet}


def load(spark: SparkSession, path: str, fmt: str | None = None, sample: int | None = None,
         key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """SRC6 / SRC8: dispatch by extension (works for object-store URIs too); optional exact-n sample.

    The sample is the n rows with the smallest seeded hash of the key: reproducible,
    exactly n rows, computed as a top-k (no full sort).
    """
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt not in READERS:
        raise ValueError(f"unsupported format {fmt!r}")
    df = READERS[fmt](spark, path)
    return sample_n(df, sample, key, seed) if sample else df


def sample_n(df: DataFrame, n: int, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    cols = key or df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(n)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 8, properties: dict | None = None) -> DataFrame:
    """SRC9 / SRC10: JDBC table (range-partitioned reads when a numeric column is given) or query."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if query is not None:
        return r.option("query", query).load()
    r = r.option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def extract(df: DataFrame, columns: list[str] | None = None, date_column: str | None = None,
            start: str | None = None, end: str | None = None, where: str | None = None,
            limit: int | None = None, excluded: list[str] | None = None) -> DataFrame:
    """SRC11 / SRC15: projection minus excluded columns, closed date range, extra predicate, limit.

    Written declaratively so Catalyst pushes the filters and the projection into the scan.
    """
    out = df
    if date_column and start:
        out = out.where(F.col(date_column) >= F.lit(start).cast(df.schema[date_column].dataType))
    if date_column and end:
        out = out.where(F.col(date_column) <= F.lit(end).cast(df.schema[date_column].dataType))
    if where:
        out = out.where(F.expr(where))
    cols = [c for c in (columns or df.columns) if c not in set(excluded or [])]
    out = out.select(*cols)
    return out.limit(limit) if limit else out


def excluded_columns(feedback: DataFrame, table_name: str) -> list[str]:
    """SRC15: column names users dropped for a table (a small feedback table: one row per column)."""
    return [r[0] for r in feedback.where(F.col("table_name") == table_name).select("column_name").distinct().collect()]


def date_range(df: DataFrame, column: str) -> DataFrame:
    """SRC12: min / max of a date column."""
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def row_count(df: DataFrame) -> DataFrame:
    """SRC13."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def save_dataset(df: DataFrame, root: str, name: str, description: str = "", tags: list[str] | None = None) -> str:
    """SNK1: overwrite a named parquet dataset plus a one-row metadata record written by Spark."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(f"{path}/data")
    meta = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(df.schema.json()).alias("schema"), F.lit(description).alias("description"),
        F.array(*[F.lit(t) for t in (tags or [])]).cast("array<string>").alias("tags"),
        F.current_timestamp().alias("saved_at"))
    meta.write.mode("overwrite").json(f"{path}/meta")
    return path


def load_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SNK2: the saved parquet (its schema is authoritative)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/data")


def write_extract(df: DataFrame, root: str, run_date: str, fmt: str = "csv") -> str:
    """SNK6: write an extraction run to a dated folder."""
    path = f"{root.rstrip('/')}/run_date={run_date}"
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path
