"""SQL profiles: query to JSON rows, table to CSV, schema, table list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_json(spark: SparkSession, sql: str) -> DataFrame:
    """One JSON object per row of the query."""
    df = spark.sql(sql)
    return df.select(F.to_json(F.struct(*[df[c] for c in df.columns])).alias("json"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
