"""How queries are registered: a function of (spark, folder) and the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; without ``sql`` tests check its rows."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows of a few large input splits to all cores before costly expressions.

    Fixture files hold a single row group and load as one partition; a corpus of
    many splits has parallelism enough and is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
