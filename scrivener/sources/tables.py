"""Relational / document scans (A6, A7) over parquet tables.

``spark.read.parquet`` gives predicate and column pushdown for free; a JDBC
form is provided for the relational stores the services used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Relational scan through JDBC; filters and projections are pushed to
    the database. A partition column splits the read across executors."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (props or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Write ``df`` as a table bucketed and sorted by ``key``.

    Tables joined on the same key with the same bucket count (e.g. orders,
    documents and lineitem by submission id) then join bucket-to-bucket with
    no shuffle of either side. The warehouse folder must be shared storage.
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
     .saveAsTable(name))
