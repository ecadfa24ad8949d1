"""Where jobs stage tables of their own: under spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging(spark: SparkSession, what: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # tests, in one process
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores, before a costly step. A narrow table has few bytes and so few tasks read it, however many
    rows it has; the number is fixed, as few bytes would be laid together again."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def staged(rows: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to a folder of their own, with one in it for each value of `by`, and read them again."""
    path = staging(rows.sparkSession, what)
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
