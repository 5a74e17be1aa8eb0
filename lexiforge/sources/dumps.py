"""Dictionary-wiki XML dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("revision", T.ArrayType(T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))]))),
])

#: The same with each revision's time and number.
REVISED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("revision", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("id", T.LongType()), T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
    ]))),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, text of every page, from any export version (tags match by local name). The last revision counts; an empty text is null."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return rows.select("title", "ns", F.try_element_at("revision", F.lit(-1))["text"]["_VALUE"].alias("text"))


def revised_pages(rows: DataFrame) -> DataFrame:
    """title, revised (its last revision's timestamp and id, which sort by time), ns, text of rows (REVISED)."""
    last = F.try_element_at("revision", F.lit(-1))
    return rows.select("title", F.struct(last["timestamp"].alias("timestamp"), last["id"].alias("id")).alias("revised"), "ns", last["text"]["_VALUE"].alias("text"))


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """revised_pages() of a dump or a folder of dumps."""
    return revised_pages(spark.read.format("xml").option("rowTag", "page").schema(REVISED).load(path))


def land_pages(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Parse a dump once and keep it as Parquet by kind (template or article), so that later scans prune columns and partitions."""
    kind = F.when(F.col("title").startswith("Шаблон:"), "template").otherwise("article")
    read_pages(spark, path).withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(out)
    return spark.read.parquet(out)
