"""Sources: files by extension, nested documents, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALLOWED = {"csv", "json", "parquet", "orc"}


def allowed_file(name: str) -> bool:
    return "." in name and name.rsplit(".", 1)[1].lower() in ALLOWED


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header row; types from the schema, inferred (one more pass) only without one."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, records: bool = True) -> DataFrame:
    """``records``: each file is one array of records; otherwise one record per line."""
    r = spark.read.option("multiLine", records)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    fmt = fmt or (path.rstrip("/").rsplit(".", 1)[-1].lower() if allowed_file(path.rstrip("/")) else None)
    if fmt not in ALLOWED:
        raise ValueError(f"unsupported file type: {path}")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema is not None else r).load(path)


def read_materialized(spark: SparkSession, csv: str, parquet: str, schema: StructType | str | None = None) -> DataFrame:
    """The Parquet copy of a CSV file, written on first use and only read afterwards."""
    done = spark._jvm.org.apache.hadoop.fs.Path(parquet, "_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        read_csv(spark, csv, schema).write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet)


IMPORTANCE_SCHEMA = ("dataset string, production_feature_importance array<struct<feature:string, importance:double>>")


def read_importance_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents (one per data set) to (dataset, feature, importance) rows."""
    docs = spark.read.schema(IMPORTANCE_SCHEMA).json(path)
    return docs.select("dataset", F.explode("production_feature_importance").alias("x")).select("dataset", "x.*")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Parallel read of a database table, split by ranges of a numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
                                              numPartitions=str(parts), **options).load())


def parse_json_text(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Legacy JSON kept in a text column, as a typed column."""
    return df.withColumn(col, F.from_json(col, schema))
