"""Tables that change together: each commit is a new version written beside the current one, made
visible by one manifest entry written last.

Layout under ``root`` (a folder every executor shares): each attempt writes its tables into a fresh
folder ``v000000000007-<random>/<table>/``; ``_manifest/v000000000007/`` then holds one row naming
version 7, that folder and its tables. A version exists for readers only once its manifest entry is
complete (Spark writes the entry through its commit protocol, so it appears whole or not at all). A
run that fails while writing its tables leaves no manifest entry: readers keep the old version, the
half-written folder is ignored, and the next attempt writes into a folder of its own. Two writers
that commit the same number collide on the manifest entry (``errorifexists``) and the later one
fails instead of overwriting.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _entry(spark: SparkSession, root: str, version: int | None) -> dict | None:
    try:
        entries = spark.read.text(f"{root}/_manifest/*").select(F.get_json_object("value", "$.version").cast("long").alias("v"),
                                                                 F.col("value"))
        if version is not None:
            entries = entries.where(F.col("v") == version)
        top = entries.orderBy(F.desc("v")).first()
    except AnalysisException:
        return None
    return None if top is None else json.loads(top["value"])


def current(spark: SparkSession, root: str) -> tuple[int, list[str]] | None:
    """(version, tables) of the newest complete manifest entry; None before the first commit."""
    e = _entry(spark, root, None)
    return None if e is None else (int(e["version"]), e["tables"])


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the newest version (or of the one named)."""
    e = _entry(spark, root, version)
    if e is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} committed under {root}")
    return spark.read.parquet(f"{root}/{e['folder']}/{table}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables as the next version, then its manifest entry; returns the version."""
    now = current(spark, root)
    version = (now[0] if now else 0) + 1
    folder = f"v{version:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{folder}/{name}")
    entry = json.dumps({"version": version, "folder": folder, "tables": sorted(tables)})
    spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/_manifest/v{version:012d}")
    return version
