"""Snapshots: one Parquet folder a table with a manifest, checked and upgraded when read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators.store import upgraded

VERSION = 2
#: Columns that version 1 lacked, with their defaults.
ADDED = {"memories": {"version": ("int", 1), "retrieval_strength": ("float", 1.0), "storage_strength": ("float", 0.0), "access_count": ("int", 0), "pinned": ("boolean", False)}}


def write_archive(tables: dict[str, DataFrame], folder: str, label: str = "", created_us: int = 0) -> str:
    """Writes all tables and a manifest below ``folder``; returns the archive's path.  Signs outside letters, digits, - and _ are left out of the label."""
    clean = re.sub(r"[^A-Za-z0-9_-]+", "", label)
    path = f"{folder.rstrip('/')}/archive-{created_us:020d}" + (f"-{clean}" if clean else "")
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        counts.append((name, spark.read.schema(df.schema).parquet(f"{path}/{name}").count(), VERSION, created_us))
    spark.createDataFrame(counts, "table string, n_rows long, format_version int, created_us long").coalesce(1).write.json(f"{path}/_manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, n_rows long, format_version int, created_us long").json(f"{path}/_manifest")


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive in today's form; an archive of a later form, or with missing rows, is refused."""
    rows = manifest(spark, path).collect()  # one row a table
    if not rows:
        raise ValueError("not an archive")
    if max(r["format_version"] for r in rows) > VERSION:
        raise ValueError("the archive is newer than this version reads")
    out = {}
    for r in rows:
        df = spark.read.parquet(f"{path}/{r['table']}")
        if df.count() != r["n_rows"]:
            raise ValueError(f"{r['table']} has not the rows that the manifest says")
        columns = {c: (kind, F.lit(v)) for c, (kind, v) in ADDED.get(r["table"], {}).items()}
        out[r["table"]] = upgraded(df, columns) if columns else df
    return out


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, created_us, format_version, total_rows)`` of the archives below ``folder``, from their manifests only; newest first."""
    rows = spark.read.schema("table string, n_rows long, format_version int, created_us long").json(f"{folder.rstrip('/')}/archive-*/_manifest")
    name = F.regexp_extract(F.input_file_name(), r"/(archive-[^/]*)/_manifest/", 1)
    told = rows.withColumn("name", name).groupBy("name").agg(F.max("created_us").alias("created_us"), F.max("format_version").alias("format_version"), F.sum("n_rows").alias("total_rows"))
    return told.orderBy(F.desc("name"))
