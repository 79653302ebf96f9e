"""File listings and whole-file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, folder: str, glob: str = "*", predicate: Column | None = None) -> DataFrame:
    """Files below a folder as (path, length, modified); contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return found if predicate is None else found.where(predicate)


def find_packages(files: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Folders holding at least one of the files, as (folder)."""
    folders = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct()
    return folders if predicate is None else folders.where(predicate)


def read_sources(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """Whole files as (path, content), from a flat list of files and folders."""
    return (
        spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
