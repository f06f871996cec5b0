"""Listing of supported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright import fixed


class FileTypeError(ValueError):
    """The file name has no supported extension."""


def extension(name: Column) -> Column:
    """Lower-case suffix of a path; a leading dot alone starts no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def file_type(name: Column) -> Column:
    """``csv`` or ``excel`` by suffix, null for anything else."""
    kind = F
    for suffix, label in fixed.FILE_TYPES.items():
        kind = kind.when(extension(name) == suffix, F.lit(label))
    return kind


def file_type_of(name: str) -> str:
    """File type of one name; raises for an unsupported one."""
    base = name.rsplit("/", 1)[-1]
    stem, dot, suffix = base.rpartition(".")
    kind = fixed.FILE_TYPES.get("." + suffix.lower()) if dot and stem else None
    if kind is None:
        raise FileTypeError(fixed.ERR_FILE_TYPE)
    return kind


def list_supported_files(spark: SparkSession, prefix: str) -> DataFrame:
    """``key, size, last_modified, format`` of the supported files below a prefix.

    Only names and sizes are read: the content column is pruned.  Spark lists
    large trees in parallel and skips names that start with ``_`` or ``.``.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix)
        .select("path", "length", "modificationTime")
    )
    return (
        listed.select(
            F.col("path").alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("last_modified"),
            file_type(F.col("path")).alias("format"),
        )
        .where(F.col("format").isNotNull())
        .orderBy(F.lower("key"), "key")
    )
