"""Note exports: JSON lines of notes and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkdocs.schemas import FOLDERS, NOTES


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTES).json(path)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLDERS).json(path)
