"""File-type catalog, its order, and the facets of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs import schemas as S


def type_catalog(spark: SparkSession) -> DataFrame:
    """The 31 known extensions with category, code, label and display positions."""
    rows = []
    for i, (ext, category, description) in enumerate(S.FILE_TYPES):
        code = S.CATEGORY_CONVERSION[category]
        rows.append((ext, category, description, code, S.CONVERSION_LABELS[code], i))
    schema = "ext string, category string, description string, conversion_type int, label string, listed int"
    return spark.createDataFrame(rows, schema)


def join_catalog(docs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Documents with the catalog entry of their type. The catalog has a fixed 31 rows: broadcast."""
    entries = (catalog or type_catalog(docs.sparkSession)).select(
        "ext", "category", "description", F.col("label").alias("type_label")
    )
    return docs.join(F.broadcast(entries), F.lower("file_type") == F.col("ext"), "left").drop("ext")


def ordered_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog with `category_position` and `ext_position`: listed entries first, others as they come."""
    last = F.lit(1_000_000)

    def position(names: list[str], value):
        at = F.array_position(F.lit(names), value)
        return F.when(at > 0, at).otherwise(last)

    within = last
    for category, names in S.EXTENSION_ORDER.items():
        within = F.when(F.col("category") == category, position(names, F.col("ext"))).otherwise(within)
    return catalog.withColumns({
        "category_position": position(S.CATEGORY_ORDER, F.col("category")),
        "ext_position": within,
    }).orderBy("category_position", "category", "ext_position", "listed")


def sources(docs: DataFrame) -> DataFrame:
    """Distinct non-empty sources."""
    return docs.select("source").filter(F.col("source") != "").distinct()


def file_types(docs: DataFrame) -> DataFrame:
    """Distinct non-empty file types as stored."""
    return docs.select("file_type").filter(F.col("file_type") != "").distinct()
