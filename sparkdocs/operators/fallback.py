"""First success along an ordered chain of extraction providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: text stored with a failed image.
ALL_FAILED = "Image OCR/caption extraction failed: "


def provider_chain(primary: str, chain: list[str]) -> list[str]:
    """The chain, led by the primary provider if that is not part of it."""
    providers = [p.lower() for p in chain] or [primary.lower()]
    return providers if primary.lower() in providers else [primary.lower(), *providers]


def first_success(attempts: DataFrame, primary: str, chain: list[str]) -> DataFrame:
    """One row per path from attempts (path, provider, attempt_no, ok, content, error).

    A provider's first attempt counts, as the chain calls each provider once. Attempts shrink to one
    per path and provider before a path's errors are put in a list, so the list is no longer than the
    chain.
    """
    providers = provider_chain(primary, chain)
    position = F.array_position(F.lit(providers), F.lower("provider"))
    tried = attempts.withColumn("position", position).filter(F.col("position") > 0)
    per_provider = tried.groupBy("path", F.lower("provider").alias("provider"), "position").agg(
        F.min_by(F.struct("ok", "content", "error"), "attempt_no").alias("a")
    )
    per_path = per_provider.groupBy("path").agg(
        F.min(F.when(F.col("a.ok"), F.struct("position", "provider", "a.content"))).alias("won"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "position",
                    F.concat(
                        F.lit("provider="), "provider", F.lit(" error="),
                        F.coalesce("a.error", F.lit("None")),
                    ).alias("text"),
                )
            )
        ).alias("tried"),
    )
    failure = F.concat(
        F.lit(ALL_FAILED),
        F.array_join(F.transform("tried", lambda t: t["text"]), "; "),
    )
    return per_path.select(
        "path",
        F.col("won").isNotNull().alias("success"),
        F.col("won.provider").alias("provider"),
        F.col("won.content").alias("content"),
        F.when(F.col("won").isNull(), failure).alias("error_message"),
    )
