"""Size-checked broadcasts, and rankings that keep hot groups off a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocs.session import cut_lineage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Words of 64 ids that a set of ids may have to be broadcast.
BROADCAST_WORDS = 500_000


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Count rows and bytes of their values, reading no more than `rows + 1` rows.

    Each row is measured where it lies; only the sizes are brought together.
    """
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            own = F.octet_length(F.col(f"`{name}`"))
        elif kind.startswith(("array", "map", "struct", "variant")):
            own = F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
        else:
            own = F.lit(16)
        width = width + F.coalesce(own, F.lit(16))
    seen = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("w").alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def number_rows(
    df: DataFrame, group: list[str], order: list[Column], name: str = "row_no", total: str | None = None
) -> DataFrame:
    """Exact row numbers per group where one group may hold most rows.

    Rows are range-partitioned by group and order, numbered inside each slice, and shifted by the
    sizes of the earlier slices of their group. The slices are written once, because a second range
    partitioning may draw other borders.
    """
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = cut_lineage(
        df.repartitionByRange(slices, *[F.col(g) for g in group], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    sizes = ranged.groupBy(*group, "_slice").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = ranged.withColumn("_in", inside).join(starts, same)
    out = [F.col(c) for c in df.columns] + [(F.col("_in") + F.col("_start")).alias(name)]
    if total:
        out.append(F.col("_total").alias(total))
    return numbered.select(*out)


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, spread: list[str], salts: int = 64
) -> DataFrame:
    """First `k` rows of every group, cut per salt before the groups are brought together."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= k)
    return (
        kept.withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int = 1_000_000,
    salts: int = 64,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join (`inner` or `left`) of many rows to a side with few rows per key, safe for hot keys.

    A right side of checked size is broadcast. Otherwise keys that hold both `hot_rows` and a
    thousandth of the left side, hence a thousand keys at most, are salted: the right rows of those
    keys are repeated per salt, all other keys join plainly.
    """
    if fits_broadcast(right, rows=broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = cut_lineage(counts.filter(F.col("_n") >= max(hot_rows, total // 1000)).select(*on))
    if hot.isEmpty():
        return left.join(right, on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    hot_left = left.join(F.broadcast(hot), on, "left_semi").withColumn("_salt", salt)
    hot_right = right.join(F.broadcast(hot), on, "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    salted = hot_left.join(hot_right, [*on, "_salt"], how).drop("_salt")
    cold = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return cold.unionByName(salted)


class IdSet:
    """A set of ids to keep or leave out rows by; ids are broadcast as words of 64 bits if there are few words.

    Ids that lie close together take a bit each. A set of too many words meets the rows by an ordinary join.
    """

    def __init__(self, ids: DataFrame, most: int = BROADCAST_WORDS):
        one = F.col("id").cast("long")
        self.ids = ids.select(one.alias("id")).filter(F.col("id").isNotNull())
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
        self.words = self.ids.groupBy(F.shiftright("id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
        self.small = self.words.count() <= most

    def join(self, df: DataFrame, how: str) -> DataFrame:
        """Rows of `df` whose id is in the set (`left_semi`) or is not (`left_anti`)."""
        if not self.small:
            return df.join(self.ids, "id", how)
        held = F.getbit(F.col("_bits"), df["id"].bitwiseAND(63).cast("int")) == 1
        return df.join(F.broadcast(self.words), (F.shiftright(df["id"], 6) == F.col("_word")) & held, how)
