"""Fixity audit of archives: hash trees over records and ordered offset ranges, compared from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkdocs.session import stage

RANGE_BYTES = 1 << 20
FANOUT = 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """(file, offset, length, page_id, record) of pages laid out in archive files by id.

    A file takes `per_file` ids in order; rows that repeat an id follow each other by url and content.
    Pages without an id are dealt to files of their own by content.
    """
    file = F.when(
        F.col("page_id").isNull(), F.concat(F.lit("none-"), F.pmod(F.xxhash64("url", "html"), F.lit(1024)))
    ).otherwise(F.concat(F.lit("warc-"), F.floor(F.col("page_id") / per_file)))
    records = pages.select(
        file.alias("file"), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    ).withColumn("length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, length, sha256, node) of every record, written once. node is its offset range."""
    return stage(
        records.select(
            "file", "offset", "length", F.sha2(F.coalesce(F.col("record"), F.lit("")), 256).alias("sha256"),
            F.floor(F.col("offset") / range_bytes).alias("node"),
        )
    )


def tree(records: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> list[DataFrame]:
    """Levels (file, node, hash) from the ranges up to one root per file.

    A range hashes its records in order of offset, with offset and length; a node above hashes its at
    most `fanout` children in order, with their numbers. A range holds no more records than its bytes
    have room for, so no list grows with the archive. Records that share an offset are ordered by hash.
    """
    if levels is None:
        levels = depth(records, fanout)
    row = F.struct("offset", "length", "sha256")
    out = [
        stage(
            records.groupBy("file", "node").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
                "file", "node",
                F.sha2(F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["offset"], x["length"], x["sha256"])), "\n"), 256).alias("hash"),
            )
        )
    ]
    for _ in range(levels):
        child = F.struct("node", "hash")
        grouped = out[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("rows"))
        out.append(
            stage(
                grouped.select(
                    "file", F.col("up").alias("node"),
                    F.sha2(F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["node"], x["hash"])), "\n"), 256).alias("hash"),
                )
            )
        )
    return out


def depth(records: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the ranges that bring the longest file under one root."""
    last, n = records.agg(F.max("node")).first()[0] or 0, 0
    while last > 0:
        last //= fanout
        n += 1
    return n


def differing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs or that only one side has."""
    left = a.select(*key, F.col(value).alias("left_value"))
    return left.join(b.select(*key, F.col(value).alias("right_value")), key, "full").filter(
        ~F.col("left_value").eqNullSafe(F.col("right_value"))
    ).select(*key)


def audit(master: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Damage of `replica` against `master`, both as `leaves`: file, offset, length, verdict and hashes.

    Both trees are built to the same height. Roots are compared first; at each level only children of
    mismatching nodes are read and compared, and records only in mismatching ranges. verdict is
    `corrupt` (other content or length at the offset), `missing` or `extra`. Records that share an offset
    are compared as a multiset: each hash whose number differs gives one row per side.
    """
    height = max(depth(master, fanout), depth(replica, fanout))
    one, two = tree(master, fanout, height), tree(replica, fanout, height)
    bad = None
    for a, b in zip(reversed(one), reversed(two)):
        if bad is not None:
            parent = bad.select(F.col("file"), F.col("node").alias("up"))
            a, b = (
                x.withColumn("up", F.floor(F.col("node") / fanout)).join(parent, ["file", "up"], "left_semi") for x in (a, b)
            )
        bad = stage(differing(a, b, ["file", "node"], "hash"))
    keys = ["file", "offset", "sha256", "length"]
    sides = [
        x.join(bad, ["file", "node"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n")) for x in (master, replica)
    ]
    here = sides[0].withColumnRenamed("n", "n_master").join(sides[1].withColumnRenamed("n", "n_replica"), keys, "full").filter(
        ~F.col("n_master").eqNullSafe(F.col("n_replica"))
    )
    lost = here.filter("coalesce(n_master, 0) > coalesce(n_replica, 0)").select(
        "file", "offset", F.col("length").alias("length"), F.col("sha256").alias("expected_sha256")
    )
    found = here.filter("coalesce(n_replica, 0) > coalesce(n_master, 0)").select(
        "file", "offset", F.col("length").alias("found_length"), F.col("sha256").alias("found_sha256")
    )
    verdict = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra").otherwise("corrupt")
    return lost.join(found, ["file", "offset"], "full").select(
        "file", "offset", F.coalesce("length", "found_length").alias("length"), verdict.alias("verdict"),
        "expected_sha256", "found_sha256",
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage for checks: by page_id one in 97 altered, one in 211 lost, one in 307 doubled."""
    kind = F.col("page_id")
    kept = records.filter(F.coalesce(F.pmod(kind, F.lit(211)) != 7, F.lit(True)))
    altered = F.when(F.pmod(kind, F.lit(97)) == 13, F.overlay("record", F.lit("~"), F.length("record") - 4)).otherwise(F.col("record"))
    doubled = records.filter(F.pmod(kind, F.lit(307)) == 11).withColumn("offset", F.col("offset") + 1)
    return kept.withColumn("record", altered).unionByName(doubled)


MERKLE_SQL = """
WITH rec AS (
  SELECT page_id, 'warc-' || (page_id // 1000) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <page:' || page_id
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT page_id, file, record, strlen(record) AS length,
    coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM rec)
SELECT file, CAST(off AS BIGINT) AS "offset", length, 'missing' AS verdict, sha256(record) AS expected_sha256, NULL AS found_sha256
FROM placed WHERE page_id % 211 = 7
UNION ALL
SELECT file, CAST(off AS BIGINT), length, 'corrupt', sha256(record),
  sha256(substr(record, 1, length(record) - 5) || '~' || substr(record, length(record) - 3))
FROM placed WHERE page_id % 97 = 13 AND page_id % 211 <> 7
UNION ALL
SELECT file, CAST(off + 1 AS BIGINT), length, 'extra', NULL, sha256(record) FROM placed WHERE page_id % 307 = 11
"""
