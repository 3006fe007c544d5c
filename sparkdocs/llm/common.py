"""Pieces that several operators share: word hashes, Arrow batches cut into groups, block counts."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Distinct words a task remembers; the frequent ones come early, later ones are computed again.
CACHE_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; none for a null text."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def groups_of(batches, keys: list[str]):
    """Whole groups of an Arrow stream that is sorted by `keys`, each as one table."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, blocks: str, member: str) -> DataFrame:
    """Rows of a group dealt to pairs of its `blocks` blocks, so that any two members meet in one.

    Adds `blk_i` <= `blk_j` and the member's `own` block. A group of one block is not repeated; one of b
    blocks is repeated b times.
    """
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return (
        df.withColumn("own", own)
        .withColumn("_other", other)
        .withColumn("blk_i", F.least("own", "_other"))
        .withColumn("blk_j", F.greatest("own", "_other"))
        .drop("_other")
    )


def task_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least 1."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
