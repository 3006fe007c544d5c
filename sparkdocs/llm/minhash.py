"""Near-duplicate documents by b-bit MinHash: low bits of minima, banded candidates, exact check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.llm.common import WordHashes, ascii_words, block_pairs, groups_of, task_count
from sparkdocs.llm.components import connected_components
from sparkdocs.session import stage

WORDS = 5
PERMUTATIONS = 128
BITS = 4
ROWS_PER_BAND = 5
BANDS = 24
# Bucket members and shingles that one task compares; larger groups are dealt to pairs of blocks.
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 1_000_000
SLICE_ROWS = 1000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_NIBBLES = np.uint64(0x1111111111111111)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list, cache: WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; a shorter text is one shingle, none is empty."""
    out = []
    for text in texts:
        tokens = ascii_words(text)
        n = len(tokens)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, n)
        if n < words:
            acc = np.array([n], np.uint64)
            for value in h:
                acc = acc * _MUL + value
        else:
            acc = h[: n - words + 1].copy()
            for i in range(1, words):
                acc *= _MUL
                acc += h[i : n - words + 1 + i]
        out.append(np.unique(_mix(acc)))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240601)
    return (
        draw.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32),
        draw.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
    )


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima (uint32) of every non-empty set, one row per set."""
    xor, mul = _permutations()
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    first = 0
    while first < len(sets):  # slices that stay in the processor's cache
        last, total = first, 0
        while last < len(sets) and (last == first or total + sizes[last] <= 60_000):
            total += sizes[last]
            last += 1
        values = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes[first : last - 1])))
        for k in range(PERMUTATIONS):
            out[first:last, k] = np.minimum.reduceat((values ^ xor[k]) * mul[k], starts)
        first = last
    return out


def pack_low_bits(mins: np.ndarray) -> np.ndarray:
    """BITS bits of every minimum packed into uint64 words."""
    low = ((mins >> np.uint32(7)) & np.uint32(2**BITS - 1)).astype(np.uint64)
    per = 64 // BITS
    low = low.reshape(len(mins), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: equal fields, corrected for fields that agree by chance."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & _NIBBLES
    same = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.float64) / PERMUTATIONS
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def slack(similarity: float) -> float:
    """Least estimate a true pair may have: five standard deviations below the threshold."""
    same = similarity + (1 - similarity) * 2.0**-BITS
    return similarity - 5 * (same * (1 - same) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-BITS)


def _sign(batches):
    cache = WordHashes()
    for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
        sets = shingle_sets(batch.column(1).to_pylist(), cache)
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        sigs: list = [None] * len(sets)
        h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        if full:
            mins = minima([sets[i] for i in full])
            packed = pack_low_bits(mins)
            keys = np.zeros((len(full), BANDS), np.uint64)
            for j in range(BANDS):
                acc = np.full(len(full), j + 1, np.uint64)
                for r in range(ROWS_PER_BAND):
                    acc = acc * _MUL + mins[:, j * ROWS_PER_BAND + r].astype(np.uint64) + np.uint64(1)
                    acc = _mix(acc)
                keys[:, j] = acc
            keys = keys.view(np.int64)
            for row, i in enumerate(full):
                bands[i] = keys[row]
                sigs[i] = packed[row].tobytes()
                digest = xxhash.xxh3_128_digest(sets[i].tobytes())
                h1[i], h2[i] = np.frombuffer(digest, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
            ],
            ["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands", "sig"],
        )


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; `near(i, rest)` gives the members of `rest` linked with i."""
    rest = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                edges.extend((i, int(j)) for j in found)
                front.extend(found.tolist())
                rest = rest[~hit]
    return edges


def _bucket_links(least: float):
    """Members of a bucket that the estimate does not part, as a spanning forest."""

    def run(batches):
        for table in groups_of(batches, ["key", "blk_i", "blk_j"]):
            n = table.num_rows
            if n < 2:
                continue
            rep = table.column("rep").to_numpy()
            order = np.argsort(rep)
            rep = rep[order]
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(n, -1)[order]
            edges = _forest(n, lambda i, rest: estimate(sig[rest], sig[i]) >= least)
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], ["a", "b"])

    return run


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of all links of a group, from shared shingles counted in full."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    posted = owner[order]
    ends = np.cumsum(np.bincount(ids))
    starts = ends - np.bincount(ids)
    bounds = np.concatenate(([0], np.cumsum(sizes)))

    def near(i, rest):
        mine = ids[bounds[i] : bounds[i + 1]]
        shared = np.bincount(np.concatenate([posted[starts[s] : ends[s]] for s in mine]), minlength=n)[rest]
        return 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)

    return _forest(n, near)


def _cluster_links(percent: int, words: int):
    def run(batches):
        cache = WordHashes()
        for table in groups_of(batches, ["cluster", "blk_i", "blk_j"]):
            rep, first = np.unique(table.column("rep").to_numpy(), return_index=True)
            if len(rep) < 2:
                continue
            texts = table.column("text")
            sets = [shingle_sets([texts[int(i)].as_py()], cache, words)[0] for i in first]
            edges = exact_forest(sets, percent)
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], ["a", "b"])

    return run


def _sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(task_count(df), *keys).sortWithinPartitions(*keys)


def text_hash(text: Column) -> Column:
    """64-bit hash that tells apart the texts of a reused doc_id."""
    return F.xxhash64(text.cast("string"))


def linked(docs: DataFrame, percent: int) -> DataFrame:
    """`near_duplicates` with text_hash and group as well: group is null or the same for all rows of a component.

    A component is known by its set of texts, not by an id: two components may share their smallest doc_id.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        text_hash(F.col("text")).alias("text_hash"),
    )
    signed = stage(
        source.mapInArrow(
            _sign, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"
        )
    )
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.struct("doc_id", "text_hash", "n_shingles", "bands", "sig")
    classes = stage(
        usable.groupBy("h1", "h2").agg(F.min_by(one, F.struct("doc_id", "text_hash")).alias("c"))
        .select("h1", "h2", "c.*", F.monotonically_increasing_id().alias("rep"))
    )
    spread = classes.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = spread.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK_MEMBERS))
    dealt = block_pairs(members.select("key", "rep", "blocks"), "blocks", "rep")
    dealt = dealt.join(classes.select("rep", "sig"), "rep").select("key", "blk_i", "blk_j", "rep", "sig")
    loose = _sorted_groups(dealt, ["key", "blk_i", "blk_j"]).mapInArrow(
        _bucket_links(slack(percent / 100)), "a long, b long"
    )
    cluster = stage(connected_components(loose).select(F.col("node").alias("rep"), F.col("component").alias("cluster")))
    sized = cluster.join(classes.select("rep", "n_shingles"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    counts = sized.groupBy("cluster").agg(blocks.alias("blocks"))
    checked = block_pairs(cluster.join(counts, "cluster"), "blocks", "rep")
    checked = checked.join(classes.select("rep", "doc_id", "text_hash"), "rep")
    texts = source.join(checked, ["doc_id", "text_hash"]).select("cluster", "blk_i", "blk_j", "rep", "text")
    links = _sorted_groups(texts, ["cluster", "blk_i", "blk_j"]).mapInArrow(
        _cluster_links(percent, WORDS), "a long, b long"
    )
    found = connected_components(links).join(
        classes.select(F.col("rep").alias("node"), "doc_id"), "node"
    )
    least = found.groupBy("component").agg(F.min("doc_id").alias("least_id"))
    found = found.join(least, "component").select(F.col("node").alias("rep"), "component", "least_id")
    named = classes.join(found, "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("group"), F.coalesce("least_id", "doc_id").alias("class_component")
    )
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "h1", "h2")
        .join(named, ["h1", "h2"], "left")
        .withColumn("group", F.when(in_class, F.col("group")))
        .withColumn("component_id", F.when(in_class, F.col("class_component")).otherwise(F.col("doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "text_hash", "n_shingles", "group", "component_id", "kept")
    )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |A & B| >= percent * |A | B| over distinct five-word shingles are linked, and
    component_id is the smallest doc_id reachable. Steps: minima and their packed low bits per document;
    documents with the same set become one class; classes that share a band bucket and whose corrected
    estimate is not five deviations too low form loose clusters; inside a cluster all links are checked on
    full sets and only a spanning forest leaves the task. A true pair misses every band with probability
    8e-7 at the threshold, and the estimate drops it with 3e-7. Hashes of words and sets have 64 and 128
    bits. Large buckets and clusters are dealt to pairs of blocks.

    A null or empty text has n_shingles 0 and links with nothing. A row without doc_id links with nothing,
    has a null component_id and is kept. Rows that repeat a doc_id keep one row each; if their texts differ
    they are documents of their own, which a shared doc_id does not link. Other columns are not looked at.
    """
    return linked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")
