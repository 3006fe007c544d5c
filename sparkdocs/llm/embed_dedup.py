"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.llm.common import block_pairs, groups_of, task_count
from sparkdocs.llm.components import connected_components
from sparkdocs.llm.minhash import _forest
from sparkdocs.session import stage

# Vectors per bucket that the number of sign bits aims at, and chance that a pair just at the threshold is missed.
BUCKET_AIM = 32
MISSED = 1e-4
BLOCK_MEMBERS = 1024


def plan_tables(vectors: int, cosine: float, missed: float = MISSED) -> tuple[int, int]:
    """(sign bits, tables): buckets of about BUCKET_AIM vectors, enough tables for the wanted recall."""
    bits = min(40, max(4, math.ceil(math.log2(max(2, vectors / BUCKET_AIM)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log1p(-agree)))


def _parse(batches):
    """Bytes and digest of every usable vector; null for null, empty, zero or not finite ones."""
    for batch in batches:
        column = batch.column(1)
        raw, h1, h2 = [], np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for i, cell in enumerate(column):
            value = None
            if cell.is_valid and len(cell.values) and not cell.values.null_count:
                v = cell.values.to_numpy() + 0.0
                with np.errstate(over="ignore"):
                    length = np.linalg.norm(v.astype(np.float64))
                if np.isfinite(length) and length > 0:
                    value = v.tobytes()
                    h1[i], h2[i] = np.frombuffer(xxhash.xxh3_128_digest(value), np.int64)
            raw.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(h1), pa.array(h2), pa.array(raw, pa.binary())], ["vec_id", "h1", "h2", "vec"]
        )


def _units(cells: list[bytes], kind) -> np.ndarray:
    v = np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _codes(bits: int, tables: int, kind):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            codes: list = [None] * len(cells)
            by_size: dict[int, list[int]] = {}
            for i, c in enumerate(cells):
                by_size.setdefault(len(c), []).append(i)
            for size, rows in by_size.items():
                dim = size // np.dtype(kind).itemsize
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim, bits * tables))
                signs = (_units([cells[i] for i in rows], kind) @ planes[dim] > 0).reshape(len(rows), tables, bits)
                code = (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)
                for i, c in zip(rows, code):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])

    return run


def _bucket_links(cosine: float, kind):
    """Of one bucket: link counts of pairs that met in no earlier table, and a forest of all its links."""

    def run(batches):
        for table in groups_of(batches, ["t", "code", "dim", "blk_i", "blk_j"]):
            if table.num_rows < 2:
                continue
            rep, weight, own = (table.column(c).to_numpy() for c in ("rep", "n", "own"))
            order = np.argsort(rep)
            rep, weight, own = rep[order], weight[order], own[order]
            t = table.column("t")[0].as_py()
            unit = _units(table.column("vec").to_pylist(), kind)[order]
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            if table.column("blk_i")[0].as_py() != table.column("blk_j")[0].as_py():
                linked &= own[:, None] != own[None, :]
            i, j = np.nonzero(np.triu(linked))
            if not len(i):
                continue
            edges = np.array(_forest(len(rep), lambda x, rest: linked[x, rest]))
            codes = np.array(table.column("codes").to_pylist())[order][:, :t]
            fresh = np.ones(len(i), bool)
            for start in range(0, len(i), 100_000):
                part = slice(start, start + 100_000)
                fresh[part] = ~(codes[i[part]] == codes[j[part]]).any(axis=1)
            i, j = i[fresh], j[fresh]
            counts = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((rep[edges[:, 0]], rep[some]))),
                    pa.array(rep[edges[:, 1]].tolist() + [None] * len(some), pa.int64()),
                    pa.array(np.concatenate((np.zeros(len(edges), np.int64), counts[some].astype(np.int64)))),
                ],
                ["a", "b", "links"],
            )

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors become one class with a count. Classes are hashed by the signs of random projections in
    several tables, whose number follows from the threshold, the bits and MISSED; members of a bucket are
    compared by cosine in double precision. A pair counts in the first table where it meets, so n_links is
    the number of other rows linked directly, and only counts and a spanning forest leave a bucket.
    component_id is the smallest vec_id reachable. Buckets above BLOCK_MEMBERS are dealt to block pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
    of different lengths never link. Rows without vec_id link with nothing, have a null component_id and
    are kept. Rows that repeat a vec_id count as further vectors and share their component.
    """
    double = "double" in dict(vectors.dtypes)["embedding"]
    kind = "<f8" if double else "<f4"
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"),
    )
    parsed = stage(source.mapInArrow(_parse, "vec_id long, h1 long, h2 long, vec binary"))
    classes = stage(
        parsed.filter("vec IS NOT NULL AND vec_id IS NOT NULL").groupBy("h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vec").alias("vec")
        )
    )
    bits, tables = plan_tables(classes.count(), cosine)
    hashed = classes.select("rep", "n", "vec").mapInArrow(
        _codes(bits, tables, kind), "rep long, n long, vec binary, codes array<long>"
    )
    # The projections are made once; the buckets are then cut from columns of the written table.
    hashed = stage(hashed)
    placed = hashed.select("rep", "n", "vec", "codes", F.length("vec").alias("dim"), F.posexplode("codes").alias("t", "code"))
    bucket = ["t", "code", "dim"]
    large = placed.groupBy(*bucket).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK_MEMBERS)
    sized = placed.join(large, bucket, "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("size") / BLOCK_MEMBERS), F.lit(1))
    )
    dealt = block_pairs(sized.drop("size"), "blocks", "rep").drop("blocks")
    keys = [*bucket, "blk_i", "blk_j"]
    found = stage(
        dealt.repartition(task_count(dealt), *keys).sortWithinPartitions(*keys).mapInArrow(
            _bucket_links(cosine, kind), "a long, b long, links long"
        )
    )
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("b IS NOT NULL"))
    named = (
        classes.select("h1", "h2", "rep", "n")
        .join(links, "rep", "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .select(
            "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("class_links"),
            F.coalesce("component", "rep").alias("class_component"), F.lit(True).alias("usable"),
        )
    )
    ready = parsed.select("vec_id", "h1", "h2", (F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).alias("usable"))
    return ready.join(named, ["h1", "h2", "usable"], "left").select(
        "vec_id",
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("class_component", "vec_id"), F.lit(True)).alias("kept"),
    )
