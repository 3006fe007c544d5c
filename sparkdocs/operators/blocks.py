"""Index rows on their way into ranges: sorted blocks of many rows, packed, not a row each.

An index row (key, id, and for postings tf and positions) is a few bytes of content in a row of eighty. So the tasks
that make such rows sort them and pack them into blocks, which are written once. Borders of the ranges come from
places drawn evenly from all blocks; each task then cuts its blocks at the borders, and a range is put together
and written by one task. A range holds about as many rows as the others, also where one key has most of them.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.session import shuffles_removed, staged

# Rows that a task sorts at a time, rows of a range at most on average, and at least if there are many partitions.
BLOCK_ROWS, RANGE_ROWS, LEAST_ROWS = 1_000_000, 3_000_000, 500_000
# One row in so many is drawn for the borders, of these so many for each range at most.
_STEP, _DRAWN = 1024, 200
# Rows that a range hands over at a time.
_OUT = 50_000

BLOCKS = "n long, drawn array<struct<key:string,id:long>>, block binary"
DRAWN = pa.list_(pa.struct([("key", pa.string()), ("id", pa.int64())]))


class Rows:
    """Rows ordered by key and id: sorted distinct `keys`, rows of each in `sizes`, and columns of the rows.

    `tf` may be absent; `counts` has the number of `places` of each row, if rows have any.
    """

    def __init__(self, keys, sizes, ids, tf=None, counts=None, places=None):
        self.keys, self.sizes, self.ids, self.tf, self.counts, self.places = keys, sizes, ids, tf, counts, places

    def __len__(self):
        return len(self.ids)

    def cut(self, start: int, end: int, starts: np.ndarray, bounds: np.ndarray | None) -> Rows:
        """Rows `start` to `end`; `starts` and `bounds` are the first rows of keys and first places of rows."""
        first, last = np.searchsorted(starts, start, "right") - 1, np.searchsorted(starts, end - 1, "right")
        own = np.clip(starts[first : last + 1], start, end)
        places = None if self.places is None else self.places[bounds[start] : bounds[end]]
        part = [None if c is None else c[start:end] for c in (self.tf, self.counts)]
        return Rows(self.keys.slice(first, last - first), np.diff(own), self.ids[start:end], *part, places)


def _bounds(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _steps(values: np.ndarray, sizes) -> np.ndarray:
    """Values that ascend within groups as differences, the first of a group against 0."""
    out = np.diff(values, prepend=values[:1] * 0)
    first = _bounds(sizes)[:-1][np.asarray(sizes) > 0]
    out[first] = values[first]
    return out


def _from_steps(steps: np.ndarray, sizes) -> np.ndarray:
    total = np.cumsum(steps)
    before = total - steps
    return total - np.repeat(before[_bounds(sizes)[:-1][np.asarray(sizes) > 0]], np.asarray(sizes)[np.asarray(sizes) > 0])


def _planes(values: np.ndarray) -> pa.ListArray:
    """Integers as one cell of bytes: all lowest bytes, then the next ones; as many as the largest needs."""
    values = np.ascontiguousarray(values, np.int64)
    seen = int(np.bitwise_or.reduce(values)) if len(values) else 0
    width = 8 if seen < 0 else (seen.bit_length() + 7) // 8
    cell = np.concatenate([(values >> (8 * k)).astype(np.uint8) for k in range(width)]) if width else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays([0, len(cell)], pa.array(cell))


def _from_planes(cell: pa.ListArray, n: int) -> np.ndarray:
    data, out = cell.flatten().to_numpy(), np.zeros(n, np.int64)
    for k in range(len(data) // n if n else 0):
        out |= data[k * n : (k + 1) * n].astype(np.int64) << (8 * k)
    return out


def pack(rows: Rows) -> bytes:
    docs, rank = np.unique(rows.ids, return_inverse=True)
    cells = {
        "keys": pa.ListArray.from_arrays([0, len(rows.keys)], rows.keys), "sizes": _planes(rows.sizes),
        "docs": pa.ListArray.from_arrays([0, len(docs)], pa.array(np.diff(docs, prepend=docs[:1] * 0))),
        "rank": _planes(_steps(rank, rows.sizes)),
    }
    if rows.tf is not None:
        cells["tf"] = _planes(rows.tf)
    if rows.counts is not None:
        if rows.tf is None or not np.array_equal(rows.tf, rows.counts):
            cells["counts"] = _planes(rows.counts)
        cells["places"] = _planes(_steps(rows.places.astype(np.int64), rows.counts))
    batch = pa.RecordBatch.from_arrays(list(cells.values()), list(cells))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(block: bytes) -> Rows:
    batch = pa.ipc.open_stream(block).read_next_batch()
    cell = dict(zip(batch.schema.names, batch.columns))
    keys = cell["keys"].flatten()
    sizes = _from_planes(cell["sizes"], len(keys))
    n = int(sizes.sum())
    docs = np.cumsum(cell["docs"].flatten().to_numpy())
    ids = docs[_from_steps(_from_planes(cell["rank"], n), sizes)] if n else np.empty(0, np.int64)
    tf = _from_planes(cell["tf"], n) if "tf" in cell else None
    if "places" not in cell:
        return Rows(keys, sizes, ids, tf)
    counts = _from_planes(cell["counts"], n) if "counts" in cell else tf
    return Rows(keys, sizes, ids, tf, counts, _from_steps(_from_planes(cell["places"], int(counts.sum())), counts).astype(np.int32))


def sorted_rows(keys: pa.Array, code: np.ndarray, ids: np.ndarray, tf=None, positions: pa.ListArray | None = None) -> Rows:
    """Rows in the order of (key, id); `code` has the place of each row's key in `keys`, which may repeat."""
    coded = keys.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy()][code]
    by = np.lexsort((ids, key))
    sizes = np.bincount(key, minlength=len(order))
    held = np.flatnonzero(sizes)
    out = Rows(coded.dictionary.take(pa.array(order[held])), sizes[held], ids[by], None if tf is None else tf[by])
    if positions is not None:
        taken = positions.take(pa.array(by))
        out.counts = pc.list_value_length(taken).to_numpy().astype(np.int64)
        out.places = taken.flatten().to_numpy()
    return out


def distinct(parts, below: int) -> np.ndarray:
    """Distinct values of some arrays, ascending; all are at least 0 and less than `below`."""
    if below <= 1 << 26:
        seen = np.zeros(below, bool)
        for values in parts:
            seen[values] = True
        return np.flatnonzero(seen)

    def once(values):
        values = np.sort(values)
        return values[np.diff(values, prepend=-1) != 0]

    return once(np.concatenate([np.empty(0, np.int64), *map(once, parts)]))


def row_batches(rows: Rows, names: list[str]):
    """Arrow batches of the rows, a row each."""
    key, bounds = np.repeat(np.arange(len(rows.keys)), rows.sizes), None if rows.counts is None else _bounds(rows.counts)
    for start in range(0, len(rows), _OUT):
        end = min(start + _OUT, len(rows))
        columns = [rows.keys.take(pa.array(key[start:end])), pa.array(rows.ids[start:end])]
        if rows.tf is not None:
            columns.append(pa.array(rows.tf[start:end]))
        if bounds is not None:
            own = (bounds[start : end + 1] - bounds[start]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(own), pa.array(rows.places[bounds[start] : bounds[end]])))
        yield pa.RecordBatch.from_arrays(columns, names)


def block_batch(rows: Rows) -> pa.RecordBatch:
    """One row of BLOCKS."""
    at = np.arange(np.random.default_rng().integers(_STEP), len(rows), _STEP)
    key = rows.keys.take(pa.array(np.searchsorted(_bounds(rows.sizes), at, "right") - 1))
    drawn = pa.ListArray.from_arrays([0, len(at)], pa.StructArray.from_arrays([key, pa.array(rows.ids[at])], ["key", "id"]))
    return pa.RecordBatch.from_arrays([pa.array([len(rows)]), drawn.cast(DRAWN), pa.array([pack(rows)], pa.binary())], ["n", "drawn", "block"])


def _packed(batches):
    """Blocks of Arrow batches (key, id[, tf[, positions]])."""
    held, n = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [c.chunk(0) for c in table.columns]
        coded = columns[0].dictionary_encode()
        tf = columns[2].to_numpy() if len(columns) > 2 else None
        return block_batch(sorted_rows(coded.dictionary, coded.indices.to_numpy(), columns[1].to_numpy(), tf, *columns[3:]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of a table whose columns are a key, id and, for postings, tf and positions, in this order."""
    return rows.mapInArrow(_packed, BLOCKS)


def _cut_at(borders: list[tuple[str, int]]):
    def cut(batches):
        for batch in batches:
            for block in batch.column(0):
                rows = unpack(block.as_py())
                keys, starts = rows.keys.to_pylist(), _bounds(rows.sizes)
                bounds = None if rows.counts is None else _bounds(rows.counts)
                at = [0]
                for key, id_ in borders:
                    k = bisect_left(keys, key)
                    row = starts[k]
                    if k < len(keys) and keys[k] == key:
                        row += np.searchsorted(rows.ids[row : starts[k + 1]], id_)
                    at.append(int(row))
                at.append(len(rows))
                for part, (start, end) in enumerate(zip(at, at[1:])):
                    if start < end:
                        piece = pack(rows.cut(start, end, starts, bounds))
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.binary())], ["part", "block"])

    return cut


def _merged(names: list[str]):
    """Rows of all blocks of a task in the order of (key, id)."""

    def merge(batches):
        held = [unpack(block.as_py()) for batch in batches for block in batch.column(0)]
        if not held:
            return
        code = np.repeat(np.arange(sum(len(r.keys) for r in held)), np.concatenate([r.sizes for r in held]))
        tf = None if held[0].tf is None else np.concatenate([r.tf for r in held])
        positions = None
        if held[0].counts is not None:
            ends = _bounds(np.concatenate([r.counts for r in held])).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r.places for r in held])))
        keys, ids = pa.concat_arrays([r.keys for r in held]), np.concatenate([r.ids for r in held])
        held.clear()
        rows = sorted_rows(keys, code, ids, tf, positions)
        del code, ids, tf, positions
        yield from row_batches(rows, names)

    return merge


def write_ranges(blocks: DataFrame, schema: str, path: str, partitions: int | None = None) -> None:
    """Write the rows of stored blocks to Parquet in ranges of (key, id), as columns of `schema`."""
    session = blocks.sparkSession
    total = blocks.agg(F.sum("n")).first()[0] or 0
    n = partitions or min(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_ROWS))
    n = max(1, n, -(-total // RANGE_ROWS))
    share = min(1.0, _DRAWN * n * _STEP / max(1, total))
    drawn = blocks.select(F.explode("drawn").alias("d")).select("d.*")
    places = sorted((r.key, r.id) for r in (drawn.filter(F.rand() < share) if share < 1 else drawn).collect())
    borders = sorted({places[i * len(places) // n] for i in range(1, n)}) if places else []
    pieces = blocks.select("block").mapInArrow(_cut_at(borders), "part int, block binary")
    ranged = pieces.repartitionById(len(borders) + 1, F.col("part")).select("block")
    names = session.createDataFrame([], schema).columns
    # Delta encoding of ids needs the second version of the format.
    options = {"compression": "zstd", "parquet.writer.version": "v2"}
    with shuffles_removed(session):
        ranged.mapInArrow(_merged(names), schema).write.mode("errorifexists").options(**options).parquet(path)


def write_sorted(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a table whose columns are a key, id and, for postings, tf and positions, in ranges of (key, id)."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    with staged(packed(rows)) as blocks:
        write_ranges(blocks, schema, path, partitions)
