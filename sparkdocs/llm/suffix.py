"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

An array of all suffixes would need sixteen bytes and more for every byte of text. The arrays here are
sparse: each window of LENGTH bytes names one of its GRAM-byte strings, the one with the least hash, and
a suffix is kept where some window names it. Equal windows name the same place, so no repeat is lost. An
entry stands for all windows that name its suffix, and an array is sorted by the fingerprint of the gram
and then by that of the whole stretch of those windows; a repeat is an equal key, so the order of the
bytes themselves is not needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.llm.common import task_count
from sparkdocs.operators.sizes import number_rows
from sparkdocs.session import stage

LENGTH = 100
GRAM = 32
# Batches that a corpus is indexed in, one after another.
BATCHES = 4
# Text bytes whose hashes a task holds at a time; a longer text goes in pieces.
SLICE_BYTES = 1 << 21
# Stretches of one gram whose windows are compared in a task; those of a more frequent one meet by shuffle.
HOT_STRETCHES = 8_192

_WINDOW = LENGTH - GRAM + 1  # grams of a window
_BASE = 0x9E3779B97F4A7C15
_PLACE = 7  # bits of an offset below _WINDOW
_ENTRY = "gram long, span long, doc long, place long"


class _Hasher:
    """Polynomial hashes of any stretch of a byte array from one running sum, modulo 2^64."""

    powers: tuple[np.ndarray, np.ndarray] | None = None
    letters = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        if _Hasher.powers is None or len(_Hasher.powers[0]) < len(data) + 1:
            size = max(len(data) + 1, SLICE_BYTES + 2 * LENGTH)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _Hasher.powers = np.cumprod(up), np.cumprod(down)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * _Hasher.powers[0][: len(data)], out=self.sums[1:])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return self.mixed((self.sums[start + length] - self.sums[start]) * _Hasher.powers[1][start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return self.mixed((self.sums[length:] - self.sums[:-length]) * _Hasher.powers[1][:n])


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, stretch hash, place of the gram, first window, last window) of every entry.

    `data` holds texts one after another that stop at `ends`. Of equal least hashes in a window the last
    one counts.
    """
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none
    hasher = _Hasher(data)
    grams = hasher.all(GRAM)
    bits = np.uint64(max(1, len(grams).bit_length()))
    # The hash above, the place below: later places are smaller.
    least = (grams >> bits << bits) | (np.uint64(len(grams)) - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while 2 * width <= _WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n], least[_WINDOW - width :][:n])
    sizes = np.diff(ends, prepend=0)
    whole = np.arange(n) + LENGTH <= np.repeat(ends, sizes)[:n]
    change = least[1:] != least[:-1]
    lo = np.flatnonzero(whole & np.concatenate(([True], change | ~whole[:-1])))
    hi = np.flatnonzero(whole & np.concatenate((change | ~whole[1:], [True])))
    place = (np.uint64(len(grams)) - (least[lo] & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    span = hasher.at(lo, hi - lo + LENGTH) ^ hasher.mixed((place - lo).astype(np.uint64))
    return grams[place], span, place, lo, hi


def _pieces(batch):
    """(documents, place of the first one's piece in its text, bytes, ends) of an Arrow batch of (doc, text)."""
    docs, column = batch.column(0).to_numpy(), batch.column(1)
    # A null text takes no bytes.
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + SLICE_BYTES, "right")) - 1)
        if cut[b] - cut[a] <= SLICE_BYTES:
            yield docs[a:b], 0, data[cut[a] : cut[b]], cut[a + 1 : b + 1] - cut[a]
        else:
            for start in range(0, int(cut[b] - cut[a]), SLICE_BYTES):
                part = data[cut[a] + start : min(cut[a] + start + SLICE_BYTES + LENGTH - 1, cut[b])]
                yield docs[a:b], start, part, np.array([len(part)])
        a = b


def _entries(batches):
    """Entries of the texts. Of equal stretches in one slice the earliest goes on; the others are copies."""
    for batch in batches:
        for docs, start, data, ends in _pieces(batch):
            gram, span, place, lo, hi = stretches(data, ends)
            which = np.searchsorted(ends, lo, "right")
            first = np.concatenate(([0], ends[:-1]))[which]
            doc = docs[which]
            packed = (start + place - first) << (2 * _PLACE) | (place - lo) << _PLACE | (hi - lo)
            order = np.lexsort((packed, doc, span, gram))
            gram, span, doc, packed = gram[order].view(np.int64), span[order].view(np.int64), doc[order], packed[order]
            copy = np.zeros(len(order), bool)
            copy[1:] = (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])
            # Copies are settled: a key of their own spreads them.
            gram = np.where(copy, _Hasher.mixed(doc.view(np.uint64) * np.uint64(_BASE) + packed.view(np.uint64)).view(np.int64), gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram, span, doc, packed, copy)], ["gram", "span", "doc", "place", "copy"]
            )


def _shared(batches):
    """Rows of a stream sorted by gram whose gram another row has too, and all copies."""
    names = ["gram", "span", "doc", "place", "copy"]
    held, before = None, None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        same = gram[1:] == gram[:-1]
        head = before is not None and gram[0] == before
        keep = np.concatenate(([head], same)) | np.concatenate((same, [False])) | batch.column(4).to_numpy(zero_copy_only=False)
        # The last row waits for its successor.
        held, before = batch.slice(batch.num_rows - 1), gram[-2] if len(gram) > 1 else before
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).rename_columns(names)
        last = bool(keep[-1])
    if held is not None:
        yield held.filter(pa.array([last])).rename_columns(names)


class IndexFamily:
    """Arrays of distinct stretches, each level twice the size of the one before.

    A batch's array is scanned against every level and then becomes a level itself; two levels of equal
    size merge into the next. Batches must come in the order of their documents.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (merges, array), largest first

    def add(self, array: DataFrame) -> DataFrame:
        """Index an array of entries; its rows that repeat an indexed or earlier stretch as a whole."""
        array = array.select("gram", "span", "doc", "place")
        first = array.groupBy("gram", "span").agg(F.min(F.struct("doc", "place")).alias("at"))
        for _, level in self.levels:
            first = first.join(level.select("gram", "span"), ["gram", "span"], "left_anti")
        fresh = self._sorted(first.select("gram", "span", "at.doc", "at.place"))
        merges = 0
        level = fresh
        while self.levels and self.levels[-1][0] == merges:
            level = self._sorted(self.levels.pop()[1].union(level))
            merges += 1
        self.levels.append((merges, level))
        return array.join(fresh, ["gram", "span", "doc", "place"], "left_anti")

    @staticmethod
    def _sorted(array: DataFrame) -> DataFrame:
        return stage(array.repartition(task_count(array), "gram").sortWithinPartitions("gram", "span"))

    def entries(self) -> DataFrame:
        found = self.levels[0][1]
        for _, level in self.levels[1:]:
            found = found.union(level)
        return found


def _bytes_of(batches):
    """The bytes of each entry's stretch; for a frequent gram the hash of each of its windows instead."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for text, doc, items in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.as_py()
            for item in items:
                place, back, more = item["place"] >> 2 * _PLACE, item["place"] >> _PLACE & 127, item["place"] & 127
                lo = place - back
                part = data[lo : lo + more + LENGTH]
                if not item["hot"]:
                    _append(out, item["gram"], doc, lo, part, None)
                else:
                    windows = _Hasher(np.frombuffer(part, np.uint8)).all(LENGTH).view(np.int64)
                    for i, h in enumerate(windows.tolist()):
                        _append(out, item["gram"], doc, lo + i, None, h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
            ["gram", "doc", "lo", "bytes", "window"],
        )


def _append(columns: tuple[list, ...], *values) -> None:
    for column, value in zip(columns, values):
        column.append(value)


def _later_windows(batches):
    """Runs of windows that an earlier row of the same gram holds too; rows come by gram, document and place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        gram = batch.column(0).to_numpy()
        if not len(gram):
            continue
        cut = int(np.searchsorted(gram, gram[-1]))  # rows of the last gram may go on
        if cut or (held and held[-1].column(0)[0].as_py() != gram[0]):
            yield from _compare([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    yield from _compare(held)


def _compare(parts: list[pa.RecordBatch]):
    if not sum(p.num_rows for p in parts):
        return
    table = pa.Table.from_batches(parts)
    gram, doc, lo = (table.column(c).to_numpy() for c in ("gram", "doc", "lo"))
    cells = table.column("bytes").to_pylist()
    size = np.array([len(c) for c in cells])
    for a, b in _chunks(gram, size):
        hasher = _Hasher(np.frombuffer(b"".join(cells[a:b]), np.uint8))
        count = size[a:b] - LENGTH + 1
        row = np.repeat(np.arange(a, b), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(size[a:b]) - size[a:b], count) + inside
        key = hasher.at(start, LENGTH) ^ hasher.mixed(gram[row].view(np.uint64))
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(row), bool)
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = row[1:] != row[:-1]
        begins = np.flatnonzero(later & (edge[:-1] | ~np.concatenate(([False], later[:-1]))))
        stops = np.flatnonzero(later & (edge[1:] | ~np.concatenate((later[1:], [False]))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row[begins]]), pa.array(lo[row[begins]] + inside[begins]), pa.array(lo[row[begins]] + inside[stops])],
            ["doc", "lo", "hi"],
        )


def _chunks(gram: np.ndarray, size: np.ndarray):
    """Ranges of rows of about SLICE_BYTES that do not cut a gram."""
    starts = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1))
    total = np.concatenate(([0], np.cumsum(size)))
    a = 0
    for i, s in enumerate(starts.tolist()):
        end = int(starts[i + 1]) if i + 1 < len(starts) else len(gram)
        if total[end] - total[a] > SLICE_BYTES // 4 and s > a:
            yield a, s
            a = s
    yield a, len(gram)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the byte runs that windows lo..hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.concatenate(([True], lo[1:] > end[:-1]))
    return lo[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def _cut(batches):
    """Removed spans and kept bytes of every text."""
    for batch in batches:
        spans, kept = [], []
        for text, runs in zip(batch.column(1), batch.column(2)):
            data = text.as_py() or b""
            if not runs.is_valid or not len(runs.values):
                spans.append([])
                kept.append(data)
                continue
            start, end = _merged(*(runs.values.field(i).to_numpy() for i in (0, 1)))
            spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["row", "spans", "kept"],
        )


def repeated_windows(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, lo, hi): runs of window starts whose LENGTH bytes start earlier too, for (doc, text) with unique doc."""
    spread = texts.select("doc", "text").mapInArrow(_entries, _ENTRY + ", copy boolean")
    spread = spread.repartition(task_count(texts), "gram").sortWithinPartitions("gram", "span")
    borders = texts.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum(((F.col("doc") > F.lit(int(b))).cast("int") for b in borders), F.lit(0))
    # Suffixes whose gram occurs once in the corpus cannot repeat and are left out of the arrays.
    arrays = stage(spread.mapInArrow(_shared, _ENTRY + ", copy boolean").withColumn("batch", batch), partition_by="batch")
    copies = arrays.filter("copy").select("doc", "place")
    family = IndexFamily()
    for i in range(len(borders) + 1):
        copies = copies.union(family.add(arrays.filter((F.col("batch") == i) & ~F.col("copy"))).select("doc", "place"))
    lo = F.shiftright("place", 2 * _PLACE) - F.shiftright("place", _PLACE).bitwiseAND(F.lit(127))
    whole = copies.select("doc", lo.alias("lo"), (lo + F.col("place").bitwiseAND(F.lit(127))).alias("hi"))
    # Stretches of one gram that differ may still share windows.
    fresh = family.entries()
    several = fresh.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    parts = fresh.join(several, "gram").select("doc", F.struct("gram", "place", (F.col("n") > HOT_STRETCHES).alias("hot")).alias("item"))
    wanted = parts.groupBy("doc").agg(F.collect_list("item").alias("items"))
    cut = stage(
        texts.join(wanted, "doc").select("text", "doc", "items")
        .mapInArrow(_bytes_of, "gram long, doc long, lo long, bytes binary, window long")
    )
    met = cut.filter("bytes IS NOT NULL").select("gram", "doc", "lo", "bytes").repartition(task_count(texts), "gram")
    runs = met.sortWithinPartitions("gram", "doc", "lo").mapInArrow(_later_windows, "doc long, lo long, hi long")
    hot = cut.filter("window IS NOT NULL").select("gram", "window", "doc", "lo")
    first = hot.groupBy("gram", "window").agg(F.min(F.struct("doc", "lo")).alias("at"))
    later = hot.join(first, ["gram", "window"]).filter(F.struct("doc", "lo") != F.col("at"))
    return whole.union(runs).union(later.select("doc", "lo", F.col("lo").alias("hi")))


def remove_repeats(docs: DataFrame, keep: list[str], batches: int = BATCHES) -> DataFrame:
    """`keep` columns of every row of `docs`, with `spans` that were removed and the `kept` bytes.

    A byte of the UTF-8 text goes if it lies in a string of LENGTH bytes that also starts earlier: in a
    smaller doc_id, or earlier in the same document. Strings are judged on the input; spans are maximal
    runs of removed bytes as (start, end).

    A null text is an empty one and stays empty, texts below LENGTH bytes are kept. A null doc_id comes
    first. Rows that share an id but not the text come by the digest of their text; rows that repeat both
    are one document, and each gets its result. An empty table gives no rows. Further columns may have any
    name.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").cast("long").alias("doc"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    ids = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1 OR doc IS NULL")
    if ids.isEmpty():
        texts = rows.select("doc", "text")
    else:
        rows = rows.withColumnRenamed("doc", "own").withColumn("digest", F.sha2("text", 256))
        numbers = number_rows(rows.select("own", "digest").distinct(), [], [F.asc_nulls_first("own"), F.asc("digest")], name="doc")
        numbers = stage(numbers.select(F.col("own").alias("_own"), F.col("digest").alias("_digest"), F.col("doc").cast("long").alias("doc")))
        same = F.col("own").eqNullSafe(F.col("_own")) & (F.col("digest") == F.col("_digest"))
        rows = rows.join(numbers, same).select("row", "doc", "text")
        # Equal rows have equal texts, so any of them will do.
        texts = rows.groupBy("doc").agg(F.first("text").alias("text"))
    runs = repeated_windows(texts, batches).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    out = rows.join(runs, "doc", "left").select("row", "text", "runs")
    kept = "array<struct<start: long, end: long>>"
    found = out.mapInArrow(_cut, f"row {out.schema['row'].dataType.simpleString()}, spans {kept}, kept binary")
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "spans", "kept")


REPEATS_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS s
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM t)
),
l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
        SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM l)
),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
p AS (
    SELECT s.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER d + 1, 2 * (a - lag(b, 1, 0) OVER d)) AS part
    FROM s JOIN t USING (doc_id) WINDOW d AS (PARTITION BY s.doc_id ORDER BY a)
),
c AS (
    SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last, string_agg(part, '' ORDER BY a) AS parts
    FROM p GROUP BY doc_id
)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(parts || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)
"""
