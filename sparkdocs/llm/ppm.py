"""Language-model scoring by prediction by partial matching over bytes, with a word-count baseline."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sparkdocs.llm.common import ascii_words, task_count
from sparkdocs.session import fresh_dir

# Bytes of context, text bytes that share one table of terms while they are scored, and text bytes whose
# grams a task spells out at a time (a single longer text goes alone).
DEPTH = 5
BLOCK_BYTES = 32_000_000
SLICE_BYTES = 250_000
ROW_BYTES = 64
# Distinct grams of slices that wait to be added to those of their block, rows that a task sends on at a time, and
# terms with values that a task holds to pack them by block.
PENDING_GRAMS = 300_000
SENT_ROWS = 100_000
PACKED_TERMS = 500_000

_END = b"\n"  # after every text, and before it as often as the context is deep


def stage(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again; grams are many, so they are packed harder than by default."""
    path = fresh_dir(df.sparkSession, "ppm")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mask(size: int) -> int:
    return (1 << (8 * size)) - 1


def grams(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every predicted byte with its context as one number, and how many each text has.

    A text is its words, each followed by a space, and an end. Context bytes stand above the predicted
    one, so a shift by 8 bits gives the trie node of the context and a mask its suffixes. `depth` is 7 at
    most.
    """
    bodies = [b" ".join([*w, _END]) for w in texts]
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join([_END * depth + b for b in bodies]), np.uint8).astype(np.uint64)
    acc = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        acc <<= np.uint64(8)
        acc |= data[i : len(data) - depth + i]
    keep = np.ones(len(acc), bool)
    starts = np.cumsum(sizes + depth)[:-1]  # of the padding of all texts but the first
    for i in range(depth):
        keep[starts - depth + i] = False
    return acc[keep].view(np.int64), sizes


class _Block:
    """Grams and words of one block with their counts in training texts, 0 for those of other texts."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth = number, depth
        # Sorted grams with their counts, and those of slices that wait to be added; a block's counts fit 32 bits.
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.train, self.other = Counter(), set()

    def add(self, use: list, texts: list) -> None:
        split = [ascii_words(t) for t in texts]
        keys, sizes = grams(split, self.depth)
        train = np.repeat(np.array(use, bool), sizes)
        for part, counts in ((keys[train], True), (keys[~train], False)):
            if len(part):
                uniq, n = np.unique(part, return_counts=True)
                self.pending.append((uniq, n.astype(np.int32) if counts else np.zeros(len(uniq), np.int32)))
        if sum(len(g[0]) for g in self.pending) > PENDING_GRAMS:
            self._merge()
        for words, learned in zip(split, use):
            words.append(b"")
            self.train.update(words) if learned else self.other.update(words)

    def _merge(self) -> None:
        """Add what waits; only the waiting grams are sorted, the block's own are copied once."""
        if not self.pending:
            return
        keys, n = (np.concatenate(x) for x in zip(*self.pending))
        self.pending = []
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
        keys, n = keys[first], np.add.reduceat(n, first)
        del order, first
        at = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        held[inside] = self.keys[at[inside]] == keys[inside]
        self.n[at[held]] += n[held]
        at = at[~held]
        self.keys = np.insert(self.keys, at, keys[~held])
        self.n = np.insert(self.n, at, n[~held])

    def rows(self):
        names = ["block", "gram", "word", "n"]
        self._merge()
        for i in range(0, len(self.keys), SENT_ROWS):
            part = self.keys[i : i + SENT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), self.number)), pa.array(part), pa.nulls(len(part), pa.binary()),
                    pa.array(self.n[i : i + SENT_ROWS].astype(np.int64)),
                ],
                names,
            )
        self.keys, self.n = self.keys[:0].copy(), self.n[:0].copy()
        words = chain(self.train.items(), ((w, 0) for w in self.other if w not in self.train))
        while part := list(islice(words, SENT_ROWS)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), self.number)), pa.array(np.zeros(len(part), np.int64)),
                    pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64()),
                ],
                names,
            )


def _blocks(batches):
    """(block, part) of a partition's rows in order: a new block begins where BLOCK_BYTES would be passed.

    Every row counts some bytes besides its text. Blocks follow the rows alone, however they are batched;
    the number holds the partition, so rows of different partitions do not share a block.
    """
    block, held = None, 0
    for batch in batches:
        if block is None and batch.num_rows:
            block = batch.column("part")[0].as_py() << 32
        start = part = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            full = held and held + size + ROW_BYTES > BLOCK_BYTES
            if i > start and (full or part + size > SLICE_BYTES):
                yield block, batch.slice(start, i - start)
                start, part = i, 0
            if full:
                block, held = block + 1, 0
            held += size + ROW_BYTES
            part += size
        if start < batch.num_rows:
            yield block, batch.slice(start)


def _count(depth: int):
    def run(batches):
        block = None
        for number, part in _blocks(batches):
            if block is None or number != block.number:
                if block is not None:
                    yield from block.rows()
                block = _Block(number, depth)
            block.add(part.column("train").to_pylist(), part.column("text").to_pylist())
        if block is not None:
            yield from block.rows()
        pa.default_memory_pool().release_unused()

    return run


_PACKED = ["block", "kind", "n", "size", "data"]


def _pack(numbers: np.ndarray, rest: bytes) -> tuple[int, int, bytes]:
    """(n, size, data): n numbers of 8 bytes and the bytes behind them, compressed from `size` bytes."""
    raw = numbers.tobytes() + rest
    return len(numbers), len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack(n: int, size: int, data: bytes, dtype) -> tuple[np.ndarray, bytes]:
    raw = pa.decompress(data, size, "zstd", asbytes=True)
    return np.frombuffer(raw, dtype, n), raw[8 * n :]


def _packed_rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _PACKED)


def _packed_terms(batches):
    """Terms with values, packed by block: grams (kind 0) as steps from one to the next, words (1) with spaces between."""

    def pack(held):
        table = pa.Table.from_batches(held)
        name = "gram" if "gram" in table.column_names else "word"
        blocks, values = table.column("block").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        terms = table.column(name).to_numpy() if name == "gram" else table.column(name).combine_chunks()
        rows = []
        for group in np.split(order, cuts):
            for i in range(0, len(group), SENT_ROWS):
                at = group[i : i + SENT_ROWS]
                if name == "gram":
                    kind, rest = 0, np.diff(terms[at], prepend=0).tobytes()
                else:
                    listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), terms.take(pa.array(at)))
                    kind, rest = 1, pc.binary_join(listed, b" ")[0].as_py()
                rows.append((int(blocks[at[0]]), kind, *_pack(values[at], rest)))
        return _packed_rows(rows)

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= PACKED_TERMS:
            yield pack(held)
            held, count = [], 0
    if held:
        yield pack(held)


def _packed_texts(batches):
    """Texts (kind 2) with the block that `_count` gave their terms to, a slice packed as one, with its `rows`."""
    for number, part in _blocks(batches):
        texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        packed = _packed_rows([(number, 2, *_pack(np.array([len(t) for t in texts], np.int64), b"".join(texts)))])
        row = part.column("row")
        rows = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
        yield pa.RecordBatch.from_arrays([*packed.columns, rows], [*_PACKED, "rows"])


class GramTable:
    """Values by gram: one probe into a hashed table, a search among the few whose slot another gram took."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if not len(keys):
            keys, values = np.full(1, -1, np.int64), np.zeros(1)
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(8, len(keys).bit_length() + 1))
        slot = self._slot(keys)
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        own = np.arange(len(keys), dtype=np.int32)
        self.slots[slot] = own
        lost = np.flatnonzero(self.slots[slot] != own)
        self.lost = lost[np.argsort(keys[lost])].astype(np.int32)
        self.lost_keys = keys[self.lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of grams that are all in the table; another one is an error."""
        at = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            place = np.searchsorted(self.lost_keys, keys[miss])
            if not len(self.lost) or not np.array_equal(self.lost_keys.take(place, mode="clip"), keys[miss]):
                raise KeyError("a gram is not among the terms of its block")
            at[miss] = self.lost[place]
        return self.values[at]


def _score(depth: int, unknown: float):
    """Packed rows sorted by block and kind: grams of a block (0), its words (1), then its texts (2) one slice after another."""

    def run(batches):
        block, table, words, keys, values = None, None, {}, [], []
        for batch in batches:
            columns = [batch.column(c) for c in _PACKED]
            for i in range(batch.num_rows):
                number, kind, n, size, data = (c[i].as_py() for c in columns)
                if number != block:
                    block, table, words, keys, values = number, None, {}, [], []
                    pa.default_memory_pool().release_unused()
                if kind == 0:
                    value, steps = _unpack(n, size, data, np.float64)
                    keys.append(np.cumsum(np.frombuffer(steps, np.int64)))
                    values.append(value)
                elif kind == 1:
                    value, joined = _unpack(n, size, data, np.float64)
                    words.update(zip(joined.split(b" "), value.tolist()))
                else:
                    if table is None:
                        # Each list goes before the next copy is made.
                        keys = np.concatenate(keys or [np.zeros(0, np.int64)])
                        values = np.concatenate(values or [np.zeros(0)])
                        table = GramTable(keys, values)
                        keys, values = [], []
                    sizes, joined = _unpack(n, size, data, np.int64)
                    ends = np.cumsum(sizes)
                    texts = [joined[e - k : e].lower().split() for e, k in zip(ends.tolist(), sizes.tolist())]
                    yield score(batch.column("rows").slice(i, 1).flatten(), texts, table, words)

    def score(rows, texts, table, value_of):
        found, sizes = grams(texts, depth)
        model = np.add.reduceat(table.get(found), np.cumsum(sizes) - sizes)
        base, known = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, words in enumerate(texts):
            words.append(b"")
            each = np.fromiter(map(value_of.__getitem__, words), np.float64, len(words))
            base[i] = each.sum()
            known[i] = (each > unknown).sum()
        return pa.RecordBatch.from_arrays(
            [rows, pa.array([len(w) for w in texts], pa.int64()), pa.array(known), pa.array(base), pa.array(model)],
            ["row", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def code_lengths(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, logp): log10 probability of the last byte of each gram after the bytes before it.

    `counted` has distinct grams of depth + 1 bytes with their training counts n, 0 for grams that only
    other texts have. The trie is one table per level: for each context its total N, its number of
    distinct bytes D, and the share of those bytes in the counts of the next shorter context. A byte seen
    n times has probability (2 n - 1) / 2 N. One that a context has not seen escapes with D / 2 N to the
    next shorter context, where the bytes seen above are taken out of N and D; below the empty context all
    bytes left are equally likely. A context never seen, or with no byte left, is skipped without cost.
    Grams seen in full need one join; the others go down level by level.
    """
    trained = counted.filter("n > 0")
    levels = {depth: trained}
    for j in range(depth - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(_mask(j + 1))).alias("gram")
        levels[j] = stage(levels[j + 1].groupBy(shorter).agg(F.sum("n").alias("n")))
    context = {}
    for j in range(depth, -1, -1):
        if j:
            shorter = levels[j - 1].select(F.col("gram").alias("short"), F.col("n").alias("short_n"))
            below = levels[j].join(shorter, F.col("gram").bitwiseAND(F.lit(_mask(j))) == F.col("short"))
        else:
            below = levels[0].withColumn("short_n", F.lit(0).cast("long"))
        context[j] = below.groupBy(F.shiftrightunsigned("gram", 8).alias("node")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("short_n").alias("shared")
        )
    whole = trained.groupBy(F.shiftrightunsigned("gram", 8).alias("node")).agg(F.sum("n").alias("total"))
    seen = trained.join(whole, F.shiftrightunsigned("gram", 8) == F.col("node")).select(
        "gram", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("logp")
    )
    zero = F.lit(0).cast("long")
    # above_d, above_n: distinct bytes of the longer context, and their counts in this one.
    left = counted.filter("n = 0").select("gram", F.lit(0.0).alias("logp"), zero.alias("above_d"), zero.alias("above_n"))
    done = seen
    for j in range(depth, -1, -1):
        node = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(_mask(j)))
        here = levels[j].select(F.col("gram").alias("own"), F.col("n").alias("own_n"))
        step = stage(
            left.join(context[j], node == F.col("node"), "left")
            .join(here, F.col("gram").bitwiseAND(F.lit(_mask(j + 1))) == F.col("own"), "left")
            .withColumn("more", F.coalesce(F.col("distinct") - F.col("above_d"), zero))
            .withColumn("room", 2 * F.coalesce(F.col("total") - F.col("above_n"), zero))
            .select("gram", "logp", "distinct", "shared", "own_n", "more", "room")
        )
        found = F.col("logp") + F.log10((2 * F.col("own_n") - 1) / F.col("room"))
        done = done.union(step.filter("own_n IS NOT NULL").select("gram", found))
        escape = F.when(F.col("more") > 0, F.log10(F.col("more") / F.col("room"))).otherwise(0.0)
        left = step.filter("own_n IS NULL").select(
            "gram", (F.col("logp") + escape).alias("logp"),
            F.coalesce("distinct", zero).alias("above_d"), F.coalesce("shared", zero).alias("above_n"),
        )
    return done.union(left.select("gram", F.col("logp") - F.log10(F.lit(256.0) - F.col("above_d"))))


def score_texts(
    docs: DataFrame, held_out: Column, keep: list[str], depth: int = DEPTH, plain_scan: bool = False
) -> DataFrame:
    """`keep` columns of every row of `docs` with n_tokens, n_known, train_tokens, base_score and score.

    Words are split at ASCII white space with A-Z in lower case; a text is its words and one end, a null
    text the end alone. Rows where `held_out` is false or null are learned from, all rows are scored.
    score is the log10 probability of the text's bytes, a space after each word, under the byte model of
    `code_lengths`; base_score sums log10((c + 1) / (N + V + 1)) over the tokens, with c, N and V from the
    training tokens.

    Repeated rows are counted and scored each. The id is not looked at, so it may be null or repeat; an
    empty table gives no rows. Extra columns may have any name.

    The rows of a partition are cut into blocks of BLOCK_BYTES. Each block gives its distinct grams and
    words with their counts; counts are added up over all blocks, each distinct gram is evaluated once, and
    every block gets back the values of its own terms, packed and sorted before its texts. So no task holds the whole model,
    and what moves grows with the input. Blocks follow the place of a row, so the rows are written once; with
    `plain_scan` they are read twice instead, which is right for rows that come straight from files. A row
    that changed its block raises an error, for a word as for a gram.
    """
    text = F.col("text").cast("string")
    source = docs.select(
        F.coalesce(~held_out, F.lit(True)).alias("train"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
    )
    # The number of the scan's own partition, whatever plan the scan is part of.
    source = (source if plain_scan else stage(source)).withColumn("part", F.spark_partition_id())
    terms = stage(source.select("part", "train", "text").mapInArrow(_count(depth), "block long, gram long, word binary, n long"))
    counted = stage(terms.filter("word IS NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    words = stage(terms.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    value = F.log10(F.col("n") + 1.0) - F.log10(F.lit(float(n + v + 1)))
    logp = code_lengths(counted, depth).withColumnRenamed("logp", "value")
    gram_rows = terms.filter("word IS NULL").select("block", "gram").join(logp, "gram")
    word_rows = terms.filter("word IS NOT NULL").select("block", "word").join(words.select("word", value.alias("value")), "word")
    row = StructField("row", source.schema["row"].dataType)
    # What goes to a block is packed in the tasks that make it: a row per term would take several times its bytes.
    packed = "block long, kind int, n long, size long, data binary"
    rows = StructField("rows", ArrayType(row.dataType))
    texts = source.select("part", "text", "row").mapInArrow(_packed_texts, StructType([*StructType.fromDDL(packed), rows]))
    both = texts
    for each in (gram_rows.select("block", "gram", "value"), word_rows.select("block", "word", "value")):
        both = both.union(each.mapInArrow(_packed_terms, packed).withColumn("rows", F.lit(None).cast(rows.dataType)))
    out = StructType([
        row, StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ])
    # Half a count above the value of an unknown word parts it from the rarest known one.
    unknown = math.log10(1.5) - math.log10(n + v + 1)
    sorted_rows = both.repartition(task_count(both), "block").sortWithinPartitions("block", "kind")
    scored = sorted_rows.mapInArrow(_score(depth, unknown), out)
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
