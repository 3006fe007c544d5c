"""Packing of tokenized documents into fixed sequences: best fit, then local search by swaps and moves."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sparkdocs.llm.common import CACHE_WORDS, groups_of, task_count
from sparkdocs.llm.quality import free_name
from sparkdocs.session import stage

CAPACITY = 1024
END_ID = 2
# Pieces one task packs together, and the emptiest sequences it hands on to the next, smaller round.
GROUP_PIECES = 20_000
HANDED_ON = 64
SLICE_ROWS = 500


def _char_class(kind: str) -> str:
    """Code points of a general category up to the scripts that `split_words` cuts itself."""
    chars = [c for c in range(0x530) if unicodedata.category(chr(c))[0] == kind]
    parts, start = [], None
    for c in chars:
        if start is None or c != last + 1:
            start = c
            parts.append([c, c])
        parts[-1][1] = last = c
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in parts)


_L, _N, _S = _char_class("L"), _char_class("N"), r"\t-\r \x85\xa0"
# The pre-split of byte-level tokenizers, for texts of code points below U+0530.
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_BEYOND = re.compile("[^\\u0000-\\u052f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + moved.index(b)) for b in range(256)]


class WordIds(dict):
    """Ids of a word as little-endian uint32 bytes, remembered up to a bound."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode("utf-8").decode("latin-1").translate(self.letters)
        value = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


class ByteEncoder:
    """Token ids of a text as little-endian uint32 bytes, word by word.

    Texts with other scripts, or with a special token's own string, go to the tokenizer whole.
    """

    def __init__(self, model: str):
        self.tokenizer = tokenizers.Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = WordIds(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if _BEYOND.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, WORD.findall(text)))


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """`docs` without text, one row per piece: struct `piece_` with piece, start, length, ids.

    A document is its token ids and then `end_id`. One longer than `capacity` is cut into pieces of that
    size, of which the first may be shorter; start counts the document's ids before the piece, ids are
    little-endian uint32. A null text is an empty one. `model` is the tokenizer's JSON text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = ByteEncoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows, no, start, ids = [], [], [], []
                for i, text in enumerate(batch.column(1).slice(first, SLICE_ROWS).to_pylist(), first):
                    raw = encoder.encode(text) + tail
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        no.append(k)
                        start.append(a)
                        ids.append(raw[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    ["row", "piece", "start", "length", "ids"],
                )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = StructType([
        StructField("row", rows.schema["row"].dataType), StructField("piece", IntegerType()),
        StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()),
    ])
    name = free_name(docs, "piece_")
    return rows.mapInArrow(run, schema).select(
        *[F.col("row").getField(c).alias(c) for c in others], F.struct("piece", "start", "length", "ids").alias(name)
    )


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        left = room - size
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills; full bins stay as they are.

    The emptiest bin gives: an item moves to another bin, or is exchanged for a smaller one, for two that
    are smaller together, or two of its items for one smaller one; each time the change with the largest
    gain is made. Of two for one, pairs close together in a bin's list come first, all others only where no
    change is found. A bin that can give nothing more is passed. The sum of squares is a rising integer, so
    the search ends; it stops early when all room left is less than one bin.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    part = np.flatnonzero(fill < capacity)
    if len(part) < 2 or capacity * len(part) - fill[part].sum() < capacity:
        return bins
    item = np.array([i for b in part for i in bins[b]])
    home = np.repeat(np.arange(len(part)), [len(bins[b]) for b in part])
    size = sizes[item].astype(np.int64)
    load = fill[part].copy()
    passed = np.zeros(len(part), bool)
    empty = 0
    while capacity * (len(part) - empty) - load.sum() >= capacity:
        open_ = np.flatnonzero(~passed & (load > 0))
        if len(open_) < 2:
            break
        giver = open_[load[open_].argmin()]
        mine = np.flatnonzero(home == giver)
        takers = (np.arange(len(part)) != giver) & (load > 0)
        room = np.where(takers, capacity - load, -1)
        other = home != giver
        best = (0, None)

        def weigh(more, taker, change):
            # Gain in the sum of squares when `more` tokens go from the giver to each taker.
            nonlocal best
            ok = (more > 0) & (more <= room[taker])
            if ok.any():
                gain = np.where(ok, more * (load[taker] - load[giver] + more), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (k, change))

        everywhere = np.arange(len(part))
        theirs = np.flatnonzero(other)
        for x in mine:
            weigh(np.full(len(part), size[x]), everywhere, ("move", x))
            weigh(size[x] - size[theirs], home[theirs], ("one", x))
        if best[1] is None:
            order = theirs[np.argsort(home[theirs], kind="stable")]
            for gap in (1, 2, 3):
                a, b = order[:-gap], order[gap:]
                same = home[a] == home[b]
                a, b = a[same], b[same]
                for x in mine:
                    weigh(size[x] - size[a] - size[b], home[a], ("two", x, a, b))
            for p in range(len(mine)):
                for q in range(p):
                    weigh(size[mine[p]] + size[mine[q]] - size[theirs], home[theirs], ("for", mine[p], mine[q]))
        if best[1] is None:
            # All pairs of a bin, two items of each size being enough; further apart until no bin has such a pair.
            key = home[theirs] * (capacity + 1) + size[theirs]
            by_size = np.argsort(key, kind="stable")
            order, key = theirs[by_size], key[by_size]
            order = order[np.concatenate((np.ones(min(2, len(key)), bool), key[2:] != key[:-2]))]
            kinds = mine[np.unique(size[mine], return_index=True)[1]]
            for gap in range(1, len(order)):
                a, b = order[:-gap], order[gap:]
                same = home[a] == home[b]
                if not same.any():
                    break
                a, b = a[same], b[same]
                for x in kinds:
                    weigh(size[x] - size[a] - size[b], home[a], ("two", x, a, b))
        if best[1] is None:
            passed[giver] = True
            continue
        k, change = best[1]
        if change[0] == "move":
            taker, give, get = k, [change[1]], []
        elif change[0] == "one":
            taker, give, get = home[theirs[k]], [change[1]], [theirs[k]]
        elif change[0] == "two":
            taker, give, get = home[change[2][k]], [change[1]], [change[2][k], change[3][k]]
        else:
            taker, give, get = home[theirs[k]], [change[1], change[2]], [theirs[k]]
        moved = size[give].sum() - (size[get].sum() if get else 0)
        home[give] = taker
        if get:
            home[get] = giver
        load[taker] += moved
        load[giver] -= moved
        passed[taker] = False
        empty += load[giver] == 0
    inside: list[list[int]] = [[] for _ in part]
    for i, h in zip(item.tolist(), home.tolist()):
        inside[h].append(i)
    untouched = set(part.tolist())
    return [b for k, b in enumerate(bins) if k not in untouched] + [b for b in inside if b]


def _pack_group(capacity: int, round_no: int, last: bool):
    def run(batches):
        for table in groups_of(batches, ["pack_group"]):
            sizes = table.column("length").to_numpy()
            bins = local_search(sizes, best_fit(sizes, capacity), capacity)
            fill = np.array([sizes[b].sum() for b in bins])
            hand_on = np.zeros(len(bins), bool)
            if not last:
                low = np.argsort(fill, kind="stable")[:HANDED_ON]
                low = low[fill[low] < capacity]
                # No more than half of the pieces, or short ones would all go on for ever.
                held = np.cumsum([len(bins[k]) for k in low])
                hand_on[low[held <= len(sizes) // 2]] = True
            group = table.column("pack_group")[0].as_py()
            order = np.concatenate([np.array(b) for b in bins])
            which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            ends = np.cumsum(sizes[order])
            offset = ends - sizes[order] - np.repeat(np.cumsum(fill) - fill, [len(b) for b in bins])
            yield from pa.table(
                [
                    table.column("item").take(pa.array(order)), table.column("length").take(pa.array(order)),
                    pa.array((round_no << 56) + (group << 20) + which), pa.array(offset), pa.array(hand_on[which]),
                ],
                ["item", "length", "sequence_id", "offset", "open"],
            ).to_batches()

    return run


def assign(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(item, sequence_id, offset) for rows (item, length) with unique items and 1 <= length <= capacity.

    Items are spread evenly over groups of about `group_pieces`; a task packs a group by best fit and
    local search. The HANDED_ON emptiest sequences of every group are opened again and packed in the next
    round, which has about a hundredth of the items, until one group is left. With very short items it is
    more, but at most half of each group, so the rounds end. Every item is placed.
    """
    held = items.select("item", F.col("length").cast("long").alias("length"))
    out, round_no = None, 0
    while True:
        groups = max(1, -(-held.count() // group_pieces))
        dealt = held.withColumn("pack_group", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)))
        packed = stage(
            dealt.repartition(min(groups, 8 * task_count(held)), "pack_group").sortWithinPartitions("pack_group").mapInArrow(
                _pack_group(capacity, round_no, groups == 1),
                "item long, length long, sequence_id long, offset long, open boolean",
            )
        )
        done = packed.filter("NOT open").select("item", "sequence_id", "offset")
        out = done if out is None else out.unionByName(done)
        if groups == 1:
            return out
        held = packed.filter("open").select("item", "length")
        round_no += 1


def pack_documents(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are placed whole and gapless. Null and empty texts are the end id alone. Rows without or with
    repeated doc_id are packed like others.
    """
    cut = pieces(docs.select("doc_id", "text"), model, capacity, end_id)
    listed = stage(
        cut.select(
            "doc_id", "piece_.piece", "piece_.start", "piece_.length", F.crc32("piece_.ids").alias("ids_crc32"),
            F.monotonically_increasing_id().alias("item"),
        )
    )
    return listed.join(assign(listed, capacity), "item").drop("item")


def tokenizer_text(path: str) -> str:
    """JSON text of a tokenizer file that the driver can read."""
    with open(path, encoding="utf-8") as f:
        return sys.intern(f.read())
