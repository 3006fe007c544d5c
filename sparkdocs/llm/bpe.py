"""BPE by a tokenization automaton: merges compiled one by one, words read by table, labels emitted."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sparkdocs.llm.packing import _L, _N, _S, byte_letters
from sparkdocs.llm.quality import free_name

SUFFIX = "</w>"
# Words whose ids a task remembers.
KNOWN_WORDS = 150_000
_BEYOND = re.compile("[^\\u0000-\\u052f]")
# The pre-split of the tokenizer file, for lower-case texts of code points below U+0530.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Automaton:
    """Deterministic automaton over tokens. A state is the token read last; `allows` is the arc table.

    Bit r of a row says that its tokens may follow the token of state r; tokens with equal rows share one.
    Only tokens that do not end a word have a state.
    """

    def __init__(self, labels: list[str], ids: list[int], state: np.ndarray, allows: np.ndarray):
        self.labels, self.ids, self.state = labels, ids, state.tolist()
        self.width = allows.shape[1]
        rows: dict[bytes, int] = {}
        self.row = [rows.setdefault(r.tobytes(), len(rows) * self.width) for r in allows]
        self.packed = zlib.compress(b"".join(rows), 1)

    def open(self) -> None:
        """Unpack the arc table and lay the labels out as a table of letter transitions."""
        if self.packed is None:  # a later task of the same worker
            return
        self.bits, self.packed = zlib.decompress(self.packed), None
        self.step: dict[int, int] = {}  # by node and letter
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        for t, label in enumerate(self.labels):
            last = label.endswith(SUFFIX)
            node = 0
            for c in label[: -len(SUFFIX)] if last else label:
                key = node << 9 | ord(c)
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = nxt
            (self.final if last else self.inner)[node] = t

    def read(self, word: str) -> list[int]:
        """Ids of the one path that spells `word` (byte letters, not empty) and ends a word."""
        n = len(word)
        letters = list(map(ord, word))
        reached = [-1] * (n + 1)  # token that ends at each place on the way
        origin = [0] * (n + 1)
        step, inner, final, bits, row, state = self.step, self.inner, self.final, self.bits, self.row, self.state
        for i in range(n):
            t = reached[i]
            if i and t < 0:
                continue
            r = state[t] if i else 0
            at, mask = r >> 3, 1 << (r & 7)
            node = 0
            for j in range(i, n):
                node = step.get(node << 9 | letters[j])
                if node is None:
                    break
                u = final[node] if j == n - 1 else inner[node]
                if u >= 0 and (not i or bits[row[u] + at] & mask):
                    reached[j + 1] = u
                    origin[j + 1] = i
        out = []
        while n:
            out.append(self.ids[reached[n]])
            n = origin[n]
        return out[::-1]


def compile_merges(vocab: dict[str, int], merges: list) -> Automaton:
    """Automaton of the token sequences that the merges, applied in their order, leave.

    At first every letter may follow every letter. The gadget of a merge u v -> w: wherever u may be
    read, so may w; what may follow w is what may follow v; and v no longer follows u. For u = v the run
    is merged from the left, so w does not follow a lone u either. All arcs of a token lead to one state,
    so a gadget copies one row and one column of the table. The size is bounded by the vocabulary.
    """
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
    made = {u + v for u, v in pairs}
    labels = [t for t in vocab if t not in made]
    index = {t: i for i, t in enumerate(labels)}
    for u, v in pairs:
        index[u + v] = len(labels)
        labels.append(u + v)
    inner = [not t.endswith(SUFFIX) for t in labels]
    state = np.full(len(labels), -1)
    state[np.flatnonzero(inner)] = np.arange(sum(inner))
    allows = np.zeros((len(labels), -(-sum(inner) // 8)), np.uint8)
    letters = len(labels) - len(pairs)
    for r in state[:letters][state[:letters] >= 0]:
        allows[:letters, r >> 3] |= np.uint8(1 << (r & 7))
    for w, (u, v) in enumerate(pairs, letters):
        u, v = index[u], index[v]
        ru = int(state[u])
        off = np.uint8(255 - (1 << (ru & 7)))
        if not allows[v, ru >> 3] >> (ru & 7) & 1:
            continue  # an earlier merge always takes u or v away: w is never read
        allows[w] = allows[u]
        if state[w] >= 0:
            rv, rw = int(state[v]), int(state[w])
            copied = (allows[: w + 1, rv >> 3] >> np.uint8(rv & 7)) & np.uint8(1)
            allows[: w + 1, rw >> 3] |= copied << np.uint8(rw & 7)
        allows[v, ru >> 3] &= off
        if u == v:
            allows[w, ru >> 3] &= off
    return Automaton(labels, [vocab[t] for t in labels], state, allows)


class WordIds(dict):
    """Ids of a word as bytes, read by the automaton and remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = np.array(self.automaton.read(spelled), np.int32).tobytes()
        if len(self) < KNOWN_WORDS:
            self[word] = ids
        return ids


class WordEncoder:
    """Texts to token ids: special tokens cut out, text normalised and pre-split, words read by the automaton."""

    def __init__(self, model: str, automaton: Automaton):
        self.model = model
        self.library: tokenizers.Tokenizer | None = None  # its normalizer and pre-split, for other scripts
        automaton.open()
        self.automaton = automaton
        self.words = WordIds(automaton)
        self.special = {t["content"]: t["id"] for t in json.loads(model)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as int32 bytes."""
        out = []
        for part in self.cut.split(text) if text and "<|" in text else [text or ""]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            # The library lowers letter by letter, so a final sigma is like any other.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if _BEYOND.search(plain) or _BEYOND.search(part):
                self.library = self.library or tokenizers.Tokenizer.from_str(self.model)
                normal = self.library.normalizer.normalize_str(part)
                for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    out.append(np.array(self.automaton.read(letters), np.int32).tobytes())
            else:
                out.extend(map(self.words.__getitem__, WORD.findall(plain)))
        return b"".join(out)


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _extended(df: DataFrame, name: str, kind) -> StructType:
    return StructType([StructField("row", df.schema["row"].dataType), StructField(name, kind)])


def encode(docs: DataFrame, model: str, name: str = "ids") -> DataFrame:
    """`docs` with an array of token ids of each whole text; a null text is empty.

    `model` is the tokenizer's JSON text. The automaton is compiled once on the driver from the merges
    and broadcast; its size depends on the vocabulary alone. The result is that of the tokenizer without
    special tokens added; their strings in a text become their ids.
    """
    spec = json.loads(model)["model"]
    automaton = compile_merges(spec["vocab"], spec["merges"])
    shared = docs.sparkSession.sparkContext.broadcast((model, automaton))

    def run(batches):
        encoder = WordEncoder(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = _lists([encoder.encode(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["row", "out"])

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")
    )
    out = rows.mapInArrow(run, _extended(rows, "out", ArrayType(IntegerType())))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("out").alias(free_name(docs, name)))


def decode(rows: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`rows` with the labels of the token ids in order, joined by spaces; null ids give null.

    The tokenizer file names no decoder, so this is the library's decode with special tokens kept. Ids
    that are not in the vocabulary are passed over.
    """
    spec = json.loads(model)
    label = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    table = [label.get(i) for i in range(max(label) + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        labels = pa.array(shared.value, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                cells = part.column(1).cast(pa.list_(pa.int64()))
                ids = pc.list_flatten(cells)
                known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(labels)))
                told = labels.take(pc.if_else(known, ids, None))
                sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                if told.null_count:  # ids out of the vocabulary
                    lists = pa.ListArray.from_arrays(offsets, told).to_pylist()
                    joined = pa.array([" ".join([x for x in cell if x is not None]) for cell in lists], pa.string())
                else:
                    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, told), " ")
                texts = pc.if_else(pc.is_valid(cells), joined, None)
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["row", "out"])

    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(ids).alias("ids"))
    out = held.mapInArrow(run, _extended(held, "out", StringType()))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], F.col("out").alias(free_name(rows, name)))
