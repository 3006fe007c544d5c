"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels reduced from keyed slot arrays.

No leaf is sorted. The ids of a group are kept as a bitmap of 64-bit words, empty words left out, merged
over all tasks by `bit_or`. A popcount directory gives every word the number of leaves before it, so the
place of a leaf is that number and a count of bits below its own. Sixteen consecutive places share a key;
their digests meet in a slot array and become one node of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocs.operators.sizes import number_rows
from sparkdocs.session import stage

FANOUT = 16
# Words of a directory block (2^9 words of 2^6 ids), and blocks of a larger block above it.
BLOCK_BITS = 9
LARGE_BITS = 12
# Copies of one leaf that a task gives out at a time.
COPY_SLICE = 65_536

_NULL_WORD = -(1 << 60)  # below the word of every 64-bit id: rows without an id come first
_STEP = "struct<pre: string, post: string>"


def field_text(column: Column) -> Column:
    """`-` for a null, else the UTF-8 byte count, `:` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def leaf_hash(columns: list[Column]) -> Column:
    return digest(F.concat(*[field_text(c) for c in columns]))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())


def _popcount(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def bitmap_words(leaves: DataFrame) -> DataFrame:
    """(group, word, bits, n): the bitmap of every group's ids as its words that are not empty; n counts rows."""
    return leaves.groupBy("group", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")
    )


def directory(words: DataFrame) -> DataFrame:
    """Adds `before`, the rows of the group in smaller words, and `total`, all rows of the group.

    Counts are added up inside blocks of words, then inside large blocks, then per group, so that no task
    walks over the words of a whole group.
    """
    keyed = words.withColumn("block", F.shiftright("word", BLOCK_BITS))
    blocks = keyed.groupBy("group", "block").agg(F.sum("n").alias("block_n"))
    blocks = blocks.withColumn("large", F.shiftright("block", LARGE_BITS))
    larges = blocks.groupBy("group", "large").agg(F.sum("block_n").alias("large_n"))
    earlier = Window.unboundedPreceding, -1
    zero = F.lit(0).cast("long")
    larges = larges.select(
        "group", "large",
        F.coalesce(F.sum("large_n").over(Window.partitionBy("group").orderBy("large").rowsBetween(*earlier)), zero).alias("large_before"),
        F.sum("large_n").over(Window.partitionBy("group")).alias("total"),
    )
    in_large = Window.partitionBy("group", "large").orderBy("block").rowsBetween(*earlier)
    blocks = blocks.withColumn("in_large", F.coalesce(F.sum("block_n").over(in_large), zero)).join(larges, ["group", "large"])
    in_block = Window.partitionBy("group", "block").orderBy("word").rowsBetween(*earlier)
    placed = keyed.withColumn("in_block", F.coalesce(F.sum("n").over(in_block), zero)).join(
        blocks.select("group", "block", (F.col("large_before") + F.col("in_large")).alias("block_before"), "total"), ["group", "block"]
    )
    return placed.select("group", "word", "bits", "n", (F.col("block_before") + F.col("in_block")).alias("before"), "total")


def places(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """`leaves` with `pos`, their rank in the group, and `total`; ids that repeat are ranked by leaf.

    A word with more rows than bits holds ids that repeat: those rows are numbered apart, and the rows
    above the first of each such id are added to what lies behind it.
    """
    ranked = directory(words)
    below = F.expr("~shiftleft(-1L, bit)")
    rank = F.col("before") + _popcount(F.col("bits").bitwiseAND(below))
    if ranked.filter(F.col("n") > _popcount(F.col("bits"))).isEmpty():
        return leaves.join(ranked.drop("n"), ["group", "word"]).withColumn("pos", rank).drop("bits", "before")
    ranked = stage(ranked)
    full = ranked.filter(F.col("n") > _popcount(F.col("bits"))).select("group", "word")
    suspects = leaves.join(full, ["group", "word"], "left_semi")
    counted = suspects.groupBy("group", "word", "bit").agg(F.count("*").alias("m")).filter("m > 1")
    # At most 64 entries a word.
    extra = stage(counted.groupBy("group", "word").agg(F.collect_list(F.struct("bit", (F.col("m") - 1).alias("more"))).alias("extra")))
    shift = F.coalesce(
        F.aggregate(F.filter("extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda a, x: a + x["more"]),
        F.lit(0).cast("long"),
    )
    repeated = stage(counted.select("group", "word", "bit"))
    ties = number_rows(
        leaves.join(repeated, ["group", "word", "bit"], "left_semi").groupBy(*leaves.columns).agg(F.count("*").alias("m")),
        ["group", "word", "bit"], [F.asc("leaf"), F.asc("tampered")], name="tie",
    )
    # Equal leaves take one place after another: sums of the copies before each distinct one, in two steps.
    ties = stage(ties.withColumn("part", F.shiftright("tie", LARGE_BITS)))
    same, zero = ["group", "word", "bit"], F.lit(0).cast("long")
    parts = ties.groupBy(*same, "part").agg(F.sum("m").alias("part_m"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*same, "part", F.coalesce(F.sum("part_m").over(before), zero).alias("part_start"))
    run = Window.partitionBy(*same, "part").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("in_part", F.coalesce(F.sum("m").over(run), zero)).join(parts, [*same, "part"])
    ties = ties.withColumn("start", F.col("part_start") + F.col("in_part"))
    copies = (
        ties.withColumn("slice", F.explode(F.expr(f"sequence(0L, m - 1, {COPY_SLICE}L)")))
        .withColumn("own", F.explode(F.expr(f"sequence(slice, least(slice + {COPY_SLICE}L, m) - 1)")))
    )
    plain = leaves.join(repeated, ["group", "word", "bit"], "left_anti").withColumn("tie_no", F.lit(0).cast("long"))
    tied = copies.select(*leaves.columns, (F.col("start") + F.col("own")).cast("long").alias("tie_no"))
    return (
        plain.unionByName(tied)
        .join(ranked.drop("n"), ["group", "word"])
        .join(extra, ["group", "word"], "left")
        .withColumn("pos", rank + shift + F.col("tie_no"))
        .drop("bits", "before", "extra", "tie_no")
    )


def _slots(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Runs of FANOUT consecutive nodes as slot arrays: (group, parent, n, slots)."""
    slot = F.struct(F.pmod("pos", F.lit(FANOUT)).cast("int").alias("slot"), "hash", *carried)
    return nodes.groupBy("group", F.shiftright("pos", 4).alias("parent"), "n").agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def _reduced(runs: DataFrame) -> DataFrame:
    """The nodes of the next level. A group of a single node keeps it as it is."""
    joined = F.array_join(F.transform("slots", lambda x: x["hash"]), "")
    return runs.select(
        "group", F.col("parent").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        F.when(F.col("n") == 1, F.element_at("slots", 1)["hash"]).otherwise(digest(joined)).alias("hash"),
    )


def _tree(nodes: DataFrame, height: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every level, leaves first, and the (group, hash) that remains of each group."""
    levels, tops = [], []
    for level in range(height):
        runs = stage(_slots(nodes, carried if level == 0 else []))
        levels.append(runs)
        reduced = _reduced(runs)
        tops.append(reduced.filter("n = 1").select("group", "hash"))
        nodes = reduced.filter("n > 1")
    top = tops[0]
    for other in tops[1:]:
        top = top.union(other)
    return levels, stage(top)


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Siblings from every leaf up to the root: (group, pos, path, slot fields).

    `above` has the path of each group's top. A run hands its own path down to its nodes, each with its
    siblings in front: those before it and those after it.
    """
    paths = above.withColumn("pos", F.lit(0).cast("long"))
    out = None
    for level in range(len(levels) - 1, -1, -1):
        runs = levels[level].withColumnRenamed("parent", "pos")
        met = runs.join(paths, ["group", "pos"])
        met = met.select("group", F.col("pos").alias("parent"), "n", "slots", "path").withColumn("at", F.explode("slots"))
        own = F.col("at")["slot"]
        step = F.struct(
            F.array_join(F.transform(F.filter("slots", lambda x: x["slot"] < own), lambda x: x["hash"]), "").alias("pre"),
            F.array_join(F.transform(F.filter("slots", lambda x: x["slot"] > own), lambda x: x["hash"]), "").alias("post"),
        )
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        out = met.select("group", (F.col("parent") * FANOUT + own).alias("pos"), path.alias("path"), "at")
        if level:
            # Groups whose top lies just below this level start here; the others come down.
            below = levels[level - 1].select("group", F.col("parent").alias("pos"), "n").filter(f"n <= {FANOUT}")
            start = above.join(below.filter("pos = 0").select("group"), "group", "left_semi").withColumn("pos", F.lit(0).cast("long"))
            paths = out.select("group", "path", "pos").unionByName(start.select("group", "path", "pos"))
    return out


def _height(n: int) -> int:
    """Rounds until n nodes are one; at least one, in which a lone node is kept."""
    rounds, left = 0, n
    while left > 1 or not rounds:
        rounds, left = rounds + 1, -(-left // FANOUT)
    return rounds


def manifest(
    docs: DataFrame, group: str = "source", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, changed: Column | None = None,
) -> DataFrame:
    """One row per row of `docs`: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes `columns` as `field_text`. Per `group` the leaves ascend by `key`, a whole number, and
    every 16 become their digest until one is left, the subroot; the subroots, ordered by group, give
    the root the same way. proof_sha256 hashes the siblings from the leaf up to the root. Where
    `changed` holds, folded_root is computed from a leaf whose columns `tampered` replaces, else from the
    leaf itself, and the original siblings; verified says if it equals the root.

    A null group is one of its own and comes first; rows without a key come first in their group; rows
    that repeat a key follow each other by leaf. Every row is a leaf, repeated ones too. An empty table
    gives no rows. Only the named columns are read, so further columns may have any name.
    """
    value = {c: F.col(f"`{c}`") for c in {*columns, group, key}}
    leaf = leaf_hash([value[c] for c in columns])
    swapped = leaf_hash([(tampered or {}).get(c, value[c]) for c in columns])
    is_changed = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    number = value[key].cast("long")
    leaves = stage(
        docs.select(
            # A mark in front keeps a null apart from an empty name and before all others.
            F.coalesce(F.concat(F.lit("="), value[group].cast("string")), F.lit("")).alias("group"),
            number.alias("key"),
            F.coalesce(F.shiftright(number, 6), F.lit(_NULL_WORD)).alias("word"),
            F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
            leaf.alias("leaf"),
            F.when(is_changed, swapped).alias("tampered"),
        )
    )
    words = stage(bitmap_words(leaves))
    sizes = stage(words.groupBy("group").agg(F.sum("n").alias("n")))
    most = sizes.agg(F.max("n").alias("n"), F.count("*").alias("groups")).first()
    placed = places(leaves, words)
    nodes = placed.select("group", "pos", F.col("total").alias("n"), F.col("leaf").alias("hash"), "key", "tampered")
    levels, subroots = _tree(nodes, _height(most["n"] or 0), ["key", "tampered"])
    # The subroots are leaves of a tree of their own, in the order of their groups.
    ordered = number_rows(subroots, [], [F.asc("group")], name="no")
    heads = ordered.select(
        F.lit("").alias("group"), (F.col("no") - 1).cast("long").alias("pos"), F.lit(most["groups"]).cast("long").alias("n"),
        "hash", F.col("group").alias("name"),
    )
    top_levels, top = _tree(heads, _height(most["groups"]), ["name"])
    none = F.from_json(F.lit("[]"), f"array<{_STEP}>")
    head = _paths(top_levels, top.select("group", none.alias("path")))
    above = stage(
        head.join(top.select("group", F.col("hash").alias("root")), "group")
        .select(F.col("at")["name"].alias("group"), F.col("at")["hash"].alias("subroot"), "path", "root")
    )
    found = _paths(levels, above.select("group", "path")).join(above.select("group", "subroot", "root"), "group")
    own = F.col("at")["hash"]
    start = F.coalesce(F.col("at")["tampered"], own)
    folded = F.aggregate("path", start, lambda acc, s: digest(F.concat(s["pre"], acc, s["post"])))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["pre"], s["post"])), ""))
    return found.select(
        F.col("at")["key"].alias(key), own.alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# The same manifest with the upper-case letters A-Z of the text lowered where 5 divides the crc32 of the id.
MANIFEST_SQL = f"""
WITH RECURSIVE
f AS (
    SELECT *, row_number() OVER () AS rid, coalesce('=' || source, '') AS tree,
           list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
               lambda a, x: list_reduce([xor(a, x)] || range(8), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))) AS crc,
           {{leaf}} AS leaf, {{low}} AS lowered
    FROM documents
),
l AS (
    SELECT rid, tree, doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN lowered ELSE leaf END AS start,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM f
),
own(tree, k, pos, n, hash) AS (
    SELECT tree, 0, pos, n, leaf FROM l
    UNION ALL
    SELECT tree, k + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY pos))
    FROM own WHERE n > 1 GROUP BY tree, k, pos // {FANOUT}, n
),
sub AS (SELECT tree, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
head(k, pos, n, hash) AS (
    SELECT 0, pos, n, hash FROM sub
    UNION ALL
    SELECT k + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY pos))
    FROM head WHERE n > 1 GROUP BY k, pos // {FANOUT}, n
),
run AS (
    SELECT tree, false AS top, k, pos // {FANOUT} AS parent, list(hash ORDER BY pos) AS h FROM own WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT '', true, k, pos // {FANOUT}, list(hash ORDER BY pos) FROM head WHERE n > 1 GROUP BY ALL
),
walk(rid, step, top, tree, k, pos, h, proof) AS (
    SELECT rid, 0, false, tree, 0, pos, start, '' FROM l
    UNION ALL
    SELECT w.rid, w.step + 1, w.top OR r.h IS NULL, CASE WHEN r.h IS NULL THEN '' ELSE w.tree END,
           CASE WHEN r.h IS NULL THEN 0 ELSE w.k + 1 END, CASE WHEN r.h IS NULL THEN s.pos ELSE w.pos // {FANOUT} END,
           CASE WHEN r.h IS NULL THEN w.h ELSE sha256(
               array_to_string(r.h[:w.pos % {FANOUT}], '') || w.h || array_to_string(r.h[w.pos % {FANOUT} + 2:], '')) END,
           CASE WHEN r.h IS NULL THEN w.proof ELSE w.proof || array_to_string(r.h[:w.pos % {FANOUT}], '')
               || array_to_string(r.h[w.pos % {FANOUT} + 2:], '') END
    FROM walk w LEFT JOIN run r ON r.tree = w.tree AND r.top = w.top AND r.k = w.k AND r.parent = w.pos // {FANOUT}
    LEFT JOIN sub s ON s.tree = w.tree WHERE r.h IS NOT NULL OR NOT w.top
),
ended AS (SELECT rid, arg_max(h, step) AS folded, arg_max(proof, step) AS proof FROM walk GROUP BY rid)
SELECT l.doc_id, l.leaf, sub.hash AS subroot, root.hash AS root, sha256(ended.proof) AS proof_sha256,
       ended.folded AS folded_root, ended.folded = root.hash AS verified
FROM l JOIN ended USING (rid) JOIN sub USING (tree) CROSS JOIN (SELECT hash FROM head WHERE n = 1) root
"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MANIFEST_SQL = MANIFEST_SQL.format(leaf=_leaf_sql("text"), low=_leaf_sql(f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')"))
