"""Root paths of trees given as (id, parent) rows, and outlines rendered from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.operators.sizes import keyed_join
from sparkdocs.session import cut_lineage

_PLAIN_ROUNDS = 7  # chains of up to 2^7 links need no look for cycles


def _double(state: DataFrame) -> DataFrame:
    """One round: every open node takes over the reach of the node it points to."""
    open_nodes = state.filter(F.col("up").isNotNull())
    reach = state.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above"))
    moved = keyed_join(open_nodes, reach, ["up"], "left").select(
        "id",
        F.col("_next").alias("up"),
        F.concat(F.coalesce("_above", F.array().cast("array<string>")), "path").alias("path"),
    )
    return cut_lineage(state.filter(F.col("up").isNull()).unionByName(moved))


def _rounds(state: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    for _ in range(limit):
        if state.filter(F.col("up").isNotNull()).isEmpty():
            return state, True
        state = _double(state)
    return state, state.filter(F.col("up").isNotNull()).isEmpty()


def root_paths(nodes: DataFrame) -> DataFrame:
    """`path` (array of labels from the root down) for nodes (id, parent, label).

    Pointer doubling: the reach of each node doubles per round, so a chain of n links takes log2(n)
    self-joins. An unknown parent ends a chain. Nodes on or below a cycle get a null path.
    """
    start = cut_lineage(
        nodes.select("id", F.col("parent").alias("up"), F.array("label").alias("path"))
    )
    state, done = _rounds(start, _PLAIN_ROUNDS)
    if done:
        return state.select("id", "path")
    # Long chains or cycles: first find, without labels, what never reaches a root.
    bare = start.select("id", "up", F.array().cast("array<string>").alias("path"))
    limit = math.ceil(math.log2(start.count() + 1)) + 1
    bare, _ = _rounds(bare, limit)
    looped = cut_lineage(bare.filter(F.col("up").isNotNull()).select("id"))
    sound = start.join(looped, "id", "left_anti")
    state, _ = _rounds(cut_lineage(sound), limit)
    lost = looped.select("id", F.lit(None).cast("array<string>").alias("path"))
    return state.select("id", "path").unionByName(lost)


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, folder_path) of folders (id, parent_id, title); titles joined by '/'."""
    parent = F.nullif(F.col("parent_id").cast("string"), F.lit(""))
    nodes = folders.select(
        F.col("id").cast("string").alias("id"), parent.alias("parent"), F.col("title").alias("label")
    )
    return root_paths(nodes).select("id", F.array_join("path", "/").alias("folder_path"))


def outline_markdown(nodes: DataFrame) -> DataFrame:
    """(file, markdown_content) of outline nodes (file, sheet, node_id, parent_id, ordinal, title).

    Depth and reading order come from the root path of zero-padded ordinals.
    """

    def key(node: str):
        return F.to_json(F.struct(F.col("file"), F.col("sheet"), F.col(node).alias("n")))

    keyed = nodes.withColumn("id", key("node_id"))
    parent = F.when(F.col("parent_id").isNotNull(), key("parent_id"))
    paths = root_paths(
        keyed.select("id", parent.alias("parent"), _padded(F.col("ordinal")).alias("label"))
    )
    return render_outlines(keyed.join(paths, "id").select("file", "sheet", "path", "title"))


def _padded(ordinal: Column) -> Column:
    return F.lpad(ordinal.cast("string"), 10, "0")


def dotted_path(place: Column) -> Column:
    """Path of a node that carries its ordinals as `0.2.1`."""
    return F.transform(F.split(place, "[.]"), _padded)


def render_outlines(nodes: DataFrame) -> DataFrame:
    """(file, markdown_content) of (file, sheet, path, title).

    `# root`, then one `- ` line per topic in reading order, two blanks per level; sheets are parted
    by an empty line.
    """
    title = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    depth = F.size("path")
    line = F.when(depth == 1, F.concat(F.lit("# "), title, F.lit("\n"))).otherwise(
        F.concat(F.repeat(F.lit("  "), depth - 2), F.lit("- "), title)
    )
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    sheets = nodes.groupBy("file", "sheet").agg(
        F.regexp_replace(
            F.array_join(F.transform(lines, lambda n: n["line"]), "\n"), r"\s+$", ""
        ).alias("text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("sheet", "text")))
    return sheets.groupBy("file").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("markdown_content")
    )
