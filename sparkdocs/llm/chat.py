"""Perspective rotation: every participant's view of a dialogue as training text with loss masks.

Only column expressions and aggregates; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.operators.sizes import number_rows

# Turn numbers that share one part; a longer dialogue goes on in further parts.
PART_TURNS = 256
# Rows of a part that are gathered and rendered together.
PIECE_ROWS = 256
SYSTEM = "system"
NOBODY = "unknown"


def plain(text: Column) -> Column:
    """A text without the marks of a turn: a blank parts the signs of `<|` and `|>`, so no turn can forge another."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def segments(part: str, viewer: str):
    """Per turn of the ordered array `part`: struct of head, body and whether the viewer speaks."""
    return F.transform(
        part,
        lambda m: F.struct(
            F.when(m["speaker"] == F.col(viewer), F.lit("<|assistant|>\n"))
            .when(m["speaker"] == SYSTEM, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), m["speaker"], F.lit("|>\n"))).alias("head"),
            F.concat(m["said"], F.lit("<|end|>\n")).alias("body"),
            (m["speaker"] == F.col(viewer)).alias("own"),
        ),
    )


def rotate_pieces(turns: DataFrame, part_turns: int = PART_TURNS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Views as in `rotate`, but a part goes on in pieces of at most `piece_rows` rows by their position.

    Further columns: piece (from 0) and pieces, their number in the part. Positions come from range slices,
    so that a dialogue that holds most rows, with repeated or null turn numbers, is never in one task or row.
    """
    role = F.replace(F.trim(F.col("role").cast("string")), F.lit("\n"), F.lit(" "))
    said = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(role.isNull() | (role == ""), F.lit(NOBODY)).otherwise(plain(role)).alias("speaker"),
        plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"),
    )
    viewers = said.filter(~F.col("speaker").isin(SYSTEM, NOBODY)).groupBy("conv_id").agg(
        F.array_sort(F.collect_set("speaker")).alias("viewers")
    )
    # Equal rows get a tie, for range slices cannot part them otherwise; their order does not show.
    dealt = said.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1))).withColumn(
        "tie", F.monotonically_increasing_id()
    )
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("said"), F.col("tie")]
    placed = number_rows(dealt, ["conv_id", "part"], order, "place", total="rows")
    gathered = placed.groupBy(
        "conv_id", "part", F.floor((F.col("place") - 1) / piece_rows).alias("piece"),
        F.ceil(F.col("rows") / piece_rows).alias("pieces"),
    ).agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    named = viewers.withColumnRenamed("conv_id", "viewers_of")
    views = gathered.join(named, F.col("conv_id").eqNullSafe(F.col("viewers_of"))).select(
        "conv_id", "part", "piece", "pieces", "turns", F.explode("viewers").alias("viewer")
    )
    runs = F.flatten(F.transform(
        "said",
        lambda p: F.when(
            p["own"],
            F.array(
                F.struct(F.length(p["head"]).alias("length"), F.lit(False).alias("trained")),
                F.struct(F.length(p["body"]).alias("length"), F.lit(True).alias("trained")),
            ),
        ).otherwise(F.array(F.struct((F.length(p["head"]) + F.length(p["body"])).alias("length"), F.lit(False).alias("trained")))),
    ))
    trained = F.aggregate(
        F.filter("said", lambda p: p["own"]), F.lit(0).cast("long"), lambda x, p: x + F.length(p["body"])
    )
    return views.withColumn("said", segments("turns", "viewer")).select(
        "conv_id", "viewer", "part", "piece", "pieces", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        runs.alias("mask"), trained.alias("n_trained"),
    )


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per dialogue, part and participant: conv_id, viewer, part, n_turns, text, mask, n_trained.

    `turns` has conv_id, turn, role (the speaker) and text. For each speaker but `system` the dialogue is
    rendered with their turns as assistant and all others as users under their names; system turns stay
    system turns. mask is the rendered text as runs of struct(length, trained) in characters: the body of
    the viewer's own turns is trained, with the end sign, all else is not. Runs cover the text.

    A part takes the turns whose number lies in the same `part_turns`; participants are those of the whole
    dialogue. Turns are ordered by number, speaker and text; repeated rows are rendered as often as they
    come; null turn numbers come first, in a part numbered -1. A null or blank role is a speaker `unknown`
    who is rendered but gets no view. A null text is empty. Marks of a turn inside names and texts are taken
    apart by a blank, line ends in names become blanks. Rows without conv_id form one dialogue. Other
    columns are not looked at.

    A part of more than `piece_rows` rows is rendered in pieces and its texts and masks are joined at the
    end, per viewer: one part of one viewer must fit in a row. `rotate_pieces` has no such bound.
    """
    found = rotate_pieces(turns, part_turns, piece_rows)
    columns = ["conv_id", "viewer", "part", "n_turns", "text", "mask", "n_trained"]
    split = found.filter("pieces > 1").groupBy("conv_id", "viewer", "part").agg(
        F.sort_array(F.collect_list(F.struct("piece", "n_turns", "text", "mask", "n_trained"))).alias("p"),
        F.sum("n_turns").alias("n_turns"), F.sum("n_trained").alias("n_trained"),
    )
    joined = split.withColumn("text", F.array_join("p.text", "")).withColumn("mask", F.flatten("p.mask"))
    return found.filter("pieces = 1").select(*columns).unionByName(joined.select(*columns))


ROTATION_SQL = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown'
      ELSE replace(replace(replace(trim(role), chr(10), ' '), '<|', '< |'), '|>', '| >') END AS speaker,
    replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS said, coalesce(turn // 256, -1) AS part
  FROM conversations),
viewers AS (SELECT DISTINCT conv_id, speaker AS viewer FROM said WHERE speaker NOT IN ('system', 'unknown')),
pieces AS (
  SELECT s.conv_id, viewer, part, turn, speaker, said,
    CASE WHEN speaker = viewer THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
      ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head,
    said || '<|end|>' || chr(10) AS body, speaker = viewer AS own
  FROM said s JOIN viewers v ON s.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, viewer, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, said) AS text,
  string_agg(CASE WHEN own THEN length(head) || ':0 ' || length(body) || ':1' ELSE (length(head) + length(body)) || ':0' END,
    ' ' ORDER BY turn NULLS FIRST, speaker, said) AS mask_runs,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_trained
FROM pieces GROUP BY conv_id, viewer, part
"""
