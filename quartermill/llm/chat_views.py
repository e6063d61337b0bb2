"""Chat formatting by multi-party perspective rotation, in DataFrame functions.

Every participant of a conversation gets a rendering of it with itself as the
assistant, all others as users under their names, and a mask of just its own
words. Participants are the distinct roles but ``system``, whose turns stay
system turns for everyone. A turn is written

    <|im_start|>assistant\\n TEXT <|im_end|>\\n            its own
    <|im_start|>user name=ROLE\\n TEXT <|im_end|>\\n       another's
    <|im_start|>system\\n TEXT <|im_end|>\\n

(without the blanks). Markers within texts and names get a blank after "<",
and line ends within names are blanks, so nothing a speaker writes can close
its turn. The mask is the spans [start, end) in code points of the own turns'
texts with their end marks.

A rendering is the whole conversation, however long. It is stored in parts of
``TURNS`` turn numbers, so a row's size is bounded and a long conversation is
spread over tasks: the parts of a speaker, put together in order, are the
rendering; ``at`` is where a part begins in it, and the mask's positions are
those of the whole rendering.

Plan. One aggregation collects a part's turns, and text and mask are made
within its row. Where parts begin follows from counts by conversation, part
and role only: a part is as long for a speaker as for anyone else, but for the
names in the heads of its own turns. Participants meet these small rows, and
the turns join by conversation and part, so a hot conversation spreads.

Edge cases. Null text is empty; a null role is the participant ``unknown``.
Turns without a number come first, in parts below 0 by a hash of role and text
(4096 of them). Turns with equal numbers are ordered by role and text and share
a part; repeated rows are repeated turns. Null conv_ids make up one
conversation. Conversations with system turns only, and empty tables, give no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turn numbers in a part.
TURNS = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def clean(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def head(own: Column, role: Column) -> Column:
    """What stands before a turn's text."""
    name = F.when(own, F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), name, F.lit("\n"))


def rotate(turns: DataFrame, per_part: int = TURNS) -> DataFrame:
    """conv_id, part, speaker, at, n_turns, text, mask (array of start and end)."""
    role = F.translate(clean(F.coalesce("role", F.lit("unknown"))), "\n\r", "  ")
    text = clean(F.coalesce("text", F.lit("")))
    loose = F.conv(F.substring(F.md5(F.concat(role, F.lit("\n"), text)), 1, 3), 16, 10).cast("bigint") - 4096
    said = turns.select(
        F.struct("conv_id").alias("conv"),  # a struct is never null, so nulls join and group as a value
        F.coalesce(F.floor(F.col("turn") / per_part).cast("bigint"), loose).alias("part"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    parts = said.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    counts = said.groupBy("conv", "part", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    before = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    as_other = F.col("chars") + F.col("n") * (F.length(head(F.lit(False), F.col("role"))) + len(END))
    lengths = counts.groupBy("conv", "part").agg(F.sum(as_other).alias("long"))
    begins = lengths.select("conv", "part", F.coalesce(F.sum("long").over(before("conv")), F.lit(0)).alias("base"))
    speakers = counts.where("role <> 'system'").select("conv", F.col("role").alias("speaker")).distinct()
    own = counts.select("conv", "part", F.col("role").alias("speaker"), "n")
    seats = begins.join(speakers, "conv").join(own, ["conv", "part", "speaker"], "left")
    saved = F.length(head(F.lit(True), F.col("speaker"))) - F.length(head(F.lit(False), F.col("speaker")))
    at = F.col("base") + saved * F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before("conv", "speaker")), F.lit(0))
    views = seats.select("conv", "part", "speaker", at.cast("bigint").alias("at")).hint("merge").join(parts, ["conv", "part"])
    mine = lambda t: t["role"] == F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(mine(t).alias("own"), head(mine(t), t["role"]).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")))
    views = views.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    # each piece's end is the sum of the sizes so far, kept in the array that is built
    begin = lambda a, p: a["at"] + F.length(p["head"])
    end = lambda a, p: begin(a, p) + F.length(p["body"])
    spans = F.aggregate(
        "pieces",
        F.struct(F.col("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            end(a, p).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.struct(begin(a, p).alias("start"), end(a, p).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return views.select(F.col("conv.conv_id").alias("conv_id"), "part", "speaker", "at", F.size("pieces").cast("bigint").alias("n_turns"), text.alias("text"), spans.alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, part, speaker, at, n_turns, text and the mask's spans as text, of every conversation and participant."""
    views = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return views.select("conv_id", "part", "speaker", "at", "n_turns", "text", spans.alias("mask_spans"))


SQL = r"""
WITH cleaned AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
said AS (
  SELECT *, coalesce(CAST(floor(turn / 512.0) AS BIGINT), CAST('0x' || substr(md5(role || chr(10) || text), 1, 3) AS BIGINT) - 4096) AS part
  FROM cleaned),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn, role, text) AS pos FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
parts AS (
  SELECT p.conv_id, part, speaker, pos, role = speaker AS own, text || '<|im_end|>' || chr(10) AS body,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END || chr(10) AS head
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
ended AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
  FROM parts)
SELECT conv_id, part, speaker, CAST(min(upto - length(head) - length(body)) AS BIGINT) AS "at", count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto AS BIGINT) AS VARCHAR),
                           ',' ORDER BY pos) FILTER (WHERE own), '') AS mask_spans
FROM ended GROUP BY conv_id, part, speaker
"""
