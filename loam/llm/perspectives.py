"""Chat formatting by multi-party perspective rotation (operator 8).

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant, the others as users by name and context roles (system) as they are; the loss mask covers the
assistant's own words. The result is one row per perspective and turn: the rendered segment, its place in
the rendered dialogue and the masked part of it, so that a conversation of any length is spread over many
tasks. Places come from running sums over range partitions, which split a very long conversation too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import running_sum
from .common import materialize, narrow, read_table

#: The template. A marker inside a text is written with a space, so that no text can open a turn;
#: in a name the end of a marker and line breaks too, so that no name can close its own.
OWN, OTHER, CONTEXT, END = "<|assistant|>\n", "<|user name={}|>\n", "<|{}|>\n", "<|end|>\n"
MARK, HARMLESS = "<|", "< |"
MARK_END, HARMLESS_END = "|>", "| >"
CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, conv_col: str = "conv_id",
           turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, perspective, turn, speaker, segment, start, end, mask_start, mask_end``.

    The segments of a (``conv_id``, ``perspective``) in order of ``start`` are the rendered dialogue;
    offsets are characters, ends exclusive. ``mask_start``/``mask_end`` are the assistant's text with its
    end marker; for the others' segments the mask is empty and lies at ``end``. Turns are ordered by
    number (null first), then speaker and the text's md5; repeated turns stay. A null speaker is
    ``unknown``, a null text empty; rows without ``conv_id`` take no part, and a conversation with
    context roles only has no perspective. Every participant gets the whole dialogue, so a
    conversation of p participants and t turns gives p * t rows. Other columns are ignored; an empty table gives no rows.
    """
    rows = narrow(turns, conv_id=conv_col, turn=turn_col, speaker=speaker_col, text=text_col).where(
        "conv_id is not null").select(
        "conv_id", "turn", F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(HARMLESS)).alias("text"))
    # a repeated turn is one row with a count, so that its key (by the text's md5) is unique
    rows = materialize(rows.groupBy("conv_id", "turn", "speaker", "text").agg(
        F.count(F.lit(1)).alias("copies")).withColumn("sum", F.md5("text")), "turns")
    # written, so that a join with it is one of plain shuffles and a hot conversation can be split
    people = materialize(rows.where(~F.col("speaker").isin(*context_roles)).select(
        "conv_id", F.col("speaker").alias("perspective")).distinct(), "people")
    name = F.replace(F.replace("speaker", F.lit(MARK), F.lit(HARMLESS)), F.lit(MARK_END), F.lit(HARMLESS_END))
    name = F.translate(name, "\r\n", "  ")
    before, after = OTHER.split("{}")
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(own, F.lit(OWN))
            .when(F.col("speaker").isin(*context_roles), F.concat(F.lit("<|"), name, F.lit("|>\n")))
            .otherwise(F.concat(F.lit(before), name, F.lit(after))))
    # places from narrow rows: the texts are neither sorted nor written
    sized = rows.select("conv_id", "turn", "speaker", "sum", "copies", F.length("text").alias("length")).join(
        people, "conv_id").withColumn("head", head)
    sized = sized.withColumn("one", (F.length("head") + F.col("length") + len(END)).cast("bigint")).withColumn(
        "size", F.col("one") * F.col("copies"))
    placed = running_sum(sized, [F.col("turn"), F.col("speaker"), F.col("sum")], "size", ["conv_id", "perspective"], "last")
    keys = ["conv_id", "speaker", "sum"]
    texts = rows.select(*keys, F.col("turn").alias("_turn"), "text")
    out = placed.join(texts, keys).where(F.col("turn").eqNullSafe(F.col("_turn")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    out = out.withColumn("end", F.col("last") - F.col("one") * (F.col("copies") - F.col("copy")))
    start = F.col("end") - F.col("one")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", F.concat("head", "text", F.lit(END)).alias("segment"),
        start.alias("start"), "end",
        F.when(own, start + F.length("head")).otherwise(F.col("end")).alias("mask_start"),
        F.when(own, F.col("end") - 1).otherwise(F.col("end")).alias("mask_end"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations"))


def _lit(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_NAME = (f"translate(replace(replace(speaker, '{MARK}', '{HARMLESS}'), '{MARK_END}', '{HARMLESS_END}'), "
         "chr(13) || chr(10), '  ')")

ORACLE = f"""
WITH r AS (
    SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker,
           replace(coalesce(text, ''), '{MARK}', '{HARMLESS}') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), p AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker NOT IN ('system')
), s AS (
    SELECT r.*, perspective,
           CASE WHEN speaker = perspective THEN {_lit(OWN)}
                WHEN speaker IN ('system') THEN '<|' || {_NAME} || {_lit("|>" + chr(10))}
                ELSE '<|user name=' || {_NAME} || {_lit("|>" + chr(10))} END AS head
    FROM r JOIN p USING (conv_id)
), t AS (
    SELECT *, head || text || {_lit(END)} AS segment FROM s
), u AS (
    SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective
                                         ORDER BY turn NULLS FIRST, speaker, md5(text), id
                                         ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM t
)
SELECT conv_id, perspective, turn, speaker, segment, e - length(segment) AS start, e AS "end",
       CASE WHEN speaker = perspective THEN e - length(segment) + length(head) ELSE e END AS mask_start,
       CASE WHEN speaker = perspective THEN e - 1 ELSE e END AS mask_end
FROM u
"""
