"""Chat formatting: a dialogue of several speakers, once from the perspective of each.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named users; the mask
holds the places that a model learns, the assistant's own words. DataFrame operations only.

A row of the result holds a whole dialogue, so a dialogue's turns meet in one row first, in one shuffle; its speakers follow
from them. Where dialogues are too long for that, ``part_turns`` has them rendered in parts of so many turns. A turn's place
is then found without gathering the dialogue: rows are dealt by ranges of (dialogue, turn), numbered within their partition,
and the counts of earlier partitions are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

SYSTEM = "system"
END = "<|end|>\n"


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, key, turn, role, text) for each turn; ``key`` stands for ``conv`` and is never null."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    name = F.replace(F.replace(F.regexp_replace(text(role_col), "[\\r\\n]+", " "), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return turns.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string")), F.lit("")).alias("key"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown")).alias("role"),
        F.replace(text(text_col), F.lit("<|"), F.lit("< |")).alias("text"),
    )


def _in_parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """(conv, part, turns, speaker): parts of ``part_turns`` turns, for each speaker of the dialogue."""
    order = ["key", "turn", "role", "text"]
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(dealt.select("conv", "key", "role", "text", F.shiftright(at, 33).alias("task"), at.bitwiseAND((1 << 33) - 1).alias("at")), "turns")
    runs = rows.groupBy("key", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("key", "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"))
    ranked = rows.join(base, ["key", "task"]).withColumn("rank", F.col("at") + F.col("base"))
    part = F.floor(F.col("rank") / part_turns).cast("int").alias("part")
    parts = ranked.groupBy("conv", "key", part).agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    return parts.join(speakers, "key").select("conv", "part", "turns", "speaker")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = None) -> DataFrame:
    """(conv, part, speaker, n_turns, rendered, mask) for each participant of each dialogue (and each part of it).

    ``mask`` is an array of (start, end) in characters of ``rendered``: the speaker's texts with their end marks. Turns of the
    role ``system`` stay what they are and are nobody's perspective. ``<|`` inside a text or role becomes ``< |``, and in a role
    also ``|>`` becomes ``| >`` and line ends a space, so that nothing can forge a mark; roles that are alike then are one.

    - Turns are ordered by number, then role, then text (nulls first); ties and repeated rows stay, one turn each.
    - A null text is empty; a null or blank role is the speaker ``unknown``; rows without a dialogue id are one dialogue.
    - A dialogue without participants (only system turns) has no rows, nor has an empty table. Other columns aren't read.
    - A dialogue is rendered whole (``part`` is 0), however long; a row is then as large as its dialogue. With ``part_turns`` each
      row has at most so many turns.
    """
    rows = _named(turns, conv_col, turn_col, role_col, text_col)
    if part_turns:
        both = _in_parts(rows, part_turns)
    else:
        whole = rows.groupBy("conv", "key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        others = F.expr(f"filter(array_distinct(transform(turns, t -> t.role)), r -> r <> '{SYSTEM}')")
        both = whole.select("conv", F.lit(0).alias("part"), "turns", F.explode(others).alias("speaker"))
    head = f"case when t.role = '{SYSTEM}' then '<|system|>\n' when t.role = speaker then '<|assistant|>\n' else concat('<|user name=', t.role, '|>\n') end"
    made = both.withColumn("made", F.expr(f"transform(turns, t -> named_struct('head', {head}, 'body', concat(t.text, '<|end|>\n'), 'own', t.role = speaker))"))
    step = "named_struct('at', a.at + length(m.head) + length(m.body), 'mask', if(m.own, array_append(a.mask, named_struct('start', a.at + length(m.head), 'end', a.at + length(m.head) + length(m.body) - 1)), a.mask))"
    first = "named_struct('at', 0, 'mask', cast(array() as array<struct<start:int,end:int>>))"
    return made.select(
        F.col("conv"), "part", "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(made, m -> concat(m.head, m.body)), '')").alias("rendered"),
        F.expr(f"aggregate(made, {first}, (a, m) -> {step}, a -> a.mask)").alias("mask"),
    )


ORACLE = """
    WITH r AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank FROM (
        SELECT conv_id, turn, coalesce(nullif(trim(replace(replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '<|', '< |'), '|>', '| >')), ''), 'unknown') AS role,
          replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)
    ), p AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
    x AS (
      SELECT r.conv_id, CAST(0 AS INTEGER) AS part, speaker, rank, role = speaker AS own, text || '<|end|>' || chr(10) AS body,
        CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
          ELSE '<|user name=' || role || '|>' || chr(10) END AS head
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
    ), o AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY rank) AS BIGINT) AS stop FROM x)
    SELECT conv_id, part, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS rendered,
      coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop - 1 AS VARCHAR) END, ',' ORDER BY rank), '') AS mask
    FROM o GROUP BY conv_id, part, speaker
"""
