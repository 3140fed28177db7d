"""Multi-party perspective rotation of dialogues, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered once more with that speaker as
the assistant and everybody else as a named user; system turns stay system turns.  A row is one
turn seen by one participant: its rendered piece, where the piece stands in the rendered dialogue
(characters, gapless from 0) and the part of it that a model learns from (the assistant's words
and the closing mark; nothing elsewhere).  Joining the pieces by ``seq`` gives the whole rendering.

Turns are ordered by number (null first), then role, then text; repeated rows are interchangeable.
They are sorted once into ranges of about ``RUN`` rows, and places are added up in two levels, inside
the ranges and then over them: a conversation of any length, rows without a turn number, rows that
share one and repeated rows all spread over as many ranges as their number asks for.

A null role speaks as ``unknown``, a null text is empty, and conversations with a null id form one.
A conversation of system turns alone has no participant and no rows.  ``<|`` in a text is broken up,
and ``|`` and line breaks in a speaker's name are replaced in the rendering, so that neither can
forge a mark.  Texts of any length are rendered whole; extra columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.plans.tables import materialize

SYSTEM = "system"
#: Turns in one range of places; there are at most ``RANGES`` for each core.
RUN, RANGES = 8192, 64


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, perspective, seq, turn, role, speaker, piece, start, stop, learn_from, learn_to)``.

    ``learn_from = learn_to`` where nothing is learnt.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    # the last key parts rows that are equal in all others
    rows = rows.withColumn("any", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "speaker", "text", "any")]
    ranges = max(1, min(-(-turns.count() // RUN), RANGES * turns.sparkSession.sparkContext.defaultParallelism))
    rows = materialize(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "turns")
    cast = (
        rows.filter(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("cast_of"))
        .agg(F.array_sort(F.collect_set("speaker")).alias("cast"))
    )
    seen = rows.join(cast, F.col("conv_id").eqNullSafe(F.col("cast_of"))).drop("cast_of").withColumn("perspective", F.explode("cast")).drop("cast")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.translate("speaker", "|\n\r", "/  ")
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user:"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    pieces = (
        seen.withColumn("role", role).withColumn("head", head)
        .withColumn("piece", F.concat("head", "text", F.lit("<|end|>\n")))
        .withColumn("size", F.length("piece").cast("long"))
    )
    of = ["conv_id", "perspective"]
    totals = pieces.groupBy(*of, "range").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*of).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("range").alias("__r"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("nth"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("range") == F.col("__r"))
    inside = Window.partitionBy(*of, "range").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text", "any")
    stop = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("at")
    placed = pieces.join(before, same).withColumn("stop", stop).withColumn("seq", F.row_number().over(inside) - 1 + F.col("nth"))
    start = F.col("stop") - F.col("size")
    learns = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "role", "speaker", "piece",
        start.alias("start"), "stop", F.when(learns, start + F.length("head")).otherwise(F.col("stop")).alias("learn_from"),
        # the line break after the closing mark is not learnt
        F.when(learns, F.col("stop") - 1).otherwise(F.col("stop")).alias("learn_to"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole renderings ``(conv_id, perspective, text, masks)`` for conversations that fit a row."""
    part = F.struct("seq", "piece", "learn_from", "learn_to")
    got = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["learn_from"] < p["learn_to"]), lambda p: F.struct(p["learn_from"].alias("start"), p["learn_to"].alias("stop")))
    return got.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"), masks.alias("masks"))


ORACLE = f"""
with rows as (select conv_id, turn::bigint as turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
cast_ as (select distinct conv_id as c, speaker as perspective from rows where speaker <> '{SYSTEM}'),
seen as (select conv_id, perspective, turn, speaker, text,
    case when speaker = '{SYSTEM}' then '{SYSTEM}' when speaker = perspective then 'assistant' else 'user' end as role
    from rows join cast_ on conv_id is not distinct from c),
heads as (select *, case when role = 'user' then '<|user:' || translate(speaker, '|' || chr(10) || chr(13), '/  ') || '|>' || chr(10) else '<|' || role || '|>' || chr(10) end as head from seen),
pieces as (select *, head || text || '<|end|>' || chr(10) as piece from heads),
placed as (select *, sum(length(piece)) over w as stop, row_number() over w - 1 as seq from pieces
    window w as (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding))
select conv_id, perspective, seq::bigint as seq, turn, role, speaker, piece, (stop - length(piece))::bigint as start, stop::bigint as stop,
    (case when role = 'assistant' then stop - length(piece) + length(head) else stop end)::bigint as learn_from,
    (case when role = 'assistant' then stop - 1 else stop end)::bigint as learn_to from placed
"""
