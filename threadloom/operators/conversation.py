"""Conversation cleaning: roles, noise, merging of turns, length filters (long form: one row a turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import UNICODE, any_of, has, kept, one_line, sms_text, strip

SMS_NOISE = r"(?i)^\s*(?:this is an automated|msg\s*&?\s*data rates|reply stop|unsubscribe)"
SIGNATURE = r"(?i)^\s*(?:thanks[!,]*\s*)?[–—-]\s*\w+\s*$"
CALL_NOISE = "(?i)(?:" + any_of("left call", "joined call", "for english", "please wait", "may be monitored", "quality assurance", "thank you for calling") + r"|press \d)"
NODS = ("gotcha", "mm hmm", "ok", "okay", "right", "sure", "uh huh", "yeah", "yep")
CALL_LINE = r"^\[(?:\d\d:){2}\d\d\]\s*([ a-zA-Z]+?):\s*(.*)$"
SPEAKERS = {"agent": "agent", "internal": "agent", "client": "client", "customer": "client", "external": "client"}


def sms_role(c: Column) -> Column:
    """agent or client, else null."""
    role = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(role.isin("agent", "client"), role)


def call_role(c: Column) -> Column:
    role = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])[role]


def clean_sms(turns: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """Normalised texts and roles without empty turns, other roles, opt-out notices and signatures."""
    out = turns.withColumn(role, sms_role(F.col(role))).where(F.col(role).isNotNull())
    return kept(out, text, sms_text(F.col(text)), lambda m: (m != "") & ~has(m, SMS_NOISE) & ~has(m, SIGNATURE))


def parse_call_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """role and text of stamped transcript lines, without notices and bare nods."""
    trimmed = strip(F.col(line))
    said = F.struct(call_role(F.regexp_extract(trimmed, UNICODE + CALL_LINE, 1)).alias("role"), one_line(F.regexp_extract(trimmed, UNICODE + CALL_LINE, 2)).alias("text"))
    good = lambda x: x["role"].isNotNull() & (x["text"] != "") & ~has(x["text"], CALL_NOISE) & ~F.lower(x["text"]).isin(*NODS)
    out = kept(lines, "_said", said, good)
    return out.select(*[F.col(f"`{c}`") for c in lines.columns if c not in (line, "role", "text")], "_said.role", "_said.text")


def merge_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Neighbouring turns of one role become one, texts joined by a blank: key, turn (0, 1, ...), role, text, parts."""
    w = W.partitionBy(key).orderBy(order)
    marked = turns.withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    merged = marked.groupBy(key, "island").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct(order, "text"))).alias("xs"))
    return merged.select(key, (F.col("island") - 1).cast("int").alias("turn"), "role", F.array_join(F.col("xs.text"), " ").alias("text"), F.size("xs").alias("parts"))


def at_least(turns: DataFrame, least: int, key: str = "conv_id") -> DataFrame:
    """Conversations of that many turns or more."""
    return turns.withColumn("_n", F.count("*").over(W.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def kept_skipped(all_turns: DataFrame, kept: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row: conversations kept and skipped."""
    good = kept.select(key).distinct().withColumn("ok", F.lit(1))
    joined = all_turns.select(key).distinct().join(good, key, "left")
    return joined.agg(F.count("ok").alias("kept"), F.count_if(F.col("ok").isNull()).alias("skipped"))


def by_timestamp(turns: DataFrame, key: str = "conv_id", stamp: str = "timestamp", order: str = "ordinal") -> DataFrame:
    """A turn number in string order of the stamps, missing ones first, ties in input order."""
    w = W.partitionBy(key).orderBy(F.coalesce(F.col(stamp), F.lit("")), order)
    return turns.withColumn("turn", (F.row_number().over(w) - 1).cast("int"))


def fold(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation with its turns in an array, as sinks want it."""
    xs = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy(key).agg(F.transform(xs, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
