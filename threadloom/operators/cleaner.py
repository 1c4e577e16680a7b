"""The cleaner of chat records: relabel, route, rewrite, circle back, cap duplicates, report.

Every record gets one ``outcome`` by a strict first match:
unparsable, relabelled, grief_mixed_logistics, spec_sensitive, guardrail_humanity, degenerate_after_strip,
collapsed_duplicates, kept; then dup_capped among relabelled and kept ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import UNICODE, any_of, has, quoted, strip, word_count
from .prompts import FIELDS, recommendations

_KIN = "brother child dad daughter father husband mom mother partner sister son spouse wife".split()
_NEAR = "dad daughter father husband mom mother partner son wife".split()
GRIEF = rf"(?i)\b(?:funeral|(?:he|she|they) died|in hospice|just (?:passed|died)|lost my (?:{'|'.join(_KIN)})|my (?:{'|'.join(_NEAR)}) (?:just )?(?:passed|died)|passed (?:on|away)|terminally ill)\b"
LOGISTICS = r"(?i)\b(?:closing|deed|down payment|escrow|estate|inherit|loan|mortgage|payment|pre-?approv|property|rate|refinance|survivorship|title)\b"
PITCH = r"(?i)\b(?:appl(?:y|ication)|bankruptc|down payment|foreclosur|investment property|late (?:mortgage )?payment|loan|mortgage|move forward|next step|pre-?approv|primary residence|property use|qualify(?:ing)?|rate|refinanc)\b"
HUMAN = r"(?i)\b(?:100% real|a human being|a real person|i am (?:a )?real|i am human|i'?m (?:a )?real|i'?m human|not a bot|real human|really a person|yes,? (?:a )?real)\b"
ROUTED = ("complaint", "compliance", "inappropriate", "legal", "opt out", "opt-out", "stop")
CIRCLE = ("asked a mortgage question", "off topic", "off-topic", "small talk", "small-talk")

#: Openers that go whatever follows them, and those that go before a mark only.
HARD = [
    "appreciate that", "appreciate you", "for sure", "glad to hear", "good to hear", "good to know", "got it", "gotcha", "haha", "i appreciate it", "i appreciate that",
    "i feel you", "i get it", "i hear you", "i totally get it", "i understand", "lol", "makes sense", "no problem", "no problem at all", "no worries",
    "no worries at all", "not a problem", "not a problem at all", "of course", "sounds good", "sure thing", "thank you for confirming", "thanks for confirming",
    "thanks for letting me know", "thanks for letting us know", "thanks for reaching out", "thanks for sharing", "thanks for that", "thanks for the info",
    "thanks for the update", "understood",
]
SOFT = [
    "absolutely", "alright", "awesome", "cool", "fantastic", "great", "love it", "love that", "nice", "ok", "okay", "perfect", "right", "so", "sure", "totally", "well",
    "wonderful", "yeah", "yep", "yup",
]
_KIND = any_of("amazing", "awesome", "excellent", "glad", "good", "great", "happy", "lovely", "nice", "perfect", "wonderful")
_ACT = any_of("catch up", "chat", "connect", "hear", "know", "meet", "see", "talk")
_OPENER = rf"[—\s,.;:?!-]*(?:(?:{any_of(*HARD)})\b[,\s]*[—-]?\s*|(?:{any_of(*SOFT)})\b\s*[—!,.?-]+\s*|(?:{_KIND})\s+to\s+(?:{_ACT})\b[^!.?]{{0,20}}[!,.]+\s*)"
#: All openers at once: the same as taking one off until none is left.
OPENERS = rf"(?i)\A(?:{_OPENER})+"
GREETING = r"(?i)^\s*(?:heya|hello|hiya|hey|hi)\b"
FILLER = r"(?i)^\s*(?:" + any_of("absolutely", "awesome", "good to", "got it", "gotcha", "great", "i understand", "makes sense", "nice", "no problem", "no worries", "of course", "perfect", "sounds good", "sure thing", "thanks for", "totally", "understood", "yeah") + r")\b"

COMFORT = [
    "I am very sorry for your loss. Take all the time you need, and write when you feel ready.",
    "That must be so hard, I am sorry. Nothing here is urgent; come back whenever you like.",
    "My heart goes out to you. Look after yourself first, I will be around later.",
    "I am sorry you have to go through this. There is no pressure from me at all.",
    "My condolences to you and yours. We can speak again at any time that suits you.",
    "I cannot imagine how this feels. Please take your time; I am here when you want.",
    "I am truly sorry. Leave all of this for another day, and reach out when you wish.",
    "Sending you my sympathy. Whenever you want to continue, I will gladly help.",
]
QUESTIONS = {
    "late_payments_past_12mo": "Were there any late mortgage payments in the last 12 months?",
    "foreclosure_past_2yr": "Was there any foreclosure in the past 2 years?",
    "bankruptcy_past_3yr": "Was there any bankruptcy in the past 3 years?",
    "property_use": "Will it be your main home, a second home or an investment?",
}


def _lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")


def context_value(user: Column, label: str) -> Column:
    """A field's value from a rendered context: of several lines with its key the last; null without one."""
    lines = F.filter(_lines(user), lambda x: x.contains(":") & ~x.startswith("---") & ~x.startswith("SITUATION"))
    mine = F.filter(lines, lambda x: strip(F.substring_index(x, ":", 1)) == label)
    last = F.get(mine, F.size(mine) - 1)
    return strip(F.regexp_replace(last, r"(?s)\A[^:]*:", ""))


def situation(user: Column) -> Column:
    """The first line that begins with SITUATION, else ''."""
    return F.coalesce(F.get(F.filter(_lines(user), lambda x: x.startswith("SITUATION")), F.lit(0)), F.lit(""))


def pick3(seed: Column, pool: list[str]) -> Column:
    """Three different entries chosen by md5 of the seed: a start, then steps of 1 + h mod 3, modulo the pool's size (8)."""
    if len(pool) != 8:
        raise ValueError("the pool has 8 entries")
    h = F.md5(seed)
    start = F.conv(F.substring(h, -1, 1), 16, 10).cast("int") % 8
    digits = F.transform(F.split(h, ""), lambda d: F.when(d != "", F.conv(d, 16, 10).cast("int")).otherwise(0))
    step = 1 + F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 3
    entries = F.array(*map(F.lit, pool))
    return F.array(*[F.get(entries, (start + k * step) % 8) for k in range(3)])


def _name_steps(name: Column) -> list:
    """Greetings with the name, and the name as a form of address, out of a message."""
    q = quoted(name)
    cuts = [
        (F.concat(F.lit(r"\A\s*(?i:hiya|heya|hey|hello|hi)\s+(?i:"), q, F.lit(r")\b[\s,!.:-]*")), ""),
        (F.concat(F.lit(r"\A\s*"), q, F.lit(r"\s*[,!:-]+\s*")), ""),
        (F.concat(F.lit(r"\s*,\s*"), q, F.lit(r"\b(?=[\s.!?,]|\z)")), ""),
        (F.concat(F.lit(r"\s+"), q, F.lit(r"\s*([.!?])\s*\z")), "$1"),
    ]
    # Few messages hold the name; only those pay for a pattern of their own.
    step = lambda p, r: lambda m: F.when(F.lower(m).contains(F.lower(name)), F.regexp_replace(m, F.concat(F.lit(UNICODE), p), F.lit(r))).otherwise(m)
    return [step(p, r) for p, r in cuts]


def drop_openers(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + OPENERS, "")


def _marks(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\A[—\s,.;:?!-]+", "")
    c = F.regexp_replace(c, r"\A[ \t—,;:-]+|[ \t—,;:-]+\z", "")
    c = F.regexp_replace(c, r"(?U)\s+([.,;:!?])", "$1")
    return strip(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def _capital(c: Column) -> Column:
    first = r"(?s)\A(\P{L}*)(\p{L})(.*)\z"
    return F.when(c.rlike(first), F.concat(F.regexp_extract(c, first, 1), F.upper(F.regexp_extract(c, first, 2)), F.regexp_extract(c, first, 3))).otherwise(c)


def _through(messages: Column, steps: list) -> Column:
    """Each step over all messages in turn. A lambda binds the message, so that steps that
    use it several times don't multiply the expression."""
    for step in steps:
        messages = F.transform(messages, step)
    return messages


def drop_name(message: Column, name: Column, is_first: Column) -> Column:
    """One message without the client's name, unless it is the first or the name is missing."""
    named = name.isNotNull() & (name != "") & (F.lower(name) != "n/a") & ~is_first
    return F.when(named, F.get(_through(F.array(message), _name_steps(name)), F.lit(0))).otherwise(message)


def tidy(c: Column) -> Column:
    """No marks in front, no blanks before marks, single blanks, the first letter upper case."""
    return F.get(_through(F.array(c), [_marks, _capital]), F.lit(0))


def clean_messages(messages: Column, name: Column, is_first: Column) -> Column:
    """Names off (see drop_name), openers off, tidied: all messages of a record."""
    named = name.isNotNull() & (name != "") & (F.lower(name) != "n/a") & ~is_first
    without = F.when(named, _through(messages, _name_steps(name))).otherwise(messages)
    return _through(without, [drop_openers, _marks, _capital])


def circle_back(message: Column, key: Column) -> Column:
    question = F.create_map(*[F.lit(x) for k, q in QUESTIONS.items() for x in (k, q[0].lower() + q[1:])])[key]
    return F.when(question.isNull() | message.contains("?"), message).otherwise(F.concat(F.regexp_replace(message, r"[ .!]+\z", ""), F.lit(". Anyway - "), question))


def clean(records: DataFrame, order: str, user: str = "user", reply: str = "reply", least_words: int = 3, cap: int = 3) -> DataFrame:
    """The rows with ``outcome``, ``messages_out`` (three cleaned messages, where kept), ``circled``, ``relabelled`` and ``modified``."""
    u, texts = F.col(user), F.col("_texts")
    value = lambda name: F.coalesce(context_value(u, FIELDS[name]), F.lit(""))
    df = records.withColumns({"_recs": recommendations(F.col(reply)), "_latest": value("latest"), "_name": value("client"), "_key": value("next_key"), "_first": F.lower(value("is_first")).isin("yes", "true"), "_sit": F.lower(situation(u))})
    df = df.withColumn("_texts", F.transform("_recs", lambda r: F.coalesce(r["suggested_message"], F.lit(""))))
    any_text = lambda pattern: F.exists(texts, lambda m: has(m, pattern))
    listed = lambda words: F.col("_sit").rlike("|".join(map(re.escape, words)))
    grief = has(F.col("_latest"), GRIEF)
    early = (
        F.when(F.col("_recs").isNull() | (F.size("_recs") != 3), "unparsable")
        .when(grief & ~has(F.col("_latest"), LOGISTICS), "relabelled")
        .when(grief & any_text(PITCH), "grief_mixed_logistics")
        .when(listed(ROUTED), "spec_sensitive")
        .when(any_text(HUMAN), "guardrail_humanity")
    )
    df = df.withColumn("_early", early).withColumn("_new", F.when(F.col("_early").isNull(), clean_messages(texts, F.col("_name"), F.col("_first"))))
    circled = F.col("_early").isNull() & listed(CIRCLE) & (F.col("_key") != "") & ~F.exists("_new", lambda m: m.contains("?"))
    df = df.withColumn("circled", F.coalesce(circled, F.lit(False)) & ~F.coalesce(F.exists("_new", lambda m: word_count(m) < least_words), F.lit(False)))
    first = F.when(F.col("circled"), circle_back(F.get("_new", F.lit(0)), F.col("_key"))).otherwise(F.get("_new", F.lit(0)))
    df = df.withColumn("_out", F.when(F.col("_early") == "relabelled", pick3(u, COMFORT)).when(F.col("_early").isNull(), F.array(first, F.get("_new", F.lit(1)), F.get("_new", F.lit(2)))))
    late = F.when(F.exists("_new", lambda m: word_count(m) < least_words), "degenerate_after_strip").when(F.size(F.array_distinct("_out")) < 3, "collapsed_duplicates").otherwise("kept")
    df = df.withColumn("outcome", F.coalesce("_early", late)).withColumn("messages_out", F.when(F.col("outcome").isin("kept", "relabelled"), F.col("_out")))
    df = df.withColumn("modified", F.col("messages_out").isNotNull() & ~F.coalesce(F.col("messages_out") == F.col("_texts"), F.lit(False)))
    df = df.withColumn("relabelled", F.coalesce(F.col("_early") == "relabelled", F.lit(False)))
    # Rows that don't go on are spread by their order column, so that null messages form no hot key.
    spread = F.when(F.col("messages_out").isNull(), F.col(order))
    rank = F.row_number().over(W.partitionBy(user, "messages_out", spread).orderBy(order))
    out = df.withColumn("outcome", F.when(F.col("messages_out").isNotNull() & (rank > cap), "dup_capped").otherwise(F.col("outcome")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def cap_duplicates(df: DataFrame, keys: list[str], order: str, cap: int = 3) -> DataFrame:
    """The first ``cap`` rows of every key, in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= cap).drop("_n")


def report(cleaned: DataFrame) -> DataFrame:
    """metric, value: the counters of a cleaning run."""
    o = F.col("outcome")
    routed = ("grief_mixed_logistics", "spec_sensitive", "guardrail_humanity", "degenerate_after_strip", "collapsed_duplicates")
    metrics = {"total": F.count("*"), "unparsable_dropped": F.count_if(o == "unparsable"), "records_modified": F.count_if("modified"), "circle_back_added": F.count_if("circled"), "dup_capped": F.count_if(o == "dup_capped"), "kept": F.count_if(o.isin("kept", "relabelled")), "routed_to_regen": F.count_if(o.isin(*routed))}
    metrics["grief_relabeled"] = F.count_if("relabelled")
    metrics |= {name: F.count_if(o == name) for name in routed}
    row = cleaned.agg(*[c.cast("long").alias(k) for k, c in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def quality(records: DataFrame, texts: str, name: str, is_first: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each value of ``by``, if given): records, suggestions, and how many hold fillers, artifacts, names or greetings (the latter two among records that aren't first);
    and the rates of fillers a suggestion, of names and greetings a record that isn't first (0 where there is none)."""
    t, n = F.col(texts), F.lower(F.coalesce(F.col(name), F.lit("")))
    count = lambda p: F.size(F.filter(t, lambda m: p(m)))
    rest = ~F.coalesce(F.lower(F.col(is_first)).isin("yes", "true"), F.lit(False))
    named = (n != "") & (n != "n/a") & F.exists(t, lambda m: F.lower(m).contains(n))
    counts = records.groupBy(*by).agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.size(t)), F.lit(0)).alias("suggestions"), F.coalesce(F.sum(count(lambda m: has(m, FILLER))), F.lit(0)).alias("fillers"), F.coalesce(F.sum(count(lambda m: has(m, r"\A[\s.,;:!?]") | m.contains("  "))), F.lit(0)).alias("artifacts"),
        F.count_if(rest).alias("not_first"), F.count_if(rest & named).alias("named"), F.count_if(rest & F.exists(t, lambda m: has(m, GREETING))).alias("greeted"),
    )
    rate = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    return counts.withColumns({"filler_rate": rate("fillers", "suggestions"), "name_rate": rate("named", "not_first"), "greeting_rate": rate("greeted", "not_first")})
