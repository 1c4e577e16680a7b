"""Reply tasks from conversations; mining of situations from client turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import COMPANY
from ..functions.text import has


def topic(company: str = COMPANY) -> str:
    """Pattern of home lending, and the company's name."""
    return (
        r"(?i)\b(?:home (?:loan|equity)|mortgage|loan (?:amount|officer)|refinanc|\brefi\b|interest rate|pre-?approv|escrow|closing cost|"
        r"down payment|underwrit|credit score|appraisal|(?:buy|purchase) a home|" + company.lower() + r")\b"
    )


TOPIC = topic()
#: Its stems also match inflected forms, which the trailing word boundary above rules out.
TOPIC_STEMS = TOPIC.replace("refinanc|", r"refinanc\w*|").replace("pre-?approv|", r"pre-?approv\w*|").replace("underwrit|", r"underwrit\w*|")

_KIN = "(?:dad|father|husband|mom|mother|wife)"
#: The first that matches decides.
INTENTS: list[tuple[str, str]] = [
    ("life_event", rf"(?i)(?:family emergency|\bcancer\b|\bdivorce|funeral|got fired|hospitali[sz]|in the hospital|laid off|lost my (?:job|{_KIN[3:-1]})|my {_KIN} (?:just )?(?:passed|died)|passed away)"),
    ("stop", r"(?i)^\s*(?:do not (?:text|contact)|quit texting|remove me|unsubscribe|stop)"),
    ("escalation", r"(?i)\b(?:cfpb|attorney|file a complaint|harass|lawsuit|lawyer|sue you|sue your)\b"),
    ("not_interested", r"(?i)\b(?:changed my mind|don'?t want|forget it|no longer interested|not interested|not looking anymore|please stop)\b"),
    ("other_lender", r"(?i)\b(?:already (?:have a lender|got a quote|working)|another lender|different lender|going with (?:someone|another)|my bank is|other lender)\b"),
    ("busy", r"(?i)\b(?:call me (?:back|later)|can'?t talk|i'?m (?:at work|busy|driving)|in a meeting|not a good time|text me later)\b"),
    ("rate_shopping", r"(?i)(?:best rate|current rates?|how much (?:are|is) (?:the )?rate|rate shopping|what'?s? (?:the|todays?|your) (?:interest|rate))"),
    ("loan_question", r"(?i)\b(?:can i (?:afford|buy|qualify)|difference between|do i need|how (?:does|long)|how much (?:do i|can i)|what (?:are|is a|credit|documents|score)).*\?"),
]
MODE_OF = {"busy": "logistics", "life_event": "empathy", "not_interested": "objection"}


def candidates(turns: DataFrame, key: str = "conv_id", last: int | None = None) -> DataFrame:
    """Agent turns with a client turn before them: turn_idx, is_first, gold_reply; and with ``last`` their history, that many turns before
    them at most, from the same shuffle."""
    order = W.partitionBy(key).orderBy("turn")
    asked = F.max(F.when(F.col("role") == "client", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    out = turns.withColumn("_asked", asked)
    also = []
    if last is not None:
        out, also = out.withColumn("history", F.collect_list(F.struct("role", "text")).over(order.rowsBetween(-last, -1))), ["history"]
    out = out.where((F.col("role") == "agent") & (F.col("_asked") == 1))
    return out.select(key, F.col("turn").alias("turn_idx"), (F.col("turn") == 1).alias("is_first"), F.col("text").alias("gold_reply"), *also)


def with_history(tasks: DataFrame, folded: DataFrame, last: int | None = None, key: str = "conv_id") -> DataFrame:
    """The turns before each task (its last ``last`` ones), from conversations folded to arrays."""
    start, n = F.lit(1), F.col("turn_idx")
    if last is not None:  # only what is wanted is copied, not every prefix
        start, n = F.greatest(F.lit(1), n - last + 1), F.least(n, F.lit(last))
    return tasks.join(folded, key).withColumn("history", F.slice("turns", start, n)).drop("turns")


def head_and_sample(tasks: DataFrame, most: int, seed: int = 0, key: str = "conv_id") -> DataFrame:
    """At most that many tasks of a conversation: its first, and others by hash. ``pick`` numbers them."""
    if most < 1:
        raise ValueError("most must be at least 1")
    first = F.col("turn_idx") == F.min("turn_idx").over(W.partitionBy(key))
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("turn_idx").cast("string")))
    order = W.partitionBy(key).orderBy(F.col("_first").desc(), F.col("_rank"), "turn_idx")
    return tasks.withColumns({"_first": first, "_rank": rank}).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most).drop("_first", "_rank")


def on_topic(turns: DataFrame, pattern: str = TOPIC, key: str = "conv_id") -> DataFrame:
    """Turns of conversations whose joined text mentions the topic."""
    whole = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    text = F.array_join(F.collect_list("text").over(whole), " ")
    return turns.withColumn("_all", text).where(has(F.col("_all"), pattern)).drop("_all")


def intent(c: Column) -> Column:
    """The first intent whose pattern occurs, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INTENTS):
        out = F.when(has(c, pattern), F.lit(name)).otherwise(out)
    return out


def mode_of(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MODE_OF.items() for x in pair])[c], c)


def mined(turns: DataFrame, text: Column | None = None, least: int = 8, per: int = 300, seed: int = 0, key: str = "conv_id") -> DataFrame:
    """Client turns with an intent: one of each (intent, lower-case message), the first ``per`` of an intent by hash."""
    said = turns.where((F.col("role") == "client") & (F.length("text") >= least)).withColumn("case", intent(F.col("text"))).where("case is not null")
    said = said.select("case", (F.col("text") if text is None else text).alias("message"), key, "turn").withColumn("_low", F.lower("message"))
    one = W.partitionBy("case", "_low").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("turn").cast("string"))), key, "turn")
    unique = said.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    order = W.partitionBy("case").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "_low")), "_low")
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per).select("case", mode_of(F.col("case")).alias("mode"), "message", "rank")


def union_tasks(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns by name, missing ones null; kind is 'convo' where it is missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("kind", F.coalesce("kind", F.lit("convo"))) if "kind" in out.columns else out.withColumn("kind", F.lit("convo"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)
